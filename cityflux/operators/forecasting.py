"""Per-location linear forecaster: 24 past values to the next 24."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cityflux.operators.splits import lookback_tail
from cityflux.plans.scratch import materialize, measured_side
from cityflux.plans.series import over_rows, running_sum

LOOKBACK = 24
HORIZON = 24
# Partial sums a task holds before passing them on.
_HELD_LOCATIONS = 256

NO_MODEL = "no model trained for location"
TOO_SHORT = "not enough data for forecast"
MISSING = "missing value among the last ones"


def _lagged(span: int):
    """Window columns: the value and the ``span`` - 1 before it, newest first."""
    return lambda spec: {"_l": F.array(F.col("v"), *[F.lag("v", k).over(spec) for k in range(1, span)])}


def _runs(narrow: DataFrame, gaps: int, **plan) -> DataFrame:
    """(location, _run, timestamp, id, v, last): rows with a value; a run has no missing one inside it, ``last`` counts the missing ones of the location."""
    missing = F.col("v").isNull().cast("long")
    if not gaps:
        return narrow.withColumns({"_run": F.lit(0).cast("long"), "last": F.lit(0).cast("long")})
    counted = running_sum(narrow.withColumn("_gap", missing), ["location"], ["timestamp", "id"], "_gap", "_run", **plan)
    side = measured_side(narrow.groupBy("location").agg(F.sum(missing).alias("last")).withColumnRenamed("location", "_at"), "gaps")
    return counted.join(side, F.col("location").eqNullSafe(F.col("_at"))).filter("v IS NOT NULL").drop("_gap", "_at")


def _gram_parts(span: int):
    """Sums of products of (1, window) over the windows of each run, from its lagged products and its first and last values."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}

        def flush() -> pd.DataFrame:
            out = pd.DataFrame({"location": list(held), "gram": [g.ravel() for g in held.values()]})
            held.clear()
            return out

        for frame in batches:
            for row in frame.itertuples():
                # One row more stands behind every window, so the last full one of a location is left out.
                windows = int(row.n) - span + (1 if row.run < row.last else 0)
                if windows < 1:
                    continue
                head, tail, products = np.array(row.head)[::-1], np.array(row.tail)[::-1], np.array(row.products)
                g = np.empty((span + 1, span + 1))
                # Sum over windows of v[s + a] v[s + b]: that of all pairs so far apart, less those before and behind.
                for k in range(span):
                    ahead = np.concatenate(([0.0], np.cumsum(head[: span - k - 1] * head[k : span - 1])))
                    rest = tail[: span - k] * tail[k:]
                    a = np.arange(span - k)
                    # Pairs behind the windows begin at a + windows, counted from the last span values: at a + windows - (n - span).
                    skip = a + windows - (int(row.n) - span)
                    after = np.concatenate((np.cumsum(rest[::-1])[::-1], [0.0]))[np.minimum(skip, span - k)]
                    g[1 + a, 1 + a + k] = g[1 + a + k, 1 + a] = products[k] - ahead[a] - after
                ahead = np.concatenate(([0.0], np.cumsum(head[: span - 1])))
                skip = np.arange(span) + windows - (int(row.n) - span)
                after = np.concatenate((np.cumsum(tail[::-1])[::-1], [0.0]))[np.minimum(skip, span)]
                g[0, 1:] = g[1:, 0] = row.total - ahead - after
                g[0, 0] = windows
                held[row.location] = held.get(row.location, 0) + g
            if len(held) > _HELD_LOCATIONS:
                yield flush()
        if held:
            yield flush()

    return run


def forecast_fit(
    df: DataFrame, value: str = "aqi_value", lookback: int = LOOKBACK, horizon: int = HORIZON, **plan
) -> DataFrame:
    """M9: least squares per location: (location, step, intercept, weights).

    No window is ever built: the products of values up to a window apart are summed per location, and those sums with the
    first and last values of a series give the sums over all its windows. Windows with a missing value, NULL or NaN, are
    left out: what lies between two missing values is a series of its own. A singular system gets its smallest solution.
    """
    span, keys, order = lookback + horizon, ["location", "_run"], ["timestamp", "id"]
    v = F.col(value).cast("double")
    narrow = materialize(df.select("location", "timestamp", "id", F.when(~F.isnan(v), v).alias("v")), "values")
    # Products keep their digits about the middle of the values.
    shift, gaps = narrow.agg(F.coalesce(F.avg("v"), F.lit(0.0)), F.count_if(F.col("v").isNull())).first()
    rows = _runs(narrow, gaps, **plan).withColumn("v", F.col("v") - shift)
    lags = over_rows(rows, keys, order, _lagged(span), span - 1, **plan)
    at, full = F.struct(*order), F.col("_l")[span - 1].isNotNull()
    sums = lags.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.max("last").alias("last"), F.sum("v").alias("total"),
        F.array(*[F.sum(F.col("v") * F.col("_l")[k]) for k in range(span)]).alias("products"),
        F.max_by("_l", at).alias("tail"), F.min_by("_l", F.when(full, at)).alias("head"),
    )
    long = sums.filter(F.col("n") >= span).withColumnRenamed("_run", "run")
    parts = long.mapInPandas(_gram_parts(span), "location string, gram array<double>")
    cells = parts.select("location", F.posexplode("gram").alias("at", "s"))
    sums = cells.groupBy("location", "at").agg(F.sum("s").alias("s"))
    # One list per location of a fixed length: the cells of its matrix.
    grams = sums.groupBy("location").agg(F.sort_array(F.collect_list(F.struct("at", "s"))).alias("cells"))
    flat = grams.select("location", F.transform("cells", lambda c: c["s"]).alias("gram"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = 1 + lookback + horizon
        for pdf in batches:
            out = []
            for location, gram in zip(pdf["location"], pdf["gram"]):
                g = np.asarray(gram, dtype=float).reshape(size, size)
                n, means = g[0, 0], g[0] / g[0, 0]
                centered = g - n * np.outer(means, means)
                x, y = slice(1, 1 + lookback), slice(1 + lookback, size)
                weights = np.linalg.pinv(centered[x, x], hermitian=True) @ centered[x, y]
                intercepts = means[y] + shift - (means[x] + shift) @ weights
                out += [(location, s + 1, float(intercepts[s]), weights[:, s].tolist()) for s in range(horizon)]
            yield pd.DataFrame(out, columns=["location", "step", "intercept", "weights"])

    return flat.mapInPandas(solve, "location string, step int, intercept double, weights array<double>")


def forecast(df: DataFrame, fit: DataFrame, value: str = "aqi_value", lookback: int = LOOKBACK, horizon: int = HORIZON) -> DataFrame:
    """(location, step, value, reason): the next values of every location, or why there are none."""
    tail = lookback_tail(df, value, lookback)
    steps = tail.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    same = steps["location"].eqNullSafe(fit["location"]) & (steps["step"] == fit["step"])
    joined = steps.join(fit, same, "left").select(steps["*"], "intercept", "weights")
    products = F.zip_with("values", "weights", lambda v, w: v * w)
    guess = F.col("intercept") + F.aggregate(products, F.lit(0.0), lambda a, b: a + b)
    reason = F.when(F.col("weights").isNull(), NO_MODEL).when(F.col("n") < lookback, TOO_SHORT)
    reason = reason.when(F.exists("values", lambda v: v.isNull() | F.isnan(v.cast("double"))), MISSING)
    return joined.select("location", "step", F.when(reason.isNull(), guess).alias("value"), reason.alias("reason"))
