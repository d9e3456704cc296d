"""Missing values per location."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cityflux.plans.ranks import percentiles
from cityflux.plans.scratch import measured_side
from cityflux.plans.series import nearest_known

MEASURES = ["aqi_value", "traffic_level"]
_KEYS = ["location"]
_ORDER = ["timestamp", "id"]


def fill_zero(df: DataFrame, columns: list[str]) -> DataFrame:
    """What is still missing becomes 0."""
    return df.fillna(0, subset=columns)


def impute_interpolate(df: DataFrame, measures: list[str] = MEASURES, **plan) -> DataFrame:
    """Linear in time between the known neighbours of a location; edges take the nearest value."""
    rows = nearest_known(df, _KEYS, _ORDER, measures, ahead=True, **plan)
    for m in measures:
        prev, nxt = F.col(f"{m}_prev"), F.col(f"{m}_next")
        t = F.unix_micros(F.col("timestamp").cast("timestamp"))
        t0 = F.unix_micros(prev["t"].cast("timestamp"))
        t1 = F.unix_micros(nxt["t"].cast("timestamp"))
        share = F.coalesce(F.try_divide((t - t0).cast("double"), (t1 - t0).cast("double")), F.lit(0.0))
        v0, v1 = prev["v"].cast("double"), nxt["v"].cast("double")
        blend = F.when(F.col(m).isNotNull(), F.col(m).cast("double")).otherwise(
            F.coalesce(v0 + (v1 - v0) * share, v0, v1)
        )
        rows = rows.withColumn(m, blend).drop(f"{m}_prev", f"{m}_next")
    return fill_zero(rows, measures).select(*df.columns)


def impute_ffill(df: DataFrame, measures: list[str] = MEASURES, **plan) -> DataFrame:
    """The last known value of the location."""
    rows = nearest_known(df, _KEYS, _ORDER, measures, **plan)
    filled = {m: F.coalesce(F.col(m), F.col(f"{m}_prev")["v"]).cast("double") for m in measures}
    rows = rows.withColumns(filled)
    return fill_zero(rows, measures).select(*df.columns)


def _fill_from(df: DataFrame, side: DataFrame, measures: list[str]) -> DataFrame:
    joined = df.join(measured_side(side, "fill-values"), "location", "left")
    filled = {m: F.coalesce(F.col(m).cast("double"), F.col(f"_{m}")) for m in measures}
    return fill_zero(joined.withColumns(filled), measures).select(*df.columns)


def impute_mean(df: DataFrame, measures: list[str] = MEASURES) -> DataFrame:
    """The location's mean; combined map-side, then joined back as a measured side."""
    side = df.groupBy("location").agg(*[F.avg(m).alias(f"_{m}") for m in measures])
    return _fill_from(df, side.filter("location is not null"), measures)


def impute_median(df: DataFrame, measures: list[str] = MEASURES) -> DataFrame:
    """The location's exact median, from value counts."""
    side = None
    for m in measures:
        one = percentiles(df, m, {f"_{m}": 0.5}, _KEYS)
        side = one if side is None else side.join(one, "location", "full")
    return _fill_from(df, side.filter("location is not null"), measures)


STRATEGIES = {
    "interpolate": impute_interpolate,
    "mean": impute_mean,
    "median": impute_median,
    "forward_fill": impute_ffill,
}


def handle_missing(df: DataFrame, strategy: str = "interpolate", measures: list[str] = MEASURES) -> DataFrame:
    """W7-W10 by name."""
    return STRATEGIES[strategy](df, measures)
