"""Exact order statistics without sorting the facts into one task."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cityflux.plans.series import KEY_ROW_LIMIT, held, key_sizes, running_sum


def value_counts(df: DataFrame, keys: list[str], measure: str) -> DataFrame:
    """How often each known value occurs per key: (keys, v, n). Combined map-side, so hot keys are no matter."""
    known = df.select(*keys, F.col(measure).cast("double").alias("v")).filter(F.col("v").isNotNull())
    return known.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("n"))


def _whole(df: DataFrame, measure: str) -> bool:
    """Whether values are whole numbers, so that counting them by value first is likely to pay."""
    return isinstance(df.schema[measure].dataType, (T.ByteType, T.ShortType, T.IntegerType))


def between(lower, upper, below, above):
    """The built-in interpolation to the last digit: ``below`` and ``above`` are the distances to both ranks."""
    return above * lower + below * upper


def percentiles(
    df: DataFrame,
    measure: str,
    points: dict[str, float],
    keys: list[str] | None = None,
    limit: int | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Exact linearly interpolated percentiles, one row per key (or one row), a column per point.

    The one column is written once. Whole-number measures are counted by value and ended by the built-in
    percentile over (value, count) while no key has more than ``limit`` values; free doubles take the
    built-in one while no key has more than ``limit`` rows. Beyond it a few ranks are found by narrowing,
    and many ranks, or ranks per key, by running counts over range-cut values. All interpolate alike.
    """
    keys = keys or []
    narrow = not keys and len(points) <= _MOST_NARROWED
    if limit is None:
        limit = _NARROW_FROM if narrow else KEY_ROW_LIMIT
    # Only the keys and the measure are written; keys come back under their names.
    df = held(df.select(*keys, F.col(measure).alias(measure)))
    if _whole(df, measure):
        counts = held(value_counts(df, keys, measure))
        if key_sizes(counts, keys)[1] <= limit:
            return counts.groupBy(*keys).agg(*[F.percentile("v", F.lit(p), F.col("n")).alias(c) for c, p in points.items()])
    elif key_sizes(df, keys)[1] <= limit:
        v = F.col(measure).cast("double")
        return df.groupBy(*keys).agg(*[F.percentile(v, F.lit(p)).alias(c) for c, p in points.items()])
    if narrow:
        return _narrowed_percentiles(df, measure, points)
    return _sorted_percentiles(df, measure, points, keys, limit, partitions)


def _sorted_percentiles(df: DataFrame, measure: str, points: dict[str, float], keys: list[str], limit: int, partitions: int | None) -> DataFrame:
    counts = held(value_counts(df, keys, measure))
    ranked = running_sum(counts, keys, ["v"], "n", "_upto", limit, partitions)
    sizes = counts.groupBy(*keys).agg(F.sum("n").alias("_rows"))
    if keys:
        same = [ranked[k].eqNullSafe(sizes[k]) for k in keys]
        ranked = ranked.join(sizes, same).select(ranked["*"], sizes["_rows"])
    else:
        ranked = ranked.withColumn("_rows", sizes.scalar())
    aggs = []
    for name, p in points.items():
        at = (F.col("_rows") - 1) * F.lit(float(p))
        low = F.floor(at)
        lower = F.min(F.when(F.col("_upto") > low, F.col("v")))
        upper = F.min(F.when(F.col("_upto") > F.least(low + 1, F.col("_rows") - 1), F.col("v")))
        exact = F.max(at) == F.max(low)
        mixed = between(lower, upper, F.max(at) - F.max(low), F.max(low) + 1 - F.max(at))
        aggs.append(F.when(exact | (lower == upper), lower).otherwise(mixed).alias(name))
    return ranked.groupBy(*keys).agg(*aggs)


# More points than this are not worth a bracket each.
_MOST_NARROWED = 6
# Fewer rows than this are quicker through the built-in aggregate.
_NARROW_FROM = 100_000
_GRID = 200


def _narrowed_percentiles(df: DataFrame, measure: str, points: dict[str, float]) -> DataFrame:
    known = df.select(F.col(measure).cast("double").alias("v")).filter(F.col("v").isNotNull())
    n = known.count()
    spots = {name: (n - 1) * p for name, p in points.items()}
    ranks = sorted({min(r, n - 1) for at in spots.values() for r in (int(at), int(at) + 1)}) if n else []
    value = values_at_ranks(known, "v", ranks)
    row = []
    for at in spots.values():
        lower, upper = value.get(int(at)), value.get(min(int(at) + 1, n - 1))
        same = lower == upper or at == int(at)
        row.append(lower if lower is None or same else between(lower, upper, at - int(at), int(at) + 1 - at))
    return df.sparkSession.createDataFrame([tuple(row)], ", ".join(f"{name} double" for name in points))


def values_at_ranks(df: DataFrame, col: str, ranks: list[int], leaf: int = 10_000, grid: int = _GRID) -> dict[int, float]:
    """The exact values at some 0-based ranks of a numeric column, NULLs left out.

    Every rank keeps an open bracket of values. One pass counts what lies under, at and inside all
    brackets and takes approximate quantiles of the inside; the exact counts then pick the next,
    some hundred times smaller bracket whatever the distribution. No row is moved; a bracket of at
    most ``leaf`` rows is read outright, and a value many rows share ends the search when hit.
    """
    rows = df.filter(F.col(col).isNotNull())
    low, high = rows.agg(F.min(col), F.max(col)).collect()[0]
    open_ = {r: (low, high, low, high) for r in ranks} if low is not None else {}
    found: dict[int, float] = {}
    leaves: dict[tuple, list[float]] = {}
    v, shares = F.col(col), [i / grid for i in range(grid + 1)]
    while open_:
        brackets = sorted({b[:2] for b in open_.values()})
        aggs = []
        for i, (lo, hi) in enumerate(brackets):
            inside = (v > lo) & (v < hi)
            aggs += [
                F.count_if(v < lo).alias(f"under{i}"), F.count_if(v == lo).alias(f"low{i}"),
                F.count_if(inside).alias(f"in{i}"), F.count_if(v == hi).alias(f"high{i}"),
                F.percentile_approx(F.when(inside, v), shares, 10 * grid).alias(f"grid{i}"),
            ]
        seen = rows.agg(*aggs).collect()[0]
        for r, (lo, hi, wide_lo, wide_hi) in list(open_.items()):
            i = brackets.index((lo, hi))
            under, at_low, inside, at_high = (seen[f"{k}{i}"] for k in ("under", "low", "in", "high"))
            k = r - under - at_low
            if r < under:
                open_[r] = (wide_lo, lo, wide_lo, lo)
            elif k < 0:
                found[r] = lo
            elif k < inside:
                if inside <= leaf:
                    if (lo, hi) not in leaves:
                        leaves[lo, hi] = sorted(x[0] for x in rows.filter((v > lo) & (v < hi)).select(col).collect())
                    found[r] = leaves[lo, hi][k]
                else:
                    step = int(k / inside * grid)
                    marks = seen[f"grid{i}"]
                    next_lo = marks[step - 1] if step > 1 else lo
                    next_hi = marks[step + 2] if step + 2 < grid else hi
                    open_[r] = (next_lo, next_hi, lo, hi)
            elif k < inside + at_high or lo == hi:
                found[r] = hi
            else:
                open_[r] = (hi, wide_hi, hi, wide_hi)
            if r in found:
                del open_[r]
    return found


@dataclass(frozen=True)
class Cut:
    """The row that holds a given rank along (time, id): rows before it are ``row < cut``."""

    micros: int | None
    id: int | None

    def before(self, time_micros: Column, tie: Column) -> Column:
        if self.micros is None:
            return F.lit(True)
        return (time_micros < self.micros) | ((time_micros == self.micros) & (tie < self.id))


def rank_cut(df: DataFrame, time: str, tie: str, rank: int, leaf: int = 10_000, fan: int = 1024) -> Cut:
    """The exact row of 0-based ``rank`` along (time, tie), found by narrowing counts.

    Each pass counts at most ``fan`` even slices of the current bracket and keeps the slice that
    holds the rank; a bracket of at most ``leaf`` rows is ordered outright. No row is moved, and
    later passes scan only the bracket. Rows that share one time are narrowed by ``tie`` alike.
    """
    rows = df.select(time_micros(F.col(time)).alias("k"), F.col(tie).cast("long").alias("i"))
    micros, rank, rows = _narrow(rows, "k", rank, leaf, fan)
    if rank is None:
        return Cut(None, None)
    if micros is not None:
        ident, rank, rows = _narrow(rows.filter(F.col("k") == micros), "i", rank, leaf, fan)
        if ident is not None:
            return Cut(micros, ident)
    row = rows.orderBy("k", "i").offset(rank).limit(1).collect()[0]
    return Cut(row["k"], row["i"])


def _narrow(rows: DataFrame, col: str, rank: int, leaf: int, fan: int):
    """(value, rank, rows): value is set once the bracket is a single value of ``col``."""
    low, high, n = rows.agg(F.min(col), F.max(col), F.count(F.lit(1))).collect()[0]
    if n <= rank:
        return None, None, rows
    while n > leaf:
        if low == high:
            return low, rank, rows.filter(F.col(col) == low)
        width = -(-(high - low + 1) // fan)
        slot = F.expr(f"({col} - ({low}L)) div {width}L").alias("slot")
        inside = rows.filter(F.col(col).between(low, high))
        for s in inside.groupBy(slot).count().orderBy("slot").collect():
            if rank < s["count"]:
                low, high, n = low + s["slot"] * width, min(high, low + (s["slot"] + 1) * width - 1), s["count"]
                break
            rank -= s["count"]
    return None, rank, rows.filter(F.col(col).between(low, high))


# Stands for a missing time: after every real one, and far from overflow when subtracted.
_NO_TIME = 1 << 62


def time_micros(ts: Column) -> Column:
    """Microseconds since the epoch; a missing time sorts last."""
    return F.coalesce(F.unix_micros(ts.cast("timestamp")), F.lit(_NO_TIME))
