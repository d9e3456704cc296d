"""Ordered per-key series whose hottest key may hold any share of the rows.

A plain window hands a whole key to one task. Here the sizes are looked at first, from the key columns
alone: while every key stays under the limit the plain window runs, and nothing is written; beyond it
the rows are cut by range on (keys, order) into chunks of even size, and each chunk gets what it needs from the chunks before it: the last
``before`` rows (halo) for row frames, or one carried value for running results. Both are exact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cityflux.plans.scratch import materialize

# Rows of one key a single window task may be given.
KEY_ROW_LIMIT = 2_000_000
_CHUNK = "_chunk"
_HALO = "_halo"


def key_sizes(df: DataFrame, keys: list[str]) -> tuple[int, int]:
    """(all rows, rows of the hottest key) in one pass over the keys alone; counts are combined map-side."""
    if not keys:
        rows = df.count()
        return rows, rows
    sizes = df.groupBy(*keys).count()
    row = sizes.agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
    return row[0], row[1]


def has_hot_key(df: DataFrame, keys: list[str], limit: int = KEY_ROW_LIMIT) -> bool:
    """Whether some key holds more rows than one task should get."""
    return key_sizes(df, keys)[1] > limit


def held(df: DataFrame) -> DataFrame:
    """The frame written once, where several passes read it."""
    return materialize(df, "held")


def chunked(df: DataFrame, keys: list[str], order: list[str], rows: int, limit: int, partitions: int | None = None) -> DataFrame:
    """Rows range-cut on (keys, order) into chunks of about half ``limit`` rows, written once, with the number of their cut.

    Range bounds come from a sample, so chunks differ in size (hence the half) and two readings of an
    unwritten plan could be cut differently (hence the write). The number of cuts is asked for by
    number, which adaptive execution leaves as it is.
    """
    cuts = partitions or max(1, -(-2 * rows // limit))
    cut = df.repartitionByRange(cuts, *[F.col(c) for c in keys + order])
    return materialize(cut.withColumn(_CHUNK, F.spark_partition_id()), "series")


def _with_halo(parts: DataFrame, keys: list[str], order: list[str], before: int) -> DataFrame:
    """Chunks with the ``before`` rows that precede each of them, flagged."""
    group = keys + [_CHUNK]
    back = W.partitionBy(*group).orderBy(*[F.col(c).desc() for c in order])
    tails = parts.withColumn("_back", F.row_number().over(back)).filter(F.col("_back") <= before)
    # At most ``before`` rows per chunk and key: small enough to number per key.
    along = W.partitionBy(*keys).orderBy(_CHUNK, F.col("_back").desc())
    tails = tails.withColumn("_at", F.row_number().over(along))
    starts = tails.groupBy(*group).agg(F.min("_at").alias("_start"))
    halo = tails.drop(_CHUNK, "_back").withColumn("_start", F.explode(F.sequence(F.col("_at") + 1, F.col("_at") + before)))
    left, right = halo.alias("h"), starts.alias("s")
    same = F.col("h._start") == F.col("s._start")
    for key in keys:
        same = same & F.col(f"h.{key}").eqNullSafe(F.col(f"s.{key}"))
    halo = left.join(right, same).select("h.*", f"s.{_CHUNK}").drop("_at", "_start")
    return parts.withColumn(_HALO, F.lit(False)).unionByName(halo.withColumn(_HALO, F.lit(True)))


def over_rows(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    columns: Callable[[WindowSpec], dict[str, Column]],
    before: int,
    limit: int = KEY_ROW_LIMIT,
    partitions: int | None = None,
) -> DataFrame:
    """Add window columns whose frames reach at most ``before`` rows back and none ahead.

    ``order`` must give a total order within a key.
    """
    rows, most = key_sizes(df, keys)
    if most <= limit:
        spec = W.partitionBy(*keys).orderBy(*order)
        return df.withColumns(columns(spec))
    rows = _with_halo(chunked(df, keys, order, rows, limit, partitions), keys, order, before)
    spec = W.partitionBy(*keys, _CHUNK).orderBy(*order)
    return rows.withColumns(columns(spec)).filter(~F.col(_HALO)).drop(_HALO, _CHUNK)


def with_position(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    name: str = "position",
    limit: int = KEY_ROW_LIMIT,
    partitions: int | None = None,
) -> DataFrame:
    """Add the 0-based position of each row within its key."""
    return running_sum(df.withColumn("_one", F.lit(1)), keys, order, "_one", name, limit, partitions).withColumn(
        name, (F.col(name) - 1).cast("long")
    ).drop("_one")


def running_sum(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    value: str,
    name: str,
    limit: int = KEY_ROW_LIMIT,
    partitions: int | None = None,
) -> DataFrame:
    """Add the running sum of ``value``, current row included, along ``order`` within a key."""
    rows, most = key_sizes(df, keys)
    if most <= limit:
        # Without keys every row shares one literal key: at most ``limit`` rows, as just measured.
        spec = W.partitionBy(*(keys or [F.lit(0)])).orderBy(*order)
        return df.withColumn(name, F.sum(value).over(spec.rowsBetween(W.unboundedPreceding, 0)))
    parts = chunked(df, keys, order, rows, limit, partitions)
    group = keys + [_CHUNK]
    totals = parts.groupBy(*group).agg(F.sum(value).alias("_total"))
    before = W.partitionBy(*(keys or [F.lit(0)])).orderBy(_CHUNK).rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*group, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    inside = W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = parts.withColumn("_inside", F.sum(value).over(inside))
    return (
        _join_null_safe(rows, offsets, group)
        .withColumn(name, F.col("_offset") + F.col("_inside"))
        .drop("_offset", "_inside", _CHUNK)
    )


def nearest_known(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    measures: list[str],
    ahead: bool = False,
    limit: int = KEY_ROW_LIMIT,
    partitions: int | None = None,
) -> DataFrame:
    """Add, per measure, the closest known (value, first order column) at or before the row.

    Column ``<measure>_prev`` holds a struct(v, t); with ``ahead`` also ``<measure>_next`` from the
    other side. Missing neighbours give NULL.
    """

    def known(m: str) -> Column:
        return F.when(F.col(m).isNotNull(), F.struct(F.col(m).alias("v"), F.col(order[0]).alias("t")))

    def columns(group: list[str]) -> dict[str, Column]:
        # Looking ahead is looking back in the reverse order: a growing frame costs one step a row,
        # a shrinking one starts over at every row.
        back = W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        forth = W.partitionBy(*group).orderBy(*[F.col(c).desc() for c in order]).rowsBetween(W.unboundedPreceding, 0)
        out = {f"{m}_prev": F.last(known(m), ignorenulls=True).over(back) for m in measures}
        if ahead:
            out |= {f"{m}_next": F.last(known(m), ignorenulls=True).over(forth) for m in measures}
        return out

    rows, most = key_sizes(df, keys)
    if most <= limit:
        return df.withColumns(columns(keys))
    parts = chunked(df, keys, order, rows, limit, partitions)
    group = keys + [_CHUNK]
    # One row per chunk and key: its last and first known value of every measure.
    at = F.struct(*order)
    ends = []
    for m in measures:
        when = F.when(F.col(m).isNotNull(), at)
        ends.append(F.max_by(known(m), when).alias(f"_last_{m}"))
        ends.append(F.min_by(known(m), when).alias(f"_first_{m}"))
    edges = parts.groupBy(*group).agg(*ends)
    past = W.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(W.unboundedPreceding, -1)
    coming = W.partitionBy(*keys).orderBy(F.col(_CHUNK).desc()).rowsBetween(W.unboundedPreceding, -1)
    carried = []
    for m in measures:
        carried.append(F.last(f"_last_{m}", ignorenulls=True).over(past).alias(f"_from_{m}"))
        carried.append(F.last(f"_first_{m}", ignorenulls=True).over(coming).alias(f"_to_{m}"))
    rows = _join_null_safe(parts.withColumns(columns(group)), edges.select(*group, *carried), group)
    for m in measures:
        rows = rows.withColumn(f"{m}_prev", F.coalesce(f"{m}_prev", f"_from_{m}"))
        if ahead:
            rows = rows.withColumn(f"{m}_next", F.coalesce(f"{m}_next", f"_to_{m}"))
        rows = rows.drop(f"_from_{m}", f"_to_{m}")
    return rows.drop(_CHUNK)


def _join_null_safe(rows: DataFrame, side: DataFrame, on: list[str]) -> DataFrame:
    """Inner join on equal keys, NULL equal to NULL."""
    left, right = rows.alias("l"), side.alias("r")
    same = None
    for key in on:
        term = F.col(f"l.{key}").eqNullSafe(F.col(f"r.{key}"))
        same = term if same is None else same & term
    extra = [F.col(f"r.{c}") for c in side.columns if c not in on]
    return left.join(right, same).select("l.*", *extra)
