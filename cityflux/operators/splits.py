"""Chronological and random splits, folds, sequences."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cityflux.plans.ranks import rank_cut, time_micros
from cityflux.plans.scratch import measured_side
from cityflux.plans.series import over_rows, with_position


def _is_before(df: DataFrame, rank: int, time: str, tie: str, leaf: int) -> Column:
    return rank_cut(df, time, tie, rank, leaf).before(time_micros(F.col(time)), F.col(tie))


def train_rows(n: int, test: float) -> int:
    """Rows before the chronological cut."""
    return int(n * (1 - test))


def time_split(
    df: DataFrame, test: float = 0.2, val: float = 0.2, time: str = "timestamp", tie: str = "id", leaf: int = 10_000
) -> DataFrame:
    """Add ``split``: the latest share is test, the tail of the rest is val, else train.

    The cuts are exact ranks along (time, tie); given them the split is a filter, with no shuffle.
    """
    n = df.count()
    cut = train_rows(n, test)
    first_val = cut - int(cut * val)
    in_train = _is_before(df, first_val, time, tie, leaf)
    in_val = _is_before(df, cut, time, tie, leaf)
    return df.withColumn("split", F.when(in_train, "train").when(in_val, "val").otherwise("test"))


def tail_split(df: DataFrame, share: float = 0.2, time: str = "timestamp", tie: str = "id", leaf: int = 10_000):
    """(head, tail), the tail being the last whole share of the rows; none keeps all in the head."""
    n = df.count()
    head = _is_before(df, n - int(n * share), time, tie, leaf)
    return df.filter(head), df.filter(~head)


def test_rows(n: int, test: float) -> int:
    """Rows of the test part of a random split: the share rounded up."""
    return min(n, ceil(round(n * test, 9)))


def random_split(df: DataFrame, test: float = 0.2, seed: int = 42, tie: str = "id", leaf: int = 10_000) -> DataFrame:
    """Add ``split``: exactly the share of the rows (rounded up) with the least hashes of their ids is test.

    The cut is an exact rank along (hash, id), found by counting; given it the split is a filter, with no shuffle or sort.
    Disjoint, complete, the same on every run and engine; rows of one id stay together.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(tie).cast("string")))
    draw = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    # The search for ranks works along times: a hash is so many microseconds.
    drawn = df.select(F.timestamp_micros(draw).alias("draw"), F.col(tie).cast("long").alias("tie"))
    cut = rank_cut(drawn, "draw", "tie", test_rows(df.count(), test), leaf)
    return df.withColumn("split", F.when(cut.before(draw, F.col(tie)), "test").otherwise("train"))


def contiguous_folds(df: DataFrame, folds: int, order: list[str], by: str | None = None, name: str = "fold", **plan) -> DataFrame:
    """Folds of neighbouring rows, sizes differing by at most one, larger ones first.

    With ``by`` (a class label) rows are dealt within each class, so folds keep the class shares.
    """
    keys = [by] if by else []
    rows = with_position(df, keys, order, "_pos", **plan)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    if by:
        rows = rows.join(measured_side(sizes, "class-sizes"), by)
    else:
        rows = rows.withColumn("_n", sizes.scalar())
    base, extra = F.expr(f"_n div {folds}"), F.col("_n") % folds
    edge = (base + 1) * extra
    late = F.when(base > 0, F.expr(f"(_pos - (_n div {folds} + 1) * (_n % {folds})) div greatest(_n div {folds}, 1)"))
    fold = F.when(F.col("_pos") < edge, F.expr(f"_pos div (_n div {folds} + 1)")).otherwise(extra + late)
    return rows.withColumn(name, fold.cast("int")).drop("_pos", "_n")


def lookback_tail(df: DataFrame, value: str = "aqi_value", lookback: int = 24, ts: str = "timestamp", tie: str = "id") -> DataFrame:
    """The last ``lookback`` values per location, oldest first: (location, n, values).

    The rank limit runs before the shuffle, so a hot location sends at most ``lookback`` rows a task.
    """
    spec = W.partitionBy("location").orderBy(F.col(ts).desc(), F.col(tie).desc())
    last = df.select("location", ts, tie, value).withColumn("_back", F.row_number().over(spec))
    kept = last.filter(F.col("_back") <= lookback)
    pairs = F.sort_array(F.collect_list(F.struct((-F.col("_back")).alias("o"), F.col(value).cast("double").alias("v"))))
    return kept.groupBy("location").agg(F.count(F.lit(1)).alias("n"), F.transform(pairs, lambda p: p["v"]).alias("values"))


def sequences(
    df: DataFrame, value: str = "aqi_value", lookback: int = 24, horizon: int = 24, keys=None, order=None, **plan
) -> DataFrame:
    """(location, idx, past, future): ``lookback`` values, then ``horizon`` from position idx on.

    A window needs one more row behind it; so the last full window of a location is left out.
    """
    keys, order = keys or ["location"], order or ["timestamp", "id"]
    span = lookback + horizon
    narrow = df.select(*keys, *order, F.col(value).cast("double").alias("v"))
    placed = with_position(narrow, keys, order, "_pos", **plan)

    def window(spec):
        return {"_w": F.collect_list(F.struct(F.col("v").alias("v"))).over(spec.rowsBetween(-span, -1))}

    rows = over_rows(placed, keys, order, window, span, **plan)
    rows = rows.filter((F.col("_pos") >= span) & (F.size("_w") == span))
    values = F.transform("_w", lambda s: s["v"])
    return rows.select(
        *keys, (F.col("_pos") - horizon).alias("idx"),
        F.slice(values, 1, lookback).alias("past"), F.slice(values, lookback + 1, horizon).alias("future"),
    )


def unnest_sequences(seq: DataFrame, lookback: int = 24) -> DataFrame:
    """Sequences as (location, idx, step, value), steps -lookback.. then 0.."""
    return seq.select("location", "idx", F.posexplode(F.concat("past", "future")).alias("p", "value")).select(
        "location", "idx", (F.col("p") - lookback).alias("step"), "value"
    )
