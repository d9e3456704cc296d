"""Mixing sources to target weights by fitting subset sums.

Documents are counted by exact length within their source. A source takes all its documents as
often as they fit whole into its target; for what remains, the same share of every length is taken, then
longer lengths first, and a bounded-knapsack dynamic program over the lengths left closes the last
gap to the word where lengths allow. Which documents of a length are taken is decided by a seeded hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cityflux.llm.common import SPACE
from cityflux.plans.scratch import materialize, measured_side

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
# The dynamic program covers at least so many words below the target.
GAP = 4_096


def size_of(text: Column) -> Column:
    """Words of a text, null as none: the places where a word begins."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"(?:^|{SPACE})[^\\x20\\x09-\\x0D]")).cast("long")


def _numbered(sources: DataFrame) -> DataFrame:
    """Sources with their 0-based number by code point, null last, without one task for all of them."""
    cut = materialize(sources.repartitionByRange(F.col("source").isNull(), "source").withColumn("_part", F.spark_partition_id()), "sources")
    # One row for each partition of the cut: as many as the shuffle has, whatever the sources.
    before = W.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = cut.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    inside = cut.withColumn("_at", F.row_number().over(W.partitionBy("_part").orderBy(F.col("source").asc_nulls_last())) - 1)
    return inside.join(starts, "_part").withColumn("number", F.col("_start") + F.col("_at")).drop("_part", "_start", "_at")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_REPEATS, share: float = 1.0) -> DataFrame:
    """source, source_size, target from rows (source, size).

    Weights repeat over the sources by code point; a target stops at ``most`` times its source and the
    excess goes to the others by weight until none is above. Only sums come to the driver.
    """
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("number") % len(weights)).cast("int"))
    per = materialize(_numbered(sizes.groupBy("source").agg(F.sum("size").alias("source_size"))).withColumn("_weight", weight), "targets")
    total = float(per.agg(F.sum("source_size")).first()[0] or 0) * share
    cap = F.col("source_size") * float(most)
    # Targets are min(cap, weight * level); each pass fixes those above and shares the rest anew.
    level, fixed = 0.0, -1
    while True:
        above = F.col("_weight") * level > cap
        capped, held, open_ = per.agg(F.count(F.when(above, 1)), F.sum(F.when(above, cap).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("_weight")))).first()
        if capped == fixed or not open_:
            break
        level, fixed = (total - held) / open_, capped
    return per.select("source", "source_size", F.least(F.col("_weight") * F.lit(level), cap).alias("target"))


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, gap: int = GAP) -> np.ndarray:
    """How many documents of each length to take to come near ``budget`` words; 0 <= budget <= all."""
    take = np.zeros(len(lengths), np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or not total:
        return take
    if budget >= total:
        return counts.copy()
    # The same share of every length, rounded down (in whole numbers: products pass 2^53).
    take = np.array([int(c) * budget // total for c in counts], np.int64)
    left = budget - int((lengths * take).sum())
    for i in np.argsort(-lengths, kind="stable"):
        n = lengths[i]
        more = min(int(counts[i] - take[i]), max(0, left - gap) // int(n)) if n else 0
        take[i] += more
        left -= more * int(n)
    rest = counts - take
    # Bounded knapsack over what is left, up to one document more: the length by which a sum was first reached.
    open_ = np.flatnonzero((rest > 0) & (lengths > 0))
    top = left + (min(left, int(lengths[open_].max())) if len(open_) else 0)
    reached = np.full(top + 1, -1, np.int64)
    reached[0] = len(lengths)
    for i in open_:
        n, fresh = int(lengths[i]), np.flatnonzero(reached >= 0)
        for _ in range(int(rest[i])):
            fresh = fresh[fresh <= top - n] + n
            fresh = fresh[reached[fresh] < 0]
            if not len(fresh):
                break
            reached[fresh] = i
        if reached[left] >= 0:
            break
    sums = np.flatnonzero(reached >= 0)
    at = int(sums[np.abs(sums - left).argmin()])
    while at:
        take[reached[at]] += 1
        at -= int(lengths[reached[at]])
    return take


def _plan(histogram: DataFrame, gap: int) -> DataFrame:
    """source, size, repeats, picked, n: from rows (source, size, n, source_size, target)."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        lengths, counts = frame["size"].to_numpy(np.int64), frame["n"].to_numpy(np.int64)
        whole, target = int(frame["source_size"].iloc[0]), float(frame["target"].iloc[0])
        repeats = int(target // whole) if whole else 0
        picked = fit(lengths, counts, int(target - repeats * whole), gap)
        return pd.DataFrame({"source": frame["source"], "size": lengths, "repeats": repeats, "picked": picked, "n": counts})

    return histogram.groupBy("source").applyInPandas(run, "source string, size long, repeats long, picked long, n long")


def mix(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_REPEATS, share: float = 1.0, seed: int = 11, gap: int = GAP, per_bucket: int = 100_000
) -> DataFrame:
    """The documents with ``size``, ``source_size``, ``target`` and ``times`` (how often the mix takes each).

    Only numbers of documents are ranked, never their texts. The order is that of a seeded hash of doc_id
    and text, so reruns agree; rows equal in both stand or fall together. A null text has size 0; such
    documents are taken as often as their source goes whole into its target. A null source is a source
    of its own, the last. Empty table: no rows. Columns of docs pass through, whatever their names, but for those named
    as the four added, which are replaced.
    """
    own = ["size", "source_size", "target", "times"]
    rows = _mixed_rows(docs, weights, most, share, seed, gap, per_bucket)
    return rows.select(*[F.col("_row")[c].alias(c) for c in docs.columns if c not in own], *own)


def _mixed_rows(docs: DataFrame, weights: tuple[float, ...], most: int, share: float, seed: int, gap: int, per_bucket: int) -> DataFrame:
    """The documents as one column ``_row``, so that no name of theirs meets one of the mix, with what ``mix`` adds."""
    key = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")).bitwiseAND(2**63 - 1)
    sized = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "source", size_of(F.col("text")).alias("size"), key.alias("_key"))
    slim = materialize(sized.select("source", "size", "_key"), "sizes")
    histogram = materialize(slim.groupBy("source", "size").agg(F.count("*").alias("n")), "lengths")
    sums = histogram.select("source", (F.col("size") * F.col("n")).alias("size"))
    aims = materialize(targets(sums, weights, most, share), "aims")
    planned = materialize(_plan(_join(histogram, aims, ["source"]), gap), "plan")
    # Of some lengths only a part is taken: find the key up to which, hot lengths dealt into ranges of keys.
    partly = measured_side(planned.filter((F.col("picked") > 0) & (F.col("picked") < F.col("n"))), "partly")
    buckets = F.ceil(F.col("n") / per_bucket)
    drawn = _join(slim, partly, ["source", "size"]).withColumn("_bucket", F.shiftright(F.shiftright("_key", 32) * buckets, 31))
    group = ["source", "size", "_bucket"]
    before = W.partitionBy("source", "size").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    counted = drawn.groupBy(*group, "picked").count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0)))
    last = counted.filter((F.col("_before") < F.col("picked")) & (F.col("_before") + F.col("count") >= F.col("picked")))
    ends = _join(drawn.select(*group, "_key"), last.select(*group, (F.col("picked") - F.col("_before")).alias("_need")), group)
    ranked = ends.withColumn("_rank", F.row_number().over(W.partitionBy(*group).orderBy("_key")))
    limits = ranked.filter(F.col("_rank") == F.col("_need")).select("source", "size", F.col("_key").alias("_limit"))
    rules = measured_side(_join(_join(planned, limits, ["source", "size"], "left"), aims, ["source"]), "rules")
    chosen = F.when(F.col("_limit").isNull(), F.col("picked") > 0).otherwise(F.col("_key") <= F.col("_limit"))
    return _join(sized, rules, ["source", "size"]).withColumn("times", F.col("repeats") + chosen.cast("long"))


def _join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, null equal to null; the left side keeps its key columns."""
    a, b = left.alias("_a"), right.alias("_b")
    same = F.lit(True)
    for key in on:
        same = same & F.col(f"_a.`{key}`").eqNullSafe(F.col(f"_b.`{key}`"))
    extra = [F.col(f"_b.`{c}`") for c in right.columns if c not in on]
    return a.join(b, same, how).select("_a.*", *extra)


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_REPEATS, share: float = 1.0, seed: int = 11, gap: int = GAP, per_bucket: int = 100_000) -> DataFrame:
    """The mix itself: documents repeated as often as taken, with their own columns, whatever their names."""
    taken = _mixed_rows(docs, weights, most, share, seed, gap, per_bucket).filter(F.col("times") > 0)
    copies = taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("_copy"))
    return copies.select(*[F.col("_row")[c].alias(c) for c in docs.columns])
