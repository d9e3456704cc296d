"""Approximate nearest neighbours by a permutation index.

Pivots are points of a bounded sample that lie far apart. A vector is represented by its nearest pivots in order; within a
block of rows, every pivot has an inverted file of the vectors that list it, with the place they list it at.
A query walks the files of its own pivots, ranks all vectors met by footrule distance between the two
orders, and compares the best of them exactly. Every row is indexed, every query sees every block.

Inner products become distances by one more coordinate that levels the norms, so that nearest pivots and
largest inner products agree for vectors of any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cityflux.plans.scratch import materialize

NEAREST = 20
QUERY_EVERY = 20
# Vectors pivots are drawn from, pivots, and how many of them represent a vector.
SAMPLE, PIVOTS, LISTED = 4_096, 256, 48
# Share of a block's vectors, and least number, compared exactly after the ranking.
SHARE, LEAST = 0.2, 400
# Vectors of a block, queries of a group.
BLOCK, GROUP = 16_384, 2_048


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long"), v.alias("embedding")).filter(F.col("vec_id").isNotNull() & fine)


def _order(points: np.ndarray, pivots: np.ndarray, listed: int) -> np.ndarray:
    """The ``listed`` nearest pivots of each point, in order."""
    away = (pivots**2).sum(1)[None, :] - 2 * points @ pivots.T
    k = min(listed, len(pivots))
    near = np.argpartition(away, k - 1, axis=1)[:, :k]
    return np.take_along_axis(near, np.argsort(np.take_along_axis(away, near, 1), axis=1, kind="stable"), 1)


def _apart(points: np.ndarray, most: int) -> np.ndarray:
    """Points far from each other: each next is the farthest from those chosen, so that copies of one do not crowd the pivots."""
    chosen = [0]
    away = ((points - points[0]) ** 2).sum(1)
    while len(chosen) < min(most, len(points)):
        chosen.append(int(away.argmax()))
        away = np.minimum(away, ((points - points[chosen[-1]]) ** 2).sum(1))
    return points[chosen]


class Block:
    """A block's vectors, their inverted files by pivot, and the search in them."""

    def __init__(self, vectors: np.ndarray, pivots: np.ndarray, longest: float, listed: int):
        self.vectors, self.pivots, self.longest = vectors, pivots, longest
        order = _order(np.hstack((vectors, self._level(vectors))), pivots, listed)
        self.listed = order.shape[1]
        rows, place = np.divmod(np.arange(order.size), self.listed)
        by_pivot = np.argsort(order.ravel(), kind="stable")
        self.rows, self.place = rows[by_pivot], place[by_pivot].astype(np.int32)
        self.start = np.searchsorted(order.ravel()[by_pivot], np.arange(len(pivots) + 1))

    def _level(self, vectors: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.longest**2 - (vectors**2).sum(1), 0))[:, None]

    def candidates(self, queries: np.ndarray, most: int) -> Iterator[np.ndarray]:
        """For each query the ``most`` vectors nearest by footrule, ties by row."""
        # Scaled to the longest norm, a query's nearest pivots are those of largest inner product.
        scaled = queries * (self.longest / np.sqrt((queries**2).sum(1)))[:, None]
        orders = _order(np.hstack((scaled, np.zeros((len(queries), 1)))), self.pivots, self.listed)
        for order in orders:
            # Footrule with missing places counted as last falls by 2 * (listed - later place) per common pivot.
            common = np.zeros(len(self.vectors), np.int32)
            for at, pivot in enumerate(order):
                own = slice(self.start[pivot], self.start[pivot + 1])
                common[self.rows[own]] += self.listed - np.maximum(self.place[own], at)
            if most >= len(common):
                yield np.arange(len(common))
            else:
                # One key orders by footrule, then row.
                key = (-common.astype(np.int64)) * len(common) + np.arange(len(common))
                yield np.argpartition(key, most - 1)[:most]

    def nearest(self, queries: np.ndarray, k: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, inner products) of the k best candidates of each query, ties included."""
        for query, rows in zip(queries, self.candidates(queries, most)):
            # Summed row by row in one order: equal vectors get equal scores.
            scores = np.add.reduce(self.vectors[rows] * query, axis=1)
            if len(rows) > k:
                fine = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
                rows, scores = rows[fine], scores[fine]
            yield rows, scores


def search(
    vectors: DataFrame, queries: DataFrame, k: int = NEAREST, pivots: int = PIVOTS, listed: int = LISTED, share: float = SHARE, least: int = LEAST, sample: int = SAMPLE, block: int = BLOCK, group: int = GROUP, seed: int = 3
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k nearest other rows by inner product.

    Rows with a null id, a null or zero vector, or null or non-finite components take no part, on
    either side. Every row is a candidate, also of several with one id; those with the query's id are its own. Of queries
    with one id the least vector of each length asks. Equal vectors are indexed once with their k + 1 least ids,
    which is all that can be in a result, as ties go to the smaller id. Vectors of each length are searched among
    themselves. Empty tables: no rows. Other columns are left out.
    """
    rows = materialize(usable(vectors), "vectors")
    asked = usable(queries).groupBy(F.col("vec_id").alias("query_id"), F.size("embedding").alias("width")).agg(F.min("embedding").alias("embedding"))
    asked = materialize(asked, "queries")
    found = None
    for r in rows.select(F.size("embedding").alias("width")).distinct().collect():
        of_width = rows.filter(F.size("embedding") == r["width"])
        own = _search(of_width, asked.filter(F.col("width") == r["width"]).drop("width"), k, pivots, listed, share, least, sample, block, group, seed)
        found = own if found is None else found.unionByName(own)
    if found is None:
        return asked.select("query_id", F.lit(1).alias("rank"), F.col("query_id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(rows: DataFrame, asked: DataFrame, k: int, pivots: int, listed: int, share: float, least: int, sample: int, block: int, group: int, seed: int) -> DataFrame:
    """query_id, vec_id, score: of every block each query's k best, over vectors of one length."""
    # One row per distinct vector; the rank filter also runs before the shuffle, so copies do not pile up.
    rank = F.row_number().over(W.partitionBy("embedding").orderBy("vec_id"))
    few = rows.withColumn("_rank", rank).filter(F.col("_rank") <= k + 1)
    distinct = materialize(few.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "distinct")
    number, longest = distinct.agg(F.count("*"), F.max(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))).first()
    longest = float(np.sqrt(longest))
    # The least hashes: at most ``sample`` rows come to the driver.
    drawn = distinct.select("embedding", F.xxhash64(F.lit(seed), "embedding").alias("h")).orderBy("h").limit(sample).collect()
    drawn = _apart(np.array([r["embedding"] for r in drawn], float), pivots)
    centres = np.hstack((drawn, np.sqrt(np.maximum(longest**2 - (drawn**2).sum(1), 0))[:, None]))
    blocks, groups = max(1, -(-number // block)), max(1, -(-asked.count() // group))
    # Every group of queries meets every block, a bounded number of each in a task.
    left = distinct.withColumn("block", F.pmod(F.xxhash64("embedding"), F.lit(blocks)).cast("int"))
    left = left.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = asked.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int"))
    right = right.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(rows: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(asking):
            rows = rows.assign(least=rows["ids"].str[0]).sort_values("least")
            held = Block(np.array(rows["embedding"].tolist(), float), centres, longest, listed)
            ids, most = rows["ids"].to_numpy(), max(least, int(np.ceil(share * len(rows))))
            for query, (found, scores) in zip(asking["query_id"], held.nearest(np.array(asking["embedding"].tolist(), float), k + 1, most)):
                pairs = [(query, int(i), s) for r, s in zip(found, scores) for i in ids[r] if i != query]
                out += sorted(pairs, key=lambda p: (-p[2], p[1]))[:k]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(run, "query_id long, vec_id long, score double")


def every(vectors: DataFrame, step: int = QUERY_EVERY) -> DataFrame:
    return vectors.filter(F.col("vec_id") % step == 0)
