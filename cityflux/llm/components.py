"""Connected components of a graph kept in tables, by alternating star steps.

A large star hangs every larger neighbour of a node on the least node around it, a small star does so
with the smaller ones; both keep connectivity, and a few rounds leave one star per component. Every
step is a minimum per node and a join on nodes, so no neighbourhood is ever gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cityflux.plans.scratch import materialize


def _least(directed: DataFrame) -> DataFrame:
    """For rows (a, b): the least of a and all its b."""
    return directed.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.join(_least(both), "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = _least(down)
    moved = down.join(least, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the least node of its component.

    Edges may repeat and point either way; loops and nulls are ignored. No edges: no rows.
    """
    state, shape = materialize(edges.select("a", "b").filter("a != b").distinct(), "edges"), None
    while True:
        now = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == shape:
            break
        shape = now
        state = materialize(_small_star(_large_star(state).distinct()).filter("a != b").distinct(), "stars")
    return state.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(state.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
