"""Vector code compression: product codes by Lloyd's algorithm over two trees.

Vectors become integers and are cut into parts; each part position has its own codebook. A task assigns its rows block by
block: the parts of a block and the entries of the codebook are both put into balanced trees of boxes, and pairs of nodes
are followed from the roots down. A pair is dropped when its least distance exceeds the greatest distance to some other
entry node, for then no point of the node is nearest there. When one entry is left for a node, the node's cached sum and
count go to it as a whole. Leaves where several entries are left are decided point by point. All of it is integer arithmetic, so
the result is that of comparing every part with every entry, whatever the blocks.

Every round is one pass over a written table; tasks pass on one sum per part position, entry and component, which Spark
adds up, and the codebooks (of bounded size) go back with the next round's tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cityflux.llm.common import struct_of
from cityflux.plans.scratch import materialize, measured_side

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
# Rows put in one tree, points of a leaf, pairs of leaf and entry compared at a time.
BLOCK, LEAF, SLICE = 8_192, 8, 16_384


@dataclass
class Tree:
    """A balanced tree of boxes: ``order`` lists the points leaf by leaf; level k has 2**k nodes of equal size.

    Points are filled up with copies of the last one, which weigh nothing.
    """

    order: np.ndarray
    low: list[np.ndarray]
    high: list[np.ndarray]
    sums: list[np.ndarray]
    counts: list[np.ndarray]

    @staticmethod
    def over(points: np.ndarray, leaf: int) -> Tree:
        n, levels = len(points), 0
        while n > leaf << levels:
            levels += 1
        size = -(-n // (1 << levels))
        order = np.minimum(np.arange(size << levels), n - 1)
        weight = np.arange(size << levels) < n
        for level in range(levels):
            held = points[order].reshape(1 << level, -1, points.shape[1])
            widest = (held.max(1) - held.min(1)).argmax(1)
            along = np.take_along_axis(held, widest[:, None, None], 2)[:, :, 0]
            turn = (along.argsort(1, kind="stable") + np.arange(1 << level)[:, None] * along.shape[1]).ravel()
            order, weight = order[turn], weight[turn]
        held = points[order].reshape(1 << levels, size, -1)
        real = weight.reshape(1 << levels, size)
        low, high, sums, counts = [held.min(1)], [held.max(1)], [(held * real[:, :, None]).sum(1)], [real.sum(1)]
        for _ in range(levels):
            for stats, merge in ((low, np.minimum), (high, np.maximum), (sums, np.add), (counts, np.add)):
                stats.insert(0, merge(stats[0][::2], stats[0][1::2]))
        return Tree(np.where(weight, order, -1), low, high, sums, counts)

    @property
    def depth(self) -> int:
        return len(self.low) - 1


def _children(at: np.ndarray, deeper: bool) -> np.ndarray:
    return np.stack((2 * at, 2 * at + 1), 1) if deeper else at[:, None]


def assign(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest entry of each point, lower index on ties; sums and counts of the points by entry)."""
    trees = Tree.over(points, LEAF), Tree.over(entries, 1)
    mine, theirs = trees
    # Filled-up leaves of the entries stand for the last entry.
    index = np.where(theirs.order < 0, len(entries) - 1, theirs.order)
    nearest = np.full(len(points), -1)
    sums, counts = np.zeros_like(entries), np.zeros(len(entries), np.int64)
    p, e, a, b = np.zeros(1, np.int64), np.zeros(1, np.int64), 0, 0
    while True:
        low, high = mine.low[a][p], mine.high[a][p]
        elow, ehigh = theirs.low[b][e], theirs.high[b][e]
        gap = np.maximum(np.maximum(elow - high, low - ehigh), 0)
        least = np.einsum("ij,ij->i", gap, gap)
        reach = np.maximum(ehigh - low, high - elow)
        most = np.einsum("ij,ij->i", reach, reach)
        starts = np.flatnonzero(np.diff(p, prepend=-1))
        bound = np.repeat(np.minimum.reduceat(most, starts), np.diff(starts, append=len(p)))
        kept = least <= bound
        p, e = p[kept], e[kept]
        if b == theirs.depth:
            starts = np.flatnonzero(np.diff(p, prepend=-1))
            single = np.diff(starts, append=len(p)) == 1
            node, entry = p[starts[single]], index[e[starts[single]]]
            np.add.at(sums, entry, mine.sums[a][node])
            np.add.at(counts, entry, mine.counts[a][node])
            own = mine.order.reshape(len(mine.low[a]), -1)[node]
            nearest[own[own >= 0]] = np.broadcast_to(entry[:, None], own.shape)[own >= 0]
            open_ = np.repeat(~single, np.diff(starts, append=len(p)))
            p, e = p[open_], e[open_]
        if not len(p) or (a == mine.depth and b == theirs.depth):
            break
        # Both sides go one level down; the pairs of a point node stay together.
        down_p, down_e = a < mine.depth, b < theirs.depth
        starts = np.flatnonzero(np.diff(p, prepend=-1))
        sizes = np.diff(starts, append=len(p))
        below = _children(e, down_e)
        if down_p:
            # Each node's entries twice, once for each child.
            at = np.concatenate([np.arange(s, s + n) for s, n in zip(starts, sizes) for _ in (0, 1)])
            owner = np.repeat(_children(p[starts], True).ravel(), np.repeat(sizes, 2))
        else:
            at, owner = np.arange(len(p)), p
        p, e = np.repeat(owner, below.shape[1]), below[at].ravel()
        a, b = a + down_p, b + down_e
    if len(p):
        leaves = mine.order.reshape(len(mine.low[-1]), -1)
        starts = np.flatnonzero(np.diff(p, prepend=-1))
        cuts = [0]
        for s, n in zip(starts, np.diff(starts, append=len(p))):
            if s + n - cuts[-1] > SLICE and s > cuts[-1]:
                cuts.append(s)
        for s, t in zip(cuts, [*cuts[1:], len(p)]):
            first = starts[(starts >= s) & (starts < t)]
            entry, own = index[e[s:t]], leaves[p[s:t]]
            apart = points[own] - entries[entry][:, None]
            # One number orders by distance, then by index.
            key = np.einsum("ijk,ijk->ij", apart, apart) * len(entries) + entry[:, None]
            best = np.minimum.reduceat(key, first - s, axis=0) % len(entries)
            own = leaves[p[first]]
            who, best = own[own >= 0], best[own >= 0]
            nearest[who] = best
            np.add.at(sums, best, points[who])
            np.add.at(counts, best, 1)
    return nearest, sums, counts


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for start in range(0, len(batch), BLOCK):
            rows = batch.slice(start, BLOCK)
            lists = rows.column("v")
            yield rows, lists.flatten().to_numpy().reshape(len(rows), PARTS, -1)


def whole_parts(vectors: DataFrame) -> DataFrame:
    """vec_id, label and the integers ``v`` of the vectors that can be cut: no nulls, all finite, a length that four divides."""
    x = F.col("embedding").cast("array<double>")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    ready = vectors.filter((F.size("embedding") > 0) & (F.size("embedding") % PARTS == 0) & sound)
    return ready.select(F.col("vec_id").cast("long"), "label", F.transform(x, lambda c: F.floor(c * SCALE)).alias("v"))


def fit(rows: DataFrame, length: int, rounds: int = ROUNDS, most_entries: int = ENTRIES) -> np.ndarray:
    """Codebooks (part, entry, component) of vectors of one length, from ``rounds`` rounds over all of them."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(most_entries).select("v").collect()
    books = np.array([r["v"] for r in first], np.int64).reshape(len(first), PARTS, -1).transpose(1, 0, 2).copy()
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], books: np.ndarray = books) -> Iterator[pa.RecordBatch]:
            sums, counts = np.zeros_like(books), np.zeros(books.shape[:2], np.int64)
            for _, held in _blocks(batches):
                for k in range(PARTS):
                    _, own, many = assign(np.ascontiguousarray(held[:, k]), books[k])
                    sums[k] += own
                    counts[k] += many
            part, entry = np.nonzero(counts)
            width = books.shape[2]
            columns = [np.repeat(part, width), np.repeat(entry, width), np.tile(np.arange(width), len(part)), sums[part, entry].ravel(), np.repeat(counts[part, entry], width)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["part", "entry", "place", "total", "n"])

        told = rows.select("v").mapInArrow(run, "part long, entry long, place long, total long, n long").groupBy("part", "entry", "place")
        sums = told.agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect()
        books = books.copy()
        for r in sums:
            books[r["part"], r["entry"], r["place"]] = int(r["total"]) // r["n"]
    return books


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (two hex digits for each part) and error (squared distances summed over parts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, held in _blocks(batches):
            error, code = np.zeros(len(block), np.int64), np.empty((len(block), PARTS), np.uint8)
            for k in range(PARTS):
                points = np.ascontiguousarray(held[:, k])
                code[:, k], *_ = assign(points, books[k])
                apart = points - books[k][code[:, k]]
                error += np.einsum("ij,ij->i", apart, apart)
            codes = pa.array([row.tobytes().hex() for row in code], pa.string())
            yield pa.RecordBatch.from_arrays([block.column("vec_id"), block.column("label"), codes, pa.array(error)], names=["vec_id", "label", "code", "error"])

    return rows.mapInArrow(run, struct_of(rows.select("vec_id", "label"), ("code", "string"), ("error", "long")))


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components in order, as decimal numbers between commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, rounds: int = ROUNDS, most_entries: int = ENTRIES) -> DataFrame:
    """vec_id, label, code, error, label_error (errors summed over a label, nulls together) and codebooks_sha256.

    Left out are vectors that are null, empty, hold a null or non-finite component, or cannot be cut in four equal parts.
    Vectors of another length are a corpus of their own, with codebooks of their own. Of rows with one vec_id the lesser
    vector counts as smaller, null vec_ids as largest; every row comes out. Fewer rows than entries make smaller
    codebooks. Components so large that distances exceed 64 bits are an error. Empty table: no rows. Other columns
    are left out.
    """
    rows = materialize(whole_parts(vectors), "parts")
    told = rows.groupBy(F.size("v").alias("size")).agg(F.max(F.array_max(F.transform("v", lambda c: F.abs(c)))).alias("top")).collect()
    done = []
    for r in sorted(told):
        if r["size"] * 4 * r["top"] ** 2 * most_entries >= 2**63:
            raise ArithmeticError(f"components up to {r['top']} are too large for 64-bit distances over {r['size']} of them")
        own = rows.filter(F.size("v") == r["size"])
        books = fit(own, r["size"], rounds, most_entries)
        done.append(encode(own, books).withColumn("codebooks_sha256", F.lit(digest(books))))
    if not done:
        return rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    coded = done[0]
    for more in done[1:]:
        coded = coded.unionByName(more)
    coded = materialize(coded, "codes")
    by_label = measured_side(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"), "labels")
    both = coded.join(by_label, coded["label"].eqNullSafe(by_label["of"]))
    return both.select("vec_id", "label", "code", "error", "label_error", "codebooks_sha256")
