"""Trees grown on Spark, for models whose many fits share work (M5, M7).

Features are put in bins once and written. A node with many rows is split by histograms: every task adds up its rows per
feature and bin, Spark sums the histograms, and one small row per node tells its best split. A node with few enough rows
is finished in one go: its rows are gathered by a shuffle on (tree, node), and a task grows the whole subtree. So large tables
cost a few passes for the top levels, and small ones a single shuffle for any number of trees.

Every node keeps its own value and rows, inner ones too. A forest therefore holds all its smaller ones: fewer trees, less
depth, or larger nodes needed for a split are found by stopping earlier.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cityflux.operators import loops
from cityflux.plans.scratch import exists, materialize

BINS = 32
# Rows of a node that one task finishes; cells of a histogram held at a time.
LOCAL_ROWS, CELLS = 500_000, 1_000_000
# Deeper than any tree.
MAX_DEPTH = 62
# Boosted scores are written anew after so many rounds; in between they are added up from the latest trees.
KEPT_ROUNDS = 10


@dataclass(frozen=True)
class Growth:
    """When a tree stops: depth, least weight of a leaf, least rows of a node to be split; features tried per node (None: all)."""

    depth: int
    least: float = 1.0
    split: int = 2
    subset: int | None = None
    seed: int = 42


# --- bins -----------------------------------------------------------------------------------


def find_cuts(df: DataFrame, names: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Per feature the values at which it may be cut (a row goes left at or below one): midpoints of few values, else quantiles."""
    many = df.agg(*[F.approx_count_distinct(c).alias(c) for c in names]).first()
    few = [c for c in names if many[c] <= 2 * bins]
    shares = [k / bins for k in range(1, bins)]
    of = [F.array_sort(F.collect_set(F.col(c).cast("double"))).alias(c) if c in few else F.percentile_approx(F.col(c).cast("double"), shares, 10_000).alias(c) for c in names]
    told, out = df.agg(*of).first(), []
    for c in names:
        values = np.unique(np.array(told[c] if told[c] is not None else [], float))
        if c in few:
            if len(values) > bins:
                values = values[np.linspace(0, len(values) - 1, bins).astype(int)]
            values = (values[1:] + values[:-1]) / 2
        out.append(values)
    return out


def given(name: str) -> Column:
    """The column as a double; a missing value is an error."""
    c = F.col(name).cast("double")
    return F.when(c.isNull() | F.isnan(c), F.raise_error(F.lit(f"{name} has missing values"))).otherwise(c)


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).cast(pa.float64()).to_numpy(zero_copy_only=False)


def binned(df: DataFrame, names: list[str], cuts: list[np.ndarray], keep: list[str]) -> DataFrame:
    """The columns ``keep``, a number ``_row`` and the bins of all features (``_bins``, one byte each), written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            b = np.stack([np.searchsorted(own, _column(batch, c)) for c, own in zip(names, cuts)], 1).astype(np.uint8)
            packed = pa.Array.from_buffers(pa.binary(len(names)), len(batch), [None, pa.py_buffer(b.tobytes())]).cast(pa.binary())
            numbers = pa.array(row + np.arange(len(batch)))
            row += len(batch)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], numbers, packed], names=[*keep, "_row", "_bins"])

    kept = df.select(*keep)
    schema = T.StructType(list(kept.schema.fields)).add("_row", "long").add("_bins", "binary")
    both = df.select(*[F.col(c) for c in keep], *[F.col(c) for c in names if c not in keep])
    return materialize(both.mapInArrow(run, schema), "bins")


def _as_bytes(batch: pa.RecordBatch) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema) as stream:
        stream.write_batch(batch)
    return out.getvalue().to_pybytes()


def _from_bytes(parts: Iterable[bytes]) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in parts])


def _bins_of(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("_bins").to_pylist()), np.uint8).reshape(-1, width)


def _parts(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows of a written table of bins, and their bins: as they come, or out of blocks (``blocked``)."""
    for batch in batches:
        if "_block" in batch.schema.names:
            for block, bins in zip(batch.column("_block").to_pylist(), batch.column("_bins").to_pylist()):
                yield pa.ipc.open_stream(block).read_next_batch(), np.frombuffer(bins, np.uint8).reshape(-1, width)
        else:
            yield batch, _bins_of(batch, width)


def blocked(rows: DataFrame, width: int, keep: list[str], change: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch] | None = None) -> DataFrame:
    """The columns ``keep`` and the bins of batches of rows, or of blocks, packed into one row each, written; ``change`` makes new rows of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, b in _parts(batches, width):
            if len(batch):
                own = change(batch, b) if change else batch
                yield pa.RecordBatch.from_arrays([pa.array([_as_bytes(own.select(keep))]), pa.array([b.tobytes()])], names=["_block", "_bins"])

    return materialize(rows.mapInArrow(run, "_block binary, _bins binary"), "blocks")


def _mixed(*parts: np.ndarray | int) -> np.ndarray:
    """Hash of whole numbers, the same in every task."""
    h = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for part in parts:
            h = (h ^ np.asarray(part).astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            h = h ^ (h >> np.uint64(29))
    return h


# Chances that a row is drawn at most 0, 1, ... times into a sample of as many rows.
_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod([1, 1, 2, 3, 4, 5, 6, 7, 8, 9]))


def draws(rows: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row is in the bootstrap sample of a tree."""
    return np.searchsorted(_POISSON, _mixed(rows, tree, seed) / 2.0**64).astype(float)


# --- splits ---------------------------------------------------------------------------------


def _tried(nodes: np.ndarray, tree: int, width: int, plan: Growth) -> np.ndarray | None:
    """Which features each node may use: as many as the plan says, drawn by a hash."""
    if plan.subset is None or plan.subset >= width:
        return None
    order = _mixed(nodes[:, None], np.arange(width)[None], tree, plan.seed)
    out = np.zeros((len(nodes), width), bool)
    np.put_along_axis(out, np.argsort(order, 1)[:, : plan.subset], True, 1)
    return out


def _histogram(place: np.ndarray, m: int, b: np.ndarray, bins: int, w: np.ndarray, g: np.ndarray, classes: int = 0, tried: np.ndarray | None = None) -> np.ndarray:
    """Sums (node, feature, bin, 1 + outputs) of the weights and of g; ``b`` has a row per feature, g a column per output or class numbers."""
    width = len(b)
    out = np.empty((m, width, bins, 1 + (classes or g.shape[1])))
    for f in range(width):
        own = slice(None) if tried is None else np.flatnonzero(tried[place, f])
        cell = place[own] * bins + b[f][own]
        if classes:
            each = np.bincount(cell * classes + g[own], w[own], m * bins * classes).reshape(m, bins, classes)
            out[:, f, :, 0], out[:, f, :, 1:] = each.sum(-1), each
        else:
            for k, x in enumerate((w, *g.T)):
                out[:, f, :, k] = np.bincount(cell, x[own], m * bins).reshape(m, bins)
    return out


# Falls in error that differ less than this come from sums in another order.
_EVEN = 1 - 1e-9


def best_splits(hist: np.ndarray, plan: Growth, tried: np.ndarray | None, whole: np.ndarray) -> tuple[np.ndarray, ...]:
    """(feature, cut, gain) per node: the greatest fall in squared error, of equal ones the first; gain 0: none.

    For shares of classes as outputs the fall is that of the Gini impurity. ``whole``: sums of each node.
    """
    left = hist.cumsum(2)[:, :, :-1]
    lw, rw = left[..., 0], whole[:, None, None, 0] - left[..., 0]
    lg, rg = left[..., 1:], whole[:, None, None, 1:] - left[..., 1:]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (lg**2).sum(-1) / lw + (rg**2).sum(-1) / rw - ((whole[:, 1:] ** 2).sum(-1) / whole[:, 0])[:, None, None]
    fits = (lw >= max(plan.least, 1e-12)) & (rw >= max(plan.least, 1e-12))
    if tried is not None:
        fits &= tried[:, :, None]
    gain = np.where(fits, gain, 0.0).reshape(len(hist), -1)
    at = (gain >= (gain.max(1) * _EVEN)[:, None]).argmax(1)
    cuts = hist.shape[2] - 1
    return at // cuts, at % cuts, gain[np.arange(len(at)), at]


def sorted_splits(place: np.ndarray, m: int, b: np.ndarray, bins: int, w: np.ndarray, g: np.ndarray, classes: int, plan: Growth, tried: np.ndarray | None, whole: np.ndarray) -> tuple[np.ndarray, ...]:
    """As ``best_splits``, for nodes with fewer rows than a histogram has cells: rows are sorted by (node, bin). Rows come ordered by node."""
    feature, cut, best = np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros(m)
    columns = np.eye(classes)[g] * w[:, None] if classes else g
    columns = np.concatenate((w[:, None], columns), 1)
    const = (whole[:, 1:] ** 2).sum(-1) / whole[:, 0]
    least = max(plan.least, 1e-12)
    for f in range(len(b)):
        own = np.arange(len(place)) if tried is None else np.flatnonzero(tried[place, f])
        if not len(own):
            continue
        key = np.sort(((place * bins + b[f] if tried is None else place[own] * bins + b[f][own]) << 32) | own)
        cell, node = key >> 32, (key >> 32) // bins
        # Sums up to and with each row, less those of the nodes before.
        run = np.cumsum(columns[key & 0xFFFFFFFF], 0)
        starts = np.flatnonzero(np.diff(node, prepend=-1))
        before = np.zeros((m, run.shape[1]))
        before[node[starts[1:]]] = run[starts[1:] - 1]
        ends = np.flatnonzero((cell[1:] != cell[:-1]) & (node[1:] == node[:-1]))
        if not len(ends):
            continue
        at = node[ends]
        left = run[ends] - before[at]
        right = whole[at] - left
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = (left[:, 1:] ** 2).sum(-1) / left[:, 0] + (right[:, 1:] ** 2).sum(-1) / right[:, 0] - const[at]
        gain = np.where((left[:, 0] >= least) & (right[:, 0] >= least), gain, 0.0)
        most = np.zeros(m)
        first = np.flatnonzero(np.diff(at, prepend=-1))
        most[at[first]] = np.maximum.reduceat(gain, first)
        good = np.flatnonzero(gain >= most[at] * _EVEN)[::-1]
        place_of = np.zeros(m, np.int64)
        place_of[at[good]] = good
        better = np.flatnonzero(most * _EVEN > best)
        feature[better], cut[better], best[better] = f, cell[ends[place_of[better]]] % bins, gain[place_of[better]]
    return feature, cut, best


_NODE = ["tree", "node", "feature", "cut", "gain", "rows", "weight", "value"]
_NODES = "tree int, node long, feature int, cut int, gain double, rows long, weight double, value array<double>"
# A subtree as one row: its nodes level by level, one packed array per column; gains also summed by feature.
_PIECES = "tree int, root long, size long, feature binary, cut binary, rows binary, gain binary, value binary, gains array<double>"
_PIECE = [c.split()[0] for c in _PIECES.split(", ")]
_PACKED = {"feature": np.int16, "cut": np.uint8, "rows": np.int32, "gain": np.float32, "value": np.float64}


# Codes that the bins of some features make together, at most.
PACK = 512


def _packed(b: np.ndarray) -> list[tuple[np.ndarray, list[tuple[int, int]]]]:
    """Groups of features with one code per row, made of the bins of all of them: (codes, (feature, bins) of each)."""
    many, groups = b.max(0).astype(int) + 1, []
    for f in np.argsort(-many, kind="stable"):
        if many[f] > 1:
            fit = next((x for x in groups if np.prod([many[k] for k in x]) * many[f] <= PACK), None)
            fit.append(int(f)) if fit else groups.append([int(f)])
    out = []
    for own in groups:
        code = b[:, own[0]].astype(np.uint16)
        for f in own[1:]:
            code *= np.uint16(many[f])
            code += b[:, f]
        out.append((code, [(f, int(many[f])) for f in own]))
    return out


def _packed_histogram(place: np.ndarray, m: int, packs: list[tuple[np.ndarray, list[tuple[int, int]]]], width: int, bins: int, w: np.ndarray, g: np.ndarray, classes: int = 0) -> np.ndarray:
    """As ``_histogram``, of all features: rows are counted once per group of features and its cells are summed."""
    out = np.zeros((m, width, bins, 1 + (classes or g.shape[1])))
    base = (place * classes + g if classes else place) * PACK
    cell = np.empty_like(base)
    for code, own in packs:
        shape = [n for _, n in own]
        np.add(base, code, out=cell)
        for k, x in enumerate((w,) if classes else (w, *g.T)):
            each = np.bincount(cell, x, m * max(classes, 1) * PACK).reshape(m, -1, PACK)[..., : np.prod(shape)]
            each = each.reshape(m, -1, *shape)
            for j, (f, n) in enumerate(own):
                alone = each.sum(tuple(2 + i for i in range(len(own)) if i != j))
                if classes:
                    out[:, f, :n, 0], out[:, f, :n, 1:] = alone.sum(1), alone.transpose(0, 2, 1)
                else:
                    out[:, f, :n, k] = alone[:, 0]
    return out


def _chosen(tried: np.ndarray | None, place: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """The bins of the features that a row's node may use, a row per feature, and which features they are (None: all)."""
    if tried is None:
        return np.ascontiguousarray(b.T), None
    of = np.nonzero(tried)[1].reshape(len(tried), -1)
    return b.ravel().take((np.arange(len(b)) * b.shape[1])[:, None] + of.take(place, 0)).T, of


def subtree(b: np.ndarray, w: np.ndarray, g: np.ndarray, h: np.ndarray, bins: int, plan: Growth, tree: int, root: int, classes: int = 0) -> tuple:
    """All nodes below and with ``root`` (numbered as in a heap), level by level over the rows at hand, as a row of ``_PIECES``.

    ``b`` has a column per feature; values are sum(g) / sum(h). While a level has few nodes, its rows stay in place and are
    counted by groups of features; then they are ordered by node.
    """
    levels, ids, place, level, width = [], np.array([root]), np.zeros(len(w), np.int64), root.bit_length() - 1, b.shape[1]
    q = w if classes else (g**2).sum(1) / np.maximum(w, 1e-300)
    packs, above = _packed(b) if PACK * max(classes, 1) <= len(w) else None, None
    while len(ids):
        m = len(ids)
        if packs is not None and m * PACK * max(classes, 1) > len(w):
            packs, key = None, np.sort((place << 32) | np.arange(len(place)))
            place, order = key >> 32, key & 0xFFFFFFFF
            b, w, g, h, q = b.take(order, 0), w[order], g[order], h[order], q[order]
        rows, weight = np.bincount(place, minlength=m), np.bincount(place, w, m)
        if classes:
            sums = np.bincount(place * classes + g, w, m * classes).reshape(m, classes)
            squares = weight
        else:
            sums = np.stack([np.bincount(place, x, m) for x in g.T], -1)
            squares = np.bincount(place, q, m)
        value = sums / np.maximum(np.bincount(place, h, m), 1e-300)[:, None]
        error = squares - (sums**2).sum(-1) / weight
        can = (rows >= plan.split) & (error > 1e-10 * squares) & (level < plan.depth)
        feature, cut, gain = np.full(m, -1), np.zeros(m, np.int64), np.zeros(m)
        whole = np.concatenate((weight[:, None], sums), 1)
        if packs is not None and can.any():
            if above is None:
                hist = _packed_histogram(place, m, packs, width, bins, w, g, classes)
            else:
                # Of two children the rows of the smaller one are counted, or of one whose outputs the other's would drown;
                # the other has the rest of their parent's.
                drowned = [squares[k::2] < 1e-4 * squares[1 - k :: 2] for k in (0, 1)]
                less = np.arange(0, m, 2) + np.where(drowned[0] | drowned[1], drowned[1], rows[1::2] < rows[::2])
                own = np.flatnonzero(less[place >> 1] == place)
                part = _packed_histogram(place[own] >> 1, m // 2, [(code[own], of) for code, of in packs], width, bins, w[own], g[own], classes)
                hist = np.empty((m, *part.shape[1:]))
                hist[less], hist[less ^ 1] = part, above - part
            feature, cut, gain = best_splits(hist, plan, _tried(ids, tree, width, plan), whole)
        first = np.concatenate(([0], np.cumsum(rows)))
        for large in (True, False) if packs is None else ():
            open_ = np.flatnonzero(can & ((rows >= 2 * bins) == large))
            if not len(open_):
                continue
            # Histograms of so many nodes at a time; sorting takes as many rows.
            step = max(1, CELLS // (min(plan.subset or width, width) * bins * whole.shape[1])) if large else len(open_)
            for s in range(0, len(open_), step):
                own = open_[s : s + step]
                inside = np.repeat(np.arange(len(own)), rows[own])
                at = np.arange(len(inside)) + np.repeat(first[own] - np.concatenate(([0], np.cumsum(rows[own])[:-1])), rows[own])
                chosen, of = _chosen(_tried(ids[own], tree, width, plan), inside, b.take(at, 0))
                if large:
                    hist = _histogram(inside, len(own), chosen, bins, w[at], g[at], classes)
                    found = best_splits(hist, plan, None, whole[own])
                else:
                    found = sorted_splits(inside, len(own), chosen, bins, w[at], g[at], classes, plan, None, whole[own])
                feature[own], cut[own], gain[own] = found
                if of is not None:
                    feature[own] = of[np.arange(len(own)), found[0]]
        split = can & (gain > 1e-10 * error)
        feature[~split], cut[~split], gain[~split] = -1, 0, 0
        above = hist[split] if packs is not None and split.any() else None
        levels.append((feature, cut, rows, gain, value))
        goes = np.flatnonzero(split[place])
        if len(goes) < len(place):
            place, b, w, g, h, q = place[goes], b.take(goes, 0), w[goes], g[goes], h[goes], q[goes]
            packs = packs and [(code[goes], own) for code, own in packs]
        right = b.ravel().take(np.arange(len(b)) * width + feature[place]) > cut[place]
        ids = (2 * ids[split][:, None] + np.arange(2)).ravel()
        place, level = 2 * (np.cumsum(split) - 1)[place] + right, level + 1
        if packs is None:
            # Rows stay ordered by node.
            key = np.sort((place << 32) | np.arange(len(place)))
            place, order = key >> 32, key & 0xFFFFFFFF
            b, w, g, h, q = b.take(order, 0), w[order], g[order], h[order], q[order]
    told = dict(zip(_PACKED, (np.concatenate(x) for x in zip(*levels))))
    split = told["feature"] >= 0
    gains = np.bincount(told["feature"][split], told["gain"][split], width)
    return (tree, root, len(split), *[told[k].astype(kind).tobytes() for k, kind in _PACKED.items()], gains.tolist())


# --- growth on Spark ------------------------------------------------------------------------

# Of a batch and a tree: weights, outputs (row by output, times the weight; or the class numbers) and divisors; rows of weight 0 are not in the tree's sample.
Targets = Callable[[pa.RecordBatch, np.ndarray, int], tuple[np.ndarray, np.ndarray, np.ndarray]]


# Trees that one task finishes together when the table is small; (tree, node) pairs counted in one pass.
TOGETHER, PAIRS = 32, 4_000


def _few(total: int, most: int) -> int:
    """How many of a number of things one of at most ``most`` tasks takes."""
    return -(-total // most)


def grow(rows: DataFrame, width: int, bins: int, targets: Targets, plan: Growth, trees: list[int], count: int, local_rows: int = LOCAL_ROWS, classes: int = 0, late: list[str] | None = None, divisors: Callable[[np.ndarray], np.ndarray] | None = None) -> tuple[pd.DataFrame, DataFrame]:
    """All trees over a written table of bins: the nodes with many rows (``_NODE`` columns), and the subtrees below them (``_PIECES``, not yet computed).

    ``count`` is the number of rows of the table. Trees are the same for every ``local_rows`` but for sums in another order.
    With ``late``, the columns that targets come from, tasks that finish trees of a small table find the targets themselves.
    With ``divisors`` all weights are 1 and divisors follow from the outputs: only these are sent.
    """
    spark, top, fan = rows.sparkSession, pd.DataFrame(columns=_NODE), int(np.ceil(np.sqrt(count / local_rows)))
    whole = count <= local_rows
    big = [] if whole else [(t, 1) for t in trees]
    small = {}
    while big:
        above, told = _stubbed(top) if len(top) else None, []
        for s in range(0, len(big), PAIRS):
            told.append(_counted(rows, width, bins, targets, plan, big[s : s + PAIRS], above, fan, classes))
        told = pd.concat(told, ignore_index=True)
        top, big = pd.concat([top, told], ignore_index=True) if len(top) else told, []
        for r in told[told["feature"] >= 0].itertuples():
            # A child may hold all its parent's rows but one: half of them, rounded up, is the usual case.
            for child in (2 * r.node, 2 * r.node + 1):
                if r.rows > 2 * local_rows:
                    big.append((r.tree, child))
                else:
                    small.setdefault(r.tree, []).append(child)
    if whole and late is not None:
        return top, _grown_together(rows, width, bins, targets, plan, trees, classes, late)
    above = _stubbed(top) if len(top) else None
    small = {t: [1] for t in trees} if whole else small
    number = np.int32 if classes else np.float64

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, block = ["tree", "node", "block", "w", "h", "g", "b"], (TaskContext.get().partitionId() << 33) - 1
        for batch, b in _parts(batches, width):
            block += 1
            for t, open_ in small.items():
                w, g, h = targets(batch, b, t)
                if whole and divisors is not None:
                    packed = [b"", b"", g.astype(number).tobytes(), b.tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([1]), pa.array([block]), *[pa.array([x]) for x in packed]], names=names)
                    continue
                at = np.ones(len(b), np.int64) if above is None else above.node[above.reach(above.at(t), b, plan.depth)]
                own = np.flatnonzero((w > 0) & np.isin(at, open_))
                own = own[np.argsort(at[own], kind="stable")]
                ends = np.flatnonzero(np.diff(at[own], append=-1)) + 1
                for part in np.split(own, ends[:-1]) if len(own) else ():
                    packed = [b"" if divisors else x[part].tobytes() for x in (w, h)] + [g[part].astype(number).tobytes(), b[part].tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([at[part[0]]]), pa.array([block]), *[pa.array([x]) for x in packed]], names=names)

    def finish(frame: pd.DataFrame) -> pd.DataFrame:
        # The same order of sums, whatever order the blocks came in.
        frame = frame.sort_values("block")
        w, h = (np.frombuffer(b"".join(frame[c])) for c in "wh")
        g = np.frombuffer(b"".join(frame["g"]), number)
        if divisors is not None:
            w, h = np.ones(len(g)), divisors(g)
        b = np.frombuffer(b"".join(frame["b"]), np.uint8).reshape(-1, width)
        own = subtree(b, w, g if classes else g.reshape(len(w), -1), h, bins, plan, int(frame["tree"].iloc[0]), int(frame["node"].iloc[0]), classes)
        return pd.DataFrame([own], columns=_PIECE)

    def finish_own(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [x for x in frames if len(x)]
        if held:
            for _, frame in pd.concat(held).groupby("tree"):
                yield finish(frame)

    # What ends among the large nodes is a subtree of one node.
    ended = top[(top["feature"] < 0)].itertuples() if len(top) else ()
    leaves = [(int(r.tree), int(r.node), 1, *[np.array(x).astype(kind).tobytes() for x, kind in zip((-1, 0, r.rows, 0.0, r.value), _PACKED.values())], [0.0] * width) for r in ended]
    ends = spark.createDataFrame(leaves, _PIECES)
    sent = rows.mapInArrow(gather, "tree int, node long, block long, w binary, h binary, g binary, b binary")
    if whole:
        # Every tree has a task of its own.
        pieces = sent.repartitionById(len(trees), F.col("tree") - min(trees)).mapInPandas(finish_own, _PIECES)
    else:
        pieces = sent.groupBy("tree", "node").applyInPandas(finish, _PIECES)
    return top, pieces.unionByName(ends) if leaves else pieces


def _counted(rows: DataFrame, width: int, bins: int, targets: Targets, plan: Growth, big: list[tuple[int, int]], above: Forest | None, fan: int, classes: int) -> pd.DataFrame:
    """The best splits of large nodes (tree, node) from histograms that tasks add up and Spark sums."""
    by_tree: dict[int, list[int]] = {}
    for t, node in big:
        by_tree.setdefault(t, []).append(node)

    def count_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch, b in _parts(batches, width):
            for t, open_ in by_tree.items():
                w, g, h = targets(batch, b, t)
                at = np.ones(len(b), np.int64) if above is None else above.node[above.reach(above.at(t), b, plan.depth)]
                for node in open_:
                    own = np.flatnonzero((at == node) & (w > 0))
                    hist = _histogram(np.zeros(len(own), np.int64), 1, b[own].T, bins, w[own], g[own], classes).ravel()
                    squares = w[own].sum() if classes else ((g[own] ** 2).sum(1) / w[own]).sum()
                    held[t, node] = held.get((t, node), 0) + np.concatenate((hist, [len(own), h[own].sum(), squares]))
        branch = TaskContext.get().partitionId() % fan
        keys = [(branch, t, node, v.tobytes()) for (t, node), v in held.items()]
        if keys:
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*keys), kinds)], names=["branch", "tree", "node", "sums"])

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x) for x in frame["sums"])
        return pd.DataFrame({"tree": frame["tree"][:1], "node": frame["node"][:1], "sums": [total.tobytes()]})

    def decide(frame: pd.DataFrame) -> pd.DataFrame:
        tree, node = int(frame["tree"].iloc[0]), int(frame["node"].iloc[0])
        level = node.bit_length() - 1
        total = sum(np.frombuffer(x) for x in frame["sums"])
        hist, (n, h, squares) = total[:-3].reshape(1, width, bins, -1), total[-3:]
        whole = hist[0, 0].sum(0)
        error = squares - (whole[1:] ** 2).sum() / max(whole[0], 1e-300)
        feature, cut, gain = (x[0] for x in best_splits(hist, plan, _tried(np.array([node]), tree, width, plan), whole[None]))
        split = n >= plan.split and error > 1e-10 * squares and level < plan.depth and gain > 1e-10 * error
        value = (whole[1:] / max(h, 1e-300)).tolist()
        row = (tree, node, int(feature), int(cut), float(gain)) if split else (tree, node, -1, 0, 0.0)
        return pd.DataFrame([(*row, int(n), float(whole[0]), value)], columns=_NODE)

    first = rows.mapInArrow(count_up, "branch int, tree int, node long, sums binary").groupBy("branch", "tree", "node").applyInPandas(add, "tree int, node long, sums binary")
    return first.groupBy("tree", "node").applyInPandas(decide, _NODES).toPandas()


def _grown_together(rows: DataFrame, width: int, bins: int, targets: Targets, plan: Growth, trees: list[int], classes: int, late: list[str]) -> DataFrame:
    """Trees of a table that one task may hold: its rows go once to each of some tasks, which grow a few trees each."""
    few = _few(len(trees), TOGETHER)
    groups = _few(len(trees), few)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(groups, dtype=np.int32)), pa.array([_as_bytes(batch)] * groups)], names=["part", "rows"])

    def finish(frame: pd.DataFrame) -> pd.DataFrame:
        part = int(frame["part"].iloc[0])
        batch = _from_bytes(frame["rows"]).combine_chunks().to_batches()[0]
        # The same order of rows, and so of sums, whatever order the batches came in.
        batch = batch.take(pa.array(np.argsort(batch.column("_row").to_numpy())))
        b, out = _bins_of(batch, width), []
        for t in trees[part * few : (part + 1) * few]:
            w, g, h = targets(batch, b, t)
            drawn = np.flatnonzero(w > 0)
            if len(drawn):
                out.append(subtree(b.take(drawn, 0), w[drawn], g[drawn], h[drawn], bins, plan, t, 1, classes))
        return pd.DataFrame(out, columns=_PIECE)

    return rows.select(*late, "_row", "_bins").mapInArrow(deal, "part int, rows binary").repartition(3 * groups, "part").groupBy("part").applyInPandas(finish, _PIECES)


# Shares of an executor's heap: rows that its tasks share, what the trees growing there hold, and rows of boosted trees.
SHARED, GROWING, BOOSTED = 0.15, 0.35, 0.4
# Rows that are worth a task of boosted trees, tasks (each sends its histograms), rows that one holds at most; the depth to which nodes are numbered in two bytes.
BOOSTED_LEAST, BOOSTED_TASKS, BOOSTED_ROWS, BOOSTED_DEPTH = 50_000, 16, 1_000_000, 14


def _in_loops(rows: DataFrame, width: int, plan: Growth, trees: int, label: str, count: int, bootstrap: bool, classes: int) -> DataFrame | None:
    """The trees as pieces, grown on the JVM: rows are read once by each executor, and each task grows a few trees. None where the heap is too small."""
    spark = rows.sparkSession
    words, heap = (width + 2 + 7) // 8 + (not classes), loops.heap(spark)
    drawn = count * (0.64 if bootstrap else 1)
    if not trees or max(width, classes) > 255 or drawn * words >= 2**31 or drawn * words * 8 + count > GROWING * heap or count * (width + 16) > SHARED * heap:
        return None
    subset = plan.subset or width
    told = loops.new(spark, "Plan").set(width, classes, plan.depth, float(plan.least), plan.split, subset, plan.seed, bootstrap, bytearray(_POISSON.tobytes()))
    each, token = _few(trees, TOGETHER), uuid.uuid4().hex
    read = rows.select(F.col(label).cast("double").alias("y"), F.col("_row").alias("row"), F.col("_bins").alias("bins"))
    grown = [loops.new(spark, "Grow").set(token, k, min(trees, k + each), int(GROWING * heap), told) for k in range(0, trees, each)]
    return loops.tasks(read, grown, _PIECES)


_BOOSTED = np.dtype([("tree", "<i4"), ("node", "<i8"), ("feature", "<i4"), ("cut", "<i4"), ("gain", "<f8"), ("rows", "<i8"), ("value", "<f8")])


def _boosted_in_loops(rows: DataFrame, width: int, plan: Growth, rounds: int, rate: float, label: str, classes: int, base: list[float], count: int) -> Forest | None:
    """Boosted trees by jobs over rows that stay in the executors' memory: a job per level adds up histograms. None where memory is too small."""
    spark = rows.sparkSession
    need = count * (width + 8 + 18 * len(base))
    if not rounds or not count or width > 255 or plan.subset or plan.depth > BOOSTED_DEPTH or need > BOOSTED * loops.heap(spark) * loops.executors(spark):
        return None
    read = rows.select(F.col(label).cast("double").alias("y"), F.col("_bins").alias("bins"))
    parts = min(_few(count, BOOSTED_LEAST), max(BOOSTED_TASKS, _few(count, BOOSTED_ROWS)))
    settings = (width, classes, bytearray(np.array(base, float).tobytes()), rounds, float(rate), plan.depth, float(plan.least), plan.split)
    told = pd.DataFrame(np.frombuffer(loops.boosted(read, parts, *settings), _BOOSTED))
    return Forest.of(told.assign(value=told["value"].map(lambda v: [v])))


# --- models ---------------------------------------------------------------------------------


@dataclass
class Forest:
    """Trees as flat arrays, in order of (tree, node): ``left`` is the place of a node's left child, the right one follows it."""

    start: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    rows: np.ndarray
    gain: np.ndarray
    value: np.ndarray
    tree: np.ndarray
    node: np.ndarray

    @staticmethod
    def of(nodes: pd.DataFrame) -> Forest:
        nodes = nodes.sort_values(["tree", "node"], kind="stable")
        tree, node = nodes["tree"].to_numpy(np.int64), nodes["node"].to_numpy(np.int64)
        key = tree * 2**40 + node
        left = np.searchsorted(key, tree * 2**40 + 2 * node)
        feature = nodes["feature"].to_numpy(np.int64)
        value = np.stack(nodes["value"].to_list()) if len(nodes) else np.zeros((0, 1))
        start = np.flatnonzero(np.diff(tree, prepend=-1))
        return Forest(start, feature, nodes["cut"].to_numpy(np.int64), np.where(feature < 0, -1, left), nodes["rows"].to_numpy(np.int64), nodes["gain"].to_numpy(float), value, tree, node)

    def at(self, tree: int) -> int:
        """The place of a tree in the order of trees."""
        return int(np.searchsorted(self.tree[self.start], tree))

    def nodes(self) -> pd.DataFrame:
        columns = (self.tree, self.node, self.feature, self.cut, self.gain, self.rows, self.rows.astype(float), self.value.tolist())
        return pd.DataFrame(dict(zip(_NODE, columns)))

    def depth(self) -> np.ndarray:
        return np.floor(np.log2(self.node)).astype(int)

    def cut_back(self, trees: int, depth: int, split: int) -> Forest:
        """Its first trees, with nodes of fewer rows or at the given depth as leaves."""
        stop = (self.depth() >= depth) | (self.rows < split)
        frame = self.nodes()
        frame.loc[stop, ["feature", "cut", "gain"]] = [-1, 0, 0.0]
        alive, first = np.zeros(len(frame), bool), np.unique(self.tree)[:trees]
        alive[self.start] = np.isin(self.tree[self.start], first)
        for k in np.argsort(self.depth(), kind="stable"):
            if alive[k] and frame["feature"].iat[k] >= 0:
                alive[self.left[k] : self.left[k] + 2] = True
        return Forest.of(frame[alive])

    def reach(self, tree: int, b: np.ndarray, depth: int, split: int = 0, at: np.ndarray | None = None, done: int = 0) -> np.ndarray:
        """Places of the nodes where rows end after ``depth`` steps, ``done`` of which led to ``at``."""
        low, high = self.start[tree], self.start[tree + 1] if tree + 1 < len(self.start) else len(self.tree)
        at = np.zeros(len(b), np.int64) if at is None else at - low
        # Where a row ends it is led to the same node again.
        end = (self.feature[low:high] < 0) | (self.rows[low:high] < split)
        feature, cut = np.where(end, 0, self.feature[low:high]), np.where(end, 255, self.cut[low:high])
        left = np.where(end, np.arange(high - low), self.left[low:high] - low)
        flat, row = b.ravel(), np.arange(len(b)) * b.shape[1]
        for _ in range(done, depth):
            after = left.take(at) + (flat.take(row + feature.take(at)) > cut.take(at))
            if np.array_equal(after, at):
                break
            at = after
        return at + low

    def totals(self, b: np.ndarray, depth: int) -> np.ndarray:
        """Sums over all trees of the values rows get."""
        out = np.zeros((len(b), self.value.shape[1]))
        for t in range(len(self.start)):
            out += self.value[self.reach(t, b, depth)]
        return out


@dataclass
class Piece:
    """A subtree, its nodes level by level: the children of its k-th split are nodes 2k + 1 and 2k + 2."""

    tree: int
    root: int
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    rows: np.ndarray
    gain: np.ndarray
    value: np.ndarray

    @staticmethod
    def of(row) -> Piece:
        told = {k: np.frombuffer(getattr(row, k, b""), kind) for k, kind in _PACKED.items()}
        split = told["feature"] >= 0
        value = told.pop("value").reshape(len(split), -1)
        return Piece(int(row.tree), int(row.root), **told, left=np.where(split, 2 * np.cumsum(split) - 1, -1), value=value)

    def nodes(self) -> pd.DataFrame:
        ids, at = np.empty(len(self.feature), np.int64), np.array([0])
        ids[0] = self.root
        while len(at):
            at = at[self.feature[at] >= 0]
            ids[self.left[at]], ids[self.left[at] + 1] = 2 * ids[at], 2 * ids[at] + 1
            at = np.concatenate((self.left[at], self.left[at] + 1))
        columns = (self.tree, ids, self.feature, self.cut, self.gain, self.rows, self.rows.astype(float), self.value.tolist())
        return pd.DataFrame(dict(zip(_NODE, columns)))

    def add_below(self, out: np.ndarray, above: Forest | None, b: np.ndarray, depths: list[int], splits: list[int]) -> None:
        """Add to ``out`` the values of rows that end in the subtree, or at a large node above of which it is the first leaf."""
        if above is None:
            return self.add(out, b, np.arange(len(b)), depths, splits)
        tree, down = above.at(self.tree), self.root.bit_length() - 1
        for d, depth in enumerate(depths):
            for s, least in enumerate(splits):
                at = above.reach(tree, b, depth, least)
                first = at.copy()
                while (inner := above.feature[first] >= 0).any():
                    first = np.where(inner, above.left[first], first)
                mine, leaf = above.node[first] == self.root, first == at
                out[d, s, mine & ~leaf] += above.value[at[mine & ~leaf]]
                self.add(out[d : d + 1, s : s + 1], b, np.flatnonzero(mine & leaf), [depth - down], [least])

    def add(self, out: np.ndarray, b: np.ndarray, own: np.ndarray, depths: list[int], splits: list[int]) -> None:
        """Add to ``out`` (depth, split, row, output) the values of the rows ``own``; depths count from the root of the subtree."""
        now, act = np.zeros(len(own), np.int64), np.arange(len(own))
        ends = np.zeros((len(splits), len(own)), np.int64)
        for step in range(max(depths) + 1):
            for d in np.flatnonzero(np.array(depths) == step):
                for s in range(len(splits)):
                    out[d, s, own] += self.value[ends[s]]
            act = act[self.feature[now[act]] >= 0]
            if not len(act):
                for d in np.flatnonzero(np.array(depths) > step):
                    for s in range(len(splits)):
                        out[d, s, own] += self.value[ends[s]]
                return
            c = now[act]
            now[act] = self.left[c] + (b[own[act], self.feature[c]] > self.cut[c])
            for s, least in enumerate(splits):
                # Nodes below one with too few rows have fewer still.
                goes = act[self.rows[c] >= least]
                ends[s, goes] = now[goes]


@dataclass
class Grove:
    """A forest as a written table of subtrees, which is never in one place; ``top`` has the large nodes above them."""

    pieces: DataFrame
    top: pd.DataFrame
    trees: int

    def collect(self) -> Forest:
        """The forest in one place, for small ones."""
        parts = [Piece.of(r).nodes() for r in self.pieces.toPandas().itertuples()]
        inner = self.top[self.top["feature"] >= 0]
        return Forest.of(pd.concat([*([inner] if len(inner) else []), *parts], ignore_index=True) if parts else pd.DataFrame(columns=_NODE))

    def importances(self, width: int) -> np.ndarray:
        """Mean over trees of each feature's share of the fall in error."""
        told = self.pieces.groupBy("tree").agg(*[F.sum(F.col("gains")[k]).alias(f"g{k}") for k in range(width)]).toPandas().set_index("tree").sort_index()
        gain = told.to_numpy(float).reshape(-1, width)
        for r in self.top[self.top["feature"] >= 0].itertuples():
            gain[told.index.get_loc(r.tree), r.feature] += r.gain
        total = gain.sum(1, keepdims=True)
        share = np.divide(gain, total, out=np.zeros_like(gain), where=total > 0).sum(0)
        return share / share.sum() if share.sum() else share

    def sums(self, chunks: DataFrame, width: int, rows: int, sizes: list[int], depths: list[int], splits: list[int], outputs: int) -> DataFrame:
        """(chunk, part, sums): of the trees of one part the values of a chunk's rows, by (size of forest, depth, least rows to split, row, output).

        Parts of the forest meet blocks of rows in one task each; the values of all parts add up to those of the forest.
        """
        nodes = self.pieces.agg(F.sum("size")).first()[0] or 0
        parts = min(self.trees, max(PARTS, _few(nodes, PART_NODES)))
        # Trees too large for a part are dealt by their subtrees.
        within = _few(nodes, PART_NODES * parts) or 1
        blocks = _few(rows, BLOCK_ROWS) or 1
        part = (F.col("tree") * parts / self.trees).cast("int") * within + F.pmod(F.hash("root"), F.lit(within))
        deal = 2 * parts * within * blocks
        held = self.pieces.drop("gain", "gains").withColumn("part", part.cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        sent = chunks.select("chunk", "bins", F.pmod(F.hash("chunk"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts * within - 1))).alias("part"))
        if not len(self.top) and width <= 255 and outputs * max(len(sizes), 1) * len(depths) * len(splits) <= WALKED:
            # Subtrees come before the chunks that meet them, in the order of trees.
            kinds = "part int, block int, kind int, id long, root long, feature binary, cut binary, rows binary, value binary, bins binary"
            names = [c.split()[0] for c in kinds.split(", ")]
            given = {"kind": F.lit(0), "id": F.col("tree").cast("long"), "bins": F.lit(None).cast("binary")}
            subtrees = held.withColumns(given).select(*names)
            empty = {c: F.lit(None).cast("binary") for c in ("feature", "cut", "rows", "value")}
            met = sent.withColumns({"kind": F.lit(1), "id": F.col("chunk"), "root": F.lit(0).cast("long"), **empty}).select(*names)
            order = ["part", "block", "kind", "id", "root"]
            dealt = subtrees.unionAll(met).repartition(deal, "part", "block").sortWithinPartitions(*order)
            walk = loops.new(dealt.sparkSession, "Walk").set(width, outputs, *[bytearray(np.array(x, np.int32).tobytes()) for x in (sizes, depths, splits)])
            return loops.mapped(dealt, walk, "chunk long, part int, bands array<int>, sums binary")
        above = _stubbed(self.top) if len(self.top) else None

        def add(rows_: pd.DataFrame, trees_: pd.DataFrame) -> pd.DataFrame:
            if not len(rows_) or not len(trees_):
                return pd.DataFrame({"chunk": [], "part": [], "bands": [], "sums": []})
            pieces = [Piece.of(r) for r in trees_.sort_values(["tree", "root"]).itertuples()]
            band = np.searchsorted(sizes, [p.tree for p in pieces], "right")
            bands, out = sorted({int(x) for x in band if x < len(sizes)}), []
            for r in rows_.itertuples():
                b = np.frombuffer(r.bins, np.uint8).reshape(-1, width)
                total = np.zeros((len(bands), len(depths), len(splits), len(b), pieces[0].value.shape[1]))
                for p, k in zip(pieces, band):
                    if k < len(sizes):
                        p.add_below(total[bands.index(k)], above, b, depths, splits)
                out.append((r.chunk, int(rows_["part"].iloc[0]), bands, total.tobytes()))
            return pd.DataFrame(out, columns=["chunk", "part", "bands", "sums"])

        groups = [x.repartition(deal, "part", "block").groupBy("part", "block") for x in (sent, held)]
        return groups[0].cogroup(groups[1]).applyInPandas(add, "chunk long, part int, bands array<int>, sums binary")


# Parts of a forest, so many at least; nodes of a part; rows of a block.
PARTS, PART_NODES, BLOCK_ROWS = 24, 2_000_000, 2_000_000
# Sums of a row that a part gives at most, for chunks to go through it in ``loops``.
WALKED = 10_000


def _stubbed(top: pd.DataFrame) -> Forest:
    """Large nodes with their children that are not among them as leaves."""
    split = top[top["feature"] >= 0]
    children = pd.concat([split.assign(node=2 * split["node"] + k, feature=-1, cut=0, gain=0.0, rows=0) for k in (0, 1)])
    return Forest.of(pd.concat([top, children], ignore_index=True).drop_duplicates(["tree", "node"]))


@dataclass
class TreeModel:
    """Trees with what is needed to predict from raw features; ``kind`` is mean, sum, shares or softmax.

    Trees of softmax hold one output each: tree k of a round belongs to class k.
    """

    names: list[str]
    cuts: list[np.ndarray]
    forest: Forest | Grove
    kind: str
    base: list[float]
    settings: dict

    @property
    def stages(self) -> list[TreeModel]:
        return [self]

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802
        if isinstance(self.forest, Grove):
            return Vectors.dense(self.forest.importances(len(self.names)))
        gain = np.zeros(len(self.names))
        split = self.forest.feature >= 0
        np.add.at(gain, self.forest.feature[split], self.forest.gain[split])
        return Vectors.dense(gain / gain.sum() if gain.sum() else gain)

    def outputs(self, b: np.ndarray) -> np.ndarray:
        """Per row the predicted value, or the probability of every class."""
        forest, rate = self.forest, self.settings.get("stepSize", 1.0)
        depth = int(forest.depth().max()) if len(forest.node) else 0
        if self.kind in ("mean", "shares"):
            return forest.totals(b, depth) / max(1, len(forest.start))
        out = np.tile(np.array(self.base, float), (len(b), 1))
        for t in range(len(forest.start)):
            out[:, int(forest.tree[forest.start[t]]) % len(self.base)] += rate * forest.value[forest.reach(t, b, depth), 0]
        return softmax(out) if self.kind == "softmax" else out

    def transform(self, df: DataFrame) -> DataFrame:
        """The frame with ``prediction``, and ``probability`` (array by class) for classes; features alone go to Python."""
        if isinstance(self.forest, Grove):
            return self._met(df)
        if self.kind in ("sum", "softmax") and 0 < len(self.names) <= 255 and len(self.forest.node):
            return self._scored(df)
        sent = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("array<double>")
        def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            model = sent.value
            for frame in batches:
                b = np.stack([np.searchsorted(own, frame[c].to_numpy(float)) for c, own in zip(model.names, model.cuts)], 1)
                yield pd.Series(list(model.outputs(b)))

        out = df.withColumn("_told", told(F.struct(*[F.col(c).cast("double").alias(c) for c in self.names])))
        if self.kind in ("mean", "sum"):
            return out.withColumn("prediction", F.col("_told")[0]).drop("_told")
        best = F.array_position("_told", F.array_max("_told")) - 1
        return out.withColumn("prediction", best.cast("double")).withColumnRenamed("_told", "probability")

    def _packing(self, own: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """Batches as chunks: the bins of their rows, out of columns ``_f0``, ``_f1``, ..., and the first ``own`` columns."""
        cuts = self.cuts

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            chunk = TaskContext.get().partitionId() << 33
            for batch in batches:
                if len(batch):
                    b = np.stack([np.searchsorted(c, _column(batch, f"_f{k}")) for k, c in enumerate(cuts)], 1).astype(np.uint8)
                    kept = _as_bytes(batch.select(range(own)))
                    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (chunk, len(batch), b.tobytes(), kept)], names=["chunk", "n", "bins", "kept"])
                    chunk += 1

        return pack

    def _scored(self, df: DataFrame) -> DataFrame:
        """``transform`` with boosted trees: chunks of rows go through all of them in ``loops``."""
        forest, outputs, softened = self.forest, len(self.base), self.kind == "softmax"
        both = df.select("*", *[F.col(c).cast("double").alias(f"_f{k}") for k, c in enumerate(self.names)])
        chunks = both.mapInArrow(self._packing(len(df.columns)), "chunk long, n long, bins binary, kept binary").select("bins", "kept")
        numbers = (forest.start, forest.tree[forest.start] % outputs, forest.left, forest.feature, forest.cut)
        told = [bytearray(np.asarray(x).astype(np.int32).tobytes()) for x in numbers]
        ends = [bytearray(np.array(x, float).tobytes()) for x in (self.base, forest.value[:, 0])]
        score = loops.new(df.sparkSession, "Score").set(len(self.names), float(self.settings.get("stepSize", 1.0)), ends[0], *told, ends[1])

        def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for kept, sums in zip(batch.column("kept").to_pylist(), batch.column("sums").to_pylist()):
                    out, now = pa.ipc.open_stream(kept).read_next_batch(), np.frombuffer(sums).reshape(-1, outputs)
                    if softened:
                        now = softmax(now)
                        shares = pa.FixedSizeListArray.from_arrays(pa.array(now.ravel()), outputs).cast(pa.list_(pa.float64()))
                        yield out.append_column("probability", shares).append_column("prediction", pa.array(now.argmax(1).astype(float)))
                    else:
                        yield out.append_column("prediction", pa.array(now[:, 0]))

        schema = T.StructType(list(df.schema.fields))
        schema = (schema.add("probability", T.ArrayType(T.DoubleType())) if softened else schema).add("prediction", "double")
        return loops.mapped(chunks, score, "kept binary, sums binary").mapInArrow(tell, schema)

    def _met(self, df: DataFrame) -> DataFrame:
        """``transform`` with a forest that is a table: rows are packed into chunks, which meet its parts, written."""
        names, width = self.names, len(self.names)
        number = given if self.settings.get("complete") else lambda c: F.col(c).cast("double")
        both = df.select("*", *[number(c).alias(f"_f{k}") for k, c in enumerate(names)])
        chunks = materialize(both.mapInArrow(self._packing(len(df.columns)), "chunk long, n long, bins binary, kept binary"), "chunks")
        rows = chunks.agg(F.sum("n")).first()[0] or 0
        sums = self.forest.sums(chunks, width, rows, [self.forest.trees], [MAX_DEPTH], [0], len(self.base) or 1)
        outputs, trees, mean = len(self.base) or 1, max(1, self.forest.trees), self.kind == "mean"

        def told(left: pa.Table, right: pa.Table) -> pa.Table:
            kept = _from_bytes(left.column("kept").to_pylist())
            parts = right.sort_by("part").column("sums").to_pylist()
            total = sum((np.frombuffer(x).reshape(len(kept), outputs) for x in parts), np.zeros((len(kept), outputs))) / trees
            if mean:
                return kept.append_column("prediction", pa.array(total[:, 0]))
            shares = pa.FixedSizeListArray.from_arrays(pa.array(total.ravel()), outputs).cast(pa.list_(pa.float64()))
            return kept.append_column("probability", shares).append_column("prediction", pa.array(total.argmax(1).astype(float)))

        schema = T.StructType(list(df.schema.fields))
        schema = schema.add("prediction", "double") if mean else schema.add("probability", T.ArrayType(T.DoubleType())).add("prediction", "double")
        return materialize(chunks.groupBy("chunk").cogroup(sums.groupBy("chunk")).applyInArrow(told, schema), "predictions")

    def save(self, spark: SparkSession, path: str) -> None:
        if isinstance(self.forest, Grove):
            self.forest.pieces.write.mode("overwrite").parquet(f"{path}/pieces")
            top = [(*r[:-1], [float(x) for x in r.value]) for r in self.forest.top.itertuples(index=False)]
            spark.createDataFrame(top, _NODES).write.mode("overwrite").parquet(f"{path}/top")
        else:
            spark.createDataFrame(self.forest.nodes(), _NODES).write.mode("overwrite").parquet(f"{path}/nodes")
        settings = {k: float(v) for k, v in self.settings.items()}
        row = (self.names, [c.tolist() for c in self.cuts], self.kind, [float(x) for x in self.base], settings)
        schema = "names array<string>, cuts array<array<double>>, kind string, base array<double>, settings map<string,double>"
        spark.createDataFrame([row], schema).write.mode("overwrite").parquet(f"{path}/trees")

    @staticmethod
    def load(spark: SparkSession, path: str) -> TreeModel:
        r = spark.read.parquet(f"{path}/trees").first()
        if exists(spark, f"{path}/pieces"):
            top = spark.read.parquet(f"{path}/top").toPandas()
            forest = Grove(spark.read.schema(_PIECES).parquet(f"{path}/pieces"), top, int(r["settings"]["numTrees"]))
        else:
            forest = Forest.of(spark.read.parquet(f"{path}/nodes").toPandas())
        return TreeModel(r["names"], [np.array(c) for c in r["cuts"]], forest, r["kind"], r["base"], r["settings"])


def softmax(scores: np.ndarray) -> np.ndarray:
    p = np.exp(scores - scores.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


# --- fits -----------------------------------------------------------------------------------


def plant(rows: DataFrame, width: int, plan: Growth, trees: int, label: str, without: int | None = None, bootstrap: bool = True, classes: int = 0, local_rows: int | None = None, bins: int = BINS) -> Grove:
    """A forest over a written table of bins; ``without`` leaves out the rows of that ``fold``. ``classes``: labels 0, 1, ... as shares.

    Trees grow in ``loops`` where the heap holds the rows; else, or with ``local_rows``, in numpy. They are the same but for sums in another order.
    """
    own = rows if without is None else rows.filter(F.col("fold") != without)
    count = own.count()
    if local_rows is None and bins <= 64:
        pieces = _in_loops(own, width, plan, trees, label, count, bootstrap, classes)
        if pieces is not None:
            return Grove(materialize(pieces, "pieces"), pd.DataFrame(columns=_NODE), trees)

    def targets(batch: pa.RecordBatch, b: np.ndarray, tree: int) -> tuple[np.ndarray, ...]:
        y = _column(batch, label)
        w = draws(batch.column("_row").to_numpy(), tree, plan.seed) if bootstrap else np.ones(len(y))
        return w, y.astype(np.int64) if classes else (y * w)[:, None], w

    top, pieces = grow(own, width, bins, targets, plan, list(range(trees)), count, local_rows or LOCAL_ROWS, classes, [label])
    return Grove(materialize(pieces, "pieces"), top, trees)


def fit_forest(*args, **settings) -> Forest:
    """``plant`` for small forests, collected."""
    return plant(*args, **settings).collect()


def boost(rows: DataFrame, width: int, plan: Growth, rounds: int, rate: float, label: str, classes: int = 0, without: int | None = None, local_rows: int | None = None, bins: int = BINS) -> tuple[Forest, list[float]]:
    """Gradient boosting over a written table of bins: (trees, score before the first).

    With ``classes`` each round takes one gradient of the multinomial log loss and grows one regression tree per class on
    it; a leaf makes one Newton step. Without, trees follow the residuals. Rounds run in ``loops`` where the executors' memory
    holds the rows; else, or with ``local_rows``, in numpy, where the table of scores is written every few rounds.
    """
    held = rows if without is None else materialize(rows.filter(F.col("fold") != without), "fold")
    count = held.count()
    if classes:
        told = {int(r[label]): r["count"] for r in held.groupBy(label).count().collect()}
        # A class that is not there starts, and stays, far below the others.
        base = [float(np.log(max(told.get(k, 0), 1e-9) / max(count, 1))) for k in range(classes)]
    else:
        base = [float(held.agg(F.avg(label)).first()[0] or 0.0)]
    if local_rows is None:
        forest = _boosted_in_loops(held, width, plan, rounds, rate, label, classes, base, count)
        if forest is not None:
            return forest, base
    outputs, local_rows = len(base), local_rows or LOCAL_ROWS
    kept = [label, "_scores"]
    scored = blocked(held.withColumn("_scores", F.array(*[F.lit(x) for x in base])), width, kept)
    done, latest = [], pd.DataFrame(columns=_NODE)

    def scores(batch: pa.RecordBatch, b: np.ndarray, recent: Forest | None) -> np.ndarray:
        out = batch.column("_scores").flatten().to_numpy().reshape(-1, outputs).copy()
        if recent is not None:
            for t in range(len(recent.start)):
                out[:, int(recent.tree[recent.start[t]]) % outputs] += rate * recent.value[recent.reach(t, b, plan.depth), 0]
        return out

    def divisors(r: np.ndarray) -> np.ndarray:
        return np.abs(r) * (1 - np.abs(r)) if classes else np.ones(len(r))

    for turn in range(rounds):
        recent = Forest.of(latest) if len(latest) else None

        def targets(batch: pa.RecordBatch, b: np.ndarray, tree: int, recent=recent, memo={}) -> tuple[np.ndarray, ...]:  # noqa: B006
            # All trees of a round ask for the scores of the same batch.
            if memo.get("batch") is not batch:
                now = scores(batch, b, recent)
                memo |= {"batch": batch, "scores": softmax(now) if classes else now}
            y, now = _column(batch, label), memo["scores"]
            r = (y == tree % outputs) - now[:, tree % outputs] if classes else y - now[:, 0]
            return np.ones(len(y)), r[:, None], divisors(r)

        top, pieces = grow(scored, width, bins, targets, plan, [turn * outputs + k for k in range(outputs)], count, local_rows, divisors=divisors)
        grown = Grove(pieces, top, outputs).collect().nodes()
        if classes:
            # One Newton step per leaf; where every row is right already there is nothing to divide by.
            step = (classes - 1) / classes
            grown["value"] = [[float(np.clip(v[0] * step, -1e3, 1e3))] for v in grown["value"]]
        done.append(grown)
        latest = pd.concat([latest, grown], ignore_index=True) if len(latest) else grown
        if (turn + 1) % KEPT_ROUNDS == 0 and turn + 1 < rounds:
            recent = Forest.of(latest)

            def added(batch: pa.RecordBatch, b: np.ndarray, recent=recent) -> pa.RecordBatch:
                now = scores(batch, b, recent)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(now.ravel()), outputs).cast(pa.list_(pa.float64()))
                return batch.set_column(batch.schema.get_field_index("_scores"), "_scores", lists)

            scored = blocked(scored, width, kept, added)
            latest = pd.DataFrame(columns=_NODE)
    return Forest.of(pd.concat(done, ignore_index=True)), base


def forest_errors(rows: DataFrame, width: int, forest: Forest | Grove, label: str, points: list[tuple[int, int, int]], fold: int | None = None, classes: int = 0) -> dict[tuple[int, int, int], float]:
    """Mean squared error of the forests inside one forest, by (trees, depth, least rows to split), in one pass over the rows.

    Of shares of classes the prediction is the likeliest one.
    """
    if isinstance(forest, Grove):
        return _grove_errors(rows, width, forest, label, points, fold, classes)
    sent = rows.sparkSession.sparkContext.broadcast(forest)
    sizes, depths, splits = (sorted(set(x)) for x in zip(*points))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = {}, 0
        for batch in batches:
            b, y = _bins_of(batch, width), _column(batch, label)
            sums = {(d, s): np.zeros((len(y), sent.value.value.shape[1])) for d in depths for s in splits}
            for t in range(min(sizes[-1], len(sent.value.start))):
                for s in splits:
                    at, steps = None, 0
                    for d in depths:
                        at, steps = sent.value.reach(t, b, d, s, at, steps), d
                        sums[d, s] += sent.value.value[at]
                if t + 1 in sizes:
                    for (d, s), total in sums.items():
                        guess = total.argmax(1) if classes else total[:, 0] / (t + 1)
                        held[t + 1, d, s] = held.get((t + 1, d, s), 0.0) + float(((guess - y) ** 2).sum())
            many += len(y)
        if held:
            keys = [(*k, v, many) for k, v in held.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*keys)], names=["trees", "depth", "split", "sse", "n"])

    own = rows if fold is None else rows.filter(F.col("fold") == fold)
    told = own.mapInArrow(run, "trees long, depth long, split long, sse double, n long").groupBy("trees", "depth", "split").agg(F.sum("sse").alias("sse"), F.sum("n").alias("n")).collect()
    found = {(r["trees"], r["depth"], r["split"]): r["sse"] / r["n"] for r in told}
    return {p: found.get(p, float("nan")) for p in points}


def _grove_errors(rows: DataFrame, width: int, forest: Grove, label: str, points: list[tuple[int, int, int]], fold: int | None, classes: int) -> dict[tuple[int, int, int], float]:
    sizes, depths, splits = (sorted(set(x)) for x in zip(*points))
    own = rows if fold is None else rows.filter(F.col("fold") == fold)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 33
        for batch in batches:
            if len(batch):
                columns = (chunk, len(batch), _bins_of(batch, width).tobytes(), _column(batch, label).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in columns], names=["chunk", "n", "bins", "y"])
                chunk += 1

    chunks = materialize(own.select(label, "_bins").mapInArrow(pack, "chunk long, n long, bins binary, y binary"), "chunks")
    sums = forest.sums(chunks, width, chunks.agg(F.sum("n")).first()[0] or 0, sizes, depths, splits, classes or 1)
    outputs = classes or 1

    def errors(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        y = np.frombuffer(left["y"].iloc[0])
        total = np.zeros((len(sizes), len(depths), len(splits), len(y), outputs))
        for r in right.sort_values("part").itertuples():
            # Trees count for their own size and all larger ones.
            for k, x in zip(r.bands, np.frombuffer(r.sums).reshape(len(r.bands), *total.shape[1:])):
                total[k:] += x
        guess = total.argmax(-1) if classes else total[..., 0] / np.array(sizes)[:, None, None, None]
        sse = ((guess - y) ** 2).sum(-1)
        keys = [(n, d, s, float(sse[i, j, k]), len(y)) for i, n in enumerate(sizes) for j, d in enumerate(depths) for k, s in enumerate(splits)]
        return pd.DataFrame(keys, columns=["trees", "depth", "split", "sse", "n"])

    told = chunks.groupBy("chunk").cogroup(sums.groupBy("chunk")).applyInPandas(errors, "trees long, depth long, split long, sse double, n long")
    told = told.groupBy("trees", "depth", "split").agg(F.sum("sse").alias("sse"), F.sum("n").alias("n")).collect()
    found = {(r["trees"], r["depth"], r["split"]): r["sse"] / r["n"] for r in told}
    return {p: found.get(p, float("nan")) for p in points}


def boosted_errors(rows: DataFrame, width: int, forest: Forest, base: list[float], rate: float, label: str, depth: int, rounds: list[int], fold: int | None = None, classes: int = 0) -> dict[int, float]:
    """Mean squared error after each of some numbers of rounds, in one pass over the rows."""
    sent = rows.sparkSession.sparkContext.broadcast(forest)
    outputs = len(base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = dict.fromkeys(rounds, 0.0), 0
        for batch in batches:
            b, y = _bins_of(batch, width), _column(batch, label)
            now = np.tile(np.array(base, float), (len(y), 1))
            for t in range(len(sent.value.start)):
                now[:, t % outputs] += rate * sent.value.value[sent.value.reach(t, b, depth), 0]
                if (t + 1) % outputs == 0 and (t + 1) // outputs in held:
                    guess = now.argmax(1) if classes else now[:, 0]
                    held[(t + 1) // outputs] += float(((guess - y) ** 2).sum())
            many += len(y)
        if many:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*[(k, v, many) for k, v in held.items()])], names=["rounds", "sse", "n"])

    own = rows if fold is None else rows.filter(F.col("fold") == fold)
    told = own.mapInArrow(run, "rounds long, sse double, n long").groupBy("rounds").agg(F.sum("sse").alias("sse"), F.sum("n").alias("n")).collect()
    return {r["rounds"]: r["sse"] / r["n"] for r in told}
