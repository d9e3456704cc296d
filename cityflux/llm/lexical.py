"""Ranked lexical search by MaxScore with bounds of term pairs.

All documents are cut into terms once; kept are the terms that a block of items asks for. A second pass deals the documents
into blocks and writes an inverted index: for each term its documents and impacts with the greatest impact, and for each
pair of neighbouring terms of an item the greatest joint impact in the intersection of their lists. The ten best
impacts of every list, merged over the blocks, give each item a score that its tenth document reaches at least.

Items are then answered block by block. The terms of an item count as pairs: two terms together add no more than the
greater of their joint maximum and their own maxima, which is less than the sum of both maxima. Pairs are read from the
greatest bound down; once the bounds of the rest together stay below the score to beat, the rest is looked up only for documents met
so far, and those that cannot reach the score any more are dropped before each lookup. Skipping is by bounds alone, so results are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cityflux.llm.common import chunks
from cityflux.plans.scratch import materialize

TOP = 10
# Items answered together: their terms travel with the tasks.
ITEMS = 1_000
# A block of the index: about so many documents and postings.
BLOCK_DOCS, BLOCK_POSTINGS = 8_192, 2_000_000
CHUNK_BYTES = 8_000_000

# ASCII bytes that end a term become spaces, capitals small letters; all other bytes stay.
_BYTES = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()


# --- terms ----------------------------------------------------------------------------------


def terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts in order, and the position of each text's first term (one more at the end)."""
    texts = pc.fill_null(texts, "")
    if not len(texts):
        return pa.array([], pa.string()), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    plain = bytes(memoryview(data)[at[0] : at[-1]]).translate(_BYTES) if data is not None else b""
    lists = pc.ascii_split_whitespace(pa.StringArray.from_buffers(len(texts), pa.py_buffer((at - at[0]).tobytes()), pa.py_buffer(plain)))
    flat, ends = lists.values, lists.offsets.to_numpy()
    full = pc.greater(pc.binary_length(flat), 0)
    kept = np.concatenate(([0], np.cumsum(full.to_numpy(zero_copy_only=False))))
    return flat.filter(full), kept[ends]


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, item (a number that tells rows of one item_id apart) and the distinct terms of each item's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            flat, first = terms(batch.column("text"))
            lists = [sorted(set(flat.slice(a, b - a).to_pylist())) for a, b in zip(first[:-1], first[1:])]
            numbers = pa.array(row + np.arange(len(batch)))
            row += len(batch)
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), numbers, pa.array(lists, pa.list_(pa.string()))], names=["item_id", "item", "terms"])

    return items.select(F.col("item_id").cast("long"), "text").mapInArrow(run, "item_id long, item long, terms array<string>")


def term_lists(docs: DataFrame, wanted: pa.Array) -> DataFrame:
    """row, doc_id, n (terms with repeats) of every document, and which of the wanted terms it holds (``at``) how often (``tf``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in chunks(batch, most=CHUNK_BYTES):
                flat, first = terms(part.column("text"))
                coded = flat.dictionary_encode()
                place = pc.fill_null(pc.index_in(coded.dictionary, value_set=wanted), -1).to_numpy().astype(np.int64)
                term = place[coded.indices.to_numpy()] if len(flat) else np.zeros(0, np.int64)
                owner = np.repeat(np.arange(len(part)), np.diff(first))
                key, tf = np.unique((owner * len(wanted) + term)[term >= 0], return_counts=True)
                ends = np.searchsorted(key, np.arange(len(part) + 1) * len(wanted)).astype(np.int32)
                at, tf = (pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (key % max(1, len(wanted)), tf))
                numbers = pa.array(row + np.arange(len(part)))
                row += len(part)
                yield pa.RecordBatch.from_arrays([numbers, part.column("doc_id"), pa.array(np.diff(first)), at, tf], names=["row", "doc_id", "n", "at", "tf"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "row long, doc_id long, n long, at array<int>, tf array<int>")


# --- the index ------------------------------------------------------------------------------


def _units(own: list[int], weight: np.ndarray) -> list[tuple[int, ...]]:
    """The terms of an item as pairs of neighbours by falling weight; of an odd number the last stays alone."""
    order = sorted((t for t in own if weight[t] > 0), key=lambda t: (-weight[t], t))
    return [tuple(order[k : k + 2]) for k in range(0, len(order), 2)]


def _best(impacts: np.ndarray, top: int) -> np.ndarray:
    return np.sort(impacts)[::-1][:top] if len(impacts) <= top else np.sort(np.partition(impacts, -top)[-top:])[::-1]


def build_index(lists: DataFrame, blocks: int, weight: np.ndarray, n: int, total: int, pairs: list[tuple[int, int]], top: int = TOP) -> DataFrame:
    """The inverted index, one row per block and list: (block, a, b, docs, impacts, most, best).

    Of a term ``a`` (b null): its documents by place in the block, their impacts, the greatest and the ten best. Of a pair
    (a, b): the joint impacts of documents that hold both, as the greatest and the ten best. a = -1: the doc_ids of the block.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame[frame["at"].str.len() > 0]
        sizes = frame["at"].str.len().to_numpy()
        if not len(frame):
            return pd.DataFrame({c: [] for c in ("block", "a", "b", "docs", "impacts", "most", "best")})
        doc = np.repeat(np.arange(len(frame), dtype=np.int32), sizes)
        term, tf = np.concatenate(frame["at"].to_list()).astype(np.int64), np.concatenate(frame["tf"].to_list()).astype(np.int64)
        m = 10 + 90 * frame["n"].to_numpy(np.int64) * n // total
        impact = weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, sizes)))
        full = impact > 0
        doc, term, impact = doc[full], term[full], impact[full]
        order = np.argsort(term, kind="stable")
        doc, term, impact = doc[order], term[order], impact[order]
        starts = np.flatnonzero(np.diff(term, prepend=-1))
        held = {int(term[s]): (doc[s:t], impact[s:t]) for s, t in zip(starts, [*starts[1:], len(term)])}
        block = int(frame["block"].iloc[0])
        ids = frame["doc_id"].to_numpy(np.float64 if frame["doc_id"].isna().any() else np.int64)
        nameless = np.flatnonzero(np.isnan(ids)).astype(np.int32) if ids.dtype == np.float64 else np.zeros(0, np.int32)
        if len(nameless):
            ids = frame["doc_id"].astype("Int64").fillna(0).to_numpy(np.int64)
        rows = [(block, -1, None, nameless, ids, 0, [])]
        rows += [(block, t, None, d, i, int(i.max()), _best(i, top)) for t, (d, i) in held.items()]
        dense, last = np.zeros(len(frame), np.int64), -1
        for a, b in pairs:
            if a in held and b in held:
                if a != last:
                    dense[:] = 0
                    dense[held[a][0]] = held[a][1]
                    last = a
                joint = dense[held[b][0]]
                joint = joint[joint > 0] + held[b][1][joint > 0]
                if len(joint):
                    rows.append((block, a, b, [], [], int(joint.max()), _best(joint, top)))
        return pd.DataFrame(rows, columns=["block", "a", "b", "docs", "impacts", "most", "best"]).astype({"b": "Int32"})

    dealt = lists.filter(F.size("at") > 0).withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    return dealt.groupBy("block").applyInPandas(run, "block long, a int, b int, docs array<int>, impacts array<long>, most long, best array<long>")


def floors(index: DataFrame, top: int = TOP) -> dict[tuple[int, int | None], int]:
    """For each list with ten documents or more in all blocks together: the impact of the tenth."""
    best = index.filter("a >= 0").select("a", "b", F.explode("best").alias("impact"))
    ranked = best.withColumn("r", F.row_number().over(W.partitionBy("a", "b").orderBy(F.desc("impact")))).filter(F.col("r") <= top)
    told = ranked.groupBy("a", "b").agg(F.min("impact").alias("least"), F.count("*").alias("n")).filter(F.col("n") == top)
    return {(r["a"], r["b"]): r["least"] for r in told.collect()}


# --- answers --------------------------------------------------------------------------------


def answer(units: list[tuple[int, ...]], held: dict, most: dict, floor: int, size: int, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of a block that may be among an item's best, with their scores: all of its ``top`` best that reach ``floor``.

    ``held`` has (documents, impacts) by term, ``most`` the greatest impact by (term, None) and the greatest joint one by pair.
    """
    bounds, present = [], []
    for unit in units:
        own = [t for t in unit if t in held]
        if own:
            single = max(most[t, None] for t in own)
            bounds.append(max(single, most.get(unit, 0)) if len(own) == 2 else single)
            present.append(own)
    order = np.argsort(-np.array(bounds, np.int64), kind="stable")
    rest = np.append(np.cumsum(np.array(bounds, np.int64)[order][::-1])[::-1], 0)
    aim, scores, u = max(floor, 1), np.zeros(size, np.int64), 0

    def raised(partial: np.ndarray) -> int:
        return max(aim, int(np.partition(partial, -top)[-top])) if len(partial) >= top else aim

    # A document met in none of the pairs read so far can add up to rest[u] at most.
    while u < len(order) and rest[u] >= aim:
        for t in present[order[u]]:
            docs, impacts = held[t]
            scores[docs] += impacts
        aim, u = raised(scores), u + 1
    met = np.flatnonzero(scores)
    partial = scores[met]
    while u < len(order):
        can = partial + rest[u] >= aim
        met, partial = met[can], partial[can]
        if not len(met):
            break
        for t in present[order[u]]:
            docs, impacts = held[t]
            at = np.searchsorted(docs, met)
            at[at == len(docs)] = 0
            partial = partial + np.where(docs[at] == met, impacts[at], 0)
        aim, u = raised(partial), u + 1
    can = partial >= aim
    return met[can], partial[can]


def _answers(index: DataFrame, plan: list[tuple[int, list[tuple[int, ...]], int]], top: int) -> DataFrame:
    """(item, doc_id, score): of each block and item the best documents."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        held, most, ids, nameless = {}, {}, None, None
        singles = frame["b"].isna().to_numpy()
        for a, b, single, docs, impacts, top_impact in zip(frame["a"], frame["b"], singles, frame["docs"], frame["impacts"], frame["most"]):
            if a < 0:
                ids, nameless = impacts, docs
            else:
                most[int(a), None if single else int(b)] = int(top_impact)
                if single:
                    held[int(a)] = (docs, impacts)
        named = np.ones(len(ids), bool)
        named[nameless] = False
        items, found, scores = [], [], []
        for item, units, floor in plan:
            docs, own = answer(units, held, most, floor, len(ids), top)
            first = np.lexsort((ids[docs], ~named[docs], -own))[:top]
            items.append(np.full(len(first), item))
            found.append(docs[first])
            scores.append(own[first])
        at = np.concatenate(found)
        doc_id = pd.Series(ids[at], dtype="Int64").mask(~named[at])
        return pd.DataFrame({"item": np.concatenate(items), "doc_id": doc_id, "score": np.concatenate(scores)})

    return index.groupBy("block").applyInPandas(run, "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, items_at_once: int = ITEMS, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` highest-scoring documents of each item, equal scores by ascending doc_id.

    Null and empty texts have no terms: such documents are not counted, such items get no rows. Rows of one item_id are
    answered each, rows of one doc_id are documents each; a null doc_id comes last among equal scores. Empty tables:
    no rows. Other columns are left out. Whole texts are searched; the items are taken in blocks.
    """
    asked = materialize(item_terms(items), "items")
    asked = asked.filter(F.size("terms") > 0)
    # Items travel to the tasks in blocks, dealt by hash; their answers are small tables.
    parts = -(-asked.count() // items_at_once)
    answers, whole = [], None
    for part in range(parts):
        own = asked.filter(F.pmod(F.xxhash64("item"), F.lit(parts)) == part).select("item", "terms").collect()
        wanted = sorted({t for r in own for t in r["terms"]})
        number = {t: i for i, t in enumerate(wanted)}
        lists = materialize(term_lists(docs, pa.array(wanted, pa.string())), "terms")
        if whole is None:
            whole = lists.filter("n > 0").agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
        counted = lists.select(F.explode("at").alias("t")).groupBy("t").count().collect()
        df = np.zeros(len(wanted), np.int64)
        for r in counted:
            df[r["t"]] = r["count"]
        weight = np.array([math.floor(1000 * math.log((2 * whole["n"] + 2) / (2 * d + 1))) if d else 0 for d in df.tolist()], np.int64)
        units = {r["item"]: _units([number[t] for t in r["terms"]], weight) for r in own}
        pairs = sorted({u for held in units.values() for u in held if len(u) == 2})
        blocks = max(1, -(-whole["n"] // block_docs), -(-int(df.sum()) // BLOCK_POSTINGS))
        index = materialize(build_index(lists, blocks, weight, whole["n"], max(1, whole["total"]), pairs, top), "index")
        least = floors(index, top)
        plan = []
        for item, held in units.items():
            keys = [*held, *[(t, None) for u in held for t in u]]
            plan.append((item, held, max((least.get(k, 0) for k in keys), default=0)))
        answers.append(materialize(_answers(index, plan, top), "answers"))
    if not answers:
        return asked.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    found = answers[0]
    for more in answers[1:]:
        found = found.unionByName(more)
    place = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    ranked = found.withColumn("rank", place).filter(F.col("rank") <= top)
    return ranked.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
