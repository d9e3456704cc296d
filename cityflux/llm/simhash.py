"""SimHash near-duplicates by anchor-point covering.

Fingerprints of 64 bits link when at most two bits differ; then in one of their halves at most one
differs. On 31 bits of each half the codewords of the perfect Hamming code are anchors: every word is
within one bit of exactly one (its home). A fingerprint is put at every anchor within covering radius plus
threshold, two bits, of each half: one when the half is a codeword, else 16. Of a linked pair, one's home is
among the other's anchors, so comparing homes with replicas anchor by anchor finds every link.

Equal fingerprints are one node from the start, so copies never meet as pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cityflux.llm.common import chunks, flat_words
from cityflux.llm.components import components
from cityflux.plans.scratch import materialize, measured_side

SHINGLE = 3
MOST_BITS = 2
SEED = 42

# Byte -> its bits as eight counters of one byte each.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def _bit_counts(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many hashes of each run (beginning at ``starts``) have each of 64 bits set."""
    # Counters of a byte hold 255 rows: cut runs there, add eight counters at a time, then add the cuts.
    ends = np.append(starts[1:], len(hashes))
    cuts = -(-(ends - starts) // 255)
    first = np.cumsum(cuts) - cuts
    at = np.repeat(starts - first * 255, cuts) + np.arange(cuts.sum()) * 255
    lanes = _SPREAD[hashes.view(np.uint8).reshape(-1, 8)]
    small = np.add.reduceat(lanes, at, axis=0).view(np.uint8).reshape(len(at), 64)
    return np.add.reduceat(small, first, axis=0, dtype=np.int64)


def _prints(texts: pa.Array, shingle: int) -> np.ndarray:
    words, first = flat_words(texts, lower=True)
    n = np.diff(first)
    out = np.zeros(len(n), np.uint64)
    if not len(words):
        return out
    # A shingle starts at every word that has shingle - 1 more after it; a shorter text is one shingle.
    many = np.maximum(n - shingle + 1, np.minimum(n, 1))
    if len(words) >= shingle:
        runs = [words.slice(k, len(words) - shingle + 1) for k in range(shingle)]
        joined = pc.binary_join_element_wise(*runs, " ")
    else:
        joined = pa.array([], pa.string())
    starts = np.cumsum(many) - many
    at = np.repeat(first[:-1] - starts, many) + np.arange(many.sum())
    short = (n > 0) & (n < shingle)
    full = np.repeat(~short, many)
    hashes = np.zeros(len(at), np.uint64)
    if full.any():
        own = joined.take(pa.array(at[full]))
        hashes[full] = np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in own.to_numpy(zero_copy_only=False)), np.uint64, len(own))
    for i in np.flatnonzero(short):
        hashes[starts[i]] = xxhash.xxh64_intdigest(" ".join(words.slice(first[i], n[i]).to_pylist()), SEED)
    has = many > 0
    counts = _bit_counts(hashes, starts[has])
    bits = (2 * counts > many[has][:, None]).astype(np.uint8)
    out[has] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash and fp (the 64 bits as a long) of every document, over its whole text.

    Null and empty texts have fingerprint zero. Other columns are left out; null doc_ids stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                prints = _prints(part.column("text"), shingle).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(prints)], names=["doc_id", "text_hash", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, "doc_id long, text_hash long, fp long")


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _syndrome(word: Column) -> Column:
    """Of 31 bits, the place (from 1) of the bit to turn for the nearest codeword; 0 if it is one."""
    out = F.lit(0)
    for k in range(5):
        mask = sum(1 << (p - 1) for p in range(1, 32) if p >> k & 1)
        out = out + F.shiftleft(F.bit_count(word.bitwiseAND(F.lit(mask))) % 2, k)
    return out


def _turned(word: Column, place: Column) -> Column:
    """The word with the bit at ``place`` turned; place 0 turns none."""
    bits = F.array(F.lit(0).cast("long"), *[F.lit(1 << p).cast("long") for p in range(31)])
    return word.bitwiseXOR(F.get(bits, place))


def links(prints: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """Pairs (a, b), a < b, of different fingerprints of column fp with at most ``most`` (0 to 2) differing bits."""
    low = 2**31 - 1
    halves = F.array(
        F.struct(F.lit(0).alias("half"), F.col("fp").bitwiseAND(low).alias("word")),
        F.struct(F.lit(1).alias("half"), F.shiftrightunsigned("fp", 32).bitwiseAND(low).alias("word")),
    )
    cut = prints.select("fp", F.explode(halves).alias("h")).select("fp", "h.half", "h.word").withColumn("s", _syndrome(F.col("word")).cast("int"))
    home = cut.select("half", _turned(F.col("word"), F.col("s")).alias("anchor"), F.col("fp").alias("a"))
    # Within two bits of a word that is no codeword: its home, and one for each pair of places whose sum is s.
    pairs = F.filter(F.sequence(F.lit(1), F.lit(31)), lambda p: p < p.bitwiseXOR(F.col("s")))
    twice = F.transform(pairs, lambda p: _turned(_turned(F.col("word"), p), p.bitwiseXOR(F.col("s"))))
    near = F.when(F.col("s") == 0, F.array("word")).otherwise(F.concat(F.array(_turned(F.col("word"), F.col("s"))), twice))
    replicas = cut.select("half", F.explode(near).alias("anchor"), F.col("fp").alias("b"))
    found = home.join(replicas, ["half", "anchor"]).filter((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _grouped(docs: DataFrame, shingle: int, most: int) -> DataFrame:
    """doc_id, text_hash, fp, root (a fingerprint that stands for the component), component_id."""
    held = materialize(fingerprints(docs, shingle), "prints")
    nodes = materialize(held.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    rooted = materialize(components(links(nodes.select("fp"), most)), "rooted")
    # Few fingerprints are linked: only they are joined with their root and its least document.
    linked = rooted.join(nodes, rooted["node"] == nodes["fp"]).select("fp", "root", "first")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    found = linked.join(least, "root").select("fp", "root", "least")
    whole = nodes.join(found, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("least")).alias("component_id"))
    return held.join(whole, "fp")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, most: int = MOST_BITS) -> DataFrame:
    """doc_id, fp and component_id (the least doc_id reachable over links) of every document.

    Null and empty texts have fingerprint zero and link like any other. Rows with a null doc_id take part;
    a component of only such rows has a null component_id. Repeated rows come out as often as they go in.
    Empty table: no rows. Other columns are left out.
    """
    return _grouped(docs, shingle, most).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, most: int = MOST_BITS) -> DataFrame:
    """Of each group of near-duplicates the document with the least doc_id, with its own columns.

    Null doc_ids come last; rows of one doc_id with other texts are told apart by text hash, the least
    stays; of equal rows one stays. Null and empty texts are one group. Empty table: no rows.
    """
    groups = materialize(_grouped(docs, shingle, most), "groups")
    name = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_hash")
    winners = groups.groupBy("root").agg(F.min(name).alias("w"))
    marked = groups.select("root", "doc_id", "text_hash").join(winners, "root").withColumn("wins", F.col("w") == name)
    gone = measured_side(marked.filter("not wins").select("doc_id", "text_hash").distinct(), "gone")
    twice = measured_side(marked.filter("wins").groupBy("doc_id", "text_hash").count().filter("count > 1").drop("count"), "twice")

    def same(side: DataFrame):
        return docs["doc_id"].eqNullSafe(side["doc_id"]) & (F.xxhash64(docs["text"]) == side["text_hash"])

    kept = docs.join(gone, same(gone), "left_anti")
    if twice.isEmpty():
        return kept
    rank = F.row_number().over(W.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.lit(0)))
    one = docs.join(twice, same(twice), "left_semi").withColumn("_simhash_rank", rank).filter("_simhash_rank = 1").drop("_simhash_rank")
    rest = kept.join(twice, kept["doc_id"].eqNullSafe(twice["doc_id"]) & (F.xxhash64(kept["text"]) == twice["text_hash"]), "left_anti")
    return rest.unionByName(one)
