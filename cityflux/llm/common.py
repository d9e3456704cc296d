"""What the operators share: words, given tables, let-bindings inside one expression, even ranks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

# Characters between words, as a class of a regular expression.
SPACE = r"[\x20\x09-\x0D]"
# Texts a Python worker holds at a time, in bytes; a longer text is held alone.
CHUNK_BYTES = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text, in order; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row, wherever ``use`` repeats it.

    A lambda that named an outer expression would compute it again for every element.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def even_ranks(df: DataFrame, keys: list[str], order: list[str], rows: int, name: str, per_bucket: int = 100_000) -> DataFrame:
    """Add the 0-based rank of each row within its keys, with no more than about ``per_bucket`` rows a task.

    Rows of a key are dealt into hash buckets of the order columns, ranked inside a bucket, and
    moved up by the rows of the buckets before. The order between buckets is that of the hash.
    ``df`` must be a written table: it is read twice.
    """
    buckets = max(1, -(-rows // per_bucket))
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    group = [*keys, "_bucket"]
    along = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    before = dealt.groupBy(*group).count().select(*group, F.coalesce(F.sum("count").over(along), F.lit(0)).alias("_before"))
    inside = dealt.withColumn(name, F.row_number().over(W.partitionBy(*group).orderBy(*order)) - 1)
    if buckets == 1:
        return inside.drop("_bucket")
    a, b = inside.alias("a"), before.alias("b")
    same = F.lit(True)
    for key in group:
        same = same & F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}"))
    kept = [F.col(f"a.{c}") for c in df.columns]
    return a.join(b, same).select(*kept, (F.col(f"a.{name}") + F.col("b._before")).alias(name))


# --- texts in Python workers ----------------------------------------------------------------


def chunks(batch: pa.RecordBatch, column: str = "text", most: int = CHUNK_BYTES):
    """Parts of a batch whose texts together hold at most about ``most`` bytes."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        base = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(start, end - start)
        start = end
    # Workers are reused by later stages: what this batch no longer needs goes back to the system.
    pa.default_memory_pool().release_unused()


def flat_words(texts: pa.Array, lower: bool) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, and for each text the position of its first word (one more at the end)."""
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    flat, ends = lists.values, lists.offsets.to_numpy()
    flat = flat.slice(int(ends[0]), int(ends[-1] - ends[0]))
    full = pc.greater(pc.binary_length(flat), 0)
    kept = np.concatenate(([0], np.cumsum(full.to_numpy(zero_copy_only=False))))
    return flat.filter(full), kept[ends - ends[0]]


def struct_of(df: DataFrame, *extra: tuple[str, str]) -> T.StructType:
    """The schema of df with further columns."""
    out = T.StructType(list(df.schema.fields))
    for name, kind in extra:
        out.add(name, kind)
    return out
