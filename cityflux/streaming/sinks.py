"""Micro-batch sinks that a replayed batch cannot double.

Every batch writes its own ``batch_id`` partition and overwrites it when it comes again. Rollups keep
additive states, so reading is a merge, rows may come in any order, and nothing is rewritten.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cityflux.operators.rollups import hourly_state, merge_states
from cityflux.operators.upserts import expire
from cityflux.plans.scratch import exists
from cityflux.sources.messages import decode, good, quarantine
from cityflux.sources.tables import to_raw_data, to_realtime_data

Sink = Callable[[DataFrame, int], None]


def write_batch(df: DataFrame, batch_id: int, path: str) -> None:
    """One batch as one partition of a table, replaced when the batch is replayed."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{path}/batch_id={batch_id}")


def read_batches(spark: SparkSession, path: str, after: int = -1) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("batch_id") > after)


def delta_sink(path: str) -> Sink:
    """The hourly state of the batch alone."""
    return lambda df, batch_id: write_batch(hourly_state(df), batch_id, path)


# Written last into a snapshot; one without it is not read.
_COMPLETE = "_COMPLETE"


def read_rollup(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """The hourly state over all batches, or those up to ``upto``: newest snapshot merged with the batches after it."""
    base, done = _snapshot(spark, path, upto)
    deltas = read_batches(spark, f"{path}/deltas", done)
    if upto is not None:
        deltas = deltas.filter(F.col("batch_id") <= upto)
    deltas = deltas.drop("batch_id")
    return merge_states(deltas if base is None else base.unionByName(deltas))


def _snapshot(spark: SparkSession, path: str, upto: int | None) -> tuple[DataFrame | None, int]:
    """The newest complete snapshot, of those up to ``upto``."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/snapshots/upto=*/{_COMPLETE}")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
    marks = [int(str(f.getPath().getParent().getName()).split("=")[1]) for f in found]
    done = max((m for m in marks if upto is None or m <= upto), default=None)
    return (None, -1) if done is None else (spark.read.parquet(f"{path}/snapshots/upto={done}"), done)


def compact(spark: SparkSession, path: str) -> int:
    """Merge all batches so far into a snapshot; readers move to it once it is marked complete.

    Batches that land meanwhile are not part of it: readers take them from their own folders.
    """
    upto = newest_batch(spark, path)
    write_snapshot(spark, path, upto)
    return upto


def write_snapshot(spark: SparkSession, path: str, upto: int) -> None:
    """The state of the batches up to ``upto``, marked complete once it is written."""
    folder = f"{path}/snapshots/upto={upto}"
    if not exists(spark, f"{folder}/{_COMPLETE}"):
        read_rollup(spark, path, upto).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(folder)
        mark = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{_COMPLETE}")
        mark.getFileSystem(spark._jsc.hadoopConfiguration()).create(mark, True).close()


def newest_batch(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(f"{path}/deltas").agg(F.max("batch_id")).first()[0]


def read_realtime(spark: SparkSession, path: str, as_of, hours: int = 1) -> DataFrame:
    """Realtime rows with those older than the cutoff inactive; expiry costs no rewrite."""
    rows = spark.read.parquet(path).drop("batch_id")
    return expire(rows.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz")), as_of, hours)


def speed_layer(realtime_path: str, rollup_path: str, quarantine_path: str, raw_path: str | None = None) -> Sink:
    """One pass over a message batch into every table it feeds.

    The parsed batch is kept for the few writes and released after them.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        parsed = decode(batch).persist()
        try:
            rows = good(parsed)
            write_batch(to_realtime_data(rows), batch_id, realtime_path)
            if raw_path:
                write_batch(to_raw_data(rows), batch_id, raw_path)
            write_batch(hourly_state(rows), batch_id, f"{rollup_path}/deltas")
            write_batch(quarantine(parsed), batch_id, quarantine_path)
        finally:
            parsed.unpersist()

    return sink
