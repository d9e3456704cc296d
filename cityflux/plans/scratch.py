"""Tables in the shared folder the cluster names, and joins that broadcast only what was measured."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side with at most this many narrow rows is sent to every executor.
BROADCAST_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, or a fresh one on a local session."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="cityflux-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path under one folder per application, so that a finished one's tables can be dropped together."""
    return f"{shared_dir(spark)}/cityflux-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder at the path, on whatever file system it names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def clear(spark: SparkSession) -> None:
    """Delete all tables this application has put aside; for the end of a run, when no frame reads them any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/cityflux-{spark.sparkContext.applicationId}")
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write once and read back: cuts lineage, survives lost executors, stays columnar and prunable."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, rows: int, key: str = "id", per_task: int = 8_000, most: int = 4_096) -> DataFrame:
    """Rows dealt by a hash of ``key`` over a number of partitions that the row count alone decides.

    For work that reads a table again and again and draws per partition, such as fitting forests: the
    same rows then come in the same partitions on any cluster.
    """
    return df.repartition(min(most, max(1, -(-rows // per_task))), key)


def measured_side(df: DataFrame, name: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A small join side, written once and marked for broadcast only if it has few enough rows.

    Past the limit the side comes back plain: the join shuffles and adaptive execution splits hot keys.
    """
    side = materialize(df, name)
    return F.broadcast(side) if side.limit(limit + 1).count() <= limit else side


def rebalanced(df: DataFrame, *columns: str) -> DataFrame:
    """Rows gathered by column values into files of even size: small groups share a task, a hot one is split."""
    return df.sparkSession.sql(f"SELECT /*+ REBALANCE({', '.join(columns)}) */ * FROM {{df}}", df=df)
