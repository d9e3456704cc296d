"""Keyed replacement and soft expiry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cityflux.functions.times import AsOf, moment
from cityflux.plans.scratch import exists, materialize, rebalanced

ROLLUP_KEYS = ["date", "hour", "location"]


def newest_per_key(df: DataFrame, keys: list[str], newest: str | None) -> DataFrame:
    """One row per key, and an error if there are more and nothing says which is newest; the limit runs before the shuffle too, so copies of a key stay where they are."""
    if newest is None:
        # Two rows for one key would both stay and break the key: the job ends instead.
        many = F.count(F.lit(1)).over(W.partitionBy(*keys)) > 1
        checked = df.withColumn("_rn", F.when(many, F.raise_error(F.lit("the source repeats a key"))).otherwise(F.lit(True)))
        return checked.filter("_rn").drop("_rn")
    spec = W.partitionBy(*keys).orderBy(F.col(newest).desc())
    return df.withColumn("_rn", F.row_number().over(spec)).filter("_rn = 1").drop("_rn")


def upsert(target: DataFrame, source: DataFrame, keys: list[str] = ROLLUP_KEYS, newest: str | None = None) -> DataFrame:
    """Source rows replace target rows of the same key; NULL key parts are equal.

    ``newest`` names a column that picks the row when the source repeats a key.
    """
    new = newest_per_key(source, keys, newest).select(*target.columns)
    same = reduce(lambda a, b: a & b, [target[k].eqNullSafe(new[k]) for k in keys])
    return target.join(new, same, "left_anti").unionByName(new)


# A source with at most this many partition values names them, so that only those are listed and read.
_NAMED_PARTITIONS = 10_000


def upsert_table(path: str, source: DataFrame, keys: list[str] = ROLLUP_KEYS, partition: str = "date") -> None:
    """U4 on a stored table partitioned by ``partition``: only touched partitions are read and rewritten.

    The merged partitions are written aside first, since a plan may not overwrite what it reads.
    A table not there yet is made.
    """
    spark = source.sparkSession
    source = materialize(source, "upsert-source")
    if not exists(spark, path):
        return write_partitions(newest_per_key(source, keys, None), path, partition)
    target = spark.read.schema(source.schema).parquet(path).select(*source.columns)
    touched = source.select(partition).distinct()
    names = [r[0] for r in touched.limit(_NAMED_PARTITIONS + 1).collect()]
    if len(names) <= _NAMED_PARTITIONS:
        old = target.filter(F.col(partition).isin(names))
    else:
        old = target.join(touched, partition, "left_semi")
    write_partitions(materialize(upsert(old, source, keys), "upsert-merged"), path, partition)


def write_partitions(df: DataFrame, path: str, partition: str = "date") -> None:
    """Replace exactly the partitions present in ``df``."""
    out = rebalanced(df, partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    out.partitionBy(partition).parquet(path)


def expire(realtime: DataFrame, as_of: AsOf, hours: int = 1) -> DataFrame:
    """Active rows older than the cutoff become inactive."""
    cutoff = moment(as_of) - F.make_dt_interval(hours=F.lit(hours))
    stale = F.col("is_active") & (F.col("timestamp") < cutoff)
    return realtime.withColumn("is_active", F.when(stale, False).otherwise(F.col("is_active")))
