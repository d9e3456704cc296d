"""CSV, JSON and text exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
# Whole microseconds; the default formats keep only milliseconds.
_TIMES = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}
_REPLACE = {"partitionOverwriteMode": "static"}


def write_csv(df: DataFrame, path: str) -> None:
    """Header, no index, all rows."""
    df.write.mode("overwrite").options(header=True, **_TIMES, **_REPLACE).csv(path)


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).options(header=True, **_TIMES).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """A tidy table as JSON lines."""
    df.write.mode("overwrite").options(**_TIMES, **_REPLACE).json(path)


def read_json(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).options(**_TIMES).json(path)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A short report as text."""
    out = spark.createDataFrame([(text,)], "value string")
    out.coalesce(1).write.mode("overwrite").options(**_REPLACE).text(path)
