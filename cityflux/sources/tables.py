"""Stored tables: ranged and projected scans, appends, replacement."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cityflux.functions.categories import aqi_category_ingest
from cityflux.functions.times import AsOf, is_peak_hour, moment, shift_hours
from cityflux.plans.scratch import rebalanced


def scan_range(df: DataFrame, start: AsOf | None = None, end: AsOf | None = None, ts: str = "timestamp") -> DataFrame:
    """rows in the closed time range, either end open. The literals reach the Parquet scan."""
    if start is not None:
        df = df.filter(F.col(ts) >= moment(start))
    if end is not None:
        df = df.filter(F.col(ts) <= moment(end))
    return df


def newest_first(df: DataFrame, ts: str = "timestamp", tie: str = "id") -> DataFrame:
    """Newest first, lowest id first among equals. For display; operators never need it."""
    return df.orderBy(F.col(ts).desc(), F.col(tie))


def lookback_days(df: DataFrame, as_of: AsOf, days: int, date: str = "date") -> DataFrame:
    """rows whose date is at most ``days`` before the reference date."""
    return df.filter(F.col(date) >= F.date_sub(F.to_date(moment(as_of)), days))


def on_date(df: DataFrame, day: str, ts: str = "timestamp") -> DataFrame:
    """rows of one calendar day, as a half-open time range so that scans prune."""
    start = F.lit(day).cast("timestamp_ntz")
    return df.filter((F.col(ts) >= start) & (F.col(ts) < shift_hours(start, 24)))


def active_since(df: DataFrame, as_of: AsOf, minutes: int, ts: str = "timestamp") -> DataFrame:
    """active rows at or after the cutoff."""
    cutoff = moment(as_of) - F.make_dt_interval(mins=F.lit(minutes))
    return df.filter((F.col(ts) >= cutoff) & F.col("is_active"))


READING_COLUMNS = ["timestamp", "location", "latitude", "longitude", "aqi_value", "traffic_level"]


def realtime_scan(realtime: DataFrame, as_of: AsOf, minutes: int = 60) -> DataFrame:
    """The six reading columns of recent active rows, with the index made whole."""
    recent = active_since(realtime, as_of, minutes)
    return recent.select(*READING_COLUMNS, F.coalesce(F.col("aqi_value"), F.lit(0)).cast("int").alias("aqi_clean"))


def enrich_reading(df: DataFrame, offset_hours: int = 0) -> DataFrame:
    """Peak flag and ingestion label of a reading."""
    return df.withColumns(
        {
            "aqi_category": aqi_category_ingest(F.col("aqi_value")),
            "is_peak_hour": is_peak_hour(F.col("timestamp"), offset_hours),
        }
    )


def to_raw_data(df: DataFrame) -> DataFrame:
    """Readings as rows of the raw table."""
    return enrich_reading(df).withColumn("is_processed", F.lit(False))


def to_realtime_data(df: DataFrame) -> DataFrame:
    """Readings as active rows of the realtime table."""
    return enrich_reading(df).withColumn("is_active", F.lit(True))


def append_by_date(df: DataFrame, path: str, ts: str = "timestamp") -> None:
    """Append to a date-partitioned table; a date lands in few files, a hot one in several."""
    out = rebalanced(df.withColumn("date", F.to_date(ts)), "date")
    out.write.mode("append").partitionBy("date").parquet(path)


def newest_dates(df: DataFrame, n: int, date: str = "date") -> DataFrame:
    """Of a date-partitioned table only its newest dates, as many as hold ``n`` rows together.

    Dates come from the table's file names and are walked downwards, twice as many at a time; only the dates met are
    scanned. Rows without a time are in no date and come back where all dates together hold too few. A frame with
    no such layout comes back as it is.
    """
    if date not in df.columns:
        return df
    named = re.compile(rf"/{re.escape(date)}=(\d{{4}}-\d\d-\d\d)/")
    dates = sorted({found.group(1) for file in df.inputFiles() if (found := named.search(file))}, reverse=True)
    take = 1
    while take < len(dates):
        part = df.filter(F.col(date) >= F.lit(dates[take - 1]).cast("date"))
        if part.limit(n).count() >= n:
            return part
        take *= 2
    return df


def replace_table(df: DataFrame, path: str) -> None:
    """Replace a table by this frame, whole."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def jdbc_table(spark: SparkSession, url: str, table: str, start: AsOf, end: AsOf, parts: int = 64, **options) -> DataFrame:
    """S1 over a database: range-split on time so that many executors read at once."""
    split = {
        "partitionColumn": "timestamp",
        "lowerBound": str(start),
        "upperBound": str(end),
        "numPartitions": str(parts),
    }
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **split, **options)
    return scan_range(reader.load(), start, end)
