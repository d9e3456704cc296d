"""Batch jobs as plain functions of a reference time, for any scheduler.

The rollup table holds hourly and daily rows, partitioned by date; a rerun replaces its own rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cityflux.functions.times import AsOf, moment, previous_hour, shift_hours
from cityflux.operators import rollups
from cityflux.operators.upserts import ROLLUP_KEYS, upsert_table
from cityflux.schemas import BATCH_AGGREGATIONS, PEAK_HOURS_TABLE
from cityflux.sources.tables import read_table, scan_range


def _between(raw: DataFrame, start, end) -> DataFrame:
    return raw.filter((F.col("timestamp") >= start) & (F.col("timestamp") < end))


def yesterday(as_of: AsOf):
    """First moment of the day before the reference time."""
    return shift_hours(F.date_trunc("day", moment(as_of)).cast("timestamp_ntz"), -24)


def hourly_job(raw: DataFrame, table: str, as_of: AsOf) -> None:
    """Rows of the hour before ``as_of``."""
    start = previous_hour(as_of)
    upsert_table(table, rollups.hourly_aggregation(_between(raw, start, shift_hours(start, 1))))


def daily_job(raw: DataFrame, table: str, as_of: AsOf) -> None:
    """Daily rows of the day before ``as_of``."""
    start = yesterday(as_of)
    upsert_table(table, rollups.daily_aggregation(_between(raw, start, shift_hours(start, 24))))


def backfill(raw: DataFrame, table: str, start: AsOf | None = None, end: AsOf | None = None) -> None:
    """Hourly and daily rows of all hours that lie in the range, in one pass over the readings."""
    state = rollups.hourly_state(scan_range(raw, start, end))
    upsert_table(table, rollups.finish(state).unionByName(rollups.daily_from_hourly(state)))


def peak_job(spark: SparkSession, table: str, peaks: str, as_of: AsOf) -> None:
    """Peak hours of the day before ``as_of``, from the stored hourly rows of that day."""
    day = read_table(spark, table, BATCH_AGGREGATIONS).filter(F.col("date") == F.to_date(yesterday(as_of)))
    upsert_table(peaks, rollups.peak_hours(day), ["analysis_date"], "analysis_date")


def stored_rollup(spark: SparkSession, table: str) -> DataFrame:
    return read_table(spark, table, BATCH_AGGREGATIONS).select(*ROLLUP_KEYS, *BATCH_AGGREGATIONS.names[3:])


def stored_peaks(spark: SparkSession, peaks: str) -> DataFrame:
    return read_table(spark, peaks, PEAK_HOURS_TABLE).select(*PEAK_HOURS_TABLE.names)
