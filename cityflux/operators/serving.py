"""The merged recent-plus-historical view and its parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cityflux.functions.numbers import normalize_aqi, round_to_int
from cityflux.functions.times import AsOf, minutes_between, moment, time_from_parts
from cityflux.sources.tables import READING_COLUMNS, lookback_days, newest_dates, realtime_scan

VIEW_ROWS = 100
ENOUGH_SPEED_ROWS = 10
SPEED_MINUTES = 60


def latest_per_location(df: DataFrame, columns: list[str], ts: str = "timestamp", tie: str = "id") -> DataFrame:
    """The newest row per location (highest id on ties).

    The rank limit is applied on both sides of the shuffle, so a hot location sends one row per task.
    """
    spec = W.partitionBy("location").orderBy(F.col(ts).desc(), F.col(tie).desc())
    narrow = df.select("location", ts, tie, *[c for c in columns if c not in ("location", ts, tie)])
    newest = narrow.withColumn("_rn", F.row_number().over(spec)).filter("_rn = 1")
    return newest.select("location", *[c for c in columns if c != "location"])


def few_rows(df: DataFrame) -> DataFrame:
    """A frame that a limit already bounds, run once and held as literal rows: what follows plans nothing twice."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def with_coordinates(df: DataFrame, raw: DataFrame) -> DataFrame:
    """Latest coordinates of the location, the row's own kept where there are none."""
    coords = latest_per_location(raw, ["latitude", "longitude"]).select(
        "location", F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon")
    )
    joined = df.join(coords, "location", "left")
    return joined.withColumns(
        {"latitude": F.coalesce("_lat", "latitude"), "longitude": F.coalesce("_lon", "longitude")}
    ).drop("_lat", "_lon")


def newest_rows(df: DataFrame, n: int = VIEW_ROWS, ties: list[str] | None = None) -> DataFrame:
    """Top n by time; planned as a per-task top-n and one merge of n rows each."""
    return df.orderBy(F.col("timestamp").desc(), *(ties or ["location"])).limit(n)


def batch_as_readings(rollup: DataFrame, raw: DataFrame, as_of: AsOf, days: int = 1, n: int = VIEW_ROWS) -> DataFrame:
    """Recent hourly rollup rows in the shape of readings, the newest n."""
    hours = lookback_days(rollup, as_of, days).filter(F.col("hour").isNotNull())
    rows = hours.select(
        time_from_parts(F.col("date"), F.col("hour")).alias("timestamp"), "location",
        F.lit(None).cast("double").alias("latitude"), F.lit(None).cast("double").alias("longitude"),
        round_to_int(F.col("avg_aqi")).alias("aqi_value"), round_to_int(F.col("avg_traffic")).alias("traffic_level"),
    )
    newest = few_rows(newest_rows(rows, n))
    # At most n locations are asked for: the scan of the raw history keeps only theirs.
    places = [r[0] for r in newest.select("location").distinct().collect() if r[0] is not None]
    out = with_coordinates(newest, raw.filter(F.col("location").isin(places)))
    return out.select(*READING_COLUMNS, F.coalesce("aqi_value", F.lit(0)).alias("aqi_clean"))


def serving_union(speed: DataFrame, batch: DataFrame, n: int = VIEW_ROWS) -> DataFrame:
    """G1: both layers, one row per (location, timestamp) with the speed row first, newest n."""
    both = speed.withColumn("source", F.lit("speed")).unionByName(batch.withColumn("source", F.lit("batch")))
    # 'speed' sorts after 'batch'; the remaining columns make the order total.
    rank = W.partitionBy("location", "timestamp").orderBy(F.col("source").desc(), "aqi_value", "traffic_level")
    once = both.withColumn("_rn", F.row_number().over(rank)).filter("_rn = 1").drop("_rn")
    return newest_rows(once, n)


def latest_readings(raw: DataFrame, n: int = VIEW_ROWS) -> DataFrame:
    """The newest n raw readings, those without coordinates then dropped, index made whole.

    Of a table stored by date only the newest dates are read.
    """
    newest = newest_rows(newest_dates(raw, n), n, ["id"]).dropna(subset=["latitude", "longitude"])
    return newest.select(
        "timestamp", "location",
        F.col("latitude").cast("double").alias("latitude"), F.col("longitude").cast("double").alias("longitude"),
        "aqi_value", "traffic_level", normalize_aqi(F.col("aqi_value")).alias("aqi_clean"),
    )


def raw_fallback(raw: DataFrame, n: int = VIEW_ROWS) -> DataFrame:
    """The newest n raw readings as they are; of a table stored by date only the newest dates are read."""
    newest = newest_rows(newest_dates(raw, n), n, ["id"])
    return newest.select(*READING_COLUMNS, F.coalesce("aqi_value", F.lit(0)).alias("aqi_clean"))


def combined_view(
    realtime: DataFrame, rollup: DataFrame, raw: DataFrame, as_of: AsOf,
    minutes: int = SPEED_MINUTES, enough: int = ENOUGH_SPEED_ROWS,
) -> DataFrame:
    """Enough speed rows: those alone; else speed and batch merged; both empty: raw rows.

    Which layers to read is settled by probes of at most ``enough`` rows behind time filters, so
    the raw table is only scanned when it is the answer.
    """
    speed = realtime_scan(realtime, as_of, minutes)
    found = speed.limit(enough).count()
    if found >= enough:
        view = speed.withColumn("source", F.lit("speed"))
    else:
        recent = lookback_days(rollup, as_of, 1).filter(F.col("hour").isNotNull())
        if found == 0 and recent.isEmpty():
            view = few_rows(raw_fallback(raw).withColumn("source", F.lit("raw")))
        else:
            view = few_rows(serving_union(speed, batch_as_readings(rollup, raw, as_of)))
    newest = view.agg(F.max("timestamp"))
    return view.withColumn("last_update", newest.scalar())


def latest_peak_hours(peaks: DataFrame) -> DataFrame:
    """The newest peak-hours row, missing values as 0."""
    newest = peaks.orderBy(F.col("analysis_date").desc()).limit(1)
    zero = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("peak_aqi_value", "peak_traffic_value")}
    return newest.withColumns(zero)


def data_freshness(df: DataFrame, as_of: AsOf, fresh_minutes: int = 60) -> DataFrame:
    """Newest time, its age in minutes, and the layer the age speaks for."""
    newest = df.agg(F.max("timestamp").alias("last_update"))
    age = minutes_between(moment(as_of), F.col("last_update"))
    label = F.when(age < fresh_minutes, "speed").otherwise("batch")
    return newest.select("last_update", age.alias("age_minutes"), label.alias("data_source"))


def current_peak_status(df: DataFrame) -> DataFrame:
    """Peak flag of the newest row."""
    newest = df.orderBy(F.col("timestamp").desc(), F.col("id").desc()).limit(1)
    return newest.select("timestamp", "is_peak_hour")
