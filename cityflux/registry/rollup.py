"""Rollups, peaks, upserts."""

from __future__ import annotations

from pyspark.sql import functions as F

from cityflux.operators import rollups, upserts
from cityflux.plans.scratch import fresh_path
from cityflux.registry.base import AS_OF, analysis_table, hourly, query, readings, realtime
from cityflux.runs import batch

_HOURLY = """date::VARCHAR AS date, hour, location, avg_aqi, avg_traffic, max_aqi, max_traffic, min_aqi, min_traffic,
       data_points_count, is_peak_hour"""


@query("daily_aggregation", """
SELECT CAST(timestamp AS DATE)::VARCHAR AS date, CAST(NULL AS BIGINT) AS hour, location, avg(aqi_value) AS avg_aqi,
       avg(traffic_level) AS avg_traffic, max(aqi_value) AS max_aqi, max(traffic_level) AS max_traffic,
       min(aqi_value) AS min_aqi, min(traffic_level) AS min_traffic, count(*) AS data_points_count, FALSE AS is_peak_hour
FROM readings GROUP BY 1, 3
""")
def daily_aggregation(spark, sf):
    return rollups.daily_aggregation(readings(spark, sf))


@query("hourly_aggregation", f"SELECT {_HOURLY} FROM hourly")
def hourly_aggregation(spark, sf):
    return hourly(spark, sf)


@query("recent_aggregates", """
SELECT location, coalesce(avg(aqi_value), 0) AS avg_aqi, coalesce(avg(traffic_level), 0) AS avg_traffic,
       max(aqi_value) AS max_aqi, max(traffic_level) AS max_traffic, count(*) AS data_points
FROM realtime WHERE is_active AND timestamp >= TIMESTAMP '2024-01-30 00:00:00' GROUP BY location
""")
def recent_aggregates(spark, sf):
    return rollups.recent_aggregates(realtime(spark, sf), AS_OF, minutes=24 * 60)


@query("peak_hours_panel", """
SELECT hour, round(avg(avg_traffic_level), 6) AS avg_traffic, round(avg(avg_aqi_value), 6) AS avg_aqi,
       max(CASE WHEN is_peak_hour THEN 1 ELSE 0 END) = 1 AS is_peak, CAST(sum(total_records) AS BIGINT) AS total_records,
       round(round(avg(avg_aqi_value), 8) / 50, 6) AS avg_aqi_scaled
FROM analysis WHERE date >= DATE '2024-01-01' GROUP BY hour
""", places=6)
def peak_hours_panel(spark, sf):
    return rollups.panel_overlay(rollups.peak_hours_panel(analysis_table(spark, sf), AS_OF, days=30))


@query("peak_hours", """
, per_hour AS (
  SELECT date, hour, avg(avg_aqi) AS aqi, avg(avg_traffic) AS traffic FROM hourly GROUP BY 1, 2
), best AS (
  SELECT date, hour, aqi, traffic,
         row_number() OVER (PARTITION BY date ORDER BY round(aqi, 9) DESC, hour) AS ra,
         row_number() OVER (PARTITION BY date ORDER BY round(traffic, 9) DESC, hour) AS rt
  FROM per_hour
), top AS (
  SELECT date, hour, location,
         row_number() OVER (PARTITION BY date, hour ORDER BY avg_aqi DESC, location) AS ra,
         row_number() OVER (PARTITION BY date, hour ORDER BY avg_traffic DESC, location) AS rt
  FROM hourly
)
SELECT a.date::VARCHAR AS analysis_date, a.hour AS peak_aqi_hour, round(a.aqi, 6) AS peak_aqi_value, ta.location AS peak_aqi_location,
       t.hour AS peak_traffic_hour, round(t.traffic, 6) AS peak_traffic_value, tt.location AS peak_traffic_location
FROM best a JOIN best t ON a.date = t.date AND a.ra = 1 AND t.rt = 1
JOIN top ta ON ta.date = a.date AND ta.hour = a.hour AND ta.ra = 1
JOIN top tt ON tt.date = t.date AND tt.hour = t.hour AND tt.rt = 1
""", places=6)
def peak_hours(spark, sf):
    return rollups.peak_hours(hourly(spark, sf))


@query("peak_hours_local", """
, h AS (
  SELECT hour(timestamp + INTERVAL 7 HOUR) AS hour, round(avg(aqi_value), 2) AS avg_aqi, round(avg(traffic_level), 2) AS avg_traffic
  FROM readings GROUP BY 1
)
SELECT hour, avg_aqi, avg_traffic,
       row_number() OVER (ORDER BY avg_aqi DESC, hour) = 1 AS is_peak_aqi,
       row_number() OVER (ORDER BY avg_traffic DESC, hour) = 1 AS is_peak_traffic
FROM h
""")
def peak_hours_local(spark, sf):
    return rollups.peak_hours_local(readings(spark, sf))


@query("kpi_summary", """
SELECT avg(traffic_level) AS avg_traffic, max(traffic_level) AS max_traffic, avg(aqi_value) AS avg_aqi, max(aqi_value) AS max_aqi,
       count(*) FILTER (WHERE hour(timestamp) BETWEEN 6 AND 9 OR hour(timestamp) BETWEEN 16 AND 19) AS peak_records,
       count(*) AS total_records
FROM readings
""")
def kpi_summary(spark, sf):
    return rollups.kpi_summary(readings(spark, sf))


@query("daily_summary", """
SELECT CAST(timestamp AS DATE)::VARCHAR AS date, avg(aqi_value) AS avg_aqi_city, max(traffic_level) AS max_traffic_level
FROM readings GROUP BY 1
""")
def daily_summary(spark, sf):
    return rollups.daily_summary(readings(spark, sf))




_UPSERT = """
, early AS (SELECT * FROM readings WHERE timestamp < TIMESTAMP '2024-01-20 12:00:00'),
late AS (SELECT * FROM readings WHERE timestamp >= TIMESTAMP '2024-01-11 00:00:00'),
old AS (
  SELECT CAST(timestamp AS DATE) AS date, CAST(NULL AS BIGINT) AS hour, location, count(*) AS n, sum(aqi_value) AS s FROM early GROUP BY 1, 3
  UNION ALL SELECT CAST(timestamp AS DATE), hour(timestamp), location, count(*), sum(aqi_value) FROM early GROUP BY 1, 2, 3
), new AS (
  SELECT CAST(timestamp AS DATE) AS date, CAST(NULL AS BIGINT) AS hour, location, count(*) AS n, sum(aqi_value) AS s FROM late GROUP BY 1, 3
  UNION ALL SELECT CAST(timestamp AS DATE), hour(timestamp), location, count(*), sum(aqi_value) FROM late GROUP BY 1, 2, 3
), merged AS (
  SELECT * FROM new UNION ALL
  SELECT * FROM old o WHERE NOT EXISTS (
    SELECT 1 FROM new n WHERE n.date = o.date AND n.hour IS NOT DISTINCT FROM o.hour AND n.location = o.location)
)
SELECT date::VARCHAR AS date, hour, location, n AS data_points_count, CAST(s AS DOUBLE) / n AS avg_aqi FROM merged
"""


def _rollup_rows(df):
    state = rollups.hourly_state(df)
    both = rollups.finish(state).unionByName(rollups.daily_from_hourly(state))
    return both.select("date", "hour", "location", "data_points_count", "avg_aqi")


def _early_late(spark, sf):
    r = readings(spark, sf)
    early = r.filter(F.col("timestamp") < F.lit("2024-01-20 12:00:00").cast("timestamp_ntz"))
    late = r.filter(F.col("timestamp") >= F.lit("2024-01-11 00:00:00").cast("timestamp_ntz"))
    return _rollup_rows(early), _rollup_rows(late)


@query("upsert_aggregates", _UPSERT)
def upsert_aggregates(spark, sf):
    old, new = _early_late(spark, sf)
    return upserts.upsert(old, new)


@query("upsert_table", _UPSERT)
def upsert_table(spark, sf):
    """The same through a stored table, and again to show that a rerun changes nothing."""
    old, new = _early_late(spark, sf)
    path = fresh_path(spark, "aggregates")
    upserts.write_partitions(old, path)
    upserts.upsert_table(path, new)
    upserts.upsert_table(path, new)
    return spark.read.parquet(path).withColumn("date", F.col("date").cast("date")).select(*old.columns)


@query("upsert_peak_hours", """
, base AS (SELECT date, max(avg_aqi) AS v FROM hourly WHERE date <= DATE '2024-01-20' GROUP BY 1),
fresh AS (SELECT date, min(avg_aqi) AS v FROM hourly WHERE date >= DATE '2024-01-15' GROUP BY 1)
SELECT coalesce(f.date, b.date)::VARCHAR AS analysis_date, CASE WHEN f.date IS NOT NULL THEN f.v ELSE b.v END AS peak_aqi_value
FROM base b FULL JOIN fresh f ON b.date = f.date
""")
def upsert_peak_hours(spark, sf):
    h = hourly(spark, sf)
    base = h.filter("date <= date'2024-01-20'").groupBy("date").agg(F.max("avg_aqi").alias("peak_aqi_value"))
    fresh = h.filter("date >= date'2024-01-15'").groupBy("date").agg(F.min("avg_aqi").alias("peak_aqi_value"))
    name = {"date": "analysis_date"}
    return upserts.upsert(base.withColumnsRenamed(name), fresh.withColumnsRenamed(name), ["analysis_date"])


@query("expire_realtime", """
SELECT id, timestamp, location, CASE WHEN is_active AND timestamp < TIMESTAMP '2024-01-20 11:00:00' THEN FALSE ELSE is_active END AS is_active
FROM realtime
""")
def expire_realtime(spark, sf):
    return upserts.expire(realtime(spark, sf), "2024-01-20 12:00:00").select("id", "timestamp", "location", "is_active")


@query("incremental_hourly", """
SELECT date::VARCHAR AS date, hour, location, avg_traffic_level, avg_aqi_value, is_peak_hour, total_records FROM analysis
""")
def incremental_hourly(spark, sf):
    """Two disjoint halves of the readings, each rolled up alone, merged by their states."""
    r = readings(spark, sf)
    odd = F.col("id") % 2 == 1
    parts = rollups.hourly_state(r.filter(odd)).unionByName(rollups.hourly_state(r.filter(~odd)))
    return rollups.hourly_analysis(rollups.merge_states(parts))


@query("batch_jobs", f"""
SELECT {_HOURLY} FROM hourly WHERE date = DATE '2024-01-16' AND hour = 4
UNION ALL
SELECT CAST(timestamp AS DATE)::VARCHAR, NULL, location, avg(aqi_value), avg(traffic_level), max(aqi_value), max(traffic_level),
       min(aqi_value), min(traffic_level), count(*), FALSE
FROM readings WHERE CAST(timestamp AS DATE) = DATE '2024-01-15' GROUP BY 1, 3
""")
def batch_jobs(spark, sf):
    """The hourly and the daily job at one reference time, run twice over."""
    table, r = fresh_path(spark, "rollup"), readings(spark, sf)
    for _ in range(2):
        batch.hourly_job(r, table, "2024-01-16 05:05:00")
        batch.daily_job(r, table, "2024-01-16 05:05:00")
    return batch.stored_rollup(spark, table)


@query("backfill", f"""
SELECT {_HOURLY} FROM hourly
UNION ALL
SELECT CAST(timestamp AS DATE)::VARCHAR, NULL, location, avg(aqi_value), avg(traffic_level), max(aqi_value), max(traffic_level),
       min(aqi_value), min(traffic_level), count(*), FALSE
FROM readings GROUP BY 1, 3
""")
def backfill(spark, sf):
    """A1, A2, U4: the whole history into an empty table."""
    table = fresh_path(spark, "rollup")
    batch.backfill(readings(spark, sf), table)
    return batch.stored_rollup(spark, table)


@query("peak_job", """
, d AS (SELECT * FROM hourly WHERE date IN (DATE '2024-01-15', DATE '2024-01-16')),
per_hour AS (SELECT date, hour, avg(avg_aqi) AS aqi, avg(avg_traffic) AS traffic FROM d GROUP BY 1, 2),
a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY round(aqi, 9) DESC, hour) AS rn FROM per_hour) WHERE rn = 1),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY round(traffic, 9) DESC, hour) AS rn FROM per_hour) WHERE rn = 1)
SELECT a.date::VARCHAR AS analysis_date, a.hour AS peak_aqi_hour, round(a.aqi, 6) AS peak_aqi_value,
  (SELECT location FROM d WHERE d.date = a.date AND d.hour = a.hour ORDER BY avg_aqi DESC, location LIMIT 1) AS peak_aqi_location,
  t.hour AS peak_traffic_hour, round(t.traffic, 6) AS peak_traffic_value,
  (SELECT location FROM d WHERE d.date = t.date AND d.hour = t.hour ORDER BY avg_traffic DESC, location LIMIT 1) AS peak_traffic_location
FROM a JOIN t ON a.date = t.date
""", places=6)
def peak_job(spark, sf):
    """Peak hours of two days from the stored table, the second day twice."""
    table, peaks = fresh_path(spark, "rollup"), fresh_path(spark, "peaks")
    batch.backfill(readings(spark, sf), table)
    for as_of in ("2024-01-16 03:00:00", "2024-01-17 03:00:00", "2024-01-17 03:00:00"):
        batch.peak_job(spark, table, peaks, as_of)
    return batch.stored_peaks(spark, peaks)
