"""The serving view, its parts, and dashboard frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from cityflux.operators import dashboard, serving
from cityflux.registry.base import AS_OF, dirty_readings, hourly, query, readings, realtime
from cityflux.plans.scratch import fresh_path
from cityflux.sources.tables import append_by_date, enrich_reading, read_table, realtime_scan
from cityflux import schemas
from cityflux.registry.scans import _AQI_CASES, _CLASS, _LEVEL_CASES, _rgba

_COORDS = """
, coords AS (
  SELECT location, latitude, longitude FROM (
    SELECT *, row_number() OVER (PARTITION BY location ORDER BY timestamp DESC, id DESC) AS rn FROM readings) WHERE rn = 1
)"""
_VIEW = "timestamp, location, latitude, longitude, aqi_value, traffic_level, aqi_clean"
_BATCH = _COORDS + """
, batch AS (
  SELECT b.timestamp, b.location, c.latitude, c.longitude, b.aqi_value, b.traffic_level, b.aqi_value AS aqi_clean
  FROM (SELECT CAST(date AS TIMESTAMP) + INTERVAL 1 HOUR * hour AS timestamp, location,
               CAST(round(avg_aqi) AS INT) AS aqi_value, CAST(round(avg_traffic) AS INT) AS traffic_level
        FROM hourly WHERE date >= DATE '2024-01-30' ORDER BY 1 DESC, location LIMIT 100) b
  LEFT JOIN coords c ON b.location = c.location
), speed AS (
  SELECT timestamp, location, latitude, longitude, aqi_value, traffic_level, coalesce(aqi_value, 0) AS aqi_clean
  FROM realtime WHERE is_active AND timestamp >= TIMESTAMP '2024-01-30 23:00:00'
), merged AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY location, timestamp ORDER BY source DESC, aqi_value, traffic_level) AS rn
    FROM (SELECT *, 'speed' AS source FROM speed UNION ALL SELECT *, 'batch' AS source FROM batch))
  WHERE rn = 1 ORDER BY timestamp DESC, location LIMIT 100
)"""


@query("latest_per_location", _COORDS + "SELECT location, latitude, longitude FROM coords")
def latest_per_location(spark, sf):
    return serving.latest_per_location(readings(spark, sf), ["latitude", "longitude"])


@query("enrich_coordinates", _COORDS + """
SELECT h.date::VARCHAR AS date, h.hour, h.location, h.avg_aqi, c.latitude, c.longitude
FROM hourly h LEFT JOIN coords c ON h.location = c.location
""")
def enrich_coordinates(spark, sf):
    none = F.lit(None).cast("double")
    rows = hourly(spark, sf).select("date", "hour", "location", "avg_aqi", none.alias("latitude"), none.alias("longitude"))
    return serving.with_coordinates(rows, readings(spark, sf)).select("date", "hour", "location", "avg_aqi", "latitude", "longitude")


@query("batch_as_readings", _BATCH + f"SELECT {_VIEW} FROM batch")
def batch_as_readings(spark, sf):
    return serving.batch_as_readings(hourly(spark, sf), readings(spark, sf), AS_OF)


@query("serving_union", _BATCH + f"SELECT {_VIEW}, source FROM merged")
def serving_union(spark, sf):
    speed = realtime_scan(realtime(spark, sf), AS_OF)
    return serving.serving_union(speed, serving.batch_as_readings(hourly(spark, sf), readings(spark, sf), AS_OF))


@query("combined_view", _BATCH + f"""
, n AS (SELECT count(*) AS speed_rows, (SELECT count(*) FROM batch) AS batch_rows FROM speed),
raw AS (
  SELECT timestamp, location, latitude, longitude, aqi_value, traffic_level, coalesce(aqi_value, 0) AS aqi_clean, 'raw' AS source
  FROM readings ORDER BY timestamp DESC, id LIMIT 100
), picked AS (
  SELECT speed.*, 'speed' AS source FROM speed, n WHERE speed_rows >= 10
  UNION ALL SELECT merged.* FROM merged, n WHERE speed_rows < 10 AND (speed_rows > 0 OR batch_rows > 0)
  UNION ALL SELECT raw.* FROM raw, n WHERE speed_rows = 0 AND batch_rows = 0
)
SELECT {_VIEW}, source, (SELECT max(timestamp) FROM picked) AS last_update FROM picked
""")
def combined_view(spark, sf):
    return serving.combined_view(realtime(spark, sf), hourly(spark, sf), readings(spark, sf), AS_OF)


@query("latest_readings", """
SELECT timestamp, location, latitude, longitude, aqi_value, traffic_level, coalesce(aqi_value, 0) AS aqi_clean
FROM (SELECT * FROM dirty_readings ORDER BY timestamp DESC, id LIMIT 100) WHERE latitude IS NOT NULL AND longitude IS NOT NULL
""")
def latest_readings(spark, sf):
    return serving.latest_readings(dirty_readings(spark, sf))


@query("latest_readings_stored", """
SELECT timestamp, location, latitude, longitude, aqi_value, traffic_level, coalesce(aqi_value, 0) AS aqi_clean
FROM (SELECT * FROM dirty_readings ORDER BY timestamp DESC, id LIMIT 100) WHERE latitude IS NOT NULL AND longitude IS NOT NULL
""")
def latest_readings_stored(spark, sf):
    """T1, T2 over a table stored by date: its newest dates answer."""
    path = fresh_path(spark, "raw")
    append_by_date(dirty_readings(spark, sf), path)
    return serving.latest_readings(read_table(spark, path))


@query("latest_peak_hours", """
SELECT max(date)::VARCHAR AS analysis_date, coalesce(NULL, 0.0::DOUBLE) AS peak_aqi_value,
       (SELECT max(avg_traffic) FROM hourly WHERE date = (SELECT max(date) FROM hourly)) AS peak_traffic_value
FROM hourly
""")
def latest_peak_hours(spark, sf):
    peaks = hourly(spark, sf).groupBy(F.col("date").alias("analysis_date")).agg(
        F.lit(None).cast("double").alias("peak_aqi_value"), F.max("avg_traffic").alias("peak_traffic_value")
    )
    return serving.latest_peak_hours(peaks)


@query("data_freshness", """
SELECT max(timestamp) AS last_update,
       round((epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(max(timestamp))) / 60000000.0::DOUBLE, 6) AS age_minutes,
       CASE WHEN (epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(max(timestamp))) / 60000000.0::DOUBLE < 60 THEN 'speed' ELSE 'batch' END AS data_source
FROM readings
""", places=6)
def data_freshness(spark, sf):
    return serving.data_freshness(readings(spark, sf), AS_OF)


@query("current_peak_status", """
SELECT timestamp, hour(timestamp) BETWEEN 6 AND 9 OR hour(timestamp) BETWEEN 16 AND 19 AS is_peak_hour
FROM readings ORDER BY timestamp DESC, id DESC LIMIT 1
""")
def current_peak_status(spark, sf):
    return serving.current_peak_status(enrich_reading(readings(spark, sf)))


@query("map_points", f"""
SELECT id, 'aqi' AS kind, location, latitude, longitude, aqi_value AS value, coalesce(CAST(aqi_value AS VARCHAR), '') AS label,
       {_rgba('', 'aqi_value', _AQI_CASES)}, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS formatted_time FROM dirty_readings
UNION ALL
SELECT id, 'traffic' AS kind, location, latitude, longitude, traffic_level AS value, coalesce(CAST(traffic_level AS VARCHAR), '') AS label,
       {_rgba('', 'traffic_level', _LEVEL_CASES)}, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS formatted_time FROM dirty_readings
""")
def map_points(spark, sf):
    return dashboard.map_points(dirty_readings(spark, sf), keep=["id"])


_DASH = f"""
, n AS (SELECT count(*) AS speed_rows FROM speed),
picked AS (
  SELECT speed.* FROM speed, n WHERE speed_rows >= 10
  UNION ALL SELECT merged.* EXCLUDE (source) FROM merged, n WHERE speed_rows < 10
), frame AS (
  SELECT timestamp, location, latitude, longitude, CAST(aqi_value AS DOUBLE) AS aqi_value, CAST(traffic_level AS DOUBLE) AS traffic_level,
         CAST(aqi_value AS DOUBLE) AS aqi_clean, timestamp + INTERVAL 7 HOUR AS timestamp_wib,
         strftime(timestamp + INTERVAL 7 HOUR, '%Y-%m-%d %H:%M:%S') || ' WIB' AS formatted_time,
         coalesce({_CLASS}, 'Unknown') AS aqi_category, FALSE AS is_peak_hour, 'No' AS is_peak_hour_display
  FROM picked WHERE latitude IS NOT NULL AND longitude IS NOT NULL
)"""


def _frame(spark, sf):
    view = serving.combined_view(realtime(spark, sf), hourly(spark, sf), readings(spark, sf), AS_OF)
    return dashboard.dashboard_frame(view.drop("source", "last_update"))


@query("dashboard_frame", _BATCH + _DASH + "SELECT * FROM frame")
def dashboard_frame(spark, sf):
    return _frame(spark, sf)


_SHOWN = ", ".join(f'{c} AS "{n}"' for c, n in schemas.DISPLAY_COLUMNS.items())


@query("display_projection", f"""
, frame AS (SELECT *, timestamp + INTERVAL 7 HOUR AS timestamp_wib, {_CLASS} AS aqi_category,
  CASE WHEN hour(timestamp) BETWEEN 6 AND 9 OR hour(timestamp) BETWEEN 16 AND 19 THEN 'Yes' ELSE 'No' END AS is_peak_hour_display
  FROM readings)
SELECT {_SHOWN} FROM frame
""")
def display_projection(spark, sf):
    return dashboard.display_projection(dashboard.dashboard_frame(enrich_reading(readings(spark, sf)).drop("aqi_category")).withColumns(
        {"aqi_value": F.col("aqi_value").cast("int"), "traffic_level": F.col("traffic_level").cast("int")}
    ))


@query("display_top", f"""
, frame AS (SELECT *, timestamp + INTERVAL 7 HOUR AS timestamp_wib, {_CLASS} AS aqi_category,
  CASE WHEN hour(timestamp) BETWEEN 6 AND 9 OR hour(timestamp) BETWEEN 16 AND 19 THEN 'Yes' ELSE 'No' END AS is_peak_hour_display
  FROM readings)
SELECT {_SHOWN} FROM frame ORDER BY timestamp DESC, location LIMIT 100
""")
def display_top(spark, sf):
    """The first hundred rows of the display table."""
    return dashboard.first_rows(display_projection(spark, sf))
