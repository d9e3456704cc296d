"""Scans, payloads, messages, exports and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from cityflux import schemas
from cityflux.functions import categories, numbers, times
from cityflux.plans.scratch import fresh_path
from cityflux.registry.base import (
    AS_OF, analysis_table, dirty_readings, events, payloads, query, readings, realtime, with_station,
)
from cityflux.sources import exports, messages, payloads as payload_ops, tables

_READING = "id, timestamp, location, latitude, longitude, aqi_value, traffic_level"


@query("scan_range", f"""
SELECT {_READING} FROM readings
WHERE timestamp >= TIMESTAMP '2024-01-10 06:00:00' AND timestamp <= TIMESTAMP '2024-01-20 18:00:00'
""")
def scan_range(spark, sf):
    return tables.scan_range(readings(spark, sf), "2024-01-10 06:00:00", "2024-01-20 18:00:00")


@query("realtime_scan", """
SELECT timestamp, location, latitude, longitude, aqi_value, traffic_level, coalesce(aqi_value, 0) AS aqi_clean
FROM realtime WHERE is_active AND timestamp >= TIMESTAMP '2024-01-24 00:00:00'
""")
def realtime_scan(spark, sf):
    return tables.realtime_scan(realtime(spark, sf), AS_OF, minutes=7 * 24 * 60)


@query("lookback_days", """
SELECT date::VARCHAR AS date, hour, location, avg_traffic_level, avg_aqi_value, is_peak_hour, total_records
FROM analysis WHERE date >= DATE '2024-01-24'
""")
def lookback_days(spark, sf):
    return tables.lookback_days(analysis_table(spark, sf), AS_OF, 7)


@query("one_day", f"SELECT {_READING} FROM readings WHERE CAST(timestamp AS DATE) = DATE '2024-01-15'")
def one_day(spark, sf):
    return tables.on_date(readings(spark, sf), "2024-01-15")


_INGEST_LABEL = """CASE WHEN aqi_value IS NULL OR aqi_value = 0 THEN 'Unknown'
  WHEN aqi_value <= 50 THEN 'Good' WHEN aqi_value <= 100 THEN 'Moderate'
  WHEN aqi_value <= 150 THEN 'Unhealthy for Sensitive Groups' WHEN aqi_value <= 200 THEN 'Unhealthy'
  WHEN aqi_value <= 300 THEN 'Very Unhealthy' ELSE 'Hazardous' END"""
_CLASS = """CASE WHEN aqi_value IS NULL THEN NULL
  WHEN aqi_value <= 50 THEN 'Good' WHEN aqi_value <= 100 THEN 'Moderate'
  WHEN aqi_value <= 150 THEN 'Unhealthy for Sensitive Groups' WHEN aqi_value <= 200 THEN 'Unhealthy'
  WHEN aqi_value <= 300 THEN 'Very Unhealthy' ELSE 'Hazardous' END"""
_PEAK_TS = "(hour(timestamp) BETWEEN 6 AND 9 OR hour(timestamp) BETWEEN 16 AND 19)"


@query("raw_enriched", f"""
SELECT {_READING}, {_INGEST_LABEL} AS aqi_category, {_PEAK_TS} AS is_peak_hour, FALSE AS is_processed
FROM readings
""")
def raw_enriched(spark, sf):
    return tables.to_raw_data(readings(spark, sf))


@query("raw_table_append", f"""
SELECT {_READING}, {_INGEST_LABEL} AS aqi_category, {_PEAK_TS} AS is_peak_hour, FALSE AS is_processed,
       CAST(timestamp AS DATE)::VARCHAR AS date
FROM readings
""")
def raw_table_append(spark, sf):
    path = fresh_path(spark, "raw-data")
    tables.append_by_date(tables.to_raw_data(readings(spark, sf)), path)
    return spark.read.parquet(path).withColumn("date", F.col("date").cast("date"))


@query("processed_table", f"SELECT {_READING} FROM readings")
def processed_table(spark, sf):
    path = fresh_path(spark, "processed")
    tables.replace_table(dirty_readings(spark, sf), path)
    tables.replace_table(readings(spark, sf), path)
    return spark.read.parquet(path)


@query("export_csv", f"SELECT {_READING} FROM readings")
def export_csv(spark, sf):
    path = fresh_path(spark, "csv")
    r = readings(spark, sf)
    exports.write_csv(r, path)
    return exports.read_csv(spark, path, r.schema)


@query("export_json", f"SELECT {_READING} FROM readings")
def export_json(spark, sf):
    path = fresh_path(spark, "json")
    r = readings(spark, sf)
    exports.write_json(r, path)
    return exports.read_json(spark, path, r.schema)


@query("json_encode", """
SELECT location AS key, strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp, location,
       latitude, longitude, aqi_value, traffic_level
FROM readings
""")
def json_encode(spark, sf):
    sent = messages.encode(readings(spark, sf))
    body = sent.select("key", F.from_json("value", schemas.MESSAGE).alias("m"))
    return body.select("key", "m.*")


@query("parse_payloads", """
SELECT id, timestamp, location,
       CASE WHEN json_extract_string(aqi_json, '$.status') = 'ok'
            THEN TRY_CAST(json_extract_string(aqi_json, '$.data.aqi') AS INT) END AS aqi_value,
       CASE WHEN ff IS NULL OR ff <= 0 THEN 1
            WHEN (ff - cur) / ff < 0.1::DOUBLE THEN 1 WHEN (ff - cur) / ff < 0.3::DOUBLE THEN 2
            WHEN (ff - cur) / ff < 0.5::DOUBLE THEN 3 WHEN (ff - cur) / ff < 0.7::DOUBLE THEN 4 ELSE 5 END AS traffic_level
FROM (SELECT *, CAST(json_extract_string(traffic_json, '$.flowSegmentData.freeFlowSpeed') AS DOUBLE) AS ff,
             CAST(json_extract_string(traffic_json, '$.flowSegmentData.currentSpeed') AS DOUBLE) AS cur FROM payloads)
""")
def parse_payloads(spark, sf):
    return payload_ops.parse_payloads(payloads(spark, sf))


@query("ingest_results", """
SELECT id, location, aqi_value, traffic_level, aqi_value IS NOT NULL AS success,
       CASE WHEN aqi_value IS NULL THEN 'AQI value is None' END AS error_message
FROM (SELECT id, location,
       CASE WHEN json_extract_string(aqi_json, '$.status') = 'ok'
            THEN TRY_CAST(json_extract_string(aqi_json, '$.data.aqi') AS INT) END AS aqi_value,
       CASE WHEN ff IS NULL OR ff <= 0 THEN 1
            WHEN (ff - cur) / ff < 0.1::DOUBLE THEN 1 WHEN (ff - cur) / ff < 0.3::DOUBLE THEN 2
            WHEN (ff - cur) / ff < 0.5::DOUBLE THEN 3 WHEN (ff - cur) / ff < 0.7::DOUBLE THEN 4 ELSE 5 END AS traffic_level
      FROM (SELECT *, CAST(json_extract_string(traffic_json, '$.flowSegmentData.freeFlowSpeed') AS DOUBLE) AS ff,
             CAST(json_extract_string(traffic_json, '$.flowSegmentData.currentSpeed') AS DOUBLE) AS cur FROM payloads))
""")
def ingest_results(spark, sf):
    return payload_ops.ingest_results(payloads(spark, sf))


@query("stations", """
SELECT s.id_station, s.location, CAST(s.latitude AS DOUBLE) AS latitude, CAST(s.longitude AS DOUBLE) AS longitude,
       count(e.event_id) AS readings
FROM stations s LEFT JOIN events e ON s.idx = e.user_id % 10 GROUP BY 1, 2, 3, 4
""")
def station_coverage(spark, sf):
    """S15 with the number of readings each station has."""
    counts = events(spark, sf).groupBy((F.col("user_id") % 10).alias("idx")).agg(F.count("event_id").alias("readings"))
    joined = schemas.stations(spark).join(counts, "idx", "left")
    return joined.select("id_station", "location", "latitude", "longitude", F.coalesce("readings", F.lit(0)).alias("readings"))


# --- scalar functions -----------------------------------------------------------------------


@query("aqi_category", f"SELECT id, aqi_value, {_CLASS} AS aqi_category FROM dirty_readings")
def aqi_category(spark, sf):
    return dirty_readings(spark, sf).select("id", "aqi_value", categories.aqi_category(F.col("aqi_value")).alias("aqi_category"))


@query("aqi_category_ingest", f"SELECT id, aqi_value, {_INGEST_LABEL} AS aqi_category FROM dirty_readings")
def aqi_category_ingest(spark, sf):
    label = categories.aqi_category_ingest(F.col("aqi_value"))
    return dirty_readings(spark, sf).select("id", "aqi_value", label.alias("aqi_category"))


@query("aqi_bins", """
SELECT id, aqi_value, CASE WHEN aqi_value > 0 AND aqi_value <= 50 THEN 'Good'
  WHEN aqi_value > 50 AND aqi_value <= 100 THEN 'Moderate'
  WHEN aqi_value > 100 AND aqi_value <= 150 THEN 'Unhealthy_Sensitive'
  WHEN aqi_value > 150 AND aqi_value <= 200 THEN 'Unhealthy'
  WHEN aqi_value > 200 AND aqi_value <= 300 THEN 'Very_Unhealthy'
  WHEN aqi_value > 300 AND aqi_value <= 500 THEN 'Hazardous' END AS aqi_bin
FROM dirty_readings
""")
def aqi_bins(spark, sf):
    return dirty_readings(spark, sf).select("id", "aqi_value", categories.aqi_bin(F.col("aqi_value")).alias("aqi_bin"))


@query("traffic_level", """
SELECT id, CASE WHEN ff <= 0 THEN 1
            WHEN (ff - cur) / ff < 0.1::DOUBLE THEN 1 WHEN (ff - cur) / ff < 0.3::DOUBLE THEN 2
            WHEN (ff - cur) / ff < 0.5::DOUBLE THEN 3 WHEN (ff - cur) / ff < 0.7::DOUBLE THEN 4 ELSE 5 END AS level
FROM (SELECT event_id AS id, CAST(100 - k AS DOUBLE) AS cur,
             CASE WHEN event_id % 43 = 0 THEN 0.0::DOUBLE ELSE 100.0::DOUBLE END AS ff FROM joined)
""")
def traffic_level(spark, sf):
    free = F.when(F.col("event_id") % 43 == 0, 0.0).otherwise(100.0)
    level = numbers.traffic_level(free, (F.lit(100) - F.col("k")).cast("double"))
    return with_station(spark, sf).select(F.col("event_id").alias("id"), level.alias("level"))


_TEXT = """CASE WHEN event_id % 5 = 0 THEN '-' WHEN event_id % 7 = 0 THEN '12.5' WHEN event_id % 11 = 0 THEN NULL
  ELSE CAST(CAST(floor(value) AS INT) AS {}) END"""


@query("normalize_aqi", f"""
SELECT event_id AS id, CASE WHEN regexp_full_match(t, '[0-9]+') THEN CAST(t AS INT) ELSE 0 END AS aqi_clean
FROM (SELECT event_id, {_TEXT.format('VARCHAR')} AS t FROM joined)
""")
def normalize_aqi(spark, sf):
    text = F.expr(_TEXT.format("STRING"))
    return with_station(spark, sf).select(F.col("event_id").alias("id"), numbers.normalize_aqi(text).alias("aqi_clean"))


@query("coerce_numeric", f"""
SELECT event_id AS id, TRY_CAST(t AS DOUBLE) AS number FROM (SELECT event_id, {_TEXT.format('VARCHAR')} AS t FROM joined)
""")
def coerce_numeric(spark, sf):
    text = F.expr(_TEXT.format("STRING"))
    return with_station(spark, sf).select(F.col("event_id").alias("id"), numbers.to_number(text).alias("number"))


@query("is_peak_hour", f"""
SELECT id, {_PEAK_TS} AS is_peak, hour(timestamp + INTERVAL 7 HOUR) BETWEEN 6 AND 9
  OR hour(timestamp + INTERVAL 7 HOUR) BETWEEN 16 AND 19 AS is_peak_local
FROM readings
""")
def is_peak_hour(spark, sf):
    ts = F.col("timestamp")
    return readings(spark, sf).select("id", times.is_peak_hour(ts).alias("is_peak"), times.is_peak_hour(ts, 7).alias("is_peak_local"))


@query("time_of_day", """
SELECT id, CASE WHEN hour(timestamp) <= 6 THEN 'night' WHEN hour(timestamp) <= 12 THEN 'morning'
                WHEN hour(timestamp) <= 18 THEN 'afternoon' ELSE 'evening' END AS time_of_day
FROM readings
""")
def time_of_day(spark, sf):
    return readings(spark, sf).select("id", times.time_of_day(F.hour("timestamp")).alias("time_of_day"))


@query("temporal_features", """
SELECT id, hour(timestamp) AS hour, isodow(timestamp) - 1 AS day_of_week, month(timestamp) AS month,
       day(timestamp) AS day_of_month, CASE WHEN isodow(timestamp) >= 6 THEN 1 ELSE 0 END AS is_weekend,
       CASE WHEN hour(timestamp) BETWEEN 7 AND 9 OR hour(timestamp) BETWEEN 17 AND 19 THEN 1 ELSE 0 END AS is_rush_hour
FROM readings
""")
def temporal_features(spark, sf):
    parts = times.calendar_parts(F.col("timestamp"))
    cols = [c.alias(n) for n, c in parts.items()]
    return readings(spark, sf).select("id", *cols, times.is_rush_hour(F.hour("timestamp")).alias("is_rush_hour"))


@query("to_local_time", "SELECT id, timestamp + INTERVAL 7 HOUR AS local_time FROM readings")
def to_local_time(spark, sf):
    return readings(spark, sf).select("id", times.to_local(F.col("timestamp")).alias("local_time"))


@query("format_local_time", """
SELECT id, coalesce(strftime(t + INTERVAL 7 HOUR, '%Y-%m-%d %H:%M:%S') || ' WIB', 'N/A') AS local_text,
       coalesce(strftime(t, '%Y-%m-%d %H:%M:%S'), 'N/A') AS plain_text
FROM (SELECT id, CASE WHEN id % 9 = 0 THEN NULL ELSE timestamp END AS t FROM readings)
""")
def format_local_time(spark, sf):
    t = F.when(F.col("id") % 9 != 0, F.col("timestamp"))
    return readings(spark, sf).select("id", times.format_local_time(t).alias("local_text"), times.format_time(t).alias("plain_text"))


@query("parse_iso", """
SELECT id, CASE WHEN id % 6 = 0 THEN TIMESTAMP '2024-01-31 00:00:00' ELSE date_trunc('second', timestamp) END AS parsed FROM readings
""")
def parse_iso(spark, sf):
    iso = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(F.col("id") % 6 == 0, "bad").when(F.col("id") % 2 == 0, F.concat(iso, F.lit("Z"))).otherwise(iso)
    parsed = times.parse_iso(text, times.moment(AS_OF).cast("timestamp"))
    return readings(spark, sf).select("id", parsed.alias("parsed"))


@query("time_from_parts", """
SELECT date::VARCHAR AS date, hour, location,
       CAST(date AS TIMESTAMP) + INTERVAL 1 HOUR * coalesce(CASE WHEN hour % 5 = 0 THEN NULL ELSE hour END, 12) AS timestamp,
       CAST(round(avg_aqi) AS INT) AS aqi_rounded
FROM hourly
""")
def time_from_parts(spark, sf):
    from cityflux.registry.base import hourly

    hour = F.when(F.col("hour") % 5 != 0, F.col("hour"))
    return hourly(spark, sf).select(
        "date", "hour", "location", times.time_from_parts(F.col("date"), hour).alias("timestamp"),
        numbers.round_to_int(F.col("avg_aqi")).alias("aqi_rounded"),
    )


@query("previous_hour", """
SELECT id, date_trunc('hour', timestamp) - INTERVAL 1 HOUR AS previous_hour FROM readings
""")
def previous_hour(spark, sf):
    return readings(spark, sf).select("id", times.previous_hour(F.col("timestamp")).alias("previous_hour"))


def _rgba(prefix: str, col: str, cases: list[tuple[str, tuple]]) -> str:
    parts = []
    for i, ch in enumerate("rgba"):
        whens = " ".join(f"WHEN {cond} THEN {rgba[i]}" for cond, rgba in cases)
        parts.append(f"CASE {whens} ELSE {schemas.UNKNOWN_COLOR[i]} END AS {prefix}{ch}")
    return ", ".join(parts)


_AQI_CASES = [(f"aqi_value <= {b}" if b else "aqi_value > 300", rgba) for b, _, rgba, _ in schemas.AQI_CLASSES]
_LEVEL_CASES = [(f"traffic_level = {lv}", rgba) for lv, rgba in schemas.TRAFFIC_COLORS.items()]
_HEX = " ".join(f"WHEN aqi_value <= {b} THEN '{h}'" for b, _, _, h in schemas.AQI_CLASSES if b)


@query("aqi_color", f"""
SELECT id, {_rgba('', 'aqi_value', _AQI_CASES)},
       CASE WHEN aqi_value IS NULL THEN NULL {_HEX} ELSE '#7B1FA2' END AS hex
FROM dirty_readings
""")
def aqi_color(spark, sf):
    v = F.col("aqi_value")
    color = categories.aqi_color(v)
    return dirty_readings(spark, sf).select("id", *[color[i].alias(ch) for i, ch in enumerate("rgba")], categories.aqi_hex(v).alias("hex"))


@query("traffic_color", f"SELECT id, {_rgba('', 'traffic_level', _LEVEL_CASES)} FROM dirty_readings")
def traffic_color(spark, sf):
    color = categories.traffic_color(F.col("traffic_level"))
    return dirty_readings(spark, sf).select("id", *[color[i].alias(ch) for i, ch in enumerate("rgba")])
