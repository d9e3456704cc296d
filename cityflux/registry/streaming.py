"""Streams over messages made from the readings; each must equal its batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from cityflux.operators import rollups
from cityflux.plans.scratch import fresh_path
from cityflux.registry.base import query, readings
from cityflux.registry.scans import _INGEST_LABEL, _PEAK_TS
from cityflux.sources import messages
from cityflux.streaming import jobs, sinks, windows

_BODY = "timestamp, location, latitude, longitude, aqi_value, traffic_level"
# Longer than the data spans, so that no row counts as late.
_WHOLE = "40 days"


def _sent(spark, sf, twice=False, broken=False):
    """A folder of message files: all readings; a second time over; or with broken lines beside."""
    path = fresh_path(spark, "messages")
    rows = messages.encode(readings(spark, sf))
    files = max(4, -(-readings(spark, sf).count() // 50_000))
    if broken:
        bad = readings(spark, sf).filter(F.col("id") % 20 == 0)
        rows = rows.unionByName(bad.select("location", F.concat(F.lit('{"timestamp": oops '), F.col("id").cast("string")).alias("value")).withColumnRenamed("location", "key"))
    messages.write_files(rows, path, files)
    if twice:
        messages.write_files(rows, path, files // 2)
    return path


def _stream(spark, path):
    return messages.good(messages.decode(messages.file_source(spark, path, files_per_trigger=2)))


def _run(spark, stream, mode="append"):
    """Drain a stream into a table of batches and read it back."""
    out = fresh_path(spark, "stream-out")
    jobs.drain(stream, lambda df, i: sinks.write_batch(df, i, out), fresh_path(spark, "stream-state"), mode)
    return sinks.read_batches(spark, out)


@query("stream_source", f"SELECT {_BODY} FROM readings")
def stream_source(spark, sf):
    return _run(spark, _stream(spark, _sent(spark, sf))).drop("batch_id")


@query("stream_envelope", """
SELECT 'traffic-aqi-data' AS topic, location AS key, count(*) AS n, count(*) AS with_value FROM readings GROUP BY location
""")
def stream_envelope(spark, sf):
    rows = _run(spark, messages.file_source(spark, _sent(spark, sf), files_per_trigger=2))
    return rows.groupBy("topic", "key").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("with_value"))


@query("stream_enrich", f"""
SELECT {_BODY}, {_INGEST_LABEL} AS aqi_category, {_PEAK_TS} AS is_peak_hour, TRUE AS is_active FROM readings
""")
def stream_enrich(spark, sf):
    from cityflux.sources.tables import to_realtime_data

    return _run(spark, to_realtime_data(_stream(spark, _sent(spark, sf)))).drop("batch_id")


def _speed_layer(spark, sf, **kw):
    root = fresh_path(spark, "speed")
    source = messages.file_source(spark, _sent(spark, sf, **kw), files_per_trigger=2)
    sink = sinks.speed_layer(f"{root}/realtime", f"{root}/rollup", f"{root}/bad", f"{root}/raw")
    jobs.drain(source.select("value"), sink, f"{root}/state")
    return root


@query("stream_hourly", """
SELECT date::VARCHAR AS date, hour, location, avg_traffic_level, avg_aqi_value, is_peak_hour, total_records FROM analysis
""")
def stream_hourly(spark, sf):
    """R3, U6 through the whole speed layer, with a snapshot taken on the way."""
    root = _speed_layer(spark, sf)
    sinks.compact(spark, f"{root}/rollup")
    return rollups.hourly_analysis(sinks.read_rollup(spark, f"{root}/rollup"))


@query("stream_compact_race", """
SELECT date::VARCHAR AS date, hour, location, avg_traffic_level, avg_aqi_value, is_peak_hour, total_records FROM analysis
""")
def stream_compact_race(spark, sf):
    """A batch lands while a snapshot is taken, and an unfinished snapshot lies about; nothing counts twice."""
    rows, path = readings(spark, sf), fresh_path(spark, "race")
    for batch in range(2):
        sinks.write_batch(rollups.hourly_state(rows.filter(F.col("id") % 3 == batch)), batch, f"{path}/deltas")
    upto = sinks.newest_batch(spark, path)
    sinks.write_batch(rollups.hourly_state(rows.filter(F.col("id") % 3 == 2)), 2, f"{path}/deltas")
    sinks.write_snapshot(spark, path, upto)
    sinks.read_rollup(spark, path, 0).write.parquet(f"{path}/snapshots/upto=2")
    return rollups.hourly_analysis(sinks.read_rollup(spark, path))


@query("stream_expire", """
SELECT timestamp, location, timestamp >= TIMESTAMP '2024-01-30 23:00:00' AS is_active FROM readings
""")
def stream_expire(spark, sf):
    root = _speed_layer(spark, sf)
    return sinks.read_realtime(spark, f"{root}/realtime", "2024-01-31 00:00:00").select("timestamp", "location", "is_active")


@query("stream_quarantine", """
SELECT 'good' AS kind, count(*) AS n, CAST(sum(aqi_value) AS BIGINT) AS total FROM readings
UNION ALL SELECT 'bad', count(*), CAST(sum(id) AS BIGINT) FROM readings WHERE id % 20 = 0
""")
def stream_quarantine(spark, sf):
    root = _speed_layer(spark, sf, broken=True)
    ok = spark.read.parquet(f"{root}/realtime").agg(F.count(F.lit(1)).alias("n"), F.sum("aqi_value").alias("total"))
    ids = F.regexp_extract("bad_text", r"(\d+)$", 1).cast("long")
    bad = spark.read.parquet(f"{root}/bad").agg(F.count(F.lit(1)).alias("n"), F.sum(ids).alias("total"))
    return ok.select(F.lit("good").alias("kind"), "*").unionByName(bad.select(F.lit("bad").alias("kind"), "*"))


@query("dual_sink", """
SELECT 'realtime' AS table_name, count(*) AS n, CAST(sum(aqi_value) AS BIGINT) AS total FROM readings
UNION ALL SELECT 'raw', count(*), CAST(sum(aqi_value) AS BIGINT) FROM readings
""")
def dual_sink(spark, sf):
    root = _speed_layer(spark, sf)
    parts = [
        spark.read.parquet(f"{root}/{name}").agg(F.count(F.lit(1)).alias("n"), F.sum("aqi_value").alias("total")).select(F.lit(name).alias("table_name"), "n", "total")
        for name in ("realtime", "raw")
    ]
    return parts[0].unionByName(parts[1])


_AGG = """avg(aqi_value) AS avg_aqi, avg(traffic_level) AS avg_traffic, max(aqi_value) AS max_aqi,
  max(traffic_level) AS max_traffic, count(*) AS data_points"""


@query("stream_5min", f"""
SELECT time_bucket(INTERVAL 5 MINUTE, timestamp) AS window_start, time_bucket(INTERVAL 5 MINUTE, timestamp) + INTERVAL 5 MINUTE AS window_end,
       location, {_AGG} FROM readings GROUP BY 1, 2, 3
""")
def stream_5min(spark, sf):
    stream = windows.recent_windows(_stream(spark, _sent(spark, sf)), _WHOLE)
    return windows.latest_updates(_run(spark, stream, "update"), ["window_start", "window_end", "location"])


@query("stream_sliding", f"""
, w AS (SELECT *, time_bucket(INTERVAL 5 MINUTE, timestamp) - INTERVAL 5 MINUTE * k AS window_start
        FROM readings, (SELECT unnest([0, 1, 2]) AS k))
SELECT window_start, window_start + INTERVAL 15 MINUTE AS window_end, location, {_AGG} FROM w GROUP BY 1, 2, 3
""")
def stream_sliding(spark, sf):
    """R4 sliding: a quarter of an hour, moved by five minutes."""
    stream = windows.recent_windows(_stream(spark, _sent(spark, sf)), _WHOLE, "15 minutes", "5 minutes")
    return windows.latest_updates(_run(spark, stream, "update"), ["window_start", "window_end", "location"])


@query("stream_dedupe", f"SELECT {_BODY} FROM readings")
def stream_dedupe(spark, sf):
    """Every message sent twice, kept once."""
    stream = windows.drop_repeats(_stream(spark, _sent(spark, sf, twice=True)), _WHOLE)
    return _run(spark, stream).drop("batch_id")


@query("stream_late", f"""
SELECT time_bucket(INTERVAL 5 MINUTE, timestamp) AS window_start, time_bucket(INTERVAL 5 MINUTE, timestamp) + INTERVAL 5 MINUTE AS window_end,
       location, {_AGG} FROM readings WHERE timestamp >= TIMESTAMP '2024-01-16 00:00:00' GROUP BY 1, 2, 3
""")
def stream_late(spark, sf):
    """The second half of the month comes first, so the first half is late by more than an hour and dropped."""
    path, out, state = (fresh_path(spark, n) for n in ("messages", "stream-out", "stream-state"))
    r = readings(spark, sf)
    early = F.col("timestamp") < F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    for part in (r.filter(~early), r.filter(early)):
        messages.write_files(messages.encode(part), path, 4)
        # A run ends with the watermark moved on; the next takes it up from the checkpoint.
        stream = windows.recent_windows(_stream(spark, path), "1 hour")
        jobs.drain(stream, lambda df, i: sinks.write_batch(df, i, out), state, "update")
    return windows.latest_updates(sinks.read_batches(spark, out), ["window_start", "window_end", "location"])
