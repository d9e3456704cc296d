"""Streams: any file order, restart, replay and late rows."""

import datetime as dt

from pyspark.sql import functions as F

from cityflux.operators import rollups
from cityflux.sources import messages
from cityflux.streaming import jobs, sinks, windows


def readings(spark, first, n, minutes=1, base="2024-01-01 00:00:00"):
    start = dt.datetime.fromisoformat(base)
    rows = [(i, str(start + dt.timedelta(minutes=minutes * i)), "ab"[i % 2], 1.0, 2.0, 10 + i, 1 + i % 5) for i in range(first, first + n)]
    df = spark.createDataFrame(rows, "id long, ts string, location string, latitude double, longitude double, aqi_value int, traffic_level int")
    return df.withColumn("timestamp", F.col("ts").cast("timestamp_ntz")).drop("ts")


def send(df, path):
    messages.write_files(messages.encode(df), path, 1)


def state(spark, root):
    out = rollups.hourly_analysis(sinks.read_rollup(spark, f"{root}/rollup"))
    return sorted(map(repr, out.collect()))


def batch_state(df):
    out = rollups.hourly_analysis(rollups.hourly_state(df))
    return sorted(map(repr, out.collect()))


def run(spark, root):
    sink = sinks.speed_layer(f"{root}/realtime", f"{root}/rollup", f"{root}/bad")
    source = messages.file_source(spark, f"{root}/in", files_per_trigger=1).select("value")
    jobs.drain(source, sink, f"{root}/state")


def test_restart_continues_and_late_rows_count(spark, tmp_path):
    root = str(tmp_path)
    new, old = readings(spark, 200, 90), readings(spark, 0, 90)
    send(new, f"{root}/in")
    run(spark, root)
    assert state(spark, root) == batch_state(new)
    sinks.compact(spark, f"{root}/rollup")
    send(old, f"{root}/in")
    run(spark, root)
    assert state(spark, root) == batch_state(new.unionByName(old))
    sinks.compact(spark, f"{root}/rollup")
    assert state(spark, root) == batch_state(new.unionByName(old))


def test_replayed_batch_is_not_counted_twice(spark, tmp_path):
    root = str(tmp_path)
    batch = messages.encode(readings(spark, 0, 50)).select("value")
    sink = sinks.speed_layer(f"{root}/realtime", f"{root}/rollup", f"{root}/bad")
    for _ in range(2):
        sink(batch, 7)
    assert state(spark, root) == batch_state(readings(spark, 0, 50))
    assert spark.read.parquet(f"{root}/realtime").count() == 50


def test_bad_messages_are_kept_apart(spark, tmp_path):
    texts = ["{oops", "[]", "", '{"location": null}', '{"location": "a", "timestamp": "2024-01-01T00:00:00Z", "aqi_value": 5}']
    df = messages.decode(spark.createDataFrame([(t,) for t in texts], "value string"))
    rows = messages.good(df).collect()
    assert len(rows) == 1 and rows[0]["aqi_value"] == 5 and rows[0]["timestamp"] == dt.datetime(2024, 1, 1)
    assert messages.quarantine(df).count() == 4


def test_missing_time_becomes_now(spark):
    df = messages.decode(spark.createDataFrame([('{"location": "a"}',)], "value string"))
    assert messages.good(df).collect()[0]["timestamp"] is not None


def test_watermark_drops_and_counts(spark, tmp_path):
    root = str(tmp_path)
    send(readings(spark, 600, 20), f"{root}/in")

    def drain():
        stream = messages.good(messages.decode(messages.file_source(spark, f"{root}/in", 1)))
        sink = lambda df, i: sinks.write_batch(df, i, f"{root}/out")
        return jobs.drain(windows.recent_windows(stream, "1 hour"), sink, f"{root}/state", "update")

    drain()
    send(readings(spark, 0, 10), f"{root}/in")
    # Rows dropped are counted after the map-side combine: one per window and location.
    assert jobs.dropped_late(drain()) >= 1
    seen = windows.latest_updates(sinks.read_batches(spark, f"{root}/out"), ["window_start", "location"])
    assert seen.agg(F.sum("data_points")).collect()[0][0] == 20


def test_realtime_expiry_at_read(spark, tmp_path):
    root = str(tmp_path)
    send(readings(spark, 0, 120), f"{root}/in")
    run(spark, root)
    live = sinks.read_realtime(spark, f"{root}/realtime", "2024-01-01 02:00:00", hours=1)
    assert live.filter("is_active").count() == 60


def test_offsets_of_hour_rules(spark):
    df = readings(spark, 0, 3)
    here = rollups.hourly_state(df, offset_hours=7).select("hour").distinct().collect()
    assert [r["hour"] for r in here] == [7]


def test_tasks_of_a_batch_do_not_follow_the_session(spark, tmp_path):
    """Every task of every batch reports to the driver; their number is that of the stream."""
    root, held = str(tmp_path), spark.conf.get("spark.sql.shuffle.partitions")
    send(readings(spark, 0, 40), f"{root}/in")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        stream = windows.recent_windows(messages.good(messages.decode(messages.file_source(spark, f"{root}/in", 1))), "1 hour")
        jobs.drain(stream, lambda df, i: sinks.write_batch(df, i, f"{root}/out"), f"{root}/state", "update")
        assert spark.conf.get("spark.sql.shuffle.partitions") == "40"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    stores = [p for p in (tmp_path / "state/state/0").iterdir() if p.name.isdigit()]
    assert len(stores) == jobs.BATCH_TASKS
    assert sinks.read_batches(spark, f"{root}/out").agg(F.sum("data_points")).first()[0] == 40


def test_batches_write_what_they_change(spark, tmp_path):
    """a batch with state leaves its changes, not a new copy of the store, and repeats go across batches."""
    from cityflux.session import tune

    tune(spark)
    for first in (0, 10, 0):
        send(readings(spark, first, 20), f"{tmp_path}/in")
    source = messages.file_source(spark, f"{tmp_path}/in", files_per_trigger=1)
    rows = windows.drop_repeats(messages.good(messages.decode(source)), "40 days")
    jobs.drain(rows, lambda df, i: sinks.write_batch(df, i, f"{tmp_path}/out"), f"{tmp_path}/state")
    assert sinks.read_batches(spark, f"{tmp_path}/out").count() == 30
    assert list(tmp_path.glob("state/state/0/*/*.changelog")) and not list(tmp_path.glob("state/state/0/*/1.zip"))
