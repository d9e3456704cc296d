"""Hand-made tables: ties, constants, missing values, empty input, bin edges, short series."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from cityflux.functions import categories, numbers, times
from cityflux.operators import cleaning, describe, evaluation, features, findings, forecasting, imputation, rollups, serving, splits, upserts

READING = "id long, ts string, location string, latitude double, longitude double, aqi_value int, traffic_level int"


def make(spark, rows):
    df = spark.createDataFrame(rows, READING)
    return df.withColumn("timestamp", F.col("ts").cast("timestamp_ntz")).drop("ts")


def simple(spark, values, location="a", step="minute"):
    start = dt.datetime(2024, 1, 1)
    gap = dt.timedelta(**{step + "s": 1})
    return make(spark, [(i, str(start + i * gap), location, 1.0, 2.0, v, 1 + i % 5) for i, v in enumerate(values)])


def column(df, name, order="id"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_category_edges(spark):
    edges = [-1, 0, 1, 50, 51, 100, 101, 150, 151, 200, 201, 300, 301, 500, 501, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(edges)], "id int, v int")
    v = F.col("v")
    good, mod, sens = "Good", "Moderate", "Unhealthy for Sensitive Groups"
    want = [good] * 4 + [mod] * 2 + [sens] * 2 + ["Unhealthy"] * 2 + ["Very Unhealthy"] * 2 + ["Hazardous"] * 3 + [None]
    assert column(df.select("id", categories.aqi_category(v).alias("c")), "c") == want
    ingest = column(df.select("id", categories.aqi_category_ingest(v).alias("c")), "c")
    assert ingest[1] == "Unknown" and ingest[-1] == "Unknown" and ingest[0] == good
    bins = column(df.select("id", categories.aqi_bin(v).alias("c")), "c")
    assert bins[:2] == [None, None] and bins[2:4] == [good, good] and bins[13] == "Hazardous" and bins[14:] == [None, None]
    assert column(df.select("id", categories.aqi_color(v).alias("c")), "c")[-1] == [128, 128, 128, 255]


def test_hours(spark):
    df = spark.range(24).select(F.col("id"), F.col("id").cast("int").alias("h"))
    h = F.col("h")
    peak = column(df.select("id", times.is_peak(h).alias("x")), "x")
    assert [i for i, x in enumerate(peak) if x] == [6, 7, 8, 9, 16, 17, 18, 19]
    rush = column(df.select("id", times.is_rush_hour(h).alias("x")), "x")
    assert [i for i, x in enumerate(rush) if x] == [7, 8, 9, 17, 18, 19]
    part = column(df.select("id", times.time_of_day(h).alias("x")), "x")
    assert [part.index(p) for p in ("night", "morning", "afternoon", "evening")] == [0, 7, 13, 19]


def test_traffic_level_edges(spark):
    rows = [(0, 0.0, 50.0, 1), (1, 50.0, 60.0, 1), (2, 100.0, 90.0, 2), (3, 100.0, 70.0, 3), (4, 100.0, 50.0, 4),
            (5, 100.0, 30.0, 5), (6, 100.0, 0.0, 5), (7, -5.0, 10.0, 1)]
    df = spark.createDataFrame(rows, "id int, free double, cur double, want int")
    got = column(df.select("id", numbers.traffic_level(F.col("free"), F.col("cur")).alias("x")), "x")
    assert got == [r[3] for r in rows]


def test_rounding_and_casts(spark):
    df = spark.createDataFrame([(0, 2.5), (1, -2.5), (2, 3.49), (3, None)], "id int, v double")
    assert column(df.select("id", numbers.round_to_int(F.col("v")).alias("x")), "x") == [3, -3, 3, None]
    text = spark.createDataFrame([(0, "7"), (1, "-"), (2, None), (3, "NaN")], "id int, v string")
    assert column(text.select("id", numbers.normalize_aqi(F.col("v")).alias("x")), "x") == [7, 0, 0, 0]
    assert column(text.select("id", numbers.to_number(F.col("v")).alias("x")), "x") == [7.0, None, None, None]


def test_peak_hours_ties(spark):
    rows = [(i, f"2024-01-01 {h:02d}:00:00", loc, 1.0, 2.0, 100, 3) for i, (h, loc) in enumerate([(5, "b"), (5, "a"), (3, "b"), (3, "a"), (9, "z")])]
    got = rollups.peak_hours(rollups.hourly_aggregation(make(spark, rows))).collect()
    assert len(got) == 1
    assert (got[0]["peak_aqi_hour"], got[0]["peak_aqi_location"], got[0]["peak_traffic_hour"]) == (3, "a", 3)


def test_interpolation_gaps(spark):
    spots = ["00:00", "01:00", "02:00", "04:00", "05:00", "06:30"]
    rows = [(i, f"2024-01-01 {t}:00", "a", 1.0, 2.0, v, 1) for i, (t, v) in enumerate(zip(spots, [None, 1, None, 4, None, None]))]
    rows += [(10 + i, f"2024-01-01 {t}:00", "empty", 1.0, 2.0, None, 2) for i, t in enumerate(spots[:2])]
    df = make(spark, rows)
    assert column(imputation.impute_interpolate(df), "aqi_value") == [1, 1, 2, 4, 4, 4, 0, 0]
    assert column(imputation.impute_ffill(df), "aqi_value") == [0, 1, 1, 4, 4, 4, 0, 0]
    assert column(imputation.impute_mean(df), "aqi_value") == [2.5, 1, 2.5, 4, 2.5, 2.5, 0, 0]
    assert column(imputation.impute_median(df), "aqi_value") == [2.5, 1, 2.5, 4, 2.5, 2.5, 0, 0]


def test_constant_column(spark):
    df = simple(spark, [40] * 6)
    assert [r["skewness"] for r in describe.shape_statistics(df, ["aqi_value"]).collect()] == [0.0]
    z = describe.anomalies_zscore(df, ["aqi_value"]).collect()[0]
    assert (z["count"], z["percentage"], z["first_ids"]) == (0, 0.0, "")
    assert column(features.scale_standard(df, ["aqi_value"]), "aqi_value") == [0.0] * 6
    assert column(features.scale_minmax(df, ["aqi_value"]), "aqi_value") == [0.0] * 6
    for most in (1, 100):
        matrix = describe.correlation_matrix(df, ["aqi_value", "traffic_level"], most).collect()
        assert [r["correlation"] for r in matrix] == [None]


def test_correlation_forms_agree(spark):
    base = spark.range(300).select(
        (F.col("id") % 17).alias("a"), F.when(F.col("id") % 5 != 0, F.col("id") % 13 + F.col("id") / 50).alias("b"),
        (F.col("id") * 7 % 19 + 106.8).alias("c"), F.lit(3).alias("d"), (F.col("id") % 17 * -2.0).alias("e"),
    )
    cols = ["a", "b", "c", "d", "e"]
    forms = [
        {(r["variable1"], r["variable2"]): r["correlation"] for r in describe.correlation_matrix(base, cols, most).collect()}
        for most in (1, 3, 100)
    ]
    assert forms[0].keys() == forms[1].keys() and len(forms[0]) == 10
    pdf = base.toPandas()
    for key, r in forms[0].items():
        if "d" in key:
            assert r is None and forms[1][key] is None
        else:
            assert r == pytest.approx(pdf[key[0]].corr(pdf[key[1]]))
    # Sums of doubles depend on how rows are split over tasks in their last digit, and on nothing else.
    assert all(f[k] == (None if r is None else pytest.approx(r, rel=1e-9)) for f in forms for k, r in forms[0].items())


def test_correlation_with_an_outlier_and_nan(spark):
    rows = [(float(i), float(2 * i), 1.0) for i in range(20)] + [(1e12, None, 1.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    for most in (1, 100):
        got = {r["variable1"] + r["variable2"]: r["correlation"] for r in describe.correlation_matrix(df, ["a", "b", "c"], most).collect()}
        assert got["ab"] == pytest.approx(1.0) and got["ac"] is None
    nan = spark.createDataFrame([(float("nan"), 1.0), (1.0, 2.0), (2.0, 4.0)], "a double, b double")
    assert all(describe.correlation_matrix(nan, ["a", "b"], m).first()["correlation"] != describe.correlation_matrix(nan, ["a", "b"], m).first()["correlation"] for m in (1, 9))


def test_labels_never_seen(spark):
    df = spark.createDataFrame([(1, 1), (1, 6), (2, 2)], "c_true int, c_pred int")
    wide = {r["actual"]: r.asDict() for r in evaluation.confusion_wide(df, [1, 2]).collect()}
    assert wide[1] == {"actual": 1, "1": 1, "2": 0, "6": 1}
    short = spark.createDataFrame([(1, [0.25, 0.75])], "c_true int, p array<double>")
    cells = {r["class"]: r["score"] for r in evaluation.explode_scores(short, "p", [1, 2, 3], "c_true").collect()}
    assert cells == {1: 0.25, 2: 0.75, 3: 0.0}


def test_colours_go_by_the_whole_part(spark):
    row = spark.range(1).select(categories.aqi_color(F.lit(50.5)).alias("a"), categories.aqi_color(F.lit(50)).alias("b"), categories.traffic_color(F.lit(2.7)).alias("c"), categories.traffic_color(F.lit(2)).alias("d")).first()
    assert row["a"] == row["b"] and row["c"] == row["d"]


def test_forecast_with_gaps(spark):
    nan = float("nan")
    rows = [(i, f"2024-01-{1 + i // 24:02d} {i % 24:02d}:00:00", place, v) for place in ("a", None) for i in range(120) for v in [nan if i == 3 else None if i == 119 and place == "a" else float(i % 7)]]
    df = spark.createDataFrame(rows, "id long, ts string, location string, aqi_value double").withColumn("timestamp", F.col("ts").cast("timestamp_ntz"))
    fit = forecasting.forecast_fit(df)
    out = {(r["location"], r["step"]): r for r in forecasting.forecast(df, fit).collect()}
    assert out["a", 1]["reason"] == forecasting.MISSING and out["a", 1]["value"] is None
    assert out[None, 1]["reason"] is None and out[None, 1]["value"] == pytest.approx(120 % 7, abs=1e-6)


def test_upsert_refuses_repeated_keys(spark):
    old = spark.createDataFrame([("d", 1, "a", 1.0)], "date string, hour int, location string, v double")
    new = spark.createDataFrame([("d", 1, "a", 2.0), ("d", 1, "a", 3.0)], old.schema)
    with pytest.raises(Exception, match="repeats a key"):
        upserts.upsert(old, new).collect()


@pytest.mark.parametrize("values", [[], [5], [None, None], [1, 2, 3]])
def test_tiny_inputs(spark, values):
    df = simple(spark, values)
    for frame in (
        describe.summary_statistics(df), describe.shape_statistics(df), describe.missing_profile(df),
        describe.hourly_pattern(df), describe.dow_pattern(df), describe.weekend_effect(df), describe.rush_hours(df),
        describe.location_stats(df), describe.hotspots(df), describe.anomalies_iqr(df), describe.anomalies_zscore(df),
        describe.correlation_matrix(df, ["aqi_value", "traffic_level"]), describe.dataset_info(df), describe.map_center(df),
        findings.key_findings(df), cleaning.clean_data(df), cleaning.cleaning_counters(df), features.preprocess(df),
        rollups.daily_aggregation(df), rollups.peak_hours(rollups.hourly_aggregation(df)), rollups.kpi_summary(df),
        splits.time_split(df), splits.sequences(df), imputation.impute_median(df), serving.latest_readings(df),
    ):
        frame.collect()
    center = describe.map_center(df).collect()[0]
    assert (center["latitude"], center["longitude"]) == ((1.0, 2.0) if values else (-6.2, 106.816666))


def test_bias_corrected_shape(spark):
    import pandas as pd

    values = [3, 9, 4, 4, 80, 17, 21, 4]
    got = describe.shape_statistics(simple(spark, values), ["aqi_value"]).collect()[0]
    assert got["skewness"] == pytest.approx(pd.Series(values).skew())
    assert got["kurtosis"] == pytest.approx(pd.Series(values).kurt())


def test_dedupe_with_null_location(spark):
    rows = [(3, "2024-01-01", None, 1.0, 2.0, 1, 1), (1, "2024-01-01", None, 1.0, 2.0, 2, 1), (2, "2024-01-01", "a", 1.0, 2.0, 3, 1)]
    assert column(cleaning.dedupe_first(make(spark, rows)), "id") == [1, 2]


def test_upsert_null_hour(spark):
    schema = "date string, hour int, location string, n int"
    old = spark.createDataFrame([("d", None, "a", 1), ("d", 3, "a", 1), ("d", None, "b", 1)], schema)
    new = spark.createDataFrame([("d", None, "a", 2), ("e", 3, "a", 2)], schema)
    once = upserts.upsert(old, new)
    rows = lambda df: sorted(map(repr, df.collect()))
    assert once.count() == 4 and rows(upserts.upsert(once, new)) == rows(once)
    twice = new.withColumn("v", F.lit(1)).unionByName(new.withColumns({"v": F.lit(2), "n": F.lit(9)}))
    assert {r["n"] for r in upserts.upsert(old, twice, newest="v").collect()} == {1, 9}


@pytest.mark.parametrize("rows,windows", [(47, 0), (48, 0), (49, 1), (60, 12)])
def test_sequence_lengths(spark, rows, windows):
    seq = splits.sequences(simple(spark, list(range(rows)))).orderBy("idx").collect()
    assert len(seq) == windows
    if windows:
        assert seq[0]["idx"] == 24 and seq[0]["past"] == [float(i) for i in range(24)]
        assert seq[-1]["future"][-1] == float(rows - 2)


def test_sequences_keep_missing_values(spark):
    values = [None if i == 10 else i for i in range(50)]
    first = splits.sequences(simple(spark, values)).orderBy("idx").collect()[0]
    assert first["past"][10] is None and len(first["past"]) == 24


def test_combined_view_branches(spark):
    raw = make(spark, [(i, f"2024-01-01 10:{i:02d}:00", "abc"[i % 3], 1.0, 2.0, i, 1) for i in range(30)])
    live = raw.withColumn("is_active", F.lit(True))
    rollup = rollups.hourly_aggregation(raw)

    def view(as_of):
        return serving.combined_view(live, rollup, raw, as_of).collect()

    assert {r["source"] for r in view("2024-01-01 10:40:00")} == {"speed"}
    mixed = view("2024-01-01 11:25:00")
    assert {r["source"] for r in mixed} == {"speed", "batch"} and len(mixed) == 8
    assert {r["source"] for r in view("2024-01-02 09:00:00")} == {"batch"}
    far = view("2024-03-01 00:00:00")
    assert {r["source"] for r in far} == {"raw"} and len(far) == 30
    assert {r["last_update"] for r in far} == {dt.datetime(2024, 1, 1, 10, 29)}


def test_speed_row_wins(spark):
    same = make(spark, [(1, "2024-01-01 10:00:00", "a", 1.0, 2.0, 77, 1)])
    live = same.withColumn("is_active", F.lit(True))
    from cityflux.sources.tables import realtime_scan

    speed = realtime_scan(live, "2024-01-01 10:30:00")
    batch = serving.batch_as_readings(rollups.hourly_aggregation(same), same, "2024-01-01 10:30:00")
    rows = serving.serving_union(speed, batch).collect()
    assert len(rows) == 1 and rows[0]["source"] == "speed"


def test_no_leak_features(spark):
    rows = features.engineer_features(simple(spark, [10, 20, 30, 40]), feature_set="no_leak")
    assert column(rows, "aqi_value_ma_3h") == [None, 10.0, 15.0, 20.0]
    leaky = features.engineer_features(simple(spark, [10, 20, 30, 40]))
    assert column(leaky, "aqi_value_ma_3h") == [10.0, 15.0, 20.0, 30.0]


def test_weekend_finding(spark):
    rows = [(i, f"2024-01-{d:02d} 08:00:00", "a", 1.0, 2.0, v, 1) for i, (d, v) in enumerate([(1, 40), (2, 40), (6, 90), (7, 90)])]
    found = {r["ord"]: r for r in findings.key_findings(make(spark, rows)).collect()}
    assert found[4]["finding"] == "Weekend AQI is 50.0 points higher than weekdays"
    assert math.isclose(rollups.kpi_summary(make(spark, rows)).collect()[0]["avg_aqi"], 65.0)


def test_newest_readings_of_a_stored_table(spark, tmp_path):
    from cityflux.sources import tables

    rows = spark.range(3_000).select("id", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 864).cast("timestamp_ntz").alias("timestamp"), F.lit("a").alias("location"), F.lit(1.0).alias("latitude"), F.lit(2.0).alias("longitude"), F.lit(5).alias("aqi_value"), F.lit(2).alias("traffic_level"))
    rows = rows.unionByName(rows.filter("id < 2").withColumn("timestamp", F.lit(None).cast("timestamp_ntz")))
    tables.append_by_date(rows, f"{tmp_path}/raw")
    stored = tables.read_table(spark, f"{tmp_path}/raw")
    for n, dates in ((50, 1), (150, 2), (2_000, 32)):
        part = tables.newest_dates(stored, n)
        assert part.select("date").distinct().count() == min(dates, 31)
        got, want = (serving.latest_readings(df, n).orderBy("timestamp").collect() for df in (stored, rows))
        assert got == want and len(got) == n
    pruned = tables.newest_dates(stored, 50)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in pruned and "date#" in pruned
    assert tables.newest_dates(rows, 50) is rows
