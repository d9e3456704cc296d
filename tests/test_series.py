"""The range-cut plans give the same rows as the plain ones, also when one key holds nearly everything."""

import random

import pytest
from pyspark.sql import functions as F

from cityflux.operators import features, imputation, splits
from cityflux.plans import ranks, series

COLS = "id long, timestamp timestamp_ntz, location string, aqi_value int, traffic_level int"


@pytest.fixture(scope="module")
def hot(spark):
    """700 rows: one location holds most, one has a single row, one has a NULL name; gaps and tied times."""
    rng = random.Random(7)
    rows = []
    for i in range(700):
        loc = "a" if i % 10 < 7 else ("b" if i % 10 < 9 else None)
        if i == 333:
            loc = "c"
        minute = rng.randrange(0, 400)
        value = None if rng.random() < 0.4 else rng.randrange(0, 300)
        rows.append((i, f"2024-01-01 {minute // 60:02d}:{minute % 60:02d}:00", loc, value, rng.randrange(1, 6)))
    df = spark.createDataFrame(rows, "id long, ts string, location string, aqi_value int, traffic_level int")
    out = df.select("id", F.col("ts").cast("timestamp_ntz").alias("timestamp"), "location", "aqi_value", "traffic_level")
    return out.cache()


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    cols = sorted(a.columns)
    key = lambda rows: sorted(repr(tuple(r)) for r in rows)
    left, right = key(a.select(*cols).collect()), key(b.select(*cols).collect())
    assert left == right


SMALL = dict(limit=10, partitions=9)


def test_lags_and_means(hot):
    for op in (features.lag_features, features.rolling_means):
        same(op(hot), op(hot, **SMALL))


def test_many_tiny_chunks(hot):
    """Chunks shorter than the halo must reach several chunks back."""
    same(features.lag_features(hot), features.lag_features(hot, limit=0, partitions=40))


def test_carry(hot):
    for op in (imputation.impute_interpolate, imputation.impute_ffill):
        same(op(hot, ["aqi_value"]), op(hot, ["aqi_value"], **SMALL))
        same(op(hot, ["aqi_value"]), op(hot, ["aqi_value"], limit=0, partitions=30))


def test_positions_and_sequences(hot):
    order = ["timestamp", "id"]
    same(series.with_position(hot, ["location"], order), series.with_position(hot, ["location"], order, **SMALL))
    same(series.with_position(hot, [], order), series.with_position(hot, [], order, **SMALL))
    same(splits.sequences(hot, lookback=5, horizon=3), splits.sequences(hot, lookback=5, horizon=3, **SMALL))
    same(splits.sequences(hot), splits.sequences(hot, limit=0, partitions=24))


def test_folds(hot):
    same(splits.contiguous_folds(hot, 4, ["timestamp", "id"]), splits.contiguous_folds(hot, 4, ["timestamp", "id"], **SMALL))


def test_percentiles(hot):
    points = {"q25": 0.25, "median": 0.5, "q75": 0.75, "p99": 0.99, "lo": 0.0, "hi": 1.0}
    measured = hot.withColumn("v", F.col("aqi_value") + F.col("id") / F.lit(1000.0))
    pdf = measured.select("location", "v").toPandas()
    few = {k: points[k] for k in ("q25", "median", "p99")}
    row = ranks.percentiles(measured, "v", few, limit=5).collect()[0]
    for name, p in few.items():
        assert row[name] == pytest.approx(pdf["v"].quantile(p))
    for kw in ({}, {"limit": 5, "partitions": 7}):
        row = ranks.percentiles(measured, "v", points, **kw).collect()[0]
        for name, p in points.items():
            assert row[name] == pytest.approx(pdf["v"].quantile(p))
        for r in ranks.percentiles(measured, "v", points, ["location"], **kw).collect():
            mine = pdf[pdf["location"].isna()] if r["location"] is None else pdf[pdf["location"] == r["location"]]
            for name, p in points.items():
                if len(mine["v"].dropna()):
                    assert r[name] == pytest.approx(mine["v"].quantile(p))


def test_values_at_ranks(spark):
    """Narrowing on a skewed column where one value holds a third of the rows."""
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.exp(F.col("id") % 97 / 9.0) - F.lit(3.0)).alias("v")
    )
    ordered = sorted(r["v"] for r in df.collect())
    wanted = [0, 1, 700, 1000, 1500, 1999, 2500, 2999]
    for leaf, grid in ((1, 4), (20, 10), (10_000, 400)):
        got = ranks.values_at_ranks(df, "v", wanted, leaf=leaf, grid=grid)
        assert got == {r: ordered[r] for r in wanted}
    same = spark.range(50).select(F.lit(2.5).alias("v"))
    assert ranks.values_at_ranks(same, "v", [0, 49], leaf=1) == {0: 2.5, 49: 2.5}


def test_rank_cut(hot):
    ordered = [(r["timestamp"], r["id"]) for r in hot.orderBy("timestamp", "id").collect()]
    for rank in (0, 1, 350, 560, 699):
        for leaf in (1, 3, 10_000):
            cut = ranks.rank_cut(hot, "timestamp", "id", rank, leaf=leaf, fan=4)
            assert cut.id == ordered[rank][1]
    assert ranks.rank_cut(hot, "timestamp", "id", 700).micros is None


def test_time_split_is_exact(hot):
    got = {r["id"]: r["split"] for r in splits.time_split(hot, leaf=5).collect()}
    ordered = [r["id"] for r in hot.orderBy("timestamp", "id").collect()]
    cut = int(700 * 0.8)
    val = int(cut * 0.2)
    want = {i: "train" if p < cut - val else "val" if p < cut else "test" for p, i in enumerate(ordered)}
    assert got == want


def test_missing_times_come_last(spark):
    rows = [(0, None), (1, "2024-01-02"), (2, None), (3, "2024-01-01"), (4, None)]
    df = spark.createDataFrame(rows, "id long, ts string").select("id", F.col("ts").cast("timestamp_ntz").alias("timestamp"))
    got = {r["id"]: r["split"] for r in splits.time_split(df, test=0.4, val=0.0).collect()}
    assert got == {3: "train", 1: "train", 0: "train", 2: "test", 4: "test"}
    head, tail = splits.tail_split(df, 0.4)
    assert {r["id"] for r in head.collect()} == {0, 1, 3} and {r["id"] for r in tail.collect()} == {2, 4}


def test_random_split(hot):
    parts = splits.random_split(hot, 0.3)
    shares = {r["split"]: r["count"] for r in parts.groupBy("split").count().collect()}
    assert shares == {"test": 210, "train": 490}
    same(parts, splits.random_split(hot.repartition(5), 0.3, leaf=20))


@pytest.mark.parametrize("n, test, want", [(10, 0.25, 3), (7, 0.2, 2), (1, 0.5, 1), (0, 0.2, 0), (10, 0.3, 3), (5, 1.0, 5), (5, 0.0, 0)])
def test_random_split_sizes(spark, n, test, want):
    assert splits.random_split(spark.range(n), test).filter("split = 'test'").count() == want


def test_chunks_keep_to_the_limit(spark, hot):
    one = hot.withColumn("location", F.lit("a"))
    parts = series.chunked(one, ["location"], ["timestamp", "id"], 700, 50)
    sizes = [r["count"] for r in parts.groupBy(series._CHUNK).count().collect()]
    assert sum(sizes) == 700 and max(sizes) <= 50
    same(features.lag_features(one), features.lag_features(one, limit=50))


@pytest.mark.parametrize("kind", ["int", "double"])
def test_percentile_plans_agree_to_the_last_digit(spark, kind):
    rows = spark.range(5000).select((F.col("id") * 7919 % 4999 / F.lit(1 if kind == "int" else 7.0)).cast(kind).alias("v"), (F.col("id") % 3).alias("k"))
    points = {"a": 0.25, "b": 0.5, "c": 0.123, "d": 0.75}
    plain = ranks.percentiles(rows, "v", points, limit=10**9).collect()
    assert plain == ranks.percentiles(rows, "v", points, limit=10).collect()
    many = points | {f"p{i}": i / 20 for i in range(8)}
    assert ranks.percentiles(rows, "v", many, limit=10**9).collect() == ranks.percentiles(rows, "v", many, limit=10, partitions=5).collect()
    keyed = [sorted(ranks.percentiles(rows, "v", points, ["k"], limit=n).collect()) for n in (10**9, 10)]
    assert keyed[0] == keyed[1]
