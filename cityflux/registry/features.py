"""Features, scaling, splits, sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from cityflux.operators import features, splits
from cityflux.registry.base import dirty_readings, query, readings
from cityflux.registry.cleaning import _DEDUPED, interpolate_sql

_W = "PARTITION BY location ORDER BY timestamp, id"
_M = ["aqi_value", "traffic_level"]
_LAGS = ", ".join(f"lag({m}, {n}) OVER ({_W}) AS {m}_lag_{n}h" for m in _M for n in (1, 2, 24))
_MEANS = ", ".join(
    f"round(avg({m}) OVER ({_W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), 6) AS {m}_ma_{n}h" for m in _M for n in (3, 6, 24)
)
_MEANS_OPEN = ", ".join(
    f"round(avg({m}) OVER ({_W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING), 6) AS {m}_ma_{n}h" for m in _M for n in (3, 6, 24)
)


def means_sql(before: int, digits: int | None = 6) -> str:
    """Rolling means that leave the row itself out, rounded or whole."""
    whole = [(f"avg({m}) OVER ({_W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)", f"{m}_ma_{n}h") for m in _M for n in (3, 6, 24) if n <= before]
    return ", ".join(f"{f'round({c}, {digits})' if digits else c} AS {name}" for c, name in whole)


_BIN = """CASE WHEN aqi_value > 0 AND aqi_value <= 50 THEN 'Good' WHEN aqi_value > 50 AND aqi_value <= 100 THEN 'Moderate'
  WHEN aqi_value > 100 AND aqi_value <= 150 THEN 'Unhealthy_Sensitive' WHEN aqi_value > 150 AND aqi_value <= 200 THEN 'Unhealthy'
  WHEN aqi_value > 200 AND aqi_value <= 300 THEN 'Very_Unhealthy' WHEN aqi_value > 300 AND aqi_value <= 500 THEN 'Hazardous' END"""
_CALENDAR = """hour(timestamp) AS hour, isodow(timestamp) - 1 AS day_of_week, month(timestamp) AS month, day(timestamp) AS day_of_month,
  CASE WHEN isodow(timestamp) >= 6 THEN 1 ELSE 0 END AS is_weekend,
  CASE WHEN hour(timestamp) BETWEEN 7 AND 9 OR hour(timestamp) BETWEEN 17 AND 19 THEN 1 ELSE 0 END AS is_rush_hour,
  CASE WHEN hour(timestamp) <= 6 THEN 'night' WHEN hour(timestamp) <= 12 THEN 'morning'
       WHEN hour(timestamp) <= 18 THEN 'afternoon' ELSE 'evening' END AS time_of_day"""


def feature_sql(source: str, means: str = _MEANS) -> str:
    return f"""
, features AS (
  SELECT id, timestamp, location, latitude, longitude, aqi_value, traffic_level, {_LAGS}, {means}, {_CALENDAR},
         aqi_value * traffic_level AS aqi_traffic_interaction, {_BIN} AS aqi_category FROM {source}
)"""


@query("lag_features", f"SELECT id, location, {_LAGS} FROM readings")
def lag_features(spark, sf):
    return features.lag_features(readings(spark, sf)).drop("timestamp", "latitude", "longitude", *_M)


@query("rolling_means", f"SELECT id, location, {_MEANS} FROM readings", places=6)
def rolling_means(spark, sf):
    return features.rolling_means(readings(spark, sf)).drop("timestamp", "latitude", "longitude", *_M)


@query("rolling_means_items", """
SELECT l_orderkey, l_linenumber, round(avg(l_quantity) OVER w3, 6) AS l_quantity_ma_3h, round(avg(l_quantity) OVER w6, 6) AS l_quantity_ma_6h,
       round(avg(l_quantity) OVER w24, 6) AS l_quantity_ma_24h
FROM lineitem
WINDOW w3 AS (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber ROWS BETWEEN 2 PRECEDING AND CURRENT ROW),
       w6 AS (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber ROWS BETWEEN 5 PRECEDING AND CURRENT ROW),
       w24 AS (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)
""", places=6)
def rolling_means_items(spark, sf):
    """W2 on the larger table: per supplier along the ship date."""
    items = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", "l_quantity")
    out = features.rolling_means(items, ["l_quantity"], ["l_suppkey"], ["l_shipdate", "l_orderkey", "l_linenumber"])
    return out.select("l_orderkey", "l_linenumber", "l_quantity_ma_3h", "l_quantity_ma_6h", "l_quantity_ma_24h")


@query("engineer_features", feature_sql("readings") + "SELECT * FROM features", places=6)
def engineer_features(spark, sf):
    return features.engineer_features(readings(spark, sf))


@query("engineer_features_no_leak", feature_sql("readings", _MEANS_OPEN) + "SELECT * FROM features", places=6)
def engineer_features_no_leak(spark, sf):
    return features.engineer_features(readings(spark, sf), feature_set="no_leak")


_F_AQI = """hour, day_of_week, month, is_weekend, is_rush_hour, traffic_level, latitude, longitude,
  aqi_value_lag_1h, aqi_value_lag_2h, aqi_value_lag_24h, traffic_level_lag_1h, traffic_level_lag_2h, traffic_level_lag_24h,
  aqi_value_ma_3h, aqi_value_ma_6h, aqi_value_ma_24h, traffic_level_ma_3h, traffic_level_ma_6h, traffic_level_ma_24h"""


@query("prepare_features", feature_sql("readings") + f"SELECT id, {_F_AQI}, aqi_value FROM features WHERE aqi_value_lag_24h IS NOT NULL", places=6)
def prepare_features(spark, sf):
    return features.prepare_features(features.engineer_features(readings(spark, sf)), "aqi_value", keep=["id"])


_SCALED = ["aqi_value", "traffic_level", "latitude", "month"]


@query("scale_standard", ", f AS (SELECT id, aqi_value, traffic_level, latitude, month(timestamp) AS month FROM readings) SELECT id, " + ", ".join(
    f"round(coalesce((CAST({c} AS DOUBLE) - avg({c}) OVER ()) / nullif(stddev_pop({c}) OVER (), 0), 0), 6) + 0.0 AS {c}" for c in _SCALED
) + " FROM f", places=6)
def scale_standard(spark, sf):
    r = readings(spark, sf).select("id", "aqi_value", "traffic_level", "latitude", F.month("timestamp").alias("month"))
    return features.scale_standard(r, _SCALED)


@query("scale_minmax", ", f AS (SELECT id, aqi_value, traffic_level, latitude, month(timestamp) AS month FROM readings) SELECT id, " + ", ".join(
    f"round(coalesce((CAST({c} AS DOUBLE) - min({c}) OVER ()) / nullif(max({c}) OVER () - min({c}) OVER (), 0), 0), 6) AS {c}" for c in _SCALED
) + " FROM f", places=6)
def scale_minmax(spark, sf):
    r = readings(spark, sf).select("id", "aqi_value", "traffic_level", "latitude", F.month("timestamp").alias("month"))
    return features.scale_minmax(r, _SCALED)


@query("preprocess_full", _DEDUPED + interpolate_sql("clean", _M) + feature_sql("filled") + "SELECT * FROM features", places=6)
def preprocess_full(spark, sf):
    return features.preprocess(dirty_readings(spark, sf))


@query("preprocessing_summary", _DEDUPED + interpolate_sql("clean", _M) + feature_sql("filled") + """
, b AS (SELECT count(*) AS n, count(*) * 3 - count(aqi_value) - count(traffic_level) - count(latitude) AS m FROM dirty_readings)
, a AS (
  SELECT count(*) AS n, min(timestamp) AS start, max(timestamp) AS "end", count(DISTINCT location) AS locations,
    count(*) * 7 - count(aqi_value_lag_1h) - count(aqi_value_lag_2h) - count(aqi_value_lag_24h)
      - count(traffic_level_lag_1h) - count(traffic_level_lag_2h) - count(traffic_level_lag_24h) - count(aqi_category) AS m
  FROM features)
SELECT b.n AS original_records, a.n AS processed_records, b.n - a.n AS records_removed,
  round(CAST(b.n - a.n AS DOUBLE) / b.n * 100, 6) AS removal_percentage, 7 AS original_features, 28 AS processed_features, 21 AS new_features,
  b.m AS missing_values_original, a.m AS missing_values_processed, start, "end", locations
FROM a, b
""", places=6)
def preprocessing_summary(spark, sf):
    before = dirty_readings(spark, sf)
    return features.preprocessing_summary(before, features.preprocess(before))


@query("time_split", """
, n AS (SELECT count(*) AS n, CAST(floor(count(*) * (1 - 0.2)) AS BIGINT) AS cut FROM readings),
r AS (SELECT id, row_number() OVER (ORDER BY timestamp, id) - 1 AS rn FROM readings)
SELECT id, CASE WHEN rn < cut - CAST(floor(cut * 0.2) AS BIGINT) THEN 'train' WHEN rn < cut THEN 'val' ELSE 'test' END AS split FROM r, n
""")
def time_split(spark, sf):
    return splits.time_split(readings(spark, sf)).select("id", "split")


@query("random_split", """
, drawn AS (SELECT id, row_number() OVER (ORDER BY CAST('0x' || substr(md5('42:' || id), 1, 8) AS BIGINT), id) AS rn, count(*) OVER () AS n FROM readings)
SELECT id, CASE WHEN rn <= ceil(n / 5) THEN 'test' ELSE 'train' END AS split FROM drawn
""")
def random_split(spark, sf):
    return splits.random_split(readings(spark, sf)).select("id", "split")


@query("contiguous_folds", """
, r AS (SELECT id, row_number() OVER (ORDER BY timestamp, id) - 1 AS rn, count(*) OVER () AS n FROM readings)
SELECT id, CASE WHEN rn < (n // 3 + 1) * (n % 3) THEN rn // (n // 3 + 1) ELSE n % 3 + (rn - (n // 3 + 1) * (n % 3)) // (n // 3) END AS fold FROM r
""")
def contiguous_folds(spark, sf):
    return splits.contiguous_folds(readings(spark, sf), 3, ["timestamp", "id"]).select("id", "fold")


@query("stratified_folds", """
, r AS (SELECT id, traffic_level, row_number() OVER (PARTITION BY traffic_level ORDER BY timestamp, id) - 1 AS rn,
               count(*) OVER (PARTITION BY traffic_level) AS n FROM readings)
SELECT id, traffic_level, CASE WHEN rn < (n // 3 + 1) * (n % 3) THEN rn // (n // 3 + 1)
  ELSE n % 3 + (rn - (n // 3 + 1) * (n % 3)) // (n // 3) END AS fold FROM r
""")
def stratified_folds(spark, sf):
    return splits.contiguous_folds(readings(spark, sf), 3, ["timestamp", "id"], by="traffic_level").select("id", "traffic_level", "fold")


@query("lookback_tail", """
SELECT location, count(*) AS n, string_agg(CAST(aqi_value AS VARCHAR), ',' ORDER BY timestamp, id) AS history FROM (
  SELECT *, row_number() OVER (PARTITION BY location ORDER BY timestamp DESC, id DESC) AS b FROM readings) WHERE b <= 24
GROUP BY location
""")
def lookback_tail(spark, sf):
    tail = splits.lookback_tail(readings(spark, sf))
    text = F.array_join(F.transform("values", lambda v: v.cast("int").cast("string")), ",")
    return tail.select("location", "n", text.alias("history"))


@query("sequences", """
, r AS (SELECT location, CAST(aqi_value AS DOUBLE) AS v, row_number() OVER (PARTITION BY location ORDER BY timestamp, id) - 1 AS pos,
               count(*) OVER (PARTITION BY location) AS n FROM readings)
, w AS (SELECT location, pos AS idx FROM r WHERE pos >= 24 AND pos < n - 24)
SELECT w.location, w.idx, r.pos - w.idx AS step, r.v AS value
FROM w JOIN (SELECT unnest(range(-24, 24)) AS s) ON TRUE JOIN r ON r.location = w.location AND r.pos = w.idx + s
""")
def sequences(spark, sf):
    return splits.unnest_sequences(splits.sequences(readings(spark, sf)))


@query("numeric_columns", """
SELECT column_name AS name FROM (
  SELECT unnest(['id', 'latitude', 'longitude', 'aqi_value', 'traffic_level', 'hour', 'day_of_week', 'month', 'day_of_month', 'is_weekend', 'is_rush_hour', 'aqi_traffic_interaction']) AS column_name
  UNION ALL SELECT m || t FROM (SELECT unnest(['aqi_value', 'traffic_level']) AS m), (SELECT unnest(['_lag_1h', '_lag_2h', '_lag_24h', '_ma_3h', '_ma_6h', '_ma_24h']) AS t)
) WHERE column_name NOT LIKE '%id%' AND EXISTS (SELECT 1 FROM readings)
""")
def numeric_columns(spark, sf):
    """F16: the numeric columns of the feature table of the readings, without ids."""
    built = features.engineer_features(readings(spark, sf))
    names = features.numeric_columns(built, without_ids=True)
    return built.limit(1).select(F.explode(F.array(*[F.lit(n) for n in names])).alias("name"))
