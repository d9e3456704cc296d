"""Cleaning and imputation."""

from __future__ import annotations

from cityflux.operators import cleaning, imputation
from cityflux.registry.base import dirty_readings, gappy_readings, query

_READING = "id, timestamp, location, latitude, longitude, aqi_value, traffic_level"
_DEDUPED = """
, deduped AS (
  SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY timestamp, location ORDER BY id) AS rn FROM dirty_readings)
  WHERE rn = 1
), valid AS (
  SELECT * FROM deduped WHERE latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180
    AND aqi_value >= 0 AND traffic_level BETWEEN 1 AND 5
), q AS (
  SELECT quantile_cont(CAST(aqi_value AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(aqi_value AS DOUBLE), 0.75) AS q3 FROM valid
), clean AS (
  SELECT valid.* FROM valid, q WHERE aqi_value >= q1 - 3.0::DOUBLE * (q3 - q1) AND aqi_value <= q3 + 3.0::DOUBLE * (q3 - q1)
)
"""


@query("dedupe_first", _DEDUPED + f"SELECT {_READING} FROM deduped")
def dedupe_first(spark, sf):
    return cleaning.dedupe_first(dirty_readings(spark, sf))


@query("clean_coords", f"SELECT {_READING} FROM dirty_readings WHERE latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180")
def clean_coords(spark, sf):
    return dirty_readings(spark, sf).filter(cleaning.valid_coordinates())


@query("clean_aqi", f"SELECT {_READING} FROM dirty_readings WHERE aqi_value >= 0")
def clean_aqi(spark, sf):
    return dirty_readings(spark, sf).filter(cleaning.valid_aqi())


@query("clean_traffic", f"SELECT {_READING} FROM dirty_readings WHERE traffic_level BETWEEN 1 AND 5")
def clean_traffic(spark, sf):
    return dirty_readings(spark, sf).filter(cleaning.valid_traffic())


@query("dropna_coords", f"""
SELECT id, latitude, longitude FROM (SELECT id, longitude, CASE WHEN latitude BETWEEN -90 AND 90 THEN latitude END AS latitude FROM dirty_readings)
WHERE latitude IS NOT NULL AND longitude IS NOT NULL
""")
def dropna_coords(spark, sf):
    from pyspark.sql import functions as F

    d = dirty_readings(spark, sf).withColumn("latitude", F.when(F.col("latitude").between(-90, 90), F.col("latitude")))
    return cleaning.dropna_coords(d).select("id", "latitude", "longitude")


@query("iqr_filter", f"""
, q AS (SELECT quantile_cont(CAST(aqi_value AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(aqi_value AS DOUBLE), 0.75) AS q3 FROM dirty_readings)
, one AS (
  SELECT d.* FROM dirty_readings d, q WHERE aqi_value >= q1 - 3.0::DOUBLE * (q3 - q1) AND aqi_value <= q3 + 3.0::DOUBLE * (q3 - q1)
), q2 AS (SELECT quantile_cont(CAST(traffic_level AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(traffic_level AS DOUBLE), 0.75) AS q3 FROM one)
SELECT {_READING} FROM one, q2 WHERE traffic_level >= q1 - 3.0::DOUBLE * (q3 - q1) AND traffic_level <= q3 + 3.0::DOUBLE * (q3 - q1)
""")
def iqr_filter(spark, sf):
    return cleaning.iqr_filter(dirty_readings(spark, sf), ["aqi_value", "traffic_level"])


@query("iqr_filter_prices", """
, q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem)
SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem, q
WHERE l_extendedprice >= q1 - 0.5::DOUBLE * (q3 - q1) AND l_extendedprice <= q3 + 0.5::DOUBLE * (q3 - q1)
""")
def iqr_filter_prices(spark, sf):
    """F9 on a measure with very many distinct values."""
    items = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return cleaning.iqr_filter(items, ["l_extendedprice"], k=0.5)


@query("iqr_filter_parts", """
, q AS (SELECT quantile_cont(l_partkey::DOUBLE, 0.25) AS q1, quantile_cont(l_partkey::DOUBLE, 0.75) AS q3 FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem, q
WHERE l_partkey >= q1 - 0.25::DOUBLE * (q3 - q1) AND l_partkey <= q3 + 0.25::DOUBLE * (q3 - q1)
""")
def iqr_filter_parts(spark, sf):
    """F9 on an integer measure with many distinct values."""
    items = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("l_orderkey", "l_linenumber", "CAST(l_partkey AS INT) AS l_partkey")
    return cleaning.iqr_filter(items, ["l_partkey"], k=0.25)


@query("clean_data", _DEDUPED + f"SELECT {_READING} FROM clean")
def clean_data(spark, sf):
    return cleaning.clean_data(dirty_readings(spark, sf))


@query("cleaning_counters", _DEDUPED + """
, n AS (
  SELECT (SELECT count(*) FROM dirty_readings) AS total, (SELECT count(*) FROM deduped) AS n0,
    (SELECT count(*) FROM deduped WHERE latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180) AS n1,
    (SELECT count(*) FROM deduped WHERE latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 AND aqi_value >= 0) AS n2,
    (SELECT count(*) FROM valid) AS n3, (SELECT count(*) FROM clean) AS n4
)
SELECT 'duplicates' AS step, total - n0 AS removed FROM n UNION ALL SELECT 'coordinates', n0 - n1 FROM n
UNION ALL SELECT 'aqi', n1 - n2 FROM n UNION ALL SELECT 'traffic', n2 - n3 FROM n UNION ALL SELECT 'outliers', n3 - n4 FROM n
""")
def cleaning_counters(spark, sf):
    return cleaning.cleaning_counters(dirty_readings(spark, sf))


def interpolate_sql(source: str, measures: list[str]) -> str:
    """Chain of CTEs that ends in ``filled``: time-weighted interpolation of each measure."""
    near, blend = [], []
    for m in measures:
        for tag, fn, frame in (
            ("p", "last_value", "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"),
            ("n", "first_value", "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"),
        ):
            for what, expr in (("v", m), ("t", f"CASE WHEN {m} IS NOT NULL THEN epoch_us(timestamp) END")):
                near.append(
                    f"{fn}({expr} IGNORE NULLS) OVER (PARTITION BY location ORDER BY timestamp, id {frame}) AS {m}_{tag}{what}"
                )
        blend.append(
            f"CAST(coalesce({m}, coalesce({m}_pv + ({m}_nv - {m}_pv) * CASE WHEN {m}_nt = {m}_pt THEN 0.0::DOUBLE ELSE "
            f"CAST(epoch_us(timestamp) - {m}_pt AS DOUBLE) / CAST({m}_nt - {m}_pt AS DOUBLE) END, {m}_pv, {m}_nv), 0) AS DOUBLE) AS {m}"
        )
    return f"""
, near AS (SELECT *, {', '.join(near)} FROM {source}),
filled AS (SELECT id, timestamp, location, latitude, longitude, {', '.join(blend)} FROM near)
"""


_M = ["aqi_value", "traffic_level"]
_FILLED = "SELECT id, timestamp, location, latitude, longitude, round(aqi_value, 6) AS aqi_value, round(traffic_level, 6) AS traffic_level FROM filled"


@query("impute_interpolate", interpolate_sql("gappy_readings", _M) + _FILLED, places=6)
def impute_interpolate(spark, sf):
    return imputation.impute_interpolate(gappy_readings(spark, sf))


def _grouped_fill(fn: str) -> str:
    fills = ", ".join(
        f"CAST(coalesce({m}, {fn}({m}) OVER (PARTITION BY location), 0) AS DOUBLE) AS {m}" for m in _M
    )
    return f", filled AS (SELECT id, timestamp, location, latitude, longitude, {fills} FROM gappy_readings)" + _FILLED


@query("impute_mean", _grouped_fill("avg"), places=6)
def impute_mean(spark, sf):
    return imputation.impute_mean(gappy_readings(spark, sf))


@query("impute_median", _grouped_fill("median"), places=6)
def impute_median(spark, sf):
    return imputation.impute_median(gappy_readings(spark, sf))


@query("impute_ffill", ", filled AS (SELECT id, timestamp, location, latitude, longitude, " + ", ".join(
    f"CAST(coalesce(last_value({m} IGNORE NULLS) OVER (PARTITION BY location ORDER BY timestamp, id "
    f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS DOUBLE) AS {m}" for m in _M
) + " FROM gappy_readings)" + _FILLED, places=6)
def impute_ffill(spark, sf):
    return imputation.impute_ffill(gappy_readings(spark, sf))
