"""Descriptive statistics and findings."""

from __future__ import annotations

from cityflux import schemas
from cityflux.operators import describe, findings
from cityflux.registry.base import analysis_table, dirty_readings, hourly, query, readings, realtime

_M = ["aqi_value", "traffic_level"]


def _each(template: str, measures=tuple(_M)) -> str:
    return " UNION ALL ".join(template.replace("{m}", m) for m in measures)


@query("dataset_info", """
SELECT count(*) AS total_records, min(timestamp) AS start, max(timestamp) AS "end", count(DISTINCT location) AS locations,
       (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) // 86400000000 AS duration_days FROM readings
""")
def dataset_info(spark, sf):
    return describe.dataset_info(readings(spark, sf))


@query("distinct_locations", "SELECT DISTINCT location FROM dirty_readings")
def distinct_locations(spark, sf):
    return describe.distinct_locations(dirty_readings(spark, sf))


@query("summary_statistics", _each("""
SELECT '{m}' AS measure, round(avg({m}), 6) AS mean, round(median({m}), 6) AS median, round(stddev_samp({m}), 6) AS std,
  CAST(min({m}) AS DOUBLE) AS min, CAST(max({m}) AS DOUBLE) AS max, round(quantile_cont(CAST({m} AS DOUBLE), 0.25), 6) AS q25,
  round(quantile_cont(CAST({m} AS DOUBLE), 0.75), 6) AS q75,
  round(quantile_cont(CAST({m} AS DOUBLE), 0.75) - quantile_cont(CAST({m} AS DOUBLE), 0.25), 6) AS iqr,
  (SELECT CAST({m} AS DOUBLE) FROM dirty_readings WHERE {m} IS NOT NULL GROUP BY {m} ORDER BY count(*) DESC, {m} LIMIT 1) AS mode
FROM dirty_readings"""), places=6)
def summary_statistics(spark, sf):
    return describe.summary_statistics(dirty_readings(spark, sf))


@query("shape_statistics", _each("""
SELECT '{m}' AS measure, round(skewness({m}), 6) AS skewness, round(kurtosis({m}), 6) AS kurtosis FROM dirty_readings"""), places=6)
def shape_statistics(spark, sf):
    return describe.shape_statistics(dirty_readings(spark, sf))


@query("missing_profile", _each("""
SELECT '{m}' AS column_name, count(*) - count({m}) AS missing, round(CAST(count(*) - count({m}) AS DOUBLE) / count(*) * 100, 6) AS missing_pct
FROM dirty_readings""", ("id", "timestamp", "location", "latitude", "longitude", "aqi_value", "traffic_level")), places=6)
def missing_profile(spark, sf):
    return describe.missing_profile(dirty_readings(spark, sf))


@query("traffic_distribution", "SELECT traffic_level, count(*) AS n FROM readings GROUP BY 1")
def traffic_distribution(spark, sf):
    return describe.traffic_distribution(readings(spark, sf))


@query("aqi_category_distribution", " UNION ALL ".join(
    f"SELECT '{n}' AS category, count(*) FILTER (WHERE aqi_value > {lo} AND aqi_value <= {hi}) AS n FROM readings"
    for lo, hi, n in schemas.AQI_BINS
))
def aqi_category_distribution(spark, sf):
    return describe.aqi_category_distribution(readings(spark, sf))


@query("aqi_label_distribution", """
SELECT CASE WHEN aqi_value <= 50 THEN 'Good' WHEN aqi_value <= 100 THEN 'Moderate' WHEN aqi_value <= 150 THEN 'Unhealthy for Sensitive Groups'
  WHEN aqi_value <= 200 THEN 'Unhealthy' WHEN aqi_value <= 300 THEN 'Very Unhealthy' ELSE 'Hazardous' END AS category, count(*) AS n
FROM readings GROUP BY 1
""")
def aqi_label_distribution(spark, sf):
    return describe.aqi_category_distribution(readings(spark, sf), binned=False)


@query("hourly_pattern", _each("""
SELECT '{m}' AS measure, hour, round(mean, 6) AS mean, round(std, 6) AS std, lo AS min, hi AS max,
  row_number() OVER (ORDER BY mean DESC, hour) = 1 AS is_peak, row_number() OVER (ORDER BY mean, hour) = 1 AS is_lowest
FROM (SELECT hour(timestamp) AS hour, avg({m}) AS mean, stddev_samp({m}) AS std, CAST(min({m}) AS DOUBLE) AS lo, CAST(max({m}) AS DOUBLE) AS hi
      FROM readings GROUP BY 1)"""), places=6)
def hourly_pattern(spark, sf):
    return describe.hourly_pattern(readings(spark, sf))


_DAYS = ",".join(f"({i},'{n}')" for i, n in enumerate(schemas.DAY_NAMES))
_MONTHS = ",".join(f"({i},'{n}')" for i, n in enumerate(schemas.MONTH_NAMES, 1))


@query("dow_pattern", f", d AS (SELECT * FROM (VALUES {_DAYS}) AS v(i, day_name))" + _each("""
SELECT '{m}' AS measure, day_name, coalesce(mean, 0) AS mean FROM d
LEFT JOIN (SELECT isodow(timestamp) - 1 AS i, avg({m}) AS mean FROM readings GROUP BY 1) x ON d.i = x.i"""))
def dow_pattern(spark, sf):
    return describe.dow_pattern(readings(spark, sf))


@query("month_pattern", f", d AS (SELECT * FROM (VALUES {_MONTHS}) AS v(i, month_name))" + _each("""
SELECT month_name, '{m}' AS measure, mean FROM d
JOIN (SELECT month(timestamp) AS i, avg({m}) AS mean FROM readings GROUP BY 1) x ON d.i = x.i"""))
def month_pattern(spark, sf):
    return describe.month_pattern(readings(spark, sf), _M)


@query("weekend_effect", _each("""
SELECT '{m}' AS measure, round(wd, 6) AS weekday, round(we, 6) AS weekend, round(we - wd, 6) AS difference FROM (
  SELECT coalesce(avg({m}) FILTER (WHERE isodow(timestamp) < 6), 0) AS wd, coalesce(avg({m}) FILTER (WHERE isodow(timestamp) >= 6), 0) AS we
  FROM readings)"""), places=6)
def weekend_effect(spark, sf):
    return describe.weekend_effect(readings(spark, sf))


@query("rush_hours", """
, busy AS (SELECT id, timestamp, CASE WHEN hour(timestamp) BETWEEN 7 AND 9 OR hour(timestamp) BETWEEN 17 AND 19
                                  THEN least(traffic_level + 2, 5) ELSE traffic_level END AS traffic_level FROM readings)
SELECT hour, mean_traffic, threshold FROM (
  SELECT hour(timestamp) AS hour, avg(traffic_level) AS mean_traffic,
         (SELECT quantile_cont(CAST(traffic_level AS DOUBLE), 0.75) FROM busy) AS threshold FROM busy GROUP BY 1)
WHERE mean_traffic >= threshold
""")
def rush_hours(spark, sf):
    from pyspark.sql import functions as F

    from cityflux.functions.times import is_rush_hour

    rush = is_rush_hour(F.hour("timestamp")) == 1
    busier = F.when(rush, F.least(F.col("traffic_level") + 2, F.lit(5))).otherwise(F.col("traffic_level"))
    return describe.rush_hours(readings(spark, sf).withColumn("traffic_level", busier))


@query("location_stats", """
SELECT location, count(*) AS total_records, round(avg(latitude), 6) AS latitude, round(avg(longitude), 6) AS longitude,
  round(avg(aqi_value), 6) AS aqi_mean, round(stddev_samp(aqi_value), 6) AS aqi_std, CAST(min(aqi_value) AS DOUBLE) AS aqi_min,
  CAST(max(aqi_value) AS DOUBLE) AS aqi_max, round(avg(traffic_level), 6) AS traffic_mean, round(stddev_samp(traffic_level), 6) AS traffic_std,
  CAST(min(traffic_level) AS DOUBLE) AS traffic_min, CAST(max(traffic_level) AS DOUBLE) AS traffic_max,
  round(median(aqi_value), 6) AS aqi_median, round(median(traffic_level), 6) AS traffic_median
FROM dirty_readings GROUP BY location
""", places=6)
def location_stats(spark, sf):
    return describe.location_stats(dirty_readings(spark, sf))


_RANK = ", ranked AS (" + _each("""
SELECT '{m}' AS measure, location, avg({m}) AS mean, row_number() OVER (ORDER BY avg({m}) DESC, location) AS rank,
       row_number() OVER (ORDER BY avg({m}), location DESC) AS low FROM readings GROUP BY location""") + ")"


@query("location_ranking", _RANK + "SELECT measure, location, mean, rank FROM ranked")
def location_ranking(spark, sf):
    return describe.location_ranking(readings(spark, sf))


@query("hotspots", _RANK + """
SELECT measure, 'highest' AS side, rank, location, mean FROM ranked WHERE rank <= 3
UNION ALL SELECT measure, 'lowest', low, location, mean FROM ranked WHERE low <= 3
""")
def hotspots(spark, sf):
    return describe.hotspots(readings(spark, sf))


_COLS = ["aqi_value", "traffic_level", "latitude", "longitude", "hour", "month", "interaction"]
_PAIRS = [tuple(sorted((a, b))) for i, a in enumerate(_COLS) for b in _COLS[i + 1:]]
_MATRIX = """
, f AS (SELECT *, hour(timestamp) AS hour, month(timestamp) AS month, aqi_value * traffic_level AS interaction FROM gappy_readings)
, matrix AS (""" + " UNION ALL ".join(
    f"SELECT '{a}' AS variable1, '{b}' AS variable2, round(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0), 6) AS correlation "
    f"FROM (SELECT CAST({a} AS DOUBLE) AS x, CAST({b} AS DOUBLE) AS y FROM f WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
    for a, b in _PAIRS
) + ")"


def _matrix(spark, sf):
    from pyspark.sql import functions as F

    from cityflux.registry.base import gappy_readings

    f = gappy_readings(spark, sf).withColumns(
        {"hour": F.hour("timestamp"), "month": F.month("timestamp"), "interaction": F.col("aqi_value") * F.col("traffic_level")}
    )
    return describe.correlation_matrix(f, _COLS)


@query("correlation_matrix", _MATRIX + "SELECT * FROM matrix", places=6)
def correlation_matrix(spark, sf):
    return _matrix(spark, sf)


_WIDE = {
    "aqi_value": "aqi_value", "traffic_level": "traffic_level", "hour": "hour(timestamp)", "month": "month(timestamp)", "interaction": "aqi_value * traffic_level",
    "latitude": "latitude", "longitude": "longitude", "nothing": "CAST(NULL AS DOUBLE)", "almost": "CASE WHEN id = 1 THEN 1.0 ELSE 0.0 END",
    "day": "day(timestamp)", "parity": "id % 2",
}
_WIDE_PAIRS = [tuple(sorted((a, b))) for i, a in enumerate(_WIDE) for b in list(_WIDE)[i + 1 :]]


@query("correlation_matrix_wide", ", f AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in _WIDE.items()) + " FROM gappy_readings) " + " UNION ALL ".join(
    f"SELECT '{a}' AS variable1, '{b}' AS variable2, round(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0), 6) + 0.0 AS correlation "
    f"FROM (SELECT CAST({a} AS DOUBLE) AS x, CAST({b} AS DOUBLE) AS y FROM f WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
    for a, b in _WIDE_PAIRS
), places=6)
def correlation_matrix_wide(spark, sf):
    """A22 over more pairs than one pass takes, with an empty and a nearly constant column."""
    from cityflux.registry.base import gappy_readings

    return describe.correlation_matrix(gappy_readings(spark, sf).selectExpr(*[f"{e} AS {c}" for c, e in _WIDE.items()]), list(_WIDE))


_WORDS = """CASE WHEN abs(correlation) > 0.7 THEN 'strong' WHEN abs(correlation) > 0.5 THEN 'moderate' WHEN abs(correlation) > 0.3 THEN 'weak'
  ELSE 'very weak' END || CASE WHEN correlation > 0 THEN ' positive correlation' ELSE ' negative correlation' END"""


@query("strong_correlations", _MATRIX + f"""
SELECT variable1, variable2, correlation, CASE WHEN abs(correlation) > 0.7 THEN 'strong' ELSE 'moderate' END AS strength,
       {_WORDS} AS interpretation FROM matrix WHERE abs(correlation) > 0.5
""", places=6)
def strong_correlations(spark, sf):
    return describe.strong_correlations(_matrix(spark, sf))


@query("correlation_insight", _MATRIX + f"""
SELECT 'AQI-Traffic Correlation' AS insight, correlation AS value, {_WORDS} AS interpretation
FROM matrix WHERE variable1 = 'aqi_value' AND variable2 = 'traffic_level'
""", places=6)
def correlation_insight(spark, sf):
    return describe.correlation_insight(_matrix(spark, sf))


@query("anomalies_iqr", _each("""
SELECT '{m}' AS measure, round(any_value(lower), 6) AS lower, round(any_value(upper), 6) AS upper, count(*) FILTER (WHERE odd) AS count,
  round(CAST(count(*) FILTER (WHERE odd) AS DOUBLE) / count(*) * 100, 6) AS percentage,
  coalesce((SELECT string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) FROM (
     SELECT id FROM (SELECT id, {m} AS v FROM dirty_readings), (
       SELECT quantile_cont(CAST({m} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({m} AS DOUBLE), 0.75) AS q3 FROM dirty_readings)
     WHERE v < q1 - 1.5::DOUBLE * (q3 - q1) OR v > q3 + 1.5::DOUBLE * (q3 - q1) ORDER BY id LIMIT 10)), '') AS first_ids
FROM (SELECT lower, upper, coalesce({m} < lower OR {m} > upper, FALSE) AS odd FROM dirty_readings, (
  SELECT q1 - 1.5::DOUBLE * (q3 - q1) AS lower, q3 + 1.5::DOUBLE * (q3 - q1) AS upper FROM (
    SELECT quantile_cont(CAST({m} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({m} AS DOUBLE), 0.75) AS q3 FROM dirty_readings)))"""), places=6)
def anomalies_iqr(spark, sf):
    return describe.anomalies_iqr(dirty_readings(spark, sf))


@query("anomalies_zscore", _each("""
SELECT '{m}' AS measure, round(any_value(mean), 6) AS mean, round(any_value(std), 6) AS std, count(*) FILTER (WHERE odd) AS count,
  round(CAST(count(*) FILTER (WHERE odd) AS DOUBLE) / count(*) * 100, 6) AS percentage,
  coalesce((SELECT string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) FROM (
     SELECT id FROM dirty_readings, (SELECT avg({m}) AS a, stddev_samp({m}) AS s FROM dirty_readings)
     WHERE abs(({m} - a) / nullif(s, 0)) > 3 ORDER BY id LIMIT 10)), '') AS first_ids
FROM (SELECT mean, std, coalesce(abs(({m} - mean) / nullif(std, 0)) > 3, FALSE) AS odd FROM dirty_readings, (
  SELECT avg({m}) AS mean, stddev_samp({m}) AS std FROM dirty_readings))"""), places=6)
def anomalies_zscore(spark, sf):
    return describe.anomalies_zscore(dirty_readings(spark, sf))


@query("total_anomalies", """
SELECT sum(n)::BIGINT AS total_anomalies FROM (""" + " UNION ALL ".join(f"""
  SELECT count(*) AS n FROM dirty_readings, (SELECT quantile_cont(CAST({m} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({m} AS DOUBLE), 0.75) AS q3 FROM dirty_readings)
  WHERE {m} < q1 - 1.5::DOUBLE * (q3 - q1) OR {m} > q3 + 1.5::DOUBLE * (q3 - q1)""" for m in ("aqi_value", "traffic_level")) + ")")
def total_anomalies(spark, sf):
    return describe.total_anomalies(describe.anomalies_iqr(dirty_readings(spark, sf)))


@query("map_center", "SELECT round(avg(latitude), 6) AS latitude, round(avg(longitude), 6) AS longitude FROM readings", places=6)
def map_center(spark, sf):
    return describe.map_center(readings(spark, sf))


@query("table_counts", """
SELECT 'raw_data' AS table_name, count(*) AS n FROM readings UNION ALL SELECT 'realtime_data', count(*) FROM realtime
UNION ALL SELECT 'batch_aggregations', count(*) FROM hourly UNION ALL SELECT 'peak_hours_analysis', count(*) FROM analysis
""")
def table_counts(spark, sf):
    return describe.table_counts({
        "raw_data": readings(spark, sf), "realtime_data": realtime(spark, sf),
        "batch_aggregations": hourly(spark, sf), "peak_hours_analysis": analysis_table(spark, sf),
    })


FINDINGS_SQL = """
, m AS (SELECT avg(aqi_value) AS a FROM readings),
h AS (SELECT hour(timestamp) AS hour, avg(aqi_value) AS a FROM readings GROUP BY 1 ORDER BY a DESC, hour LIMIT 1),
l AS (SELECT location, avg(aqi_value) AS a FROM readings GROUP BY 1 ORDER BY a DESC, location LIMIT 1),
w AS (SELECT avg(aqi_value) FILTER (WHERE isodow(timestamp) >= 6) - avg(aqi_value) FILTER (WHERE isodow(timestamp) < 6) AS d FROM readings)
SELECT 1 AS ord, 'Air Quality' AS category, 'Average AQI is ' || printf('%.1f', a) || ', classified as ''' ||
  CASE WHEN a < 50 THEN 'Good' WHEN a < 100 THEN 'Moderate' WHEN a < 150 THEN 'Unhealthy for Sensitive Groups' ELSE 'Unhealthy' END || '''' AS finding,
  CASE WHEN a > 100 THEN 'high' ELSE 'medium' END AS severity FROM m
UNION ALL SELECT 2, 'Temporal Pattern', 'Peak pollution occurs at ' || hour || ':00 with average AQI of ' || printf('%.1f', a), 'medium' FROM h
UNION ALL SELECT 3, 'Spatial Pattern', '''' || location || ''' has the highest average AQI of ' || printf('%.1f', a), 'high' FROM l
UNION ALL SELECT 4, 'Temporal Pattern', 'Weekend AQI is ' || printf('%.1f', abs(d)) || ' points ' || CASE WHEN d > 0 THEN 'higher' ELSE 'lower' END
  || ' than weekdays', 'medium' FROM w WHERE abs(d) > 10
"""


@query("key_findings", FINDINGS_SQL)
def key_findings(spark, sf):
    return findings.key_findings(readings(spark, sf))
