"""Registry, input projections of the given tables, and the same projections as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cityflux import schemas
from cityflux.operators import rollups
from cityflux.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

AS_OF = "2024-01-31 00:00:00"


def query(name: str, sql: str | None = None, places: int | None = None):
    """Register a query. Results are made plain: whole numbers as bigint, dates as text.

    ``places`` rounds every double on the Spark side; the SQL twin rounds for itself.
    """

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plain(fn(tune(spark), sf_dir), places)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = CTES + sql.strip()
        return fn

    return wrap


def plain(df: DataFrame, places: int | None = None) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("long")
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        elif isinstance(f.dataType, T.DoubleType) and places is not None:
            # Adding zero turns a negative zero into zero.
            c = F.round(c, places) + F.lit(0.0)
        cols.append(c.alias(f.name))
    return df.select(*cols)


# --- inputs: projections of the events table ------------------------------------------------


def events(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet")


def with_station(spark: SparkSession, sf: str) -> DataFrame:
    """Events with the station they stand for; the ten literal stations are sent to every task."""
    e = events(spark, sf).withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return e.join(F.broadcast(schemas.stations(spark)), F.col("idx") == F.col("user_id") % 10)


def readings(spark: SparkSession, sf: str) -> DataFrame:
    return with_station(spark, sf).select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp_ntz").alias("timestamp"), "location",
        "latitude", "longitude",
        F.floor("value").cast("int").alias("aqi_value"), (F.lit(1) + F.col("k") % 5).alias("traffic_level"),
    )


def dirty_readings(spark: SparkSession, sf: str) -> DataFrame:
    """Readings with bad coordinates, missing and negative index, bad level, and copies."""
    r = readings(spark, sf)
    i = F.col("id")
    spoiled = r.withColumns(
        {
            "latitude": F.when(i % 101 == 0, 999.0).otherwise(F.col("latitude")),
            "aqi_value": F.when(i % 31 == 0, None).when(i % 97 == 0, -1).otherwise(F.col("aqi_value")),
            "traffic_level": F.when(i % 89 == 0, 9).when(i % 83 == 0, None).otherwise(F.col("traffic_level")),
        }
    )
    copies = r.filter(i % 50 == 0).withColumns({"id": i + 10_000_000, "aqi_value": F.col("aqi_value") + 1})
    return spoiled.unionByName(copies)


def gappy_readings(spark: SparkSession, sf: str) -> DataFrame:
    """Valid readings with gaps in both measures, for imputation."""
    i = F.col("id")
    return readings(spark, sf).withColumns(
        {
            "aqi_value": F.when(i % 3 == 0, None).otherwise(F.col("aqi_value")),
            "traffic_level": F.when(i % 4 == 1, None).otherwise(F.col("traffic_level")),
        }
    )


def realtime(spark: SparkSession, sf: str) -> DataFrame:
    return readings(spark, sf).withColumn("is_active", F.col("id") % 13 != 0)


def payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Raw payload texts: missing object, no free flow, error status, text index, well formed."""
    i, k = F.col("event_id"), F.col("k")
    flow = F.concat(F.lit('{"flowSegmentData":{"freeFlowSpeed":100,"currentSpeed":'), (F.lit(100) - k).cast("string"), F.lit("}}"))
    air = F.concat(F.lit('{"status":"ok","data":{"aqi":'), F.floor("value").cast("int").cast("string"), F.lit("}}"))
    return with_station(spark, sf).select(
        i.alias("id"), F.col("ts").cast("timestamp_ntz").alias("timestamp"), "location",
        F.when(i % 41 == 0, '{"error":"x"}')
        .when(i % 43 == 0, '{"flowSegmentData":{"freeFlowSpeed":0,"currentSpeed":10}}')
        .otherwise(flow).alias("traffic_json"),
        F.when(i % 37 == 0, '{"status":"error","data":"x"}')
        .when(i % 29 == 0, '{"status":"ok","data":{"aqi":"-"}}')
        .otherwise(air).alias("aqi_json"),
    )


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """True and predicted values and classes derived from readings."""
    i, a, lv = F.col("id"), F.col("aqi_value"), F.col("traffic_level")
    return readings(spark, sf).select(
        "id", a.cast("double").alias("y_true"), (a + (i * 7) % 21 - 10).cast("double").alias("y_pred"),
        lv.alias("c_true"), F.when(i % 6 == 0, 1 + lv % 5).otherwise(lv).alias("c_pred"),
    )


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """Per reading and class: whether it is the class, and a score, with many ties."""
    p = predictions(spark, sf).select("id", "c_true", "c_pred", F.explode(F.array(*[F.lit(c) for c in range(1, 6)])).alias("class"))
    noise = F.expr("pmod(id * 31 + class * 17, 40)") / F.lit(100.0)
    return p.select(
        "id", "class", (F.col("c_true") == F.col("class")).cast("int").alias("label"),
        (F.when(F.col("c_pred") == F.col("class"), 0.5).otherwise(0.2) + noise).alias("score"),
    )


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.hourly_aggregation(readings(spark, sf))


def analysis_table(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.hourly_analysis(rollups.hourly_state(readings(spark, sf)))


# --- the same as SQL ------------------------------------------------------------------------

_STATION_ROWS = ",".join(f"({i},'{s}','{n}',{la},{lo})" for i, s, n, la, lo in schemas.STATIONS)
_PEAK = "((hour >= 6 AND hour < 10) OR (hour >= 16 AND hour < 20))"

CTES = f"""
WITH stations AS (
  SELECT * FROM (VALUES {_STATION_ROWS}) AS s(idx, id_station, location, latitude, longitude)
), joined AS (
  SELECT e.*, s.location, CAST(s.latitude AS DOUBLE) AS latitude, CAST(s.longitude AS DOUBLE) AS longitude,
         CAST(json_extract_string(e.props, '$.k') AS INT) AS k
  FROM events e JOIN stations s ON s.idx = e.user_id % 10
), readings AS (
  SELECT event_id AS id, ts AS timestamp, location, latitude, longitude,
         CAST(floor(value) AS INT) AS aqi_value, 1 + (k % 5) AS traffic_level
  FROM joined
), dirty_readings AS (
  SELECT id, timestamp, location,
         CASE WHEN id % 101 = 0 THEN 999.0::DOUBLE ELSE latitude END AS latitude, longitude,
         CASE WHEN id % 31 = 0 THEN NULL WHEN id % 97 = 0 THEN -1 ELSE aqi_value END AS aqi_value,
         CASE WHEN id % 89 = 0 THEN 9 WHEN id % 83 = 0 THEN NULL ELSE traffic_level END AS traffic_level
  FROM readings
  UNION ALL
  SELECT id + 10000000, timestamp, location, latitude, longitude, aqi_value + 1, traffic_level
  FROM readings WHERE id % 50 = 0
), gappy_readings AS (
  SELECT id, timestamp, location, latitude, longitude,
         CASE WHEN id % 3 = 0 THEN NULL ELSE aqi_value END AS aqi_value,
         CASE WHEN id % 4 = 1 THEN NULL ELSE traffic_level END AS traffic_level
  FROM readings
), realtime AS (
  SELECT *, id % 13 <> 0 AS is_active FROM readings
), payloads AS (
  SELECT event_id AS id, ts AS timestamp, location,
    CASE WHEN event_id % 41 = 0 THEN '{{"error":"x"}}'
         WHEN event_id % 43 = 0 THEN '{{"flowSegmentData":{{"freeFlowSpeed":0,"currentSpeed":10}}}}'
         ELSE concat('{{"flowSegmentData":{{"freeFlowSpeed":100,"currentSpeed":', CAST(100 - k AS VARCHAR), '}}}}') END AS traffic_json,
    CASE WHEN event_id % 37 = 0 THEN '{{"status":"error","data":"x"}}'
         WHEN event_id % 29 = 0 THEN '{{"status":"ok","data":{{"aqi":"-"}}}}'
         ELSE concat('{{"status":"ok","data":{{"aqi":', CAST(CAST(floor(value) AS INT) AS VARCHAR), '}}}}') END AS aqi_json
  FROM joined
), predictions AS (
  SELECT id, CAST(aqi_value AS DOUBLE) AS y_true, CAST(aqi_value + ((id * 7) % 21) - 10 AS DOUBLE) AS y_pred,
         traffic_level AS c_true, CASE WHEN id % 6 = 0 THEN 1 + (traffic_level % 5) ELSE traffic_level END AS c_pred
  FROM readings
), scores AS (
  SELECT id, class, CASE WHEN c_true = class THEN 1 ELSE 0 END AS label,
         (CASE WHEN c_pred = class THEN 0.5::DOUBLE ELSE 0.2::DOUBLE END)
           + CAST((id * 31 + class * 17) % 40 AS DOUBLE) / 100.0::DOUBLE AS score
  FROM predictions, (SELECT unnest([1, 2, 3, 4, 5]) AS class)
), hourly AS (
  SELECT *, {_PEAK} AS is_peak_hour FROM (
    SELECT CAST(timestamp AS DATE) AS date, hour(timestamp) AS hour, location,
           avg(aqi_value) AS avg_aqi, avg(traffic_level) AS avg_traffic,
           max(aqi_value) AS max_aqi, max(traffic_level) AS max_traffic,
           min(aqi_value) AS min_aqi, min(traffic_level) AS min_traffic, count(*) AS data_points_count
    FROM readings GROUP BY 1, 2, 3)
), analysis AS (
  SELECT date, hour, location, avg_traffic AS avg_traffic_level, avg_aqi AS avg_aqi_value, is_peak_hour,
         data_points_count AS total_records
  FROM hourly
)
"""
