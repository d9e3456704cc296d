"""Table schemas and the fixed values results depend on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# --- fixed values ---------------------------------------------------------------------------
# Stations: (idx, id_station, location, latitude, longitude).
STATIONS = [
    (0, "A521365", "Kebon Sirih", -6.1861, 106.8236),
    (1, "A495982", "Krukut", -6.1593, 106.8180),
    (2, "A416842", "GBK, Gelora", -6.2154, 106.8030),
    (3, "A531565", "Jakarta Timur Kebon Nanas", -6.2338, 106.8769),
    (4, "A515938", "Tangerang Benteng Betawi", -6.1756, 106.6449),
    (5, "A521380", "Kedoya Utara", -6.1714, 106.7622),
    (6, "A570235", "Grogol Utara", -6.2224, 106.7883),
    (7, "A537937", "Gunung", -6.2373, 106.7861),
    (8, "A511573", "Cinere", -6.3498, 106.7782),
    (9, "@8294", "Kemayoran", -6.1911, 106.8491),
]

# Air-quality classes: (upper bound, label, RGBA map colour, hex colour); None = no upper bound.
AQI_CLASSES = [
    (50, "Good", (76, 175, 80, 255), "#4CAF50"),
    (100, "Moderate", (255, 235, 59, 255), "#FFEB3B"),
    (150, "Unhealthy for Sensitive Groups", (255, 152, 0, 255), "#FF9800"),
    (200, "Unhealthy", (244, 67, 54, 255), "#F44336"),
    (300, "Very Unhealthy", (156, 39, 176, 255), "#9C27B0"),
    (None, "Hazardous", (126, 87, 194, 255), "#7B1FA2"),
]

# Wording of correlations: (above this size, word), the word for smaller ones; and classes of an average: (below, label), the label beyond.
CORRELATION_WORDS = [(0.7, "strong"), (0.5, "moderate"), (0.3, "weak")]
CORRELATION_SMALL = "very weak"
QUALITY_OF_MEAN = [(50, "Good"), (100, "Moderate"), (150, "Unhealthy for Sensitive Groups")]
QUALITY_BEYOND = "Unhealthy"

# Sentences of the key findings, for format_string.
FINDINGS = {
    "overall": "Average AQI is %.1f, classified as '%s'",
    "peak": "Peak pollution occurs at %d:00 with average AQI of %.1f",
    "worst": "'%s' has the highest average AQI of %.1f",
    "weekend": "Weekend AQI is %.1f points %s than weekdays",
}

# Air-quality bins of the feature table, open below and closed above: (lower, upper, label).
AQI_BINS = [
    (0, 50, "Good"),
    (50, 100, "Moderate"),
    (100, 150, "Unhealthy_Sensitive"),
    (150, 200, "Unhealthy"),
    (200, 300, "Very_Unhealthy"),
    (300, 500, "Hazardous"),
]

# Traffic map colours by level 1..5, and the colour of anything unknown.
TRAFFIC_COLORS = {
    1: (76, 175, 80, 255),
    2: (139, 195, 74, 255),
    3: (255, 235, 59, 255),
    4: (255, 152, 0, 255),
    5: (244, 67, 54, 255),
}
UNKNOWN_COLOR = (128, 128, 128, 255)

# Share of free-flow speed lost, upper bound (open) -> traffic level; beyond the last it is level 5.
SPEED_LOSS_LEVELS = [(0.1, 1), (0.3, 2), (0.5, 3), (0.7, 4)]
TOP_TRAFFIC_LEVEL = 5

# Peak hours, half open; rush hours, both ends in; time of day by last hour of each part.
PEAK_HOURS = [(6, 10), (16, 20)]
RUSH_HOURS = [(7, 9), (17, 19)]
DAY_PARTS = [(6, "night"), (12, "morning"), (18, "afternoon"), (24, "evening")]

DAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
MONTH_NAMES = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]

# Local time is UTC+7, shown with this zone mark.
LOCAL_OFFSET_HOURS = 7
LOCAL_ZONE_MARK = "WIB"

# Map centre when no reading has coordinates.
DEFAULT_CENTER = (-6.2, 106.816666)

# Display names of the data table.
DISPLAY_COLUMNS = {
    "timestamp_wib": "Timestamp (WIB)",
    "location": "Location",
    "aqi_value": "AQI Value",
    "aqi_category": "AQI Category",
    "traffic_level": "Traffic Level",
    "is_peak_hour_display": "Peak Hour",
    "latitude": "Latitude",
    "longitude": "Longitude",
}

NO_AQI_ERROR = "AQI value is None"
TOPIC = "traffic-aqi-data"
# --------------------------------------------------------------------------------------------


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


READING = _struct(
    ("id", T.LongType()),
    ("timestamp", T.TimestampType()),
    ("location", T.StringType()),
    ("latitude", T.DoubleType()),
    ("longitude", T.DoubleType()),
    ("aqi_value", T.IntegerType()),
    ("traffic_level", T.IntegerType()),
)

# The body of one stream message; the timestamp travels as ISO text.
MESSAGE = _struct(
    ("timestamp", T.StringType()),
    ("location", T.StringType()),
    ("latitude", T.DoubleType()),
    ("longitude", T.DoubleType()),
    ("aqi_value", T.IntegerType()),
    ("traffic_level", T.IntegerType()),
)

RAW_DATA = T.StructType(
    READING.fields
    + _struct(
        ("aqi_category", T.StringType()),
        ("is_peak_hour", T.BooleanType()),
        ("is_processed", T.BooleanType()),
        ("created_at", T.TimestampType()),
    ).fields
)

REALTIME_DATA = T.StructType(
    READING.fields
    + _struct(
        ("aqi_category", T.StringType()),
        ("is_peak_hour", T.BooleanType()),
        ("processing_timestamp", T.TimestampType()),
        ("is_active", T.BooleanType()),
    ).fields
)

BATCH_AGGREGATIONS = _struct(
    ("date", T.DateType()),
    ("hour", T.IntegerType()),
    ("location", T.StringType()),
    ("avg_aqi", T.DoubleType()),
    ("avg_traffic", T.DoubleType()),
    ("max_aqi", T.IntegerType()),
    ("max_traffic", T.IntegerType()),
    ("min_aqi", T.IntegerType()),
    ("min_traffic", T.IntegerType()),
    ("data_points_count", T.LongType()),
    ("is_peak_hour", T.BooleanType()),
)

PEAK_HOURS_TABLE = _struct(
    ("analysis_date", T.DateType()),
    ("peak_aqi_hour", T.IntegerType()),
    ("peak_aqi_value", T.DoubleType()),
    ("peak_aqi_location", T.StringType()),
    ("peak_traffic_hour", T.IntegerType()),
    ("peak_traffic_value", T.DoubleType()),
    ("peak_traffic_location", T.StringType()),
)

PEAK_HOURS_ANALYSIS = _struct(
    ("date", T.DateType()),
    ("hour", T.IntegerType()),
    ("location", T.StringType()),
    ("avg_traffic_level", T.DoubleType()),
    ("avg_aqi_value", T.DoubleType()),
    ("is_peak_hour", T.BooleanType()),
    ("total_records", T.LongType()),
)

METRICS_HISTORY = _struct(
    ("timestamp", T.StringType()),
    ("metrics", T.MapType(T.StringType(), T.DoubleType())),
    ("metadata", T.MapType(T.StringType(), T.StringType())),
)


def values_sql(rows: list[tuple], names: list[str]) -> str:
    """A literal relation as SQL text; Spark plans it as a local relation, so its size is known."""
    body = ",".join("(" + ",".join(repr(cell) for cell in row) + ")" for row in rows)
    return f"SELECT * FROM VALUES {body} AS t({','.join(names)})"


def stations(spark: SparkSession) -> DataFrame:
    """The station dimension."""
    sql = values_sql(STATIONS, ["idx", "id_station", "location", "latitude", "longitude"])
    return spark.sql(sql).selectExpr(
        "idx", "id_station", "location",
        "cast(latitude as double) latitude", "cast(longitude as double) longitude",
    )
