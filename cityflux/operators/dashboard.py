"""Display-ready frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cityflux.functions.categories import aqi_category, aqi_color, int_label, traffic_color, yes_no
from cityflux.functions.numbers import to_number
from cityflux.functions.times import format_local_time, format_time, to_local
from cityflux.operators.cleaning import dropna_coords
from cityflux.schemas import DISPLAY_COLUMNS


def map_points(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Two map points per reading, one for the index and one for the level, from one pass."""
    points = []
    for kind, col, color in (("aqi", "aqi_value", aqi_color), ("traffic", "traffic_level", traffic_color)):
        v, rgba = F.col(col), color(F.col(col))
        points.append(
            F.struct(
                F.lit(kind).alias("kind"), v.cast("int").alias("value"), int_label(v).alias("label"),
                *[rgba[i].alias(ch) for i, ch in enumerate("rgba")],
            )
        )
    return df.select(
        *(keep or []), "location", "latitude", "longitude", format_time(F.col("timestamp")).alias("formatted_time"),
        F.inline(F.array(*points)),
    )


def dashboard_frame(view: DataFrame) -> DataFrame:
    """Numbers made safe, rows without coordinates out, local time, label and peak text."""
    numeric = [c for c in ("latitude", "longitude", "aqi_value", "traffic_level") if c in view.columns]
    out = dropna_coords(view.withColumns({c: to_number(F.col(c)) for c in numeric}))
    out = out.withColumns(
        {
            "aqi_clean": F.col("aqi_value"),
            "timestamp_wib": to_local(F.col("timestamp")),
            "formatted_time": format_local_time(F.col("timestamp")),
        }
    )
    if "aqi_category" not in out.columns:
        out = out.withColumn("aqi_category", F.coalesce(aqi_category(F.col("aqi_value").cast("int")), F.lit("Unknown")))
    if "is_peak_hour" not in out.columns:
        out = out.withColumn("is_peak_hour", F.lit(False))
    return out.withColumn("is_peak_hour_display", yes_no(F.col("is_peak_hour")))


def display_projection(df: DataFrame, names: dict[str, str] = DISPLAY_COLUMNS) -> DataFrame:
    """the display columns that exist, renamed."""
    return df.select(*[F.col(c).alias(n) for c, n in names.items() if c in df.columns])


def first_rows(display: DataFrame, n: int = 100) -> DataFrame:
    """The newest n display rows."""
    return display.orderBy(F.col("`Timestamp (WIB)`").desc(), "Location").limit(n)
