"""Air-quality classes, bins and colours; wording of scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cityflux.schemas import (
    AQI_BINS, AQI_CLASSES, CORRELATION_SMALL, CORRELATION_WORDS, QUALITY_BEYOND, QUALITY_OF_MEAN, TRAFFIC_COLORS, UNKNOWN_COLOR,
)


def _by_upper_bound(value: Column, steps: list[tuple], missing: Column) -> Column:
    """The first output whose upper bound holds the value; a None bound takes the rest."""
    expr = F.when(value.isNull(), missing)
    for bound, out in steps:
        expr = expr.otherwise(out) if bound is None else expr.when(value <= bound, out)
    return expr


def _rgba(parts: tuple) -> Column:
    return F.array(*[F.lit(p) for p in parts])


def aqi_category(value: Column) -> Column:
    """Six-class label; NULL stays NULL."""
    return _by_upper_bound(value, [(b, F.lit(name)) for b, name, _, _ in AQI_CLASSES], F.lit(None).cast("string"))


def aqi_category_ingest(value: Column) -> Column:
    """The label stored at ingestion, where NULL and 0 both read as 'Unknown'."""
    return F.when(value.isNull() | (value == 0), "Unknown").otherwise(aqi_category(value))


def aqi_bin(value: Column) -> Column:
    """Right-closed bins; 0, negatives and values past the last bin give NULL."""
    expr = F.lit(None).cast("string")
    for low, high, name in reversed(AQI_BINS):
        expr = F.when((value > low) & (value <= high), name).otherwise(expr)
    return expr


def aqi_color(value: Column) -> Column:
    """RGBA by class of the whole part, grey when missing."""
    return _by_upper_bound(value.cast("int"), [(b, _rgba(rgba)) for b, _, rgba, _ in AQI_CLASSES], _rgba(UNKNOWN_COLOR))


def aqi_hex(value: Column) -> Column:
    """Hex colour by class."""
    return _by_upper_bound(value, [(b, F.lit(code)) for b, _, _, code in AQI_CLASSES], F.lit(None).cast("string"))


def traffic_color(level: Column) -> Column:
    """C17: RGBA by level, its whole part, grey when missing or out of range."""
    expr, level = None, level.cast("int")
    for key, rgba in TRAFFIC_COLORS.items():
        expr = (F if expr is None else expr).when(level == key, _rgba(rgba))
    return expr.otherwise(_rgba(UNKNOWN_COLOR))


def int_label(value: Column) -> Column:
    """Whole number as text, empty when missing."""
    return F.coalesce(value.cast("int").cast("string"), F.lit(""))


def yes_no(flag: Column) -> Column:
    """C20: Yes / No; missing counts as No."""
    return F.when(flag, "Yes").otherwise("No")


def correlation_wording(r: Column) -> Column:
    """Strength and direction of a correlation."""
    size = F.abs(r)
    strength = F.lit(CORRELATION_SMALL)
    for floor, word in reversed(CORRELATION_WORDS):
        strength = F.when(size > floor, word).otherwise(strength)
    direction = F.when(r > 0, "positive").otherwise("negative")
    return F.when(r.isNotNull(), F.concat_ws(" ", strength, direction, F.lit("correlation")))


def overall_quality(mean_aqi: Column) -> Column:
    """Class of an average, bounds open above."""
    label = F.lit(QUALITY_BEYOND)
    for bound, name in reversed(QUALITY_OF_MEAN):
        label = F.when(mean_aqi < bound, name).otherwise(label)
    return F.when(mean_aqi.isNull(), QUALITY_BEYOND).otherwise(label)
