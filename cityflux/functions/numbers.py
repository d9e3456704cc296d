"""Numeric rules: traffic level from speeds, safe casts, rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cityflux.schemas import SPEED_LOSS_LEVELS, TOP_TRAFFIC_LEVEL


def traffic_level(free_flow: Column, current: Column) -> Column:
    """C4: level 1..5 from the share of free-flow speed lost; no free flow means level 1."""
    lost = F.try_divide((free_flow - current).cast("double"), free_flow.cast("double"))
    expr = F.when(free_flow <= 0, 1)
    for bound, level in SPEED_LOSS_LEVELS:
        expr = expr.when(lost < bound, level)
    return expr.otherwise(TOP_TRAFFIC_LEVEL)


def normalize_aqi(value: Column) -> Column:
    """Whole number, 0 when missing or not a number."""
    return F.coalesce(value.try_cast("int"), F.lit(0))


def round_to_int(value: Column) -> Column:
    """C14: nearest whole number, halves away from zero."""
    return F.round(value, 0).cast("int")


def to_number(value: Column) -> Column:
    """double, or NULL when the text is not a number; NaN becomes NULL."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number), number)


def ratio(num: Column, den: Column) -> Column:
    """num / den as double, 0 when the denominator is 0 or NULL."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))
