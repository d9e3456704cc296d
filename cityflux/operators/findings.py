"""Key findings in words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cityflux.functions.categories import overall_quality
from cityflux.operators.describe import weekend_effect
from cityflux.schemas import FINDINGS


def _row(order: int, category: str, finding: Column, severity: Column) -> list[Column]:
    return [F.lit(order).alias("ord"), F.lit(category).alias("category"), finding.alias("finding"), severity.alias("severity")]


def key_findings(df: DataFrame, aqi: str = "aqi_value", weekend_floor: float = 10.0) -> DataFrame:
    """Overall quality, peak hour, worst location, and the weekend effect when it is large."""
    known = df.filter(F.col(aqi).isNotNull())
    overall = known.agg(F.avg(aqi).alias("a")).filter(F.col("a").isNotNull())
    hours = known.groupBy(F.hour("timestamp").alias("h")).agg(F.avg(aqi).alias("a"))
    places = known.groupBy("location").agg(F.avg(aqi).alias("a"))
    weekend = weekend_effect(df, [aqi]).filter(F.abs("difference") > weekend_floor)
    a, medium = F.col("a"), F.lit("medium")
    first = overall.select(
        *_row(
            1, "Air Quality",
            F.format_string(FINDINGS["overall"], a, overall_quality(a)),
            F.when(a > 100, "high").otherwise("medium"),
        )
    )
    second = hours.orderBy(a.desc(), "h").limit(1).select(
        *_row(2, "Temporal Pattern", F.format_string(FINDINGS["peak"], "h", a), medium)
    )
    third = places.orderBy(a.desc(), "location").limit(1).select(
        *_row(3, "Spatial Pattern", F.format_string(FINDINGS["worst"], "location", a), F.lit("high"))
    )
    d = F.col("difference")
    way = F.when(d > 0, "higher").otherwise("lower")
    fourth = weekend.select(
        *_row(4, "Temporal Pattern", F.format_string(FINDINGS["weekend"], F.abs(d), way), medium)
    )
    return first.unionByName(second).unionByName(third).unionByName(fourth)
