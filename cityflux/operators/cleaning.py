"""Deduplication, validity filters, outlier removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cityflux.functions.numbers import to_number
from cityflux.plans.ranks import percentiles
from cityflux.plans.scratch import materialize


def dedupe_first(df: DataFrame, keys: tuple[str, ...] = ("timestamp", "location"), tie: str = "id") -> DataFrame:
    """One row per key, the lowest id; NULL keys are equal.

    The rank limit is also applied before the shuffle, so a large group of copies leaves each task
    as one row.
    """
    spec = W.partitionBy(*keys).orderBy(tie)
    return df.withColumn("_rn", F.row_number().over(spec)).filter("_rn = 1").drop("_rn")


def valid_coordinates() -> Column:
    """F6."""
    return F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180)


def valid_aqi() -> Column:
    """F7."""
    return F.col("aqi_value") >= 0


def valid_traffic() -> Column:
    """F8."""
    return F.col("traffic_level").between(1, 5)


def validity(df: DataFrame) -> dict[str, Column]:
    """The validity rules that apply to the columns present, in cleaning order."""
    rules = {}
    if {"latitude", "longitude"} <= set(df.columns):
        rules["coordinates"] = valid_coordinates()
    if "aqi_value" in df.columns:
        rules["aqi"] = valid_aqi()
    if "traffic_level" in df.columns:
        rules["traffic"] = valid_traffic()
    return rules


def iqr_bounds(df: DataFrame, measure: str, k: float) -> DataFrame:
    """One row (lower, upper): quartiles widened by k interquartile ranges."""
    q = percentiles(df, measure, {"q25": 0.25, "q75": 0.75})
    width = (F.col("q75") - F.col("q25")) * F.lit(float(k))
    return q.select((F.col("q25") - width).alias("lower"), (F.col("q75") + width).alias("upper"))


def inside_bounds(bounds: DataFrame, measure: str) -> Column:
    """Within the bounds, both ends in; the one bounds row enters the plan as a scalar."""
    b = bounds.select(F.struct("lower", "upper").alias("b")).scalar()
    return (F.col(measure) >= b["lower"]) & (F.col(measure) <= b["upper"])


def iqr_filter(df: DataFrame, measures: list[str] | None = None, k: float = 3.0) -> DataFrame:
    """outliers out, each measure judged on what the previous one left."""
    for m in measures or ["aqi_value"]:
        if m in df.columns:
            df = df.filter(inside_bounds(iqr_bounds(df, m, k), m))
    return df


def dropna_coords(df: DataFrame) -> DataFrame:
    """F10."""
    return df.dropna(subset=["latitude", "longitude"])


def coerce_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """columns to double, bad text to NULL."""
    return df.withColumns({c: to_number(F.col(c)) for c in columns})


def clean_data(df: DataFrame, k: float = 3.0) -> DataFrame:
    """dedupe, valid coordinates, index, level, then outliers of the index.

    The rows before the last step are written once: the quartiles then read one column of them, and
    the rows are shuffled once, not twice.
    """
    out = dedupe_first(df)
    for rule in validity(df).values():
        out = out.filter(rule)
    if "aqi_value" not in df.columns:
        return out
    return iqr_filter(materialize(out, "valid"), ["aqi_value"], k)


def cleaning_counters(df: DataFrame, k: float = 3.0) -> DataFrame:
    """Rows removed by each cleaning step: (step, removed), from two aggregations of the unique rows."""
    rules = validity(df)
    unique = materialize(dedupe_first(df), "unique")
    valid = unique
    for rule in rules.values():
        valid = valid.filter(rule)
    left = [F.count(F.lit(1)).alias("n0")]
    passed = F.lit(True)
    for i, rule in enumerate(rules.values(), start=1):
        passed = passed & F.coalesce(rule, F.lit(False))
        left.append(F.count_if(passed).alias(f"n{i}"))
    last = len(rules) + 1
    if "aqi_value" in df.columns:
        ok = passed & inside_bounds(iqr_bounds(valid, "aqi_value", k), "aqi_value")
    else:
        ok = passed
    left.append(F.count_if(ok).alias(f"n{last}"))
    counts = unique.agg(*left).withColumn("total", df.agg(F.count(F.lit(1))).scalar())
    names = ["duplicates", *rules, "outliers"]
    marks = ["total"] + [f"n{i}" for i in range(last + 1)]
    steps = [
        F.struct(F.lit(name).alias("step"), (F.col(marks[i]) - F.col(marks[i + 1])).alias("removed"))
        for i, name in enumerate(names)
    ]
    return counts.select(F.inline(F.array(*steps)))
