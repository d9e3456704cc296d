"""Summaries, temporal and spatial patterns, correlations, anomalies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cityflux.functions.categories import aqi_bin, aqi_category, correlation_wording
from cityflux.operators.cleaning import iqr_bounds
from cityflux.operators.imputation import MEASURES
from cityflux.operators.rollups import flag_extreme
from cityflux.plans.ranks import percentiles, value_counts
from cityflux.plans.scratch import materialize
from cityflux.plans.series import with_position
from cityflux.schemas import AQI_BINS, DAY_NAMES, DEFAULT_CENTER, MONTH_NAMES


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def long_measures(df: DataFrame, measures: list[str], keep: list[Column | str]) -> DataFrame:
    """(keep.., measure, value): one row per measure, from one pass over the frame."""
    pairs = [F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures]
    return df.select(*keep, F.inline(F.array(*pairs)))


def dataset_info(df: DataFrame) -> DataFrame:
    """Rows, time range, whole days, locations."""
    a = df.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.min("timestamp").alias("start"),
        F.max("timestamp").alias("end"),
        F.countDistinct("location").alias("locations"),
    )
    seconds = F.unix_micros(F.col("end").cast("timestamp")) - F.unix_micros(F.col("start").cast("timestamp"))
    days = F.floor(seconds / F.lit(86_400_000_000)).cast("long")
    return a.withColumn("duration_days", days)


def distinct_locations(df: DataFrame) -> DataFrame:
    """The locations seen, as rows."""
    return df.select("location").distinct()


def summary_statistics(df: DataFrame, measures: list[str] = MEASURES) -> DataFrame:
    """Moments, exact quartiles and mode (smallest on ties) per measure."""
    frames = []
    for m in measures:
        moments = df.agg(
            F.avg(m).alias("mean"), F.stddev_samp(m).alias("std"),
            F.min(m).cast("double").alias("min"), F.max(m).cast("double").alias("max"),
        )
        q = percentiles(df, m, {"median": 0.5, "q25": 0.25, "q75": 0.75}).select(F.struct("*")).scalar()
        # Values are counted first, so the most frequent one is looked for among few rows.
        best = F.min(F.struct((-F.col("n")).alias("n"), F.col("v").alias("v")))["v"]
        mode = value_counts(df, [], m).agg(best).scalar()
        frames.append(
            moments.select(
                F.lit(m).alias("measure"), "mean", q["median"].alias("median"), "std", "min", "max",
                q["q25"].alias("q25"), q["q75"].alias("q75"), (q["q75"] - q["q25"]).alias("iqr"), mode.alias("mode"),
            )
        )
    return _union(frames)


def shape_statistics(df: DataFrame, measures: list[str] = MEASURES) -> DataFrame:
    """Bias-corrected skewness and excess kurtosis; a constant measure has 0 for both."""
    aggs = []
    for m in measures:
        aggs += [
            F.count(m).cast("double").alias(f"{m}_n"),
            F.coalesce(F.skewness(m), F.lit(0.0)).alias(f"{m}_g1"),
            F.kurtosis(m).alias(f"{m}_g2"),
        ]
    wide = df.agg(*aggs)
    rows = []
    for m in measures:
        n, g1, g2 = F.col(f"{m}_n"), F.col(f"{m}_g1"), F.col(f"{m}_g2")
        skew = F.when(n >= 3, g1 * F.sqrt(n * (n - 1)) / (n - 2))
        corrected = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
        kurt = F.when(n >= 4, F.coalesce(corrected, F.lit(0.0)))
        rows.append(F.struct(F.lit(m).alias("measure"), skew.alias("skewness"), kurt.alias("kurtosis")))
    return wide.select(F.inline(F.array(*rows)))


def missing_profile(df: DataFrame) -> DataFrame:
    """Missing values per column, count and percent."""
    counts = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    rows = [
        F.struct(
            F.lit(c).alias("column_name"), F.col(c).alias("missing"),
            (F.coalesce(F.try_divide(F.col(c).cast("double"), F.col("_n").cast("double")), F.lit(0.0)) * 100).alias("missing_pct"),
        )
        for c in df.columns
    ]
    return counts.select(F.inline(F.array(*rows)))


def traffic_distribution(df: DataFrame) -> DataFrame:
    """Rows per level."""
    return df.groupBy("traffic_level").agg(F.count(F.lit(1)).alias("n"))


def aqi_category_distribution(df: DataFrame, binned: bool = True) -> DataFrame:
    """Rows per bin, bins without rows included; or per class label as seen."""
    if not binned:
        return df.groupBy(aqi_category(F.col("aqi_value")).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    names = [name for _, _, name in AQI_BINS]
    bins = aqi_bin(F.col("aqi_value"))
    counts = df.agg(*[F.count_if(bins == name).alias(name) for name in names])
    rows = [F.struct(F.lit(name).alias("category"), F.col(name).alias("n")) for name in names]
    return counts.select(F.inline(F.array(*rows)))


def hourly_pattern(df: DataFrame, measures: list[str] = MEASURES) -> DataFrame:
    """Mean, deviation, range per hour of day, with peak and lowest hour flagged."""
    hours = df.groupBy(F.hour("timestamp").alias("hour")).agg(
        *[
            F.struct(
                F.lit(m).alias("measure"), F.avg(m).alias("mean"), F.stddev_samp(m).alias("std"),
                F.min(m).cast("double").alias("min"), F.max(m).cast("double").alias("max"),
            ).alias(m)
            for m in measures
        ]
    )
    tidy = hours.select("hour", F.inline(F.array(*measures)))
    return flag_extreme(tidy, {"is_peak": ("mean", True), "is_lowest": ("mean", False)}, ["measure"])


def dow_pattern(df: DataFrame, measures: list[str] = MEASURES) -> DataFrame:
    """Mean per weekday, all seven named, 0 for a weekday without rows."""
    day = F.weekday("timestamp")
    wide = df.agg(*[F.avg(F.when(day == i, F.col(m))).alias(f"{m}_{i}") for m in measures for i in range(7)])
    rows = [
        F.struct(
            F.lit(m).alias("measure"), F.lit(name).alias("day_name"),
            F.coalesce(F.col(f"{m}_{i}"), F.lit(0.0)).alias("mean"),
        )
        for m in measures
        for i, name in enumerate(DAY_NAMES)
    ]
    return wide.select(F.inline(F.array(*rows)))


def month_pattern(df: DataFrame, measures: list[str] | None = None) -> DataFrame:
    """Mean per month present, named."""
    measures = measures or ["aqi_value"]
    name = F.element_at(F.array(*[F.lit(n) for n in MONTH_NAMES]), F.month("timestamp"))
    months = df.groupBy(name.alias("month_name")).agg(*[F.avg(m).alias(m) for m in measures])
    pairs = [F.struct(F.lit(m).alias("measure"), F.col(m).alias("mean")) for m in measures]
    return months.select("month_name", F.inline(F.array(*pairs)))


def weekend_effect(df: DataFrame, measures: list[str] = MEASURES) -> DataFrame:
    """A10: weekday and weekend means (0 when absent) and their difference."""
    weekend = F.weekday("timestamp") >= 5
    zero = F.lit(0.0)
    aggs = []
    for m in measures:
        aggs.append(F.coalesce(F.avg(F.when(~weekend, F.col(m))), zero).alias(f"{m}_weekday"))
        aggs.append(F.coalesce(F.avg(F.when(weekend, F.col(m))), zero).alias(f"{m}_weekend"))
    rows = [
        F.struct(
            F.lit(m).alias("measure"), F.col(f"{m}_weekday").alias("weekday"), F.col(f"{m}_weekend").alias("weekend"),
            (F.col(f"{m}_weekend") - F.col(f"{m}_weekday")).alias("difference"),
        )
        for m in measures
    ]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def rush_hours(df: DataFrame) -> DataFrame:
    """Hours whose mean level reaches the upper quartile of all levels."""
    threshold = percentiles(df, "traffic_level", {"q75": 0.75}).scalar()
    hours = df.groupBy(F.hour("timestamp").alias("hour")).agg(F.avg("traffic_level").alias("mean_traffic"))
    return hours.withColumn("threshold", threshold).filter(F.col("mean_traffic") >= F.col("threshold"))


def location_stats(df: DataFrame) -> DataFrame:
    """Rows, mean coordinates, and statistics of both measures per location.

    Moments are one aggregation; medians come from value counts per location.
    """
    tags = {"aqi_value": "aqi", "traffic_level": "traffic"}
    aggs = [
        F.count(F.lit(1)).alias("total_records"), F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"),
    ]
    for m, tag in tags.items():
        aggs += [
            F.avg(m).alias(f"{tag}_mean"), F.stddev_samp(m).alias(f"{tag}_std"),
            F.min(m).cast("double").alias(f"{tag}_min"), F.max(m).cast("double").alias(f"{tag}_max"),
        ]
    out = df.groupBy("location").agg(*aggs)
    for m, tag in tags.items():
        mid = percentiles(df, m, {f"{tag}_median": 0.5}, ["location"])
        out = out.join(mid, "location", "left")
    return out


def _location_means(df: DataFrame, measures: list[str]) -> DataFrame:
    means = df.groupBy("location").agg(*[F.avg(m).alias(m) for m in measures])
    return long_measures(means, measures, ["location"]).withColumnRenamed("value", "mean")


def location_ranking(df: DataFrame, measures: list[str] = MEASURES, **plan) -> DataFrame:
    """Locations by mean, highest first, name on ties."""
    means = _location_means(df, measures).withColumn("_down", -F.col("mean"))
    ranked = with_position(means, ["measure"], ["_down", "location"], "rank", **plan)
    return ranked.withColumn("rank", F.col("rank") + 1).drop("_down")


def hotspots(df: DataFrame, n: int = 3, measures: list[str] = MEASURES) -> DataFrame:
    """T4: the n highest and the n lowest locations per measure; each task passes on n rows at most."""
    means = _location_means(df, measures)
    sides = {
        "highest": [F.col("mean").desc(), F.col("location").asc()],
        "lowest": [F.col("mean").asc(), F.col("location").desc()],
    }
    frames = []
    for side, order in sides.items():
        ranked = means.withColumn("rank", F.row_number().over(W.partitionBy("measure").orderBy(*order)))
        frames.append(ranked.filter(F.col("rank") <= n).select("measure", F.lit(side).alias("side"), "rank", "location", "mean"))
    return _union(frames)


# Column pairs that one pass aggregates; wider frames take several passes over their columns, written once.
_PAIRS_A_PASS = 40


def correlation_matrix(df: DataFrame, columns: list[str], pairs_a_pass: int = _PAIRS_A_PASS) -> DataFrame:
    """Pearson r of every column pair over rows where both are known; NULL for a constant column.

    Every pair is the same built-in aggregates whatever the number of columns.
    """
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    parts = [pairs[k : k + pairs_a_pass] for k in range(0, len(pairs), pairs_a_pass)] or [[]]
    rows = df if len(parts) == 1 else materialize(df.select(*columns), "correlated")
    return _union([_correlations(rows, columns, part) for part in parts])


def _correlations(df: DataFrame, columns: list[str], pairs: list[tuple[int, int]]) -> DataFrame:
    if not pairs:
        return df.sparkSession.createDataFrame([], "variable1 string, variable2 string, correlation double")
    aggs = []
    for n, (i, j) in enumerate(pairs):
        a, b = F.col(columns[i]), F.col(columns[j])
        x, y = F.when(b.isNotNull(), a.cast("double")), F.when(a.isNotNull(), b.cast("double"))
        aggs += [F.covar_pop(x, y).alias(f"c{n}"), F.stddev_pop(x).alias(f"x{n}"), F.stddev_pop(y).alias(f"y{n}")]
    wide = df.agg(*aggs)
    rows = []
    for n, (i, j) in enumerate(pairs):
        r = F.try_divide(F.col(f"c{n}"), F.col(f"x{n}") * F.col(f"y{n}"))
        first, second = sorted((columns[i], columns[j]))
        rows.append(F.struct(F.lit(first).alias("variable1"), F.lit(second).alias("variable2"), r.alias("correlation")))
    return wide.select(F.inline(F.array(*rows)))


def strong_correlations(matrix: DataFrame, floor: float = 0.5) -> DataFrame:
    """Pairs beyond the floor, with strength and wording."""
    r = F.col("correlation")
    strength = F.when(F.abs(r) > 0.7, "strong").otherwise("moderate")
    rows = matrix.filter(F.abs(r) > floor)
    return rows.withColumns({"strength": strength, "interpretation": correlation_wording(r)})


def correlation_insight(matrix: DataFrame, first: str = "aqi_value", second: str = "traffic_level") -> DataFrame:
    """The one pair the insight is about."""
    pair = matrix.filter((F.col("variable1") == first) & (F.col("variable2") == second))
    return pair.select(
        F.lit("AQI-Traffic Correlation").alias("insight"), F.col("correlation").alias("value"),
        correlation_wording(F.col("correlation")).alias("interpretation"),
    )


def _anomalies(df: DataFrame, measure: str, stats: DataFrame, names: list[str], test, preview: int) -> DataFrame:
    s = stats.select(F.struct(*names).alias("s")).scalar()
    odd = F.coalesce(test(F.col(measure).cast("double"), s), F.lit(False))
    first = df.filter(odd).orderBy("id").limit(preview).select("id")
    ids = first.agg(F.array_join(F.sort_array(F.collect_list("id")), ",").alias("ids")).scalar()
    n = df.agg(F.count_if(odd).alias("count"), F.count(F.lit(1)).alias("_n"))
    share = F.coalesce(F.try_divide(F.col("count").cast("double"), F.col("_n").cast("double")), F.lit(0.0)) * 100
    return n.select(
        F.lit(measure).alias("measure"), *[s[c].alias(c) for c in names], "count",
        share.alias("percentage"), ids.alias("first_ids"),
    )


def anomalies_iqr(df: DataFrame, measures: list[str] = MEASURES, k: float = 1.5, preview: int = 10) -> DataFrame:
    """Values strictly outside the widened quartiles; W15: ids of the first few."""
    frames = []
    for m in [m for m in measures if m in df.columns]:
        bounds = iqr_bounds(df, m, k)
        outside = lambda v, s: (v < s["lower"]) | (v > s["upper"])
        frames.append(_anomalies(df, m, bounds, ["lower", "upper"], outside, preview))
    return _union(frames)


def anomalies_zscore(df: DataFrame, measures: list[str] = MEASURES, bound: float = 3.0, preview: int = 10) -> DataFrame:
    """Values more than ``bound`` sample deviations from the mean; a constant measure has none."""
    frames = []
    for m in [m for m in measures if m in df.columns]:
        stats = df.agg(F.avg(m).alias("mean"), F.stddev_samp(m).alias("std"))
        far = lambda v, s: F.abs(F.try_divide(v - s["mean"], s["std"])) > bound
        frames.append(_anomalies(df, m, stats, ["mean", "std"], far, preview))
    return _union(frames)


def total_anomalies(found: DataFrame) -> DataFrame:
    """Anomalies over all measures together, from their rows per measure."""
    return found.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total_anomalies"))


def map_center(df: DataFrame) -> DataFrame:
    """Mean coordinates, or the default centre."""
    lat, lon = DEFAULT_CENTER
    return df.agg(
        F.coalesce(F.avg("latitude"), F.lit(lat)).alias("latitude"),
        F.coalesce(F.avg("longitude"), F.lit(lon)).alias("longitude"),
    )


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table."""
    return _union([df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()])
