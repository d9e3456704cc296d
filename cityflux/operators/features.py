"""Feature table, scaling and feature selection.

Lags and rolling means count rows of a location, not hours, although their names say hours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from cityflux.functions.categories import aqi_bin
from cityflux.functions.times import calendar_parts, is_rush_hour, time_of_day
from cityflux.operators.cleaning import clean_data
from cityflux.operators.imputation import MEASURES, handle_missing
from cityflux.plans.series import over_rows

LAGS = {1: "1h", 2: "2h", 24: "24h"}
SPANS = {3: "3h", 6: "6h", 24: "24h"}
_KEYS = ["location"]
_ORDER = ["timestamp", "id"]


def lag_columns(spec: WindowSpec, measures: list[str]) -> dict[str, Column]:
    return {f"{m}_lag_{tag}": F.lag(m, n).over(spec) for m in measures for n, tag in LAGS.items()}


def mean_columns(spec: WindowSpec, measures: list[str]) -> dict[str, Column]:
    return {
        f"{m}_ma_{tag}": F.avg(m).over(spec.rowsBetween(-(n - 1), 0)) for m in measures for n, tag in SPANS.items()
    }


def lag_features(df: DataFrame, measures: list[str] = MEASURES, keys=None, order=None, **plan) -> DataFrame:
    """Values 1, 2 and 24 rows back."""
    return over_rows(df, keys or _KEYS, order or _ORDER, lambda s: lag_columns(s, measures), max(LAGS), **plan)


def rolling_means(df: DataFrame, measures: list[str] = MEASURES, keys=None, order=None, **plan) -> DataFrame:
    """Means over the last 3, 6 and 24 rows, the row itself in."""
    return over_rows(df, keys or _KEYS, order or _ORDER, lambda s: mean_columns(s, measures), max(SPANS), **plan)


def own_lag_means(spec: WindowSpec, measures: list[str]) -> dict[str, Column]:
    """Rolling means that leave the row itself out, for models that must not see their target."""
    return {
        f"{m}_ma_{tag}": F.avg(m).over(spec.rowsBetween(-n, -1)) for m in measures for n, tag in SPANS.items()
    }


def engineer_features(
    df: DataFrame, measures: list[str] = MEASURES, feature_set: str = "reference", **plan
) -> DataFrame:
    """Whole feature table: calendar, rush hour, day part, lags, means, interaction, bin.

    All row features share one sort. ``feature_set='no_leak'`` ends the means one row earlier.
    """
    present = [m for m in measures if m in df.columns]
    means = mean_columns if feature_set == "reference" else own_lag_means
    rows = over_rows(
        df, _KEYS, _ORDER, lambda s: {**lag_columns(s, present), **means(s, present)}, max(LAGS), **plan
    )
    rows = rows.withColumns(calendar_parts(F.col("timestamp")))
    more = {"is_rush_hour": is_rush_hour(F.col("hour")), "time_of_day": time_of_day(F.col("hour"))}
    if set(MEASURES) <= set(present):
        more["aqi_traffic_interaction"] = F.col("aqi_value") * F.col("traffic_level")
    if "aqi_value" in present:
        more["aqi_category"] = aqi_bin(F.col("aqi_value"))
    return rows.withColumns(more)


BASE_FEATURES = ["hour", "day_of_week", "month", "is_weekend", "is_rush_hour"]


def feature_names(df: DataFrame, target: str) -> list[str]:
    """base columns, the other measure, coordinates, then every column named like a lag or mean."""
    other = "traffic_level" if target == "aqi_value" else "aqi_value"
    base = BASE_FEATURES + [other, "latitude", "longitude"]
    series = [c for c in df.columns if "lag" in c or "ma" in c]
    return [c for c in base + series if c in df.columns]


def prepare_features(df: DataFrame, target: str = "aqi_value", keep: list[str] | None = None) -> DataFrame:
    """M1: features and target of rows where none is missing, plus ``keep`` columns."""
    names = feature_names(df, target)
    extra = [c for c in keep or [] if c not in names + [target]]
    return df.dropna(subset=[target] + names).select(*extra, *names, target)


def numeric_columns(df: DataFrame, exclude: list[str] | None = None, without_ids: bool = False) -> list[str]:
    """F16: numeric columns, less a fixed list or less every name with 'id' in it."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]
    if without_ids:
        names = [n for n in names if "id" not in n.lower()]
    return [n for n in names if n not in (exclude or [])]


def _scaled(df: DataFrame, columns: list[str], shift: str, spread) -> DataFrame:
    present = [c for c in columns if c in df.columns]
    stats = df.agg(
        *[getattr(F, shift)(c).cast("double").alias(f"{c}_shift") for c in present],
        *[spread(c).cast("double").alias(f"{c}_spread") for c in present],
    )
    s = stats.select(F.struct("*").alias("s")).scalar()
    return df.withColumns(
        {
            c: F.when(
                F.col(c).isNotNull(),
                F.coalesce(F.try_divide(F.col(c).cast("double") - s[f"{c}_shift"], s[f"{c}_spread"]), F.lit(0.0)),
            )
            for c in present
        }
    )


def scale_standard(df: DataFrame, columns: list[str]) -> DataFrame:
    """M6: zero mean, unit population deviation; a constant column becomes 0."""
    return _scaled(df, columns, "avg", F.stddev_pop)


def scale_minmax(df: DataFrame, columns: list[str]) -> DataFrame:
    """M6: onto 0..1; a constant column becomes 0."""
    return _scaled(df, columns, "min", lambda c: F.max(c) - F.min(c))


def preprocess(df: DataFrame, with_features: bool = True, scale: bool = False) -> DataFrame:
    """Clean, impute, features, optionally scaled."""
    out = handle_missing(clean_data(df))
    if with_features:
        out = engineer_features(out)
    if scale:
        out = scale_standard(out, numeric_columns(out, ["id", "timestamp", "latitude", "longitude"]))
    return out


def preprocessing_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row on what preprocessing did; each frame is read once."""

    def missing(df: DataFrame) -> Column:
        total = F.lit(0).cast("long")
        for c in df.columns:
            total = total + F.count_if(F.col(c).isNull())
        return total

    b = before.agg(F.count(F.lit(1)).alias("n"), missing(before).alias("m")).select(F.struct("*")).scalar()
    a = after.agg(
        F.count(F.lit(1)).alias("processed_records"),
        missing(after).alias("missing_values_processed"),
        F.min("timestamp").alias("start"),
        F.max("timestamp").alias("end"),
        F.countDistinct("location").alias("locations"),
    )
    wide = a.withColumns({"original_records": b["n"], "missing_values_original": b["m"]})
    removed = F.col("original_records") - F.col("processed_records")
    share = F.try_divide(removed.cast("double"), F.col("original_records").cast("double")) * 100
    return wide.select(
        "original_records", "processed_records", removed.alias("records_removed"),
        share.alias("removal_percentage"),
        F.lit(len(before.columns)).alias("original_features"),
        F.lit(len(after.columns)).alias("processed_features"),
        F.lit(len(after.columns) - len(before.columns)).alias("new_features"),
        "missing_values_original", "missing_values_processed", "start", "end", "locations",
    )
