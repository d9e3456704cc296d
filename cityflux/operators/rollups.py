"""Hourly and daily rollups, peak detection, panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cityflux.functions.times import AsOf, hour_of, is_peak, shift_hours, to_local
from cityflux.sources.tables import active_since, lookback_days

_KEYS = ["date", "hour", "location"]


def hourly_state(readings: DataFrame, ts: str = "timestamp", offset_hours: int = 0) -> DataFrame:
    """Additive state per (date, hour, location): sums and counts of known values, extremes, rows.

    States of disjoint row sets merge by ``merge_states``; every rollup below derives from it.
    """
    when = shift_hours(F.col(ts), offset_hours)
    keyed = readings.select(
        F.to_date(when).alias("date"), F.hour(when).alias("hour"), "location", "aqi_value", "traffic_level"
    )
    return keyed.groupBy(*_KEYS).agg(
        F.sum("aqi_value").cast("long").alias("sum_aqi"),
        F.count("aqi_value").alias("n_aqi"),
        F.sum("traffic_level").cast("long").alias("sum_traffic"),
        F.count("traffic_level").alias("n_traffic"),
        F.max("aqi_value").alias("max_aqi"),
        F.max("traffic_level").alias("max_traffic"),
        F.min("aqi_value").alias("min_aqi"),
        F.min("traffic_level").alias("min_traffic"),
        F.count(F.lit(1)).alias("data_points_count"),
    )


def merge_states(states: DataFrame, keys: list[str] = _KEYS) -> DataFrame:
    """Combine states that share a key."""
    adds = ["sum_aqi", "n_aqi", "sum_traffic", "n_traffic", "data_points_count"]
    return states.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in adds],
        *[F.max(c).alias(c) for c in ("max_aqi", "max_traffic")],
        *[F.min(c).alias(c) for c in ("min_aqi", "min_traffic")],
    )


def _mean(total: str, n: str) -> Column:
    return F.try_divide(F.col(total).cast("double"), F.col(n).cast("double"))


def finish(state: DataFrame) -> DataFrame:
    """State to the stored rollup row; a row without hour is never a peak."""
    return state.select(
        *_KEYS,
        _mean("sum_aqi", "n_aqi").alias("avg_aqi"),
        _mean("sum_traffic", "n_traffic").alias("avg_traffic"),
        "max_aqi", "max_traffic", "min_aqi", "min_traffic", "data_points_count",
        is_peak(F.col("hour")).alias("is_peak_hour"),
    )


def hourly_aggregation(readings: DataFrame, offset_hours: int = 0) -> DataFrame:
    """A2: all hours in one job; restrict the readings for a single hour."""
    return finish(hourly_state(readings, offset_hours=offset_hours))


def daily_from_hourly(state: DataFrame) -> DataFrame:
    """A1 from hourly state: no second pass over the readings."""
    daily = merge_states(state, ["date", "location"])
    return finish(daily.withColumn("hour", F.lit(None).cast("int")))


def daily_aggregation(readings: DataFrame, offset_hours: int = 0) -> DataFrame:
    """A1: per (date, location), hour NULL."""
    return daily_from_hourly(hourly_state(readings, offset_hours=offset_hours))


def daily_summary(readings: DataFrame) -> DataFrame:
    """City-wide average index and top level per date."""
    return readings.groupBy(F.to_date("timestamp").alias("date")).agg(
        F.avg("aqi_value").alias("avg_aqi_city"), F.max("traffic_level").alias("max_traffic_level")
    )


def recent_aggregates(realtime: DataFrame, as_of: AsOf, minutes: int = 5) -> DataFrame:
    """A3: per location over the last minutes of active rows; a missing average reads as 0."""
    zero = F.lit(0.0)
    return active_since(realtime, as_of, minutes).groupBy("location").agg(
        F.coalesce(F.avg("aqi_value"), zero).alias("avg_aqi"),
        F.coalesce(F.avg("traffic_level"), zero).alias("avg_traffic"),
        F.max("aqi_value").alias("max_aqi"),
        F.max("traffic_level").alias("max_traffic"),
        F.count(F.lit(1)).alias("data_points"),
    )


def hourly_analysis(state: DataFrame) -> DataFrame:
    """State to the peak-hours analysis table (U6): derived averages, row count."""
    return state.select(
        *_KEYS,
        _mean("sum_traffic", "n_traffic").alias("avg_traffic_level"),
        _mean("sum_aqi", "n_aqi").alias("avg_aqi_value"),
        is_peak(F.col("hour")).alias("is_peak_hour"),
        F.col("data_points_count").alias("total_records"),
    )


def peak_hours_panel(analysis: DataFrame, as_of: AsOf, days: int = 7) -> DataFrame:
    """A4: per hour of day, the mean of hourly averages (unweighted on purpose), flag and rows."""
    return lookback_days(analysis, as_of, days).groupBy("hour").agg(
        F.avg("avg_traffic_level").alias("avg_traffic"),
        F.avg("avg_aqi_value").alias("avg_aqi"),
        F.coalesce(F.bool_or("is_peak_hour"), F.lit(False)).alias("is_peak"),
        F.sum("total_records").alias("total_records"),
    )


def panel_overlay(panel: DataFrame) -> DataFrame:
    """The panel with the index scaled to sit beside the levels."""
    return panel.withColumn("avg_aqi_scaled", F.col("avg_aqi") / F.lit(50.0))


def peak_hours(hourly: DataFrame) -> DataFrame:
    """A5: per date and measure the hour with the highest mean over locations, and its top location.

    Ties go to the earlier hour and the first name. Two small aggregations over hourly rows: the
    winner of each hour travels with the hour's mean.
    """
    rows = hourly.filter(F.col("hour").isNotNull())

    def top_location(avg: str) -> Column:
        return F.min(F.when(F.col(avg).isNotNull(), F.struct((-F.col(avg)).alias("v"), F.col("location").alias("l"))))

    by_hour = rows.groupBy("date", "hour").agg(
        F.avg("avg_aqi").alias("aqi"), top_location("avg_aqi").alias("aqi_top"),
        F.avg("avg_traffic").alias("traffic"), top_location("avg_traffic").alias("traffic_top"),
    )

    def best(m: str) -> Column:
        key = F.struct((-F.col(m)).alias("v"), F.col("hour").alias("h"), F.col(f"{m}_top.l").alias("l"))
        return F.min(F.when(F.col(m).isNotNull(), key)).alias(m)

    out = by_hour.groupBy("date").agg(best("aqi"), best("traffic"))
    cols = [F.col("date").alias("analysis_date")]
    for m in ("aqi", "traffic"):
        cols += [
            F.col(f"{m}.h").alias(f"peak_{m}_hour"),
            (-F.col(f"{m}.v")).alias(f"peak_{m}_value"),
            F.col(f"{m}.l").alias(f"peak_{m}_location"),
        ]
    return out.select(*cols)


def peak_hours_local(readings: DataFrame) -> DataFrame:
    """Hour means in local time, rounded to 2, with the first maximum flagged."""
    hours = readings.groupBy(F.hour(to_local(F.col("timestamp"))).alias("hour")).agg(
        F.round(F.avg("aqi_value"), 2).alias("avg_aqi"), F.round(F.avg("traffic_level"), 2).alias("avg_traffic")
    )
    return flag_extreme(hours, {"is_peak_aqi": ("avg_aqi", True), "is_peak_traffic": ("avg_traffic", True)}, [])


def flag_extreme(hours: DataFrame, flags: dict[str, tuple[str, bool]], group: list[str]) -> DataFrame:
    """Flag the hour with the largest (True) or smallest value per group; earliest hour on ties.

    The input has at most 24 rows per group.
    """
    from pyspark.sql import Window as W

    spec = W.partitionBy(*(group or [F.lit(0)]))
    out = {}
    for name, (col, largest) in flags.items():
        value = -F.col(col) if largest else F.col(col)
        first = F.min(F.when(F.col(col).isNotNull(), F.struct(value.alias("v"), F.col("hour").alias("h")))).over(spec)
        out[name] = F.coalesce(first["h"] == F.col("hour"), F.lit(False))
    return hours.withColumns(out)


def kpi_summary(readings: DataFrame, offset_hours: int = 0) -> DataFrame:
    """Dashboard tiles in one pass."""
    peak = is_peak(hour_of(F.col("timestamp"), offset_hours))
    return readings.agg(
        F.avg("traffic_level").alias("avg_traffic"), F.max("traffic_level").alias("max_traffic"),
        F.avg("aqi_value").alias("avg_aqi"), F.max("aqi_value").alias("max_aqi"),
        F.count_if(peak).alias("peak_records"), F.count(F.lit(1)).alias("total_records"),
    )
