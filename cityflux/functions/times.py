"""Time rules: hours, peaks, day parts, local time and its text."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from cityflux.schemas import DAY_PARTS, LOCAL_OFFSET_HOURS, LOCAL_ZONE_MARK, PEAK_HOURS, RUSH_HOURS

AsOf = str | datetime


def moment(as_of: AsOf | Column) -> Column:
    """A reference time as a zone-less timestamp literal; a column is taken as it is."""
    return (as_of if isinstance(as_of, Column) else F.lit(str(as_of))).cast("timestamp_ntz")


def shift_hours(ts: Column, hours: int) -> Column:
    return ts if hours == 0 else ts + F.make_dt_interval(hours=F.lit(hours))


def hour_of(ts: Column, offset_hours: int = 0) -> Column:
    return F.hour(shift_hours(ts, offset_hours))


def is_peak(hour: Column) -> Column:
    """C6 on an hour number: the morning and evening peaks, ends open; missing hour is no peak."""
    spans = [(hour >= start) & (hour < end) for start, end in PEAK_HOURS]
    return F.coalesce(spans[0] | spans[1], F.lit(False))


def is_peak_hour(ts: Column, offset_hours: int = 0) -> Column:
    """C6 on a timestamp."""
    return is_peak(hour_of(ts, offset_hours))


def is_rush_hour(hour: Column) -> Column:
    """1 in the rush hours, both ends in."""
    spans = [hour.between(first, last) for first, last in RUSH_HOURS]
    return (spans[0] | spans[1]).cast("int")


def time_of_day(hour: Column) -> Column:
    """Part of the day."""
    expr = None
    for last, name in DAY_PARTS:
        expr = (F if expr is None else expr).when(hour <= last, name)
    return expr


def calendar_parts(ts: Column) -> dict[str, Column]:
    """Hour, day_of_week (Monday = 0), month, day_of_month, is_weekend."""
    weekday = F.weekday(ts)
    return {
        "hour": F.hour(ts),
        "day_of_week": weekday,
        "month": F.month(ts),
        "day_of_month": F.dayofmonth(ts),
        "is_weekend": (weekday >= 5).cast("int"),
    }


def to_local(ts: Column) -> Column:
    """UTC to local wall time."""
    return shift_hours(ts, LOCAL_OFFSET_HOURS)


def format_time(ts: Column) -> Column:
    """C11: plain text of a time, N/A when missing."""
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit("N/A"))


def format_local_time(ts: Column) -> Column:
    """C11: local text with the zone mark, N/A when missing."""
    text = F.date_format(to_local(ts), "yyyy-MM-dd HH:mm:ss")
    return F.coalesce(F.concat(text, F.lit(f" {LOCAL_ZONE_MARK}")), F.lit("N/A"))


def parse_iso(text: Column, default: Column | None = None) -> Column:
    """ISO-8601 text, with or without a zone, to a timestamp; else the default (now)."""
    fallback = F.current_timestamp() if default is None else default
    return F.coalesce(text.try_cast("timestamp"), fallback)


def time_from_parts(date: Column, hour: Column, missing_hour: int = 12) -> Column:
    """Date plus hour; a missing hour reads as midday."""
    hours = F.coalesce(hour, F.lit(missing_hour)).cast("int")
    return date.cast("timestamp_ntz") + F.make_dt_interval(hours=hours)


def previous_hour(as_of: AsOf | Column) -> Column:
    """Start of the hour before a moment or the times of a column."""
    return shift_hours(F.date_trunc("hour", moment(as_of)).cast("timestamp_ntz"), -1)


def minutes_between(later: Column, earlier: Column) -> Column:
    """Minutes as double."""
    micros = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return micros / F.lit(60_000_000.0)
