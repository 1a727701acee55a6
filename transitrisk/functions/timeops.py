"""Time-of-day / second-of-week expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_S = 86400
WEEK_S = 7 * DAY_S


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def hhmm_to_sod(text) -> Column:
    """'HH:MM' or 'HH:MM:SS' → second of day; null when unparsable."""
    parts = F.split(_c(text), ":")
    h = F.get(parts, 0).try_cast("int")
    m = F.get(parts, 1).try_cast("int")
    s = F.coalesce(F.get(parts, 2).try_cast("int"), F.lit(0))
    return h * 3600 + m * 60 + s


def sod_of(ts) -> Column:
    """Second of day of a timestamp."""
    t = _c(ts)
    return F.hour(t) * 3600 + F.minute(t) * 60 + F.floor(F.second(t)).cast("int")


def sow(day, sod) -> Column:
    """Second of week from a Monday=0 weekday and a second of day."""
    return _c(day) * DAY_S + _c(sod)


def duration_minutes(dep_sod, arr_sod, day_offset) -> Column:
    """Edge duration in minutes with a day offset (F8)."""
    return ((_c(arr_sod) - _c(dep_sod)) / 60.0 + F.lit(1440) * _c(day_offset))


def format_hms(seconds) -> Column:
    """Seconds (may exceed a day) → 'HH:MM:SS' of the day."""
    s = F.pmod(_c(seconds), F.lit(DAY_S))
    return F.when(s.isNotNull(), F.format_string("%02d:%02d:%02d", (s / 3600).cast("int"),
                           (F.pmod(s, F.lit(3600)) / 60).cast("int"), F.pmod(s, F.lit(60))))


def is_hms(text) -> Column:
    """Validates 'HH:MM:SS' input."""
    return _c(text).rlike(r"^([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]$")


def today_weekday() -> Column:
    """Weekday of the current date, Monday = 0."""
    return F.weekday(F.current_date())
