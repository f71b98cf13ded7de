"""Calendar weeks and months, clocks, as column expressions. Sessions run in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_week(at: Column) -> Column:
    """``YYYY-Www``, by the ISO year."""
    return F.format_string("%04d-W%02d", F.extract(F.lit("YEAROFWEEK"), at), F.weekofyear(at))


def week_start(at: Column) -> Column:
    return F.date_trunc("week", at)


def month_bounds(at: Column, zone: str) -> tuple[Column, Column]:
    """First instant of the month in a time zone, and of the next one, in UTC."""
    local = F.trunc(F.from_utc_timestamp(at, zone), "MM")
    return F.to_utc_timestamp(local.cast("timestamp"), zone), F.to_utc_timestamp(F.add_months(local, 1).cast("timestamp"), zone)


def to_master(t: Column, offset: Column, scale: Column, adjusted: Column) -> Column:
    """A stream's own time on the session's clock."""
    return offset + adjusted + t * scale


def from_master(t: Column, offset: Column, scale: Column, adjusted: Column) -> Column:
    return (t - offset - adjusted) / scale


def clock_text(ms: Column) -> Column:
    """``mm:ss.s``, with hours if there are any; tenths are cut off, not rounded."""
    tenths = F.floor(ms / 100)
    s, m, h = F.floor(tenths / 10), F.floor(tenths / 600), F.floor(tenths / 36000)
    short = F.format_string("%02d:%02d.%d", m % 60, s % 60, tenths % 10)
    return F.when(h > 0, F.concat(h.cast("string"), F.lit(":"), short)).otherwise(short)


def week_bounds(week: Column) -> tuple[Column, Column]:
    """First instants of the week ``YYYY-Www`` and of the next one: the fourth of January lies in week 1."""
    fourth = F.make_date(F.substring(week, 1, 4).cast("int"), F.lit(1), F.lit(4))
    monday = F.date_add(F.date_trunc("week", fourth).cast("date"), (F.substring(week, 7, 2).cast("int") - 1) * 7)
    return monday.cast("timestamp"), F.date_add(monday, 7).cast("timestamp")


def weeks_before(week: Column, n: int) -> Column:
    """The ``n`` weeks that end with this one, the earliest first."""
    start = week_bounds(week)[0]
    return F.transform(F.sequence(F.lit(n - 1), F.lit(0)), lambda k: iso_week(F.timestamp_add("WEEK", -k, start)))


def whole_ms(ms: Column) -> Column:
    """Rounded to whole milliseconds, halves to even."""
    return F.bround(ms, 0).cast("long")
