"""Calendar columns. Months are dates on the 1st, weeks are dates on their Monday.

Timestamps have no zone; nothing here passes through the session's time zone, where
an hour may be skipped or repeated.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day(ts: Column) -> Column:
    return F.to_date(ts)


def month_start(ts: Column) -> Column:
    return F.trunc(F.to_date(ts), "MM")


def month_label(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def week_start(ts: Column) -> Column:
    return F.trunc(F.to_date(ts), "week")


def week_end_month(monday: Column) -> Column:
    """Month of the Sunday that closes the week starting on `monday`."""
    return F.trunc(F.date_add(monday, 6), "MM")


def period_start(date: Column, grain: str) -> Column:
    """`date` cut to 'month' or 'week'."""
    return F.trunc(date, grain)


def days_between(start: Column, end: Column) -> Column:
    return F.datediff(F.to_date(end), F.to_date(start))


def minutes_between(start: Column, end: Column) -> Column:
    seconds = (end - start).cast("interval second").cast("decimal(18,6)")
    return seconds.cast("double") / F.lit(60.0)
