"""Months, month labels and date bounds."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

AsOf = str | dt.date

#: Label patterns in use.
MONTH_NAME = "MMMM yyyy"
YEAR_MONTH = "yyyy-MM"
ISO_DAY = "yyyy-MM-dd"
ISO_MINUTE = "yyyy-MM-dd HH:mm"


def as_date(value: AsOf) -> dt.date:
    """Accept ``'2001-07-15'``, a date or a datetime."""
    if isinstance(value, dt.datetime):
        return value.date()
    return value if isinstance(value, dt.date) else dt.date.fromisoformat(value)


def month_floor(as_of: AsOf) -> dt.date:
    return as_date(as_of).replace(day=1)


def previous_month(as_of: AsOf) -> dt.date:
    return (month_floor(as_of) - dt.timedelta(days=1)).replace(day=1)


def next_month(as_of: AsOf) -> dt.date:
    return (month_floor(as_of) + dt.timedelta(days=32)).replace(day=1)


def month_of(col: Column) -> Column:
    """First day of the column's month, as a date."""
    return F.trunc(col, "month")


def month_before(col: Column) -> Column:
    return F.add_months(month_of(col), -1)


def month_after(col: Column) -> Column:
    return F.add_months(month_of(col), 1)


def within(col: Column, start: dt.date | dt.datetime, stop: dt.date | dt.datetime) -> Column:
    """Half-open range ``start <= col < stop``. The bounds are literals, so the
    scan can skip row groups and files by their statistics."""
    return (col >= F.lit(start)) & (col < F.lit(stop))


def within_month(col: Column, as_of: AsOf) -> Column:
    return within(col, month_floor(as_of), next_month(as_of))


def label(col: Column, pattern: str = MONTH_NAME) -> Column:
    return F.date_format(col, pattern)
