"""Defaults, guarded ratios, rounding and number text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

def or_zero(col: Column) -> Column:
    """NULL becomes 0."""
    return F.coalesce(col, F.lit(0))


def or_one(col: Column) -> Column:
    """NULL and 0 both become 1, as a divisor that is never zero."""
    return F.coalesce(F.nullif(col, F.lit(0)), F.lit(1))


def percent_change(current: Column, base: Column) -> Column:
    """Change against ``base`` in percent; only the divisor is guarded."""
    now, before = current.cast("double"), base.cast("double")
    return (now - before) / or_one(before) * 100


def mean(col: Column) -> Column:
    """Aggregate: mean as a double, from the exact sum, so the order of rows cannot matter."""
    return F.sum(col).cast("double") / F.nullif(F.count(col), F.lit(0))


def rounded(col: Column, digits: int = 2) -> Column:
    """Round half to even."""
    return F.bround(col, digits)


def thousands(col: Column) -> Column:
    """Whole number with thousands separators."""
    return F.format_number(col, 0)


def truncated(col: Column) -> Column:
    """Whole part, toward zero."""
    return col.cast("bigint")


def parse_number(col: Column) -> Column:
    """Text to double; anything that is not a plain number becomes NULL. The cast also takes Java's own
    spellings, which end in a letter (``12d``, ``NaN``) or hold a ``p`` (hexadecimal)."""
    text = F.trim(col)
    plain = F.substring(text, -1, 1).between(".", "9") & ~F.contains(F.lower(text), F.lit("p"))
    return F.when(plain, text.try_cast("double"))
