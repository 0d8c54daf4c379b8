"""Search, labels and names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def contains_ci(col: Column, term: str) -> Column:
    """Case-insensitive substring; ``%`` and ``_`` are ordinary characters."""
    return F.contains(F.lower(col), F.lower(F.lit(term)))


def any_of(conditions: list[Column]) -> Column:
    """OR where a NULL condition counts as false."""
    return reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in conditions])


def display_name(col: Column) -> Column:
    """``random_forest`` becomes ``Random Forest``."""
    return F.initcap(F.translate(col, "_", " "))


def coded(prefix: str, col: Column, separator: str = " - ") -> Column:
    return F.concat(F.lit(prefix), F.lit(separator), col)


def or_label(col: Column, text: str, empty_too: bool = False) -> Column:
    """Replace a missing value (and, if asked, an empty one) by a label."""
    return F.coalesce(F.nullif(col, F.lit("")) if empty_too else col, F.lit(text))


#: Layouts of a date, each with the order of its parts. English month names.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
MONTH_FIRST = r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4})$"
ISO_DATE = r"^\d{4}-\d{1,2}-\d{1,2}([ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?$"
DIGITS_ONLY = r"^(\d{4})(\d{2})(\d{2})$"
DAY_NAME = r"(?i)^(\d{1,2})[ -]([a-z]{3})[a-z]*\.?,?[ -](\d{4})$"
NAME_DAY = r"(?i)^([a-z]{3})[a-z]*\.? (\d{1,2}),? (\d{4})$"


def parse_date(col: Column) -> Column:
    """Text to date: ISO (a time of day is cut off), year/month/day, month/day/year, eight digits, or
    with an English month name as ``July 15, 2001``, ``15 July 2001`` and ``15-Jul-2001``;
    anything else becomes NULL. Casting does not throw on bad text, as parsing with
    patterns does internally, which is slow where many cells are bad. Ordinary cells meet no pattern: the rarer
    layouts, and times of day, are only looked at where the text isn't a plain ISO date."""
    text = F.trim(col)
    iso = F.replace(text, F.lit("/"), F.lit("-"))
    like_iso = (F.substring(iso, 5, 1) == "-") & (F.locate("-", iso, 6) > 0) & ((F.length(iso) <= 10) | iso.rlike(ISO_DATE))

    def dated(pattern: str, year: int, month: int, day: int, named: bool = False) -> Column:
        part = lambda n: F.regexp_extract(text, pattern, n)
        name = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(part(month), 1, 3)))
        number = F.nullif(name, F.lit(0)).cast("string") if named else part(month)
        return F.concat_ws("-", part(year), F.when(part(year) != "", number), part(day))

    other = F.coalesce(*[made.try_cast("date") for made in (
        dated(MONTH_FIRST, 3, 1, 2), dated(DIGITS_ONLY, 1, 2, 3), dated(DAY_NAME, 3, 2, 1, True), dated(NAME_DAY, 3, 1, 2, True))])
    return F.when(like_iso, iso.try_cast("date")).otherwise(other)
