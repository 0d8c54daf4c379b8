"""Projections and filters."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from bizmetrics.functions import dates, text
from bizmetrics.functions.dates import AsOf
from bizmetrics.schemas import ENTITIES


# -- derived columns ---------------------------------------------------------------

def with_total_value(products: DataFrame) -> DataFrame:
    return products.withColumn("total_value", F.col("quantity") * F.col("unit_price"))


def with_line_total(items: DataFrame) -> DataFrame:
    return items.withColumn("total", F.col("quantity") * F.col("unit_price") - F.col("discount"))


def with_overdue(invoices: DataFrame, as_of: AsOf) -> DataFrame:
    return invoices.withColumn(
        "is_overdue", (F.col("due_date") < F.lit(dates.as_date(as_of))) & (F.col("status") != "paid"))


def with_paid(invoices: DataFrame) -> DataFrame:
    return invoices.withColumn("is_paid", F.col("status") == "paid")


def with_stock_status(products: DataFrame) -> DataFrame:
    quantity, reorder = F.col("quantity"), F.col("reorder_level")
    return products.withColumn(
        "stock_status",
        F.when(quantity == 0, "out").when(quantity <= reorder, "low").otherwise("in_stock"))


def with_stock_band(products: DataFrame, margin: int = 10) -> DataFrame:
    quantity, reorder = F.col("quantity"), F.col("reorder_level")
    return products.withColumn(
        "stock_band",
        F.when(quantity <= reorder, "red").when(quantity <= reorder + margin, "yellow").otherwise("green"))


def label_category(df: DataFrame, label: str, empty_too: bool = False, col: str = "category") -> DataFrame:
    return df.withColumn(col, text.or_label(F.col(col), label, empty_too))


def with_label(df: DataFrame, col: str, mapping: dict[str, str], out: str | None = None) -> DataFrame:
    """Display text of a code; a code outside the mapping shows as itself."""
    pairs = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return df.withColumn(out or f"{col}_label", F.coalesce(F.try_element_at(pairs, F.col(col)), F.col(col)))


def with_defaults(df: DataFrame, entity: str) -> DataFrame:
    """Fill absent values (and absent columns) with the entity's defaults."""
    spec = ENTITIES[entity]
    types = {n: t for n, t, _ in spec.fields}
    return df.withColumns({
        name: F.coalesce(F.col(name) if name in df.columns else F.lit(None), F.lit(value)).cast(types[name])
        for name, value in spec.defaults.items()})


# -- date filters ------------------------------------------------------------------

def in_year(df: DataFrame, col: str, year: int | str | None) -> DataFrame:
    if not year:
        return df
    return df.where(dates.within(F.col(col), dt.date(int(year), 1, 1), dt.date(int(year) + 1, 1, 1)))


def in_month(df: DataFrame, col: str, as_of: AsOf) -> DataFrame:
    return df.where(dates.within_month(F.col(col), as_of))


def between_dates(df: DataFrame, col: str, lo: AsOf | None = None, hi: AsOf | None = None) -> DataFrame:
    """Both ends are inclusive days and optional; of timestamps, the whole last day counts."""
    if lo:
        df = df.where(F.col(col) >= F.lit(dates.as_date(lo)))
    if hi:
        df = df.where(F.col(col) < F.lit(dates.as_date(hi) + dt.timedelta(days=1)))
    return df


def trailing_days(df: DataFrame, col: str, as_of: AsOf, days: int = 365) -> DataFrame:
    return df.where(F.col(col) >= F.lit(dates.as_date(as_of) - dt.timedelta(days=days)))


def on_day(df: DataFrame, col: str, day: AsOf) -> DataFrame:
    start = dates.as_date(day)
    return df.where(dates.within(F.col(col), start, start + dt.timedelta(days=1)))


# -- value filters -----------------------------------------------------------------

def eq_if(df: DataFrame, col: str, value: object) -> DataFrame:
    """Equality filter that is skipped when no value is given."""
    return df if value is None or value == "" else df.where(F.col(col) == F.lit(value))


def is_low_stock() -> Column:
    return F.col("quantity") <= F.col("reorder_level")


def low_stock(products: DataFrame, active_only: bool = False) -> DataFrame:
    return (active(products) if active_only else products).where(is_low_stock())


def low_stock_literal(products: DataFrame, threshold: int = 10) -> DataFrame:
    return products.where(F.col("quantity") <= threshold)


def active(df: DataFrame) -> DataFrame:
    return df.where(F.col("is_active"))


def out_of_stock(products: DataFrame) -> DataFrame:
    return active(products).where(F.col("quantity") == 0)


def search(df: DataFrame, cols: list[str], term: str | None) -> DataFrame:
    """Rows where any of the columns holds the term."""
    if not term:
        return df
    return df.where(text.any_of([text.contains_ci(F.col(c), term) for c in cols]))


def search_sales(sales: DataFrame, term: str | None) -> DataFrame:
    """Search the year and the revenue as printed (two decimals)."""
    if not term:
        return sales
    printed = [F.year("month").cast("string"), F.col("revenue").cast("string")]
    return sales.where(text.any_of([text.contains_ci(c, term) for c in printed]))


def search_any(df: DataFrame, term: str, cols: list[str] | None = None) -> DataFrame:
    """Search the whole printed row."""
    row = F.concat_ws(" ", *[F.col(c).cast("string") for c in (cols or df.columns)])
    return df.where(text.contains_ci(row, term))


def non_blank(df: DataFrame, col: str) -> DataFrame:
    return df.where(F.col(col) != "")


def by_key(df: DataFrame, value: object, key: str = "id") -> DataFrame:
    return df.where(F.col(key) == F.lit(value))


def complete_rows(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=cols)


def enough_history(df: DataFrame, by: list[str] | None = None, minimum: int = 6) -> DataFrame:
    """Keep the series that have at least ``minimum`` rows (one row per period)."""
    series = Window.partitionBy(*(by or []))
    return (df.withColumn("_n", F.count(F.lit(1)).over(series))
              .where(F.col("_n") >= minimum).drop("_n"))
