"""Figures over the product-sales file: totals, months, products, countries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from bizmetrics.functions.dates import month_of
from bizmetrics.functions.numbers import or_zero, truncated
from bizmetrics.operators.timeseries import fill_months


def product_sales_kpi(sales: DataFrame) -> DataFrame:
    return sales.agg(
        truncated(or_zero(F.sum("sales"))).alias("total_sales"),
        truncated(or_zero(F.sum("profit"))).alias("total_profit"),
        truncated(or_zero(F.sum("units_sold"))).alias("total_orders"))


def monthly_resample(sales: DataFrame, by: list[str] | None = None, date: str = "sale_date",
                     values: tuple[str, ...] = ("sales",)) -> DataFrame:
    """Sums per calendar month (and key); months without rows, between a series' first and
    last, are 0."""
    keys = by or []
    monthly = (sales.groupBy(*keys, month_of(F.col(date)).alias("month"))
               .agg(*[F.sum(v).alias(v) for v in values]))
    return fill_months(monthly, keys, values)


def sales_by_product(sales: DataFrame) -> DataFrame:
    return sales.groupBy("product").agg(F.sum("sales").alias("sales")).orderBy("product")


def sales_by_country(sales: DataFrame) -> DataFrame:
    return sales.groupBy("country").agg(F.sum("sales").alias("sales")).orderBy("country")
