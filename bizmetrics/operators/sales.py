"""Sales figures: months, transactions and their roll-up."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from bizmetrics.functions import dates
from bizmetrics.functions.dates import AsOf
from bizmetrics.functions.numbers import mean, or_one, or_zero
from bizmetrics.operators.filters import in_year, search_sales, trailing_days
from bizmetrics.schemas import ENTITIES


def sales_series(sales: DataFrame, with_count: bool = True) -> DataFrame:
    cols = ["month", "revenue", "transaction_count"] if with_count else ["month", "revenue"]
    return sales.select(*cols).orderBy("month")


def rollup_monthly(transactions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Transactions to one row per month (and key): revenue and transaction count."""
    return (transactions
            .groupBy(*(by or []), dates.month_of(F.col("transaction_date")).alias("month"))
            .agg(F.sum("amount").alias("revenue"), F.count(F.lit(1)).alias("transaction_count")))


def monthly_of(transactions: DataFrame) -> DataFrame:
    """``monthly_sales`` rows of a ledger, with that table's types."""
    money, count = (ENTITIES["monthly_sales"].schema[c].dataType for c in ("revenue", "transaction_count"))
    return rollup_monthly(transactions).select(
        "month", F.col("revenue").cast(money).alias("revenue"), F.col("transaction_count").cast(count).alias("transaction_count"))


def two_months(transactions: DataFrame, as_of: AsOf) -> DataFrame:
    """``monthly_sales`` of the month of ``as_of`` and the one before, which is all that the boards read. The range
    stands on the ledger's own time, where the scan can use it, as on the rolled-up month it could not."""
    return monthly_of(transactions.where(dates.within(
        F.col("transaction_date"), dates.previous_month(as_of), dates.next_month(as_of))))


def trailing_months(transactions: DataFrame, as_of: AsOf, days: int = 365) -> DataFrame:
    """``monthly_sales`` of the months that begin within ``days`` before ``as_of``, and of all later ones."""
    start = dates.as_date(as_of) - dt.timedelta(days=days)
    first = start if start.day == 1 else dates.next_month(start)
    return monthly_of(transactions.where(F.col("transaction_date") >= F.lit(first)))


def sales_summary(sales: DataFrame, year: int | str | None = None, term: str | None = None) -> DataFrame:
    chosen = search_sales(in_year(sales, "month", year), term)
    return chosen.agg(
        or_zero(F.sum("revenue")).alias("total_revenue"),
        or_zero(F.sum("transaction_count")).alias("total_transactions"),
        or_zero(mean(F.col("revenue"))).alias("avg_revenue"))


def transaction_summary(transactions: DataFrame) -> DataFrame:
    return transactions.agg(
        or_zero(F.sum("amount")).alias("total_amount"),
        F.count_if(F.col("status") == "completed").alias("completed_count"))


def sales_api_summary(sales: DataFrame) -> DataFrame:
    return sales.agg(
        or_zero(F.sum("revenue").cast("double")).alias("total_revenue"),
        or_zero(mean(F.col("revenue"))).alias("avg_revenue"),
        F.count(F.lit(1)).alias("count"))


def _month_sum(col: str, as_of: AsOf) -> Column:
    return F.sum(F.when(dates.within_month(F.col("month"), as_of), F.col(col)))


def month_pair(sales: DataFrame, as_of: AsOf) -> DataFrame:
    """This month and the previous one in one pass over those two months. A missing or
    zero previous revenue counts as 1, and that 1 is what later figures use."""
    last = dates.previous_month(as_of)
    both = sales.where(dates.within(F.col("month"), last, dates.next_month(as_of)))
    return both.agg(
        or_zero(_month_sum("revenue", as_of)).alias("current_revenue"),
        or_zero(_month_sum("transaction_count", as_of)).alias("current_transactions"),
        or_one(_month_sum("revenue", last)).alias("last_revenue"),
        or_zero(_month_sum("transaction_count", last)).alias("last_transactions"))


def sales_totals(sales: DataFrame) -> DataFrame:
    return sales.agg(
        or_zero(F.sum("revenue")).alias("total_revenue"),
        or_zero(F.sum("transaction_count")).alias("total_transactions"))


def revenue_stats(sales: DataFrame, by: list[str] | None = None) -> DataFrame:
    return sales.groupBy(*(by or [])).agg(
        F.sum("revenue").alias("total_revenue"),
        mean(F.col("revenue")).alias("avg_revenue"),
        F.max("revenue").alias("max_revenue"),
        F.min("revenue").alias("min_revenue"),
        F.count(F.lit(1)).alias("data_count"))


def sales_chart(sales: DataFrame, as_of: AsOf) -> DataFrame:
    return (trailing_days(sales, "month", as_of).orderBy("month")
            .select(F.date_format("month", dates.YEAR_MONTH).alias("month"),
                    F.col("revenue").cast("double").alias("revenue")))


def sales_years(sales: DataFrame) -> DataFrame:
    return sales.select(F.year("month").alias("year")).distinct()


def best_month(sales: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The month with the highest revenue (the later one of equals), overall or per key."""
    if not by:
        return (sales.select("month", "revenue", "transaction_count")
                .orderBy(F.desc("revenue"), F.desc("month")).limit(1))
    best = F.max_by(F.struct("month", "revenue", "transaction_count"), F.struct("revenue", "month"))
    return sales.groupBy(*by).agg(best.alias("best")).select(*by, "best.*")
