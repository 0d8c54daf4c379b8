"""Expense figures: periods, days and categories.

Category totals are summed per ``category_id`` before the name is looked up, so the
join sees one row per category and a hot or missing category costs nothing extra.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from bizmetrics.functions import dates
from bizmetrics.functions.dates import AsOf
from bizmetrics.functions.numbers import mean, or_one, or_zero
from bizmetrics.functions.text import or_label
from bizmetrics.operators.filters import between_dates, eq_if, in_month, in_year, search, trailing_days
from bizmetrics.operators.joins import with_category
from bizmetrics.schemas import NO_CATEGORY


def expense_filter(expenses: DataFrame, category_id: int | None = None, from_date: AsOf | None = None,
                   to_date: AsOf | None = None, term: str | None = None) -> DataFrame:
    chosen = between_dates(eq_if(expenses, "category_id", category_id), "date", from_date, to_date)
    return search(chosen, ["title", "description"], term)


def expense_summary(expenses: DataFrame, **filters: object) -> DataFrame:
    return expense_filter(expenses, **filters).agg(
        or_zero(F.sum("amount")).alias("total_expenses"),
        or_zero(mean(F.col("amount"))).alias("avg_expense"),
        F.count(F.lit(1)).alias("expense_count"))


def expense_api_summary(expenses: DataFrame) -> DataFrame:
    return expenses.agg(
        or_zero(F.sum("amount").cast("double")).alias("total_amount"),
        or_zero(mean(F.col("amount"))).alias("avg_amount"),
        F.count(F.lit(1)).alias("count"))


def expense_month_pair(expenses: DataFrame, as_of: AsOf) -> DataFrame:
    """This and the previous month's expenses, reading only those two months."""
    last = dates.previous_month(as_of)
    date, amount = F.col("date"), F.col("amount")
    return expenses.where(dates.within(date, last, dates.next_month(as_of))).agg(
        or_zero(F.sum(F.when(dates.within_month(date, as_of), amount))).alias("current_expenses"),
        or_zero(F.sum(F.when(dates.within_month(date, last), amount))).alias("last_expenses"))


def expense_periods(expenses: DataFrame, as_of: AsOf) -> DataFrame:
    """This month, previous month and all time, in one pass."""
    last = dates.previous_month(as_of)
    date, amount = F.col("date"), F.col("amount")
    return expenses.agg(
        or_zero(F.sum(F.when(dates.within_month(date, as_of), amount))).alias("current_expenses"),
        or_zero(F.sum(F.when(dates.within_month(date, last), amount))).alias("last_expenses"),
        or_zero(F.sum(amount)).alias("total_expenses"))


def category_totals(expenses: DataFrame, categories: DataFrame) -> DataFrame:
    sums = expenses.groupBy("category_id").agg(F.sum("amount").alias("_sum"))
    # Grouped by name again: expenses without a category, or with one that is gone,
    # form one nameless group.
    return (with_category(sums, categories)
            .groupBy("category_name").agg(F.sum("_sum").cast("decimal(25,2)").alias("total")))


def _top(totals: DataFrame, n: int) -> DataFrame:
    return totals.orderBy(F.desc("total"), "category_name").limit(n)


def top_categories_month(expenses: DataFrame, categories: DataFrame, as_of: AsOf, n: int = 5) -> DataFrame:
    return _top(category_totals(in_month(expenses, "date", as_of), categories), n)


def top_categories_year(expenses: DataFrame, categories: DataFrame, as_of: AsOf, n: int = 5) -> DataFrame:
    return _top(category_totals(in_year(expenses, "date", dates.as_date(as_of).year), categories), n)


def category_chart(expenses: DataFrame, categories: DataFrame, as_of: AsOf,
                   label: str = NO_CATEGORY) -> DataFrame:
    """Every category of the trailing year, largest first."""
    return (category_totals(trailing_days(expenses, "date", as_of), categories)
            .orderBy(F.desc("total"), "category_name")
            .select(or_label(F.col("category_name"), label, empty_too=True).alias("category"),
                    F.col("total").cast("double").alias("amount")))


def category_share(expenses: DataFrame, categories: DataFrame, as_of: AsOf, n: int = 5) -> DataFrame:
    """Percentages of the month's top categories among themselves (at most ``n`` rows)."""
    top = top_categories_month(expenses, categories, as_of, n)
    whole = F.sum(F.col("total").cast("double")).over(Window.partitionBy())
    return top.withColumn("share", F.bround(F.col("total").cast("double") / whole * 100, 1))


def expense_daily_chart(expenses: DataFrame, as_of: AsOf) -> DataFrame:
    """One row per day of the trailing year; the label is the day's month."""
    return (trailing_days(expenses, "date", as_of)
            .groupBy("date").agg(F.sum("amount").cast("double").alias("amount"))
            .orderBy("date")
            .select("date", F.date_format("date", dates.YEAR_MONTH).alias("month"), "amount"))


def monthly_expenses(expenses: DataFrame) -> DataFrame:
    return (expenses.groupBy(dates.month_of(F.col("date")).alias("month"))
            .agg(F.sum("amount").alias("total")))


def avg_monthly_expense(expenses: DataFrame) -> DataFrame:
    """Total over the number of months that have expenses. Summing per month first keeps
    the distinct count free."""
    return monthly_expenses(expenses).agg(
        F.bround(or_zero(F.sum("total")).cast("double") / or_one(F.count(F.lit(1))), 2)
        .alias("avg_monthly_expenses"))
