"""One-row dashboards and the bars drawn from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from bizmetrics.functions import dates
from bizmetrics.functions.dates import AsOf
from bizmetrics.functions.numbers import or_one, or_zero, percent_change
from bizmetrics.operators.combine import one_row
from bizmetrics.operators.expenses import expense_month_pair, monthly_expenses
from bizmetrics.operators.filters import active, in_month, is_low_stock, low_stock, with_total_value
from bizmetrics.operators.inventory import movements_on_day
from bizmetrics.operators.sales import month_pair


def _named(value, text: str):
    return F.date_format(F.lit(value), dates.MONTH_NAME).alias(text)


def home_summary(sales: DataFrame, expenses: DataFrame, products: DataFrame, as_of: AsOf) -> DataFrame:
    """This month's revenue, expenses, profit and transactions, and two stock counts."""
    parts = one_row(
        in_month(sales, "month", as_of).agg(
            or_zero(F.sum("revenue")).alias("current_revenue"),
            or_zero(F.sum("transaction_count")).alias("total_transactions")),
        in_month(expenses, "date", as_of).agg(or_zero(F.sum("amount")).alias("current_expenses")),
        products.agg(
            F.count_if(is_low_stock()).alias("low_stock_products"),
            F.count_if("is_active").alias("total_products")))
    return parts.select(
        "current_revenue", "current_expenses",
        (F.col("current_revenue") - F.col("current_expenses")).alias("current_profit"),
        "total_transactions", "low_stock_products", "total_products",
        _named(dates.month_floor(as_of), "current_month"))


def kpi_board(sales: DataFrame, expenses: DataFrame, products: DataFrame, as_of: AsOf,
              low_threshold: int = 10) -> DataFrame:
    """This month against the previous one, with stock value and low-stock count.

    A previous month of nothing counts as 1, also inside the previous profit. Each table
    is read once, sales and expenses only for the two months.
    """
    parts = one_row(
        month_pair(sales, as_of),
        expense_month_pair(expenses, as_of).withColumn("last_expenses", or_one(F.col("last_expenses"))),
        products.agg(
            or_zero(F.sum(F.col("quantity") * F.col("unit_price"))).alias("total_inventory_value"),
            F.count_if(F.col("quantity") <= low_threshold).alias("low_stock_count")))
    profits = parts.withColumns({
        "current_profit": F.col("current_revenue") - F.col("current_expenses"),
        "last_profit": F.col("last_revenue") - F.col("last_expenses")})

    def change(name: str):
        return F.bround(percent_change(F.col(f"current_{name}"), F.col(f"last_{name}")), 2)

    return profits.select(
        "current_revenue", change("revenue").alias("revenue_change"),
        "current_expenses", change("expenses").alias("expense_change"),
        "current_profit", change("profit").alias("profit_change"),
        F.col("current_transactions").alias("total_transactions"),
        "total_inventory_value", "low_stock_count",
        _named(dates.month_floor(as_of), "current_month"),
        _named(dates.previous_month(as_of), "last_month"))


def sales_board(sales: DataFrame, as_of: AsOf) -> DataFrame:
    """Month pair, growth, totals and the best month, in one pass over the months."""
    last = dates.previous_month(as_of)
    month = F.col("month")

    def of(col: str, when) -> F.Column:
        return F.sum(F.when(dates.within_month(month, when), F.col(col)))

    best = F.max_by(F.struct("month", "revenue"), F.struct("revenue", "month"))
    return sales.agg(
        or_zero(of("revenue", as_of)).alias("current_month_revenue"),
        or_zero(of("transaction_count", as_of)).alias("current_month_transactions"),
        or_one(of("revenue", last)).alias("last_month_revenue"),
        or_zero(F.sum("revenue")).alias("total_revenue"),
        or_zero(F.sum("transaction_count")).alias("total_transactions"),
        best.alias("best"),
    ).select(
        "current_month_revenue", "current_month_transactions", "last_month_revenue",
        F.bround(percent_change(F.col("current_month_revenue"), F.col("last_month_revenue")), 2).alias("growth_percent"),
        "total_revenue", "total_transactions",
        F.col("best.month").alias("best_month"), F.col("best.revenue").alias("best_month_revenue"),
        _named(dates.month_floor(as_of), "current_month"), _named(last, "last_month_name"))


def expense_board(expenses: DataFrame, as_of: AsOf) -> DataFrame:
    """Periods, growth and the average month, from one roll-up to months. Here only the
    divisor is guarded; the previous month itself stays 0."""
    last = dates.previous_month(as_of)
    month, total = F.col("month"), F.col("total")
    return monthly_expenses(expenses).agg(
        or_zero(F.sum(F.when(dates.within_month(month, as_of), total))).alias("current_month_expenses"),
        or_zero(F.sum(F.when(dates.within_month(month, last), total))).alias("last_month_expenses"),
        or_zero(F.sum(total)).alias("total_expenses"),
        F.count(F.lit(1)).alias("_months"),
    ).select(
        "current_month_expenses", "last_month_expenses",
        F.bround(percent_change(F.col("current_month_expenses"), F.col("last_month_expenses")), 2).alias("growth_percent"),
        "total_expenses",
        F.bround(F.col("total_expenses").cast("double") / or_one(F.col("_months")), 2).alias("avg_monthly_expenses"),
        _named(dates.month_floor(as_of), "current_month"), _named(last, "last_month_name"))


def inventory_board(products: DataFrame, movements: DataFrame, as_of: AsOf) -> DataFrame:
    return one_row(
        active(products).agg(
            F.count(F.lit(1)).alias("total_products"),
            or_zero(F.sum(F.col("quantity") * F.col("unit_price"))).alias("total_value"),
            F.count_if(is_low_stock()).alias("low_stock_products"),
            F.count_if(F.col("quantity") == 0).alias("out_of_stock")),
        movements_on_day(movements, as_of).withColumnRenamed("movements", "today_movements"))


def low_stock_report(products: DataFrame) -> DataFrame:
    """Active products at or below their reorder level, scarcest first."""
    return low_stock(products, active_only=True).orderBy("quantity", "product_code").select(
        "product_code", "name", "category", "quantity", "reorder_level", "unit_price")


def inventory_value_report(products: DataFrame) -> DataFrame:
    """Active products with their stock value, largest quantity first."""
    return with_total_value(active(products)).orderBy(F.desc("quantity"), "product_code").select(
        "product_code", "name", "quantity", "unit_price", "total_value")


def summary_bars(board: DataFrame) -> DataFrame:
    bars = board.select(F.col("current_revenue").alias("revenue"), F.col("current_expenses").alias("expenses"),
                        F.col("current_profit").alias("profit"))
    widest = F.col("value").cast("decimal(38,2)").alias("value")
    same = bars.select([F.col(c).cast("decimal(38,2)").alias(c) for c in bars.columns])
    return same.unpivot([], ["revenue", "expenses", "profit"], "label", "value").select("label", widest)


def change_bars(board: DataFrame) -> DataFrame:
    bars = board.select(F.col("revenue_change").alias("revenue"), F.col("expense_change").alias("expenses"),
                        F.col("profit_change").alias("profit"))
    return (bars.unpivot([], ["revenue", "expenses", "profit"], "label", "change")
            .withColumn("direction", F.when(F.col("change") >= 0, "up").otherwise("down")))
