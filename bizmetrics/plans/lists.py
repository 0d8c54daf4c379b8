"""List views: filter, sort, one page."""

from __future__ import annotations

from pyspark.sql import DataFrame

from bizmetrics.operators.expenses import expense_filter
from bizmetrics.operators.filters import eq_if, in_year, search_sales
from bizmetrics.operators.inventory import product_filter
from bizmetrics.operators.ordering import Page, page


def sales_list(sales: DataFrame, year: int | str | None = None, term: str | None = None,
               number: object = 1) -> Page:
    return page(search_sales(in_year(sales, "month", year), term), ["-month"], number, 20)


def transaction_list(transactions: DataFrame, number: object = 1) -> Page:
    return page(transactions, ["-transaction_date", "id"], number, 20)


def expense_list(expenses: DataFrame, number: object = 1, **filters: object) -> Page:
    ties = ["-date", "id", "title", "amount", "category_id", "status"]
    return page(expense_filter(expenses, **filters), ties, number, 20)


def product_list(products: DataFrame, number: object = 1, **filters: object) -> Page:
    return page(product_filter(products, **filters), ["product_code"], number, 20)


def movement_list(movements: DataFrame, movement_type: str | None = None, number: object = 1) -> Page:
    ties = ["-created_at", "-id", "product_id", "movement_type", "quantity"]
    return page(eq_if(movements, "movement_type", movement_type), ties, number, 30)


def category_list(categories: DataFrame) -> DataFrame:
    """All categories by name; this list has no pages."""
    return categories.orderBy("name")
