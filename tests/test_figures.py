"""Boards and summaries on empty and odd tables."""

import datetime as dt
from decimal import Decimal

import pytest

from bizmetrics.operators import expenses as e, inventory as i, sales as s
from bizmetrics.plans import boards
from bizmetrics.schemas import ENTITIES, MOVEMENT_SIGN
from conftest import rows

D = Decimal
JULY, JUNE = dt.date(2001, 7, 1), dt.date(2001, 6, 1)


@pytest.fixture
def empty(spark):
    return {n: spark.createDataFrame([], spec.schema) for n, spec in ENTITIES.items()}


def sales_of(spark, *values):
    return spark.createDataFrame(list(values), "month date, revenue decimal(25,2), transaction_count int")


def expenses_of(spark, *values):
    return spark.createDataFrame(list(values), "category_id bigint, date date, amount decimal(15,2)")


def test_everything_works_on_empty_tables(empty):
    sales, expenses, products, moves = (
        empty[n] for n in ("monthly_sales", "expense", "product", "inventory_movement"))
    home = boards.home_summary(sales, expenses, products, "2001-07-15").first()
    assert (home.current_revenue, home.current_profit, home.total_transactions, home.total_products) == (0, 0, 0, 0)
    kpi = boards.kpi_board(sales, expenses, products, "2001-07-15").first()
    # Nothing before counts as 1: from 1 to 0 is -100 %; profit goes from 1 - 1 to 0.
    assert (kpi.revenue_change, kpi.expense_change, kpi.profit_change) == (-100.0, -100.0, 0.0)
    board = boards.expense_board(expenses, "2001-07-15").first()
    assert (board.growth_percent, board.avg_monthly_expenses, board.last_month_expenses) == (0.0, 0.0, 0)
    assert boards.sales_board(sales, "2001-07-15").first().best_month is None
    assert boards.inventory_board(products, moves, "2001-07-15").first().today_movements == 0
    assert s.sales_api_summary(sales).first() == (0.0, 0.0, 0)
    assert e.expense_api_summary(expenses).first() == (0.0, 0.0, 0)
    assert e.avg_monthly_expense(expenses).first()[0] == 0.0
    assert s.best_month(sales).count() == 0


def test_previous_month_of_zero_counts_as_one_on_the_kpi_board(spark, empty):
    sales = sales_of(spark, (JULY, D(50), 2), (JUNE, D(0), 0))
    expenses = expenses_of(spark, (1, JULY, D(30)))
    kpi = boards.kpi_board(sales, expenses, empty["product"], "2001-07-15").first()
    assert (kpi.revenue_change, kpi.expense_change) == (4900.0, 2900.0)
    # Profit went from 1 - 1 = 0, again taken as 1 in the divisor only, to 20.
    assert kpi.profit_change == 2000.0
    assert (kpi.current_month, kpi.last_month) == ("July 2001", "June 2001")


def test_expense_board_guards_only_the_divisor(spark):
    board = boards.expense_board(expenses_of(spark, (1, JULY, D(30))), "2001-07-15").first()
    assert (board.last_month_expenses, board.growth_percent) == (0, 3000.0)


def test_sales_board(spark):
    board = boards.sales_board(sales_of(spark, (JULY, D(50), 2), (JUNE, D(80), 3), (dt.date(1999, 1, 1), D(80), 1)),
                               "2001-07-15").first()
    assert (board.growth_percent, board.total_revenue, board.total_transactions) == (-37.5, 210, 6)
    assert (board.best_month, board.best_month_revenue) == (JUNE, 80)


def test_bars(spark, empty):
    sales, expenses = sales_of(spark, (JULY, D(50), 2)), expenses_of(spark, (1, JULY, D(80)))
    home = boards.home_summary(sales, expenses, empty["product"], "2001-07-15")
    assert rows(boards.summary_bars(home)) == [("revenue", 50), ("expenses", 80), ("profit", -30)]
    kpi = boards.kpi_board(sales, expenses, empty["product"], "2001-07-15")
    assert [r[0::2] for r in rows(boards.change_bars(kpi))] == [("revenue", "up"), ("expenses", "up"), ("profit", "down")]


def test_categories_with_null_group_and_ties(spark):
    categories = spark.createDataFrame([(n, f"c{n}") for n in range(1, 8)], "id bigint, name string")
    expenses = expenses_of(spark, *[(n, JULY, D(10)) for n in range(1, 8)], (None, JULY, D(6)), (99, JULY, D(6)),
                           (7, dt.date(2001, 1, 1), D(5)))
    top = e.top_categories_month(expenses, categories, "2001-07-15")
    # A missing category and one that no longer exists form one group.
    assert rows(top) == [(None, 12), ("c1", 10), ("c2", 10), ("c3", 10), ("c4", 10)]
    assert rows(e.top_categories_year(expenses, categories, "2001-07-15"))[0] == ("c7", 15)
    chart = rows(e.category_chart(expenses, categories, "2001-07-15", label="none"))
    assert ("none", 12.0) in chart and len(chart) == 8
    share = rows(e.category_share(expenses, categories, "2001-07-15"))
    assert [r[2] for r in share] == [23.1, 19.2, 19.2, 19.2, 19.2]


def test_stock(spark):
    products = spark.createDataFrame([(1, "P1", 10), (2, "P2", 5)], "id bigint, product_code string, quantity int")
    moves = spark.createDataFrame(
        [(1, k, 4) for k in MOVEMENT_SIGN] + [(1, "other", 100), (1, "in", 3)],
        "product_id bigint, movement_type string, quantity int")
    assert sorted(rows(i.stock_on_hand(products, moves))) == [(1, "P1", 10, 3, 13), (2, "P2", 5, 0, 5)]
