import datetime as dt

import pytest

from bizmetrics.operators import filters as f
from bizmetrics.schemas import PAYMENT_METHODS
from conftest import plan_of, rows


@pytest.fixture
def expenses(spark):
    return spark.createDataFrame(
        [(1, "Rent 100%", "Office", dt.date(2001, 7, 1)), (2, "rent_a", None, dt.date(2001, 7, 31)),
         (3, None, "RENT", dt.date(2001, 8, 1)), (4, "Paper", None, dt.date(2000, 7, 15))],
        "id int, title string, description string, date date")


def ids(df):
    return sorted(r[0] for r in df.select("id").collect())


def test_search_is_literal_and_ignores_case_and_null(expenses):
    cols = ["title", "description"]
    assert ids(f.search(expenses, cols, "RENT")) == [1, 2, 3]
    assert ids(f.search(expenses, cols, "%")) == [1]
    assert ids(f.search(expenses, cols, "t_a")) == [2]
    assert ids(f.search(expenses, cols, "")) == [1, 2, 3, 4]
    assert ids(f.search(expenses, cols, None)) == [1, 2, 3, 4]


def test_date_ranges(expenses):
    assert ids(f.in_month(expenses, "date", "2001-07-15")) == [1, 2]
    assert ids(f.in_year(expenses, "date", "2001")) == [1, 2, 3]
    assert ids(f.in_year(expenses, "date", None)) == [1, 2, 3, 4]
    assert ids(f.between_dates(expenses, "date", "2001-07-01", "2001-07-31")) == [1, 2]
    assert ids(f.between_dates(expenses, "date", hi="2001-07-01")) == [1, 4]
    # 365 days, not twelve months, and the first of them counts.
    assert ids(f.trailing_days(expenses, "date", "2001-07-15")) == [1, 2, 3, 4]
    assert ids(f.trailing_days(expenses, "date", "2001-07-16")) == [1, 2, 3]


def test_empty_values(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a")], "id int, category string")
    assert ids(f.non_blank(df, "category")) == [3]
    assert ids(f.eq_if(df, "category", "")) == [1, 2, 3]
    assert rows(f.label_category(df, "none").select("category")) == [("none",), ("",), ("a",)]
    assert rows(f.label_category(df, "none", empty_too=True).select("category")) == [("none",), ("none",), ("a",)]


def test_labels_and_defaults(spark):
    df = spark.createDataFrame([("card",), ("gift",), (None,)], "payment_method string")
    assert [r[1] for r in rows(f.with_label(df, "payment_method", PAYMENT_METHODS))] == [
        PAYMENT_METHODS["card"], "gift", None]
    filled = f.with_defaults(df, "sales_transaction")
    assert rows(filled) == [("card", "completed"), ("gift", "completed"), ("cash", "completed")]


def test_stock_levels(spark):
    df = spark.createDataFrame([(1, 0, 10, True), (2, 10, 10, True), (3, 20, 10, True), (4, 21, 10, True), (5, 0, 10, False)],
                               "id int, quantity int, reorder_level int, is_active boolean")
    shown = f.with_stock_band(f.with_stock_status(df)).select("stock_status", "stock_band")
    assert rows(shown) == [("out", "red"), ("low", "red"), ("in_stock", "yellow"), ("in_stock", "green"), ("out", "red")]
    assert ids(f.low_stock(df)) == [1, 2, 5]
    assert ids(f.low_stock(df, active_only=True)) == [1, 2]
    assert ids(f.out_of_stock(df)) == [1]


def test_history_guard(spark):
    df = spark.createDataFrame([("a", m) for m in range(6)] + [("b", m) for m in range(5)], "id string, month int")
    assert ids(f.enough_history(df, ["id"])) == ["a"] * 6
    assert f.enough_history(df.where("id = 'b'")).count() == 0


def test_ranges_reach_the_scan(tables, tmp_path, spark):
    from bizmetrics.sources.entities import load_entity, store_entity
    store_entity(tables.expense, str(tmp_path), "expense")
    stored = load_entity(spark, str(tmp_path), "expense")
    plan = plan_of(f.in_month(stored, "date", "2001-07-15").select("amount"))
    assert "GreaterThanOrEqual(date,2001-07-01)" in plan and "LessThan(date,2001-08-01)" in plan
    assert "ReadSchema: struct<amount:decimal(15,2),date:date>" in plan
