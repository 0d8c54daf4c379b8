"""Queries whose order is the feature: the rows in sequence, against the SQL sorted as asked."""

import duckdb
import pytest

from conftest import DATA
from registry import REGISTRY
from registry.views import GIVEN
from verify import cell

ORDERS = {
    "order_by_keys": "name, id",
    "active_products_by_name": "name, id",
    "category_list": "name",
    "top_k": "amount DESC, id",
    "low_stock_report": "quantity, product_code",
    "inventory_value_report": "quantity DESC, product_code",
    "sales_series": "month",
    "sales_rows": "month DESC",
    "expense_rows": "date DESC, id, title, amount, category NULLS FIRST, status",
    "movement_rows": "created_at DESC, id DESC",
    "sales_chart": "month",
    "sales_list": "month DESC",
    "transaction_list": "transaction_date DESC, id",
    "product_list": "product_code",
    "page_tied_key": "status DESC, id",
}


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in GIVEN:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", ORDERS)
def test_rows_come_in_order(spark, con, name):
    df = REGISTRY[name].run(spark, DATA)
    order = sorted(df.columns)
    got = [tuple(cell(r[c]) for c in order) for r in df.collect()]
    found = con.execute(f"SELECT * FROM ({REGISTRY[name].sql}) q ORDER BY {ORDERS[name]}")
    at = [[d[0] for d in found.description].index(c) for c in order]
    want = [tuple(cell(r[i]) for i in at) for r in found.fetchall()]
    assert got == want and len(got) > 1
