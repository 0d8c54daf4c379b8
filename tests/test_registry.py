"""Every registered query against its SQL, on the smallest data."""

import duckdb
import pytest

from conftest import DATA
from registry import REGISTRY
from registry.views import GIVEN
from verify import compare


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in GIVEN:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


#: No series is long enough there.
EMPTY_HERE = {"enough_history"}


@pytest.mark.parametrize("name", [n for n, q in REGISTRY.items() if q.sql])
def test_same_as_sql(spark, con, name):
    problem = compare(spark, con, name, REGISTRY[name].run, REGISTRY[name].sql, DATA)
    # An empty result proves nothing, but a few questions have an empty answer on the smallest data.
    assert problem is None or (problem == "both empty" and name in EMPTY_HERE)


def test_keyed_report_is_whole(spark, monkeypatch):
    """With the trees a report has by default, and all its columns."""
    from registry import forecasts
    asked = []
    monkeypatch.setattr(forecasts, "forecast_report", lambda sales, *how, **models: asked.append((how, models)) or sales)
    got = REGISTRY["forecast_report_by_country"].run(spark, DATA)
    assert asked == [((forecasts.AS_OF, forecasts.BY), {})] and got.columns == ["country", "month", "revenue"]
    assert REGISTRY["forecast_report_by_country_checks"].sql


def test_driver_contract(spark):
    import __spark_entry__ as entry
    assert set(entry.oracle_sql()) <= set(entry.queries())
    row = entry.entry(spark).first()
    # Expected figures for this data, as computed independently.
    assert (row.current_revenue, row.revenue_change, row.current_expenses, row.expense_change) == (
        7678264.94, 112.8, 1921898.56, 133.86)
    assert (row.current_profit, row.profit_change, row.total_transactions) == (5756366.38, 106.59, 31)
    assert (row.total_inventory_value, row.low_stock_count) == (4040843.50, 59)
