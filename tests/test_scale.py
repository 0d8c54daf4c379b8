"""Plans that must hold at scale."""

import pytest
from pyspark.sql import functions as F

from bizmetrics.operators.joins import with_category, with_product
from conftest import DATA, plan_of
from registry import REGISTRY

WITH_EFFECTS = {"load_entity", "load_entity_by_year", "load_entity_range", "load_product_sales", "stream_stock",
                "stream_stock_on_hand", "stream_daily_movements", "forecast_by_index_by_country",
                "train_all", "forecast_next", "forecast_report", "forecast_by_index", "feature_importance", "forecast_vs_actual"}


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in REGISTRY if n not in WITH_EFFECTS])
def test_no_cross_joins_and_no_python_rows(spark, name):
    plan = physical(REGISTRY[name].run(spark, DATA))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_hot_key_lookup_is_split(spark, conf):
    """A product with a third of all movements, too many products to broadcast."""
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.shuffle.partitions", "40")
    conf("spark.sql.adaptive.coalescePartitions.enabled", "false")
    conf("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "100KB")
    conf("spark.sql.adaptive.advisoryPartitionSizeInBytes", "50KB")
    movements = spark.range(0, 300_000, 1, 20).select(
        "id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 5000).alias("product_id"),
        F.sha2(F.col("id").cast("string"), 256).alias("reference_number"))
    products = spark.range(5000).select(
        "id", F.concat(F.lit("p"), "id").alias("name"), F.concat(F.lit("P"), "id").alias("product_code"))
    joined = with_product(movements, products)
    assert joined.count() == 300_000
    assert "skew=true" in plan_of(joined.select("id", "reference_number", "product_name"))


def test_missing_category_rows_are_split_too(spark, conf):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.shuffle.partitions", "40")
    conf("spark.sql.adaptive.coalescePartitions.enabled", "false")
    conf("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "100KB")
    conf("spark.sql.adaptive.advisoryPartitionSizeInBytes", "50KB")
    expenses = spark.range(0, 300_000, 1, 20).select(
        "id", F.when(F.col("id") % 3 > 0, F.col("id") % 5000).alias("category_id"),
        F.sha2(F.col("id").cast("string"), 256).alias("title"))
    categories = spark.range(5000).select("id", F.concat(F.lit("c"), "id").alias("name"))
    joined = with_category(expenses, categories)
    assert joined.where("category_name is null").count() == 100_000
    assert "skew=true" in plan_of(joined)


def test_category_totals_join_after_the_sum(spark, tables):
    from bizmetrics.operators.expenses import category_totals
    plan = physical(category_totals(tables.expense, tables.expense_category))
    lookup = plan.index("LeftOuter")
    assert "partial_sum(amount" in plan[lookup:]


def test_month_bounds_reach_the_orders_scan(spark, conf):
    conf("spark.sql.maxMetadataStringLength", "1000")
    plan = physical(REGISTRY["kpi_board"].run(spark, DATA))
    assert "GreaterThanOrEqual(o_orderdate,2001-06-01" in plan and "LessThan(o_orderdate,2001-08-01" in plan
    assert "LessThan(l_shipdate,2001-08-01" in plan
