"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8) choose the
data and the cores. Each query runs in full into a sink that discards its rows.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from bizmetrics.operators.forecast import regression_metrics, train_all  # noqa: E402
from bizmetrics.operators.timeseries import forecast_features  # noqa: E402
from bizmetrics.session import build_session, cut_lineage  # noqa: E402
from registry import runners  # noqa: E402
from registry.core import Tables  # noqa: E402
from registry.views import GIVEN  # noqa: E402

HEADLINE = [
    "kpi_board", "home_summary", "sales_board", "expense_board", "inventory_board", "low_stock_report",
    "rollup_monthly", "expense_summary_filtered", "search_description", "quality_rejected", "duplicate_keys",
    "with_category", "with_product", "invoice_lines", "with_transaction", "latest_movements",
    "top_categories_year", "category_chart", "expense_daily_chart", "top_out_products",
    "monthly_resample_by_product", "monthly_resample_gaps", "sales_by_country", "clean_product_sales",
    "forecast_features_by_country", "growth_rate_by_country", "trend_line_by_country", "mom_change_by_country",
    "running_stock", "stock_on_hand", "movement_list", "movement_list_deep", "global_row_number",
    "apply_changes_products", "cascade_items", "set_null", "stream_stock", "stream_daily_movements",
    "forecast_report", "forecast_by_index", "page_tied_key", "movement_rows", "stream_stock_in_batches",
]


BASELINE_MONTHS = 36


def prepare_training(spark, folder):
    """Feature rows of the newest 36 months: the size the stated timing target is for."""
    months = Tables(spark, folder).monthly_sales.select("month", "revenue")
    return cut_lineage(forecast_features(months.orderBy(F.desc("month")).limit(BASELINE_MONTHS)))


def train_36_months(features):
    """Fit all three models and score them, from prepared features."""
    return regression_metrics(train_all(features).predictions)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-")})
    spark.sparkContext.setLogLevel("ERROR")
    for table in GIVEN:  # start-up costs are not the first query's
        spark.read.parquet(f"{folder}/{table}.parquet").groupBy().count().collect()
    times: dict[str, float] = {}

    def clock(name, build):
        began = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)

    wanted = sys.argv[1:] or [*HEADLINE, "train_36_months"]
    for name in wanted:
        if name == "train_36_months":
            features = prepare_training(spark, folder)
            clock(name, lambda: train_36_months(features))
        else:
            clock(name, lambda: runners()[name](spark, folder))
    spark.stop()
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": folder.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
