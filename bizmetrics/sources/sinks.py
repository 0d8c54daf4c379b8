"""Export frames, and CSV / JSON writers for them.

The ``*_frame`` functions build exactly the rows an export holds; the ``export_*``
functions write them. A sorted export is range-partitioned by Spark, and every sort
ends in tie-break columns, so equal dates do not pile up in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from bizmetrics.functions.dates import ISO_DAY, ISO_MINUTE
from bizmetrics.operators.filters import active
from bizmetrics.operators.joins import with_category


#: Quotes inside a cell are doubled, as other programs write and expect them.
CSV = {"header": True, "escape": '"', "dateFormat": ISO_DAY}


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(**CSV).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What ``write_csv`` wrote, with the types it had. An empty cell is NULL; an empty text is told apart from it
    by its quotes, for which the text that would mean NULL must be one that no cell holds."""
    return spark.read.schema(schema).options(**CSV, multiLine=True, emptyValue="", nullValue="\0").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def sales_export_frame(sales: DataFrame) -> DataFrame:
    return sales.select("month", "revenue", "transaction_count").orderBy("month")


def export_sales_csv(sales: DataFrame, path: str) -> None:
    write_csv(sales_export_frame(sales), path)


def expenses_export_frame(expenses: DataFrame, categories: DataFrame) -> DataFrame:
    return (with_category(expenses, categories)
            .select("title", "amount", "date", "category_name", "description")
            .orderBy(F.desc("date"), "title", "amount", "category_name", "description"))


def export_expenses_csv(expenses: DataFrame, categories: DataFrame, path: str) -> None:
    write_csv(expenses_export_frame(expenses, categories), path)


def inventory_export_frame(products: DataFrame) -> DataFrame:
    return active(products).select("product_code", "name", "category", "quantity", "unit_price", "location")


def export_inventory_csv(products: DataFrame, path: str) -> None:
    write_csv(inventory_export_frame(products), path)


def report_export_frame(sales: DataFrame) -> DataFrame:
    return sales.select("month", "revenue", "transaction_count").orderBy(F.desc("month"))


def export_report_csv(sales: DataFrame, path: str) -> None:
    write_csv(report_export_frame(sales), path)


def sales_rows(sales: DataFrame) -> DataFrame:
    """Date text, amount as double, count: the shape of a sales JSON row. Newest first."""
    return sales.orderBy(F.desc("month")).select(
        F.date_format("month", ISO_DAY).alias("month"),
        F.col("revenue").cast("double").alias("revenue"), "transaction_count")


def expense_rows(expenses: DataFrame, categories: DataFrame) -> DataFrame:
    """Newest first, with the category's name (NULL if none)."""
    return (with_category(expenses, categories)
            .orderBy(F.desc("date"), "id", "title", "amount", "category_name", "status")
            .select("id", "title", F.col("amount").cast("double").alias("amount"),
                    F.date_format("date", ISO_DAY).alias("date"),
                    F.col("category_name").alias("category"), "status"))


def product_rows(products: DataFrame) -> DataFrame:
    return active(products).select(
        "id", "product_code", "name", "category", "quantity", "unit_price", "reorder_level")


def movement_rows(movements: DataFrame, products: DataFrame, n: int = 100) -> DataFrame:
    """The newest ``n`` movements with product name and a timestamp to the minute. They are cut before the
    product is looked up; one whose product is gone keeps its row, without a name."""
    newest = [F.desc("created_at"), F.desc("id"), F.desc("product_id"), "movement_type", "quantity"]
    names = products.select(F.col("id").alias("product_id"), F.col("name").alias("product"))
    return (movements.orderBy(*newest).limit(n).join(names, "product_id", "left")
            .orderBy(*newest)
            .select("id", "product", "movement_type", "quantity", F.date_format("created_at", ISO_MINUTE).alias("created_at")))
