"""Lookups between entities.

No join carries a broadcast hint: Catalyst broadcasts a side only when its statistics
put it under ``spark.sql.autoBroadcastJoinThreshold``, and beyond that a sort-merge
join with the adaptive skew split takes over. Aggregations by a looked-up name are
done before the lookup (see ``expenses`` and ``inventory``), not here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from bizmetrics.operators.filters import with_line_total


def with_category(expenses: DataFrame, categories: DataFrame) -> DataFrame:
    names = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category_name"))
    return expenses.join(names, "category_id", "left")


def with_product(movements: DataFrame, products: DataFrame) -> DataFrame:
    names = products.select(
        F.col("id").alias("product_id"), F.col("name").alias("product_name"), "product_code")
    return movements.join(names, "product_id")


def product_movements(movements: DataFrame, product_id: int, n: int = 20) -> DataFrame:
    """Newest ``n`` movements of one product: a pushed filter and a top-k."""
    return (movements.where(F.col("product_id") == product_id)
            .orderBy(F.desc("created_at"), F.desc("id"), "movement_type", "quantity").limit(n))


def latest_movements(movements: DataFrame, n: int = 20) -> DataFrame:
    """Newest ``n`` movements of every product. Each map task keeps at most ``n`` rows of
    a product before the shuffle, so a hot product stays small."""
    newest = Window.partitionBy("product_id").orderBy(
        F.desc("created_at"), F.desc("id"), "movement_type", "quantity")
    return movements.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= n)


def _category_ids_in_use(expenses: DataFrame) -> DataFrame:
    # Distinct first: its map-side step leaves one row per category and task.
    return expenses.select(F.col("category_id").alias("id")).where(F.col("id").isNotNull()).distinct()


def used_categories(categories: DataFrame, expenses: DataFrame) -> DataFrame:
    return categories.join(_category_ids_in_use(expenses), "id", "left_semi")


def unused_categories(categories: DataFrame, expenses: DataFrame) -> DataFrame:
    return categories.join(_category_ids_in_use(expenses), "id", "left_anti")


def with_parent(categories: DataFrame) -> DataFrame:
    parents = categories.select(
        F.col("id").alias("parent_category_id"), F.col("name").alias("parent_name"))
    return categories.join(parents, "parent_category_id", "left")


def invoice_lines(invoices: DataFrame, items: DataFrame) -> DataFrame:
    """Items with their line total and the number of their invoice."""
    numbers = invoices.select(F.col("id").alias("invoice_id"), "invoice_number")
    return with_line_total(items).join(numbers, "invoice_id")


def with_transaction(invoices: DataFrame, transactions: DataFrame) -> DataFrame:
    """Invoices with the code, amount and status of their transaction, if they have one."""
    sales = transactions.select(
        F.col("id").alias("transaction_id"), F.col("transaction_id").alias("transaction_code"),
        F.col("amount").alias("transaction_amount"), F.col("status").alias("transaction_status"))
    return invoices.join(sales, "transaction_id", "left")
