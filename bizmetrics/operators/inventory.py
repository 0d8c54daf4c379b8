"""Stock figures: values, counts and movements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from bizmetrics.functions.dates import AsOf
from bizmetrics.functions.numbers import or_zero
from bizmetrics.operators.filters import active, eq_if, is_low_stock, low_stock, non_blank, on_day, search
from bizmetrics.operators.joins import with_product
from bizmetrics.operators.ordering import bucketed_slices
from bizmetrics.schemas import MOVEMENT_SIGN


def product_filter(products: DataFrame, category: str | None = None, low_only: bool = False,
                   term: str | None = None) -> DataFrame:
    chosen = eq_if(products, "category", category)
    if low_only:
        chosen = low_stock(chosen)
    return search(chosen, ["name", "product_code", "barcode"], term)


def _value() -> Column:
    return or_zero(F.sum(F.col("quantity") * F.col("unit_price")))


def product_summary(products: DataFrame, **filters: object) -> DataFrame:
    return product_filter(products, **filters).agg(
        F.count(F.lit(1)).alias("total_products"),
        _value().alias("total_value"),
        F.count_if(is_low_stock()).alias("low_stock_count"))


def product_categories(products: DataFrame) -> DataFrame:
    return non_blank(products, "category").select("category").distinct()


def inventory_value(products: DataFrame, active_only: bool = True) -> DataFrame:
    return (active(products) if active_only else products).agg(_value().alias("total_value"))


def stock_counts(products: DataFrame) -> DataFrame:
    """Active, active and low, active and out, in one pass."""
    return active(products).agg(
        F.count(F.lit(1)).alias("active_products"),
        F.count_if(is_low_stock()).alias("low_stock"),
        F.count_if(F.col("quantity") == 0).alias("out_of_stock"))


def movements_on_day(movements: DataFrame, day: AsOf) -> DataFrame:
    return on_day(movements, "created_at", day).agg(F.count(F.lit(1)).alias("movements"))


def top_out_products(movements: DataFrame, products: DataFrame, n: int = 5) -> DataFrame:
    """Products by quantity moved out. Summed per product id first (the code is unique, so
    name and code add no groups), joined after, cut last."""
    out = (movements.where(F.col("movement_type") == "out")
           .groupBy("product_id").agg(F.sum("quantity").alias("total_out")))
    return (with_product(out, products).select("product_name", "product_code", "total_out")
            .orderBy(F.desc("total_out"), "product_code").limit(n))


def signed_quantity() -> Column:
    """In and return add to the stock, out and damage take from it, other codes do nothing."""
    kind = F.col("movement_type")
    plus = [k for k, sign in MOVEMENT_SIGN.items() if sign > 0]
    minus = [k for k, sign in MOVEMENT_SIGN.items() if sign < 0]
    quantity = F.col("quantity").cast("bigint")
    return F.when(kind.isin(plus), quantity).when(kind.isin(minus), -quantity).otherwise(F.lit(0))


def stock_on_hand(products: DataFrame, movements: DataFrame) -> DataFrame:
    """Opening quantity plus all signed movements, for every product."""
    net = movements.groupBy(F.col("product_id").alias("id")).agg(F.sum(signed_quantity()).alias("_net"))
    return products.join(net, "id", "left").select(
        "id", "product_code", F.col("quantity").alias("opening"),
        F.coalesce("_net", F.lit(0)).alias("moved"),
        (F.col("quantity") + F.coalesce("_net", F.lit(0))).alias("stock"))


def running_stock(movements: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """Every movement with the sum of its product's movements up to and including it; with
    ``products``, on top of their opening quantity.

    A product may own a third of all movements, so no task ever holds a whole product:
    the rows are cut into slices of the order (product, time, id), summed inside their
    slice, and raised by what earlier slices of the same product add up to. The rows move once: slices
    are stored as buckets, and the sums inside them read them bucket by bucket.
    """
    # The trailing columns only matter where ids repeat.
    order = ["product_id", "created_at", "id", "movement_type", "quantity"]
    slices = bucketed_slices(movements.withColumn("_signed", signed_quantity()), order)
    carried = carried_forward(
        slices.groupBy("_bucket", "_slice", "product_id").agg(F.sum("_signed").alias("_sum")), "product_id", "_sum")
    inside = (Window.partitionBy("_bucket", "_slice", "product_id").orderBy("_place")
              .rowsBetween(Window.unboundedPreceding, 0))
    # Broadcast is safe: one row per slice at most (see ``carried_forward``).
    moved = (slices.withColumn("_within", F.sum("_signed").over(inside))
             .join(F.broadcast(carried), (F.col("_slice") == F.col("_into")) & F.col("product_id").eqNullSafe(F.col("_key")),
                   "left")
             .withColumn("running_stock", F.col("_within") + F.coalesce("_carried", F.lit(0)))
             .drop("_bucket", "_slice", "_place", "_into", "_key", "_signed", "_within", "_carried"))
    if products is None:
        return moved
    opening = products.select(F.col("id").alias("product_id"), F.col("quantity").alias("_opening"))
    return (moved.join(opening, "product_id")
            .withColumn("running_stock", F.col("running_stock") + F.col("_opening")).drop("_opening"))


def carried_forward(slice_sums: DataFrame, key: str, value: str) -> DataFrame:
    """Per slice, the sum its first key brings along from earlier slices.

    Slices are consecutive in key order, so only the first key of a slice can have begun
    before it: the result has at most one row per slice and is safe to broadcast.
    """
    earlier = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    return (slice_sums.withColumn("_carried", F.sum(value).over(earlier))
            .where(F.col("_carried").isNotNull())
            .select(F.col("_slice").alias("_into"), F.col(key).alias("_key"), "_carried"))
