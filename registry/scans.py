"""Scans, sources and export frames."""

from pyspark.sql import functions as F

from bizmetrics.operators.filters import by_key, with_line_total
from bizmetrics.operators.sales import sales_series
from bizmetrics.sources import sinks
from bizmetrics.sources.entities import conform, load_entity, store_entity
from bizmetrics.sources.product_sales import clean_product_sales, load_product_sales, load_rejected_product_sales
from registry.core import query

NULL_TS = "CAST(NULL AS TIMESTAMP)"
NULL_TEXT = "CAST(NULL AS VARCHAR)"

ENTITY_SQL = {
    "monthly_sales": (f"SELECT *, {NULL_TS} AS created_at, {NULL_TS} AS updated_at FROM monthly_sales", "revenue"),
    "sales_transaction": (
        f"SELECT *, {NULL_TEXT} AS customer_phone, {NULL_TEXT} AS description, {NULL_TS} AS created_at "
        "FROM transaction_named", "amount"),
    "sales_invoice": (
        "SELECT *, CAST(NULL AS DOUBLE) AS tax_amount, CAST(NULL AS DOUBLE) AS discount_amount, "
        f"CAST(NULL AS DOUBLE) AS subtotal, {NULL_TEXT} AS notes, {NULL_TS} AS created_at, {NULL_TS} AS updated_at "
        "FROM sales_invoice", "total_amount"),
    "invoice_item": ("SELECT *, CAST(quantity * unit_price - discount AS DECIMAL(15,2)) AS total FROM invoice_item", "unit_price discount total"),
    "expense_category": (
        f"SELECT *, {NULL_TEXT} AS description, {NULL_TS} AS created_at, {NULL_TS} AS updated_at FROM expense_category", ""),
    "expense": (
        f"SELECT *, {NULL_TEXT} AS receipt_image, {NULL_TEXT} AS created_by, {NULL_TS} AS created_at, "
        f"{NULL_TS} AS updated_at FROM expense", "amount"),
    "product": (
        f"SELECT *, {NULL_TEXT} AS description, {NULL_TEXT} AS unit, {NULL_TEXT} AS supplier, "
        f"{NULL_TS} AS created_at, {NULL_TS} AS updated_at FROM product", "unit_price"),
    "inventory_movement": (
        f"SELECT *, {NULL_TEXT} AS reference_number, {NULL_TEXT} AS description, {NULL_TEXT} AS created_by "
        "FROM inventory_movement", ""),
}


#: Entities whose table here is a view with more columns.
ENTITY_VIEW = {"sales_transaction": "transaction_named"}
#: Columns an entity derives from others before it is stored.
DERIVED = {"invoice_item": with_line_total}


def _register_entities():
    for entity, (sql, doubles) in ENTITY_SQL.items():
        query(f"entity_{entity}", sql, doubles)(lambda t, entity=entity: conform(
            DERIVED.get(entity, lambda rows: rows)(t.view(ENTITY_VIEW.get(entity, entity))), entity))


_register_entities()


@query("load_entity", *ENTITY_SQL["product"])
def _(t):
    folder = t.scratch
    store_entity(t.product, folder, "product")
    return load_entity(t.spark, folder, "product")


@query("load_entity_by_year", *ENTITY_SQL["expense"])
def _(t):
    folder = t.scratch
    store_entity(t.expense, folder, "expense")
    return load_entity(t.spark, folder, "expense")


@query("load_entity_range", f"""
    SELECT * FROM ({ENTITY_SQL["expense"][0]}) x WHERE date BETWEEN DATE '1999-11-15' AND DATE '2000-02-15'""", "amount")
def _(t):
    folder = t.scratch
    store_entity(t.expense, folder, "expense")
    return load_entity(t.spark, folder, "expense", "1999-11-15", "2000-02-15")


PRODUCT_SALES_SQL = """
    SELECT * FROM (
        SELECT CAST(try_strptime(trim(date_text), '%Y-%m-%d') AS DATE) AS sale_date,
               TRY_CAST(sales_text AS DOUBLE) AS sales, TRY_CAST(profit_text AS DOUBLE) AS profit,
               TRY_CAST(units_text AS DOUBLE) AS units_sold, product, country FROM raw_product_sales) x
    WHERE sale_date IS NOT NULL AND sales IS NOT NULL AND profit IS NOT NULL AND units_sold IS NOT NULL
      AND product IS NOT NULL AND country IS NOT NULL"""


def _raw(t):
    # Headers as in the file: untrimmed.
    return t.raw_product_sales.toDF("Date ", " Sales", "Profit", " Units Sold ", "Product", "Country")


@query("load_product_sales", PRODUCT_SALES_SQL)
def _(t):
    path = t.scratch
    _raw(t).write.option("header", True).csv(path)
    return load_product_sales(t.spark, path)


def _spanning(t):
    """Some products' names go over two lines."""
    return _raw(t).withColumn("Product", F.when(F.length("Product") % 4 == 0, F.replace("Product", F.lit(" "), F.lit("\n"))).otherwise(F.col("Product")))


SPANNING_SQL = "SELECT * REPLACE (CASE WHEN length(product) % 4 = 0 THEN replace(product, ' ', chr(10)) ELSE product END AS product) FROM"


@query("load_product_sales_spanning", f"{SPANNING_SQL} ({PRODUCT_SALES_SQL}) y")
def _(t):
    """Records that span lines are read whole."""
    path = t.scratch
    _spanning(t).write.options(header=True, escape='"').csv(path)
    return load_product_sales(t.spark, path)


@query("load_product_sales_rejected", f"""
    SELECT * FROM ({SPANNING_SQL} (
        SELECT nullif(trim(date_text), '') AS sale_date, nullif(sales_text, '') AS sales, profit_text AS profit, units_text AS units_sold, product, country,
               concat_ws('; ', CASE WHEN trim(date_text) NOT LIKE '____-__-__' THEN 'Date does not parse' END,
                         CASE WHEN coalesce(sales_text, '') = '' THEN 'Sales is missing' WHEN TRY_CAST(sales_text AS DOUBLE) IS NULL THEN 'Sales does not parse' END,
                         CASE WHEN profit_text IS NULL THEN 'Profit is missing' WHEN TRY_CAST(profit_text AS DOUBLE) IS NULL THEN 'Profit does not parse' END) AS reasons
        FROM raw_product_sales) x) y WHERE reasons <> ''""")
def _(t):
    """The rows that cleaning drops, with what is wrong with them."""
    path = t.scratch
    _spanning(t).write.options(header=True, escape='"').csv(path)
    rejected = load_rejected_product_sales(t.spark, path)
    # Reasons come in the order of the file's columns; the writer turns an empty cell into an empty text.
    return rejected.drop("record").withColumns({"reasons": F.array_join("reasons", "; "), "sales": F.nullif("sales", F.lit(""))})


@query("clean_product_sales", PRODUCT_SALES_SQL)
def _(t):
    return clean_product_sales(_raw(t))


@query("sales_series", "SELECT month, revenue, transaction_count FROM monthly_sales", "revenue")
def _(t):
    return sales_series(t.monthly_sales)


@query("export_sales_csv", "SELECT month, revenue, transaction_count FROM monthly_sales", "revenue")
def _(t):
    path = t.scratch
    sinks.export_sales_csv(t.monthly_sales, path)
    return sinks.read_csv(t.spark, path, sinks.sales_export_frame(t.monthly_sales).schema)


@query("export_expenses_csv", """
    SELECT title, amount, date, name AS category_name, e.description
    FROM expense e LEFT JOIN expense_category c ON e.category_id = c.id""", "amount")
def _(t):
    path = t.scratch
    sinks.export_expenses_csv(t.expense, t.expense_category, path)
    return sinks.read_csv(t.spark, path, sinks.expenses_export_frame(t.expense, t.expense_category).schema)


@query("export_inventory_csv", """
    SELECT product_code, name, category, quantity, unit_price, location FROM product WHERE is_active""", "unit_price")
def _(t):
    path = t.scratch
    sinks.export_inventory_csv(t.product, path)
    return sinks.read_csv(t.spark, path, sinks.inventory_export_frame(t.product).schema)


@query("export_report_csv", "SELECT month, revenue, transaction_count FROM monthly_sales", "revenue")
def _(t):
    path = t.scratch
    sinks.export_report_csv(t.monthly_sales, path)
    return sinks.read_csv(t.spark, path, sinks.report_export_frame(t.monthly_sales).schema)


@query("sales_rows", """
    SELECT strftime(month, '%Y-%m-%d') AS month, CAST(revenue AS DOUBLE) AS revenue, transaction_count
    FROM monthly_sales""")
def _(t):
    return sinks.sales_rows(t.monthly_sales)


@query("expense_rows", """
    SELECT e.id, title, CAST(amount AS DOUBLE) AS amount, strftime(date, '%Y-%m-%d') AS date,
           name AS category, status
    FROM expense e LEFT JOIN expense_category c ON e.category_id = c.id""")
def _(t):
    return sinks.expense_rows(t.expense, t.expense_category)


@query("product_rows", """
    SELECT id, product_code, name, category, quantity, unit_price, reorder_level FROM product WHERE is_active""",
       "unit_price")
def _(t):
    return sinks.product_rows(t.product)


@query("movement_rows", """
    SELECT m.id, p.name AS product, movement_type, m.quantity, strftime(created_at, '%Y-%m-%d %H:%M') AS created_at
    FROM inventory_movement m JOIN product p ON m.product_id = p.id
    ORDER BY m.created_at DESC, m.id DESC, m.product_id DESC, movement_type, m.quantity LIMIT 100""")
def _(t):
    return sinks.movement_rows(t.inventory_movement, t.product)


@query("movement_rows_orphans", """
    SELECT m.id, p.name AS product, movement_type, m.quantity, strftime(created_at, '%Y-%m-%d %H:%M') AS created_at
    FROM inventory_movement m LEFT JOIN (SELECT * FROM product WHERE id % 3 > 0) p ON m.product_id = p.id
    ORDER BY m.created_at DESC, m.id DESC, m.product_id DESC, movement_type, m.quantity LIMIT 100""")
def _(t):
    """A third of the products is gone: still the newest 100."""
    return sinks.movement_rows(t.inventory_movement, t.product.where("id % 3 > 0"))


@query("load_entity_by_key", f"SELECT * FROM ({ENTITY_SQL['inventory_movement'][0]}) x WHERE id = (SELECT max(id) FROM inventory_movement)")
def _(t):
    """One row of a stored entity, found by its key's Bloom filters."""
    folder = t.scratch
    store_entity(t.inventory_movement, folder, "inventory_movement")
    newest = t.inventory_movement.agg(F.max("id")).first()[0]
    return by_key(load_entity(t.spark, folder, "inventory_movement"), newest)
