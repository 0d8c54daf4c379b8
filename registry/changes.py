"""Changes to tables."""

import datetime as dt

from pyspark.sql import functions as F

from bizmetrics.operators import changes as c, filters as f
from bizmetrics.operators.inventory import stock_on_hand
from bizmetrics.sources import snapshots
from registry.core import AS_OF, query

STAMP = dt.datetime(2001, 7, 15, 12, 0)


def _apply_sql(base, changes, columns):
    """The changes replayed one after another, each on what the ones before have left of its row."""
    names = ", ".join(columns)
    new = ", ".join(f"CASE WHEN c.op = 'delete' OR (c.op = 'update' AND NOT r.there) THEN r.{x} ELSE c.{x} END" for x in columns)
    return f"""
    WITH RECURSIVE numbered AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS n FROM {changes}),
    replay(id, n, there, {names}) AS (
        SELECT k.id, CAST(0 AS BIGINT), b.id IS NOT NULL, {', '.join(f'b.{x}' for x in columns)}
        FROM (SELECT DISTINCT id FROM numbered) k LEFT JOIN {base} b ON k.id = b.id
        UNION ALL
        SELECT r.id, c.n, CASE c.op WHEN 'delete' THEN false WHEN 'update' THEN r.there ELSE true END, {new}
        FROM replay r JOIN numbered c ON c.id = r.id AND c.n = r.n + 1)
    SELECT id, {names} FROM {base} WHERE id NOT IN (SELECT id FROM numbered)
    UNION ALL
    SELECT id, {names} FROM replay r WHERE there AND n = (SELECT max(n) FROM numbered c WHERE c.id = r.id)"""


@query("apply_changes", _apply_sql("expense_category", "category_changes", ["name", "parent_category_id", "is_active"]))
def _(t):
    return c.apply_changes(t.expense_category, t.category_changes, "id", STAMP)


PRODUCT_COLUMNS = ["product_code", "name", "quantity", "unit_price", "is_active"]


@query("apply_changes_products", _apply_sql("product", "product_changes", PRODUCT_COLUMNS), "unit_price")
def _(t):
    return c.apply_changes(t.product.select("id", *PRODUCT_COLUMNS), t.product_changes, "id", STAMP)


@query("apply_changes_stored", _apply_sql("product", "product_changes", PRODUCT_COLUMNS), "unit_price")
def _(t):
    """The same changes as two commits to a stored table, in partitions that rows move between."""
    folder = t.scratch
    snapshots.create(t.product.select("id", *PRODUCT_COLUMNS), folder, "quantity % 8")
    for batch in (t.product_changes.where("seq < 5"), t.product_changes.where("seq >= 5")):
        snapshots.apply(t.spark, folder, batch, "id", STAMP)
    return snapshots.read(t.spark, folder)


STAMPED = "TIMESTAMP '2001-07-15 12:00:00'"


@query("apply_changes_stamped", f"""
    SELECT x.id, x.name, CASE WHEN b.id IS NULL OR x.name LIKE '% back' THEN {STAMPED} END AS created_at,
           CASE WHEN c.id IS NOT NULL THEN {STAMPED} END AS updated_at
    FROM ({_apply_sql("expense_category", "category_changes", ["name", "parent_category_id", "is_active"])}) x
    LEFT JOIN expense_category b ON x.id = b.id LEFT JOIN (SELECT DISTINCT id FROM category_changes) c ON x.id = c.id""")
def _(t):
    none = F.lit(None).cast("timestamp_ntz")
    base = t.expense_category.select("id", "name").withColumns({"created_at": none, "updated_at": none})
    return c.apply_changes(base, t.category_changes, "id", STAMP)


@query("cascade_delete", """
    SELECT * FROM inventory_movement WHERE product_id NOT IN (SELECT id FROM product WHERE NOT is_active)""")
def _(t):
    return c.cascade_delete(t.inventory_movement, t.product.where(~F.col("is_active")), "product_id")


CANCELLED = "SELECT id FROM sales_transaction WHERE status = 'cancelled'"


def _cascade(t):
    gone = f.eq_if(t.sales_transaction, "status", "cancelled")
    return c.cascade_transactions(t.sales_transaction, t.sales_invoice, t.invoice_item, gone)


@query("cascade_transactions", f"SELECT * FROM sales_transaction WHERE id NOT IN ({CANCELLED})", "amount")
def _(t):
    return _cascade(t)[0]


@query("cascade_invoices", f"""
    SELECT * FROM sales_invoice WHERE transaction_id IS NULL OR transaction_id NOT IN ({CANCELLED})""", "total_amount")
def _(t):
    return _cascade(t)[1]


@query("cascade_items", f"""
    SELECT * FROM invoice_item WHERE invoice_id NOT IN (
        SELECT id FROM sales_invoice WHERE transaction_id IN ({CANCELLED}))""", "unit_price discount")
def _(t):
    return _cascade(t)[2]


@query("set_null", """
    SELECT * REPLACE (CASE WHEN category_id IN (SELECT id FROM expense_category WHERE NOT is_active) THEN NULL
                           ELSE category_id END AS category_id) FROM expense""", "amount")
def _(t):
    return c.set_null(t.expense, t.expense_category.where(~F.col("is_active")), "category_id")


@query("set_null_parent", """
    SELECT * REPLACE (CASE WHEN parent_category_id IN (SELECT id FROM expense_category WHERE name LIKE 'A%') THEN NULL
                           ELSE parent_category_id END AS parent_category_id) FROM expense_category""")
def _(t):
    return c.set_null(t.expense_category, t.expense_category.where(F.col("name").startswith("A")), "parent_category_id")


@query("restricted_delete", """
    SELECT id, name, CASE WHEN id IN (SELECT category_id FROM expense WHERE category_id IS NOT NULL) THEN 'refused'
                          ELSE 'deleted' END AS outcome FROM expense_category WHERE is_active""")
def _(t):
    return c.restricted_delete(t.expense_category, t.expense, f.active(t.expense_category))


STOCK_SQL = """
    SELECT p.id, product_code, p.quantity AS opening, CAST(COALESCE(moved, 0) AS BIGINT) AS moved,
           CAST(p.quantity + COALESCE(moved, 0) AS BIGINT) AS stock
    FROM product p LEFT JOIN (
        SELECT product_id, SUM(CASE WHEN movement_type IN ('in', 'return') THEN quantity ELSE -quantity END) AS moved
        FROM inventory_movement GROUP BY product_id) m ON p.id = m.product_id"""


@query("stock_on_hand", STOCK_SQL)
def _(t):
    return stock_on_hand(t.product, t.inventory_movement)
