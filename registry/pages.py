"""Sorting, top-k, pages and list views."""

from bizmetrics.operators import ordering as o, sales as s
from bizmetrics.plans import lists
from registry.core import query


def _page_sql(table, order, number, size, where="true", columns="*"):
    """``number`` may be any SQL over ``pages``, the page count."""
    return f"""
    SELECT {columns}, CAST(n AS BIGINT) AS page_number, CAST(pages AS BIGINT) AS page_count,
           CAST(total AS BIGINT) AS page_row_count, CAST((n - 1) * {size} + 1 AS BIGINT) AS page_start_index,
           CAST(least(n * {size}, total) AS BIGINT) AS page_end_index
    FROM (SELECT *, row_number() OVER (ORDER BY {order}) AS rn FROM {table} WHERE {where}) r,
         (SELECT *, {number} AS n FROM (
             SELECT COUNT(*) AS total, greatest(1, (COUNT(*) + {size} - 1) // {size}) AS pages
             FROM {table} WHERE {where}) c) p
    WHERE rn > (n - 1) * {size} AND rn <= n * {size}"""


MOVEMENT = "id, product_id, movement_type, quantity, created_at"
MOVEMENT_ORDER = "created_at DESC, id DESC, product_id, movement_type, quantity"
EXPENSE = "id, title, category_id, amount, date, description, status"
EXPENSE_ORDER = "date DESC, id, title, amount, category_id NULLS FIRST, status"
PRODUCT = ("id, product_code, barcode, name, category, quantity, unit_price, reorder_level, location, is_active")
TRANSACTION = "id, transaction_id, transaction_date, amount, payment_method, status, customer_name"


@query("order_by_keys", "SELECT * FROM expense_category")
def _(t):
    return t.expense_category.orderBy(*o.sort_keys(["name", "id"]))


@query("top_k", """
    SELECT id, transaction_date, amount FROM sales_transaction ORDER BY amount DESC, id LIMIT 20""", "amount")
def _(t):
    return t.sales_transaction.select("id", "transaction_date", "amount").orderBy(*o.sort_keys(["-amount", "id"])).limit(20)


@query("best_month", """
    SELECT month, revenue, transaction_count FROM monthly_sales ORDER BY revenue DESC, month DESC LIMIT 1""", "revenue")
def _(t):
    return s.best_month(t.monthly_sales)


@query("best_month_by_method", """
    SELECT payment_method, month, revenue, transaction_count FROM (
        SELECT *, row_number() OVER (PARTITION BY payment_method ORDER BY revenue DESC, month DESC) AS rn FROM (
            SELECT payment_method, CAST(date_trunc('month', transaction_date) AS DATE) AS month,
                   SUM(amount) AS revenue, COUNT(*) AS transaction_count
            FROM sales_transaction GROUP BY 1, 2) m) x WHERE rn = 1""", "revenue")
def _(t):
    return s.best_month(s.rollup_monthly(t.sales_transaction, ["payment_method"]), ["payment_method"])


@query("page", _page_sql("product", "product_code", "2", 20, columns=PRODUCT), "unit_price")
def _(t):
    return o.page(t.product, ["product_code"], 2).described()


@query("page_not_a_number", _page_sql("product", "product_code", "1", 20, columns=PRODUCT), "unit_price")
def _(t):
    return o.page(t.product, ["product_code"], "x").described()


@query("page_beyond_end", _page_sql("product", "product_code", "pages", 20, columns=PRODUCT), "unit_price")
def _(t):
    return o.page(t.product, ["product_code"], 10**9).described()


@query("global_row_number", f"SELECT *, row_number() OVER (ORDER BY {MOVEMENT_ORDER}) AS row_number FROM inventory_movement")
def _(t):
    return o.global_row_number(t.inventory_movement, ["-created_at", "-id", "product_id", "movement_type", "quantity"])


@query("sales_list", _page_sql("monthly_sales", "month DESC", "1", 20, "year(month) = 2000",
                               "month, revenue, transaction_count"), "revenue")
def _(t):
    return lists.sales_list(t.monthly_sales, year="2000").described()


@query("transaction_list", _page_sql("transaction_named", "transaction_date DESC, id", "3", 20, columns=TRANSACTION),
       "amount")
def _(t):
    return lists.transaction_list(t.transaction_named, number="3").described()


@query("transaction_list_last", _page_sql("transaction_named", "transaction_date DESC, id", "pages", 20,
                                          columns=TRANSACTION), "amount")
def _(t):
    return lists.transaction_list(t.transaction_named, number=0).described()


@query("expense_list", _page_sql(
    "expense", EXPENSE_ORDER, "2", 20,
    "category_id = 3 AND date >= DATE '1999-01-01' AND (contains(lower(title), 'po') "
    "OR COALESCE(contains(lower(description), 'po'), false))", EXPENSE), "amount")
def _(t):
    return lists.expense_list(t.expense, 2, category_id=3, from_date="1999-01-01", term="PO").described()


@query("product_list", _page_sql("product", "product_code", "1", 20, "quantity <= reorder_level AND category = 'SMALL'",
                                 PRODUCT), "unit_price")
def _(t):
    return lists.product_list(t.product, category="SMALL", low_only=True).described()


@query("movement_list", _page_sql("inventory_movement", MOVEMENT_ORDER, "4", 30, "movement_type = 'out'", MOVEMENT))
def _(t):
    return lists.movement_list(t.inventory_movement, "out", 4).described()


@query("movement_list_deep", _page_sql("inventory_movement", MOVEMENT_ORDER, "pages // 2", 30, columns=MOVEMENT))
def _(t):
    return lists.movement_list(t.inventory_movement, number=lambda pages: pages // 2).described()


@query("page_tied_key", _page_sql(
    "sales_transaction", "status DESC, id, transaction_id, transaction_date, amount, payment_method", "pages * 2 // 3", 50,
    columns="id, transaction_id, transaction_date, amount, payment_method, status"), "amount")
def _(t):
    """Three statuses only: the other columns tell the rows apart."""
    return o.page(t.sales_transaction, ["-status"], lambda pages: pages * 2 // 3, 50).described()


@query("category_list", "SELECT * FROM expense_category")
def _(t):
    return lists.category_list(t.expense_category)


@query("active_products_by_name", "SELECT id, name FROM product WHERE is_active")
def _(t):
    return t.product.where("is_active").select("id", "name").orderBy(*o.sort_keys(["name", "id"]))
