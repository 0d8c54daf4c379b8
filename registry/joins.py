"""Lookups, semi-joins and per-key top-k."""

from bizmetrics.operators import joins as j
from registry.core import query


@query("with_category", """
    SELECT e.*, c.name AS category_name FROM expense e LEFT JOIN expense_category c ON e.category_id = c.id""", "amount")
def _(t):
    return j.with_category(t.expense, t.expense_category)


@query("with_product", """
    SELECT m.*, p.name AS product_name, p.product_code FROM inventory_movement m JOIN product p ON m.product_id = p.id""")
def _(t):
    return j.with_product(t.inventory_movement, t.product)


@query("product_movements", """
    SELECT * FROM inventory_movement WHERE product_id = 42
    ORDER BY created_at DESC, id DESC, movement_type, quantity LIMIT 20""")
def _(t):
    return j.product_movements(t.inventory_movement, 42)


@query("latest_movements", """
    SELECT id, product_id, movement_type, quantity, created_at, CAST(rank AS INTEGER) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY created_at DESC, id DESC, movement_type, quantity)
                  AS rank FROM inventory_movement) x WHERE rank <= 20""")
def _(t):
    return j.latest_movements(t.inventory_movement)


@query("used_categories", """
    SELECT * FROM expense_category WHERE id IN (SELECT category_id FROM expense WHERE category_id IS NOT NULL)""")
def _(t):
    return j.used_categories(t.expense_category, t.expense)


@query("unused_categories", """
    SELECT * FROM expense_category WHERE id NOT IN (SELECT category_id FROM expense WHERE category_id IS NOT NULL)""")
def _(t):
    return j.unused_categories(t.expense_category, t.expense)


@query("with_parent", """
    SELECT c.*, p.name AS parent_name FROM expense_category c
    LEFT JOIN expense_category p ON c.parent_category_id = p.id""")
def _(t):
    return j.with_parent(t.expense_category)


@query("invoice_lines", """
    SELECT i.*, i.quantity * i.unit_price - i.discount AS total, v.invoice_number
    FROM invoice_item i JOIN sales_invoice v ON i.invoice_id = v.id""", "unit_price discount total")
def _(t):
    return j.invoice_lines(t.sales_invoice, t.invoice_item)


@query("with_transaction", """
    SELECT v.*, x.transaction_id AS transaction_code, x.amount AS transaction_amount, x.status AS transaction_status
    FROM sales_invoice v LEFT JOIN sales_transaction x ON v.transaction_id = x.id""", "total_amount transaction_amount")
def _(t):
    return j.with_transaction(t.sales_invoice, t.sales_transaction)
