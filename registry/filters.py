"""Projections, filters, defaults and quality rules."""

from pyspark.sql import functions as F

from bizmetrics.operators import filters as f, quality as q
from bizmetrics.schemas import (
    EXPENSE_STATUS, INVOICE_STATUS, MOVEMENT_TYPES, NO_CATEGORY, PAYMENT_METHODS, TRANSACTION_STATUS, UNITS)
from registry.core import AS_OF, query


def _case(col, mapping):
    arms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {col} {arms} ELSE {col} END"


@query("select_columns", "SELECT id, title, amount, date, status FROM expense", "amount")
def _(t):
    return t.expense.select("id", "title", "amount", "date", "status")


@query("with_total_value", "SELECT *, quantity * unit_price AS total_value FROM product", "unit_price total_value")
def _(t):
    return f.with_total_value(t.product)


@query("with_line_total", "SELECT *, quantity * unit_price - discount AS total FROM invoice_item",
       "unit_price discount total")
def _(t):
    return f.with_line_total(t.invoice_item)


@query("with_overdue", "SELECT *, due_date < DATE '2001-07-15' AND status <> 'paid' AS is_overdue FROM sales_invoice",
       "total_amount")
def _(t):
    return f.with_overdue(t.sales_invoice, AS_OF)


@query("with_paid", "SELECT *, status = 'paid' AS is_paid FROM sales_invoice", "total_amount")
def _(t):
    return f.with_paid(t.sales_invoice)


@query("with_stock_status", """
    SELECT *, CASE WHEN quantity = 0 THEN 'out' WHEN quantity <= reorder_level THEN 'low' ELSE 'in_stock' END
              AS stock_status FROM product""", "unit_price")
def _(t):
    return f.with_stock_status(t.product)


@query("with_stock_band", """
    SELECT *, CASE WHEN quantity <= reorder_level THEN 'red' WHEN quantity <= reorder_level + 10 THEN 'yellow'
              ELSE 'green' END AS stock_band FROM product""", "unit_price")
def _(t):
    return f.with_stock_band(t.product)


@query("label_category", f"SELECT id, COALESCE(category, '{NO_CATEGORY}') AS category FROM product")
def _(t):
    return f.label_category(t.product.select("id", "category"), NO_CATEGORY)


@query("label_category_empty_too", f"SELECT id, COALESCE(NULLIF(category, ''), '{NO_CATEGORY}') AS category FROM product")
def _(t):
    return f.label_category(t.product.select("id", "category"), NO_CATEGORY, empty_too=True)


@query("with_label", f"SELECT *, {_case('movement_type', MOVEMENT_TYPES)} AS movement_type_label FROM inventory_movement")
def _(t):
    return f.with_label(t.inventory_movement, "movement_type", MOVEMENT_TYPES)


@query("with_label_payment", f"SELECT id, payment_method, {_case('payment_method', PAYMENT_METHODS)} AS method "
                             "FROM sales_transaction")
def _(t):
    return f.with_label(t.sales_transaction.select("id", "payment_method"), "payment_method", PAYMENT_METHODS, "method")


@query("with_label_invoice", f"SELECT id, status, {_case('status', INVOICE_STATUS)} AS status_label FROM sales_invoice")
def _(t):
    return f.with_label(t.sales_invoice.select("id", "status"), "status", INVOICE_STATUS)


@query("with_label_transaction", f"SELECT id, status, {_case('status', TRANSACTION_STATUS)} AS status_label "
                                 "FROM sales_transaction")
def _(t):
    return f.with_label(t.sales_transaction.select("id", "status"), "status", TRANSACTION_STATUS)


@query("with_label_unit", f"SELECT id, unit, {_case('unit', UNITS)} AS unit_label FROM product_input")
def _(t):
    return f.with_label(t.product_input.select("id", "unit"), "unit", UNITS)


@query("with_label_unknown_code", f"SELECT id, status, {_case('status', EXPENSE_STATUS)} AS status_label FROM expense_input")
def _(t):
    return f.with_label(t.expense_input.select("id", "status"), "status", EXPENSE_STATUS)


@query("in_year", "SELECT * FROM expense WHERE year(date) = 2000", "amount")
def _(t):
    return f.in_year(t.expense, "date", 2000)


@query("in_month", "SELECT * FROM expense WHERE year(date) = 2001 AND month(date) = 7", "amount")
def _(t):
    return f.in_month(t.expense, "date", AS_OF)


@query("between_dates", "SELECT * FROM expense WHERE date BETWEEN DATE '1999-03-01' AND DATE '1999-05-31'", "amount")
def _(t):
    return f.between_dates(t.expense, "date", "1999-03-01", "1999-05-31")


@query("between_dates_open", "SELECT * FROM expense WHERE date <= DATE '1995-12-31'", "amount")
def _(t):
    return f.between_dates(t.expense, "date", None, "1995-12-31")


@query("trailing_days", "SELECT * FROM expense WHERE date >= DATE '2001-07-15' - 365", "amount")
def _(t):
    return f.trailing_days(t.expense, "date", AS_OF)


@query("eq_if", "SELECT * FROM inventory_movement WHERE movement_type = 'damage'")
def _(t):
    return f.eq_if(t.inventory_movement, "movement_type", "damage")


@query("eq_if_skipped", "SELECT * FROM inventory_movement")
def _(t):
    return f.eq_if(t.inventory_movement, "movement_type", "")


@query("low_stock", "SELECT * FROM product WHERE quantity <= reorder_level", "unit_price")
def _(t):
    return f.low_stock(t.product)


@query("low_stock_active", "SELECT * FROM product WHERE is_active AND quantity <= reorder_level", "unit_price")
def _(t):
    return f.low_stock(t.product, active_only=True)


@query("low_stock_literal", "SELECT * FROM product WHERE quantity <= 10", "unit_price")
def _(t):
    return f.low_stock_literal(t.product)


@query("active", "SELECT * FROM product WHERE is_active", "unit_price")
def _(t):
    return f.active(t.product)


@query("active_categories", "SELECT * FROM expense_category WHERE is_active")
def _(t):
    return f.active(t.expense_category)


@query("out_of_stock", "SELECT * FROM product WHERE is_active AND quantity = 0", "unit_price")
def _(t):
    return f.out_of_stock(t.product)


@query("search", """
    SELECT * FROM expense WHERE contains(lower(title), 'po-12') OR contains(lower(description), 'po-12')""", "amount")
def _(t):
    return f.search(t.expense, ["title", "description"], "Po-12")


@query("search_description", """
    SELECT * FROM expense WHERE contains(lower(title), lower('SUPPLIER#00000000'))
       OR contains(lower(description), lower('SUPPLIER#00000000'))""", "amount")
def _(t):
    return f.search(t.expense, ["title", "description"], "SUPPLIER#00000000")


@query("search_products", """
    SELECT * FROM product WHERE contains(lower(name), 'bc1') OR contains(lower(product_code), 'bc1')
       OR contains(lower(barcode), 'bc1')""", "unit_price")
def _(t):
    return f.search(t.product, ["name", "product_code", "barcode"], "bC1")


@query("search_literal_percent", """
    SELECT * FROM product WHERE contains(name, '%') OR contains(name, '_') OR contains(lower(name), 'widget')""",
       "unit_price")
def _(t):
    return f.search(t.product, ["name"], "%").unionByName(f.search(t.product, ["name"], "_")).unionByName(
        f.search(t.product, ["name"], "WIDGET"))


@query("search_sales", """
    SELECT * FROM monthly_sales WHERE contains(CAST(year(month) AS VARCHAR), '99')
       OR contains(CAST(revenue AS VARCHAR), '99')""", "revenue")
def _(t):
    return f.search_sales(t.monthly_sales, "99")


@query("search_any", """
    SELECT id, product_code, name, category, quantity FROM product
    WHERE contains(lower(concat_ws(' ', CAST(id AS VARCHAR), product_code, name, category, CAST(quantity AS VARCHAR))),
                   'ring promo')""")
def _(t):
    return f.search_any(t.product.select("id", "product_code", "name", "category", "quantity"), "RING promo")


@query("non_blank", "SELECT * FROM product WHERE category IS NOT NULL AND category <> ''", "unit_price")
def _(t):
    return f.non_blank(t.product, "category")


@query("on_day", "SELECT * FROM inventory_movement WHERE CAST(created_at AS DATE) = DATE '2001-07-15'")
def _(t):
    return f.on_day(t.inventory_movement, "created_at", AS_OF)


@query("by_key", "SELECT * FROM product WHERE id = 17", "unit_price")
def _(t):
    return f.by_key(t.product, 17)


@query("complete_rows", """
    SELECT * FROM expense_input WHERE id IS NOT NULL AND title IS NOT NULL AND category_id IS NOT NULL
       AND amount IS NOT NULL AND date IS NOT NULL AND description IS NOT NULL AND status IS NOT NULL""", "amount")
def _(t):
    return f.complete_rows(t.expense_input)


@query("enough_history", """
    SELECT product, month, sales FROM (
        SELECT *, COUNT(*) OVER (PARTITION BY product) AS n FROM (
            SELECT product, CAST(date_trunc('month', sale_date) AS DATE) AS month, SUM(sales) AS sales
            FROM product_sales GROUP BY 1, 2) m) x
    WHERE n >= 82""", "sales")
def _(t):
    from pyspark.sql import functions as F
    from bizmetrics.functions.dates import month_of
    monthly = t.product_sales.groupBy("product", month_of(F.col("sale_date")).alias("month")).agg(
        F.sum("sales").alias("sales"))
    return f.enough_history(monthly, ["product"], 82)


@query("with_defaults", """
    SELECT id, product_code, COALESCE(unit, 'piece') AS unit, COALESCE(quantity, 0) AS quantity,
           COALESCE(unit_price, 0) AS unit_price, COALESCE(reorder_level, 10) AS reorder_level,
           COALESCE(is_active, true) AS is_active FROM product_input""", "unit_price")
def _(t):
    return f.with_defaults(t.product_input, "product")


@query("with_defaults_absent_columns", """
    SELECT *, CAST(0 AS DOUBLE) AS tax_amount, CAST(0 AS DOUBLE) AS discount_amount, CAST(0 AS DOUBLE) AS subtotal
    FROM sales_invoice""", "total_amount")
def _(t):
    return f.with_defaults(t.sales_invoice, "sales_invoice")


# -- quality ------------------------------------------------------------------------

def _expense_rules(t):
    return q.rules_for("expense", t.expense_input.schema)


# The broken rules of a row, in rule order, joined by commas.
EXPENSE_FAILURES = """
    concat_ws(',',
        CASE WHEN title IS NULL THEN 'title_missing' END,
        CASE WHEN amount IS NULL THEN 'amount_missing' END,
        CASE WHEN date IS NULL THEN 'date_missing' END,
        CASE WHEN status IS NULL THEN 'status_missing' END,
        CASE WHEN length(title) > 200 THEN 'title_too_long' END,
        CASE WHEN length(status) > 20 THEN 'status_too_long' END,
        CASE WHEN abs(amount) >= 10000000000000 OR amount <> round(amount, 2) THEN 'amount_digits' END,
        CASE WHEN status NOT IN ('pending', 'approved', 'rejected') THEN 'status_not_allowed' END,
        CASE WHEN amount < 0 THEN 'amount_negative' END,
        CASE WHEN amount > 999999999 THEN 'amount_too_large' END)"""


@query("quality_valid", f"SELECT * FROM expense_input WHERE {EXPENSE_FAILURES} = ''", "amount")
def _(t):
    return q.quality(t.expense_input, _expense_rules(t))[0]


@query("quality_rejected", f"""
    SELECT * FROM (SELECT *, {EXPENSE_FAILURES} AS failures FROM expense_input) x WHERE failures <> ''""", "amount")
def _(t):
    from pyspark.sql import functions as F
    rejected = q.quality(t.expense_input, _expense_rules(t))[1]
    return rejected.withColumn("failures", F.concat_ws(",", "failures"))


@query("quality_revenue_not_negative", "SELECT * FROM sales_input WHERE NOT COALESCE(revenue < 0, false)", "revenue")
def _(t):
    return q.quality(t.sales_input, [q.not_negative("revenue")])[0]


@query("quality_count_not_negative", "SELECT * FROM sales_input WHERE transaction_count >= 0", "revenue")
def _(t):
    return q.quality(t.sales_input, [q.not_negative("transaction_count")])[0]


@query("quality_amount_range", "SELECT * FROM expense_input WHERE amount BETWEEN 0 AND 999999999", "amount")
def _(t):
    return q.quality(t.expense_input, [q.not_negative("amount"), q.at_most("amount", q.MAX_AMOUNT)])[0]


@query("quality_required_and_length", "SELECT * FROM expense_input WHERE title IS NOT NULL AND length(title) <= 200",
       "amount")
def _(t):
    return q.quality(t.expense_input, [q.required("title"), q.max_length("title", 200)])[0]


@query("quality_choices", "SELECT * FROM product_input WHERE unit IS NULL OR unit IN ('piece', 'kg', 'meter', 'liter', 'box')",
       "unit_price")
def _(t):
    return q.quality(t.product_input, [q.one_of("unit", list(UNITS))])[0]


@query("failure_counts", """
    SELECT rule, COUNT(*) AS rows FROM (
        SELECT unnest(['amount_negative', 'amount_too_large', 'title_missing']) AS rule,
               unnest([amount < 0, amount > 999999999, title IS NULL]) AS broken FROM expense_input) x
    WHERE broken GROUP BY rule""")
def _(t):
    return q.failure_counts(
        t.expense_input, [q.not_negative("amount"), q.at_most("amount", q.MAX_AMOUNT), q.required("title")])


@query("duplicate_keys", "SELECT id, COUNT(*) AS rows FROM inventory_movement GROUP BY id HAVING COUNT(*) > 1")
def _(t):
    return q.duplicate_keys(t.inventory_movement, "id")


@query("duplicate_keys_pair", """
    SELECT product_id, created_at, COUNT(*) AS rows FROM inventory_movement GROUP BY 1, 2 HAVING COUNT(*) > 1""")
def _(t):
    return q.duplicate_keys(t.inventory_movement, ["product_id", "created_at"])


@query("quality_digits", """
    SELECT * FROM sales_large WHERE revenue IS NULL OR abs(revenue) < 10000000000000""", "revenue")
def _(t):
    """Fifteen digits are allowed, thirteen of them before the point, although the type holds more."""
    return q.quality(t.sales_large, [r for r in q.rules_for("monthly_sales", t.sales_large.schema) if r.name == "revenue_digits"])[0]


@query("duplicate_keys_declared", """
    SELECT 'product_code' AS key, left(product_code, 7) AS value, COUNT(*) AS rows FROM product GROUP BY 2 HAVING COUNT(*) > 1""")
def _(t):
    return q.duplicate_keys_of(t.product.withColumn("product_code", F.substring("product_code", 1, 7)), "product")


@query("between_dates_timestamp", """
    SELECT * FROM inventory_movement_timed WHERE CAST(created_at AS DATE) BETWEEN DATE '1999-11-15' AND DATE '2000-02-15'""")
def _(t):
    return f.between_dates(t.inventory_movement_timed, "created_at", "1999-11-15", "2000-02-15")
