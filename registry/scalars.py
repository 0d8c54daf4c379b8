"""Column functions on the business tables."""

from pyspark.sql import functions as F

from bizmetrics.functions import dates as d, numbers as n, text as x
from registry.core import query


@query("date_labels", """
    SELECT month, strftime(month, '%B %Y') AS month_name, strftime(month, '%Y-%m') AS year_month,
           strftime(month, '%Y-%m-%d') AS day FROM monthly_sales""")
def _(t):
    m = F.col("month")
    return t.monthly_sales.select("month", d.label(m).alias("month_name"), d.label(m, d.YEAR_MONTH).alias("year_month"),
                                  d.label(m, d.ISO_DAY).alias("day"))


@query("minute_label", "SELECT id, strftime(created_at, '%Y-%m-%d %H:%M') AS minute FROM inventory_movement")
def _(t):
    return t.inventory_movement.select("id", d.label(F.col("created_at"), d.ISO_MINUTE).alias("minute"))


@query("date_parts", """
    SELECT id, CAST(year(created_at) AS INTEGER) AS y, CAST(month(created_at) AS INTEGER) AS m,
           CAST(created_at AS DATE) AS day FROM inventory_movement""")
def _(t):
    c = F.col("created_at")
    return t.inventory_movement.select("id", F.year(c).alias("y"), F.month(c).alias("m"), F.to_date(c).alias("day"))


@query("month_bounds", """
    SELECT id, date, CAST(date_trunc('month', date) AS DATE) AS first_day,
           CAST(date_trunc('month', date) - INTERVAL 1 MONTH AS DATE) AS previous_month,
           CAST(date_trunc('month', date) + INTERVAL 1 MONTH AS DATE) AS next_month FROM expense""")
def _(t):
    c = F.col("date")
    return t.expense.select("id", "date", d.month_of(c).alias("first_day"), d.month_before(c).alias("previous_month"),
                            d.month_after(c).alias("next_month"))


@query("percent_change", """
    SELECT id, (CAST(quantity AS DOUBLE) - reorder_level) / CASE WHEN reorder_level = 0 THEN 1 ELSE reorder_level END * 100
             AS against_reorder,
           (CAST(reorder_level AS DOUBLE) - quantity) / CASE WHEN quantity = 0 THEN 1 ELSE quantity END * 100
             AS against_stock FROM product""")
def _(t):
    q, r = F.col("quantity"), F.col("reorder_level")
    return t.product.select("id", n.percent_change(q, r).alias("against_reorder"),
                            n.percent_change(r, q).alias("against_stock"))


@query("null_defaults", """
    SELECT id, COALESCE(quantity, 0) AS or_zero, COALESCE(NULLIF(quantity, 0), 1) AS or_one FROM product_input""")
def _(t):
    q = F.col("quantity")
    return t.product_input.select("id", n.or_zero(q).alias("or_zero"), n.or_one(q).alias("or_one"))


@query("rounding", """
    SELECT id, round_even(CAST(amount AS DOUBLE) / 7, 2) AS two, round_even(CAST(amount AS DOUBLE) / 7, 4) AS four,
           CAST(round(amount, 0) AS DOUBLE) AS whole FROM sales_transaction""")
def _(t):
    seventh = F.col("amount").cast("double") / 7
    return t.sales_transaction.select("id", n.rounded(seventh).alias("two"), n.rounded(seventh, 4).alias("four"),
                                      F.round("amount", 0).alias("whole"))


@query("thousands", "SELECT id, format('{:,}', CAST(round_even(CAST(amount AS DOUBLE), 0) AS BIGINT)) AS shown FROM sales_transaction")
def _(t):
    return t.sales_transaction.select("id", n.thousands(F.col("amount")).alias("shown"))


@query("larger_of_two", "SELECT id, greatest(quantity, reorder_level) AS larger FROM product")
def _(t):
    return t.product.select("id", F.greatest("quantity", "reorder_level").alias("larger"))


@query("number_casts", """
    SELECT id, CAST(amount AS DOUBLE) AS as_double, CAST(trunc(amount) AS BIGINT) AS whole,
           CAST(trunc(-amount) AS BIGINT) AS minus_whole FROM sales_transaction""")
def _(t):
    a = F.col("amount")
    return t.sales_transaction.select("id", a.cast("double").alias("as_double"), n.truncated(a).alias("whole"),
                                      n.truncated(-a).alias("minus_whole"))


@query("coercing_parse", """
    SELECT CAST(try_strptime(trim(date_text), '%Y-%m-%d') AS DATE) AS day, TRY_CAST(sales_text AS DOUBLE) AS sales,
           TRY_CAST(profit_text AS DOUBLE) AS profit FROM raw_product_sales""")
def _(t):
    return t.raw_product_sales.select(
        x.parse_date(F.col("date_text")).alias("day"),
        n.parse_number(F.col("sales_text")).alias("sales"), n.parse_number(F.col("profit_text")).alias("profit"))


@query("lower_substring", "SELECT id, contains(lower(description), 'supplier#00000001') AS found FROM expense")
def _(t):
    return t.expense.select("id", x.contains_ci(F.col("description"), "Supplier#00000001").alias("found"))


@query("name_text", """
    SELECT id, trim(concat('  ', name, ' ')) AS trimmed,
           concat(upper(substr(movement, 1, 1)), substr(movement, 2), ' Type') AS shown,
           concat(product_code, ' - ', name) AS full_name
    FROM (SELECT *, CASE WHEN is_active THEN 'active' ELSE 'closed' END AS movement FROM product) p""")
def _(t):
    code = F.concat(F.when(F.col("is_active"), "active").otherwise("closed"), F.lit("_type"))
    return t.product.select(
        "id", F.trim(F.concat(F.lit("  "), "name", F.lit(" "))).alias("trimmed"),
        x.display_name(code).alias("shown"), F.concat_ws(" - ", "product_code", "name").alias("full_name"))
