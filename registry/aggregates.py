"""Summaries, groupings and charts."""

from bizmetrics.operators import expenses as e, inventory as i, product_sales as p, sales as s
from bizmetrics.schemas import NO_CATEGORY
from registry.core import AS_OF, query

TRAILING = "date >= DATE '2001-07-15' - 365"


@query("sales_summary", """
    SELECT COALESCE(SUM(revenue), 0) AS total_revenue,
           CAST(COALESCE(SUM(transaction_count), 0) AS BIGINT) AS total_transactions,
           COALESCE(CAST(SUM(revenue) AS DOUBLE) / COUNT(revenue), 0) AS avg_revenue
    FROM monthly_sales""", "total_revenue")
def _(t):
    return s.sales_summary(t.monthly_sales)


@query("sales_summary_filtered", """
    SELECT COALESCE(SUM(revenue), 0) AS total_revenue,
           CAST(COALESCE(SUM(transaction_count), 0) AS BIGINT) AS total_transactions,
           COALESCE(CAST(SUM(revenue) AS DOUBLE) / COUNT(revenue), 0) AS avg_revenue
    FROM monthly_sales WHERE year(month) = 1999 AND contains(CAST(revenue AS VARCHAR), '7')""", "total_revenue")
def _(t):
    return s.sales_summary(t.monthly_sales, 1999, "7")


@query("transaction_summary", """
    SELECT SUM(amount) AS total_amount, COUNT(*) FILTER (status = 'completed') AS completed_count
    FROM sales_transaction""", "total_amount")
def _(t):
    return s.transaction_summary(t.sales_transaction)


@query("expense_summary", """
    SELECT SUM(amount) AS total_expenses, CAST(SUM(amount) AS DOUBLE) / COUNT(amount) AS avg_expense,
           COUNT(*) AS expense_count FROM expense""", "total_expenses")
def _(t):
    return e.expense_summary(t.expense)


@query("expense_summary_filtered", """
    SELECT COALESCE(SUM(amount), 0) AS total_expenses,
           COALESCE(CAST(SUM(amount) AS DOUBLE) / COUNT(amount), 0) AS avg_expense, COUNT(*) AS expense_count
    FROM expense WHERE category_id = 7 AND date BETWEEN DATE '1998-01-01' AND DATE '2000-12-31'
      AND (contains(lower(title), 'po-1') OR COALESCE(contains(lower(description), 'po-1'), false))""", "total_expenses")
def _(t):
    return e.expense_summary(t.expense, category_id=7, from_date="1998-01-01", to_date="2000-12-31", term="po-1")


@query("product_summary", """
    SELECT COUNT(*) AS total_products, SUM(quantity * unit_price) AS total_value,
           COUNT(*) FILTER (quantity <= reorder_level) AS low_stock_count FROM product""", "total_value")
def _(t):
    return i.product_summary(t.product)


@query("product_summary_filtered", """
    SELECT COUNT(*) AS total_products, COALESCE(SUM(quantity * unit_price), 0) AS total_value,
           COUNT(*) FILTER (quantity <= reorder_level) AS low_stock_count
    FROM product WHERE category = 'PROMO' AND quantity <= reorder_level AND (contains(lower(name), 'ring')
      OR contains(lower(product_code), 'ring') OR COALESCE(contains(lower(barcode), 'ring'), false))""", "total_value")
def _(t):
    return i.product_summary(t.product, category="PROMO", low_only=True, term="Ring")


@query("sales_api_summary", """
    SELECT CAST(SUM(revenue) AS DOUBLE) AS total_revenue, CAST(SUM(revenue) AS DOUBLE) / COUNT(*) AS avg_revenue,
           COUNT(*) AS count FROM monthly_sales""")
def _(t):
    return s.sales_api_summary(t.monthly_sales)


@query("expense_api_summary", """
    SELECT CAST(SUM(amount) AS DOUBLE) AS total_amount, CAST(SUM(amount) AS DOUBLE) / COUNT(*) AS avg_amount,
           COUNT(*) AS count FROM expense""")
def _(t):
    return e.expense_api_summary(t.expense)


@query("month_pair", """
    SELECT COALESCE(SUM(revenue) FILTER (month = DATE '2001-07-01'), 0) AS current_revenue,
           CAST(COALESCE(SUM(transaction_count) FILTER (month = DATE '2001-07-01'), 0) AS BIGINT) AS current_transactions,
           COALESCE(NULLIF(SUM(revenue) FILTER (month = DATE '2001-06-01'), 0), 1) AS last_revenue,
           CAST(COALESCE(SUM(transaction_count) FILTER (month = DATE '2001-06-01'), 0) AS BIGINT) AS last_transactions
    FROM monthly_sales""", "current_revenue last_revenue")
def _(t):
    return s.month_pair(s.two_months(t.sales_transaction, AS_OF), AS_OF)


@query("month_pair_no_previous", """
    SELECT COALESCE(SUM(revenue) FILTER (month = DATE '1995-01-01'), 0) AS current_revenue,
           CAST(COALESCE(SUM(transaction_count) FILTER (month = DATE '1995-01-01'), 0) AS BIGINT) AS current_transactions,
           COALESCE(NULLIF(SUM(revenue) FILTER (month = DATE '1994-12-01'), 0), 1) AS last_revenue,
           CAST(COALESCE(SUM(transaction_count) FILTER (month = DATE '1994-12-01'), 0) AS BIGINT) AS last_transactions
    FROM monthly_sales""", "current_revenue last_revenue")
def _(t):
    return s.month_pair(s.two_months(t.sales_transaction, "1995-01-20"), "1995-01-20")


@query("sales_totals", """
    SELECT SUM(revenue) AS total_revenue, CAST(SUM(transaction_count) AS BIGINT) AS total_transactions
    FROM monthly_sales""", "total_revenue")
def _(t):
    return s.sales_totals(t.monthly_sales)


@query("expense_periods", """
    SELECT COALESCE(SUM(amount) FILTER (year(date) = 2001 AND month(date) = 7), 0) AS current_expenses,
           COALESCE(SUM(amount) FILTER (year(date) = 2001 AND month(date) = 6), 0) AS last_expenses,
           COALESCE(SUM(amount), 0) AS total_expenses FROM expense""",
       "current_expenses last_expenses total_expenses")
def _(t):
    return e.expense_periods(t.expense, AS_OF)


@query("expense_month_pair", """
    SELECT COALESCE(SUM(amount) FILTER (year(date) = 2001 AND month(date) = 7), 0) AS current_expenses,
           COALESCE(SUM(amount) FILTER (year(date) = 2001 AND month(date) = 6), 0) AS last_expenses FROM expense""",
       "current_expenses last_expenses")
def _(t):
    return e.expense_month_pair(t.expense, AS_OF)


STATS = """SUM(revenue) AS total_revenue, CAST(SUM(revenue) AS DOUBLE) / COUNT(revenue) AS avg_revenue,
           MAX(revenue) AS max_revenue, MIN(revenue) AS min_revenue, COUNT(*) AS data_count"""


@query("revenue_stats", f"SELECT {STATS} FROM monthly_sales", "total_revenue max_revenue min_revenue")
def _(t):
    return s.revenue_stats(t.monthly_sales)


@query("revenue_stats_by_country", f"SELECT country, {STATS} FROM panel GROUP BY country",
       "total_revenue max_revenue min_revenue")
def _(t):
    return s.revenue_stats(t.panel, ["country"])


def _top_sql(where, limit="LIMIT 5"):
    return f"""SELECT c.name AS category_name, SUM(amount) AS total
               FROM expense e LEFT JOIN expense_category c ON e.category_id = c.id WHERE {where}
               GROUP BY 1 ORDER BY total DESC, category_name {limit}"""


IN_MONTH = "year(date) = 2001 AND month(date) = 7"


@query("top_categories_month", _top_sql(IN_MONTH), "total")
def _(t):
    return e.top_categories_month(t.expense, t.expense_category, AS_OF)


@query("top_categories_year", _top_sql("year(date) = 2001"), "total")
def _(t):
    return e.top_categories_year(t.expense, t.expense_category, AS_OF)


@query("category_chart", f"""
    SELECT COALESCE(category_name, '{NO_CATEGORY}') AS category, CAST(total AS DOUBLE) AS amount
    FROM ({_top_sql(TRAILING, '')}) x""")
def _(t):
    return e.category_chart(t.expense, t.expense_category, AS_OF)


@query("category_share", f"""
    SELECT category_name, total, round_even(CAST(total AS DOUBLE) / SUM(CAST(total AS DOUBLE)) OVER () * 100, 1) AS share
    FROM ({_top_sql(IN_MONTH)}) x""", "total")
def _(t):
    return e.category_share(t.expense, t.expense_category, AS_OF)


@query("expense_daily_chart", f"""
    SELECT date, strftime(date, '%Y-%m') AS month, CAST(SUM(amount) AS DOUBLE) AS amount
    FROM expense WHERE {TRAILING} GROUP BY date""")
def _(t):
    return e.expense_daily_chart(t.expense, AS_OF)


@query("sales_chart", """
    SELECT strftime(month, '%Y-%m') AS month, CAST(revenue AS DOUBLE) AS revenue
    FROM monthly_sales WHERE month >= DATE '2001-07-15' - 365""")
def _(t):
    return s.sales_chart(s.trailing_months(t.sales_transaction, AS_OF), AS_OF)


@query("avg_monthly_expense", """
    SELECT round_even(CAST(COALESCE(SUM(amount), 0) AS DOUBLE)
             / COALESCE(NULLIF(COUNT(DISTINCT date_trunc('month', date)), 0), 1), 2) AS avg_monthly_expenses
    FROM expense""")
def _(t):
    return e.avg_monthly_expense(t.expense)


@query("sales_years", "SELECT DISTINCT CAST(year(month) AS INTEGER) AS year FROM monthly_sales")
def _(t):
    return s.sales_years(t.monthly_sales)


@query("product_categories", "SELECT DISTINCT category FROM product WHERE category <> ''")
def _(t):
    return i.product_categories(t.product)


@query("inventory_value", "SELECT SUM(quantity * unit_price) AS total_value FROM product WHERE is_active", "total_value")
def _(t):
    return i.inventory_value(t.product)


@query("inventory_value_all", "SELECT SUM(quantity * unit_price) AS total_value FROM product", "total_value")
def _(t):
    return i.inventory_value(t.product, active_only=False)


@query("stock_counts", """
    SELECT COUNT(*) AS active_products, COUNT(*) FILTER (quantity <= reorder_level) AS low_stock,
           COUNT(*) FILTER (quantity = 0) AS out_of_stock FROM product WHERE is_active""")
def _(t):
    return i.stock_counts(t.product)


@query("movements_on_day", """
    SELECT COUNT(*) AS movements FROM inventory_movement WHERE CAST(created_at AS DATE) = DATE '2001-07-15'""")
def _(t):
    return i.movements_on_day(t.inventory_movement, AS_OF)


@query("top_out_products", """
    SELECT p.name AS product_name, product_code, CAST(SUM(m.quantity) AS BIGINT) AS total_out
    FROM inventory_movement m JOIN product p ON m.product_id = p.id WHERE movement_type = 'out'
    GROUP BY 1, 2 ORDER BY total_out DESC, product_code LIMIT 5""")
def _(t):
    return i.top_out_products(t.inventory_movement, t.product)


@query("product_sales_kpi", """
    SELECT CAST(trunc(SUM(sales)) AS BIGINT) AS total_sales, CAST(trunc(SUM(profit)) AS BIGINT) AS total_profit,
           CAST(trunc(SUM(units_sold)) AS BIGINT) AS total_orders FROM product_sales""")
def _(t):
    return p.product_sales_kpi(t.product_sales)


def _resample_sql(key=""):
    k, kc = (f"{key}", f"{key}, ") if key else ("", "")
    on = f"s.{key} = m.{key} AND " if key else ""
    group = f"GROUP BY {k}" if k else ""
    out = f"s.{key}, " if key else ""
    return f"""
    SELECT {out}s.month, COALESCE(m.sales, 0) AS sales
    FROM (SELECT {kc}CAST(unnest(generate_series(MIN(date_trunc('month', sale_date)),
                 MAX(date_trunc('month', sale_date)), INTERVAL 1 MONTH)) AS DATE) AS month
          FROM product_sales {group}) s
    LEFT JOIN (SELECT {kc}CAST(date_trunc('month', sale_date) AS DATE) AS month, SUM(sales) AS sales
               FROM product_sales GROUP BY ALL) m ON {on}s.month = m.month"""


@query("monthly_resample", _resample_sql(), "sales")
def _(t):
    return p.monthly_resample(t.product_sales)


@query("monthly_resample_by_product", _resample_sql("product"), "sales")
def _(t):
    return p.monthly_resample(t.product_sales, ["product"])


@query("monthly_resample_gaps", """
    SELECT s.product_id, s.month, CAST(COALESCE(m.quantity, 0) AS BIGINT) AS quantity
    FROM (SELECT product_id, CAST(unnest(generate_series(MIN(date_trunc('month', created_at)),
                 MAX(date_trunc('month', created_at)), INTERVAL 1 MONTH)) AS DATE) AS month
          FROM inventory_movement GROUP BY product_id) s
    LEFT JOIN (SELECT product_id, CAST(date_trunc('month', created_at) AS DATE) AS month, SUM(quantity) AS quantity
               FROM inventory_movement GROUP BY 1, 2) m ON s.product_id = m.product_id AND s.month = m.month""")
def _(t):
    return p.monthly_resample(t.inventory_movement, ["product_id"], "created_at", ("quantity",))


@query("sales_by_product", "SELECT product, SUM(sales) AS sales FROM product_sales GROUP BY product", "sales")
def _(t):
    return p.sales_by_product(t.product_sales)


@query("sales_by_country", "SELECT country, SUM(sales) AS sales FROM product_sales GROUP BY country", "sales")
def _(t):
    return p.sales_by_country(t.product_sales)


@query("rollup_monthly", """
    SELECT CAST(date_trunc('month', transaction_date) AS DATE) AS month, SUM(amount) AS revenue,
           COUNT(*) AS transaction_count FROM sales_transaction GROUP BY 1""", "revenue")
def _(t):
    return s.rollup_monthly(t.sales_transaction)


@query("rollup_monthly_by_method", """
    SELECT payment_method, CAST(date_trunc('month', transaction_date) AS DATE) AS month, SUM(amount) AS revenue,
           COUNT(*) AS transaction_count FROM sales_transaction GROUP BY 1, 2""", "revenue")
def _(t):
    return s.rollup_monthly(t.sales_transaction, ["payment_method"])
