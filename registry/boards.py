"""Boards and reports."""

from bizmetrics.operators.sales import two_months
from bizmetrics.plans import boards as b
from registry.core import AS_OF, query

MONTH = "month = DATE '2001-07-01'"
LAST = "month = DATE '2001-06-01'"
DAY = "date >= DATE '2001-07-01' AND date < DATE '2001-08-01'"
LAST_DAY = "date >= DATE '2001-06-01' AND date < DATE '2001-07-01'"

HOME_SQL = f"""
    SELECT r AS current_revenue, e AS current_expenses, r - e AS current_profit, n AS total_transactions,
           low AS low_stock_products, act AS total_products, 'July 2001' AS current_month
    FROM (SELECT COALESCE((SELECT SUM(revenue) FROM monthly_sales WHERE {MONTH}), 0) AS r,
                 CAST(COALESCE((SELECT SUM(transaction_count) FROM monthly_sales WHERE {MONTH}), 0) AS BIGINT) AS n,
                 COALESCE((SELECT SUM(amount) FROM expense WHERE {DAY}), 0) AS e,
                 (SELECT COUNT(*) FROM product WHERE quantity <= reorder_level) AS low,
                 (SELECT COUNT(*) FROM product WHERE is_active) AS act) x"""

KPI_SQL = f"""
    SELECT r AS current_revenue, round_even((CAST(r AS DOUBLE) - lr) / lr * 100, 2) AS revenue_change,
           e AS current_expenses, round_even((CAST(e AS DOUBLE) - le) / le * 100, 2) AS expense_change,
           r - e AS current_profit,
           round_even((CAST(r - e AS DOUBLE) - CAST(lr - le AS DOUBLE))
             / CASE WHEN lr - le = 0 THEN 1 ELSE CAST(lr - le AS DOUBLE) END * 100, 2) AS profit_change,
           n AS total_transactions, v AS total_inventory_value, low AS low_stock_count,
           'July 2001' AS current_month, 'June 2001' AS last_month
    FROM (SELECT COALESCE((SELECT SUM(revenue) FROM monthly_sales WHERE {MONTH}), 0) AS r,
                 COALESCE(NULLIF((SELECT SUM(revenue) FROM monthly_sales WHERE {LAST}), 0), 1) AS lr,
                 CAST(COALESCE((SELECT SUM(transaction_count) FROM monthly_sales WHERE {MONTH}), 0) AS BIGINT) AS n,
                 COALESCE((SELECT SUM(amount) FROM expense WHERE {DAY}), 0) AS e,
                 COALESCE(NULLIF((SELECT SUM(amount) FROM expense WHERE {LAST_DAY}), 0), 1) AS le,
                 COALESCE((SELECT SUM(quantity * unit_price) FROM product), 0) AS v,
                 (SELECT COUNT(*) FROM product WHERE quantity <= 10) AS low) x"""

SALES_BOARD_SQL = f"""
    SELECT r AS current_month_revenue, n AS current_month_transactions, lr AS last_month_revenue,
           round_even((CAST(r AS DOUBLE) - lr) / lr * 100, 2) AS growth_percent,
           total AS total_revenue, tn AS total_transactions, best.month AS best_month,
           best.revenue AS best_month_revenue, 'July 2001' AS current_month, 'June 2001' AS last_month_name
    FROM (SELECT COALESCE(SUM(revenue) FILTER ({MONTH}), 0) AS r,
                 CAST(COALESCE(SUM(transaction_count) FILTER ({MONTH}), 0) AS BIGINT) AS n,
                 COALESCE(NULLIF(SUM(revenue) FILTER ({LAST}), 0), 1) AS lr,
                 SUM(revenue) AS total, CAST(SUM(transaction_count) AS BIGINT) AS tn FROM monthly_sales) x,
         (SELECT month, revenue FROM monthly_sales ORDER BY revenue DESC, month DESC LIMIT 1) best"""

EXPENSE_BOARD_SQL = f"""
    SELECT e AS current_month_expenses, le AS last_month_expenses,
           round_even((CAST(e AS DOUBLE) - le) / CASE WHEN le = 0 THEN 1 ELSE le END * 100, 2) AS growth_percent,
           total AS total_expenses,
           round_even(CAST(total AS DOUBLE) / CASE WHEN months = 0 THEN 1 ELSE months END, 2) AS avg_monthly_expenses,
           'July 2001' AS current_month, 'June 2001' AS last_month_name
    FROM (SELECT COALESCE(SUM(amount) FILTER ({DAY}), 0) AS e, COALESCE(SUM(amount) FILTER ({LAST_DAY}), 0) AS le,
                 COALESCE(SUM(amount), 0) AS total, COUNT(DISTINCT date_trunc('month', date)) AS months
          FROM expense) x"""


def _sales(t):
    return two_months(t.sales_transaction, AS_OF)


@query("kpi_board", KPI_SQL, "current_revenue current_expenses current_profit total_inventory_value")
def _(t):
    return b.kpi_board(_sales(t), t.expense, t.product, AS_OF)


@query("home_summary", HOME_SQL, "current_revenue current_expenses current_profit")
def _(t):
    return b.home_summary(_sales(t), t.expense, t.product, AS_OF)


@query("sales_board", SALES_BOARD_SQL,
       "current_month_revenue last_month_revenue total_revenue best_month_revenue")
def _(t):
    return b.sales_board(t.monthly_sales, AS_OF)


@query("expense_board", EXPENSE_BOARD_SQL,
       "current_month_expenses last_month_expenses total_expenses")
def _(t):
    return b.expense_board(t.expense, AS_OF)


@query("inventory_board", """
    SELECT COUNT(*) AS total_products, SUM(quantity * unit_price) AS total_value,
           COUNT(*) FILTER (quantity <= reorder_level) AS low_stock_products,
           COUNT(*) FILTER (quantity = 0) AS out_of_stock,
           (SELECT COUNT(*) FROM inventory_movement WHERE CAST(created_at AS DATE) = DATE '2001-07-15') AS today_movements
    FROM product WHERE is_active""", "total_value")
def _(t):
    return b.inventory_board(t.product, t.inventory_movement, AS_OF)


@query("low_stock_report", """
    SELECT product_code, name, category, quantity, reorder_level, unit_price
    FROM product WHERE is_active AND quantity <= reorder_level""", "unit_price")
def _(t):
    return b.low_stock_report(t.product)


@query("inventory_value_report", """
    SELECT product_code, name, quantity, unit_price, quantity * unit_price AS total_value
    FROM product WHERE is_active""", "unit_price total_value")
def _(t):
    return b.inventory_value_report(t.product)


@query("summary_bars", f"""
    WITH home AS ({HOME_SQL})
    SELECT 'revenue' AS label, current_revenue AS value FROM home
    UNION ALL SELECT 'expenses', current_expenses FROM home
    UNION ALL SELECT 'profit', current_profit FROM home""", "value")
def _(t):
    return b.summary_bars(b.home_summary(_sales(t), t.expense, t.product, AS_OF))


@query("change_bars", f"""
    WITH board AS ({KPI_SQL})
    SELECT label, change, CASE WHEN change >= 0 THEN 'up' ELSE 'down' END AS direction
    FROM (SELECT 'revenue' AS label, revenue_change AS change FROM board
          UNION ALL SELECT 'expenses', expense_change FROM board
          UNION ALL SELECT 'profit', profit_change FROM board) x""")
def _(t):
    return b.change_bars(b.kpi_board(_sales(t), t.expense, t.product, AS_OF))
