"""Boards over roll-ups that were kept while a batch of changes came in, compared with the ledgers after the batch."""

from bizmetrics.plans import boards as b
from bizmetrics.session import store_once
from bizmetrics.sources import rollups, snapshots
from registry.boards import EXPENSE_BOARD_SQL, KPI_SQL, SALES_BOARD_SQL
from registry.changes import STAMP, _apply_sql
from registry.core import AS_OF, query

TRANSACTION = ["transaction_id", "transaction_date", "amount", "payment_method", "status"]
EXPENSE = ["title", "category_id", "amount", "date", "description", "status"]

#: The ledgers after the batch, and the months of one of them.
AFTER_SQL = f"""
    sales_after AS ({_apply_sql("sales_transaction", "transaction_changes", TRANSACTION)}),
    expense_after AS ({_apply_sql("expense", "expense_changes", EXPENSE)}),
    months_after AS (SELECT CAST(date_trunc('month', transaction_date) AS DATE) AS month,
                            CAST(SUM(amount) AS DECIMAL(25,2)) AS revenue, CAST(COUNT(*) AS INT) AS transaction_count
                     FROM sales_after GROUP BY 1)"""


def _after(sql):
    """A board's question, asked of the ledgers after the batch."""
    return f"WITH {AFTER_SQL} " + sql.replace("monthly_sales", "months_after").replace("FROM expense", "FROM expense_after")


def _follow(t, base, changes, rollup):
    """A stored ledger and its roll-up, made before the batch; the batch comes in two commits, and the roll-up follows
    the first. Returns both folders: the roll-up is one commit behind. The batch is stored, for it is read several times a
    commit, and made of the ledger's own tables."""
    ledger, folder = t.scratch, t.scratch
    changes = store_once(changes, "batch")
    snapshots.create(base, ledger, rollup.ledger_part)
    rollups.refresh(t.spark, ledger, folder, rollup)
    snapshots.apply(t.spark, ledger, changes.where("seq = 1"), "id", STAMP)
    rollups.refresh(t.spark, ledger, folder, rollup)
    snapshots.apply(t.spark, ledger, changes.where("seq > 1"), "id", STAMP)
    return ledger, folder


def _sales(t, months=None):
    ledger, folder = _follow(t, t.sales_transaction, t.transaction_changes, rollups.SALES_MONTHS)
    return rollups.current(t.spark, ledger, folder, rollups.SALES_MONTHS, months)


def _expenses(t, months=None):
    ledger, folder = _follow(t, t.expense, t.expense_changes, rollups.EXPENSE_DAYS)
    return rollups.current(t.spark, ledger, folder, rollups.EXPENSE_DAYS, months)


@query("kpi_board_kept", _after(KPI_SQL), "current_revenue current_expenses current_profit total_inventory_value")
def _(t):
    """Only the two months that the board compares are read, of the roll-ups or where they are behind."""
    months = rollups.month_and_last(AS_OF)
    return b.kpi_board(_sales(t, months), _expenses(t, months), t.product, AS_OF)


@query("sales_board_kept", _after(SALES_BOARD_SQL),
       "current_month_revenue last_month_revenue total_revenue best_month_revenue")
def _(t):
    return b.sales_board(_sales(t), AS_OF)


@query("expense_board_kept", _after(EXPENSE_BOARD_SQL), "current_month_expenses last_month_expenses total_expenses")
def _(t):
    return b.expense_board(_expenses(t), AS_OF)


@query("rollup_sales_kept", f"WITH {AFTER_SQL} SELECT month, revenue, transaction_count FROM months_after", "revenue")
def _(t):
    """The roll-up itself, refreshed twice."""
    ledger, folder = _follow(t, t.sales_transaction, t.transaction_changes, rollups.SALES_MONTHS)
    rollups.refresh(t.spark, ledger, folder, rollups.SALES_MONTHS)
    return snapshots.read(t.spark, folder)


@query("rollup_expenses_kept", f"""
    WITH {AFTER_SQL} SELECT date, category_id, SUM(amount) AS amount, COUNT(*) AS expenses FROM expense_after GROUP BY 1, 2""", "amount")
def _(t):
    ledger, folder = _follow(t, t.expense, t.expense_changes, rollups.EXPENSE_DAYS)
    rollups.refresh(t.spark, ledger, folder, rollups.EXPENSE_DAYS)
    return snapshots.read(t.spark, folder)
