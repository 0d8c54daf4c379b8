"""Roll-ups that are kept beside a stored ledger and follow its changes.

The ledger is a table of ``snapshots``, in partitions by month. A roll-up is another such table, whose snapshots say which
snapshot of the ledger they were made of. To follow a batch, the folders of the two ledger snapshots are compared: only
months whose folders differ are read and summed again, so deletes and updates need no subtraction, and extremes stay right.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from bizmetrics.functions.dates import AsOf, month_floor, previous_month
from bizmetrics.operators.sales import monthly_of
from bizmetrics.sources import snapshots


@dataclass(frozen=True)
class Rollup:
    """How a ledger is summed up. ``summed`` turns rows of whole months into rows of the same months."""

    ledger_part: str  # the month of a ledger row
    part: str  # the month of a roll-up row
    summed: Callable[[DataFrame], DataFrame]


def _days_of(expenses: DataFrame) -> DataFrame:
    sums = expenses.groupBy("date", "category_id").agg(F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("expenses"))
    return sums.select("date", "category_id", F.col("amount").cast("decimal(25,2)").alias("amount"), "expenses")


#: ``monthly_sales`` of ``sales_transaction``.
SALES_MONTHS = Rollup("trunc(transaction_date, 'month')", "month", monthly_of)
#: Sums per day and category, which stand in for ``expense`` wherever amounts are summed over days, months or categories.
EXPENSE_DAYS = Rollup("trunc(date, 'month')", "trunc(date, 'month')", _days_of)


def _folders(spark: SparkSession, folder: str, version: int) -> dict[str | None, frozenset[str]]:
    """The folders of each partition of a snapshot."""
    found: dict[str | None, set[str]] = {}
    for r in snapshots.manifest(spark, folder, version).collect():  # one row per month and batch that added to it
        if r.path:
            found.setdefault(r.value, set()).add(r.path)
    return {value: frozenset(paths) for value, paths in found.items()}


def _behind(spark: SparkSession, ledger: str, version: int, folder: str) -> set[str | None] | None:
    """The months in which a roll-up is behind a snapshot of the ledger; None where all of it has to be made: there is
    no roll-up yet, or the snapshot it was made of has been forgotten."""
    if not snapshots.versions(spark, folder):
        return None
    made_of = snapshots.manifest(spark, folder).first().note
    known = {snapshots.name_of(spark, ledger, v): v for v in snapshots.versions(spark, ledger)}
    if made_of not in known:
        return None
    before, now = _folders(spark, ledger, known[made_of]), _folders(spark, ledger, version)
    return {value for value in before.keys() | now.keys() if before.get(value) != now.get(value)}


def behind(spark: SparkSession, ledger: str, folder: str) -> set[str | None] | None:
    """The months (as text; None for rows without a time) that the next ``refresh`` will sum again; None means all."""
    return _behind(spark, ledger, snapshots.versions(spark, ledger)[-1], folder)


def refresh(spark: SparkSession, ledger: str, folder: str, rollup: Rollup) -> set[str | None] | None:
    """Bring the roll-up in ``folder`` to the newest snapshot of the ledger, and say which months were summed again (None:
    all). A refresh that dies leaves the roll-up as it was; of two at a time one fails."""
    listed = snapshots.manifest(spark, ledger).first()
    if listed.part != rollup.ledger_part:
        raise ValueError(f"{ledger} lies in partitions by {listed.part}, not by {rollup.ledger_part}")
    version = snapshots.versions(spark, ledger)[-1]
    name = snapshots.name_of(spark, ledger, version)
    changed = _behind(spark, ledger, version, folder)
    if changed is None:
        rows = rollup.summed(snapshots.read(spark, ledger, version))
        if snapshots.versions(spark, folder):
            everything = {r.value for r in snapshots.manifest(spark, folder).collect()}
            snapshots.replace(rows, folder, everything, name)
        else:
            snapshots.create(rows, folder, rollup.part, name)
    elif changed or snapshots.manifest(spark, folder).first().note != name:
        snapshots.replace(rollup.summed(snapshots.read(spark, ledger, version, list(changed))), folder, changed, name)
    return changed


def current(spark: SparkSession, ledger: str, folder: str, rollup: Rollup, months: list[str | None] | None = None) -> DataFrame:
    """The roll-up as of the newest snapshot of the ledger, refreshed or not: stored rows of the months that stand, and
    the others summed from the ledger now. With ``months`` only those are read, on either side."""
    version = snapshots.versions(spark, ledger)[-1]
    changed = _behind(spark, ledger, version, folder)
    if changed is None:
        return rollup.summed(snapshots.read(spark, ledger, version, months))
    held = set(_folders(spark, folder, snapshots.versions(spark, folder)[-1]))
    stand = [v for v in held - changed if months is None or v in months]
    stored = snapshots.read(spark, folder, values=stand)
    anew = [v for v in changed if months is None or v in months]
    return stored.unionByName(rollup.summed(snapshots.read(spark, ledger, version, anew))) if anew else stored


def month_and_last(as_of: AsOf) -> list[str | None]:
    """The two months that a board compares, as partitions are called."""
    return [month_floor(as_of).isoformat(), previous_month(as_of).isoformat()]
