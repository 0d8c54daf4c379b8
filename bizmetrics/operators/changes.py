"""Batches of changes to tables: table in, new table out."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F


#: Of changes with equal order, deletes come first, then inserts, then updates.
_RANK = {"delete": 0, "insert": 1, "upsert": 1, "update": 2}


def latest_changes(changes: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """Per key, what its changes come to, from one aggregation: the values of its last change that is no
    delete; ``_created``, whether it was inserted after its last delete, if it had one; ``_deleted``, whether it
    had one. Maxima combine on the map side, so a key that is changed very often ships one row per task.

    Changes of a key take effect by ``order``; among equals a delete comes first, then inserts, then updates, and
    of updates the one with the greatest values is last.
    """
    others = [c for c in changes.columns if c not in {key, order, "op"}]
    op = F.col("op")
    rank = F.coalesce(*[F.when(op == name, n) for name, n in _RANK.items()])
    last = F.max(F.when(op != "delete", F.struct(order, rank.alias("rank"), *others)))
    deleted = F.max(F.when(op == "delete", F.col(order)))
    created = F.max(F.when(op.isin("insert", "upsert"), F.col(order)))
    return (changes.groupBy(key).agg(last.alias("_last"), deleted.alias("_deleted"), created.alias("_created"))
            .select(key, *[F.col(f"_last.{c}").alias(c) for c in others], F.col("_deleted").isNotNull().alias("_deleted"),
                    F.coalesce(F.col("_created") >= F.coalesce("_deleted", "_created"), F.lit(False)).alias("_created")))


def apply_changes(base: DataFrame, changes: DataFrame, key: str, stamp: dt.datetime,
                  order: str = "seq") -> DataFrame:
    """Apply inserts, updates and deletes by key, in sequence.

    ``changes`` has the table's columns plus ``op`` (``insert``, ``upsert``, ``update``,
    ``delete``) and ``order`` (see ``latest_changes`` for equal ones). An insert of a key the table has replaces its row; an update or delete of a
    key that isn't there at that point does nothing. A row that was deleted and inserted again is a new one.
    ``created_at`` / ``updated_at`` columns, if the table has them, get ``stamp``.

    The base is only ever the left side of a join against the batch, so a small batch is
    broadcast by Catalyst and the table is not shuffled; a large one sort-merges.
    """
    latest = latest_changes(changes, key, order)
    # As text, so that the wall-clock time is kept whatever the session's time zone.
    stamps = {c: F.lit(stamp.isoformat(sep=" ")).cast(base.schema[c].dataType) for c in ("created_at", "updated_at") if c in base.columns}
    values = [c for c in base.columns if c != key and c in changes.columns and c not in stamps]

    batch = latest.select(key, F.lit(True).alias("_touched"), "_deleted", "_created", *[F.col(c).alias(f"_new_{c}") for c in values])
    touched, anew = F.col("_touched").isNotNull(), F.coalesce(F.col("_deleted") & F.col("_created"), F.lit(False))
    replaced = {c: F.when(touched, F.col(f"_new_{c}")).otherwise(F.col(c)) for c in values}
    replaced |= {c: F.when(~anew, F.col(c)) for c in base.columns if c not in {key, *values, *stamps}}
    if "created_at" in stamps:
        replaced["created_at"] = F.when(anew, stamps["created_at"]).otherwise(F.col("created_at"))
    if "updated_at" in stamps:
        replaced["updated_at"] = F.when(touched, stamps["updated_at"]).otherwise(F.col("updated_at"))
    kept = (base.join(batch, key, "left")
            .where(~touched | ~F.col("_deleted") | F.col("_created"))
            .withColumns(replaced).select(*base.columns))

    present = base.select(key).join(latest.select(key), key, "left_semi")
    fresh = (latest.where("_created")
             .join(present, key, "left_anti")
             .withColumns(stamps).select(*[F.col(c) if c in {key, *values, *stamps} else
                                           F.lit(None).cast(base.schema[c].dataType).alias(c) for c in base.columns]))
    return kept.unionByName(fresh)


def cascade_delete(child: DataFrame, deleted: DataFrame, fk: str, key: str = "id") -> DataFrame:
    """Drop the children of deleted parents; children without a parent stay."""
    gone = deleted.select(F.col(key).alias(fk)).distinct()
    return child.join(gone, fk, "left_anti").select(*child.columns)


def cascade_transactions(transactions: DataFrame, invoices: DataFrame, items: DataFrame,
                         deleted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Delete transactions with their invoices and the invoices' items."""
    gone = deleted.select("id").distinct()
    gone_invoices = invoices.join(gone.withColumnRenamed("id", "transaction_id"), "transaction_id", "left_semi")
    return (transactions.join(gone, "id", "left_anti"),
            cascade_delete(invoices, gone, "transaction_id"),
            cascade_delete(items, gone_invoices, "invoice_id"))


def set_null(child: DataFrame, deleted: DataFrame, fk: str, key: str = "id") -> DataFrame:
    """Clear the reference of children whose parent is deleted."""
    gone = deleted.select(F.col(key).alias(fk)).distinct().withColumn("_gone", F.lit(True))
    return (child.join(gone, fk, "left")
            .withColumn(fk, F.when(F.col("_gone").isNull(), F.col(fk))).select(*child.columns))


def restricted_delete(categories: DataFrame, expenses: DataFrame, asked: DataFrame) -> DataFrame:
    """For each category asked to be deleted: ``refused`` if it has expenses, else
    ``deleted``."""
    used = (expenses.select(F.col("category_id").alias("id")).where(F.col("id").isNotNull())
            .distinct().withColumn("_used", F.lit(True)))
    return (categories.join(asked.select("id").distinct(), "id", "left_semi").join(used, "id", "left")
            .select("id", "name", F.when(F.col("_used"), "refused").otherwise("deleted").alias("outcome")))
