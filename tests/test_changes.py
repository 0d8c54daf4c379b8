import datetime as dt

from bizmetrics.operators import changes as c
from conftest import plan_of, rows

STAMP = dt.datetime(2001, 7, 15, 12)
OLD = dt.datetime(2000, 1, 1)


def base_of(spark):
    return spark.createDataFrame([(n, f"n{n}", OLD, OLD) for n in range(1, 6)],
                                 "id bigint, name string, created_at timestamp_ntz, updated_at timestamp_ntz")


def batch_of(spark, *changes):
    return spark.createDataFrame(list(changes), "id bigint, name string, op string, seq int")


def test_latest_change_wins(spark):
    batch = batch_of(
        spark, (1, "first", "update", 1), (1, "last", "update", 3), (1, "middle", "update", 2),
        (2, None, "delete", 1), (3, "gone", "update", 1), (3, None, "delete", 2), (4, None, "delete", 1),
        (4, "back", "insert", 2), (8, "new", "insert", 1), (8, "newer", "update", 2), (9, "lost", "update", 1),
        (10, "brief", "insert", 1), (10, None, "delete", 2), (11, None, "delete", 1), (12, "up", "upsert", 1))
    got = sorted(rows(c.apply_changes(base_of(spark), batch, "id", STAMP)))
    assert got == [
        (1, "last", OLD, STAMP), (4, "back", STAMP, STAMP), (5, "n5", OLD, OLD),
        (8, "newer", STAMP, STAMP), (12, "up", STAMP, STAMP)]


def test_updates_of_rows_that_are_gone(spark):
    batch = batch_of(
        spark, (1, None, "delete", 1), (1, "late", "update", 2), (2, None, "delete", 1), (2, "lost", "update", 2), (2, "back", "insert", 3),
        (2, "again", "update", 4), (8, "new", "insert", 1), (8, None, "delete", 2), (8, "late", "update", 3), (9, "early", "update", 1),
        (9, "new", "insert", 2), (3, "same", "insert", 5), (3, None, "delete", 5), (3, "time", "update", 5))
    got = sorted(rows(c.apply_changes(base_of(spark), batch, "id", STAMP)))
    assert got == [(2, "again", STAMP, STAMP), (3, "time", STAMP, STAMP), (4, "n4", OLD, OLD), (5, "n5", OLD, OLD), (9, "new", STAMP, STAMP)]


def test_any_sequence_is_replayed(spark):
    import random
    rng = random.Random(4)
    changes = [(rng.randrange(1, 30), f"v{n}", rng.choice(["insert", "update", "update", "delete", "upsert"]), n) for n in range(120)]
    table = {n: f"n{n}" for n in range(1, 6)}
    for key, name, op, _ in changes:
        if op == "delete":
            table.pop(key, None)
        elif op != "update" or key in table:
            table[key] = name
    got = c.apply_changes(base_of(spark), batch_of(spark, *changes), "id", STAMP)
    assert {r.id: r.name for r in got.collect()} == table


def test_empty_batch_and_empty_base(spark):
    base = base_of(spark)
    assert sorted(rows(c.apply_changes(base, batch_of(spark), "id", STAMP))) == sorted(rows(base))
    got = c.apply_changes(base.limit(0), batch_of(spark, (1, "a", "insert", 1)), "id", STAMP)
    assert rows(got) == [(1, "a", STAMP, STAMP)]


def test_columns_absent_from_the_batch_are_kept(spark):
    base = base_of(spark).withColumnRenamed("updated_at", "seen_at")
    got = c.apply_changes(base, batch_of(spark, (1, "x", "update", 1), (7, "y", "insert", 1)), "id", STAMP)
    assert sorted(rows(got))[0] == (1, "x", OLD, OLD) and sorted(rows(got))[-1] == (7, "y", STAMP, None)


def test_small_batch_does_not_shuffle_the_table(spark, tables):
    batch = batch_of(spark, (1, "x", "update", 1))
    plan = plan_of(c.apply_changes(tables.product.select("id", "name"), batch, "id", STAMP))
    final = plan.split("== Initial Plan ==")[0]
    assert "SortMergeJoin" not in final and "BroadcastHashJoin" in final


def test_cascade_and_set_null(spark):
    transactions = spark.createDataFrame([(1,), (2,)], "id bigint")
    invoices = spark.createDataFrame([(10, 1), (11, None), (12, 2)], "id bigint, transaction_id bigint")
    items = spark.createDataFrame([(10, "a"), (11, "b"), (12, "c")], "invoice_id bigint, description string")
    gone = spark.createDataFrame([(1,), (1,)], "id bigint")
    left = c.cascade_transactions(transactions, invoices, items, gone)
    assert [sorted(rows(df)) for df in left] == [[(2,)], [(11, None), (12, 2)], [(11, "b"), (12, "c")]]
    assert sorted(rows(c.set_null(invoices, gone, "transaction_id"))) == [(10, None), (11, None), (12, 2)]


def test_restricted_delete(spark):
    categories = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id bigint, name string")
    expenses = spark.createDataFrame([(1,), (None,)], "category_id bigint")
    asked = spark.createDataFrame([(1,), (2,), (9,)], "id bigint")
    assert sorted(rows(c.restricted_delete(categories, expenses, asked))) == [(1, "a", "refused"), (2, "b", "deleted")]
