from decimal import Decimal

from pyspark.sql import functions as F, types as T

from bizmetrics.operators import quality as q
from conftest import rows


def test_form_rules(spark):
    df = spark.createDataFrame(
        [(1, Decimal("-1"), 3), (2, Decimal("0"), -1), (3, None, None), (4, Decimal("-2"), -2)],
        "id int, revenue decimal(25,2), transaction_count int")
    valid, rejected = q.quality(df, [q.not_negative("revenue"), q.not_negative("transaction_count")])
    assert [r.id for r in valid.collect()] == [3]
    assert {r.id: r.failures for r in rejected.collect()} == {
        1: ["revenue_negative"], 2: ["transaction_count_negative"],
        4: ["revenue_negative", "transaction_count_negative"]}


def test_column_rules(spark):
    schema = "title string, amount decimal(38,4), status string"
    df = spark.createDataFrame([
        ("ok", Decimal("1.25"), "pending"), (None, Decimal("1"), "pending"), ("x" * 201, Decimal("1"), "pending"),
        ("a", Decimal("1.255"), "pending"), ("b", Decimal("10000000000000"), "pending"),
        ("c", Decimal("999999999.5"), "pending"), ("d", Decimal("1"), "lost"), ("e", None, None)], schema)
    failures = [r.failures for r in q.check(df, q.rules_for("expense", df.schema)).collect()]
    assert failures == [
        [], ["title_missing"], ["title_too_long"], ["amount_digits"], ["amount_digits", "amount_too_large"],
        ["amount_too_large"], ["status_not_allowed"], ["amount_missing", "status_missing"]]


def test_digit_rule_is_dropped_where_the_type_already_guarantees_it():
    assert q.fits_decimal("amount", 15, 2, T.DecimalType(15, 2)) == []
    assert len(q.fits_decimal("amount", 15, 2, T.DecimalType(25, 2))) == 1
    assert len(q.fits_decimal("amount", 15, 2)) == 1


def test_split_is_complete_and_written_once(spark, tmp_path, tables):
    rules = q.rules_for("expense", tables.expense_input.schema)
    valid, rejected = q.quality(tables.expense_input, rules)
    total = tables.expense_input.count()
    assert 0 < valid.count() < total and valid.count() + rejected.count() == total
    q.write_split(tables.expense_input, rules, str(tmp_path / "split"))
    stored = spark.read.parquet(str(tmp_path / "split"))
    assert stored.where("valid = 'true'").count() == valid.count() and stored.count() == total


def test_duplicates(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,), (None,)], "code string")
    assert rows(q.duplicate_keys(df, "code")) == [("a", 2)]
    counted = q.failure_counts(df, [q.required("code"), q.Rule("is_a", F.col("code") == "a")])
    assert sorted(rows(counted)) == [("code_missing", 2), ("is_a", 2)]
