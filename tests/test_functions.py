import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from bizmetrics.functions import dates, numbers, text
from conftest import rows


def test_month_arithmetic():
    assert dates.previous_month("2001-01-31") == dt.date(2000, 12, 1)
    assert dates.next_month("2001-12-01") == dt.date(2002, 1, 1)
    assert dates.next_month("2001-01-31") == dt.date(2001, 2, 1)
    assert dates.month_floor(dt.datetime(2001, 7, 15, 9)) == dt.date(2001, 7, 1)


def test_defaults_and_ratios(spark):
    df = spark.createDataFrame([(None, None), (0, 0), (5, 4)], "a int, b int")
    a, b = F.col("a"), F.col("b")
    assert rows(df.select(numbers.or_zero(a), numbers.or_one(a))) == [(0, 1), (0, 1), (5, 5)]
    change = numbers.percent_change(numbers.or_zero(a), numbers.or_zero(b))
    assert rows(df.select(change)) == [(0.0,), (0.0,), (25.0,)]


def test_rounding_is_half_even(spark):
    df = spark.createDataFrame([(Decimal("2.675"),), (Decimal("0.125"),)], "x decimal(6,3)")
    assert rows(df.select(numbers.rounded(F.col("x")))) == [(Decimal("2.68"),), (Decimal("0.12"),)]


def test_thousands_and_truncation(spark):
    df = spark.createDataFrame([(Decimal("1234567.60"),), (Decimal("-1.99"),)], "x decimal(15,2)")
    assert rows(df.select(numbers.thousands(F.col("x")), numbers.truncated(F.col("x")))) == [
        ("1,234,568", 1234567), ("-2", -1)]


def test_parsing_keeps_only_plain_values(spark):
    texts = ["12.5", " -3 ", "1e3", ".5", "12d", "NaN", "Infinity", "", "n/a", None]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    assert [r[0] for r in rows(df.select(numbers.parse_number(F.col("x"))))] == [
        12.5, -3.0, 1000.0, 0.5, None, None, None, None, None, None]
    texts = ["2001-07-15", " 2001-07-15 10:30:00", "7/5/2001", "2001/7/5", "15.07.2001", "2001-02-30", "soon", None,
             "July 15, 2001", "15-Jul-2001", "20010715", "15 july 2001", "Jul 15 2001", "7-5-2001", "31 Feb 2001", "15 Foo 2001", "13/13/2001"]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    day = dt.date(2001, 7, 15)
    assert [r[0] for r in rows(df.select(text.parse_date(F.col("x"))))] == [
        day, day, dt.date(2001, 7, 5), dt.date(2001, 7, 5), None, None, None, None,
        day, day, day, day, day, dt.date(2001, 7, 5), None, None, None]


def test_names(spark):
    df = spark.createDataFrame([("random_forest",)], "x string")
    assert rows(df.select(text.display_name(F.col("x")), text.coded("P1", F.col("x")))) == [
        ("Random Forest", "P1 - random_forest")]
