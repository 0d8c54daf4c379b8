import datetime as dt

import pytest
from pyspark.sql import functions as F

from bizmetrics.operators import timeseries as ts
from bizmetrics.operators.product_sales import monthly_resample
from conftest import plan_of, rows


def months(spark, *values, start=(2000, 1)):
    year, month = start
    data = [(dt.date(year + (month - 1 + n) // 12, (month - 1 + n) % 12 + 1, 1), float(v)) for n, v in enumerate(values)]
    return spark.createDataFrame(data, "month date, revenue double")


def growth(spark, *values):
    return ts.growth_rate(months(spark, *values)).first()


def test_growth_switches_at_twelve_rows(spark):
    assert growth(spark, *range(100, 111)).growth_rate == pytest.approx(10.0)  # 11 rows: first against last
    # 12 rows: the first twelve are the last twelve.
    assert growth(spark, *range(100, 112)).growth_rate == 0.0
    values = list(range(1, 15))
    first, last = sum(values[:12]) / 12, sum(values[-12:]) / 12
    assert growth(spark, *values).growth_rate == pytest.approx((last - first) / first * 100)


def test_growth_without_a_base(spark):
    assert growth(spark, 5).growth_rate == 0.0
    assert growth(spark, 0, 7).growth_rate == 0.0
    assert growth(spark, -1, 7).growth_rate == 0.0


def test_lags_and_means(spark):
    df = months(spark, 1, 2, 3, 4, 5)
    assert [r[2:] for r in rows(ts.lag_features(df))][3] == (3.0, 2.0, 1.0)
    assert [r[2] for r in rows(ts.rolling_mean(df))] == [None, None, 2.0, 3.0, 4.0]
    assert [r[2] for r in rows(ts.rolling_mean(df, shift=1))] == [None, None, None, 2.0, 3.0]
    assert [r[1] for r in rows(ts.forecast_features(df))] == [4.0, 5.0]


def test_series_do_not_mix(spark):
    df = months(spark, 1, 2, 3, 4).withColumn("k", F.lit("a")).unionByName(
        months(spark, 10, 20, 30, 40).withColumn("k", F.lit("b")))
    got = {r.k: (r.month_lag_1, r.month_lag_3, r.rolling_mean_3) for r in ts.forecast_features(df, ["k"]).collect()}
    assert got == {"a": (3.0, 1.0, 2.0), "b": (30.0, 10.0, 20.0)}


def test_gaps_are_filled(spark):
    df = spark.createDataFrame(
        [("a", dt.date(2000, 11, 5), 2), ("a", dt.date(2001, 2, 9), 3), ("a", dt.date(2001, 2, 1), 4), ("b", dt.date(2001, 1, 1), 1)],
        "k string, sale_date date, sales int")
    assert sorted(rows(monthly_resample(df, ["k"]))) == [
        ("a", dt.date(2000, 11, 1), 2), ("a", dt.date(2000, 12, 1), 0), ("a", dt.date(2001, 1, 1), 0),
        ("a", dt.date(2001, 2, 1), 7), ("b", dt.date(2001, 1, 1), 1)]
    assert rows(monthly_resample(df.limit(0))) == []


def test_change_over_a_gap_month(spark):
    df = months(spark, 10, 20).unionByName(months(spark, 5, start=(2000, 4)))
    assert [(r[1], r[2]) for r in rows(ts.mom_change(df).orderBy("month"))] == [
        (10.0, 900.0), (20.0, 100.0), (0.0, -100.0), (5.0, 400.0)]


@pytest.mark.parametrize("n, test", [(1, 1), (4, 1), (5, 1), (6, 2), (10, 2), (15, 3), (77, 16)])
def test_split(spark, n, test):
    parts = [r.part for r in ts.chrono_split(months(spark, *range(n))).orderBy("month").collect()]
    assert parts == ["train"] * (n - test) + ["test"] * test


def test_trend(spark):
    line = ts.trend_line(months(spark, 3, 5, 7, 9)).first()
    assert (line.slope, line.intercept) == pytest.approx((2.0, 3.0))


def test_last_rows(spark):
    df = months(spark, 1, 2, 3, 4)
    assert sorted(r[1] for r in rows(ts.last_n(df))) == [2.0, 3.0, 4.0]
    assert sorted(r[1] for r in rows(ts.last_n(df.withColumn("k", F.lit(1)), ["k"], 2))) == [3.0, 4.0]


def test_chained_windows_shuffle_once(spark):
    df = months(spark, *range(30)).withColumn("k", F.col("revenue") % 3)
    plan = plan_of(ts.trend_line(ts.chrono_split(ts.forecast_features(df, ["k"]), ["k"]), ["k"]))
    assert plan.split("== Initial Plan ==")[0].count("Exchange hashpartitioning") == 1
