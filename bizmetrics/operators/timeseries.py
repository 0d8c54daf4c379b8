"""Windows over month series.

Input frames hold one row per period and key. With ``by`` empty there is one series, so
its window runs in one task over as many rows as there are months; a ledger is rolled up
(``rollup_monthly``, ``monthly_resample``) before it comes here. With keys, the windows
of all operators partition by the same columns, so chaining them shuffles once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from bizmetrics.functions.numbers import or_one

LAGS = 3
FEATURES = ("month_lag_1", "month_lag_2", "month_lag_3", "rolling_mean_3")


def _series(by: Sequence[str] | None) -> WindowSpec:
    return Window.partitionBy(*(by or []))


def _in_order(by: Sequence[str] | None, time: str) -> WindowSpec:
    return _series(by).orderBy(time)


def fill_months(monthly: DataFrame, by: Sequence[str] | None, values: Sequence[str],
                time: str = "month") -> DataFrame:
    """Insert the missing months of each series with zeros.

    Each month is stretched up to the one before its successor and the stretch exploded,
    which needs neither a calendar table nor a join.
    """
    following = F.lead(time).over(_in_order(by, time))
    stretch = F.sequence(F.col(time), F.coalesce(F.add_months(following, -1), F.col(time)), F.expr("interval 1 month"))
    kept = [c for c in monthly.columns if c not in {time, *values}]
    return (monthly.withColumn("_stretch", stretch)
            .withColumn("_month", F.explode("_stretch"))
            .select(*kept, F.col("_month").alias(time),
                    *[F.when(F.col("_month") == F.col(time), F.coalesce(F.col(v), F.lit(0))).otherwise(F.lit(0))
                      .cast(monthly.schema[v].dataType).alias(v) for v in values]))


def lag_features(df: DataFrame, by: Sequence[str] | None = None, k: int = LAGS,
                 value: str = "revenue", time: str = "month") -> DataFrame:
    w = _in_order(by, time)
    return df.withColumns({f"month_lag_{i}": F.lag(value, i).over(w) for i in range(1, k + 1)})


def rolling_mean(df: DataFrame, by: Sequence[str] | None = None, n: int = 3, shift: int = 0,
                 value: str = "revenue", time: str = "month") -> DataFrame:
    """Mean of ``n`` rows ending at this one (``shift=0``) or at the one before
    (``shift=1``); NULL until ``n`` values are there."""
    frame = _in_order(by, time).rowsBetween(1 - n - shift, -shift)
    mean = F.sum(value).over(frame).cast("double") / n
    return df.withColumn(f"rolling_mean_{n}", F.when(F.count(value).over(frame) == n, mean))


def forecast_features(df: DataFrame, by: Sequence[str] | None = None, shift: int = 1,
                      value: str = "revenue", time: str = "month") -> DataFrame:
    """Lags 1 to 3 and the rolling mean, complete rows only.

    ``shift=0`` puts the value to be predicted inside its own rolling mean, which leaks
    the target; ``shift=1`` uses past values only and is what training and serving use.
    """
    features = rolling_mean(lag_features(df, by, LAGS, value, time), by, 3, shift, value, time)
    return features.na.drop("any", subset=[value, *FEATURES])


def last_n(df: DataFrame, by: Sequence[str] | None = None, n: int = 3, time: str = "month") -> DataFrame:
    """The last ``n`` rows of each series."""
    if not by:
        return df.orderBy(F.desc(time)).limit(n)
    newest = _series(by).orderBy(F.desc(time))
    return df.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= n).drop("_rank")


def growth_rate(df: DataFrame, by: Sequence[str] | None = None,
                value: str = "revenue", time: str = "month") -> DataFrame:
    """Percent growth per series: mean of the first 12 rows against the last 12 from 12
    rows on, else first against last row; 0 below two rows or from a base not above 0."""
    keys = list(by or [])
    rank, n = F.col("_rank"), F.col("_n")
    ranked = (df.withColumn("_rank", F.row_number().over(_in_order(by, time)))
                .withColumn("_n", F.count(F.lit(1)).over(_series(by))))
    span = F.when(n >= 12, 12).otherwise(1)

    def mean(keep: Column) -> Column:
        return F.sum(F.when(keep, F.col(value))).cast("double") / F.max(span)

    ends = ranked.groupBy(*keys).agg(
        F.max("_n").alias("_n"),
        mean(rank <= span).alias("_first"),
        mean(rank > n - span).alias("_last"))
    grown = (F.col("_last") - F.col("_first")) / F.col("_first") * 100
    return ends.select(
        *keys, F.when((n >= 2) & (F.col("_first") > 0), grown).otherwise(F.lit(0.0)).alias("growth_rate"))


def month_index(df: DataFrame, by: Sequence[str] | None = None, time: str = "month",
                out: str = "idx") -> DataFrame:
    """Position in the series, from 0."""
    return df.withColumn(out, F.row_number().over(_in_order(by, time)) - 1)


def trend_line(df: DataFrame, by: Sequence[str] | None = None,
               value: str = "revenue", time: str = "month") -> DataFrame:
    """Least-squares line over the month index: slope, intercept, and the fitted value of
    every month."""
    x, y = F.col("idx").cast("double"), F.col(value).cast("double")
    whole = _series(by)
    return (month_index(df, by, time)
            .withColumns({"slope": F.regr_slope(y, x).over(whole),
                          "intercept": F.regr_intercept(y, x).over(whole)})
            .withColumn("fitted", F.col("intercept") + F.col("slope") * x))


def chrono_split(df: DataFrame, by: Sequence[str] | None = None, test_frac: float = 0.2,
                 time: str = "month") -> DataFrame:
    """Mark the last ``ceil(test_frac * n)`` rows of each series as ``test``."""
    rank = F.row_number().over(_in_order(by, time))
    n = F.count(F.lit(1)).over(_series(by))
    return df.withColumn(
        "part", F.when(rank > n - F.ceil(F.lit(test_frac) * n), "test").otherwise("train"))


def mom_change(df: DataFrame, by: Sequence[str] | None = None,
               value: str = "revenue", time: str = "month") -> DataFrame:
    """Month-over-month change in percent for every month; an absent month counts as 0,
    and a base of 0 (or none) counts as 1."""
    filled = fill_months(df.select(*(by or []), time, value), by, [value], time)
    before = or_one(F.lag(value).over(_in_order(by, time))).cast("double")
    now = F.col(value).cast("double")
    return filled.withColumn("change", (now - before) / before * 100)
