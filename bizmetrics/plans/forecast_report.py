"""The forecast page: history check, training, best model, next month, key figures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from bizmetrics.functions import dates
from bizmetrics.functions.dates import AsOf
from bizmetrics.operators.combine import one_row
from bizmetrics.operators.filters import enough_history
from bizmetrics.operators.forecast import Training, best_model, forecast_next, regression_metrics, train_all
from bizmetrics.operators.sales import revenue_stats
from bizmetrics.operators.timeseries import forecast_features, growth_rate
from bizmetrics.session import cut_lineage

MIN_MONTHS = 6
MIN_FEATURE_ROWS = 4


def train_on_series(sales: DataFrame, by: list[str] | None = None, shift: int = 1, **models: object) -> Training:
    """Training over all series with enough history, before and after feature building.
    ``shift=0`` gives the scores of features that contain the target (see
    ``forecast_features``). ``models`` are further arguments of ``train_all``."""
    enough = enough_history(sales, by, MIN_MONTHS)
    return train_all(enough_history(forecast_features(enough, by, shift), by, MIN_FEATURE_ROWS), by, **models)


def until(sales: DataFrame, as_of: AsOf, time: str = "month") -> DataFrame:
    """The months up to that of ``as_of``: a ledger may already hold the beginning of later ones."""
    return sales.where(F.col(time) < F.lit(dates.next_month(as_of)))


def forecast_report(sales: DataFrame, as_of: AsOf, by: list[str] | None = None, **models: object) -> DataFrame:
    """One row for the single revenue series, or per series of a panel (one model serves them all). Months after
    that of ``as_of`` are left out; the forecast's month is the one after the series' last. Series with fewer than
    six months are left out."""
    keys = list(by or [])
    months = cut_lineage(enough_history(until(sales, as_of).select(*keys, "month", "revenue"), by, MIN_MONTHS))  # one row per month
    usable = enough_history(forecast_features(months, by), by, MIN_FEATURE_ROWS)
    if usable.isEmpty():
        return _report_frame(_beside(keys, revenue_stats(months, by), growth_rate(months, by)), keys, None).limit(0)
    training = train_all(usable, by, **models)
    best = best_model(regression_metrics(training.predictions)).first()  # one row per model
    following = forecast_next(training.models[best["model"]], months, by).withColumnRenamed("month", "next_month")
    return _report_frame(_beside(keys, revenue_stats(months, by), growth_rate(months, by), following), keys, best)


def _beside(keys: list[str], *frames: DataFrame) -> DataFrame:
    """Frames of one row per key side by side; all are partitioned by the keys already."""
    return reduce(lambda a, b: a.join(b, keys), frames) if keys else one_row(*frames)


def _report_frame(parts: DataFrame, keys: list[str], best) -> DataFrame:
    known = best.asDict() if best else {}
    have = lambda name, kind: F.col(name) if name in parts.columns else F.lit(None).cast(kind)
    return parts.select(
        *keys, F.lit(known.get("model")).cast("string").alias("best_model"),
        *[F.bround(F.lit(known.get(m)).cast("double"), d).alias(m) for m, d in (("mae", 2), ("rmse", 2), ("r2", 4))],
        F.bround(have("forecast", "double"), 2).alias("next_month_prediction"),
        F.date_format(have("next_month", "date"), dates.MONTH_NAME).alias("next_month_date"),
        "total_revenue", F.bround("avg_revenue", 2).alias("avg_revenue"), "max_revenue", "min_revenue",
        F.bround("growth_rate", 2).alias("revenue_growth"), "data_count")
