"""Revenue forecasting: MLlib's linear and index models, and trees that split between any two values.

One model of each kind is trained over all series of a panel together; series differ by
their lag features only. Metrics, the choice of the best model and the fallbacks are
ordinary aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Model, Transformer
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window, functions as F

from bizmetrics.functions.numbers import truncated
from bizmetrics.functions.text import display_name
from bizmetrics.operators.forest import LEAF_POINTS, Forest, fit_forest
from bizmetrics.operators.timeseries import FEATURES, chrono_split, last_n, month_index
from bizmetrics.session import cut_lineage

#: Model names in order of preference among equal scores.
MODEL_ORDER = ("random_forest", "linear_regression", "decision_tree")

#: As deep as MLlib's trees go, for a month index: they grow until their leaves are pure, as far as that allows.
DEPTH = 30
#: Bins of a month index, at least: it gets as many as there are different months, so every one can be told apart.
BINS = 128
#: For the statistics of the nodes that are split in one pass: deep trees have many.
MEMORY_MB = 1024


@dataclass(frozen=True)
class Training:
    models: dict[str, Model | Forest]
    predictions: DataFrame  # test part: model, keys, time, actual, predicted


def _fitted(name: str, train: DataFrame, trees: int, depth: int | None, seed: int, leaf_points: int) -> Model | Forest:
    if name == "linear_regression":
        return LinearRegression(featuresCol="features", labelCol="label", predictionCol="predicted").fit(train)
    sampled = name == "random_forest"
    return fit_forest(train, trees if sampled else 1, depth, seed, sampled, leaf_points)


def _vectors(df: DataFrame, features: Sequence[str]) -> DataFrame:
    doubles = df.withColumns({f: F.col(f).cast("double") for f in features})
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(doubles)


def train_all(features: DataFrame, by: Sequence[str] | None = None, test_frac: float = 0.2, seed: int = 42,
              value: str = "revenue", time: str = "month", names: Sequence[str] = MODEL_ORDER,
              trees: int = 100, depth: int | None = None, columns: Sequence[str] = FEATURES, leaf_points: int = LEAF_POINTS) -> Training:
    """Fit each model on the earlier part of every series and predict the later part. Trees split between any two
    values, of a panel too; ``leaf_points`` bounds what one task grows (see ``forest``)."""
    keys = [*(by or []), time]
    labelled = _vectors(
        chrono_split(features, by, test_frac, time).withColumn("label", F.col(value).cast("double")), columns)
    # Every fit reads its input several times: store the feature rows, not the way to them.
    stored = cut_lineage(labelled.select(*keys, "part", "label", "features"))
    train, test = (stored.where(F.col("part") == part) for part in ("train", "test"))
    # The fits are independent sequences of jobs: submit them side by side.
    fit = inheritable_thread_target(stored.sparkSession)(
        lambda name: _fitted(name, train, trees, depth, seed, leaf_points))
    with ThreadPool(len(names)) as pool:
        models = dict(zip(names, pool.map(fit, names)))
    predictions = [
        models[name].transform(test).select(
            F.lit(name).alias("model"), *keys, F.col("label").alias("actual"), "predicted")
        for name in names]
    return Training(models, reduce(DataFrame.unionByName, predictions))


def regression_metrics(predictions: DataFrame, by: Sequence[str] | None = ("model",)) -> DataFrame:
    """MAE, RMSE and R² of ``predicted`` against ``actual``."""
    error = F.col("actual") - F.col("predicted")
    sums = predictions.groupBy(*(by or [])).agg(
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.sum(error * error).alias("_sse"),
        (F.var_pop("actual") * F.count("actual")).alias("_sst"))
    sse, sst = F.col("_sse"), F.col("_sst")
    # Constant actuals: perfect predictions score 1, all others 0.
    return sums.select(
        *(by or []), "mae", "rmse",
        F.when(sst > 0, 1 - sse / sst).when(sse == 0, 1.0).otherwise(0.0).alias("r2"))


def _preference() -> Column:
    return F.array_position(F.array(*[F.lit(m) for m in MODEL_ORDER]), F.col("model"))


def best_model(metrics: DataFrame) -> DataFrame:
    """The row with the highest R²; of equals the first in ``MODEL_ORDER``."""
    return metrics.orderBy(F.desc_nulls_last("r2"), _preference()).limit(1)


def compare_models(metrics: DataFrame) -> DataFrame:
    """Display name, rounded metrics and a flag on the best one."""
    # One row per model: this window sees three rows.
    best = F.first("model").over(Window.orderBy(F.desc_nulls_last("r2"), _preference()).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing))
    return metrics.withColumn("_best", best).orderBy(_preference()).select(
        display_name(F.col("model")).alias("model"),
        F.bround("mae", 2).alias("mae"), F.bround("rmse", 2).alias("rmse"), F.bround("r2", 4).alias("r2"),
        (F.col("model") == F.col("_best")).alias("is_best"))


def accuracy_gate(metrics: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The best model's score and whether it passes."""
    return best_model(metrics).select("model", "r2", (F.col("r2") > threshold).alias("passed"))


def serving_row(df: DataFrame, by: Sequence[str] | None = None,
                value: str = "revenue", time: str = "month") -> DataFrame:
    """Per series, the features of the month after its last: the last three values and
    their mean, named as in training. Fewer than three rows leave NULLs."""
    keys = list(by or [])
    recent = last_n(df.select(*keys, time, F.col(value).cast("double").alias("_v")), keys, 3, time)
    newest_first = F.sort_array(F.collect_list(F.struct(time, "_v")), asc=False)  # three rows at most
    return (recent.groupBy(*keys).agg(newest_first.alias("_r"), F.count(F.lit(1)).alias("_n"))
            .where(F.col("_n") > 0)
            .withColumns({f"month_lag_{i}": F.get("_r", F.lit(i - 1))["_v"] for i in (1, 2, 3)})
            .withColumn("rolling_mean_3",
                        (F.col("month_lag_1") + F.col("month_lag_2") + F.col("month_lag_3")) / 3)
            .withColumn("month", F.add_months(F.get("_r", F.lit(0))[time], 1))
            .drop("_r", "_n"))


def winner(training: Training) -> str:
    """The name of the model with the best score."""
    return best_model(regression_metrics(training.predictions)).first()["model"]  # one row per model


def forecast_next(model: Transformer | Forest | None, df: DataFrame, by: Sequence[str] | None = None,
                  value: str = "revenue", time: str = "month") -> DataFrame:
    """Next month per series: the model's prediction, but at least half the last value;
    without a model or three rows of history, the last value plus 5 %."""
    serving = serving_row(df, by, value, time)
    last = F.col("month_lag_1")
    if model is None:
        return serving.select(*(by or []), "month", (last * 1.05).alias("forecast"))
    known = F.col("rolling_mean_3").isNotNull()
    filled = serving.withColumn("_known", known).na.fill(0.0, subset=list(FEATURES[1:]))
    predicted = model.transform(_vectors(filled, FEATURES))
    return predicted.select(
        *(by or []), "month",
        F.when(F.col("_known"), F.greatest("predicted", last * 0.5)).otherwise(last * 1.05).alias("forecast"))


def forecast_vs_actual(predictions: DataFrame, model: str) -> DataFrame:
    return predictions.where(F.col("model") == model).drop("model")


#: Display names of the features.
FEATURE_LABELS = {
    "month_lag_1": "درآمد ماه قبل", "month_lag_2": "درآمد دو ماه قبل", "month_lag_3": "درآمد سه ماه قبل",
    "rolling_mean_3": "میانگین متحرک ۳ ماهه", "transaction_count": "تعداد تراکنش‌ها"}


def feature_importance(training: Training, model: str = "random_forest",
                       columns: Sequence[str] = FEATURES, n: int = 8) -> DataFrame:
    """Importance of each feature in a tree model, largest first."""
    weights = training.models[model].featureImportances.toArray()
    rows = [(c, FEATURE_LABELS.get(c, c), float(w)) for c, w in zip(columns, weights)]
    frame = training.predictions.sparkSession.createDataFrame(rows, "feature string, label string, importance double")
    return frame.orderBy(F.desc("importance"), "feature").limit(n)


def forecast_by_index(monthly: DataFrame, by: Sequence[str] | None = None, value: str = "sales",
                      time: str = "month", trees: int = 100, depth: int = DEPTH, seed: int = 42, bins: int | None = None) -> DataFrame:
    """Forest on the month index, asked for the index after the last; whole part. ``bins`` are by default as many
    as the longest series has months, ``BINS`` at least.

    With keys, one forest serves all series. It learns each month's distance from its series' mean, in the
    series' own standard deviations, and the answer is scaled back: series needn't be told apart.
    """
    keys = list(by or [])
    y, series = F.col(value).cast("double"), Window.partitionBy(*keys)
    level, spread = (F.avg(y).over(series), F.coalesce(F.stddev_pop(y).over(series), F.lit(0.0))) if keys else (F.lit(0.0), F.lit(1.0))
    numbered = month_index(monthly, keys, time).withColumns({"level": level, "spread": spread}).withColumn(
        "label", F.when(F.col("spread") > 0, (y - F.col("level")) / F.col("spread")).otherwise(F.lit(0.0)))
    stored = cut_lineage(_vectors(numbered, ["idx"]).select(*keys, "idx", "level", "spread", "label", "features"))
    bins = bins or max(BINS, (stored.agg(F.max("idx")).first()[0] or 0) + 1)
    # All bins at every split, for trees that fit a short series closely.
    model = RandomForestRegressor(numTrees=trees, maxDepth=depth, maxBins=bins, seed=seed, maxMemoryInMB=MEMORY_MB,
                                  featureSubsetStrategy="all", predictionCol="predicted").fit(stored)
    following = (stored.groupBy(*keys).agg((F.max("idx") + 1).alias("idx"), F.max("level").alias("level"), F.max("spread").alias("spread"))
                 .where(F.col("idx").isNotNull()))
    return model.transform(_vectors(following, ["idx"])).select(
        *keys, F.col("idx").cast("int").alias("idx"),
        truncated(F.col("level") + F.col("spread") * F.col("predicted")).alias("prediction"))


def forecast_by_index_line(monthly: DataFrame, by: Sequence[str] | None = None,
                           value: str = "sales", time: str = "month") -> DataFrame:
    """The same question answered by a least-squares line per series, in one aggregate."""
    x, y = F.col("idx").cast("double"), F.col(value).cast("double")
    fit = month_index(monthly, by, time).groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("idx"), F.regr_slope(y, x).alias("_slope"), F.regr_intercept(y, x).alias("_base"))
    return fit.select(*(by or []), "idx", (F.col("_base") + F.col("_slope") * F.col("idx")).alias("prediction"))
