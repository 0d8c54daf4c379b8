import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from bizmetrics.operators import forecast as fc
from bizmetrics.operators.timeseries import forecast_features
from bizmetrics.plans.forecast_report import forecast_report, train_on_series
from conftest import rows
from test_timeseries import months


@pytest.fixture(scope="module")
def synthetic(spark):
    """48 months of trend, season and noise."""
    rng = random.Random(42)
    return months(spark, *[
        5000 + 10000 * i / 47 + 2000 * math.sin(2 * math.pi * i / 12) + rng.gauss(0, 500) for i in range(48)]).cache()


@pytest.fixture(scope="module")
def training(synthetic):
    return train_on_series(synthetic)


def metrics(spark, pairs):
    df = spark.createDataFrame([("m", float(a), float(p)) for a, p in pairs], "model string, actual double, predicted double")
    return fc.regression_metrics(df).first()


def test_metric_identities(spark):
    assert metrics(spark, [(1, 1), (2, 2), (4, 4)])[1:] == (0.0, 0.0, 1.0)
    mean = metrics(spark, [(1, 2), (2, 2), (3, 2)])
    assert mean.r2 == pytest.approx(0.0) and mean.mae == pytest.approx(2 / 3) and mean.rmse == pytest.approx(math.sqrt(2 / 3))
    assert metrics(spark, [(5, 5), (5, 5)]).r2 == 1.0
    assert metrics(spark, [(5, 4), (5, 5)]).r2 == 0.0


def test_gate(spark):
    """The stated target, R² above 0.7, on the series it was stated for, with features as they were then: the
    mean includes the target. From past values alone the same series does not reach it, so the gate can fail."""
    import numpy as np
    np.random.seed(42)
    series = np.linspace(5000, 15000, 48) + 2000 * np.sin(2 * np.pi * np.arange(48) / 12) + np.random.normal(0, 500, 48)
    stated = months(spark, *map(float, series))
    gates = [fc.accuracy_gate(fc.regression_metrics(train_on_series(stated, shift=n).predictions)).first() for n in (0, 1)]
    assert gates[0].passed and gates[0].r2 > 0.7
    scores = spark.createDataFrame([("random_forest", 0.7)], "model string, r2 double")
    assert fc.accuracy_gate(scores).first().passed is False and gates[1].r2 < gates[0].r2


def test_parallel_series_are_told_apart(spark):
    panel = spark.range(3000).selectExpr("id AS k", "explode(sequence(0, 23)) AS m").selectExpr(
        "k", "add_months(date'2000-01-01', m) AS month", "CAST(10 * k + m % 12 AS DOUBLE) AS sales")
    got = {r.k: r.prediction for r in fc.forecast_by_index(panel, ["k"], trees=20).collect()}
    assert len(set(got.values())) == 3000
    assert max(abs(p - (10 * k + 5.5)) for k, p in got.items()) < 7


def test_three_models_are_compared(training):
    scores = fc.regression_metrics(training.predictions)
    assert {r.model for r in scores.collect()} == set(fc.MODEL_ORDER)
    table = {r.model: r.is_best for r in fc.compare_models(scores).collect()}
    assert set(table) == {"Random Forest", "Linear Regression", "Decision Tree"} and sum(table.values()) == 1


def test_test_part_is_the_last_fifth(training, synthetic):
    per_model = training.predictions.groupBy("model").agg(F.count("*").alias("n"), F.min("month").alias("first")).collect()
    # 45 feature rows, 9 of them for the test.
    assert {(r.n, r.first) for r in per_model} == {(9, dt.date(2003, 4, 1))}
    best = fc.forecast_vs_actual(training.predictions, "linear_regression")
    assert best.columns == ["month", "actual", "predicted"] and best.count() == 9


def test_unshifted_mean_leaks_the_target(synthetic):
    leaky = fc.train_all(forecast_features(synthetic, shift=0), names=["linear_regression"])
    clean = fc.train_all(forecast_features(synthetic, shift=1), names=["linear_regression"])
    assert fc.regression_metrics(leaky.predictions).first().r2 == pytest.approx(1.0, abs=1e-6)
    assert fc.regression_metrics(clean.predictions).first().r2 < 0.999


def test_same_seed_same_forest(synthetic, training):
    again = fc.train_all(forecast_features(synthetic), names=["random_forest"])
    before = training.predictions.where("model = 'random_forest'").select("month", "predicted")
    assert rows(again.predictions.select("month", "predicted").orderBy("month")) == rows(before.orderBy("month"))


def test_linear_model_is_least_squares(synthetic, training):
    import numpy as np
    data = [r for r in forecast_features(synthetic).orderBy("month").collect()]
    x = np.array([[*(r[c] for c in fc.FEATURES[:3]), 1.0] for r in data])  # the mean is their sum / 3
    y = np.array([r.revenue for r in data])
    weights = np.linalg.lstsq(x[:36], y[:36], rcond=None)[0]
    predicted = [r.predicted for r in training.predictions.where("model = 'linear_regression'").orderBy("month").collect()]
    assert predicted == pytest.approx(list(x[36:] @ weights), rel=1e-6)


def test_next_month(spark, synthetic, training):
    row = fc.forecast_next(training.models["linear_regression"], synthetic).first()
    serving = fc.serving_row(synthetic).first()
    weights, base = training.models["linear_regression"].coefficients, training.models["linear_regression"].intercept
    expected = base + sum(w * serving[c] for w, c in zip(weights, fc.FEATURES))
    assert row.month == dt.date(2004, 1, 1) and row.forecast == pytest.approx(max(expected, serving.month_lag_1 / 2))


def test_next_month_floor_and_fallback(spark, training):
    model = training.models["linear_regression"]
    short = months(spark, 100, 200).withColumn("k", F.lit("short"))
    steep = months(spark, 1, 1, 1e9).withColumn("k", F.lit("steep"))
    got = {r.k: r.forecast for r in fc.forecast_next(model, short.unionByName(steep), ["k"]).collect()}
    assert got["short"] == pytest.approx(210.0)
    assert got["steep"] >= 0.5e9
    assert fc.forecast_next(None, months(spark, 100)).first().forecast == pytest.approx(105.0)
    assert fc.forecast_next(model, months(spark)).count() == 0


def test_first_model_wins_ties(spark):
    scores = spark.createDataFrame([("decision_tree", 0.5), ("linear_regression", 0.5), ("random_forest", 0.1)], "model string, r2 double")
    assert fc.best_model(scores).first().model == "linear_regression"
    assert fc.accuracy_gate(scores).first().passed is False


def test_importance_sums_to_one(training):
    importance = rows(fc.feature_importance(training))
    assert [r[2] for r in importance] == sorted((r[2] for r in importance), reverse=True)
    assert sum(r[2] for r in importance) == pytest.approx(1.0) and {r[0] for r in importance} == set(fc.FEATURES)


def test_index_forecasts(spark):
    df = months(spark, *[10 * n for n in range(24)]).withColumnRenamed("revenue", "sales")
    assert fc.forecast_by_index_line(df).first() == (24, pytest.approx(240.0))
    forest = fc.forecast_by_index(df).first()
    assert forest.idx == 24 and 200 <= forest.prediction <= 230

    low, high = df.withColumn("k", F.lit("low")), df.withColumn("k", F.lit("high")).withColumn("sales", F.col("sales") + 5000)
    per_key = {r.k: r for r in fc.forecast_by_index(low.unionByName(high), ["k"]).collect()}
    assert per_key["low"].idx == 24 and 150 <= per_key["low"].prediction <= 230
    assert 5150 <= per_key["high"].prediction <= 5230


def test_report(spark, synthetic):
    sales = synthetic.select("month", F.col("revenue").cast("decimal(25,2)").alias("revenue"))
    report = forecast_report(sales, "2003-12-20").first()
    assert report.data_count == 48 and report.next_month_date == "January 2004" and report.best_model in fc.MODEL_ORDER
    assert report.next_month_prediction > 0 and report.r2 <= 1
    # A few days of a month that has only begun don't count as a month.
    begun = sales.unionByName(spark.sql("SELECT date'2004-01-01' AS month, CAST(1 AS DECIMAL(25,2)) AS revenue"))
    assert forecast_report(begun, "2003-12-20").first() == report
    panel = begun.withColumn("k", F.lit("a")).unionByName(sales.withColumn("k", F.lit("b")).where("month < '2003-06-01'"))
    by_key = {r.k: r for r in forecast_report(panel, "2003-12-20", ["k"]).collect()}
    assert (by_key["a"].next_month_date, by_key["b"].next_month_date) == ("January 2004", "June 2003")
    assert by_key["a"].total_revenue == report.total_revenue and by_key["b"].data_count == 41
    short = forecast_report(sales.orderBy("month").limit(5), "2003-12-20")
    assert short.count() == 0 and short.columns == forecast_report(sales, "2003-12-20").columns


def test_every_month_of_a_long_series_is_told_apart(spark):
    """Only the last of 400 months sells: trees that drew it answer its value, about 63 in 100 of them."""
    df = months(spark, *[0.0] * 399, 1000.0).withColumnRenamed("revenue", "sales")
    assert fc.forecast_by_index(df).first().prediction > 500
    assert fc.forecast_by_index(df.withColumn("k", F.lit("a")), ["k"]).first().prediction > 500


def test_a_single_series_is_split_between_all_its_values(spark):
    """A tree that isn't sampled gives each of 300 training rows its own value back."""
    features = spark.range(375).select(
        F.add_months(F.lit("1990-01-01").cast("date"), F.col("id").cast("int")).alias("month"),
        F.col("id").cast("double").alias("x"), (F.col("id") * 7919 % 1009).cast("double").alias("revenue"))
    tree = fc.train_all(features, names=["decision_tree"], columns=["x"]).models["decision_tree"]
    assert len({tree.predict(fc._vectors(spark.createDataFrame([(float(i),)], "x double"), ["x"]).first().features)
                for i in range(280, 290)}) == 10


def _forest_frame(spark, points):
    from pyspark.ml.functions import array_to_vector
    frame = spark.createDataFrame([([float(v) for v in x], float(y)) for x, y in points], "x array<double>, label double")
    return frame.select(array_to_vector("x").alias("features"), "label")


def test_values_of_one_quantile_of_a_panel_are_told_apart(spark):
    """Two series of 700 months: 1,400 lags, some eleven of them to a quantile of 128. A tree gives every row its value."""
    rng = random.Random(5)
    lag = [rng.random() * 1e6 for _ in range(1400)]
    features = spark.createDataFrame(
        [("ab"[i % 2], dt.date(1900 + i // 24, i // 2 % 12 + 1, 1), lag[i], lag[i] * 7 % 1000) for i in range(1400)],
        "k string, month date, x double, revenue double")
    tree = fc.train_all(features, ["k"], names=["decision_tree"], columns=["x"]).models["decision_tree"]
    fitted = fc._vectors(features.where("month < '1946-08-01'"), ["x"])
    assert tree.transform(fitted).where("abs(predicted - revenue) > 1e-6").count() == 0


def _plain_tree(points):
    """Recursive least squares splits over all values; the answer for one point as a function."""
    labels = [y for _, y in points]
    best = None
    for f in range(len(points[0][0])):
        values = sorted({x[f] for x, _ in points})
        for lo, hi in zip(values, values[1:]):
            sides = [[p for p in points if (p[0][f] <= lo) == left] for left in (True, False)]
            error = sum(sum((y - sum(v for _, v in s) / len(s)) ** 2 for _, y in s) for s in sides)
            if best is None or error < best[0] - 1e-9:
                best = error, f, (lo + hi) / 2, sides
    if len(set(labels)) == 1 or best is None:
        return lambda x: sum(labels) / len(labels)
    left, right = map(_plain_tree, best[3])
    return lambda x: left(x) if x[best[1]] <= best[2] else right(x)


def test_tree_is_brute_force(spark):
    from bizmetrics.operators.forest import fit_forest
    rng = random.Random(3)
    points = [((rng.randint(0, 12), rng.random()), rng.choice([rng.random(), 5.0])) for _ in range(90)]
    points += points[:20] + [((3, 0.5), 1.0), ((3, 0.5), 2.0)]  # repeated rows, and one point of two labels
    tree, plain = fit_forest(_forest_frame(spark, points), 1, 30, 42, False), _plain_tree(points)
    asked = points + [((rng.randint(-2, 14), rng.random() * 2 - 0.5), 0.0) for _ in range(100)]
    answers = {tuple(r.features): r.predicted for r in tree.transform(_forest_frame(spark, asked)).collect()}
    for x, _ in asked:
        assert answers[tuple(map(float, x))] == pytest.approx(plain(x), abs=1e-9)
    assert sum(tree.featureImportances) == pytest.approx(1.0)
    assert tree.transform(_forest_frame(spark, asked).limit(0)).count() == 0
    with pytest.raises(ValueError):
        fit_forest(_forest_frame(spark, asked).limit(0), 1, 30, 42, False)


@pytest.mark.parametrize("sampled", [False, True])
def test_large_tables_grow_below_tops(spark, sampled):
    """Leaves of at most 60 points a task: tops are made first, and rows still get their own values."""
    from bizmetrics.operators.forest import fit_forest
    rng = random.Random(8)
    points = [((x := rng.random(), rng.random()), round(x * 10) + rng.random()) for _ in range(1500)]
    forest = fit_forest(_forest_frame(spark, points), 6 if sampled else 1, 30, 42, sampled, leaf_points=60)
    assert forest.top is not None and forest.grown.groupBy("tree").count().agg(F.min("count")).first()[0] >= 25
    wrong = [abs(r.predicted - r.label) for r in forest.transform(_forest_frame(spark, points)).collect()]
    assert len(wrong) == 1500 and (max(wrong) < 1e-6 if not sampled else sum(wrong) / 1500 < 0.4)
    assert forest.featureImportances[0] > 0.8 and sum(forest.featureImportances) == pytest.approx(1.0)


def test_points_that_no_bin_tells_apart_stay_in_bounds(spark):
    """One value with 200 labels is one leaf at any depth: it answers its mean instead of going to one task."""
    from bizmetrics.operators.forest import fit_forest
    points = [((1.0,), float(i)) for i in range(200)] + [((2.0,), 7.0)]
    forest = fit_forest(_forest_frame(spark, points), 1, 30, 42, False, leaf_points=50)
    answers = {r.features[0]: r.predicted for r in forest.transform(_forest_frame(spark, [((1.0,), 0), ((2.0,), 0)])).collect()}
    assert answers == {1.0: pytest.approx(99.5), 2.0: pytest.approx(7.0)}
