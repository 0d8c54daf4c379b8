"""Forecasting. What MLlib fits has no SQL equal; everything around it has."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from bizmetrics.operators import forecast as fc
from bizmetrics.operators.product_sales import monthly_resample
from bizmetrics.operators.timeseries import FEATURES, forecast_features
from bizmetrics.plans.forecast_report import forecast_report, train_on_series
from registry.core import AS_OF, query

BY = ["country"]

# Three SQL-expressible predictors stand in for the models where scores are compared.
STAND_INS = {"random_forest": "month_lag_1", "linear_regression": "rolling_mean_3", "decision_tree": "month_lag_3"}

PREDICTIONS_SQL = """
    SELECT country, month, actual, model, CASE model WHEN 'random_forest' THEN lag1
           WHEN 'linear_regression' THEN mean3 ELSE lag3 END AS predicted
    FROM (SELECT country, month, CAST(revenue AS DOUBLE) AS actual,
                 CAST(lag(revenue, 1) OVER w AS DOUBLE) AS lag1, CAST(lag(revenue, 3) OVER w AS DOUBLE) AS lag3,
                 CAST(SUM(revenue) OVER (PARTITION BY country ORDER BY month ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)
                   AS DOUBLE) / 3 AS mean3
          FROM panel WINDOW w AS (PARTITION BY country ORDER BY month)) f,
         (SELECT unnest(['random_forest', 'linear_regression', 'decision_tree']) AS model) m
    WHERE lag3 IS NOT NULL"""


def _metrics_sql(keys):
    return f"""
    SELECT {keys}, avg(abs(actual - predicted)) AS mae, sqrt(avg((actual - predicted) ^ 2)) AS rmse,
           1 - sum((actual - predicted) ^ 2) / sum((actual - mean) ^ 2) AS r2
    FROM (SELECT *, avg(actual) OVER (PARTITION BY {keys}) AS mean FROM ({PREDICTIONS_SQL}) p) q GROUP BY {keys}"""


def _predictions(t) -> DataFrame:
    features = forecast_features(t.panel, BY)
    parts = [features.select("country", "month", F.lit(name).alias("model"),
                             F.col("revenue").cast("double").alias("actual"),
                             F.col(col).cast("double").alias("predicted")) for name, col in STAND_INS.items()]
    return reduce(DataFrame.unionByName, parts)


def _rounded(df):
    return df.withColumns({c: F.round(c, d) for c, d in (("mae", 2), ("rmse", 2), ("r2", 6)) if c in df.columns})


def _round_sql(sql, others, cols=("mae", "rmse", "r2")):
    digits = {"mae": 2, "rmse": 2, "r2": 6}
    return f"SELECT {others}, {', '.join(f'round({c}, {digits[c]}) AS {c}' for c in cols)} FROM ({sql}) z"


BEST_ORDER = """r2 DESC, CASE model WHEN 'random_forest' THEN 1 WHEN 'linear_regression' THEN 2 ELSE 3 END"""


@query("regression_metrics", _round_sql(_metrics_sql("model"), "model"))
def _(t):
    return _rounded(fc.regression_metrics(_predictions(t)))


@query("regression_metrics_by_country", _round_sql(_metrics_sql("model, country"), "model, country"))
def _(t):
    return _rounded(fc.regression_metrics(_predictions(t), ["model", "country"]))


@query("best_model", _round_sql(f"SELECT * FROM ({_metrics_sql('model')}) a ORDER BY {BEST_ORDER} LIMIT 1", "model"))
def _(t):
    return _rounded(fc.best_model(fc.regression_metrics(_predictions(t))))


@query("compare_models", f"""
    SELECT CASE model WHEN 'random_forest' THEN 'Random Forest' WHEN 'linear_regression' THEN 'Linear Regression'
                ELSE 'Decision Tree' END AS model,
           round_even(mae, 2) AS mae, round_even(rmse, 2) AS rmse, round_even(r2, 4) AS r2,
           row_number() OVER (ORDER BY {BEST_ORDER}) = 1 AS is_best
    FROM ({_metrics_sql('model')}) a""")
def _(t):
    return fc.compare_models(fc.regression_metrics(_predictions(t)))


@query("accuracy_gate", f"""
    SELECT model, round(r2, 6) AS r2, r2 > 0.7 AS passed
    FROM (SELECT * FROM ({_metrics_sql('model')}) a ORDER BY {BEST_ORDER} LIMIT 1) b""")
def _(t):
    return _rounded(fc.accuracy_gate(fc.regression_metrics(_predictions(t))))


@query("forecast_vs_actual_stand_in", f"SELECT * EXCLUDE (model) FROM ({PREDICTIONS_SQL}) p WHERE model = 'linear_regression'")
def _(t):
    return fc.forecast_vs_actual(_predictions(t), "linear_regression")


@query("forecast_next_fallback", """
    SELECT country, CAST(month + INTERVAL 1 MONTH AS DATE) AS month, CAST(revenue AS DOUBLE) * CAST(1.05 AS DOUBLE) AS forecast
    FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY month DESC) AS rn FROM panel) x WHERE rn = 1""")
def _(t):
    return fc.forecast_next(None, t.panel, BY)


@query("serving_row", """
    SELECT country, CAST(max(month) + INTERVAL 1 MONTH AS DATE) AS month,
           max(v) FILTER (rn = 1) AS month_lag_1, max(v) FILTER (rn = 2) AS month_lag_2, max(v) FILTER (rn = 3) AS month_lag_3,
           (max(v) FILTER (rn = 1) + max(v) FILTER (rn = 2) + max(v) FILTER (rn = 3)) / 3 AS rolling_mean_3
    FROM (SELECT country, month, CAST(revenue AS DOUBLE) AS v,
                 row_number() OVER (PARTITION BY country ORDER BY month DESC) AS rn FROM panel) x GROUP BY country""")
def _(t):
    return fc.serving_row(t.panel, BY)


@query("forecast_by_index_line", """
    SELECT country, COUNT(*) AS idx, round(regr_intercept(y, i) + regr_slope(y, i) * COUNT(*), 2) AS prediction
    FROM (SELECT country, CAST(revenue AS DOUBLE) AS y, row_number() OVER (PARTITION BY country ORDER BY month) - 1 AS i
          FROM panel) x GROUP BY country""")
def _(t):
    line = fc.forecast_by_index_line(t.panel, BY, "revenue")
    return line.withColumn("prediction", F.round("prediction", 2))


# -- MLlib: rows only, each with what SQL can say about it beside it --------------------

#: The part of the panel that training keeps: series of at least six months, four of them with features.
TESTED_SQL = """
    SELECT country, month, CAST(revenue AS DOUBLE) AS actual
    FROM (SELECT *, row_number() OVER w AS rn, COUNT(*) OVER (PARTITION BY country) AS n FROM (
            SELECT *, lag(revenue, 3) OVER (PARTITION BY country ORDER BY month) AS lag3, COUNT(*) OVER (PARTITION BY country) AS months
            FROM panel) f WHERE lag3 IS NOT NULL AND months >= 6 WINDOW w AS (PARTITION BY country ORDER BY month)) g
    WHERE n >= 4 AND rn > n - ceil(0.2 * n)"""


def _train(t, **models):
    return train_on_series(t.panel, BY, **models)


#: What SQL can check doesn't depend on the number of trees.
FEW = {"trees": 10}


@query("train_all")
def _(t):
    return fc.regression_metrics(_train(t).predictions)


@query("train_all_checks", f"""
    SELECT m AS model, COUNT(*) AS tested, true AS rmse_not_below_mae
    FROM ({TESTED_SQL}) x, (SELECT unnest(['random_forest', 'linear_regression', 'decision_tree']) AS m) y GROUP BY m""")
def _(t):
    error = F.col("actual") - F.col("predicted")
    return _train(t, **FEW).predictions.groupBy("model").agg(
        F.count("*").alias("tested"), (F.sqrt(F.avg(error * error)) >= F.avg(F.abs(error))).alias("rmse_not_below_mae"))


#: Least squares over three lags by the normal equations: centred sums, and Cramer's rule for the three slopes.
LINEAR_SQL = """
    WITH lagged AS (SELECT country, month, CAST(revenue AS DOUBLE) AS y, CAST(lag(revenue) OVER w AS DOUBLE) AS a,
                           CAST(lag(revenue, 2) OVER w AS DOUBLE) AS b, CAST(lag(revenue, 3) OVER w AS DOUBLE) AS c
                    FROM panel WINDOW w AS (PARTITION BY country ORDER BY month)),
         placed AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY month)
                              <= COUNT(*) OVER (PARTITION BY country) - ceil(CAST(0.2 AS DOUBLE) * COUNT(*) OVER (PARTITION BY country)) AS fitted
                    FROM lagged WHERE c IS NOT NULL),
         sums AS (SELECT covar_pop(a, a) AS aa, covar_pop(a, b) AS ab, covar_pop(a, c) AS ac, covar_pop(b, b) AS bb,
                         covar_pop(b, c) AS bc, covar_pop(c, c) AS cc, covar_pop(a, y) AS ya, covar_pop(b, y) AS yb,
                         covar_pop(c, y) AS yc, avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, avg(y) AS my
                  FROM placed WHERE fitted),
         slopes AS (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det,
                           ya * (bb * cc - bc * bc) - ab * (yb * cc - bc * yc) + ac * (yb * bc - bb * yc) AS da,
                           aa * (yb * cc - bc * yc) - ya * (ab * cc - bc * ac) + ac * (ab * yc - yb * ac) AS db,
                           aa * (bb * yc - yb * bc) - ab * (ab * yc - yb * ac) + ya * (ab * bc - bb * ac) AS dc FROM sums)
    SELECT country, month, y AS actual,
           round((my + da / det * (a - ma) + db / det * (b - mb) + dc / det * (c - mc)) / 1000) AS predicted_thousands
    FROM placed, slopes WHERE NOT fitted"""


@query("train_linear", LINEAR_SQL)
def _(t):
    """The linear model as ``train_all`` fits it, on the lags alone: with their mean beside them they determine each other."""
    trained = fc.train_all(forecast_features(t.panel, BY), BY, names=["linear_regression"], columns=FEATURES[:3])
    return trained.predictions.select("country", "month", "actual", F.round(F.col("predicted") / 1000).alias("predicted_thousands"))


@query("forecast_vs_actual")
def _(t):
    trained = _train(t)
    return fc.forecast_vs_actual(trained.predictions, fc.winner(trained))


@query("forecast_vs_actual_checks", TESTED_SQL)
def _(t):
    trained = _train(t, **FEW)
    return fc.forecast_vs_actual(trained.predictions, fc.winner(trained)).drop("predicted")


@query("forecast_next")
def _(t):
    trained = _train(t)
    return fc.forecast_next(trained.models[fc.winner(trained)], t.panel, BY)


@query("forecast_next_checks", """
    SELECT country, CAST(max(month) + INTERVAL 1 MONTH AS DATE) AS month, true AS half_of_last_or_more FROM panel GROUP BY country""")
def _(t):
    trained = _train(t, **FEW)
    following = fc.forecast_next(trained.models[fc.winner(trained)], t.panel, BY)
    last = fc.serving_row(t.panel, BY).select("country", "month_lag_1")
    return following.join(last, "country").select("country", "month", (F.col("forecast") >= F.col("month_lag_1") / 2).alias("half_of_last_or_more"))


@query("feature_importance")
def _(t):
    trained = fc.train_all(forecast_features(t.panel, BY), BY, names=["random_forest"])
    return fc.feature_importance(trained)


@query("feature_importance_checks", """
    SELECT CAST(4 AS BIGINT) AS features, true AS sum_to_one, true AS none_below_zero FROM (SELECT COUNT(*) AS n FROM panel) p WHERE n > 0""")
def _(t):
    trained = fc.train_all(forecast_features(t.panel, BY), BY, names=["random_forest"], **FEW)
    weight = F.col("importance")
    return fc.feature_importance(trained).agg(
        F.count("*").alias("features"), (F.abs(F.sum(weight) - 1) < 1e-9).alias("sum_to_one"), (F.min(weight) >= 0).alias("none_below_zero"))


@query("forecast_report")
def _(t):
    return forecast_report(t.monthly_sales, AS_OF)


#: Total, mean, extremes and count of the months up to that of the reference date, and the month after.
REPORT_SQL = """
    SELECT {key}strftime(max(month) + INTERVAL 1 MONTH, '%B %Y') AS next_month_date, SUM(revenue) AS total_revenue,
           round_even(CAST(SUM(revenue) AS DOUBLE) / COUNT(*), 2) AS avg_revenue, MAX(revenue) AS max_revenue, MIN(revenue) AS min_revenue,
           COUNT(*) AS data_count FROM {src} WHERE month < DATE '2001-08-01' {group}HAVING COUNT(*) >= 7"""
REPORT_COLUMNS = ["next_month_date", "total_revenue", "avg_revenue", "max_revenue", "min_revenue", "data_count"]


@query("forecast_report_checks", REPORT_SQL.format(key="", src="monthly_sales", group=""), "total_revenue max_revenue min_revenue")
def _(t):
    return forecast_report(t.monthly_sales, AS_OF).select(*REPORT_COLUMNS)


@query("forecast_report_by_country")
def _(t):
    return forecast_report(t.panel, AS_OF, BY)


@query("forecast_report_by_country_checks", REPORT_SQL.format(key="country, ", src="panel", group="GROUP BY country "),
       "total_revenue max_revenue min_revenue")
def _(t):
    return forecast_report(t.panel, AS_OF, BY, **FEW).select("country", *REPORT_COLUMNS)


@query("forecast_by_index")
def _(t):
    return fc.forecast_by_index(monthly_resample(t.product_sales))


@query("forecast_by_index_by_country")
def _(t):
    return fc.forecast_by_index(t.panel, BY, "revenue")


@query("forecast_by_index_checks", "SELECT country, CAST(COUNT(*) AS INT) AS idx, true AS within_range FROM panel GROUP BY country")
def _(t):
    """A forest's answer lies between the least and the greatest value it has seen, here in units of its series."""
    y = F.col("revenue").cast("double")
    seen = t.panel.groupBy("country").agg(F.avg(y).alias("level"), F.stddev_pop(y).alias("spread"))
    unit = F.col("spread") * 12
    return fc.forecast_by_index(t.panel, BY, "revenue", **FEW).join(seen, "country").select(
        "country", "idx", (F.abs(F.col("prediction") - F.col("level")) <= unit + 1).alias("within_range"))
