"""Windows over month series, single and per country."""

from pyspark.sql import functions as F

from bizmetrics.operators import timeseries as ts
from bizmetrics.operators.inventory import running_stock
from registry.core import query

BY = ["country"]


def _both(name, sql, build, doubles=""):
    """Register the single series and the panel. ``{part}`` is the PARTITION BY clause,
    ``{key}`` the key column with its comma, ``{src}`` the table."""
    single = sql.format(part="", key="", src="(SELECT month, revenue FROM monthly_sales) b", group="")
    keyed = sql.format(part="PARTITION BY country", key="country, ", src="panel", group="GROUP BY country")
    query(name, single, doubles)(lambda t: build(t.monthly_sales.select("month", "revenue"), []))
    query(f"{name}_by_country", keyed, doubles)(lambda t: build(t.panel, BY))


LAGS = ", ".join(f"lag(revenue, {k}) OVER ({{part}} ORDER BY month) AS month_lag_{k}" for k in (1, 2, 3))


def _mean(shift):
    frame = f"ROWS BETWEEN {2 + shift} PRECEDING AND {f'{shift} PRECEDING' if shift else 'CURRENT ROW'}"
    over = f"OVER ({{part}} ORDER BY month {frame})"
    return (f"CASE WHEN COUNT(revenue) {over} = 3 THEN CAST(SUM(revenue) {over} AS DOUBLE) / 3 END AS rolling_mean_3")


_both("lag_features", f"SELECT {{key}}month, revenue, {LAGS} FROM {{src}}",
      lambda df, by: ts.lag_features(df, by), "revenue month_lag_1 month_lag_2 month_lag_3")
_both("rolling_mean", f"SELECT {{key}}month, revenue, {_mean(0)} FROM {{src}}",
      lambda df, by: ts.rolling_mean(df, by), "revenue")
_both("rolling_mean_shifted", f"SELECT {{key}}month, revenue, {_mean(1)} FROM {{src}}",
      lambda df, by: ts.rolling_mean(df, by, shift=1), "revenue")
_both("forecast_features", f"""
    SELECT * FROM (SELECT {{key}}month, revenue, {LAGS}, {_mean(1)} FROM {{src}}) x WHERE month_lag_3 IS NOT NULL""",
      lambda df, by: ts.forecast_features(df, by), "revenue month_lag_1 month_lag_2 month_lag_3")
_both("forecast_features_unshifted", f"""
    SELECT * FROM (SELECT {{key}}month, revenue, {LAGS}, {_mean(0)} FROM {{src}}) x WHERE month_lag_3 IS NOT NULL""",
      lambda df, by: ts.forecast_features(df, by, shift=0), "revenue month_lag_1 month_lag_2 month_lag_3")
_both("last_n", """
    SELECT {key}month, revenue FROM (
        SELECT *, row_number() OVER ({part} ORDER BY month DESC) AS rn FROM {src}) x WHERE rn <= 3""",
      lambda df, by: ts.last_n(df, by), "revenue")
_both("growth_rate", """
    SELECT {key}CASE WHEN n >= 2 AND first > 0 THEN (last - first) / first * 100 ELSE 0.0 END AS growth_rate FROM (
        SELECT {key}max(n) AS n,
               CAST(SUM(revenue) FILTER (up <= CASE WHEN n >= 12 THEN 12 ELSE 1 END) AS DOUBLE)
                 / max(CASE WHEN n >= 12 THEN 12 ELSE 1 END) AS first,
               CAST(SUM(revenue) FILTER (down <= CASE WHEN n >= 12 THEN 12 ELSE 1 END) AS DOUBLE)
                 / max(CASE WHEN n >= 12 THEN 12 ELSE 1 END) AS last
        FROM (SELECT *, row_number() OVER ({part} ORDER BY month) AS up,
                     row_number() OVER ({part} ORDER BY month DESC) AS down,
                     COUNT(*) OVER ({part}) AS n FROM {src}) r {group}) g""",
      lambda df, by: ts.growth_rate(df, by))
_both("trend_line", """
    SELECT {key}month, revenue, idx, round(slope, 2) AS slope, round(intercept, 2) AS intercept,
           round(intercept + slope * idx, 2) AS fitted
    FROM (SELECT *, regr_slope(CAST(revenue AS DOUBLE), idx) OVER ({part}) AS slope,
                 regr_intercept(CAST(revenue AS DOUBLE), idx) OVER ({part}) AS intercept
          FROM (SELECT *, CAST(row_number() OVER ({part} ORDER BY month) - 1 AS INTEGER) AS idx FROM {src}) a) x""",
      # Sums of doubles differ between engines in the last digits.
      lambda df, by: ts.trend_line(df, by).withColumns({c: F.round(c, 2) for c in ("slope", "intercept", "fitted")}),
      "revenue")
_both("chrono_split", """
    SELECT {key}month, revenue, CASE WHEN rn > n - ceil(CAST(0.2 AS DOUBLE) * n) THEN 'test' ELSE 'train' END AS part FROM (
        SELECT *, row_number() OVER ({part} ORDER BY month) AS rn, COUNT(*) OVER ({part}) AS n FROM {src}) x""",
      lambda df, by: ts.chrono_split(df, by), "revenue")
_both("mom_change", """
    SELECT {key}month, revenue, (CAST(revenue AS DOUBLE) - before) / before * 100 AS change FROM (
        SELECT *, CAST(COALESCE(NULLIF(lag(revenue) OVER ({part} ORDER BY month), 0), 1) AS DOUBLE) AS before
        FROM {src}) x""",
      lambda df, by: ts.mom_change(df, by), "revenue")
_both("month_index", """
    SELECT {key}month, revenue, CAST(row_number() OVER ({part} ORDER BY month) - 1 AS INTEGER) AS idx FROM {src}""",
      lambda df, by: ts.month_index(df, by), "revenue")


RUNNING_SQL = """
    SELECT *, CAST(SUM(CASE WHEN movement_type IN ('in', 'return') THEN quantity
                            WHEN movement_type IN ('out', 'damage') THEN -quantity ELSE 0 END)
              OVER (PARTITION BY product_id ORDER BY created_at, id, movement_type, quantity
                    ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_stock FROM inventory_movement"""


@query("running_stock", RUNNING_SQL)
def _(t):
    return running_stock(t.inventory_movement)


@query("running_stock_from_opening", f"""
    SELECT m.* REPLACE (m.running_stock + p.quantity AS running_stock)
    FROM ({RUNNING_SQL}) m JOIN product p ON m.product_id = p.id""")
def _(t):
    return running_stock(t.inventory_movement, t.product)
