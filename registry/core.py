"""How queries are registered and what they run on."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from bizmetrics.operators.product_sales import monthly_resample
from bizmetrics.session import fresh_dir
from registry.views import GIVEN, VIEWS

AS_OF = "2001-07-15"

#: Oracle-only view: the gap-filled month series per country that ``Tables.panel`` is.
PANEL_SQL = """
    SELECT s.country, s.month, CAST(COALESCE(m.revenue, 0) AS DECIMAL(25,2)) AS revenue
    FROM (SELECT country, CAST(unnest(generate_series(MIN(date_trunc('month', sale_date)),
                 MAX(date_trunc('month', sale_date)), INTERVAL 1 MONTH)) AS DATE) AS month
          FROM {product_sales} GROUP BY country) s
    LEFT JOIN (SELECT country, CAST(date_trunc('month', sale_date) AS DATE) AS month, SUM(sales) AS revenue
               FROM {product_sales} GROUP BY 1, 2) m
      ON s.country = m.country AND s.month = m.month"""


class Tables:
    """The given tables and the business tables over them, as lazy frames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def given(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def view(self, name: str, **replace: DataFrame) -> DataFrame:
        """A business table; ``replace`` swaps in other frames for the tables below it."""
        sql = VIEWS[name]
        needs = set(re.findall(r"\{(\w+)\}", sql))
        return self.spark.sql(sql, **{
            n: replace.get(n) or (self.given(n) if n in GIVEN else self.view(n, **replace)) for n in needs})

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self.view(name)
        if name in GIVEN:
            return self.given(name)
        raise AttributeError(name)

    @property
    def panel(self) -> DataFrame:
        """Month series per country, gaps filled."""
        return monthly_resample(self.product_sales, ["country"]).withColumnRenamed("sales", "revenue")

    @property
    def scratch(self) -> str:
        return fresh_dir(self.spark, "registry")


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def plain(df: DataFrame) -> DataFrame:
    """Exact decimals shown as doubles, for comparison across engines."""
    return df.select([
        F.col(f"`{f.name}`").cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f"`{f.name}`")
        for f in df.schema.fields])


def _with_views(sql: str) -> str:
    """Prefix the views a query names, in order of definition."""
    texts = {**VIEWS, "panel": PANEL_SQL}
    used: set[str] = set()

    def visit(text: str) -> None:
        for name in texts:
            if name not in used and re.search(rf"\b{name}\b", text):
                used.add(name)
                visit(texts[name])

    visit(sql)
    names = {n: n for n in (*texts, *GIVEN)}
    parts = [f"{n} AS ({texts[n].format(**names)})" for n in texts if n in used]
    if sql.lstrip().startswith("WITH"):
        sql = f"SELECT * FROM ({sql}) q"
    return f"WITH {', '.join(parts)} {sql}" if parts else sql


def query(name: str, sql: str | None = None, doubles: str = "") -> Callable:
    """Register ``fn(tables) -> DataFrame`` under ``name``.

    ``sql`` asks the same of the oracle over the same view names; ``doubles`` lists its
    decimal columns, to be shown as doubles like on the Spark side.
    """
    if sql is not None:
        if doubles:
            casts = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in doubles.split())
            sql = f"SELECT * REPLACE ({casts}) FROM ({sql}) q"
        sql = _with_views(sql)

    def register(fn: Callable[[Tables], DataFrame]) -> Callable:
        if name in REGISTRY:
            raise ValueError(f"{name} is registered twice")
        REGISTRY[name] = Query(lambda spark, folder: plain(fn(Tables(spark, folder))), sql)
        return fn

    return register


def runners() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q.run for name, q in REGISTRY.items()}


def oracles() -> dict[str, str]:
    return {name: q.sql for name, q in REGISTRY.items() if q.sql is not None}
