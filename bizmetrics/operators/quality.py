"""Data-quality rules: which rows break which rule."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from bizmetrics.functions.text import any_of
from bizmetrics.schemas import ENTITIES

MAX_AMOUNT = 999_999_999


@dataclass(frozen=True)
class Rule:
    name: str
    broken: Column  # true where the rule is broken; NULL counts as not broken


def not_negative(col: str) -> Rule:
    return Rule(f"{col}_negative", F.col(col) < 0)


def at_most(col: str, limit: int) -> Rule:
    return Rule(f"{col}_too_large", F.col(col) > limit)


def required(col: str) -> Rule:
    return Rule(f"{col}_missing", F.col(col).isNull())


def max_length(col: str, limit: int) -> Rule:
    return Rule(f"{col}_too_long", F.length(col) > limit)


def fits_decimal(col: str, digits: int, places: int, held: T.DataType | None = None) -> list[Rule]:
    """Digit limits of a decimal column. Where the type ``held`` rules a breach out,
    nothing is checked."""
    value, limit = F.col(col), digits - places
    exact = isinstance(held, T.DecimalType)
    breaches = []
    if not (exact and held.precision - held.scale <= limit):
        breaches.append(F.abs(value) >= F.lit(10 ** limit))
    if not (exact and held.scale <= places):
        breaches.append(value != F.round(value, places))
    return [Rule(f"{col}_digits", any_of(breaches))] if breaches else []


def one_of(col: str, allowed: list[str]) -> Rule:
    return Rule(f"{col}_not_allowed", ~F.col(col).isin(allowed))


#: Rules of the input forms, beyond what the columns themselves demand.
FORM_RULES = {
    "monthly_sales": lambda: [not_negative("revenue"), not_negative("transaction_count")],
    "expense": lambda: [not_negative("amount"), at_most("amount", MAX_AMOUNT)],
}


def rules_for(entity: str, schema: T.StructType | None = None) -> list[Rule]:
    """Column rules (required, length, digits, choices) and form rules of an entity, for
    the columns a frame of this ``schema`` has."""
    spec = ENTITIES[entity]
    held = {f.name: f.dataType for f in (schema or spec.schema).fields}
    rules = [required(n) for n in spec.required if n in held]
    rules += [max_length(n, k) for n, k in spec.max_length.items() if n in held]
    for n, t, _ in spec.fields:
        if isinstance(t, T.DecimalType) and n in held:
            rules += fits_decimal(n, spec.digits.get(n, t.precision), t.scale, held[n])
    rules += [one_of(n, list(labels)) for n, labels in spec.choices.items() if n in held]
    return rules + (FORM_RULES[entity]() if entity in FORM_RULES else [])


def any_broken(rules: list[Rule]) -> Column:
    return any_of([r.broken for r in rules])


def check(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add ``failures``: the names of the broken rules, in rule order."""
    names = F.array(*[F.when(r.broken, r.name).otherwise("") for r in rules])
    return df.withColumn("failures", F.array_remove(names, ""))


def quality(df: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """Split into valid rows and rejected rows (with their failures)."""
    broken = any_broken(rules)
    return df.where(~broken), check(df.where(broken), rules)


def write_split(df: DataFrame, rules: list[Rule], path: str) -> None:
    """Store valid and rejected rows apart, below ``path/valid=...``, reading ``df`` once."""
    (check(df, rules).withColumn("valid", F.size("failures") == 0)
     .write.mode("overwrite").partitionBy("valid").parquet(path))


def failure_counts(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Broken rows per rule, in one pass."""
    counts = df.agg(*[F.count_if(F.coalesce(r.broken, F.lit(False))).alias(r.name) for r in rules])
    return counts.unpivot([], [r.name for r in rules], "rule", "rows")


def duplicate_keys(df: DataFrame, key: str | list[str]) -> DataFrame:
    """Key values that occur more than once. NULL keys do not collide."""
    keys = [key] if isinstance(key, str) else key
    return (df.na.drop("any", subset=keys).groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1))


def duplicate_keys_of(df: DataFrame, entity: str) -> DataFrame:
    """Values of the entity's declared keys that occur more than once, as text: ``key``, ``value``, ``rows``."""
    keys = ENTITIES[entity].unique
    if not keys:
        raise ValueError(f"{entity} declares no unique column")
    found = [duplicate_keys(df.select(F.col(k).cast("string").alias("value")), "value").select(F.lit(k).alias("key"), "value", "rows") for k in keys]
    return reduce(DataFrame.unionByName, found)
