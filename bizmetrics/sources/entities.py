"""Entity tables with a fixed schema, stored as parquet."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from bizmetrics.functions.dates import AsOf, as_date
from bizmetrics.schemas import ENTITIES
from bizmetrics.session import partitions_for, planned_bytes

YEAR = "year"  # folder column of entities laid out by year
#: How much larger rows are while a task sorts them than in the files they come from.
SORTED = 8


def conform(df: DataFrame, name: str) -> DataFrame:
    """Bring a frame to the entity's columns, order and types; absent columns are NULL."""
    have = set(df.columns)
    return df.select([
        (F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t, _ in ENTITIES[name].fields])


def load_entity(spark: SparkSession, directory: str, name: str,
                since: AsOf | None = None, until: AsOf | None = None) -> DataFrame:
    """Scan ``directory/name.parquet`` with the declared schema: nothing is inferred,
    columns the file lacks read as NULL.

    ``since`` and ``until`` (both inclusive days) bound the entity's time column. Where the
    files are laid out by year they also choose the folders, so files outside the range
    are not even opened.
    """
    entity = ENTITIES[name]
    stored = spark.read.schema(entity.schema).parquet(f"{directory}/{name}.parquet")
    if since or until:
        if entity.time is None:
            raise ValueError(f"{name} has no column of time to bound")
        time = F.col(entity.time)
        by_year = YEAR in stored.columns and entity.partition_by is not None
        if since:
            first = as_date(since)
            stored = stored.where(time >= F.lit(first))
            stored = stored.where(F.col(YEAR) >= first.year) if by_year else stored
        if until:
            last = as_date(until)
            stored = stored.where(time < F.lit(last + dt.timedelta(days=1)))
            stored = stored.where(F.col(YEAR) <= last.year) if by_year else stored
    return conform(stored, name)


def store_entity(df: DataFrame, directory: str, name: str, **options: object) -> str:
    """Write an entity so that date filters skip files and key lookups skip row groups.

    Tables with a time column are laid out by year and range-clustered by date with the
    other key columns as tie-break, so one busy day can still be split over tasks; others by their id.
    There are as many files as ``PARTITION_BYTES`` asks for at the size that the rows have in a task's sort, whatever the
    session's number of shuffle partitions. Keys get Bloom filters, sized by the values a row group holds. ``options`` go to the writer.
    """
    entity, path = ENTITIES[name], f"{directory}/{name}.parquet"
    rows = conform(df, name)
    known = planned_bytes(df)
    files = partitions_for(SORTED * known, 1) if known else int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [c for c in ("id", "product_id", "category_id") if c in rows.columns]
    blooms = {f"parquet.bloom.filter.enabled#{c}": "true" for c in {*keys, *entity.unique}}
    written = {"parquet.bloom.filter.adaptive.enabled": "true", **blooms, **options}
    if entity.partition_by is None:
        order = keys or list(entity.unique)
        rows.repartitionByRange(files, *order).sortWithinPartitions(*order).write.mode("overwrite").options(**written).parquet(path)
        return path
    (rows.withColumn(YEAR, F.year(entity.partition_by))
         .repartitionByRange(files, YEAR, entity.partition_by, *keys)
         .sortWithinPartitions(YEAR, entity.partition_by)  # the writer's order by folder, so that it sorts no second time
         .write.mode("overwrite").options(**written).partitionBy(YEAR).parquet(path))
    return path
