"""What several of the corpus operators share."""

from __future__ import annotations

import zipfile
from pathlib import Path

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from bizmetrics.session import cut_lineage, fresh_dir

#: A stored table may be broadcast if it holds so many values (keys, numbers, spans) at most,
#: some tens of MB. Beyond that the same join shuffles; its rows are the same.
BROADCAST_VALUES = 200_000

#: Bytes of a batch that a task's Python gets at once, unless the session asks for a size of its own. Spark's
#: own measure is a number of rows, which says nothing about the memory that long texts take.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8388608b")  # and Spark's default

_shipped: set[str] = set()


def uri(path: str) -> str:
    """``path`` as a URI that names its store."""
    return path if "://" in path or path.startswith("file:") else Path(path).absolute().as_uri()


def ship(spark: SparkSession) -> None:
    """Let Spark hand this package to the executors' Python, once per application, in batches of bounded size.

    Operators with Python in their tasks call it, so that the package need not be installed on
    the executors. The archive lies in the shared folder.
    """
    context = spark.sparkContext
    name, default, size = BATCH_BYTES
    if spark.conf.get(name) == default:
        spark.conf.set(name, size)
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    if not package.is_dir():
        return  # it came in an archive itself
    store, path = fs.FileSystem.from_uri(place := uri(fresh_dir(spark, "package")))
    store.create_dir(path)
    with store.open_output_stream(f"{path}/package.zip") as out, zipfile.ZipFile(out, "w") as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    context.addPyFile(f"{place}/package.zip")
    _shipped.add(context.applicationId)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sized(df: DataFrame, values: Column | None = None) -> DataFrame:
    """``df`` stored, and marked for broadcasting if it is measured to be small. ``values`` says how
    many values a row holds, where that isn't bounded."""
    stored = cut_lineage(df)
    held = stored.agg(F.count("*") if values is None else F.sum(values)).first()[0] or 0
    return F.broadcast(stored) if held <= BROADCAST_VALUES else stored


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A digest of a row's id and text, never null: rows with the same key are repeated rows.

    Decisions about rows travel under this key, so that rows with a null or a repeated id
    still get their own decision.
    """
    parts = [F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("")) for c in (id_col, text_col)]
    return F.md5(F.concat_ws("\x1f", *parts))


def narrow(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """Only the columns an operator works on, under fixed names, whatever else the table holds."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"),
                       *[F.col(f"`{c}`").alias(c) for c in more])


def spare(docs: DataFrame, name: str) -> str:
    """A column name like ``name`` that clashes with none of the table's."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = "_" + name
    return name


def keep_keys(docs: DataFrame, keys: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              drop: bool = False) -> DataFrame:
    """The rows of ``docs`` whose row key is in ``keys`` (one column ``key``), or is not."""
    name = spare(docs, "row_key")
    keyed = docs.withColumn(name, row_key(id_col, text_col))
    wanted = keys.select(F.col("key").alias(name))
    return keyed.join(wanted, name, "left_anti" if drop else "left_semi").drop(name)
