"""Tables that change batch by batch, kept as snapshots.

A table lies in partitions by a SQL expression over its columns. A snapshot lists the folders that make up each
partition; it counts once a marker names it, which is the last thing a commit writes. A batch of changes reads and
rewrites only the partitions that hold one of its keys, and the next snapshot takes the others over as they are. A commit
that dies half-way leaves folders that no snapshot names; the table is still the one before.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from bizmetrics.operators.changes import apply_changes

#: ``note`` is free text of whoever committed the snapshot.
MANIFEST = "value string, path string, part string, columns string, note string"
#: The folder Spark gives to a null partition.
NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"


def _store(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _claimed(spark: SparkSession, folder: str) -> dict[int, bool]:
    """The versions that have a marker, and whether it was written: an empty one is a commit that died just then."""
    path, store = _store(spark, f"{folder}/committed")
    return {int(s.getPath().getName()): s.getLen() > 0 for s in store.listStatus(path)} if store.exists(path) else {}


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The committed snapshots, the oldest first."""
    return sorted(v for v, written in _claimed(spark, folder).items() if written)


def name_of(spark: SparkSession, folder: str, version: int | None = None) -> str:
    """What no other snapshot of any table is called; by default of the newest."""
    known = versions(spark, folder)
    if not known:
        raise FileNotFoundError(f"{folder} has no snapshot")
    return spark.read.text(f"{folder}/committed/{known[-1] if version is None else version}").first()[0]


def manifest(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """(value, path, part, columns, note) of a snapshot, by default the newest: one row per folder."""
    return spark.read.schema(MANIFEST).parquet(f"{folder}/snapshots/{name_of(spark, folder, version)}")


def _rows(spark: SparkSession, folder: str, listed: list, columns: str) -> DataFrame:
    paths = [f"{folder}/{r.path}" for r in listed]
    return spark.read.schema(columns).parquet(*paths) if paths else spark.createDataFrame([], columns)


def read(spark: SparkSession, folder: str, version: int | None = None, values: list[str | None] | None = None) -> DataFrame:
    """The table as of a snapshot, or only the partitions with these values (as text; None for null)."""
    listed = manifest(spark, folder, version).collect()  # one row per partition and batch that added to it
    wanted = [r for r in listed if values is None or r.value in values]
    return _rows(spark, folder, [r for r in wanted if r.path], listed[0].columns)


def _commit(spark: SparkSession, folder: str, rows: DataFrame, part: str, columns: str, kept: list, version: int, note: str = "", gather: bool = True) -> int:
    """Write ``rows`` by partition (those of one brought together, if asked), then the snapshot, then its marker. A marker
    can be made once: of two commits of one version the second fails, and what it wrote is never read."""
    name = f"{version}-{uuid.uuid4().hex}"
    attempt = f"data/{name}"
    place = f"{folder}/{attempt}"
    parted = rows.withColumn("_part", F.expr(part).cast("string"))
    (parted.hint("rebalance", "_part") if gather else parted).write.partitionBy("_part").parquet(place)
    path, store = _store(spark, place)
    names = [s.getPath().getName() for s in store.listStatus(path) if s.isDirectory()]
    unescape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    made = [(None if (value := n.removeprefix("_part=")) == NULL_FOLDER else unescape(value), f"{attempt}/{n}") for n in names]
    folders = [*[(r.value, r.path) for r in kept], *made] or [(None, "")]
    listed = [(value, path, part, columns, note) for value, path in folders]
    spark.createDataFrame(listed, MANIFEST).coalesce(1).write.parquet(f"{folder}/snapshots/{name}")
    marker, store = _store(spark, f"{folder}/committed/{version}")
    stream = store.create(marker, False)
    stream.writeBytes(name)
    stream.close()
    return version


def create(df: DataFrame, folder: str, part: str, note: str = "") -> int:
    """Store ``df`` as the first snapshot of a table, in partitions by the expression ``part``. Rows of a partition come
    together, a large one in files of several tasks."""
    spark = df.sparkSession
    claimed = _claimed(spark, folder)
    if any(claimed.values()):
        raise FileExistsError(f"{folder} has a table already")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return _commit(spark, folder, df, part, columns, [], max(claimed, default=-1) + 1, note)


def replace(df: DataFrame, folder: str, values: set[str | None], note: str = "") -> int:
    """Commit a snapshot in which ``df`` takes the place of the partitions with these values; the others stay as they are."""
    spark = df.sparkSession
    version = max(_claimed(spark, folder), default=-1) + 1
    listed = manifest(spark, folder).collect()
    kept = [r for r in listed if r.path and r.value not in values]
    part, columns = listed[0].part, listed[0].columns
    return _commit(spark, folder, df, part, columns, kept, version, note)


def touched(spark: SparkSession, folder: str, changes: DataFrame, key: str) -> list[str | None]:
    """The partitions that hold a key of the batch. Of the table, only the key and what the partition is made of are read."""
    first = manifest(spark, folder).first()
    table = read(spark, folder)
    keys = changes.select(key).distinct()
    held = table.withColumn("_part", F.expr(first.part).cast("string")).join(keys, key, "left_semi")
    return [r[0] for r in held.select("_part").distinct().collect()]  # partitions, not rows


def apply(spark: SparkSession, folder: str, changes: DataFrame, key: str, stamp: dt.datetime, order: str = "seq") -> int:
    """Commit the table after a batch of changes (see ``apply_changes``) as a new snapshot, and return its version. Rows
    that are new, or whose partition changes, are added to that partition as files of their own."""
    version = max(_claimed(spark, folder), default=-1) + 1
    listed = manifest(spark, folder).collect()
    part, columns = listed[0].part, listed[0].columns
    hit = set(touched(spark, folder, changes, key))
    rewritten, kept = [r for r in listed if r.path and r.value in hit], [r for r in listed if r.path and r.value not in hit]
    after = apply_changes(_rows(spark, folder, rewritten, columns), changes, key, stamp, order)
    return _commit(spark, folder, after, part, columns, kept, version, gather=False)


def forget(spark: SparkSession, folder: str, keep: int = 2) -> int:
    """Remove all but the newest ``keep`` snapshots, and the folders that only they, or commits that failed, made. Not
    to be run beside a commit. Returns how many folders went."""
    new = versions(spark, folder)[-keep:]
    markers = {v: spark.read.text(f"{folder}/committed/{v}").first()[0] for v in new}
    used = {r.path.split("/")[1] for v in new for r in manifest(spark, folder, v).collect() if r.path}
    gone = []
    for kind, stays in (("committed", {str(v) for v in new}), ("snapshots", set(markers.values())), ("data", used)):
        path, store = _store(spark, f"{folder}/{kind}")
        for found in store.listStatus(path):
            if found.getPath().getName() not in stays:
                store.delete(found.getPath(), True)
                gone.append(kind)
    return gone.count("data")
