"""Session settings and the shared working folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings the operators are written for. They are defaults, not requirements:
#: anything set on the cluster or passed to ``build_session`` wins.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Row-level lookups (an expense's category, a movement's product) keep the hot
    # key's rows; the adaptive skew join splits such a partition while reading it.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Stored slices and feature rows go when nothing refers to them any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # Streaming state is one row per product or day, kept off the JVM heap.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


#: Shuffled bytes per partition to aim for; adaptive execution merges smaller ones but
#: never splits an ordinary shuffle partition.
PARTITION_BYTES = 256 << 20


def partitions_for(shuffle_bytes: int, least: int = 200) -> int:
    return max(least, -(-shuffle_bytes // PARTITION_BYTES))


#: How much larger than its stored tables a frame is taken to be at most. Without statistics the
#: optimizer's estimate of a join is the product of its sides.
GROWTH = 8


def planned_bytes(df: DataFrame) -> int:
    """The size the optimizer expects ``df`` to have, within reason; 0 where it can't tell."""
    plan = df._jdf.queryExecution().optimizedPlan()
    size = lambda node: int(node.stats().sizeInBytes())
    leaves = plan.collectLeaves()
    stored = [size(leaves.apply(i)) for i in range(leaves.size())]
    return 0 if any(n >> 62 for n in stored) else min(size(plan), GROWTH * sum(stored))


def build_session(app: str = "bizmetrics", master: str | None = None, shuffle_bytes: int | None = None,
                  **conf: str) -> SparkSession:
    """A session with the settings above. ``shuffle_bytes`` is the size of the largest
    shuffle to expect (the columns it carries, not the whole table): it sets the number of
    shuffle partitions, and so also the number of range slices and sort partitions."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    sized = {"spark.sql.shuffle.partitions": str(partitions_for(shuffle_bytes))} if shuffle_bytes else {}
    for key, value in {**DEFAULTS, **sized, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: the one ``spark.checkpoint.dir`` names, else a folder in the
    session's warehouse, which every executor writes its tables to."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    folder = configured or context.getCheckpointDir()
    if not folder:
        context.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch")
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Store ``df`` once in the shared folder and go on from the stored rows.

    Used where several jobs or branches must see the very same rows (range slices,
    repeated model passes) and must survive the loss of an executor.
    """
    spark = df.sparkSession
    folder = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def store_once(df: DataFrame, label: str) -> DataFrame:
    """Like ``cut_lineage``, stored by column: later reads of a few columns read only those. The files stay in
    the shared folder, to be removed with it."""
    path = fresh_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def store_bucketed(df: DataFrame, label: str, column: str, buckets: int) -> DataFrame:
    """Like ``store_once``, as an unmanaged table bucketed by ``column``: what groups by it, with or without other
    columns, needs no shuffle afterwards. Rows of one task should belong to one bucket, else there are many small files."""
    name = f"{label}_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").bucketBy(buckets, column).option("path", fresh_dir(df.sparkSession, label))
    writer.saveAsTable(name)
    return df.sparkSession.table(name)
