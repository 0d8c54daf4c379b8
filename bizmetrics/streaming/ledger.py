"""Stock and daily movement counts kept up to date by Structured Streaming.

Each micro-batch stores its changed rows in a folder named by the batch id, so a batch
that is run again after a failure replaces its own rows. The current state is the newest
row of every key among the batches that are marked as whole. Batches are grouped into epochs, and an
epoch starts with a copy of the state before it: reading never goes back further than
one epoch, and older ones are removed. Nothing passes through the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from bizmetrics.operators.inventory import signed_quantity
from bizmetrics.schemas import ENTITIES

BATCHES_PER_EPOCH = 100
#: What a stream of closed days counts of each batch.
ARRIVALS = "arrivals"
NOTES = "batch bigint, arrived bigint, open_days bigint"


def movement_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Movements arriving as parquet files."""
    return (spark.readStream.schema(ENTITIES["inventory_movement"].schema)
            .option("maxFilesPerTrigger", files_per_batch).parquet(path))


def stock_changes(movements: DataFrame) -> DataFrame:
    """Running net quantity per product: one state row each, so no watermark is needed.
    Quantities are summed per task before they reach the state, whatever the skew."""
    return movements.groupBy("product_id").agg(
        F.sum(signed_quantity()).alias("moved"), F.count(F.lit(1)).alias("movements"))


def daily_counts(movements: DataFrame, lateness: str | None = None) -> DataFrame:
    """Movements per day. Without ``lateness`` every late row still counts and the state
    is one row per day; with it (session time zone UTC), days older than that are closed
    and their late rows dropped."""
    count = F.count(F.lit(1)).alias("movements")
    if not lateness:
        return movements.groupBy(F.to_date("created_at").alias("day")).agg(count)
    timed = movements.withColumn("created_at", F.col("created_at").cast("timestamp"))
    return (timed.withWatermark("created_at", lateness)
            .groupBy(F.window("created_at", "1 day")).agg(count)
            .select(F.col("window.start").cast("date").alias("day"), "movements"))


def _newest(versions: DataFrame, key: str) -> DataFrame:
    columns = [c for c in versions.columns if c not in {key, "batch"}]
    latest = F.max_by(F.struct(*columns), F.col("batch"))
    return versions.groupBy(key).agg(latest.alias("_row")).select(key, "_row.*")


def keep_state(changes: DataFrame, folder: str, key: str, mode: str = "update") -> StreamingQuery:
    """Run over everything that has arrived, then stop; call again to go on.

    A batch's rows are stored, then a marker that says they are whole; a batch that is run again after a failure
    writes the same rows and marker. When an epoch begins, the one before the last is removed: whoever still
    reads has the last one's, and no state is read further back.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        epoch, first = divmod(batch_id, BATCHES_PER_EPOCH)
        here = f"{folder}/state/epoch={epoch}"
        if epoch and not first:
            before = spark.read.parquet(f"{folder}/state/epoch={epoch - 1}")
            _newest(before, key).write.mode("overwrite").parquet(f"{here}/batch={batch_id - 1}")
        batch.write.mode("overwrite").parquet(f"{here}/batch={batch_id}")
        spark.range(1).select(F.lit(batch_id).alias("batch")).coalesce(1).write.mode("overwrite").parquet(
            f"{folder}/whole/epoch={epoch}/batch_{batch_id}")
        if epoch > 1 and not first:
            _remove(spark, f"{folder}/state/epoch={epoch - 2}", f"{folder}/whole/epoch={epoch - 2}")

    return (changes.writeStream.outputMode(mode).foreachBatch(save)
            .option("checkpointLocation", f"{folder}/progress")
            .trigger(availableNow=True).start())


def _path(spark: SparkSession, name: str):
    """A Hadoop path and its file system: the folder may be in any store."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _remove(spark: SparkSession, *folders: str) -> None:
    for name in folders:
        path, store = _path(spark, name)
        store.delete(path, True)


def last_batch(spark: SparkSession, folder: str) -> int | None:
    """The newest batch whose rows are whole; None before the first."""
    path, store = _path(spark, f"{folder}/whole")
    if not store.exists(path):
        return None
    marked = spark.read.option("recursiveFileLookup", True).schema("batch int").parquet(f"{folder}/whole")
    return marked.agg(F.max("batch")).first()[0]


def read_state(spark: SparkSession, folder: str, key: str, schema: T.StructType | None = None) -> DataFrame:
    """The newest row of every key, up to the last whole batch; an empty frame of ``schema`` if nothing has arrived."""
    last = last_batch(spark, folder)
    if last is None:
        return spark.createDataFrame([], schema or f"{key} string")
    versions = spark.read.parquet(f"{folder}/state/epoch={last // BATCHES_PER_EPOCH}")
    return _newest(versions.where(F.col("batch") <= last), key)


def _noted(spark: SparkSession, query: StreamingQuery, folder: str) -> None:
    """Wait for the run to end, and store how many rows its batches took in and how many it left in the state. A query
    remembers its last batches only, so it is asked while it runs."""
    seen: dict[int, tuple[int, int]] = {}
    active = True
    while active:
        active = not query.awaitTermination(2)
        for p in query.recentProgress:
            state = p["stateOperators"]
            arrived = (p.get("observedMetrics") or {}).get(ARRIVALS)
            seen[p["batchId"]] = (arrived["rows"] if arrived else 0, state[0]["numRowsTotal"] if state else 0)
    if seen:
        rows = [(batch, *counts) for batch, counts in sorted(seen.items())]
        spark.createDataFrame(rows, NOTES).coalesce(1).write.mode("append").parquet(f"{folder}/notes")


def close_days(movements: DataFrame, folder: str, lateness: str) -> DataFrame:
    """Bring the counts of closed days up to date and return them. A day is written once, when nothing of it
    counts any more: ``lateness`` after its end by the newest movement's time. Its state goes then, so the state holds
    the open days only; movements that arrive for closed days are dropped and counted (``closing_report``)."""
    counts = daily_counts(movements.observe(ARRIVALS, F.count(F.lit(1)).alias("rows")), lateness)
    _noted(movements.sparkSession, keep_state(counts, folder, "day", "append"), folder)
    return read_state(movements.sparkSession, folder, "day", counts.schema)


def closing_report(spark: SparkSession, folder: str) -> DataFrame:
    """One row about a stream of closed days: movements ``arrived``, in ``closed`` days, in ``open`` ones, dropped because they
    were ``late``, and ``most_open_days``, the most days that the state held after a batch."""
    closed = read_state(spark, folder, "day", T.StructType.fromDDL("day date, movements bigint")).agg(F.coalesce(F.sum("movements"), F.lit(0)).alias("closed"))
    kept = spark.read.format("statestore").load(f"{folder}/progress").agg(F.coalesce(F.sum("value.count"), F.lit(0)).alias("open"))
    # A batch that was run again was noted again.
    notes = spark.read.schema(NOTES).parquet(f"{folder}/notes").dropDuplicates(["batch"])
    took = notes.agg(F.sum("arrived").alias("arrived"), F.max("open_days").alias("most_open_days"))
    # Three one-row results, stacked and folded.
    names = ("closed", "open", "arrived", "most_open_days")
    stacked = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), (closed, kept, took))
    whole = stacked.agg(*[F.max(c).cast("bigint").alias(c) for c in names])
    return whole.select("arrived", "closed", "open", (F.col("arrived") - F.col("closed") - F.col("open")).alias("late"), "most_open_days")


def _kept(changes: DataFrame, folder: str, key: str, mode: str = "update") -> DataFrame:
    keep_state(changes, folder, key, mode).awaitTermination()
    return read_state(changes.sparkSession, folder, key, changes.schema)


def stream_stock(movements: DataFrame, folder: str) -> DataFrame:
    """Bring the stock state up to date and return it."""
    return _kept(stock_changes(movements), folder, "product_id")


def stream_stock_on_hand(products: DataFrame, movements: DataFrame, folder: str) -> DataFrame:
    """Opening quantity plus what has streamed in so far, for every product."""
    moved = stream_stock(movements, folder).select(F.col("product_id").alias("id"), "moved")
    net = F.coalesce("moved", F.lit(0))
    return products.join(moved, "id", "left").select(
        "id", "product_code", F.col("quantity").alias("opening"), net.alias("moved"),
        (F.col("quantity") + net).alias("stock"))


def stream_daily_movements(movements: DataFrame, folder: str, lateness: str | None = None, mode: str = "update") -> DataFrame:
    """Bring the daily counts up to date and return them. With ``lateness`` the days are watermarked windows, and
    ``mode`` "complete" keeps all of them."""
    return _kept(daily_counts(movements, lateness), folder, "day", mode)
