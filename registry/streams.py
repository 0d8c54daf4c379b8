"""Streams: movements arrive as files; the final state is compared."""

from pyspark.sql import functions as F

from bizmetrics.session import planned_bytes
from bizmetrics.streaming import ledger
from registry.changes import STOCK_SQL
from registry.core import query


def _movements(t):
    """The movement table over a file stream of its given table."""
    # A pattern rather than a plain path: the stream then takes a single file as well as a folder.
    lines = t.spark.readStream.schema(t.lineitem.schema).parquet(f"{t.folder}/lineitem[.]parquet")
    return t.view("inventory_movement", lineitem=lines)


#: Stored bytes of a file that arrives; shuffled rows take about three times as much.
FILE_BYTES = 64 << 20


def _in_batches(t, batches=4):
    """The same movements arriving in several micro-batches of equally many files: one each while the table is small, more
    where it is large, so that no task writes more than a file of bounded size."""
    inbox = t.scratch
    files = max(1, -(-planned_bytes(t.lineitem) // (batches * FILE_BYTES)))
    t.lineitem.repartition(batches * files).write.parquet(inbox)
    lines = t.spark.readStream.schema(t.lineitem.schema).option("maxFilesPerTrigger", files).parquet(inbox)
    return t.view("inventory_movement", lineitem=lines)


@query("stream_stock", """
    SELECT product_id, CAST(SUM(CASE WHEN movement_type IN ('in', 'return') THEN quantity ELSE -quantity END) AS BIGINT)
             AS moved, COUNT(*) AS movements FROM inventory_movement GROUP BY product_id""")
def _(t):
    return ledger.stream_stock(_movements(t), t.scratch)


@query("stream_stock_on_hand", STOCK_SQL)
def _(t):
    return ledger.stream_stock_on_hand(t.product, _movements(t), t.scratch)


@query("stream_daily_movements", """
    SELECT CAST(created_at AS DATE) AS day, COUNT(*) AS movements FROM inventory_movement GROUP BY 1""")
def _(t):
    return ledger.stream_daily_movements(_movements(t), t.scratch)


@query("stream_stock_in_batches", """
    SELECT product_id, CAST(SUM(CASE WHEN movement_type IN ('in', 'return') THEN quantity ELSE -quantity END) AS BIGINT)
             AS moved, COUNT(*) AS movements FROM inventory_movement GROUP BY product_id""")
def _(t):
    return ledger.stream_stock(_in_batches(t), t.scratch)


@query("stream_daily_movements_windowed", """
    SELECT CAST(created_at AS DATE) AS day, COUNT(*) AS movements FROM inventory_movement GROUP BY 1""")
def _(t):
    """Watermarked windows over several micro-batches; the complete mode keeps late days open."""
    return ledger.stream_daily_movements(_in_batches(t), t.scratch, lateness="1 day", mode="complete")


def _arriving(t, inbox, since, until):
    """The movements of some time arrive, each task's as a file of lines. All of them are one micro-batch, so the order of the
    files makes no movement late."""
    lines = t.lineitem.where((F.col("l_shipdate") >= F.lit(since)) & (F.col("l_shipdate") < F.lit(until)))
    lines.write.mode("append").parquet(inbox)
    read = t.spark.readStream.schema(t.lineitem.schema).parquet(inbox)
    return t.view("inventory_movement", lineitem=read)


YEARS = [f"{y}-01-01" for y in (1900, 1994, 1996, 1998, 2100)]
CLOSED = "CAST(created_at AS DATE) + INTERVAL 1 DAY <= (SELECT max(created_at) FROM inventory_movement) - INTERVAL 30 DAY"


@query("stream_daily_movements_closed", f"""
    SELECT CAST(created_at AS DATE) AS day, COUNT(*) AS movements FROM inventory_movement WHERE {CLOSED} GROUP BY 1""")
def _(t):
    """Two years of movements arrive at a time. Days are written once they are closed."""
    inbox, folder = t.scratch, t.scratch
    for since, until in zip(YEARS, YEARS[1:]):
        days = ledger.close_days(_arriving(t, inbox, since, until), folder, "30 days")
    return days


@query("stream_late_movements", f"""
    SELECT COUNT(*) AS arrived, COUNT(*) FILTER (created_at >= DATE '1998-01-01' AND {CLOSED}) AS closed,
           COUNT(*) FILTER (created_at >= DATE '1998-01-01' AND NOT {CLOSED}) AS open, COUNT(*) FILTER (created_at < DATE '1998-01-01') AS late
    FROM inventory_movement""")
def _(t):
    """The newest movements come first: all earlier ones are late."""
    inbox, folder = t.scratch, t.scratch
    for since, until in ((YEARS[-2], YEARS[-1]), (YEARS[0], YEARS[-2])):
        ledger.close_days(_arriving(t, inbox, since, until), folder, "30 days")
    return ledger.closing_report(t.spark, folder).drop("most_open_days")
