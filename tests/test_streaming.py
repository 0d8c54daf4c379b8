import datetime as dt

import pytest

from bizmetrics.operators.inventory import stock_on_hand
from bizmetrics.streaming import ledger
from conftest import rows
from registry import streams
from registry.core import Tables

SCHEMA = "id bigint, product_id bigint, movement_type string, quantity int, created_at timestamp_ntz"


def arrive(spark, folder, *moves):
    spark.createDataFrame([(*m[:4], dt.datetime.fromisoformat(m[4])) for m in moves], SCHEMA).coalesce(1).write.mode(
        "append").parquet(folder)


@pytest.fixture
def inbox(spark, tmp_path):
    folder = str(tmp_path / "inbox")
    arrive(spark, folder, (1, 1, "in", 5, "2001-07-15T08:00"), (2, 2, "out", 3, "2001-07-15T09:00"))
    return folder


def test_stock_goes_on_where_it_stopped(spark, inbox, tmp_path):
    state = str(tmp_path / "stock")
    moves = ledger.movement_stream(spark, inbox)
    assert sorted(rows(ledger.stream_stock(moves, state))) == [(1, 5, 1), (2, -3, 1)]
    # Nothing new: the same answer.
    assert sorted(rows(ledger.stream_stock(moves, state))) == [(1, 5, 1), (2, -3, 1)]
    arrive(spark, inbox, (3, 1, "damage", 1, "2001-07-16T08:00"), (4, 3, "return", 7, "2001-07-16T08:00"))
    streamed = ledger.stream_stock(moves, state)
    assert sorted(rows(streamed)) == [(1, 4, 2), (2, -3, 1), (3, 7, 1)]
    products = spark.createDataFrame([(n, f"P{n}", 0) for n in (1, 2, 3)], "id bigint, product_code string, quantity int")
    batch = stock_on_hand(products, spark.read.parquet(inbox))
    assert sorted(rows(batch.select("id", "moved"))) == sorted(rows(streamed.select("product_id", "moved")))


def test_late_movements_still_count(spark, inbox, tmp_path):
    state = str(tmp_path / "days")
    moves = ledger.movement_stream(spark, inbox, files_per_batch=1)
    ledger.stream_daily_movements(moves, state)
    arrive(spark, inbox, (3, 1, "in", 1, "2001-09-01T08:00"))
    ledger.stream_daily_movements(moves, state)
    arrive(spark, inbox, (4, 1, "in", 1, "2001-07-15T23:59"))
    assert sorted(rows(ledger.stream_daily_movements(moves, state))) == [
        (dt.date(2001, 7, 15), 3), (dt.date(2001, 9, 1), 1)]


def test_uncommitted_rows_are_not_read(spark, inbox, tmp_path):
    state = str(tmp_path / "stock")
    ledger.stream_stock(ledger.movement_stream(spark, inbox), state)
    half_done = spark.createDataFrame([(1, 999, 9)], "product_id bigint, moved bigint, movements bigint")
    half_done.write.parquet(f"{state}/state/epoch=0/batch=1")
    assert sorted(rows(ledger.read_state(spark, state, "product_id"))) == [(1, 5, 1), (2, -3, 1)]
    # The batch is run again and replaces what was left behind.
    arrive(spark, inbox, (3, 1, "in", 1, "2001-09-01T08:00"))
    assert sorted(rows(ledger.stream_stock(ledger.movement_stream(spark, inbox), state))) == [(1, 6, 2), (2, -3, 1)]


def test_nothing_has_arrived(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    moves = ledger.movement_stream(spark, str(tmp_path / "empty"))
    stock = ledger.stream_stock(moves, str(tmp_path / "s"))
    assert stock.columns == ["product_id", "moved", "movements"] and stock.count() == 0
    assert ledger.stream_daily_movements(moves, str(tmp_path / "d")).count() == 0


def test_epochs_carry_the_state_on(spark, inbox, tmp_path, monkeypatch):
    monkeypatch.setattr(ledger, "BATCHES_PER_EPOCH", 2)
    state = str(tmp_path / "stock")
    moves = ledger.movement_stream(spark, inbox)
    ledger.stream_stock(moves, state)
    for n in range(5):
        arrive(spark, inbox, (10 + n, 1, "in", 1, "2001-09-01T08:00"))
        streamed = ledger.stream_stock(moves, state)
    assert ledger.last_batch(spark, state) == 5
    assert sorted(rows(streamed)) == [(1, 10, 6), (2, -3, 1)]
    assert sorted(p.name for p in (tmp_path / "stock" / "state").iterdir() if p.is_dir()) == ["epoch=1", "epoch=2"]


def test_closed_days_are_appended(spark, inbox, tmp_path):
    arrive(spark, inbox, (3, 1, "in", 1, "2001-07-15T20:00"), (4, 1, "in", 1, "2001-07-18T08:00"))
    out = str(tmp_path / "closed")
    counts = ledger.daily_counts(ledger.movement_stream(spark, inbox), lateness="1 day")
    query = (counts.writeStream.outputMode("append").format("parquet").option("path", out)
             .option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start())
    query.awaitTermination()
    # The last day is still open.
    assert rows(spark.read.parquet(out)) == [(dt.date(2001, 7, 15), 3)]


def test_closed_days_are_kept_and_late_movements_counted(spark, inbox, tmp_path):
    """The state holds the open days only, however many days there have been."""
    state = str(tmp_path / "closed")
    moves = ledger.movement_stream(spark, inbox, files_per_batch=1)
    ledger.close_days(moves, state, "2 days")
    for n in range(16, 22):
        arrive(spark, inbox, *[(100 * n + k, k, "in", 1, f"2001-07-{n}T08:00") for k in range(3)])
        days = ledger.close_days(moves, state, "2 days")
    got = dict(rows(days))
    assert got == {dt.date(2001, 7, 15): 2} | {dt.date(2001, 7, n): 3 for n in range(16, 19)}
    report = ledger.closing_report(spark, state).first().asDict()
    assert report == {"arrived": 20, "closed": 11, "open": 9, "late": 0, "most_open_days": report["most_open_days"]}
    assert report["most_open_days"] <= 5
    arrive(spark, inbox, (1, 1, "in", 1, "2001-07-15T23:59"), (2, 1, "in", 1, "2001-07-16T10:00"), (3, 1, "in", 1, "2001-07-21T23:00"))
    assert dict(rows(ledger.close_days(moves, state, "2 days"))) == got
    assert ledger.closing_report(spark, state).drop("most_open_days").first().asDict() == {"arrived": 23, "closed": 11, "open": 10, "late": 2}


@pytest.fixture
def lines(spark, tmp_path):
    """A table of movements in eight files, each over all its days."""
    rows = spark.range(0, 4000, numPartitions=8).selectExpr(
        "id AS l_orderkey", "1 AS l_linenumber", "id % 7 AS l_partkey", "'N' AS l_returnflag", "'O' AS l_linestatus", "CAST(2 AS DOUBLE) AS l_quantity",
        "timestamp_ntz'1992-01-01' + make_interval(0, 0, 0, CAST((id * 7919) % 2500 AS INT)) AS l_shipdate")
    rows.write.parquet(str(tmp_path / "lineitem.parquet"))
    return Tables(spark, str(tmp_path))


def files_of(folder):
    return [p for p in folder.iterdir() if p.suffix == ".parquet"]


def test_arrivals_are_written_by_many_tasks_in_one_batch(lines, spark, tmp_path, conf):
    conf("spark.sql.files.openCostInBytes", str(128 << 20))  # a task per file
    inbox, state = tmp_path / "in", str(tmp_path / "closed")
    for n, (since, until) in enumerate((("1900-01-01", "1994-01-01"), ("1994-01-01", "2100-01-01"))):
        days = ledger.close_days(streams._arriving(lines, str(inbox), since, until), state, "30 days")
        assert len(files_of(inbox)) == 8 * (n + 1)
    report = ledger.closing_report(spark, state).first()
    assert report.arrived == 4000 and report.late == 0 and report.closed == sum(r.movements for r in days.collect())


def test_large_tables_arrive_in_more_files_and_as_many_batches(lines, spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "FILE_BYTES", 1 << 11)
    inbox, state = tmp_path / "in", str(tmp_path / "stock")
    monkeypatch.setattr(Tables, "scratch", str(inbox))
    stock = ledger.stream_stock(streams._in_batches(lines), state)
    assert len(files_of(inbox)) > 4 and len(files_of(inbox)) % 4 == 0 and ledger.last_batch(spark, state) == 3
    assert sum(r.movements for r in stock.collect()) == 4000
