"""Kept roll-ups: equal to sums of the ledger after any batch, and only changed months are summed again."""

import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from bizmetrics.sources import rollups, snapshots
from conftest import rows

STAMP = dt.datetime(2001, 7, 15)
COLUMNS = "id bigint, category_id bigint, amount decimal(15,2), date date"
DAYS = rollups.EXPENSE_DAYS


@pytest.fixture
def stored(spark, tmp_path):
    """Ten expenses a month over six months, one without a date, one without a category."""
    base = spark.range(61).selectExpr(
        "id", "nullif(id % 3, 2) AS category_id", "cast(id AS decimal(15,2)) AS amount",
        "if(id = 60, null, add_months(date'2001-01-05', cast(id % 6 AS int))) AS date")
    ledger, folder = str(tmp_path / "ledger"), str(tmp_path / "rollup")
    snapshots.create(base, ledger, DAYS.ledger_part)
    assert rollups.behind(spark, ledger, folder) is None
    assert rollups.refresh(spark, ledger, folder, DAYS) is None
    return ledger, folder


def batch(spark, *changes):
    return spark.createDataFrame([(i, c, a, dt.date.fromisoformat(d) if d else None, op, s) for i, c, a, d, op, s in changes],
                                 "id bigint, category_id bigint, amount int, date date, op string, seq int").withColumn("amount", F.col("amount").cast("decimal(15,2)"))


def same(spark, df, ledger):
    want = DAYS.summed(snapshots.read(spark, ledger))
    assert df.schema == want.schema or df.dtypes == want.dtypes
    assert sorted(rows(df), key=repr) == sorted(rows(want), key=repr)


def paths(spark, folder):
    return {r.value: (r.path, {p.name for p in Path(folder, r.path).glob("*.parquet")}) for r in snapshots.manifest(spark, folder).collect() if r.path}


def test_only_months_of_the_batch_are_summed_again(spark, stored):
    ledger, folder = stored
    same(spark, snapshots.read(spark, folder), ledger)
    before = paths(spark, folder)
    assert set(before) == {*(f"2001-0{m}-01" for m in range(1, 7)), None}
    # an update, a delete, a move from March to June, a row for a new month, one that loses nothing
    snapshots.apply(spark, ledger, batch(spark, (2, 1, 900, "2001-03-09", "update", 1), (8, None, 0, None, "delete", 1),
                                         (14, 0, 5, "2001-06-01", "update", 1), (100, 1, 7, "2001-09-30", "insert", 1),
                                         (999, 1, 7, "2001-02-01", "update", 1)), "id", STAMP)
    changed = {"2001-03-01", "2001-06-01", "2001-09-01"}
    assert rollups.behind(spark, ledger, folder) == changed
    same(spark, rollups.current(spark, ledger, folder, DAYS), ledger)
    assert rollups.refresh(spark, ledger, folder, DAYS) == changed
    same(spark, snapshots.read(spark, folder), ledger)
    after = paths(spark, folder)
    assert {m for m in before if before[m] == after[m]} == set(before) - changed
    assert rollups.refresh(spark, ledger, folder, DAYS) == set()
    assert paths(spark, folder) == after and len(snapshots.versions(spark, folder)) == 2


def test_a_month_may_become_empty_and_rows_lose_their_date(spark, stored):
    ledger, folder = stored
    gone = [(i, None, 0, None, "delete", 1) for i in range(1, 60, 6)]
    snapshots.apply(spark, ledger, batch(spark, *gone, (60, 1, 8, "2001-01-01", "update", 1), (3, 1, 8, None, "update", 1)), "id", STAMP)
    assert rollups.refresh(spark, ledger, folder, DAYS) == {"2001-02-01", "2001-01-01", "2001-04-01", None}
    assert "2001-02-01" not in paths(spark, folder)
    same(spark, snapshots.read(spark, folder), ledger)


def test_several_batches_at_once_and_a_forgotten_snapshot(spark, stored):
    ledger, folder = stored
    for i in (0, 1):
        snapshots.apply(spark, ledger, batch(spark, (i, 1, 50 + i, "2001-05-05", "update", 1)), "id", STAMP)
    assert rollups.behind(spark, ledger, folder) == {"2001-01-01", "2001-02-01", "2001-05-01"}
    snapshots.forget(spark, ledger, keep=1)
    assert rollups.behind(spark, ledger, folder) is None
    same(spark, rollups.current(spark, ledger, folder, DAYS), ledger)
    assert rollups.refresh(spark, ledger, folder, DAYS) is None
    same(spark, snapshots.read(spark, folder), ledger)
    assert rollups.behind(spark, ledger, folder) == set()


def test_a_refresh_that_dies_changes_nothing(spark, stored, monkeypatch):
    ledger, folder = stored
    snapshots.apply(spark, ledger, batch(spark, (0, 1, 50, "2001-01-05", "update", 1)), "id", STAMP)
    store = snapshots._store

    def dies(spark_, name):
        if name.startswith(f"{folder}/committed/"):
            raise OSError("lost")
        return store(spark_, name)

    monkeypatch.setattr(snapshots, "_store", dies)
    with pytest.raises(OSError):
        rollups.refresh(spark, ledger, folder, DAYS)
    monkeypatch.setattr(snapshots, "_store", store)
    assert snapshots.versions(spark, folder) == [0]
    assert rollups.refresh(spark, ledger, folder, DAYS) == {"2001-01-01"}
    same(spark, snapshots.read(spark, folder), ledger)


def test_boards_read_only_their_months(spark, stored):
    ledger, folder = stored
    months = rollups.month_and_last("2001-04-10")
    df = rollups.current(spark, ledger, folder, DAYS, months)
    assert {f.split("_part=")[1][:7] for f in df.inputFiles()} == {"2001-03", "2001-04"}
    assert all(f.startswith(f"file://{folder}") for f in df.inputFiles())
    assert {r.date.month for r in df.collect()} == {3, 4}


def test_a_ledger_by_another_part_is_refused(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    snapshots.create(spark.createDataFrame([], COLUMNS), ledger, "year(date)")
    with pytest.raises(ValueError, match="year"):
        rollups.refresh(spark, ledger, str(tmp_path / "rollup"), DAYS)


def test_an_empty_ledger_and_its_first_rows(spark, tmp_path):
    ledger, folder = str(tmp_path / "ledger"), str(tmp_path / "rollup")
    snapshots.create(spark.createDataFrame([], COLUMNS), ledger, DAYS.ledger_part)
    rollups.refresh(spark, ledger, folder, DAYS)
    assert rows(snapshots.read(spark, folder)) == []
    snapshots.apply(spark, ledger, batch(spark, (1, None, 5, "2001-02-03", "insert", 1)), "id", STAMP)
    assert rollups.refresh(spark, ledger, folder, DAYS) == {"2001-02-01"}
    same(spark, snapshots.read(spark, folder), ledger)


def test_the_batch_is_made_once(spark, tables):
    """Both commits read the stored batch, not the tables that it was made of."""
    from registry import rollups as registered
    runs = spark.sparkContext.accumulator(0)

    def seen(batches):
        for rows in batches:
            runs.add(rows.num_rows)
            yield rows

    base = spark.range(60).selectExpr("id", "add_months(date'2001-01-05', cast(id % 6 AS int)) AS transaction_date", "cast(id AS decimal(15,2)) AS amount")
    changes = base.where("id % 3 = 0").selectExpr("*", "if(id % 2 = 0, 'update', 'delete') AS op", "cast(1 + id % 2 AS int) AS seq")
    ledger, _ = registered._follow(tables, base, changes.mapInArrow(seen, changes.schema), rollups.SALES_MONTHS)
    assert runs.value == changes.count() == 20
    assert len(snapshots.versions(spark, ledger)) == 3 and snapshots.read(spark, ledger).count() == 50
