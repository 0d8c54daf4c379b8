"""Snapshots: only touched partitions are rewritten, and a commit that fails changes nothing."""

import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from bizmetrics.operators.changes import apply_changes
from bizmetrics.sources import snapshots
from conftest import rows

STAMP = dt.datetime(2001, 7, 15)
COLUMNS = "id bigint, day date, amount int"


@pytest.fixture
def table(spark, tmp_path):
    folder = str(tmp_path / "t")
    base = spark.range(60).selectExpr("id", "add_months(date'1998-01-15', cast(id as int)) AS day", "cast(id as int) AS amount")
    base = base.withColumn("day", F.when(F.col("id") != 59, F.col("day")))
    snapshots.create(base, folder, "year(day)")
    return folder, base


def changes(spark, *rows_):
    return spark.createDataFrame([(i, dt.date.fromisoformat(d) if d else None, a, op, seq) for i, d, a, op, seq in rows_], COLUMNS + ", op string, seq int")


def files(spark, folder, value):
    return {p.name for r in snapshots.manifest(spark, folder).where(F.col("value") == value).collect() for p in Path(folder, r.path).glob("*.parquet")}


def test_untouched_years_keep_their_files(spark, table):
    folder, base = table
    years = ("1998", "1999", "2000", "2001", "2002")
    before = {y: files(spark, folder, y) for y in years}
    assert all(before.values())
    batch = changes(spark, (13, "1999-03-01", 500, "update", 1), (14, None, 0, "delete", 1), (100, "1999-12-31", 7, "insert", 1), (15, "2002-01-01", 9, "update", 2))
    assert snapshots.touched(spark, folder, batch, "id") == ["1999"]
    assert snapshots.apply(spark, folder, batch, "id", STAMP) == 1
    after = {y: files(spark, folder, y) for y in years}
    assert {y for y in years if before[y] != after[y]} == {"1999", "2002"}
    assert before["2002"] < after["2002"] and not before["1999"] & after["1999"]
    assert sorted(rows(snapshots.read(spark, folder)), key=repr) == sorted(rows(apply_changes(base, batch, "id", STAMP)), key=repr)
    assert sorted(rows(snapshots.read(spark, folder, version=0)), key=repr) == sorted(rows(base), key=repr)
    assert {r.id for r in snapshots.read(spark, folder, values=["2002", None]).collect()} == {15, 59, *range(48, 59)}


def test_a_commit_that_dies_leaves_the_table(spark, table, monkeypatch):
    folder, base = table
    batch = changes(spark, (3, "1998-02-01", 1, "update", 1))
    commit = snapshots._store

    def dies(spark_, name):
        if "/committed/" in name:
            raise OSError("lost")
        return commit(spark_, name)

    monkeypatch.setattr(snapshots, "_store", dies)
    with pytest.raises(OSError):
        snapshots.apply(spark, folder, batch, "id", STAMP)
    monkeypatch.setattr(snapshots, "_store", commit)
    assert snapshots.versions(spark, folder) == [0]
    assert sorted(rows(snapshots.read(spark, folder)), key=repr) == sorted(rows(base), key=repr)
    snapshots.apply(spark, folder, batch, "id", STAMP)
    assert rows(snapshots.read(spark, folder).where("id = 3").select("amount")) == [(1,)]
    assert snapshots.forget(spark, folder, keep=1) == 1  # what the dead commit left; the first folder is in use
    assert snapshots.read(spark, folder).count() == 60


def test_of_two_commits_of_a_version_one_counts(spark, table):
    folder, _ = table
    batch = changes(spark, (3, "1998-02-01", 1, "update", 1))
    listed = snapshots.manifest(spark, folder).collect()
    snapshots.apply(spark, folder, batch, "id", STAMP)
    with pytest.raises(Exception, match="exists"):
        snapshots._commit(spark, folder, snapshots.read(spark, folder, version=0), listed[0].part, listed[0].columns, [], 1)
    assert rows(snapshots.read(spark, folder).where("id = 3").select("amount")) == [(1,)]


def test_a_table_may_become_empty_and_grow_again(spark, tmp_path):
    folder = str(tmp_path / "t")
    snapshots.create(spark.createDataFrame([(1, None, 5)], COLUMNS), folder, "year(day)")
    snapshots.apply(spark, folder, changes(spark, (1, None, 0, "delete", 1)), "id", STAMP)
    assert rows(snapshots.read(spark, folder)) == []
    snapshots.apply(spark, folder, changes(spark, (2, "2001-01-01", 3, "insert", 1), (9, None, 3, "update", 1)), "id", STAMP)
    assert rows(snapshots.read(spark, folder)) == [(2, dt.date(2001, 1, 1), 3)]
    with pytest.raises(FileExistsError):
        snapshots.create(spark.createDataFrame([], COLUMNS), folder, "year(day)")
    with pytest.raises(FileNotFoundError):
        snapshots.read(spark, str(tmp_path / "none"))
