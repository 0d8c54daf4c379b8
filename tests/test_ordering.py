"""Pages, global positions and running sums, against brute force."""

import datetime as dt
import random

import pytest

from bizmetrics.operators import ordering as o
from bizmetrics.operators.inventory import running_stock
from bizmetrics.schemas import MOVEMENT_SIGN
from conftest import plan_of, rows


@pytest.fixture(scope="module")
def movements(spark):
    """A third of all movements belong to product 7, many of them at the same time."""
    rng = random.Random(3)
    start = dt.datetime(2001, 1, 1)
    data = [(n, 7 if n % 3 == 0 else rng.randrange(40), rng.choice([*MOVEMENT_SIGN, "other"]), rng.randrange(1, 50),
             start + dt.timedelta(days=0 if n % 2 else rng.randrange(60))) for n in range(3000)]
    rng.shuffle(data)
    return spark.createDataFrame(
        data, "id bigint, product_id bigint, movement_type string, quantity int, created_at timestamp_ntz").repartition(5)


@pytest.fixture
def many_slices(conf):
    """Small data would be merged into one slice."""
    conf("spark.sql.adaptive.coalescePartitions.enabled", "false")
    conf("spark.sql.shuffle.partitions", "9")


@pytest.mark.parametrize("asked, pages, shown", [
    (1, 5, 1), ("3", 5, 3), (0, 5, 5), (-2, 5, 5), (6, 5, 5), ("x", 5, 1), (None, 5, 1), ("2.5", 5, 1), ("", 5, 1),
    (1, 1, 1), (float("inf"), 5, 1)])
def test_page_number(asked, pages, shown):
    assert o.page_number(asked, pages) == shown


def test_page_of_nothing(spark):
    page = o.page(spark.range(0), ["id"], 4)
    assert (page.number, page.page_count, page.row_count, page.start_index, page.end_index) == (1, 1, 0, 0, 0)
    assert page.rows.count() == 0


@pytest.mark.parametrize("number", [1, 2, 75, 149, 150, 999, 0])
@pytest.mark.parametrize("shallow", [10_000, 100])
def test_pages_are_slices_of_the_sorted_rows(movements, many_slices, monkeypatch, number, shallow):
    monkeypatch.setattr(o, "SHALLOW_ROWS", shallow)
    order = ["-created_at", "product_id", "-id"]
    expected = sorted(rows(movements), key=lambda r: (-r[4].timestamp(), r[1], -r[0]))
    page = o.page(movements, order, number, 20)
    shown = number if 1 <= number <= 150 else 150
    assert (page.number, page.page_count, page.row_count) == (shown, 150, 3000)
    assert (page.start_index, page.end_index) == ((shown - 1) * 20 + 1, shown * 20)
    assert rows(page.rows) == expected[(shown - 1) * 20:shown * 20]


@pytest.fixture(scope="module")
def tied(spark):
    """One key of three values, some nulls, and a third of the rows wholly equal."""
    rng = random.Random(9)
    data = [("a", 1, None, 1.5)] * 1000 + [(rng.choice("abc"), rng.randrange(30), rng.choice([None, "x", "y"]), rng.random()) for _ in range(2000)]
    rng.shuffle(data)
    return spark.createDataFrame(data, "kind string, n int, note string, amount double").repartition(4)


@pytest.mark.parametrize("order", [["kind"], ["-note", "n"]])
def test_all_pages_hold_every_row_once(tied, many_slices, monkeypatch, order):
    monkeypatch.setattr(o, "SAMPLED", 40)
    monkeypatch.setattr(o, "SPLITTERS", 8)
    numbers, size = (2, 4, 5, 9), 250
    by_way = {}
    for shallow in (10_000, 60):
        monkeypatch.setattr(o, "SHALLOW_ROWS", shallow)
        by_way[shallow] = {n: rows(o.page(tied, order, n, size).rows) for n in numbers}
    assert by_way[60] == by_way[10_000]
    monkeypatch.setattr(o, "SHALLOW_ROWS", 10_000)
    every = [r for n in range(1, 13) for r in (by_way[10_000].get(n) or rows(o.page(tied, order, n, size).rows))]
    assert sorted(every, key=repr) == sorted(rows(tied), key=repr)


def test_a_deep_page_stores_nothing(tied, monkeypatch):
    monkeypatch.setattr(o, "SHALLOW_ROWS", 100)
    monkeypatch.setattr(o, "store_once", None)
    assert o.page(tied, ["n"], 15, 20).rows.count() == 20


@pytest.mark.parametrize("order, ties", [(["-created_at", "id"], 0), (["product_id"], 1)])
def test_only_the_last_pass_reads_whole_rows(movements, tmp_path, monkeypatch, order, ties):
    """Counting passes read the leading columns; tie-break columns only inside a run of equal keys."""
    monkeypatch.setattr(o, "SHALLOW_ROWS", 100)
    monkeypatch.setattr(o, "SAMPLED", 100)
    path = f"{tmp_path}/movements"
    movements.write.parquet(path)
    passes, counted = [], o._counted

    def seen(df, by, splitters):
        plan = df._jdf.queryExecution().executedPlan().toString()
        passes.append((by, plan.split("ReadSchema: struct<")[1].split(">")[0]))
        return counted(df, by, splitters)

    monkeypatch.setattr(o, "_counted", seen)
    hot = sorted(rows(movements), key=lambda r: (r[1], r[0]) if ties else (-r[4].timestamp(), r[0]))
    at = next(i for i, r in enumerate(hot) if r[1] == 7) // 20 + 30 if ties else 75
    got = rows(o.page(movements.sparkSession.read.parquet(path), order, at, 20).rows)
    assert len(got) == 20 and (not ties or {r[1] for r in got} == {7})
    lead = [p for p in passes if p[0] == order]
    assert lead and all({x.split(":")[0] for x in read.split(",")} == {c.lstrip("-") for c in order} for _, read in lead)
    assert bool(len(passes) - len(lead)) == bool(ties)


def test_a_page_takes_few_passes(spark, monkeypatch):
    """256 splitters a pass: from 200,000 rows to 2 in at most two rounds more than the logarithm asks for."""
    monkeypatch.setattr(o, "SHALLOW_ROWS", 2)
    rounds, counted = [], o._counted
    monkeypatch.setattr(o, "_counted", lambda *args: rounds.append(1) or counted(*args))
    page = o.page(spark.range(200_000).selectExpr("id * 7919 % 200000 AS n"), ["n"], 5_000, 20)
    assert [r[0] for r in rows(page.rows)] == list(range(99_980, 100_000))
    assert len(rounds) <= 5


def test_row_numbers_shuffle_once(movements):
    """After the stored cut, only one count per slice moves; the rows themselves stay where they are."""
    plan = plan_of(o.global_row_number(movements, ["product_id", "created_at"])).split("== Initial Plan ==")[0]
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    for line, below in zip(plan.splitlines(), plan.splitlines()[1:]):
        if "Exchange hashpartitioning" in line:
            assert "HashAggregate" in below and "partial_count" in plan


def test_last_page_may_be_short(spark):
    page = o.page(spark.range(45), ["-id"], 99)
    assert (page.start_index, page.end_index) == (41, 45)
    assert [r[0] for r in rows(page.rows)] == [4, 3, 2, 1, 0]
    assert set(page.described().columns) == {
        "id", "page_number", "page_count", "page_row_count", "page_start_index", "page_end_index"}


def test_global_row_number(movements, many_slices):
    numbered = o.global_row_number(movements, ["product_id", "created_at", "id"])
    expected = sorted(rows(movements), key=lambda r: (r[1], r[4], r[0]))
    got = sorted(rows(numbered), key=lambda r: r[-1])
    assert [r[:5] for r in got] == expected and [r[-1] for r in got] == list(range(1, 3001))


def test_running_stock(movements, many_slices):
    totals, expected = {}, []
    for r in sorted(rows(movements), key=lambda r: (r[1], r[4], r[0])):
        totals[r[1]] = totals.get(r[1], 0) + MOVEMENT_SIGN.get(r[2], 0) * r[3]
        expected.append((r[0], totals[r[1]]))
    got = running_stock(movements)
    assert sorted(rows(got.select("id", "running_stock"))) == sorted(expected)


@pytest.mark.parametrize("buckets", [100_000, 4])
def test_running_stock_moves_its_rows_once(movements, many_slices, monkeypatch, buckets):
    """After the slices are stored no row is shuffled: what moves are sums, one row per slice and product at most."""
    monkeypatch.setattr(o, "MOST_BUCKETS", buckets)
    found = running_stock(movements)
    plan = plan_of(found).split("== Initial Plan ==")[0]
    lines = plan.splitlines()
    assert "Bucketed: true" in plan and "Window" in plan
    for line, below in zip(lines, lines[1:]):
        assert "Exchange" not in line or "BroadcastExchange" in line or "HashAggregate" in below or "Project" in below and "_sum" in below, line
    window = next(i for i, line in enumerate(lines) if "Window" in line and "_within" in line)
    scan = next(i for i, line in enumerate(lines) if i > window and "FileScan" in line)
    below = "".join(lines[window:scan])
    assert "Sort" in below and "Exchange" not in below
    totals = {}
    for r in sorted(found.collect(), key=lambda r: (r.product_id, r.created_at, r.id)):
        totals[r.product_id] = totals.get(r.product_id, 0) + MOVEMENT_SIGN.get(r.movement_type, 0) * r.quantity
        assert r.running_stock == totals[r.product_id]


def test_every_slice_is_a_bucket(movements, many_slices):
    slices = o.bucketed_slices(movements, ["product_id", "created_at", "id"])
    pairs = rows(slices.select("_slice", "_bucket").distinct())
    assert len(pairs) == len({b for _, b in pairs}) == len({s for s, _ in pairs}) >= 8
    tasks = rows(slices.groupBy("_bucket").count())
    assert len(tasks) == len(pairs)


def test_hot_product_is_spread_over_slices(movements, many_slices):
    slices = o.range_slices(movements, ["product_id", "created_at", "id"])
    per_slice = [r[0] for r in rows(slices.groupBy("_slice").count().select("count"))]
    hot = slices.where("product_id = 7").select("_slice").distinct().count()
    assert hot >= 3 and max(per_slice) < 1000


def test_rows_with_one_and_the_same_key_are_spread_too(spark, many_slices):
    same_day = spark.range(9000).selectExpr("id", "date'2001-07-15' AS date")
    sizes = [r[1] for r in rows(o.range_slices(same_day, ["-date"]).groupBy("_slice").count())]
    assert len(sizes) > 5 and max(sizes) < 3000
    numbered = o.global_row_number(same_day, ["-date"])
    assert sorted(r[-1] for r in rows(numbered)) == list(range(1, 9001))


def test_movements_without_a_product_carry_on(spark, many_slices):
    moves = spark.range(3000).selectExpr(
        "id", "CAST(NULL AS BIGINT) AS product_id", "'in' AS movement_type", "1 AS quantity",
        "timestamp_ntz'2001-07-15 00:00:00' AS created_at")
    got = sorted(rows(running_stock(moves).select("id", "running_stock")))
    assert got == [(n, n + 1) for n in range(3000)]


def test_per_key_top_k_is_cut_before_the_shuffle(movements):
    from bizmetrics.operators.joins import latest_movements
    latest = latest_movements(movements, 3)
    assert rows(latest.groupBy("product_id").count().where("count > 3")) == []
    plan = plan_of(latest)
    assert plan.index("WindowGroupLimit") < plan.index("Exchange hashpartitioning(product_id")
    assert plan.count("WindowGroupLimit") >= 2
