import csv
import datetime as dt
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from bizmetrics import session
from bizmetrics.schemas import ENTITIES
from bizmetrics.sources import sinks
from bizmetrics.sources.entities import conform, load_entity, store_entity
from bizmetrics.operators.filters import by_key
from bizmetrics.sources.product_sales import load_product_sales, load_rejected_product_sales, read_product_sales
from conftest import plan_of, rows


def test_malformed_file(spark, tmp_path):
    path = tmp_path / "sales.csv"
    path.write_text(
        "Date , Sales,Profit, Units Sold ,Product,Country\n"
        "2001-07-15,10.5,2,3,Pen,Chile\n"
        "15 July,10,2,3,Pen,Chile\n"
        "2001-07-15,ten,2,3,Pen,Chile\n"
        "2001-07-15,10,n/a,3,Pen,Chile\n"
        "2001-07-15,10,2,,Pen,Chile\n"
        "2001-07-15,10,2,3,,Chile\n"
        '7/16/2001,1e2,-1,4,"Pen, red",Peru\n'
        '"July 17, 2001",1,1,1,"Pen ""red"", big",Chile\n')
    clean = load_product_sales(spark, str(path))
    assert clean.columns == ["sale_date", "sales", "profit", "units_sold", "product", "country"]
    assert sorted(rows(clean)) == [
        (dt.date(2001, 7, 15), 10.5, 2.0, 3.0, "Pen", "Chile"), (dt.date(2001, 7, 16), 100.0, -1.0, 4.0, "Pen, red", "Peru"),
        (dt.date(2001, 7, 17), 1.0, 1.0, 1.0, 'Pen "red", big', "Chile")]
    clean.withColumnsRenamed({"sale_date": "Date", "sales": "Sales", "profit": "Profit", "units_sold": "Units Sold",
                              "product": "Product", "country": "Country"}).write.parquet(str(tmp_path / "s.parquet"))
    assert sorted(rows(load_product_sales(spark, str(tmp_path / "s.parquet")))) == sorted(rows(clean))


def test_records_that_span_lines_and_rejected_rows(spark, tmp_path):
    """Every record is in one of the two frames, also from a folder where only some files have records that span lines."""
    head = "Date , Sales,Profit, Units Sold ,Product,Country\n"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a b%.csv").write_text(
        head + '2001-07-15,1,2,3,"Pen\nred",Chile\n2001-07-16,x,2,,"a ""b""\n\n""c",Peru\n2001-07-17,1,2,3,Pen,Chile,more\n2001-07-18,1,2\n')
    (tmp_path / "in" / "plain.csv").write_text(head + '2001-07-19,1,2,3,"a ""b"" c",Chile\nsoon, ,2,3,Pen,Peru\n')
    path = str(tmp_path / "in")
    day = lambda n: dt.date(2001, 7, n)
    assert sorted(rows(load_product_sales(spark, path))) == [(day(15), 1.0, 2.0, 3.0, "Pen\nred", "Chile"), (day(19), 1.0, 2.0, 3.0, 'a "b" c', "Chile")]
    rejected = {r.sale_date: r for r in load_rejected_product_sales(spark, path).collect()}
    assert {d: r.reasons for d, r in rejected.items()} == {
        "2001-07-16": ["Sales does not parse", "Units Sold is missing"], "2001-07-17": ["wrong number of cells"],
        "2001-07-18": ["wrong number of cells", "Units Sold is missing", "Product is missing", "Country is missing"],
        "soon": ["Date does not parse", "Sales is missing"]}
    assert rejected["2001-07-16"].product == 'a "b"\n\n"c' and rejected["2001-07-17"].record == "2001-07-17,1,2,3,Pen,Chile,more"
    (tmp_path / "none.csv").write_text(head)
    assert rows(load_product_sales(spark, str(tmp_path / "none.csv"))) == rows(load_rejected_product_sales(spark, str(tmp_path / "none.csv"))) == []


def test_only_files_with_spanning_records_are_read_whole(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Date,Sales,Profit,Units Sold,Product,Country\n2001-07-15,1,2,3,"Pen\nred",Chile\n')
    (tmp_path / "b.csv").write_text('Date,Sales,Profit,Units Sold,Product,Country\n2001-07-15,1,2,3,"Pen",Chile\n')
    leaves = read_product_sales(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert leaves.count("Relation") == 2


def test_movements_without_a_product_are_rows_too(spark):
    moves = spark.createDataFrame([(n, n % 3, "in", 1, dt.datetime(2001, 7, 15) + dt.timedelta(n)) for n in range(150)],
                                  "id bigint, product_id bigint, movement_type string, quantity int, created_at timestamp_ntz")
    products = spark.createDataFrame([(0, "Pen"), (1, "Ink")], "id bigint, name string")
    got = rows(sinks.movement_rows(moves, products))
    assert [r[0] for r in got] == list(range(149, 49, -1))
    assert [r[1] for r in got] == [["Pen", "Ink", None][r[0] % 3] for r in got]


def scanned(df):
    """Rows that came out of the scans of stored files."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_keys_skip_row_groups(spark, tmp_path):
    """Ids in no order of time: Bloom filters leave the row groups that hold the key."""
    moves = spark.range(40_000).selectExpr("(id * 7919) % 40000 * 2 AS id", "id % 50 AS product_id", "'in' AS movement_type", "1 AS quantity",
                                           "timestamp_ntz'2001-01-01' + make_interval(0, 0, 0, 0, 0, cast(id as int)) AS created_at")
    store_entity(moves, str(tmp_path), "inventory_movement", **{"parquet.block.size": 65536, "parquet.page.size": 8192, "parquet.block.row.count.limit": 2000})
    stored = load_entity(spark, str(tmp_path), "inventory_movement")
    one = by_key(stored, 7919 * 2)
    assert one.count() == 1 and scanned(by_key(stored, 7919 * 2)) <= 8_000
    assert scanned(by_key(stored, 7919)) <= 8_000 and by_key(stored, 7919).count() == 0
    assert scanned(stored) == 40_000


def test_files_follow_the_size_and_not_the_session(spark, tables, tmp_path, monkeypatch, conf):
    conf("spark.sql.shuffle.partitions", "50")
    store_entity(tables.product, str(tmp_path), "product")
    assert len(spark.read.parquet(f"{tmp_path}/product.parquet").inputFiles()) == 1
    monkeypatch.setattr(session, "PARTITION_BYTES", 1 << 11)
    store_entity(tables.product, str(tmp_path), "product")
    assert len(spark.read.parquet(f"{tmp_path}/product.parquet").inputFiles()) >= 3


def test_sorted_rows_of_a_task_are_bounded(spark, tmp_path, monkeypatch):
    """Tasks are dealt what their sort holds, not what the files hold."""
    moves = spark.range(20_000).selectExpr("id", "id % 50 AS product_id", "'in' AS movement_type", "1 AS quantity",
                                           "timestamp_ntz'2001-01-01' + make_interval(0, 0, 0, CAST(id % 700 AS INT)) AS created_at")
    monkeypatch.setattr(session, "PARTITION_BYTES", session.planned_bytes(moves))
    store_entity(moves, str(tmp_path), "inventory_movement")
    stored = spark.read.parquet(f"{tmp_path}/inventory_movement.parquet")
    parts = {p.split("/")[-1].split("-")[1] for p in stored.inputFiles()}
    assert len(parts) >= 6 and stored.count() == moves.count()


@pytest.mark.parametrize("name", ENTITIES)
def test_entities_round_trip(spark, tables, tmp_path, name):
    store_entity(tables.view(name), str(tmp_path), name)
    loaded = load_entity(spark, str(tmp_path), name)
    assert loaded.schema == ENTITIES[name].schema
    stored = conform(tables.view(name), name)
    assert loaded.exceptAll(stored).count() == 0 and loaded.count() == stored.count()


@pytest.mark.parametrize("name", [n for n, e in ENTITIES.items() if e.time])
def test_ranges_bound_every_entity_with_a_time(spark, tables, tmp_path, name):
    time = ENTITIES[name].time
    frame = conform(tables.view(name), name).withColumn(time, F.coalesce(time, F.lit(dt.datetime(2000, 1, 1, 9)).cast(ENTITIES[name].schema[time].dataType)))
    store_entity(frame, str(tmp_path), name)
    some = load_entity(spark, str(tmp_path), name, "1999-11-15", "2000-02-15")
    assert some.count() == frame.where(f"date({time}) BETWEEN '1999-11-15' AND '2000-02-15'").count()


def test_an_entity_without_time_has_no_range(spark, tables, tmp_path):
    store_entity(tables.invoice_item, str(tmp_path), "invoice_item")
    with pytest.raises(ValueError):
        load_entity(spark, str(tmp_path), "invoice_item", since="2000-01-01")


def test_newest_movements_are_cut_before_the_lookup(tables):
    plan = plan_of(sinks.movement_rows(tables.inventory_movement, tables.product)).split("== Initial Plan ==")[0]
    assert plan.index("Join") < plan.index("TakeOrderedAndProject")  # the cut is below the join


def test_roll_up_reads_no_customer(tables):
    from bizmetrics.operators.sales import rollup_monthly
    assert "customer" not in plan_of(rollup_monthly(tables.sales_transaction))


def test_years_are_folders(spark, tables, tmp_path):
    path = store_entity(tables.expense, str(tmp_path), "expense")
    assert "year=2000" in {p.split("/")[-2] for p in spark.read.parquet(path).inputFiles()}


def test_range_chooses_folders(spark, tables, tmp_path):
    store_entity(tables.inventory_movement, str(tmp_path), "inventory_movement")
    some = load_entity(spark, str(tmp_path), "inventory_movement", "1999-11-15", "2000-02-15")
    plan = some._jdf.queryExecution().executedPlan().toString()
    partitions = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "1999" in partitions and "2000" in partitions
    expected = tables.inventory_movement.where("created_at >= '1999-11-15' AND created_at < '2000-02-16'")
    assert 0 < some.count() == expected.count()
    store_entity(tables.product, str(tmp_path), "product")
    assert load_entity(spark, str(tmp_path), "product").count() == tables.product.count()


def test_csv_exports_are_sorted_and_quoted(spark, tables, tmp_path):
    sinks.export_sales_csv(tables.monthly_sales, str(tmp_path / "sales"))
    back = spark.read.option("header", True).schema("month date, revenue decimal(25,2), transaction_count int").csv(
        str(tmp_path / "sales"))
    assert rows(back.orderBy("month")) == rows(tables.monthly_sales.orderBy("month"))
    sinks.export_report_csv(tables.monthly_sales, str(tmp_path / "report"))
    text = [r[0] for r in rows(spark.read.text(str(tmp_path / "report")).coalesce(1))]
    assert text[0] == "month,revenue,transaction_count" and text[1].startswith("2001-")
    sinks.export_inventory_csv(tables.product, str(tmp_path / "stock"))
    assert spark.read.option("header", True).csv(str(tmp_path / "stock")).count() == tables.product.where("is_active").count()
    odd = tables.expense.limit(1).withColumns({"title": F.lit('a,"b"')})
    sinks.export_expenses_csv(odd, tables.expense_category, str(tmp_path / "expenses"))
    (part,) = (tmp_path / "expenses").glob("part-*.csv")
    with open(part, newline="") as file:
        assert next(csv.DictReader(file))["title"] == 'a,"b"'
    shape = sinks.expenses_export_frame(odd, tables.expense_category).schema
    assert rows(sinks.read_csv(spark, str(tmp_path / "expenses"), shape)) == rows(sinks.expenses_export_frame(odd, tables.expense_category))
    sinks.export_expenses_csv(tables.expense.limit(0), tables.expense_category, str(tmp_path / "none"))
    assert spark.read.option("header", True).csv(str(tmp_path / "none")).count() == 0


def test_json_rows(spark, tables, tmp_path):
    sinks.write_json(sinks.expense_rows(tables.expense, tables.expense_category), str(tmp_path / "expenses"))
    lines = [json.loads(r[0]) for r in rows(spark.read.text(str(tmp_path / "expenses")))]
    assert len(lines) == tables.expense.count()
    assert set(lines[0]) == {"id", "title", "amount", "date", "category", "status"}
    assert any(line["category"] is None for line in lines) and isinstance(lines[0]["amount"], float)
    newest = sinks.movement_rows(tables.inventory_movement, tables.product, 5)
    assert newest.count() == 5 and len(newest.first().created_at) == len("2001-07-15 08:00")
    assert sinks.sales_rows(tables.monthly_sales).dtypes == [
        ("month", "string"), ("revenue", "double"), ("transaction_count", "int")]
    assert len(sinks.product_rows(tables.product).columns) == 7


def test_decimals_are_exact(spark):
    df = spark.createDataFrame([(dt.date(2001, 7, 1), Decimal("0.10"), 1)] * 3, "month date, revenue decimal(25,2), transaction_count int")
    from bizmetrics.operators.sales import sales_totals
    assert sales_totals(df).first().total_revenue == Decimal("0.30")


def test_shared_folder_comes_from_the_session(spark):
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert session.shared_dir(spark) == configured
    assert session.fresh_dir(spark, "x") != session.fresh_dir(spark, "x")
    assert session.cut_lineage(spark.range(3)).count() == 3
