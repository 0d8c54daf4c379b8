"""The registered queries and the pipeline's stages, each on its own input."""

import duckdb
import pytest

import corpus_pipeline
from bizmetrics.llm import queries, simhash
from bizmetrics.session import fresh_dir
from conftest import DATA
from verify import compare


@pytest.mark.parametrize("name", list(queries.SQL))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    assert compare(spark, con, name, queries.QUERIES[name], queries.SQL[name], DATA) is None


def test_registered(spark):
    import __spark_entry__ as entry
    names = [n for n in entry.queries() if n.startswith("op")]
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11)) and "pipeline" in entry.queries()


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = fresh_dir(spark, f"test-{i}")
        stage(spark, docs, DATA).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        sizes.append(docs.count())
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
            assert docs.join(before, "doc_id", "left_anti").count() == 0
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] == sizes[4] == sizes[5]
    assert docs.where("not lossless").count() == 0


def test_stages_of_hard_rows(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "word " * 40_000, "en", "s", None), (3, "a b c d e", "en", "s", 9), (3, "a b c d e", "en", "s", 9)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, row_key int")
    for empty in (False, True):
        now = docs.limit(0) if empty else docs
        for _, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, DATA)
        assert now.count() == 0 if empty else now.count() <= 4
