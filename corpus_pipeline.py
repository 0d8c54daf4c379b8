"""The corpus pipeline: documents in, token ids out, one stored table between two stages.

Every stage takes nulls in any column, empty and long texts, repeated rows, columns it doesn't know and empty tables: decisions
are made by id and text (a null is a value of its own, a null text an empty one), so repeated rows share theirs, ties go by
id, and an empty table stays one. All stages but the last keep the columns of ``documents`` and those it has besides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bizmetrics.llm import cotraining, decontaminate, lattice, secret_scan, simhash
from bizmetrics.llm.common import row_key, table
from bizmetrics.llm.queries import PIECES, meta_columns, owner_columns
from bizmetrics.session import fresh_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return cotraining.keep_good(docs, table(spark, sf_dir, "labels"), meta_columns())


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.drop_near_duplicates(docs, shingle=3, max_bits=2)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets that look live are cut out of the texts; every document stays."""
    cut = secret_scan.redact(docs, **owner_columns())
    return secret_scan.recounted(cut)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text as sampled pieces, with whether they decode to it again."""
    return lattice.round_trip(docs.select(row_key().alias("key"), "doc_id", "text"), PIECES)


STAGES = [
    ("quality_classifier", quality),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("secret_scans", secrets),
    ("sentencepiece", pieces),
]

#: Classifiers, fingerprints and sampled segmentations are nothing SQL can express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``; each result is stored in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
