"""The raw product-sales file: untyped text cells under untrimmed headers."""

from __future__ import annotations

from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from bizmetrics.functions.numbers import parse_number
from bizmetrics.functions.text import parse_date

#: Header in the file -> column name here.
COLUMNS = {"Date": "sale_date", "Sales": "sales", "Profit": "profit",
           "Units Sold": "units_sold", "Product": "product", "Country": "country"}


#: The record as it stands in the file, if it doesn't have as many cells as the header.
RECORD = "_record"


def _parsed(raw: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """(the rows under trimmed names, each column's value: parsed, or NULL)."""
    trimmed = _once(raw.toDF(*[c.strip() for c in raw.columns]))
    kinds = {f.name: f.dataType for f in trimmed.schema.fields}
    values = {c: F.col(f"`{c}`").cast("string") for c in trimmed.columns if c != RECORD}
    values |= {c: parse_number(F.col(f"`{c}`")) if isinstance(kinds[c], T.StringType) else F.col(f"`{c}`").cast("double")
               for c in ("Sales", "Profit", "Units Sold")}
    values["Date"] = parse_date(F.col("Date")) if isinstance(kinds["Date"], T.StringType) else F.col("Date").cast("date")
    return trimmed, values


def clean_product_sales(raw: DataFrame) -> DataFrame:
    """Trim header names, turn text into dates and numbers, drop incomplete rows.

    A cell that does not parse is NULL, and a NULL in any column (also in columns beyond
    the six known ones) drops its row. So does a record of more or fewer cells than the header, where the reader
    marks it (``read_product_sales``). Columns that come as dates or numbers are not parsed.
    """
    trimmed, values = _parsed(raw)
    whole = trimmed.where(F.col(RECORD).isNull()) if RECORD in trimmed.columns else trimmed
    return _once(whole.select(*[v.alias(c) for c, v in values.items()])).na.drop("any").withColumnsRenamed(COLUMNS)


def rejected_product_sales(raw: DataFrame) -> DataFrame:
    """The rows that ``clean_product_sales`` drops: their cells as they came, and ``reasons``, a text for each
    cell that is missing or doesn't parse, and for a record with a wrong number of cells."""
    trimmed, values = _parsed(raw)
    reasons = [F.when(F.col(RECORD).isNotNull(), "wrong number of cells")] if RECORD in trimmed.columns else []
    for name, value in values.items():
        blank = F.coalesce(F.trim(F.col(f"`{name}`").cast("string")), F.lit("")) == ""
        reasons.append(F.when(value.isNull(), F.concat(F.lit(name), F.when(blank, " is missing").otherwise(" does not parse"))))
    found = _once(trimmed.withColumn("reasons", F.array_compact(F.array(*reasons))))
    return found.where(F.size("reasons") > 0).withColumnsRenamed(COLUMNS | {RECORD: "record"})


def _once(df: DataFrame) -> DataFrame:
    """The same rows, whose cells are computed once: the optimizer would put the expression of a cell wherever the
    cell is used, here in several tests and in the filter. It leaves alone what is unpacked from one value."""
    return df.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))


def _text(spark: SparkSession, paths: list[str], names: list[str], span_lines: bool) -> DataFrame:
    schema = ", ".join(f"`{n}` string" for n in [*names, RECORD])
    return spark.read.options(header=True, escape='"', columnNameOfCorruptRecord=RECORD, multiLine=span_lines).schema(schema).csv(paths)


def read_product_sales(spark: SparkSession, path: str) -> DataFrame:
    """The file(s) at ``path`` as text cells: parquet by suffix, CSV with a header and doubled quotes otherwise. Records may
    span lines. ``_record`` holds a CSV record whose cells are more or fewer than the header's.

    A file with a record that spans lines can't be split among tasks. Such a record has a line with an odd number of
    quotes; only files with one are read whole, after a scan of all lines for them.
    """
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    names = spark.read.options(header=True, escape='"', multiLine=True).csv(path).columns
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).alias("quotes"))
    files = lines.groupBy("file").agg(F.max(F.col("quotes") % 2).alias("odd")).collect()  # one row per file
    by_kind = {odd: [_local(f.file) for f in files if bool(f.odd) == odd] for odd in (False, True)}
    read = [_text(spark, paths, names, odd) for odd, paths in by_kind.items() if paths]
    return reduce(DataFrame.unionByName, read) if read else _text(spark, [path], names, False)


def _local(name: str) -> str:
    """A file's name as Spark reports it, with its escapes undone."""
    return unquote(name) if "%" in name else name


def load_product_sales(spark: SparkSession, path: str) -> DataFrame:
    """Read the file(s) at ``path`` and clean them."""
    return clean_product_sales(read_product_sales(spark, path))


def load_rejected_product_sales(spark: SparkSession, path: str) -> DataFrame:
    """What ``load_product_sales`` leaves out, with reasons."""
    return rejected_product_sales(read_product_sales(spark, path))
