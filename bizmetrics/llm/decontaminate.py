"""Benchmark decontamination: short test items that stand inside long documents.

An item is found in a document if the document holds at least ``threshold`` of the item's
different word shingles. MinHash signatures of whole documents can't show that (a long document
shares next to nothing of its shingles with a short item), so only the items are sketched:

* Items are partitioned by their number of shingles, in powers of two. An item is sketched by
  its shingles of smallest hash, as many as the largest item of its partition could lack and
  still be found, plus one. A document that holds enough of the item holds one of these, so
  the search over the documents' shingle hashes misses nothing.
* Texts that hold one are verified with the shingles themselves, not with their hashes: their different shingles meet
  the items' and are counted, so a text with many items is as much work as one with few.

Everything is DataFrame expressions. The documents' shingles never leave the task that makes
them unless they hit a sketch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from bizmetrics.llm.common import keep_keys, narrow, row_key, sized

SHINGLE = 5


def words_of(text: Column) -> Column:
    """Runs of letters and digits, lower-cased; a null text has none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _shingles(words: Column, k: Column | int) -> Column:
    k = F.lit(k) if isinstance(k, int) else k
    last = F.size(words) - k + 1
    return F.when(last > 0, F.array_distinct(F.transform(
        F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(words, i, k), " ")))).otherwise(
        F.array().cast("array<string>"))


def _hash(hashes: list[Column]) -> Column:
    return F.xxhash64(*hashes)


def _text_hash(shingle: Column, k: int) -> Column:
    """The hash of a shingle of ``k`` words, from its words' hashes, as for the documents."""
    parts = F.split(shingle, " ")
    return _hash([F.xxhash64(parts[i]) for i in range(k)])


def _needed(n: Column, threshold: float) -> Column:
    """Shingles of ``n`` that must be found."""
    return F.ceil(F.round(n * F.lit(threshold), 6)).cast("int")


def _items(benchmark: DataFrame, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """One row per item that has a word: its shingle length, shingles, and how many must be found.
    Items are numbered by content, so that items with null or repeated ids stay apart."""
    work = benchmark.select(F.col(f"`{id_col}`").alias("item_id"), F.col(f"`{text_col}`").alias("text"),
                            row_key(id_col, text_col).alias("item")).dropDuplicates(["item"])
    words = work.select("item", "item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    cut = words.withColumn("k", F.least(F.lit(SHINGLE), F.size("words")))
    return (cut.select("item", "item_id", "k", _shingles(F.col("words"), F.col("k")).alias("shingles"))
            .withColumn("n", F.size("shingles")).withColumn("needed", _needed(F.col("n"), threshold)))


def _sketches(items: DataFrame, lengths: list[int], threshold: float) -> DataFrame:
    """(k, hash, item): the shingles of each item to look for."""
    size_class = F.floor(F.log2("n"))
    largest = F.pow(F.lit(2), size_class + 1) - 1
    lacking = (largest - _needed(largest, threshold)).cast("int")
    rows = items.select("item", "k", (lacking + 1).alias("length"), F.explode("shingles").alias("shingle"))
    by_length = F.coalesce(*[F.when(F.col("k") == k, _text_hash(F.col("shingle"), k)) for k in lengths])
    hashed = rows.select("item", "k", "length", by_length.alias("hash"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy("hash"))
    return hashed.withColumn("rank", rank).where(F.col("rank") <= F.col("length")).select("k", "hash", "item")


def _doc_hashes(docs: DataFrame, k: int) -> DataFrame:
    """(key, hash) of every place of every document where a shingle of ``k`` words stands."""
    hashes = docs.select("key", F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("h"))
    ahead = F.arrays_zip(*[F.slice("h", F.lit(i + 1), F.greatest(F.size("h") - i, F.lit(0))).alias(f"h{i}") for i in range(k)])
    places = hashes.select("key", F.inline(ahead).alias(*[f"h{i}" for i in range(k)]))
    return places.where(F.col(f"h{k - 1}").isNotNull()).select("key", _hash([F.col(f"h{i}") for i in range(k)]).alias("hash"))


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, id_col: str = "doc_id",
                 text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Pairs of a document and a test item it holds: ``key`` (see ``row_key``), ``doc_id``, ``item_id``,
    ``n_shingles`` of the item, ``n_found`` of them in the document, and ``containment``, their ratio.

    Shingles are ``SHINGLE`` words; an item of fewer words is one shingle. Ties and the order of
    words don't matter beyond the shingles. Items without a word (null, empty, punctuation) are in no
    document. Documents that are null or shorter than the shingle hold nothing. Repeated rows of
    documents or items count once. Empty tables give no rows.
    """
    items = sized(_items(benchmark, threshold, item_id_col, item_text_col), F.size("shingles") * F.lit(4))
    lengths = sorted(r[0] for r in items.select("k").distinct().collect())  # five numbers at most
    work = narrow(docs, id_col, text_col).withColumn("key", row_key())
    if not lengths:
        return work.select("key", "doc_id", F.lit(None).cast(benchmark.schema[item_id_col].dataType).alias("item_id"),
                           F.lit(0).alias("n_shingles"), F.lit(0).alias("n_found"), F.lit(0.0).alias("containment")).where("false")
    sketches = sized(_sketches(items, lengths, threshold))
    hits = None
    for k in lengths:
        found = _doc_hashes(work, k).join(sketches.where(F.col("k") == k), "hash").select("key", "item")
        hits = found if hits is None else hits.unionByName(found)
    # Texts that hold a sketched shingle, each once; a text's shingles are made once, whatever items it may hold.
    held = work.join(sized(hits.select("key").distinct()), "key").dropDuplicates(["key"]).select("key", "doc_id", words_of(F.col("text")).alias("words"))
    wanted = sized(items.select("item", "k", "item_id", F.col("n").alias("n_shingles"), "needed", F.explode("shingles").alias("shingle")), F.lit(6))
    places = None
    for k in lengths:
        own = held.select("key", "doc_id", F.explode(_shingles(F.col("words"), k)).alias("shingle"))
        both = own.join(wanted.where(F.col("k") == k), "shingle")
        places = both if places is None else places.unionByName(both)
    # Shingles are different ones on both sides: a row for each that is found.
    found = places.groupBy("key", "doc_id", "item", "item_id", "n_shingles", "needed").agg(F.count(F.lit(1)).cast("int").alias("n_found"))
    return (found.where(F.col("n_found") >= F.col("needed"))
            .select("key", "doc_id", "item_id", "n_shingles", "n_found", (F.col("n_found") / F.col("n_shingles")).alias("containment")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, id_col: str = "doc_id",
                      text_col: str = "text", **item_cols: str) -> DataFrame:
    """``docs`` without the rows that hold a test item; all columns are kept. Null and empty texts hold none and stay; rows with
    the same id and text go or stay together; ties and empty tables are as in ``contaminated``."""
    found = contaminated(docs, benchmark, threshold, id_col, text_col, **item_cols).select("key").distinct()
    return keep_keys(docs, sized(found), id_col, text_col, drop=True)
