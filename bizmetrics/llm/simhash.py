"""Near-duplicates by SimHash: documents whose 64-bit fingerprints differ in few bits.

Pigeonhole blocks: the fingerprint is cut into ``BLOCKS`` blocks. Two fingerprints that differ
in at most ``max_bits`` bits differ in at most ``max_bits`` blocks, so for some choice of
``BLOCKS - max_bits`` blocks they agree on all of them. Fingerprints are joined on every such
choice, and the Hamming distance is verified inside each bucket.

Equal fingerprints are folded first, so copies cost nothing. A bucket holds different
fingerprints that agree on all but its free bits, at most 22 of 64 by default: 2**22 rows of
8 bytes, whatever the corpus holds, is the most one bucket can ask of a task. A bucket returns
a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from bizmetrics.llm.common import narrow, row_key, ship, spare
from bizmetrics.llm.components import connected_components
from bizmetrics.session import cut_lineage

BLOCKS, SEED = 6, 42
#: Shingles whose bits are counted at once.
PIECE = 1 << 15
#: Up to so many fingerprints, a bucket compares each with each; beyond, it looks up every
#: fingerprint that is near enough. Both find the same links.
SMALL_BUCKET = 256


def simhash(text: bytes | None, shingle: int = 3) -> int:
    """The fingerprint of one text (UTF-8), as a signed 64-bit number; without words it is 0."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes)
    n = max(1, len(words) - shingle + 1)
    starts, stops = (ends - sizes)[:n], ends[min(shingle, len(words)) - 1:] - 1
    ones = np.zeros(64, np.int64)
    for at in range(0, n, PIECE):
        spans = map(slice, starts[at:at + PIECE].tolist(), stops[at:at + PIECE].tolist())
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, spans), repeat(SEED)), "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view("<i8")[0])


def simhash_of(text: Column, shingle: int = 3) -> Column:
    @F.arrow_udf("bigint")
    def prints(texts: pa.Array) -> pa.Array:
        return pa.array((simhash(t.as_py(), shingle) for t in texts), pa.int64())

    return prints(text.cast("binary"))


def _masks(max_bits: int) -> list[int]:
    """For each choice of blocks, the bits on which a bucket agrees."""
    edges = [64 * i // BLOCKS for i in range(BLOCKS + 1)]
    block = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in combinations(block, BLOCKS - max_bits)]


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def _forest(prints: np.ndarray, flips: np.ndarray, max_bits: int) -> np.ndarray:
    """For sorted different fingerprints, the index of the first one reachable from each."""
    n = len(prints)
    root = np.arange(n)

    def links() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if n <= SMALL_BUCKET:
            yield np.nonzero(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= max_bits)
        else:
            yield from (_flipped(prints, flip) for flip in flips)

    changed = True
    while changed:
        changed = False
        for i, j in links():
            low, high = np.minimum(root[i], root[j]), np.maximum(root[i], root[j])
            if (low != high).any():
                changed = True
                np.minimum.at(root, high, low)
                while (root[root] != root).any():
                    root = root[root]
    return root


def _flipped(prints: np.ndarray, flip: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    other = prints ^ flip
    at = np.minimum(np.searchsorted(prints, other), len(prints) - 1)
    i = np.nonzero((prints[at] == other) & (np.arange(len(prints)) < at))[0]
    return i, at[i]


def _link(masks: list[int], max_bits: int):
    def flips_of(mask: int) -> np.ndarray:
        free = [1 << b for b in range(64) if not mask >> b & 1]
        return np.array([sum(c) for k in range(1, max_bits + 1) for c in combinations(free, k)], np.uint64)

    def bucket(part: pd.DataFrame) -> pd.DataFrame | None:
        prints = np.sort(part["fp"].to_numpy().view(np.uint64))
        choice = int(part["choice"].iloc[0])
        root = _forest(prints, flips_of(masks[choice]) if len(prints) > SMALL_BUCKET else np.empty(0, np.uint64), max_bits)
        child = np.nonzero(root != np.arange(len(prints)))[0]
        if len(child):
            return pd.DataFrame({"a": prints[child].view(np.int64), "b": prints[root[child]].view(np.int64)})
        return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by bucket; the last bucket of a batch may go on in the next."""
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            new = (batch[["choice", "block"]].diff().fillna(1) != 0).any(axis=1).to_numpy()
            if held:
                last = held[-1].iloc[-1]
                new[0] = (last["choice"], last["block"]) != (batch["choice"].iloc[0], batch["block"].iloc[0])
            else:
                new[0] = True
            starts = np.append(np.nonzero(new)[0], len(batch))
            if starts[0]:
                held.append(batch.iloc[:starts[0]])
            for lo, hi in zip(starts[:-1], starts[1:]):
                if held and (found := bucket(pd.concat(held))) is not None:
                    yield found
                held = [batch.iloc[lo:hi]]
        if held and (found := bucket(pd.concat(held))) is not None:
            yield found

    return run


def fingerprint_components(prints: DataFrame, max_bits: int = 2) -> DataFrame:
    """``prints`` has different fingerprints ``fp``; returns ``node`` and ``root`` of those with a link."""
    masks = _masks(max_bits)
    blocks = F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("bigint")).alias("block"))
                       for i, m in enumerate(masks)])
    in_bucket = Window.partitionBy("choice", "block")
    buckets = (prints.select("fp", F.explode(blocks).alias("b")).select("fp", "b.choice", "b.block")
               .withColumn("n", F.count("*").over(in_bucket)).where("n > 1")
               .sortWithinPartitions("choice", "block", "fp").select("choice", "block", "fp"))
    return connected_components(buckets.mapInPandas(_link(masks, max_bits), "a bigint, b bigint"))


def _with_roots(docs: DataFrame, shingle: int, max_bits: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Stored rows (key, doc_id, fp), and for each fingerprint its component's root."""
    ship(docs.sparkSession)
    work = narrow(docs, id_col, text_col)
    rows = cut_lineage(work.select(row_key().alias("key"), "doc_id", simhash_of(F.col("text"), shingle).alias("fp")))
    prints = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    linked = fingerprint_components(prints.select("fp"), max_bits).withColumnRenamed("node", "fp")
    roots = prints.join(linked, "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    return rows, roots


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id``, the
    smallest id reachable over links between fingerprints that differ in ``max_bits`` bits or fewer.

    Shingles are runs of ``shingle`` words, repeats included, of the text with A-Z lower-cased; a shorter
    text is one shingle. A null, empty or blank text has fingerprint 0 and is linked like any other. A null
    id links its row too but never names a component, unless all ids of the component are null; then
    the component is null. Repeated rows each get their row. No documents give no rows.
    """
    rows, roots = _with_roots(docs, shingle, max_bits, id_col, text_col)
    named = roots.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_print = roots.join(named, "root").select("fp", "component_id")
    return rows.join(by_print, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2, id_col: str = "doc_id",
                         text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that with the smallest id, nulls last, then the smallest
    digest of id and text. Of fully repeated rows one stays. All columns are kept."""
    rows, roots = _with_roots(docs, shingle, max_bits, id_col, text_col)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key"))
    by_print = rows.groupBy("fp").agg(first.alias("first"))
    kept = by_print.join(roots.select("fp", "root"), "fp").groupBy("root").agg(F.min("first").alias("first"))
    name = spare(docs, "row_key")
    keyed = docs.withColumn(name, row_key(id_col, text_col))
    return keyed.join(kept.select(F.col("first.key").alias(name)), name, "left_semi").dropDuplicates([name]).drop(name)
