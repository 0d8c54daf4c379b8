"""Phrase collocations by sorting suffix pointers.

Every place of a word is a suffix, a pointer to at most ``MOST_WORDS`` words. Suffixes are sorted by a multikey
three-way quicksort: at each depth a pivot word splits a partition in those before it, equal to it and behind it; the equal
part goes on at the next word. The size of an equal part at depth k is how often its phrase of k words occurs.
The quicksort splits all open partitions of a batch at once, in flat arrays.

Counts have to be global, so the work goes in three steps:

1. Words are counted. Then the pairs of frequent words are counted by a hash as wide as the number of words asks for: the
   suffixes are routed by their leading words, and those whose leading pair is too rare are abandoned. Pairs of one hash only
   raise its count. A bit table of bounded size tells the tasks which are left; what else it lets through changes nothing.
2. Each batch sorts the suffixes that are left, cut where a rare pair begins, and folds equal ones to one row with a number.
3. The folded suffixes are range-partitioned by their words, so suffixes with the same leading words stand together, and a
   hot beginning spreads over as many tasks as it fills. Each task sorts its range by the same quicksort. An equal part
   inside the range is complete: if it is too small it is abandoned, with all that is below it. Parts at the two ends of a range
   may go on in the next one; they are kept, at most two for each depth, and summed across ranges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from bizmetrics.llm.common import ship
from bizmetrics.session import cut_lineage, store_once

MOST_WORDS = 5
#: A folded suffix takes a task's memory while its range is sorted; so many to a range.
RANGE_ROWS = 500_000
#: Bits of the tables of frequent words and pairs: at least so many for each, and at most 32 MB.
BITS_PER_KEY, MOST_BITS = 16, 1 << 28
SLAB_BITS = 1 << 18
#: Words to a number of the pairs' hash, on average: far fewer than occurrences that matter.
WORDS_PER_HASH = 8
#: Text that is sorted at once.
SORTED_BYTES = 8 << 20
#: What separates pieces (fixed values), and words.
BREAKS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_FOLDED = bytearray(range(256))
for _c in range(0x41, 0x5B):
    _FOLDED[_c] = _c + 32
for _c in BREAKS:
    _FOLDED[_c] = 0x0A
_FOLDED[0x09] = 0x20
_FOLDED = bytes(_FOLDED)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of some texts as numbers: ``ids`` in their order, -1 between pieces and texts, and each number's word."""

    def __init__(self, texts: list[bytes]):
        joined = b"\n".join(texts).translate(_FOLDED).replace(b"\n", b" \n ")
        tokens = pc.split_pattern(pa.array([joined], pa.large_binary()), b" ").flatten()
        tokens = tokens.filter(pc.greater(pc.binary_length(tokens), 0)).dictionary_encode()
        words = tokens.dictionary
        ids = tokens.indices.to_numpy().astype(np.int64)
        at = words.index(pa.scalar(b"\n", pa.large_binary())).as_py()
        if at >= 0:
            ids = np.where(ids == at, -1, ids - (ids > at))
            words = pa.concat_arrays([words.slice(0, at), words.slice(at + 1)])
        self.ids, self.words = ids, words.cast(pa.binary())

    def hashes(self, salt: int) -> np.ndarray:
        """A hash of each word, which ``salt`` tells apart by language."""
        return np.fromiter((xxhash.xxh3_64_intdigest(w, salt) for w in self.words.to_pylist()), np.uint64, len(self.words))


def pair_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return _mixed(left * np.uint64(0x9E3779B97F4A7C15) + right)


class Table:
    """Which hashes are frequent: one bit each in a table of bounded size, which never forgets one."""

    def __init__(self, bits: int, slabs: dict[int, bytes]):
        self.bits = bits
        self.data = np.zeros(bits // 8, np.uint8)
        for slab, held in slabs.items():
            self.data[slab * (SLAB_BITS // 8):][:SLAB_BITS // 8] = np.frombuffer(held, np.uint8)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        bit = hashes % np.uint64(self.bits)
        return (self.data[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _table(hashes: DataFrame) -> Table:
    """The table over ``hashes`` (h), made slab by slab in tasks; at most ``MOST_BITS`` reach the driver."""
    n = hashes.count()
    bits = min(MOST_BITS, max(SLAB_BITS, 1 << (n * BITS_PER_KEY).bit_length()))

    def filled(key: tuple, group: pa.Table) -> pa.Table:
        held = np.zeros(SLAB_BITS, np.uint8)
        held[group["bit"].to_numpy()] = 1
        return pa.table({"slab": pa.array([key[0].as_py()], pa.int64()), "held": [np.packbits(held, bitorder="little").tobytes()]})

    bit = F.col("h").bitwiseAND(F.lit(bits - 1))  # bits is a power of two
    placed = hashes.select(F.shiftright(bit, SLAB_BITS.bit_length() - 1).alias("slab"), bit.bitwiseAND(F.lit(SLAB_BITS - 1)).alias("bit")).distinct()
    return Table(bits, dict(placed.groupBy("slab").applyInArrow(filled, "slab bigint, held binary").collect() if n else ()))


def _runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[str, list[bytes]]]:
    """(language, some of its texts): texts of a language are gathered up to a size."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held.setdefault(lang, []).append(text)
            size += len(text)
            if size >= most:
                yield from held.items()
                held, size = {}, 0
    yield from held.items()


def _salt(lang: str) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode())


def _word_counts(work: DataFrame) -> DataFrame:
    """(lang, word, h, n), counted in batches before they move."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in _runs(batches, SORTED_BYTES):
            found = Words(texts)
            counts = np.bincount(found.ids[found.ids >= 0], minlength=len(found.words))
            for i in range(0, len(counts), 100_000):
                words = found.words.slice(i, 100_000)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), words.cast(pa.string()),
                                                  pa.array(counts[i:i + 100_000], pa.int64())], names=["lang", "word", "n"])

    return work.mapInArrow(run, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _hashed(words: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.fromiter((xxhash.xxh3_64_intdigest(w.encode(), _salt(lang)) for lang, w in zip(*(c.to_pylist() for c in batch.columns))),
                            np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64))], names=["h"])

    return words.select("lang", "word").mapInArrow(run, "h bigint")


def _pairs(found: Words, lang: str, words: Table) -> tuple[np.ndarray, np.ndarray]:
    """For each place but the last, whether a pair of frequent words begins there, and its hash."""
    h = found.hashes(_salt(lang))
    frequent = np.r_[words.holds(h), False] if len(h) else np.zeros(1, bool)  # -1, a break, is none
    good = frequent[found.ids]
    ok = good[:-1] & good[1:]
    h = np.r_[h, np.uint64(0)]
    return ok, pair_hashes(h[found.ids[:-1]], h[found.ids[1:]])


def _pair_counts(work: DataFrame, words, bits: int) -> DataFrame:
    """(h, n): how often the pairs of frequent words occur, by ``bits`` of their hash. Equal hashes only raise a count."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in _runs(batches, SORTED_BYTES):
            found = Words(texts)
            if len(found.ids) < 2:
                continue
            ok, h = _pairs(found, lang, words.value)
            keys, counts = np.unique(h[ok] & np.uint64((1 << bits) - 1), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(counts, pa.int64())], names=["h", "n"])

    return work.mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))


def multikey_quicksort(words: np.ndarray, lengths: np.ndarray, weights: np.ndarray, least: int = 0,
                       ends: tuple[int, int] = (-1, -1)) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Sort suffixes by three-way partitioning, depth by depth, all open partitions at once.

    ``words`` is (suffixes x depth) of word numbers, ``lengths`` how many words a suffix has, ``weights`` how often it
    occurs. For each depth yields (depth, a suffix of each equal part, the parts' weights): the parts are the different
    phrases of that many words. Parts of a weight under ``least`` are abandoned, with all that is below them, unless they hold
    one of the suffixes ``ends``: those may go on elsewhere.
    """
    order = np.nonzero(lengths >= 1)[0]
    part = np.zeros(len(order), np.int64)  # which open partition, at this depth
    for depth in range(words.shape[1]):
        if not len(order):
            return
        place, keys, number, finished, parts, made = order, words[order, depth], part, [], [], 0
        while len(place):
            # Partitions stand together. The pivot of each is the median of its first, middle and last key.
            starts = np.nonzero(np.r_[True, number[1:] != number[:-1]])[0]
            sizes = np.diff(np.r_[starts, len(number)])
            first, middle, last = keys[starts], keys[starts + sizes // 2], keys[starts + sizes - 1]
            own = np.repeat(np.arange(len(starts)), sizes)
            pivot = np.maximum(np.minimum(first, middle), np.minimum(np.maximum(first, middle), last))[own]
            equal, behind = keys == pivot, keys > pivot
            # Equal parts are finished at this depth.
            finished.append(place[equal])
            parts.append(own[equal] + made)
            made += len(starts)
            rest = ~equal
            place, keys, own, behind = place[rest], keys[rest], own[rest], behind[rest]
            if len(place):
                again = _divided(own, behind)
                place, keys, number = place[again], keys[again], (own * 2 + behind)[again]
        order, part = np.concatenate(finished), np.concatenate(parts)
        starts = np.nonzero(np.r_[True, part[1:] != part[:-1]])[0]
        sizes = np.diff(np.r_[starts, len(order)])
        total = np.add.reduceat(weights[order], starts)
        keep = (total >= least) | np.logical_or.reduceat((order == ends[0]) | (order == ends[1]), starts)
        yield depth + 1, order[starts[keep]], total[keep]
        stays = np.repeat(keep, sizes) & (lengths[order] > depth + 1)
        order, part = order[stays], part[stays]


def _divided(own: np.ndarray, behind: np.ndarray) -> np.ndarray:
    """The order that puts, in each partition, what stands before the pivot in front of what stands behind it."""
    starts = np.nonzero(np.r_[True, own[1:] != own[:-1]])[0]
    sizes = np.diff(np.r_[starts, len(own)])
    low = np.cumsum(~behind)
    before = np.repeat(low[starts] - ~behind[starts], sizes)  # low ones in earlier partitions
    lows = np.repeat(np.add.reduceat((~behind).astype(np.int64), starts), sizes)
    begin = np.repeat(starts, sizes)
    rank = low - before
    to = np.where(behind, begin + lows + (np.arange(len(own)) - begin - rank), begin + rank - 1)
    again = np.empty_like(to)
    again[to] = np.arange(len(to))
    return again


def _windows(ids: np.ndarray, ok: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(words, lengths) of the suffixes of two words or more, each cut before a pair that isn't ``ok``; -1 behind their end."""
    ahead = np.r_[ok, False]
    at = np.nonzero(ahead)[0]
    words = np.full((len(at), most), -1, np.int64)
    words[:, 0] = ids[at]
    lengths, goes_on = np.ones(len(at), np.int64), np.ones(len(at), bool)
    for k in range(1, most):
        goes_on &= ahead[np.minimum(at + k - 1, len(ids) - 1)]
        words[goes_on, k] = ids[at[goes_on] + k]
        lengths += goes_on
    return words, lengths


def _folded(work: DataFrame, words, pairs, bits: int, most: int) -> DataFrame:
    """(lang, suffix, salt, n): the suffixes that are left, equal ones of a batch in one row; ``salt`` is the batch. A space
    ends each of a suffix's words, so all that begin with some words stand together in the order of their bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for nth, (lang, texts) in enumerate(_runs(batches, SORTED_BYTES)):
            found = Words(texts)
            if len(found.ids) < 2:
                continue
            ok, h = _pairs(found, lang, words.value)
            ok[ok] = pairs.value.holds(h[ok] & np.uint64((1 << bits) - 1))
            suffixes, lengths = _windows(found.ids, ok, most)
            # To the greatest depth with the empty places behind short suffixes: the last equal parts are equal suffixes.
            ended = pc.binary_join_element_wise(found.words.cast(pa.string()), "", " ")
            last = [x for x in multikey_quicksort(suffixes, np.full(len(lengths), most), np.ones(len(lengths), np.int64)) if x[0] == most]
            for _, first, total in last:
                for i in range(0, len(first), 100_000):
                    some = first[i:i + 100_000]
                    flat = suffixes[some]
                    offsets = np.r_[0, np.cumsum(lengths[some])].astype(np.int32)
                    listed = pa.ListArray.from_arrays(pa.array(offsets), ended.take(pa.array(flat[flat >= 0])))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(some), pa.string()), pc.binary_join(listed, ""), pa.array(np.full(len(some), task << 24 | nth)),
                         pa.array(total[i:i + 100_000], pa.int64())], names=["lang", "suffix", "salt", "n"])

    return work.mapInArrow(run, "lang string, suffix string, salt bigint, n bigint")


def _ranged(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, n) of the phrases in one range of sorted suffixes: complete ones of ``least`` occurrences or more,
    and whatever may go on in the ranges around."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    rows = pa.Table.from_batches(held).combine_chunks()
    langs, suffixes = rows["lang"].chunk(0), rows["suffix"].chunk(0).cast(pa.binary())
    lists = pc.split_pattern(suffixes, b" ")  # the last of each is empty
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64) - 1
    names = pa.concat_arrays([langs.cast(pa.binary()), lists.flatten()]).dictionary_encode()
    numbered = names.indices.to_numpy().astype(np.int64)
    count, most = len(sizes), sizes.max()
    words = np.full((count, most + 2), -1, np.int64)
    words[:, 0] = numbered[:count]
    words[:, 1:][np.arange(most + 1) <= sizes[:, None]] = numbered[count:]
    words = words[:, :-1]
    words[:, 1:][np.arange(most) >= sizes[:, None]] = -1
    for depth, first, total in multikey_quicksort(words, sizes + 1, rows["n"].to_numpy(), least, _ends(langs, suffixes)):
        if depth > 2 and len(first):  # the language and two words or more
            at = pa.array(first)
            # The first words of a suffix of each part.
            flat = names.dictionary.take(pa.array(words[first, 1:depth].ravel())).cast(pa.string())
            phrase = pa.ListArray.from_arrays(pa.array(np.arange(len(first) + 1, dtype=np.int32) * (depth - 1)), flat)
            yield pa.RecordBatch.from_arrays([langs.take(at), phrase, pa.array(total, pa.int64())], names=["lang", "phrase", "n"])


def _ends(langs: pa.Array, suffixes: pa.Array) -> tuple[int, int]:
    """The first and the last suffix in the order of the ranges."""
    found = []
    for end in ("min", "max"):
        mine = pc.equal(langs, pc.min_max(langs)[end])
        among = pc.if_else(mine, suffixes, None)
        found.append(pc.index(among, pc.min_max(among)[end]).as_py())
    return tuple(found)


def frequent_phrases(docs: DataFrame, min_count: int = 100, most_words: int = MOST_WORDS, lang_col: str = "lang",
                     text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, n) of all phrases of one word to ``most_words`` that occur ``min_count`` times or more,
    (lang, n) with the number of all words). Phrases are arrays of words; both are stored."""
    spark = docs.sparkSession
    ship(spark)
    work = docs.select(F.coalesce(F.col(f"`{lang_col}`"), F.lit("und")).alias("lang"),
                       F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text"))
    counts = store_once(_word_counts(work), "words")
    frequent = counts.where(F.col("n") >= min_count)
    words = spark.sparkContext.broadcast(_table(cut_lineage(_hashed(frequent))))
    totals = cut_lineage(counts.groupBy("lang").agg(F.sum("n").alias("n")))
    n = totals.agg(F.sum("n")).first()[0] or 0
    bits = max(20, (n // WORDS_PER_HASH).bit_length())
    pairs = spark.sparkContext.broadcast(_table(cut_lineage(_pair_counts(work, words, bits).where(F.col("n") >= min_count).select("h"))))
    folded = store_once(_folded(work, words, pairs, bits, most_words), "suffixes")
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(least, -(-folded.count() // RANGE_ROWS))
    found = (folded.repartitionByRange(ranges, "lang", "suffix", "salt")
             .mapInArrow(lambda batches: _ranged(batches, min_count), "lang string, phrase array<string>, n bigint"))
    phrases = found.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
    ones = frequent.select("lang", F.array("word").alias("phrase"), "n")
    return store_once(ones.unionByName(phrases), "phrases"), totals


def _parts_of(phrase: Column) -> Column:
    """All contiguous parts of two words or more that are shorter than the phrase."""
    size = F.size(phrase)
    return F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(
        F.sequence(F.lit(1), size - m + 1), lambda i: F.slice(phrase, i, m))))


def _score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 a n / (l r)), in 38 digits."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.call_function("div", (wide(a) * wide(n) * F.lit(1000)).cast("decimal(38,0)"), (wide(left) * wide(right)).cast("decimal(38,0)"))


def collocations(docs: DataFrame, min_count: int = 100, most_words: int = MOST_WORDS, absorbed: int = 100, top: int = 2000,
                 lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The ``top`` phrases of each language: ``lang``, ``rank``, ``phrase`` (words joined by spaces), ``a`` occurrences, ``l`` and
    ``r`` those of the two parts of its lowest-scoring cut, ``n`` words of the language, ``score``.

    Texts are folded to small letters (A-Z), cut into pieces at ``. , ; : ! ?`` and line ends, and those into words at spaces and
    tabs. A phrase is 2 to ``most_words`` words of one piece that occur ``min_count`` times or more, overlaps included. A
    cut after k words gives floor(1000 a n / (l r)); the lowest counts, of equal ones that with the fewest words in front.
    Phrases that stand inside a longer one with at least ``absorbed`` percent of their occurrences are left out. Order: score, then a,
    both downwards, then the phrase's UTF-8 bytes. A null language is ``und``; null and empty texts have no words; repeated
    rows count as often as they occur; tables without a frequent phrase give no rows. Ids and other columns take no part.
    """
    known, totals = frequent_phrases(docs, min_count, most_words, lang_col, text_col)
    phrases = known.where(F.size("phrase") > 1).withColumnRenamed("n", "a")
    cuts = phrases.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.size("phrase") - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.slice("phrase", F.lit(1), F.col("k")), "right": F.slice("phrase", F.col("k") + 1, F.size("phrase") - F.col("k"))})
    cuts = (cuts.join(known.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
            .join(known.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
            .join(totals, "lang"))
    scored = cuts.withColumn("score", _score(F.col("a"), F.col("n"), F.col("l"), F.col("r")))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    longer = (phrases.where(F.size("phrase") > 2).select("lang", "a", F.explode(_parts_of(F.col("phrase"))).alias("phrase"))
              .groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
    kept = best.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * absorbed))
    shown = kept.select("lang", F.array_join("phrase", " ").alias("phrase"), "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n",
                        F.col("cut.score").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = shown.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
