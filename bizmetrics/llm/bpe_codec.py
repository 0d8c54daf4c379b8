"""Byte-level BPE encoding with reuse of content-defined chunks, and decoding.

A rolling hash over the last 16 bytes cuts texts into chunks, so that passages which documents share fall into
the same chunks wherever they stand. Chunks that occur more than once in the corpus are encoded once: their digests
are counted, one copy of each moves to the task that encodes it, and its ids come back to the places that refer to it.
Other chunks are encoded where they stand, together with the joins around them.

A chunk's own tokens are not those of the whole text near its ends. Between a letter and a white space every split of
this kind of vocabulary has a boundary, whatever stands around; such a place is called firm here. What a chunk
contributes is the run between its first and its last firm place. Its joins are encoded anew, outwards until both sides
agree, which is at the last firm place of the chunk before and the first of the chunk behind; where a chunk has no two
such places, the join goes on over it, in a text without any to its end.
"""

from __future__ import annotations

import json
import os
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from bizmetrics.llm.common import ship
from bizmetrics.session import cut_lineage, store_once

#: Bits of the table of digests that occur more than once, at least so many for each, and at most 32 MB.
BITS_PER_KEY, MOST_BITS = 16, 1 << 28
SLAB_BITS = 1 << 18
#: Words a worker remembers: those of the latest batches, up to twice as many.
REMEMBERED = 160_000
#: Bytes of texts that are encoded at once.
AT_ONCE = 2 << 20
_WHITE = np.zeros(256, bool)
_WHITE[list(b" \t\n\r")] = True
#: Bytes a word can end in before a firm place: visible ASCII, and last bytes of letters that end no white space.
_WORD = np.zeros(256, bool)
_WORD[0x21:0x7F] = _WORD[0x90:0x9F] = _WORD[0xA1:0xA8] = _WORD[0xB0:0xC0] = True


class Cuts(NamedTuple):
    """A chunk ends where so many bits of the rolling hash are zero, here every 1 KB; limits of its bytes. ``least`` is at
    least a window of the hash."""
    bits: int = 10
    least: int = 256
    most: int = 16_384


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_GEAR = (_mixed(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


#: Bytes hashed at once, so that the intermediate values stay in a processor's cache.
HASHED = 1 << 15
WINDOW = 16


def marks_of(data: np.ndarray, bits: int) -> np.ndarray:
    """Places behind which the hash of the last ``WINDOW`` bytes has ``bits`` zeros in front: windows are doubled, each half
    shifted by the length of the other."""
    found = []
    for at in range(0, len(data), HASHED):
        h = _GEAR[data[max(0, at - WINDOW + 1):at + HASHED]]
        for step in (1, 2, 4, 8):
            h[step:] += h[:-step] << np.uint32(step)  # the right side is made first
        here = h[min(at, WINDOW - 1):]
        found.append(np.nonzero(here < np.uint32(1 << (32 - bits)))[0] + at + 1)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def firm_places(data: np.ndarray) -> np.ndarray:
    """Places with a visible letter before and a white space behind."""
    return np.nonzero(_WORD[data[:-1]] & _WHITE[data[1:]])[0] + 1


class Texts:
    """The texts of a batch, in one row of bytes, and how they are cut."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.binary())
        self.offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
        held = column.buffers()[2]
        self.bytes = memoryview(held)[self.offsets[0]:self.offsets[-1]] if held else memoryview(b"")
        self.offsets = self.offsets - self.offsets[0]
        self.data = np.frombuffer(self.bytes, np.uint8)

    def chunks(self, cuts: Cuts) -> Iterator[tuple[int, bytes, int, int, int]]:
        """(text, digest, start, first, last) of the chunks with two firm places: where it starts, and its first and last one.
        A cut needs ``least`` bytes since the last one and comes after ``most`` at the latest, never inside a letter."""
        data = self.data
        # Windows over the start of a text don't matter: cuts need more bytes than a window has.
        marks = marks_of(data, cuts.bits)
        marks = marks[(data[np.minimum(marks, len(data) - 1)] & 0xC0) != 0x80]  # a letter ends there
        of = np.searchsorted(marks, self.offsets, "right").tolist()
        places, marks = self.offsets.tolist(), marks.tolist()
        texts, starts, ends = [], [], []
        for i, (at, stop) in enumerate(zip(places, places[1:])):
            for mark in [*marks[of[i]:of[i + 1]], stop]:
                while mark - at > cuts.most:
                    cut = at + cuts.most
                    while data[cut] & 0xC0 == 0x80:
                        cut -= 1
                    texts.append(i), starts.append(at), ends.append(cut)
                    at = cut
                if mark - at >= cuts.least or mark == stop > at:
                    texts.append(i), starts.append(at), ends.append(mark)
                    at = mark
        firm = firm_places(data) if len(data) else np.zeros(0, np.int64)
        # Inside a chunk: a letter of it before the place and a white space of it behind.
        lo, hi = np.searchsorted(firm, np.array(starts, np.int64) + 1), np.searchsorted(firm, np.array(ends, np.int64))
        for k in np.nonzero(hi - lo >= 2)[0].tolist():
            yield texts[k], xxhash.xxh3_128_digest(self.bytes[starts[k]:ends[k]]), starts[k], int(firm[lo[k]]), int(firm[hi[k] - 1])


class Codec:
    """Encodes and decodes as the vocabulary file's own library does by default, without added tokens."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        split, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        if not plain or spec.get("normalizer") or any(t["lstrip"] or t["rstrip"] or t["single_word"] or any(map(str.isspace, t["content"])) for t in added):
            raise ValueError("joins can only be repaired for byte-level vocabularies that split at white space")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        ids = spec["model"]["vocab"]
        # A letter stands for each byte in the file: printable Latin-1 for itself, the others from U+0100 on.
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in set(shown)]
        byte = {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}
        bytes_of = [b""] * (1 + max(chain(ids.values(), (t["id"] for t in added))))
        for token, i in ids.items():
            bytes_of[i] = bytes(map(byte.__getitem__, token)) if all(c in byte for c in token) else token.encode()
        for t in added:
            bytes_of[t["id"]] = t["content"].encode()
        self.tokens = pa.array(bytes_of, pa.large_binary())
        self.sizes = np.fromiter(map(len, bytes_of), np.int64, len(bytes_of))
        self.kind = "<u2" if len(bytes_of) <= 1 << 16 else "<u4"  # of ids that move
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    def packed(self, ids: np.ndarray, starts: np.ndarray) -> pa.Array:
        """A binary value for each run of ids."""
        width = np.dtype(self.kind).itemsize
        places = (starts * width).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(places), pa.py_buffer(ids.astype(self.kind))])

    def unpacked(self, rows: list[bytes]) -> pa.ListArray:
        ids = np.frombuffer(b"".join(rows), self.kind)
        return _lists(ids, np.r_[0, np.cumsum(np.fromiter(map(len, rows), np.int64, len(rows)))] // np.dtype(self.kind).itemsize)

    def encode(self, texts: list[bytes | memoryview]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin and the last one's end). A text is cut at its firm places, where every
        split has a boundary; of the different words that are found so, those not met before go to the library."""
        joined = b"".join(texts)
        data = np.frombuffer(joined, np.uint8)
        bounds = np.r_[0, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))]
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(bounds), np.int64)
        cuts = np.zeros(len(data) + 1, bool)
        cuts[firm_places(data)] = cuts[bounds] = True
        places = np.nonzero(cuts)[0]
        words = pa.Array.from_buffers(pa.large_binary(), len(places) - 1, [None, pa.py_buffer(places), pa.py_buffer(joined)]).dictionary_encode()
        distinct = words.dictionary.to_pylist()
        if len(self.known) > REMEMBERED:
            self.known, self.before = {}, self.known
        tokens = [*map(self.known.get, distinct)]
        new = []
        for i in [i for i, ids in enumerate(tokens) if ids is None]:
            if (ids := self.before.get(distinct[i])) is None:
                new.append(i)
            else:
                tokens[i] = self.known[distinct[i]] = ids
        for i, found in zip(new, self.library.encode_batch_fast([distinct[i].decode() for i in new], add_special_tokens=False)):
            tokens[i] = array("I", found.ids).tobytes()
            if len(distinct[i]) < 100:
                self.known[distinct[i]] = tokens[i]
        flat = np.frombuffer(b"".join(tokens), np.uint32)
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens)) // 4
        number = words.indices.to_numpy()
        ids, ends = _gathered(flat, np.r_[0, np.cumsum(sizes)][:-1], sizes, number)
        starts = ends[np.searchsorted(places, bounds)]
        if not np.array_equal(np.r_[0, np.cumsum(self.sizes[ids])][starts], bounds):
            raise ValueError("tokens and texts don't have the same bytes")
        return ids, starts

    def decode(self, ids: pa.Array) -> pa.Array:
        """The texts of lists of ids; bytes that are no letter become U+FFFD, as they do for the library."""
        ends = _ends(ids)
        tokens = self.tokens.take(ids.flatten())
        places = np.frombuffer(tokens.buffers()[1], np.int64)[tokens.offset:tokens.offset + len(tokens) + 1]
        texts = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(np.ascontiguousarray(places[ends])), tokens.buffers()[2]])
        try:
            texts = texts.cast(pa.large_string())
        except pa.ArrowInvalid:
            texts = pa.array([t.decode("utf-8", "replace") for t in texts.to_pylist()], pa.large_string())
        return pc.if_else(ids.is_valid(), texts, None).cast(pa.string())


def _gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the ``chosen`` runs of ``flat`` in a row, where each begins and the last one ends)."""
    lengths = sizes[chosen]
    ends = np.r_[0, np.cumsum(lengths)]
    return flat[np.repeat(starts[chosen] - ends[:-1], lengths) + np.arange(ends[-1])], ends


def _ends(lists: pa.Array) -> np.ndarray:
    return np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64))]


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


class Table:
    """Which digests may occur more than once: one bit each in a table of bounded size. It never forgets one; beyond the
    bound it lets others through too, which are then encoded once like them."""

    def __init__(self, bits: int, slabs: dict[int, bytes]):
        self.bits = bits
        self.data = np.zeros(bits // 8, np.uint8)
        for slab, held in slabs.items():
            self.data[slab * (SLAB_BITS // 8):][:SLAB_BITS // 8] = np.frombuffer(held, np.uint8)

    def __contains__(self, digest: bytes) -> bool:
        bit = int.from_bytes(digest[:8], "little") % self.bits
        return bool(self.data[bit >> 3] >> (bit & 7) & 1)


def _bits(digests: list[bytes], bits: int) -> np.ndarray:
    return (np.frombuffer(b"".join(d[:8] for d in digests), "<u8") % np.uint64(bits)).astype(np.int64)


def _table(repeated: DataFrame) -> Table:
    """The table over ``repeated`` (digest), made slab by slab in tasks; at most ``MOST_BITS`` reach the driver."""
    n = repeated.count()
    bits = min(MOST_BITS, max(SLAB_BITS, 1 << (n * BITS_PER_KEY).bit_length()))

    def slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _bits(batch.column(0).to_pylist(), bits) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at // SLAB_BITS), pa.array(at % SLAB_BITS)], names=["slab", "bit"])

    def filled(key: tuple, group: pa.Table) -> pa.Table:
        held = np.zeros(SLAB_BITS, np.uint8)
        held[group["bit"].to_numpy()] = 1
        return pa.table({"slab": pa.array([key[0].as_py()], pa.int64()), "held": [np.packbits(held, bitorder="little").tobytes()]})

    placed = repeated.mapInArrow(slabs, "slab bigint, bit bigint").distinct()
    return Table(bits, dict(placed.groupBy("slab").applyInArrow(filled, "slab bigint, held binary").collect() if n else ()))


def _counted(work: DataFrame, cuts: Cuts) -> DataFrame:
    """(digest, n): how often each chunk occurs; folded per batch before it moves."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = Counter(digest for _, digest, *_ in Texts(batch.column(0)).chunks(cuts))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["digest", "n"])

    return work.select("text").mapInArrow(run, "digest binary, n bigint").groupBy("digest").agg(F.sum("n").alias("n"))


def _encoded_once(work: DataFrame, table, cuts: Cuts, vocabulary: str, partitions: int) -> DataFrame:
    """(digest, ids) of every chunk in the table, from its first firm place to its last: one copy a batch moves, one is encoded."""
    def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = Texts(batch.column(0))
            found = {digest: bytes(texts.bytes[first:last]) for _, digest, _, first, last in texts.chunks(cuts) if digest in table.value}
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.binary())], names=["digest", "inner"])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, before = codec(vocabulary), None
        for batch in _slices(batches, 1):
            keys, inner = [], []
            for key, chunk in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key != before:
                    keys.append(key), inner.append(chunk)
                before = key
            ids, starts = own.encode(inner)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), own.packed(ids, starts)], names=["digest", "ids"])

    moved = work.select("text").mapInArrow(copies, "digest binary, inner binary")
    return moved.repartition(partitions, "digest").sortWithinPartitions("digest").mapInArrow(encoded, "digest binary, ids binary")


def _pieces(texts: Texts, table, cuts: Cuts) -> Iterator[tuple[int, list[tuple[int, int]], list[bytes]]]:
    """For each text the digests of its chunks that are in the table, and the runs (start, end) before, between and behind
    what those stand for, one more than digests."""
    runs = [[] for _ in range(len(texts.offsets) - 1)]
    digests = [[] for _ in runs]
    at = texts.offsets[:-1].tolist()
    for i, digest, _, first, last in texts.chunks(cuts):
        if digest in table.value:
            runs[i].append((at[i], first))
            digests[i].append(digest)
            at[i] = last
    for i, end in enumerate(texts.offsets[1:].tolist()):
        yield i, [*runs[i], (at[i], end)], digests[i]


def _slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Smaller batches, by the bytes of a column."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def _lists(ids: np.ndarray, starts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids.astype(np.int32)))


def _alone(work: DataFrame, table, cuts: Cuts, vocabulary: str, schema: str) -> DataFrame:
    """The texts without a chunk in the table, encoded where they stand."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 1):
            texts = Texts(batch.column(1))
            found = [(i, texts.bytes[runs[0][0]:runs[0][1]]) for i, runs, digests in _pieces(texts, table, cuts) if not digests]
            ids, starts = codec(vocabulary).encode([text for _, text in found])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i for i, _ in found], pa.int64())), _lists(ids, starts)], names=["doc_id", "ids"])

    return work.select("doc_id", "text").mapInArrow(run, schema)


def _parts(work: DataFrame, table, cuts: Cuts, vocabulary: str, kind: str) -> DataFrame:
    """(row, doc_id, part, ids, digest) of the other texts: the ids of their runs, and the digests of chunks whose ids
    are elsewhere."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 1):
            texts, own = Texts(batch.column(1)), codec(vocabulary)
            rows, parts, kept, digest = [], [], [], []
            for i, runs, digests in _pieces(texts, table, cuts):
                if digests:
                    rows += [i] * (len(runs) + len(digests))
                    parts += range(len(runs) + len(digests))
                    digest += [x for d in digests for x in (None, d)] + [None]
                    kept += [texts.bytes[a:b] for a, b in runs]
            found = own.packed(*own.encode(kept))
            # The runs' ids in the even places.
            held = np.array([d is None for d in digest], bool)
            which = pa.array(np.where(held, np.cumsum(held) - 1, 0), mask=~held)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(2).take(at), batch.column(0).take(at), pa.array(parts, pa.int64()), found.take(which),
                                              pa.array(digest, pa.binary())], names=["row", "doc_id", "part", "ids", "digest"])

    numbered = work.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    return numbered.mapInArrow(run, f"row bigint, doc_id {kind}, part bigint, ids binary, digest binary")


def _joined(parts: DataFrame, vocabulary: str, schema: str) -> DataFrame:
    """The ids of texts whose parts come in their order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, row, held, doc_id = codec(vocabulary), None, [], None

        for batch in batches:
            names, texts, kind = [], [], batch.schema.field("doc_id").type
            for of, name, blob in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "ids"))):
                if of != row:
                    if row is not None:
                        names.append(doc_id), texts.append(b"".join(held))
                    row, doc_id, held = of, name, []
                held.append(blob)
            yield pa.RecordBatch.from_arrays([pa.array(names, kind), own.unpacked(texts)], names=["doc_id", "ids"])
        if row is not None:
            yield pa.RecordBatch.from_arrays([pa.array([doc_id], kind), own.unpacked([b"".join(held)])], names=["doc_id", "ids"])

    return parts.mapInArrow(run, schema)


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
           cuts: Cuts = Cuts()) -> DataFrame:
    """One row per row of ``docs``: ``doc_id`` and ``ids``, the text's token ids (array<int>), as the library of the
    vocabulary file gives them for the whole text, without added tokens.

    ``vocabulary`` is the path of a byte-level BPE vocabulary (.json) that splits at white space, the same on every executor;
    others are refused. Strings of special tokens inside texts become those tokens, as is that format's default. A null
    text counts as an empty one: no ids. Null and repeated ids and repeated rows each keep their row; an empty table gives no
    rows. Texts without white space, however long, are one join. All chunks of a repeated passage refer to one encoding.
    """
    spark: SparkSession = docs.sparkSession
    ship(spark)
    work = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, ids array<int>"
    repeated = cut_lineage(_counted(work, cuts).where(F.col("n") > 1).select("digest"))
    table = spark.sparkContext.broadcast(_table(repeated))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    once = store_once(_encoded_once(work, table, cuts, vocabulary, least), "chunks")
    parts = store_once(_parts(work, table, cuts, vocabulary, kind), "parts")
    own = parts.where(F.col("digest").isNull()).select("row", "doc_id", "part", "ids")
    shared = parts.where(F.col("digest").isNotNull()).drop("ids").join(once, "digest").select("row", "doc_id", "part", "ids")
    dealt = own.unionByName(shared).repartition("row").sortWithinPartitions("row", "part")
    return _alone(work, table, cuts, vocabulary, schema).unionByName(_joined(dealt, vocabulary, schema))


def decode(rows: DataFrame, vocabulary: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with the text of their ``ids_col`` (array<int>) in ``out``, special tokens included; a column of that name is
    replaced. Null ids give a null text, no ids an empty one; an id the vocabulary doesn't have fails."""
    ship(rows.sparkSession)

    @F.arrow_udf("string")
    def text(ids: pa.Array) -> pa.Array:
        return codec(vocabulary).decode(ids)

    return rows.withColumn(out, text(F.col(f"`{ids_col}`")))


def id_bytes(ids: str = "ids") -> Column:
    """The ids as little-endian unsigned 32-bit integers in a row, null for null."""
    @F.arrow_udf("binary")
    def packed(column: pa.Array) -> pa.Array:
        flat = column.flatten().to_numpy().astype("<u4")
        rows = pa.Array.from_buffers(pa.large_binary(), len(column), [None, pa.py_buffer(_ends(column) * 4), pa.py_buffer(flat)])
        return pc.if_else(column.is_valid(), rows, None).cast(pa.binary())
    return packed(F.col(f"`{ids}`"))
