"""Token counts of byte-level BPE vocabularies, by rank-synchronous array merging.

The different pre-tokens of a batch stand in one flat array of symbols, cut into sequences.
In each step every sequence finds its adjacent pair of lowest rank, and all sequences merge
theirs at once, at every place where it stands; sequences without a mergeable pair leave the
array with the number of symbols they have left.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from bizmetrics.llm.common import narrow, ship

#: Pre-tokens looked up at once, and pre-tokens whose counts a worker remembers.
BATCH, REMEMBERED = 200_000, 500_000
#: The split this kind of vocabulary was made with (a fixed value).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NO_RANK = np.iinfo(np.int32).max


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable Latin-1 stands for
    itself, the other bytes for the letters from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Counter:
    """Counts tokens as the vocabulary file's own library does by default, without added tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        split = spec.get("pre_tokenizer") or {}
        if split.get("type") != "ByteLevel" or not split.get("use_regex", True) or split.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("only byte-level vocabularies with their usual split and texts as they are can be counted")
        ids = spec["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.width = max(ids.values()) + 1
        letters = _byte_letters()
        self.of_byte = np.zeros(256, np.int64)
        for letter, byte in letters.items():
            self.of_byte[byte] = ids[letter]
        keys = np.array([ids[a] * self.width + ids[b] for a, b in merges], np.int64)
        made = np.array([ids[a + b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], np.arange(len(keys), dtype=np.int32)[order], made[order]
        special = sorted((t["content"] for t in spec.get("added_tokens", ())), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.split = regex.compile(SPLIT)
        self.known: dict[str, int] = {}

    def surviving(self, tokens: list[str]) -> np.ndarray:
        """How many symbols each pre-token has once no pair can be merged."""
        raw = [t.encode("utf-8", "surrogatepass") for t in tokens]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        left = sizes.copy()
        symbols = self.of_byte[np.frombuffer(b"".join(raw), np.uint8)]
        owner = np.repeat(np.arange(len(raw)), sizes)
        while len(symbols) > 1:
            pairs = symbols[:-1] * self.width + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, pairs), len(self.keys) - 1)
            ranks = np.full(len(symbols), NO_RANK, np.int32)
            ranks[:-1] = np.where((self.keys[at] == pairs) & (owner[:-1] == owner[1:]), self.ranks[at], NO_RANK)
            starts = np.nonzero(np.r_[True, owner[1:] != owner[:-1]])[0]
            lowest = np.minimum.reduceat(ranks, starts)
            lengths = np.diff(np.r_[starts, len(symbols)])
            left[owner[starts]] = lengths
            lowest = np.repeat(lowest, lengths)
            hit = (ranks == lowest) & (lowest != NO_RANK)
            if not hit.any():
                break
            # Of places that overlap, as in a run of one letter, every second one from the left.
            place = np.arange(len(symbols))
            hit &= (place - np.maximum.accumulate(np.where(hit, -1, place)) - 1) % 2 == 0
            symbols[hit] = self.made[at[np.nonzero(hit)[0]]]
            gone = np.r_[False, hit[:-1]] | (lowest == NO_RANK)
            symbols, owner = symbols[~gone], owner[~gone]
            if len(owner):
                remaining = np.bincount(owner, minlength=len(left))
                left = np.where(remaining > 0, remaining, left)
        return left

    def _pieces(self, texts: Iterable[str | None]) -> Iterator[tuple[int, list[str]]]:
        """(which text, some of its pre-tokens); specials come as empty strings."""
        for i, text in enumerate(texts):
            at = 0
            for mark in [*(self.special.finditer(text or "") if self.special else ()), None]:
                part = (text or "")[at:mark.start() if mark else None]
                found = (m[0] for m in self.split.finditer(part)) if len(part) > BATCH else iter(self.split.findall(part))
                while some := list(islice(found, BATCH)):
                    yield i, some
                if mark:
                    yield i, [""]
                    at = mark.end()

    def count(self, texts: list[str | None]) -> np.ndarray:
        counts = np.zeros(len(texts), np.int64)
        held: list[tuple[int, list[str]]] = []
        size = 0

        def flush() -> None:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            new = list(set().union(*(some for _, some in held)) - self.known.keys())
            if new:
                found = self.surviving(new).tolist()
                self.known.update(zip(new, found))
            self.known[""] = 1  # a special token
            for i, some in held:
                counts[i] += sum(map(self.known.__getitem__, some))

        for piece in self._pieces(texts):
            held.append(piece)
            size += len(piece[1])
            if size >= BATCH:
                flush()
                held, size = [], 0
        flush()
        return counts


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_bytes`` (UTF-8), ``n_tokens``, and ``over_limit``, whether
    there are more tokens than ``limit``.

    ``vocabulary`` is the path of a byte-level BPE vocabulary (.json), the same on every executor.
    Special tokens' strings count one each, as is that format's default. A null text counts as an empty one: no bytes, no tokens.
    Long texts are counted in pieces. Null and repeated ids and repeated rows each keep their row.
    """
    ship(docs.sparkSession)

    @F.arrow_udf("bigint")
    def counts(texts: pa.Array) -> pa.Array:
        return pa.array(counter(vocabulary).count(texts.to_pylist()), pa.int64())

    work = narrow(docs, id_col, text_col)
    counted = work.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"),
                          counts("text").alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
