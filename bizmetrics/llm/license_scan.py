"""License scans: notices found by a positional index over their rarest words.

The templates' words are indexed with their positions. A text looks up its highest-IDF licence
words only; each hit (word at p in the text, at q in a template) is a vote for the template to
begin at p - q. A start that enough of the looked-up words agree on, and where the template's
mandatory phrases stand, is scored by the share of the template's words in their places. How
rare a word is, is counted over all documents.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from bizmetrics.llm.common import narrow, ship
from bizmetrics.llm.license_texts import PHRASES, TEMPLATES

#: Licence words of highest IDF that a text looks up for each template, and the share of a
#: template's looked-up words that must agree on where it begins. Fixed by the templates, not by the text.
LOOKED_UP, AGREEING = 6, 0.5
#: The least share of a template's words in their places.
LEAST_SCORE = 0.6
#: How many places a mandatory phrase or a word may be off, where words were added or lost.
SLACK = 3

_LETTERS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Runs of letters, digits and anything beyond ASCII, with A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_LETTERS).split()


_TEMPLATES = {label: (words_of(notice), [words_of(p) for p in phrases]) for label, (notice, phrases) in TEMPLATES.items()}
_PHRASES = [(b" " + b" ".join(words_of(p)) + b" ", label) for p, label in PHRASES.items()]
VOCABULARY = frozenset(w for notice, _ in _TEMPLATES.values() for w in notice)


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(first word, label) of every place where a base phrase's words stand one after another."""
    line, found = b" " + b" ".join(words) + b" ", []
    for phrase, label in _PHRASES:
        at = line.find(phrase)
        before = at_before = 0
        while at >= 0:
            before += line.count(b" ", at_before, at)
            found.append((before, label))
            at_before, at = at, line.find(phrase, at + 1)
    return found


@dataclass(frozen=True)
class Index:
    """For each template its rarest words, and the postings of each such word."""
    postings: dict[bytes, list[tuple[str, int]]]
    sizes: dict[str, int]


@lru_cache(maxsize=4)
def index(frequencies: tuple[tuple[bytes, int], ...], n_docs: int) -> Index:
    known = dict(frequencies)
    idf = {w: math.log((n_docs + 1) / (known.get(w, 0) + 1)) for w in VOCABULARY}
    postings: dict[bytes, list[tuple[str, int]]] = defaultdict(list)
    sizes = {}
    for label, (notice, _) in _TEMPLATES.items():
        rarest = sorted(set(notice), key=lambda w: (-idf[w], w))[:LOOKED_UP]
        sizes[label] = len(rarest)
        for q, word in enumerate(notice):
            if word in rarest:
                postings[word].append((label, q))
    return Index(dict(postings), sizes)


def _stands(words: list[bytes], phrase: list[bytes], lo: int, hi: int) -> bool:
    return any(words[i:i + len(phrase)] == phrase for i in range(max(lo, 0), min(hi, len(words) - len(phrase)) + 1))


def matches(words: list[bytes], rare: Index) -> dict[str, float]:
    """The labels whose notice stands in the text, with the best score of each."""
    if rare.postings.keys().isdisjoint(words):
        return {}
    votes: dict[tuple[str, int], set[bytes]] = defaultdict(set)
    for p, word in enumerate(words):
        for label, q in rare.postings.get(word, ()):
            votes[label, p - q].add(word)
    best: dict[str, float] = {}
    for (label, start), agreed in votes.items():
        near = set().union(*(votes.get((label, start + d), ()) for d in range(-SLACK, SLACK + 1)))
        if len(near) < AGREEING * rare.sizes[label]:
            continue
        notice, phrases = _TEMPLATES[label]
        stop = start + len(notice)
        if not all(_stands(words, p, start - SLACK, stop + SLACK - len(p)) for p in phrases):
            continue
        at = [set(words[max(0, start + q - SLACK):max(0, start + q + SLACK + 1)]) for q in range(len(notice))]
        score = sum(w in there for w, there in zip(notice, at)) / len(notice)
        if score >= LEAST_SCORE:
            best[label] = max(best.get(label, 0.0), score)
    return best


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[tuple[tuple[bytes, int], ...], int]:
    """In how many documents each licence word stands, and the number of documents. The result is
    as large as the templates' vocabulary, whatever the corpus."""
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        n = 0
        for batch in batches:
            n += batch.num_rows
            for text in batch.column(0):
                counts.update(VOCABULARY.intersection(words_of(text.as_py())))
        yield pa.RecordBatch.from_pydict({"word": [b"", *counts], "n": [n, *counts.values()]},
                                         pa.schema([("word", pa.binary()), ("n", pa.int64())]))

    partial = docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(count, "word binary, n bigint")
    counts = {bytes(r["word"]): r["n"] for r in partial.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    n_docs = counts.pop(b"", 0)
    return tuple(sorted(counts.items())), n_docs


def licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_words``; ``n_base``, the places of base phrases, ``first_word``
    and ``last_word``, the smallest and largest start of one (null without any); ``base_labels`` and ``labels``
    (the method's too), distinct, sorted and joined by commas; ``score``, the best share of a notice's words that
    stand in their places, 0 where no notice was found.

    A null or empty text has no words, labels or score. Repeated rows and null ids each get their row; ties in
    rarity go to the smaller word. Empty tables give no rows.
    """
    frequencies, n_docs = document_frequencies(docs, text_col)
    out = pa.struct([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
                     ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])

    @F.arrow_udf("struct<n_words:bigint,n_base:bigint,first_word:bigint,last_word:bigint,base_labels:string,labels:string,score:double>")
    def scanned(texts: pa.Array) -> pa.Array:
        rare = index(frequencies, n_docs)
        return pa.array([_row(words_of(t.as_py()), rare) for t in texts], out)

    work = narrow(docs, id_col, text_col)
    return work.select("doc_id", scanned("text").alias("r")).select("doc_id", "r.*")


def _row(words: list[bytes], rare: Index) -> dict:
    places = base_places(words)
    base = {label for _, label in places}
    found = matches(words, rare)
    starts = [p for p, _ in places]
    return {"n_words": len(words), "n_base": len(places), "first_word": min(starts, default=None),
            "last_word": max(starts, default=None), "base_labels": ",".join(sorted(base)),
            "labels": ",".join(sorted(base | found.keys())), "score": max(found.values(), default=0.0)}
