"""Merkle manifest, phrase collocations and BPE codec against plain Python and the library, on hard rows."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from bizmetrics.llm import bpe_codec, merkle, phrases
from bizmetrics.llm.queries import BYTE_BPE

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, tree string, place int, digest string"


# -- Merkle manifest -------------------------------------------------------------------------------

def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text=None):
    values = [*row[:4], row[4] if text is None else text]
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i:i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def way(levels, i):
    out = []
    for level in levels[:-1]:
        run = i // 3 * 3
        out.append((level[run:i], level[i + 1:run + 3]))
        i //= 3
    return out


def plain_manifest(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[name] = levels_of([leaf(r) for r in groups[name]])
    top = levels_of([trees[name][-1][0] for name in names])
    out = []
    for k, name in enumerate(names):
        for i, row in enumerate(groups[name]):
            path = way(trees[name], i) + way(top, k)
            tampered = row[0] is not None and row[4] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0
            folded = leaf(row, row[4].replace("\n", "")) if tampered else leaf(row)
            for before, after in path:
                folded = h(*before, folded, *after)
            root = top[-1][0]
            out.append((row[0], leaf(row), trees[name][-1][0], root, h(*(x for p in path for side in p for x in side)), folded, folded == root))
    return out


def verified(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return [tuple(r) for r in merkle.verified(docs, tampered).collect()]


def document(i, source, text="one\ntwo\n", lang="en"):
    return (i, source, lang, None if text is None else len(text), text)


@pytest.mark.parametrize("block", [1, 2, 8])
def test_manifest_is_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(merkle, "BLOCK", block)
    rng = random.Random(block)
    rows = [document(rng.randrange(2000), rng.choice(["hot"] * 6 + ["a", "é", "z", None, ""]), rng.choice(["a\nb", "", None, "long " * 5000, "\n"]),
                     rng.choice(["en", None])) for _ in range(400)]
    rows += rows[:5] + [document(None, "a"), document(None, None), document(-3, "lone"), document(2 ** 62, "hot")]
    assert sorted(map(repr, verified(spark, rows))) == sorted(map(repr, plain_manifest(rows)))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 9, 10, 28])
def test_small_and_lone_trees(spark, n):
    rows = [document(i, "s") for i in range(n)]
    assert sorted(map(repr, verified(spark, rows))) == sorted(map(repr, plain_manifest(rows)))


@pytest.mark.parametrize("height", range(9))
def test_addresses_are_a_recursive_layout(height):
    """Every node has a place of its own, the arithmetic finds the one that laying out halves by recursion gives."""
    found = merkle._layout(height)
    assert sorted(np.concatenate(found)) == list(range(merkle.subtree_size(height)))
    for level, places in enumerate(found):
        assert np.array_equal(merkle.veb_address(height, level, np.arange(len(places))), places)
    if height >= 3:  # a subtree of the lower half stands together
        upper = (height - 1) // 2
        under = np.concatenate([found[level][:3 ** (level - upper - 1)] for level in range(upper + 1, height + 1)])
        assert sorted(under) == list(range(min(under), min(under) + len(under)))


def test_hot_group_is_dealt_out(spark, monkeypatch):
    """A group with most rows is cut into blocks over many tasks."""
    monkeypatch.setattr(merkle, "BLOCK", 3)
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("hot").alias("source"), F.lit("en").alias("lang"), F.lit(1).alias("n_chars"), F.lit("t").alias("text"))
    manifest = merkle.build(rows, F.col("source"), F.sha2(F.col("doc_id").cast("string"), 256), [F.col("doc_id")], F.col("doc_id"))
    assert manifest.tiers[0].agg(F.max("leaves"), F.count("*")).first() == (27, 186)


# -- phrases ---------------------------------------------------------------------------------------

def plain_phrases(rows, least, most=5, top=2000, absorbed=100):
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    total, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(upper)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            total[lang] += len(words)
            for k in range(1, most + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i:i + k])] += 1
    found = {}
    for (lang, p), a in f.items():
        if len(p) > 1 and a >= least:
            cuts = [(1000 * a * total[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found[lang, p] = (a, f[lang, p[:k]], f[lang, p[k:]], total[lang], score)
    inside = {(lang, p[i:i + m]) for (lang, p), v in found.items() for m in range(2, len(p)) for i in range(len(p) - m + 1)
              if 100 * v[0] >= absorbed * f[lang, p[i:i + m]]}
    out = []
    for lang in total:
        mine = sorted((-v[4], -v[0], " ".join(p).encode(), v) for (of, p), v in found.items() if of == lang and (of, p) not in inside)
        out += [(lang, i + 1, p.decode(), *v) for i, (_, _, p, v) in enumerate(mine[:top])]
    return sorted(out)


def texts(seed, n=300):
    rng = random.Random(seed)
    words = ["the", "The", "a", "of", "und", "é", "x\x01", "\x01", "x", "x\xa0y", "long" * 40, "the\x00"]
    rows = [(rng.choice(["en", "en", "en", "de", None, "und", ""]),
             "".join(rng.choice(words[:4] if rng.random() < .5 else words) + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\x0b"])
                     for _ in range(rng.randrange(40)))) for _ in range(n)]
    return rows + rows[:20] + [("en", None), ("en", ""), (None, None), ("en", "the " * 4000), ("xx", " . ")]


@pytest.mark.parametrize("least, rows_a_range, bytes_sorted", [(5, 500_000, 12 << 20), (5, 40, 500), (1, 100, 2000), (30, 30, 300)])
def test_phrases_are_brute_force(spark, monkeypatch, least, rows_a_range, bytes_sorted):
    monkeypatch.setattr(phrases, "RANGE_ROWS", rows_a_range)
    monkeypatch.setattr(phrases, "SORTED_BYTES", bytes_sorted)
    rows = texts(least)
    docs = spark.createDataFrame(rows, "lang string, text string").withColumn("phrase", F.lit(1)).withColumn("n", F.lit("x")).repartition(4)
    got = sorted(tuple(r) for r in phrases.collocations(docs, min_count=least, top=60).collect())
    assert got == plain_phrases(rows, least, top=60)


def test_partly_absorbed_phrases(spark):
    rows = texts(9)
    docs = spark.createDataFrame(rows, "lang string, text string")
    got = sorted(tuple(r) for r in phrases.collocations(docs, min_count=4, most_words=4, absorbed=60).collect())
    assert got == plain_phrases(rows, 4, most=4, absorbed=60)


def test_empty_table_has_no_phrases(spark):
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []


def test_scores_are_exact(spark):
    """Products beyond 64 bits, and quotients that just miss a whole number."""
    values = [(10 ** 13 + 7, 10 ** 14 + 3, 10 ** 13 + 9, 10 ** 13 + 11), (999, 10 ** 15, 10 ** 9, 999), (3, 7, 3, 7), (100, 10 ** 17, 100, 101)]
    got = spark.createDataFrame(values, "a bigint, n bigint, l bigint, r bigint").select(phrases._score(*map(F.col, "anlr"))).collect()
    assert [r[0] for r in got] == [Fraction(1000 * a * n, l_ * r) // 1 for a, n, l_, r in values]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 4), min_size=1, max_size=5), max_size=60), st.integers(0, 4))
def test_quicksort_counts_prefixes(suffixes, least):
    width = 5
    words = np.array([[*s, *[-1] * (width - len(s))] for s in suffixes], np.int64).reshape(-1, width)
    lengths, weights = np.array([*map(len, suffixes)], np.int64), np.arange(1, len(suffixes) + 1)
    got = {tuple(suffixes[i][:depth]): int(n) for depth, first, total in phrases.multikey_quicksort(words, lengths, weights, least)
           for i, n in zip(first, total)}
    want = Counter()
    for s, w in zip(suffixes, weights):
        for k in range(1, len(s) + 1):
            want[tuple(s[:k])] += int(w)
    assert got == {p: n for p, n in want.items() if n >= least}


# -- BPE codec -------------------------------------------------------------------------------------

LIBRARY = Tokenizer.from_file(BYTE_BPE)


def hard_texts():
    rng = random.Random(3)
    shared = " ".join(rng.choice(["alpha", "Beta's", "gamma,", "δέλτα", "12345", "x" * 30, "\n\n", "we'll"]) for _ in range(900))
    tail = lambda n: "".join(rng.choice("ab c\n'é ,.1") for _ in range(n))
    rows = [None, "", " ", "a", "\n", "<|endoftext|>", "a<|endoftext|> b <|endoftext|>", "x" * 60_000, " " * 20_000, "é" * 20_000, "日本語" * 9000, "\xa0 　 " * 5000]
    rows += [tail(i) + shared + tail(40 - i) for i in range(40)] + [shared[i:] + "<|endoftext|>" + shared for i in range(12)] + [shared] * 5
    return rows + [tail(rng.randrange(3000)) for _ in range(40)] + [shared.replace(" ", "")] * 3


@pytest.mark.parametrize("cuts", [(10, 256, 16_384), (3, 16, 64), (6, 20, 300)])
def test_ids_are_the_librarys(spark, cuts):
    rows = [(None if i % 9 == 0 else i // 2, t) for i, t in enumerate(hard_texts())]
    docs = spark.createDataFrame(rows, "doc_id int, text string").withColumn("ids", F.lit(1)).withColumn("digest", F.lit("x")).repartition(3)
    encoded = bpe_codec.encode(docs, BYTE_BPE, cuts=bpe_codec.Cuts(*cuts))
    got = [(r.doc_id, tuple(r.ids), r.decoded) for r in bpe_codec.decode(encoded, BYTE_BPE).collect()]
    want = [(i, tuple(LIBRARY.encode(t or "", add_special_tokens=False).ids), t or "") for i, t in rows]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_shared_chunks_are_encoded_once(spark, monkeypatch):
    """Each chunk that texts share is in the table of encodings once, and in no text's own runs."""
    rng = random.Random(1)
    shared = " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(3000))
    docs = spark.createDataFrame([(i, f"start{i} " + shared) for i in range(50)], "doc_id int, text string").repartition(5)
    stored = {}
    keep = bpe_codec.store_once
    monkeypatch.setattr(bpe_codec, "store_once", lambda df, label: stored.setdefault(label, keep(df, label)))
    assert bpe_codec.encode(docs, BYTE_BPE).count() == 50
    once, parts = stored["chunks"], stored["parts"]
    assert once.count() == once.select("digest").distinct().count() > 10
    own = parts.agg(F.sum(F.octet_length("ids"))).first()[0]
    assert own < 50 * len(shared) / 10
    assert parts.where(F.col("digest").isNotNull()).count() == 50 * once.count()


def test_codec_of_empty_table_and_odd_ids(spark):
    empty = spark.createDataFrame([], "doc_id string, text string")
    assert bpe_codec.encode(empty, BYTE_BPE).collect() == []
    rows = spark.createDataFrame([([],), (None,), ([255 + 256, 0],), ([187, 50256],)], "ids array<int>")
    got = bpe_codec.decode(rows, BYTE_BPE).withColumn("b", bpe_codec.id_bytes()).collect()
    assert [r.decoded for r in got] == [None if r.ids is None else LIBRARY.decode(r.ids, skip_special_tokens=False) for r in got]
    assert [r.b and bytes(r.b) for r in got] == [None if r.ids is None else np.array(r.ids, "<u4").tobytes() or b"" for r in got]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab'sltrevd 12\n\t.,!é漢\xa0 \u0085<|>\U0001f600")), max_size=60), max_size=4))
def test_words_at_firm_places_are_exact(some):
    own = bpe_codec.codec(BYTE_BPE)
    ids, starts = own.encode([t.encode() for t in some])
    assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in some]


def test_other_kinds_of_vocabulary_are_refused():
    import public_tokenizers
    with pytest.raises(ValueError):
        bpe_codec.Codec(public_tokenizers.path("word_bpe_49k.json"))


def test_chunks_are_content_defined():
    """What stands before a passage changes its first chunks only."""
    rng = random.Random(5)
    passage = " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(5000)).encode()
    digests = [{d for _, d, *_ in bpe_codec.Texts(pa.array([front + passage])).chunks(bpe_codec.Cuts())} for front in (b"", b"other words before it " * 77)]
    assert len(digests[0] & digests[1]) >= len(digests[0]) - 2
