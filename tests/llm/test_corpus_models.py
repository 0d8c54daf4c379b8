"""Sampled segmentations, co-training, graphs, URL rules and archives."""

import gzip
import math
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from bizmetrics.llm import cotraining, hnsw, lattice, url_rules, warc
from bizmetrics.llm.queries import URL_RULES
from conftest import DATA, rows

PIECES = public_tokenizers.path("piece_bpe_32k.model")


# -- SentencePiece ------------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text() | st.text(alphabet=" ▁ab\n日é\U0001F600"), max_size=5))
def test_decoding_is_lossless(library, texts):
    model = lattice.model(PIECES)
    offsets, ids = model.sample(texts, np.arange(len(texts), dtype=np.uint64))
    for text, a, b in zip(texts, offsets, offsets[1:]):
        assert model.decode(ids[a:b]) == text == library.decode(ids[a:b].tolist())
        assert not {0, 1, 2} & set(ids[a:b].tolist())


def test_draws_have_the_paths_shares():
    """All segmentations of some words, weighed one by one, against the frequencies of many draws."""
    model = lattice.model(PIECES)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    pieces = {library.id_to_piece(i): i for i in range(259, library.get_piece_size())}

    def paths(word):
        if not word:
            yield ()
        for n in range(1, len(word) + 1):
            if word[:n] in pieces:
                yield from ((pieces[word[:n]], *rest) for rest in paths(word[n:]))

    draws = 20_000
    for word in ("there", "  in"):
        offsets, ids = model.sample([word] * draws, np.arange(draws, dtype=np.uint64) * np.uint64(977))
        got = Counter(tuple(ids[a:b].tolist()) for a, b in zip(offsets, offsets[1:]))
        weights = {p: math.exp(sum(model.weights[list(p)])) for p in paths("▁" + word.replace(" ", "▁"))}
        total = sum(weights.values())
        assert set(got) <= set(weights)
        for path, weight in weights.items():
            share = weight / total
            assert abs(got[path] / draws - share) < 5 * math.sqrt(share / draws) + 1e-3


def test_draws_do_not_depend_on_the_batch(monkeypatch):
    texts = ["the same words again and again", None, "", "and  others\n▁日本語 here", "x" * 3000, "many words " * 500]
    seeds = np.arange(6, dtype=np.uint64)
    offsets, ids = lattice.model(PIECES).sample(texts, seeds)
    monkeypatch.setattr(lattice, "BATCH", 11)
    monkeypatch.setattr(lattice, "FILTERED", 3)
    for i, text in enumerate(texts):
        one = lattice.model(PIECES).sample([text], seeds[i:i + 1])[1]
        assert (one == ids[offsets[i]:offsets[i + 1]]).all()


def test_encode_and_decode(spark):
    texts = ["Some text, in words.", None, "", "▁ marks\nand bytes 日", "Some text, in words.", "long words " * 30_000]
    docs = spark.createDataFrame([(f"{i % 4:032x}", i if i != 2 else None, t, 0) for i, t in enumerate(texts)], "key string, doc_id int, text string, n_pieces int")
    back = lattice.decode(lattice.encode(docs, PIECES), PIECES).collect()
    assert [r.decoded for r in back] == [t or "" for t in texts]
    assert back[0].piece_ids == back[4].piece_ids and back[1].piece_ids == []
    trip = lattice.round_trip(docs, PIECES).collect()
    assert [r.piece_ids for r in trip] == [r.piece_ids for r in back] and all(r.lossless for r in trip)
    assert any(r.piece_ids != s.piece_ids for r, s in zip(back, lattice.encode(docs, PIECES, seed=1).collect()))
    assert lattice.round_trip(docs.limit(0), PIECES).count() == 0


# -- quality ------------------------------------------------------------------------

def meta():
    return [F.col("source"), F.col("lang")]


def test_quality_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    seen, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    scored = cotraining.quality(docs, seen, meta()).join(held, "doc_id").collect()
    good, bad = ([r.kept for r in scored if r.quality == q] for q in (1, 0))
    assert len(bad) > 15 and np.mean(good) > 0.98 and np.mean(bad) < 0.2
    kept = cotraining.keep_good(docs, seen, meta())
    assert kept.columns == docs.columns and 700 < kept.count() < 1000


def test_views_teach_each_other(spark):
    """Metadata tells the rows apart; most words that do so stand in no labelled row."""
    rnd = np.random.default_rng(0)
    rows_, labels = [], []
    for i in range(1500):
        good = i % 2
        own = [f"{'fine' if good else 'poor'}{n}" for n in rnd.integers(0, 150, 2)]
        text = " ".join([*rnd.choice(["alpha", "beta", "gamma", "delta"], 10), *own])
        rows_.append((i, text, f"src{good}", "en", "x"))
        if i < 200:
            labels.append((i, good))
    docs = spark.createDataFrame(rows_, "doc_id int, text string, source string, lang string, key string")
    known = spark.createDataFrame(labels, "doc_id int, quality int")
    wrong = [sum((r.text_score >= 0.5) != bool(r.doc_id % 2) for r in cotraining.quality(docs, known, meta(), rounds=n).collect()) for n in (0, 2)]
    assert wrong[0] > 100 and wrong[1] < wrong[0] / 2


def test_quality_of_hard_rows(spark):
    table = [(None, None, None, None), (1, "", "s", "en"), (2, "x" * 100_000, "s", None), (3, "a b", "s", "en"), (3, "a b", "s", "en"), (4, "a b " * 50_000, "s", "en")]
    docs = spark.createDataFrame([(*r, 1) for r in table], "doc_id int, text string, source string, lang string, score int")
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (3, 0), (4, None), (None, 1), (9, 7)], "doc_id int, quality int")
    got = cotraining.quality(docs, labels, meta())
    assert got.count() == len(table) and got.where("kept is null").count() == 0
    assert cotraining.quality(docs, labels.limit(0), meta()).where("kept and score is null").count() == len(table)
    assert cotraining.quality(docs.limit(0), labels, meta()).count() == 0
    assert cotraining.keep_good(docs, labels.limit(0), meta()).count() == len(table)


def test_copies_of_a_labelled_row_change_nothing(spark):
    """Thousands of copies of one labelled row fill no bound: scores are those with one copy."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    copied = docs.join(labels.where("quality = 0").orderBy("doc_id").limit(1).select("doc_id"), "doc_id", "left_semi")
    more = docs.unionByName(copied.crossJoin(spark.range(3000)).drop("id"))
    score = lambda df, **how: {r.doc_id: (r.text_score, r.meta_score, r.score, r.kept) for r in cotraining.quality(df, labels, meta(), **how).collect()}
    for how in ({}, {"bound": 60, "pseudo": 40}):
        once, often = score(docs, **how), score(more, **how)
        assert once.keys() == often.keys() and None not in next(iter(once.values()))
        assert all(once[i] == pytest.approx(often[i], abs=1e-9) for i in once)


def test_co_training_is_the_plain_procedure(spark):
    """The same rounds in one thread over collected rows: who is labelled, who is handed over, what it comes to."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    known = {r.doc_id: r.quality for r in labels.collect()}
    rows_ = {r.key: r for r in cotraining.featured(docs, meta(), "doc_id", "text").collect()}
    used = [r for k, r in sorted(rows_.items()) if r.doc_id in known and int(k[:8], 16) % cotraining.HELD_OUT]
    held = [r for k, r in sorted(rows_.items()) if r.doc_id in known and not int(k[:8], 16) % cotraining.HELD_OUT]
    open_ = [r for r in rows_.values() if r.doc_id not in known]
    pools = {v: [(bytes(r[v]), known[r.doc_id]) for r in used] for v in ("text", "meta")}
    dims, y_held, given_ = {"text": cotraining.TEXT_DIM, "meta": cotraining.META_DIM}, np.array([known[r.doc_id] for r in held]), set()
    def refit():
        views = {v: cotraining.fit(v, dims[v], [x for x, _ in pools[v]], np.array([y for _, y in pools[v]])) for v in pools}
        for v in views:
            cotraining.calibrate(views[v], [bytes(r[v]) for r in held], y_held)
        return views
    views = refit()
    for _ in range(cotraining.ROUNDS):
        p = {v: dict(zip([r.key for r in open_], cotraining._sigmoid(views[v].logits([bytes(r[v]) for r in open_])))) for v in views}
        found = []
        for v, other in (("text", "meta"), ("meta", "text")):
            for label, sure in ((1, p[v]), (0, {k: 1 - x for k, x in p[v].items()})):
                best = sorted((k for k, x in sure.items() if x >= cotraining.SURE), key=lambda k: (-sure[k], k))[:cotraining.PSEUDO // 2]
                found += [(other, k, label) for k in best]
        for other, k, label in sorted(found):
            if (other, k) not in given_:
                pools[other].append((bytes(rows_[k][other]), label))
                given_.add((other, k))
        views = refit()
    assert given_
    text, metas = ([bytes(r[v]) for r in rows_.values()] for v in ("text", "meta"))
    apart = {v: max(cotraining._auc(views[v].logits([bytes(r[v]) for r in held]), y_held) - 0.5, 0.0) for v in views}
    share = (apart["text"] + 1e-6) / (apart["text"] + apart["meta"] + 2e-6)
    good = (y_held.sum() + 1) / (len(y_held) + 2)
    model = cotraining.CoTrained(views["text"], views["meta"], float(np.log(good / (1 - good))), share)
    want = dict(zip(rows_, zip(*model.scores(text, metas))))
    got = cotraining.quality(docs, labels, meta()).collect()
    assert all((r.text_score, r.meta_score, r.score) == pytest.approx(want[r.key], abs=1e-9) for r in got)


def test_calibration_of_separated_rows():
    view = cotraining.View("text", np.array([10.0]))
    packed = [cotraining._packed(np.array([0]), np.array([x])) for x in (-3, -2, -1, 1, 2, 3)]
    cotraining.calibrate(view, packed, np.array([0, 0, 0, 1, 1, 1]))
    p = cotraining._sigmoid(view.logits(packed))
    assert (np.diff(p) > 0).all() and p[0] < 0.2 and p[2] < 0.5 < p[3] and p[5] > 0.8


# -- nearest neighbours -------------------------------------------------------------

def plain_nearest(table, k, queries):
    out = {}
    for q, v in queries.items():
        score = sorted((-float(np.dot(v.astype(float), w.astype(float))), i) for i, w in table.items() if i != q and len(w) == len(v))
        out[q] = [(i, -s) for s, i in score[:k]]
    return out


def test_recall_on_the_given_vectors(spark):
    rows_ = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    table = {r.vec_id: np.array(r.embedding, np.float32) for r in rows_.collect()}
    queries = {i: v for i, v in table.items() if i % 20 == 0}
    want = plain_nearest(table, 20, queries)
    got = defaultdict(list)
    for r in hnsw.nearest(rows_, rows_.where("vec_id % 20 = 0"), 20).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.95
    for q, found in got.items():
        for i, score in found:
            assert score == pytest.approx(float(np.dot(queries[q].astype(float), table[i].astype(float))), abs=1e-12)
        assert [s for _, s in found] == sorted((s for _, s in found), reverse=True)


def test_recall_of_a_full_shard():
    """One graph of the size that shards aim for, over jittered copies of the given vectors and with lengths that vary."""
    import pyarrow.parquet as pq
    given_ = np.unique(hnsw._vectors(pq.read_table("/root/testdata/sf0.1/embeddings.parquet")["embedding"]), axis=0)
    rnd = np.random.default_rng(0)
    base = given_[rnd.integers(0, len(given_), hnsw.SHARD_ROWS + 500)]
    base = base + rnd.normal(0, 0.3 * given_.std(), base.shape)
    cases = ((np.ones(len(base)), 20, hnsw.SEARCH_BEAM, 0.95), (rnd.uniform(0.5, 2, len(base)), 2, hnsw.SEARCH_BEAM, 0.9),
             (rnd.uniform(0.5, 2, len(base)), 20, 256, 0.9), (np.exp(rnd.normal(0, 1, len(base))), 20, 256, 0.9))
    for lengths, k, beam, least in cases:
        vectors = (base * lengths[:, None]).astype(np.float32)
        nodes, queries = vectors[:hnsw.SHARD_ROWS], vectors[-500:]
        graph, order = hnsw.build(nodes)
        asked = np.concatenate([queries, np.zeros((len(queries), 1), np.float32)], 1)
        near, _ = graph.beam(asked, graph.descend(asked, 0), 0, beam)
        want = np.argsort(-(queries.astype(float) @ nodes[order].astype(float).T), axis=1, kind="stable")[:, :k]
        recall = np.mean([len({*a} & {*b}) / k for a, b in zip(near, want)])
        print(f"recall of the first {k}: {recall:.4f}")
        assert recall >= least


def test_shards_share_tasks(spark, monkeypatch):
    """More shards than tasks, and several tasks: the same as one by one."""
    monkeypatch.setattr(hnsw, "SHARD_ROWS", 20)
    monkeypatch.setattr(hnsw, "TASK_ROWS", 45)
    monkeypatch.setattr(hnsw, "LEAST_SHARDS", 2)
    rnd = np.random.default_rng(5)
    table = {i: rnd.normal(size=4 + i % 2).astype(np.float32) for i in range(400)}
    rows_ = spark.createDataFrame([(i, v.tolist()) for i, v in table.items()], "vec_id int, embedding array<float>")
    nodes, groups = hnsw.index(rows_, 5)
    assert groups == 9 and nodes.select("part").distinct().count() == 40
    got = defaultdict(list)
    for r in hnsw.nearest(rows_, rows_.where("vec_id < 30"), 5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, round(r.score, 9)))
    assert dict(got) == {q: [(i, round(s, 9)) for i, s in f] for q, f in plain_nearest(table, 5, {i: table[i] for i in range(30)}).items()}


def test_tasks_are_bounded_by_components(spark, monkeypatch):
    """Long vectors: fewer of them to a task."""
    monkeypatch.setattr(hnsw, "LEAST_SHARDS", 2)
    monkeypatch.setattr(hnsw, "SHARD_ROWS", 20)
    monkeypatch.setattr(hnsw, "TASK_VALUES", 64 * 40)
    rows_ = spark.createDataFrame([(i, np.random.default_rng(i).normal(size=64).tolist()) for i in range(200)], "vec_id int, embedding array<float>")
    _, groups = hnsw.index(rows_, 5)
    assert groups == 5


def test_hard_vectors(spark):
    nan, inf = float("nan"), float("inf")
    table = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [None, 1.0]), (6, [nan, 1.0]), (7, [inf, 1.0]),
             (8, [2.0, 1.0]), (9, [-1.0, 3.0]), (None, [9.0, 9.0]), (10, [1.0, 2.0, 3.0]), (20, [0.5, 0.5, 0.5]), (11, []), *[(100 + i, [0.3, 0.4]) for i in range(40)]]
    rows_ = spark.createDataFrame([(i, v, 0, 0) for i, v in table], "vec_id int, embedding array<float>, rank int, part int")
    usable = {i: np.array(v, np.float32) for i, v in table if i is not None and i not in (3, 4, 5, 6, 7, 11)}
    queries = {i: usable[i] for i in (0, 20, 100)}
    got = defaultdict(list)
    for r in hnsw.nearest(rows_, rows_.where("vec_id % 20 = 0"), k=5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, round(r.score, 5)))
    want = {q: [(i, round(s, 5)) for i, s in f] for q, f in plain_nearest(usable, 5, {**queries, 120: usable[120]}).items()}
    assert dict(got) == want
    assert hnsw.nearest(rows_.limit(0), rows_, 5).count() == 0 and hnsw.nearest(rows_, rows_.limit(0), 5).count() == 0


def test_double_vectors(spark):
    """Beyond the range of floats, below it, and equal only as floats: all compared as given."""
    rnd = np.random.default_rng(6)
    close = [[1.0, 1.0 + i * 2.0 ** -40] for i in range(12)]
    for unit in (1.0, 1e60, 1e-60):
        vectors = [*close, *rnd.normal(size=(40, 2)).tolist()]
        table = {i: np.array(v) * unit for i, v in enumerate(vectors)}
        rows_ = spark.createDataFrame([(i, v.tolist()) for i, v in table.items()], "vec_id int, embedding array<double>")
        got = defaultdict(list)
        for r in hnsw.nearest(rows_, rows_.where("vec_id % 5 = 0"), k=3).orderBy("query_id", "rank").collect():
            got[r.query_id].append((r.vec_id, r.score))
        want = plain_nearest(table, 3, {i: v for i, v in table.items() if i % 5 == 0})
        assert {q: [i for i, _ in f] for q, f in got.items()} == {q: [i for i, _ in f] for q, f in want.items()}
        assert all(s == pytest.approx(x, rel=1e-12) for q in want for (_, s), (_, x) in zip(got[q], want[q]))


# -- URL rules ----------------------------------------------------------------------

def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[cut:]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]


def plain_rule(host, path):
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return (best.text, best.verdict) if best else (None, None)


URLS = [None, "", "no scheme", "http://", "HTTP://A.Example.NET/en/1?x=1#y", "http://example.net/en", "http://notexample.net/en/", "http://net/", "http://net", "http://x.net?q#/",
        "https://a.example.com/de/7", "https://a.example.com/De/7", "ftp://B.ORG/fr/", "x://y://z.net/", "http://é.NET/ü?a&b=1\n", "http://a.com/" + "p/" * 20_000, "http://a.org/spam/1",
        "http://user@net:80/x"]


def test_listed_rules(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "url")
    extra = spark.createDataFrame([(i if i != 4 else None, u) for i, u in enumerate(URLS + URLS[4:6])], "page_id bigint, url string")
    both = pages.unionByName(extra).withColumns({"rule": F.lit("x"), "tokens": F.lit(1)})
    got = url_rules.judge(both, URL_RULES).collect()
    want = []
    for r in both.collect():
        parts = plain_parts(r.url)
        want.append((r.page_id, *parts, *plain_rule(*parts)))
    assert len(got) == len(want)
    assert sorted(map(repr, ((r.page_id, r.host, r.path, r.rule) for r in got))) == sorted(repr(w[:4]) for w in want)
    listed = {(w[0], w[1], w[2]): w[4] for w in want}
    for r in got:
        assert r.verdict in ("allow", "block")
        if r.rule:
            assert r.verdict == listed[r.page_id, r.host, r.path] and r.mined_rule is None
    assert url_rules.judge(both.limit(0), URL_RULES).count() == 0


def test_mined_rules_are_brute_force(spark):
    """Support, confidence and redundancy counted for every combination of tokens."""
    from itertools import combinations
    rnd = np.random.default_rng(1)
    labelled = []
    for _ in range(300):
        tokens = sorted({str(t) for t in rnd.choice(list("abcdef"), rnd.integers(1, 5))})
        bad = ("a" in tokens and "b" in tokens) or "f" in tokens
        labelled.append((tokens, "block" if bad ^ (rnd.random() < 0.02) else "allow"))
    n, support, confidence = len(labelled), 0.05, 0.9
    rules = {}
    for size in range(1, 6):
        for part in combinations("abcdef", size):
            fits = [y for t, y in labelled if set(part) <= set(t)]
            for y in ("block", "allow"):
                if fits.count(y) >= math.ceil(support * n) and fits.count(y) / len(fits) >= confidence:
                    rules[part, y] = fits.count(y) / len(fits)
    kept = {k: c for k, c in rules.items() if not any(rules.get((tuple(x for x in k[0] if x != t), k[1]), -1) >= c for t in k[0])}
    got = {(tuple(r.antecedent), r.verdict): r.confidence for r in url_rules.mine(
        spark.createDataFrame(labelled, "tokens array<string>, label string"), support, confidence).collect()}
    assert got.keys() == kept.keys() and all(got[k] == pytest.approx(kept[k]) for k in kept)
    urls = spark.createDataFrame([("u1", ["a", "b", "z"]), ("u2", ["c"]), ("u3", ["f"]), ("u4", [])], "url string, tokens array<string>")
    mined = url_rules.mine(spark.createDataFrame(labelled, "tokens array<string>, label string"), support, confidence)
    found = {r.url: r.mined_verdict for r in url_rules.match(urls, mined).collect()}
    for url, tokens in (("u1", "abz"), ("u2", "c"), ("u3", "f"), ("u4", "")):
        fits = sorted((-c, y) for (part, y), c in kept.items() if set(part) <= set(tokens))
        assert found.get(url) == (fits[0][1] if fits else None)
    assert url_rules.mine(spark.createDataFrame([], "tokens array<string>, label string")).count() == 0


def test_mined_rules_count_all_tokens(spark):
    """A hot source whose URLs have far more than 12 frequent tokens, some of them also elsewhere: all sets of up
    to three tokens by brute force, larger ones by counting each."""
    from itertools import combinations
    rnd = np.random.default_rng(2)
    hot = [f"h{i:02}" for i in range(24)]
    labelled = []
    for i in range(300):
        tokens = {str(t) for t in rnd.choice(list("abcdef"), rnd.integers(1, 5))}
        tokens |= set(hot) if i % 3 == 0 else {str(t) for t in rnd.choice(hot[:8], 2)}
        bad = ("a" in tokens and "b" in tokens) or "f" in tokens
        labelled.append((sorted(tokens), "block" if bad ^ (rnd.random() < 0.02) else "allow"))
    n, support, confidence = len(labelled), 0.05, 0.9
    names = [*"abcdef", *hot]
    holds = {t: np.array([t in tokens for tokens, _ in labelled]) for t in names}
    labels = np.array([y for _, y in labelled])
    def counted(part, y):
        fits = np.logical_and.reduce([holds[t] for t in part])
        return int((fits & (labels == y)).sum()), int(fits.sum())
    rules = {}
    for size in range(1, 4):
        for part in combinations(names, size):
            for y in ("block", "allow"):
                hits, total = counted(part, y)
                if hits >= math.ceil(support * n) and hits / total >= confidence:
                    rules[part, y] = hits / total
    kept = {k: c for k, c in rules.items() if not any(rules.get((tuple(x for x in k[0] if x != t), k[1]), -1) >= c for t in k[0])}
    got = {(tuple(r.antecedent), r.verdict): r for r in url_rules.mine(
        spark.createDataFrame(labelled, "tokens array<string>, label string"), support, confidence).collect()}
    assert {k for k in got if len(k[0]) <= 3} == kept.keys()
    assert any(t.startswith("h") for part, _ in kept for t in part)
    for (part, y), r in got.items():
        hits, total = counted(part, y)
        assert r.confidence == pytest.approx(hits / total) and r.support == pytest.approx(hits / n)
        assert hits >= support * n and r.confidence >= confidence
        assert r.anchor == min(part, key=lambda t: (holds[t].sum(), t))


def test_independent_tokens_end_soon(spark):
    """16 tokens that come and go by themselves in 3,000 rows: some 67,000 sets reach the support."""
    import time
    rnd = np.random.default_rng(3)
    held = rnd.random((3000, 16)) < 0.5
    labelled = [([f"t{j:02}" for j in np.nonzero(h)[0]], "block" if h[0] and h[1] and h[2] else "allow") for h in held]
    began = time.time()
    rules = url_rules.mine(spark.createDataFrame(labelled, "tokens array<string>, label string"), 0.005, 0.9).collect()
    assert time.time() - began < 60
    assert {tuple(r.antecedent) for r in rules if r.verdict == "block"} == {("t00", "t01", "t02")}


def test_null_tokens_and_labels(spark):
    rows_ = [(["a", None, "a"], "block")] * 6 + [(["a", "b"], None)] * 2 + [(None, "allow")] * 2 + [([], "allow")]
    rules = url_rules.mine(spark.createDataFrame(rows_, "tokens array<string>, label string"), 0.1, 0.5).collect()
    assert [(r.antecedent, r.verdict, r.confidence, r.anchor) for r in rules] == [(["a"], "block", 0.75, "a")]


def test_url_filters_stay_in_the_jvm(spark):
    plan = url_rules.judge(spark.read.parquet(f"{DATA}/pages.parquet"), URL_RULES)._jdf.queryExecution().toString()
    assert not __import__("re").search("Python|Arrow|Pandas", plan)


# -- archives -----------------------------------------------------------------------

PAGES = [(5, "http://a/1", "x" * 150), (3, "http://a/2\n%", "x" * 150), (9, None, "x" * 150), (4, "u", "short"), (2, "u", "short"), (7, "u", None), (8, "u", ""), (None, "u", "x" * 150),
         (3, "http://a/2\n%", "x" * 150), (11, "é", "é" * 50), (12, "é", "é" * 50), (13, "u", "é" * 49), (14, "u", "big " * 100_000)]


def test_archive_round_trip(spark, tmp_path):
    import hashlib
    pages = spark.createDataFrame([(*p, 0) for p in PAGES], "page_id bigint, url string, html string, digest int")
    place = f"file://{tmp_path}/a"
    manifest = warc.write(pages, place, roll_bytes=300, shard_rows=2)
    back = warc.read(spark, place, payloads=True).collect()
    first = {}
    for i, _, h in PAGES:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(first.get(h, i), i)
    want = []
    for i, u, h in PAGES:
        body = (h or "").encode()
        revisit = i is not None and h in first and first[h] != i
        want.append((i, u, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", first[h] if revisit else None, None if revisit else body))
    assert sorted(repr((r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload))) for r in back) == sorted(map(repr, want))
    files = {r.file: r.sha256 for r in manifest.collect()}
    on_disk = {p.name: p for p in Path(f"{tmp_path}/a/records").iterdir() if not p.name.endswith(".crc")}
    assert set(files) == set(on_disk) and len(files) > 3
    for name, path in on_disk.items():
        assert hashlib.sha256(path.read_bytes()).hexdigest() == files[name]
        assert gzip.decompress(path.read_bytes()).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
    again = warc.write(pages.repartition(3), f"file://{tmp_path}/b", roll_bytes=300, shard_rows=2)
    assert {r.file: r.sha256 for r in again.collect()} == files


def test_hot_and_null_ids_are_split(spark, tmp_path):
    """A third of the rows under one id, a third without: no shard has more than twice the mean."""
    pages = spark.range(6000).selectExpr("CASE WHEN id % 3 = 0 THEN -7 WHEN id % 3 = 1 THEN id END AS page_id", "'u' AS url", "concat('page ', id) AS html")
    manifest = warc.write(pages, f"file://{tmp_path}", shard_rows=300).collect()
    by_shard = defaultdict(int)
    for r in manifest:
        by_shard[r.shard] += r.records
    assert len(by_shard) == 20 and sum(by_shard.values()) == 6000 and max(by_shard.values()) <= 600
    assert warc.read(spark, f"file://{tmp_path}").where("page_id = -7").count() == 2000


def test_an_attempt_that_dies_between_write_and_commit(spark, tmp_path, monkeypatch):
    """Files of a first attempt stand there whole, temporary or torn: the second one's manifest names whole files."""
    pages = spark.createDataFrame([p for p in PAGES if p[0]], "page_id bigint, url string, html string")
    place = f"file://{tmp_path}/a"
    whole = {r.file for r in warc.write(pages, place, shard_rows=4).collect()}
    records = Path(f"{tmp_path}/b/records")
    records.mkdir(parents=True)
    for i, name in enumerate(sorted(whole)):
        body = Path(f"{tmp_path}/a/records/{name}").read_bytes()
        if i % 2:
            (records / name).write_bytes(body)  # renamed before the attempt died
        else:
            (records / f".{name}.0-0.tmp").write_bytes(body[:99])
    manifest = warc.write(pages, f"file://{tmp_path}/b", shard_rows=4)
    assert {r.file for r in manifest.collect()} == whole
    assert sorted(map(repr, warc.read(spark, f"file://{tmp_path}/b").collect())) == sorted(map(repr, warc.read(spark, place).collect()))


def test_files_without_a_manifest_entry_do_not_count(spark, tmp_path):
    pages = spark.createDataFrame([p for p in PAGES if p[0]], "page_id bigint, url string, html string")
    warc.write(pages, f"file://{tmp_path}")
    Path(f"{tmp_path}/records/.part-000000-00000.warc.gz.9-9.tmp").write_bytes(b"torn")
    Path(f"{tmp_path}/records/part-000099-00000.warc.gz").write_bytes(b"torn")
    assert warc.read(spark, f"file://{tmp_path}").count() == pages.count()


def test_empty_archive(spark, tmp_path):
    none = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.archived(none, f"file://{tmp_path}").count() == 0
