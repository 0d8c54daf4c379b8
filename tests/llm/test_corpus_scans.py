"""Token counts, secrets and licences against plain versions."""

import hashlib
import re

import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from bizmetrics.llm import bpe_count, license_scan, secret_scan
from bizmetrics.llm.license_texts import TEMPLATES
from conftest import DATA, rows

BPE = public_tokenizers.path("byte_bpe_50k.json")
HARD = ["", None, " ", "a", "aaaaaaaa" * 50, "x" * 50_000, "don't  stop\n\n\t now ", "ünïcödé ẞ ﬁ 日本語 \U0001F600\U0001F600", "<|endoftext|>a<|endoftext|><|endoftext|>",
        "\u00a0\u2003\x1c\x85 \u3000x", "12³४ 1,000.5", "word " * 60_000]
SCHEMA = "doc_id bigint, text string, source string, lang string, key int, spans int, `n_tokens` int"


def frame(spark, texts, sources=None):
    return spark.createDataFrame([(i if i != 3 else None, t, (sources or ["s"] * len(texts))[i], "en", 0, 0, 0) for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(BPE)


def test_token_counts(spark, tokenizer):
    texts = HARD + HARD[-2:] + [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = bpe_count.token_counts(frame(spark, texts), BPE, limit=512).collect()
    want = [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert [r.n_tokens for r in got] == want
    assert [r.n_bytes for r in got] == [len((t or "").encode()) for t in texts]
    assert [r.over_limit for r in got] == [n > 512 for n in want]
    assert got[3].doc_id is None
    assert bpe_count.token_counts(frame(spark, []), BPE).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(), max_size=6))
def test_any_text_is_counted_as_the_library_does(tokenizer, texts):
    assert bpe_count.counter(BPE).count(texts).tolist() == [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]


def test_pieces_of_long_texts_and_a_full_memory(tokenizer, monkeypatch):
    monkeypatch.setattr(bpe_count, "BATCH", 7)
    monkeypatch.setattr(bpe_count, "REMEMBERED", 20)
    texts = [t or "" for t in HARD[:10]] + ["some words of text, and more: " * 9]
    assert bpe_count.Counter(BPE).count(texts).tolist() == [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]


# -- secrets ------------------------------------------------------------------------

HEX40 = "0641917ea4e9feb9cda83477b57ac2654884f485"
SECRETS = [
    None, "", "token=abc password=abcdefghijkl", 'API-key "token" : "abcDEF123+/=.-_x"', "x" + "AKIA" + "Z" * 14 + "a AKIAB", f"hash {HEX40}g {HEX40[:15]}",
    "secretoken = aaaaaaaaaaaaaaaa", 'token=api_key"="long1234567890', f"é日 password={HEX40} {HEX40}", "ſecret=abcdefghijklmnop toKen:qwertyuiopas",
    "passwordpasswd  :=  abcdefghijklm", "Zm9vYmFyL2Jhc2U2NC9zdHJpbmc0NTY3 and AKIA" + "0" * 30, "plain text " * 20_000 + f"token={HEX40}",
]


def plain_base(text):
    assign = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def listed(spans):
    return ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in spans)


def test_base_spans(spark):
    texts = SECRETS + SECRETS[-1:] + [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = secret_scan.secrets(frame(spark, texts), F.col("source"), F.col("lang")).collect()
    want = [plain_base(t or "") for t in texts]
    assert sum(map(bool, want)) > 10
    assert sorted(map(repr, ((r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got))) == sorted(
        repr((*[sum(k == i for _, k, _ in w) for i in range(3)], hashlib.sha256(listed(w).encode()).hexdigest())) for w in want)
    for r in got:
        kept = [x for x in r.spans.split(",") if x and not x.startswith("entropy")]
        assert hashlib.sha256(",".join(kept).encode()).hexdigest() == r.base_sha256
    assert secret_scan.secrets(frame(spark, []), F.col("source"), F.col("lang")).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["token", "api_key", "Secret", "passwd", "password", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGHIJKLMN", "0123456789abcdef", "x", "é", "ſ"]), max_size=12))
def test_base_spans_of_any_text(parts):
    text = "".join(parts)
    assert sorted(s[:3] for s in secret_scan.base_spans(text)) == plain_base(text)


def test_who_has_it_decides(spark):
    copied, own = "token=" + "a1" * 10, "token=" + "b2" * 10
    extra, spread = "Qx7Zk29vLmP0aR5tYw8eUi3o", "Zm9vYmFyL2Jhc2U2NC9zdHJp"
    texts = [f"{copied} and {spread}"] * 6 + [f"{own} then {extra}"] * 3 + [None]
    sources = ["o1", "o2", "o3", "o4", "o5", None] + ["o1"] * 3 + ["o1"]
    docs = frame(spark, texts, sources)
    got = {r.doc_id: r for r in secret_scan.secrets(docs, F.col("source"), F.col("lang")).where("doc_id is not null").collect()}
    assert (got[0].n_live, got[0].n_example, "entropy" in got[0].spans) == (0, 2, False)  # assigned, and a hexadecimal run
    assert (got[7].n_live, got[7].n_example, "entropy" in got[7].spans) == (3, 0, True)
    cut = secret_scan.recounted(secret_scan.redact(docs, F.col("source"), F.col("lang")))
    assert cut.columns == docs.columns and cut.count() == len(texts)
    after = {r.doc_id: r.text for r in cut.collect()}
    assert after[0] == texts[0] and after[7] == "[SECRET] then [SECRET]" and after[9] is None


def test_overlapping_spans_are_cut_once():
    assert secret_scan._without("ab token=123 cd", [3, 9, 13], [12, 12, 15], "#") == "ab # #"


# -- licences -----------------------------------------------------------------------

def plain_licences(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    starts, labels = [], set()
    for phrase, label in (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")):
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i:i + len(p)] == p]
        starts += at
        labels |= {label} if at else set()
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


NOTICES = [" ".join(["word"] * 50 + [notice] + ["End"] * 9) for notice, _ in TEMPLATES.values()]


def test_licences(spark):
    texts = [None, "", "CC BY-NC cc\nby CC BY cc by", "MIT-License mit licenseé", "the gnu general\tpublic license, Apache License", *NOTICES,
             "free of charge " * 30_000, NOTICES[0].replace("furnish", "x"), NOTICES[0]]
    texts += [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = license_scan.licenses(frame(spark, texts)).collect()
    assert [(r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got] == [plain_licences(t) for t in texts]
    for r, label in zip(got[5:], TEMPLATES):
        assert label in r.labels.split(",") and r.score == 1.0
    for r in got:
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
        assert r.labels == ",".join(sorted(set(r.labels.split(","))))
    assert got[0].labels == "" and got[0].score == 0
    assert license_scan.licenses(frame(spark, [])).count() == 0


def test_mandatory_phrases_and_place():
    rare = license_scan.index((), 10)
    notice = TEMPLATES["isc"][0]
    assert license_scan.matches(license_scan.words_of("a b " + notice), rare).keys() == {"isc"}
    assert not license_scan.matches(license_scan.words_of(notice.replace("without fee", "for money")), rare)
    scattered = " and then something quite different came up ".join(notice.split())
    assert not license_scan.matches(license_scan.words_of(scattered), rare)


@pytest.mark.parametrize("change", [{"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}},
                                    {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "use_regex": True}}])
def test_vocabularies_of_another_split_are_refused(tmp_path, change):
    import json
    given = {"model": {"vocab": {}, "merges": []}, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False}}
    (path := tmp_path / "other.json").write_text(json.dumps(given | change))
    with pytest.raises(ValueError, match="byte-level"):
        bpe_count.Counter(str(path))
