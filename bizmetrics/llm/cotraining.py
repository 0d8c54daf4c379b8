"""Quality classifier by co-training over two views of a document: its text and its metadata.

Each view has a logistic regression of its own. In each round either view scores all documents
without a label, and the ones it is surest of are handed, with its verdict, to the other view's
training rows. At the end each view is calibrated on labelled rows neither was trained on, and
the calibrated views are combined, weighted by how well they separate those rows.

The features of all documents are made once and stored. Models are fitted on the driver from a
bounded sample (``LABELLED`` rows, and ``PSEUDO`` a round); scoring runs where the rows are.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from bizmetrics.llm.common import keep_keys, row_key, ship, sized
from bizmetrics.session import cut_lineage

#: Labelled rows that models are fitted and calibrated on, the rows of smallest hash: a documented bound.
LABELLED = 12_000
#: Pseudo-labelled rows a view hands over in a round, half of each class at most, and how sure it must be.
PSEUDO, SURE = 1_000, 0.95
ROUNDS = 2
#: One labelled row of so many is kept for the calibration.
HELD_OUT = 4
#: Hash spaces of the two views. The first text features are shares, not words.
TEXT_DIM, META_DIM, SHARES = 4096, 512, 8

#: Rows whose features are unpacked at once.
UNPACKED = 256

_CLASS = bytes(0x41 if 0x41 <= b <= 0x5A else 0x61 if 0x61 <= b <= 0x7A or b >= 0x80 else 0x30 if 0x30 <= b <= 0x39 else b for b in range(256))
_LETTER = bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100)) + b" \t\r\n\v\f"


def text_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values: shares of capitals, digits, signs, repeated words and lines, and hashed words and word
    shapes, of unit length together."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = len(words) or 1, len(raw) or 1
    shapes = raw.translate(_CLASS)
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    shares = [shapes.count(b"A") / size, shapes.count(b"0") / size, len(shapes.translate(None, _LETTER + b"0")) / size,
              1 - len(counts) / n, max(counts.values(), default=0) / n, 1 - len(set(lines)) / (len(lines) or 1),
              min(size / n / 20, 1.0), 1.0 if not words else 0.0]
    tally: Counter[int] = Counter()
    for word, c in counts.items():
        tally[SHARES + zlib.crc32(word.lower()) % (TEXT_DIM - SHARES)] += c
    for shape, c in Counter([w[:2] + w[-3:] for w in shapes.split()]).items():
        tally[SHARES + zlib.crc32(b"\x00" + shape) % (TEXT_DIM - SHARES)] += 2 * c
    index = np.fromiter(tally.keys(), np.int64, len(tally))
    value = np.sqrt(np.fromiter(tally.values(), np.float64, len(tally)) / n)
    value /= np.sqrt((value ** 2).sum()) or 1.0
    return np.r_[np.arange(SHARES), index], np.r_[np.array(shares) * 2, value]


def meta_features(values: list[str | None]) -> np.ndarray:
    """Each metadata value as an index; a null is a value of its own."""
    return np.array([zlib.crc32(f"{i}={v}".encode()) % META_DIM for i, v in enumerate(values)], np.int64)


def _packed(index: np.ndarray, value: np.ndarray) -> bytes:
    return index.astype("<u2").tobytes() + value.astype("<f2").tobytes()


def _unpacked(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, indices and values of packed features."""
    sizes = [len(r) // 4 for r in rows]
    index = [np.frombuffer(r, "<u2", n) for r, n in zip(rows, sizes)]
    value = [np.frombuffer(r, "<f2", n, offset=2 * n) for r, n in zip(rows, sizes)]
    row = np.repeat(np.arange(len(rows)), sizes)
    if not rows:
        return row, np.empty(0, np.int64), np.empty(0)
    return row, np.concatenate(index).astype(np.int64), np.concatenate(value).astype(np.float64)


@dataclass
class View:
    """A logistic regression over packed features, with a scale and a shift from its calibration."""
    column: str
    weights: np.ndarray
    bias: float = 0.0
    scale: float = 1.0
    shift: float = 0.0

    def logits(self, rows: list[bytes]) -> np.ndarray:
        sums = [np.empty(0)]
        for at in range(0, len(rows), UNPACKED):
            row, index, value = _unpacked(rows[at:at + UNPACKED])
            sums.append(np.bincount(row, value * self.weights[index], minlength=len(rows[at:at + UNPACKED])))
        return self.scale * (np.concatenate(sums) + self.bias) + self.shift


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(column: str, dim: int, rows: list[bytes], labels: np.ndarray, steps: int = 150, rate: float = 0.5, decay: float = 1e-5) -> View:
    """Logistic regression by full-batch Adam, from zero weights; both classes weigh the same."""
    row, index, value = _unpacked(rows)
    y = labels.astype(np.float64)
    weight = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    theta = np.zeros(dim + 1)
    first, second = np.zeros(dim + 1), np.zeros(dim + 1)
    for step in range(1, steps + 1):
        z = np.bincount(row, value * theta[index], minlength=len(rows)) + theta[dim]
        error = (_sigmoid(z) - y) * weight
        slope = np.r_[np.bincount(index, value * error[row], minlength=dim) + decay * theta[:dim], error.sum()]
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope ** 2
        theta -= rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
    return View(column, theta[:dim], float(theta[dim]))


def calibrate(view: View, rows: list[bytes], labels: np.ndarray) -> None:
    """Platt's scaling, on rows the view was not fitted on, in their own class shares."""
    z, y = view.logits(rows), labels.astype(np.float64)
    if len(set(labels.tolist())) < 2:
        return
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    def loss(a: float, b: float) -> float:
        u = a * z + b
        return float((np.logaddexp(0, u) - target * u).sum() + 5e-4 * (a - 1) ** 2)

    a, b = 1.0, 0.0
    for _ in range(100):  # Newton's steps on two numbers, halved until they lead down
        p = _sigmoid(a * z + b)
        w = p * (1 - p) + 1e-9
        g = np.array([((p - target) * z).sum() + 1e-3 * (a - 1), (p - target).sum()])
        h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-6]])
        move = np.linalg.solve(h, g)
        while loss(a - move[0], b - move[1]) > loss(a, b) and np.abs(move).max() > 1e-9:
            move /= 2
        a, b = a - move[0], b - move[1]
        if np.abs(move).max() < 1e-7:
            break
    view.scale, view.shift = max(float(a), 0.0), float(b)


def _auc(score: np.ndarray, labels: np.ndarray) -> float:
    good, bad = score[labels > 0], score[labels <= 0]
    if not len(good) or not len(bad):
        return 0.5
    ordered = np.sort(bad)
    return float((np.searchsorted(ordered, good) + np.searchsorted(ordered, good, "right")).mean() / 2 / len(bad))


@dataclass
class CoTrained:
    text: View
    meta: View
    prior: float
    share: float  # the text view's weight

    def scores(self, text: list[bytes], meta: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.text.logits(text), self.meta.logits(meta)
        return _sigmoid(a), _sigmoid(b), _sigmoid(self.prior + self.share * (a - self.prior) + (1 - self.share) * (b - self.prior))


def featured(docs: DataFrame, meta: list[Column], id_col: str, text_col: str) -> DataFrame:
    """Stored rows (key, doc_id, text, meta): the packed features of the two views."""
    ship(docs.sparkSession)
    kind = pa.struct([("text", pa.binary()), ("meta", pa.binary())])

    @F.arrow_udf("struct<text:binary,meta:binary>")
    def features(texts: pa.Array, metas: pa.Array) -> pa.Array:
        rows = []
        for text, values in zip(texts, metas.to_pylist()):
            index = meta_features(values)
            rows.append({"text": _packed(*text_features(text.as_py())), "meta": _packed(index, np.ones(len(index)))})
        return pa.array(rows, kind)

    work = docs.select(row_key(id_col, text_col).alias("key"), F.col(f"`{id_col}`").alias("doc_id"),
                       F.col(f"`{text_col}`").alias("text"), F.array(*[c.cast("string") for c in meta]).alias("meta"))
    made = work.select("key", "doc_id", features(F.coalesce("text", F.lit("")), "meta").alias("f"))
    return cut_lineage(made.select("key", "doc_id", F.col("f.text").alias("text"), F.col("f.meta").alias("meta")))


def _scored(rows: DataFrame, column: str, view: View) -> Column:
    @F.arrow_udf("double")
    def score(packed: pa.Array) -> pa.Array:
        return pa.array(_sigmoid(view.logits(packed.to_pylist())))

    return score(column)


def train(rows: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", rounds: int = ROUNDS,
          bound: int = LABELLED, pseudo: int = PSEUDO) -> CoTrained | None:
    """Fit on ``labels`` (an id and 0 or 1). An id with a null, another value or contradicting labels is not used.
    Without a row of each class there is no model. Repeated rows count once, everywhere."""
    known = (labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("y"))
             .where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("most"))
             .where((F.col("y") == F.col("most")) & F.col("y").isin(0, 1)).select("doc_id", "y"))
    # Half of the bound for each class, by hash; repeated rows count once, before the bound.
    half = lambda df, by: reduce(DataFrame.unionByName, [df.where(F.col("y") == y).orderBy(*by).limit(max(1, bound // 2)) for y in (0, 1)])
    chosen = sized(half(known, (F.xxhash64("doc_id"), "doc_id")))
    different = rows.join(chosen, "doc_id").groupBy("key").agg(F.min(F.struct("text", "meta", "y")).alias("row")).select("key", "row.*")
    fitted = sorted(half(different, (F.xxhash64("key"), "key")).collect(), key=lambda r: r["key"])
    held = [r for r in fitted if int(r["key"][:8], 16) % HELD_OUT == 0]
    used = [r for r in fitted if int(r["key"][:8], 16) % HELD_OUT]
    if len({r["y"] for r in used}) < 2:
        return None
    pools = {"text": [(bytes(r["text"]), r["y"]) for r in used], "meta": [(bytes(r["meta"]), r["y"]) for r in used]}
    dims = {"text": TEXT_DIM, "meta": META_DIM}
    refit = lambda v: fit(v, dims[v], [x for x, _ in pools[v]], np.array([y for _, y in pools[v]]))
    views = {v: refit(v) for v in pools}
    unlabelled = rows.join(sized(known.select("doc_id")), "doc_id", "left_anti")
    handed: set[str] = set()
    y_held = np.array([r["y"] for r in held])
    for _ in range(rounds):
        for v in views:
            calibrate(views[v], [bytes(r[v]) for r in held], y_held)
        scored = unlabelled.select("key", *[_scored(unlabelled, v, views[v]).alias(f"p_{v}") for v in views])
        both = cut_lineage(scored.groupBy("key").agg(*[F.max(f"p_{v}").alias(f"p_{v}") for v in views]))
        picked = [both.where(sure >= SURE).orderBy(F.desc(sure), "key").limit(pseudo // 2).select("key", F.lit(other).alias("other"), F.lit(label).alias("label"))
                  for v, other in (("text", "meta"), ("meta", "text"))
                  for label, sure in ((1, F.col(f"p_{v}")), (0, 1 - F.col(f"p_{v}")))]
        best = sized(reduce(DataFrame.unionByName, picked))  # 2 ``pseudo`` rows at most
        own = unlabelled.join(best, "key").groupBy("key", "other", "label").agg(F.min(F.struct("text", "meta")).alias("row"))
        for r in sorted(own.collect(), key=lambda r: (r["other"], r["key"], r["label"])):
            if f"{r['other']}{r['key']}" not in handed:
                pools[r["other"]].append((bytes(r["row"][r["other"]]), r["label"]))
                handed.add(f"{r['other']}{r['key']}")
        views = {v: refit(v) for v in pools}
    for v in views:
        calibrate(views[v], [bytes(r[v]) for r in held], y_held)
    apart = {v: max(_auc(views[v].logits([bytes(r[v]) for r in held]), y_held) - 0.5, 0.0) for v in views}
    share = (apart["text"] + 1e-6) / (apart["text"] + apart["meta"] + 2e-6)
    good = (y_held.sum() + 1) / (len(y_held) + 2)
    return CoTrained(views["text"], views["meta"], float(np.log(good / (1 - good))), share)


def quality(docs: DataFrame, labels: DataFrame, meta: list[Column], least: float = 0.5, id_col: str = "doc_id", text_col: str = "text",
            **training) -> DataFrame:
    """One row per row of ``docs``: ``key`` (see ``row_key``), ``doc_id``, ``text_score`` and ``meta_score`` (each view's
    calibrated probability that the document is good), ``score`` (both together) and ``kept`` (``score`` is at
    least ``least``).

    Null or empty texts and null metadata are features like any other. Repeated rows score alike. Without usable
    labels of both classes scores are null and everything is kept; empty documents give no rows.
    """
    rows = featured(docs, meta, id_col, text_col)
    model = train(rows, labels, **training)
    if model is None:
        nothing = F.lit(None).cast("double")
        return rows.select("key", "doc_id", nothing.alias("text_score"), nothing.alias("meta_score"), nothing.alias("score"), F.lit(True).alias("kept"))
    kind = pa.struct([(n, pa.float64()) for n in ("text_score", "meta_score", "score")])

    @F.arrow_udf("struct<text_score:double,meta_score:double,score:double>")
    def scores(text: pa.Array, meta: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(x) for x in model.scores(text.to_pylist(), meta.to_pylist())], fields=list(kind))

    return rows.select("key", "doc_id", scores("text", "meta").alias("s")).select("key", "doc_id", "s.*", (F.col("s.score") >= least).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, meta: list[Column], least: float = 0.5, id_col: str = "doc_id", text_col: str = "text",
              **training) -> DataFrame:
    """``docs`` without the rows the classifier rejects; all columns are kept. Nulls, empty and long texts, repeated rows and
    missing labels are judged as by ``quality``: rows with the same id and text go or stay together, ties at ``least`` stay,
    an empty table stays empty."""
    judged = quality(docs, labels, meta, least, id_col, text_col, **training)
    rejected = judged.where(~F.col("kept")).select("key").distinct()
    return keep_keys(docs, sized(rejected), id_col, text_col, drop=True)
