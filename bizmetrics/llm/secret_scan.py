"""Secret scans: candidate credentials, judged by who else in the corpus has them.

Every text is scanned for candidates. Their hashes are aggregated over the corpus by distinct
repositories and owners: a value that many owners have is an example that was copied around,
one that few have looks like a live credential. Values themselves leave no task, only hashes.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from bizmetrics.llm.common import row_key, ship, sized, spare
from bizmetrics.session import cut_lineage

#: The base patterns. In a listed order, which breaks ties between spans.
KINDS = ["assign", "access", "hex", "entropy"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGNED = 12
#: The method's own kind: long runs of mixed letters and digits of high entropy.
ENTROPY = re.compile(r"[A-Za-z0-9+/_-]{20,}")
LEAST_BITS = 3.5

_KEYWORD = re.compile("password|passwd|secret|token|api_?key")
_RUN_OF = {
    "hex": (bytes(1 if chr(b) in "0123456789abcdef" else 0 for b in range(256)), b"\x01" * 16),
    "entropy": (bytes(1 if chr(b).isalnum() and b < 128 or chr(b) in "+/_-" else 0 for b in range(256)), b"\x01" * 20),
}

Span = tuple[int, int, int, str]  # start, kind's number, end, value


def _has_run(raw: bytes, kind: str) -> bool:
    table, run = _RUN_OF[kind]
    return run in raw.translate(table)


def base_spans(text: str) -> Iterator[Span]:
    raw = text.encode("utf-8", "surrogatepass")
    low, at = raw.lower().decode("utf-8", "surrogatepass"), 0
    while word := _KEYWORD.search(low, at):
        found = ASSIGN.match(text, word.start())
        at = found.end() if found else word.start() + 1
        if found and len(found[2]) >= LEAST_ASSIGNED:
            yield found.start(), 0, found.end(), found[2]
    if "AKIA" in text:
        for found in ACCESS.finditer(text):
            yield found.start(), 1, found.end(), found[0]
    if _has_run(raw, "hex"):
        for found in HEX.finditer(text):
            yield found.start(), 2, found.end(), found[0]


def bits_per_letter(value: str) -> float:
    counts = Counter(value).values()
    return -sum(n / len(value) * math.log2(n / len(value)) for n in counts)


def further_spans(text: str, base: list[Span]) -> Iterator[Span]:
    """Runs of high entropy, with a digit and a letter, that touch no base span."""
    if not _has_run(text.encode("utf-8", "surrogatepass"), "entropy"):
        return
    taken = sorted((s, e) for s, _, e, _ in base)
    i = reach = 0
    for found in ENTROPY.finditer(text):
        start, end = found.span()
        while i < len(taken) and taken[i][0] < end:
            reach, i = max(reach, taken[i][1]), i + 1
        value = found[0]
        if reach <= start and any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and bits_per_letter(value) >= LEAST_BITS:
            yield start, 3, end, value


def scan(text: str) -> list[Span]:
    base = list(base_spans(text))
    return sorted([*base, *further_spans(text, base)])


SPANS = "array<struct<kind:int,start:bigint,stop:bigint,hash:string>>"


def spans_of(text: Column) -> Column:
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("stop", pa.int64()), ("hash", pa.string())]))

    @F.arrow_udf(SPANS)
    def found(texts: pa.Array) -> pa.Array:
        return pa.array([[{"kind": k, "start": s, "stop": e, "hash": hashlib.sha256(v.encode("utf-8", "surrogatepass")).hexdigest()}
                          for s, k, e, v in scan(t.as_py() or "")] for t in texts], kind)

    return found(text)


def ownership(candidates: DataFrame) -> DataFrame:
    """From rows (hash, repository, owner): each hash with its distinct repositories and owners.
    Distinct values are folded before the shuffle, so a value that is everywhere costs no more
    than its owners. A null repository or owner counts as one of its own."""
    seen = candidates.select("hash", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias(c)
                                       for c in ("repository", "owner")]).distinct()
    return seen.groupBy("hash").agg(F.count_distinct("repository").alias("n_repositories"),
                                    F.count_distinct("owner").alias("n_owners"))


def _judged(docs: DataFrame, owner: Column, repository: Column, least_owners: int, least_repositories: int,
            id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Stored scan rows (key, doc_id, spans), and per key of a text with candidates its judged spans."""
    ship(docs.sparkSession)
    work = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"),
                       owner.alias("owner"), repository.alias("repository")).withColumn("key", row_key())
    rows = cut_lineage(work.select("key", "doc_id", "owner", "repository", spans_of(F.col("text")).alias("spans")))
    each = rows.where(F.size("spans") > 0).select("key", "owner", "repository", F.explode("spans").alias("s"))
    each = each.select("key", "owner", "repository", "s.*")
    known = ownership(each).select("hash", ((F.col("n_owners") >= least_owners) | (F.col("n_repositories") >= least_repositories)).alias("example"))
    # Repeated rows have the same spans: one set per key.
    spans = each.select("key", "kind", "start", "stop", "hash").distinct().join(known, "hash")
    judged = spans.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "stop", "example"))).alias("spans"))
    return rows, judged


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def secrets(docs: DataFrame, owner: Column, repository: Column, least_owners: int = 4, least_repositories: int = 6,
            id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``; ``n_assign``, ``n_access``, ``n_hex``, the base spans of each kind;
    ``base_sha256``, the digest of the base spans listed as ``kind:start:stop``; ``spans``, the list of all spans,
    with the method's own (kind entropy, only owner-specific ones); ``n_live`` and ``n_example``: of all spans
    listed, those that few have, and those that at least ``least_owners`` owners or ``least_repositories``
    repositories have. Positions are code points, the end excluded.

    A null or empty text has no spans: counts 0, an empty list and its digest. Repeated rows each get their row,
    but add nothing to the number of owners. Empty tables give no rows.
    """
    rows, judged = _judged(docs, owner, repository, least_owners, least_repositories, id_col, text_col)
    listed = judged.select("key", F.filter("spans", lambda s: (s["kind"] < 3) | ~s["example"]).alias("found"))
    with_all = rows.select("key", "doc_id").join(listed, "key", "left").withColumn(
        "found", F.coalesce("found", F.array().cast("array<struct<start:bigint,kind:int,stop:bigint,example:boolean>>")))
    base = F.filter("found", lambda s: s["kind"] < 3)

    def count(test) -> Column:
        return F.size(F.filter("found", lambda s: test(s))).cast("bigint")

    def of_kind(i: int):
        return lambda s: s["kind"] == i

    return with_all.select(
        "doc_id", *[count(of_kind(i)).alias(f"n_{name}") for i, name in enumerate(KINDS[:3])],
        F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"),
        count(lambda s: ~s["example"]).alias("n_live"), count(lambda s: s["example"]).alias("n_example"))


def redact(docs: DataFrame, owner: Column, repository: Column, least_owners: int = 4, least_repositories: int = 6,
           mark: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span that looks live replaced by ``mark``, overlapping spans by one; widely copied
    examples stay as they are, and so do all rows and other columns. A null text stays null."""
    _, judged = _judged(docs, owner, repository, least_owners, least_repositories, id_col, text_col)
    key, starts, stops = (spare(docs, c) for c in ("row_key", "span_starts", "span_stops"))
    live = judged.select(F.col("key").alias(key), F.filter("spans", lambda s: ~s["example"]).alias("s")).where(F.size("s") > 0).select(
        key, F.transform("s", lambda s: s["start"]).alias(starts), F.transform("s", lambda s: s["stop"]).alias(stops))
    live = sized(live, 2 * F.size(starts) + 1)

    @F.arrow_udf("string")
    def cut(texts: pa.Array, starts: pa.Array, stops: pa.Array) -> pa.Array:
        return pa.array(map(_without, texts.to_pylist(), starts.to_pylist(), stops.to_pylist(), [mark] * len(texts)), pa.string())

    keyed = docs.withColumn(key, row_key(id_col, text_col)).join(live, key, "left")
    text, hit = F.col(f"`{text_col}`"), F.col(starts).isNotNull()
    changed = F.when(hit, cut(F.when(hit, text), starts, stops)).otherwise(text)
    return keyed.withColumn(text_col, changed).select([F.col(f"`{c}`") for c in docs.columns])


def recounted(docs: DataFrame, text_col: str = "text", count_col: str = "n_chars") -> DataFrame:
    """``docs`` with the count of letters brought up to date, where there is such a column."""
    if count_col not in docs.columns:
        return docs
    kind = docs.schema[count_col].dataType
    return docs.withColumn(count_col, F.length(F.col(f"`{text_col}`")).cast(kind))


def _without(text: str | None, starts: list[int] | None, stops: list[int] | None, mark: str) -> str | None:
    if text is None or not starts:
        return text
    out, at, reach = [], 0, -1
    for start, stop in sorted(zip(starts, stops)):
        if start >= reach:
            out += [text[at:start], mark]
        reach = at = max(reach, stop)
    return "".join([*out, text[at:]])
