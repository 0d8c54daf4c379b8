"""URL filters: listed rules first, association rules for the rest.

The listed rules label the URLs they fit. Combinations of URL tokens are then mined for which
label they go with, by Spark's FP-growth over whole token sets; rules pruned by support, confidence and
redundancy judge the URLs no listed rule fits. They are matched by an inverted index: a rule is filed under its rarest token,
a URL looks up its tokens, and what is found is verified against the whole URL.

Everything is DataFrame expressions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from bizmetrics.llm.common import sized
from bizmetrics.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: Support and confidence a mined rule needs.
MIN_SUPPORT, MIN_CONFIDENCE = 0.005, 0.9


def host_of(url: Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(text, verdict) of the longest listed rule that fits; null where none does. Of rules of one
    length the first by text wins."""
    ordered = sorted(set(rules), key=lambda r: (-len(r.text), r.text, r.verdict))
    def pick(what):
        cases = [F.when(((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path)), F.lit(what(r)))
                 for r in ordered]
        return F.coalesce(*cases, F.lit(None).cast("string"))
    return pick(lambda r: r.text), pick(lambda r: r.verdict)


def tokens_of(url: Column) -> Column:
    """Different tokens of a whole URL: host labels and suffixes, path words, names in the query."""
    host, path = host_of(url), path_of(url)
    labels = F.array_remove(F.split(host, r"\."), "")
    suffixes = F.transform(labels, lambda _, i: F.concat(F.lit("host:"), F.array_join(F.slice(labels, i + 1, F.size(labels) - i), ".")))
    words = F.array_remove(F.split(F.lower(path), r"[^\p{L}\p{N}]+"), "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    names = F.array_remove(F.transform(F.split(query, "&"), lambda p: F.lower(F.regexp_extract(p, r"(?s)^([^=]*)", 1))), "")
    marked = lambda mark, parts: F.transform(parts, lambda p: F.concat(F.lit(mark), p))
    return F.array_sort(F.array_distinct(F.concat(suffixes, marked("path:", words), marked("query:", names))))


#: Stands before a label, to tell it from the tokens beside it in a basket.
LABEL = "\x00"


def _parted(sets: DataFrame) -> DataFrame:
    """Each set of tokens with each ``part`` of one token less."""
    return sets.select("*", F.explode(F.transform("antecedent", lambda t: F.array_remove("antecedent", t))).alias("part"))


def _itemsets(baskets: DataFrame, least: int, n: int) -> DataFrame:
    """(items, freq) of all sets that are in ``least`` of the ``n`` baskets or more, by FP-growth."""
    support = (least - 0.5) / n  # the learner rounds its product with n up
    found = FPGrowth(itemsCol="items", minSupport=support, numPartitions=int(baskets.sparkSession.conf.get("spark.sql.shuffle.partitions"))).fit(baskets)
    return cut_lineage(found.freqItemsets.select("items", "freq"))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """``labelled`` has ``tokens`` and ``label``. Returns rules: ``antecedent`` (sorted tokens), ``verdict``,
    ``confidence``, ``support`` and ``anchor``, the antecedent's rarest token. A rule is left out if another
    with one token less and the same verdict is at least as confident. Null tokens are no tokens, null labels no label of
    a rule. No labelled rows give no rules.

    Tokens rarer than ``min_support`` can't be in a rule. There are at most (tokens per URL) /
    ``min_support`` others, whatever the corpus holds: they are collected to restrict the mining.

    FP-growth counts the sets of all frequent tokens of all rows, each with and without its label. Tokens that stand in
    the very same rows are one item there, since a rule with two of them is redundant; rules are told for each of them
    afterwards. So tokens that come together cost no combinations. Sets of tokens that come and go by
    themselves are all counted, as many as reach ``min_support``.
    """
    schema = "antecedent array<string>, verdict string, confidence double, support double, anchor string"
    rows = cut_lineage(labelled.select(F.array_compact(F.coalesce("tokens", F.array().cast("array<string>"))).alias("tokens"),
                                       F.col("label").cast("string").alias("label"), F.monotonically_increasing_id().alias("row")))
    n = rows.count()
    least = max(1, math.ceil(min_support * n))
    # Two hashes of the rows a token stands in tell which tokens stand in the same ones.
    held = rows.select("row", F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("row")).alias("h"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("g"))
    frequent = held.where(F.col("n") >= least).orderBy("n", "token").collect()
    if not frequent:
        return labelled.sparkSession.createDataFrame([], schema)
    alike: dict[tuple, list[str]] = {}
    for r in frequent:
        alike.setdefault((r["n"], r["h"], r["g"]), []).append(r["token"])
    leaders = F.array(*[F.lit(tokens[0]) for tokens in alike.values()])
    label = F.when(F.col("label").isNotNull(), F.array(F.concat(F.lit(LABEL), "label"))).otherwise(F.array().cast("array<string>"))
    sets = _itemsets(rows.select(F.concat(F.array_intersect(leaders, "tokens"), label).alias("items")), least, n)
    is_label = lambda x: F.startswith(x, F.lit(LABEL))
    split = sets.select(F.array_sort(F.filter("items", lambda x: ~is_label(x))).alias("antecedent"), F.filter("items", is_label).alias("labels"), "freq")
    totals = split.where(F.size("labels") == 0).select("antecedent", F.col("freq").alias("total"))
    hits = split.where((F.size("labels") == 1) & (F.size("antecedent") > 0)).select(
        "antecedent", F.substring(F.col("labels")[0], 2, 1 << 30).alias("verdict"), F.col("freq").alias("hits"))
    rules = cut_lineage(hits.join(totals, "antecedent").select(
        "antecedent", "verdict", (F.col("hits") / F.col("total")).alias("confidence"), (F.col("hits") / F.lit(n)).alias("support"))
        .where(F.col("confidence") >= min_confidence))
    smaller = rules.select(F.col("antecedent").alias("part"), "verdict", F.col("confidence").alias("as_sure"))
    parts = _parted(rules.where(F.size("antecedent") > 1).select("antecedent", "verdict", "confidence"))
    redundant = parts.join(smaller, ["part", "verdict"]).where(F.col("as_sure") >= F.col("confidence")).select("antecedent", "verdict").distinct()
    kept = rules.join(redundant, ["antecedent", "verdict"], "left_anti")
    members = F.map_from_arrays(leaders, F.array(*[F.array(*map(F.lit, tokens)) for tokens in alike.values()]))
    every = F.aggregate("antecedent", F.array(F.array().cast("array<string>")), lambda made, token: F.flatten(
        F.transform(made, lambda start: F.transform(F.element_at(members, token), lambda t: F.concat(start, F.array(t))))))
    rarest_first = F.array(*[F.lit(r["token"]) for r in frequent])
    return (kept.withColumn("antecedent", F.explode(every))
            .select(F.array_sort("antecedent").alias("antecedent"), "verdict", "confidence", "support",
                    F.element_at(F.array_intersect(rarest_first, "antecedent"), 1).alias("anchor")))


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` has different ``url`` and their ``tokens``; returns ``url`` with the best rule that fits it: of
    greatest confidence, then support, then fewest tokens, then the first by text. URLs that no rule fits, or without
    tokens, are left out; null tokens fit nothing; no rules or URLs give no rows."""
    looked_up = urls.select("url", "tokens", F.explode("tokens").alias("anchor"))
    fits = looked_up.join(sized(rules, F.size("antecedent") + 4), "anchor").where(F.size(F.array_except("antecedent", "tokens")) == 0)
    best = F.min(F.struct((-F.col("confidence")).alias("c"), (-F.col("support")).alias("s"), F.size("antecedent").alias("n"),
                          F.array_join("antecedent", " ").alias("mined_rule"), "verdict"))
    return fits.groupBy("url").agg(best.alias("best")).select(
        "url", F.col("best.mined_rule"), F.col("best.verdict").alias("mined_verdict"), (-F.col("best.c")).alias("confidence"))


def judge(pages: DataFrame, rules: Sequence[Rule], default: str = "allow", labelled: DataFrame | None = None,
          id_col: str = "page_id", url_col: str = "url", **mining: float) -> DataFrame:
    """One row per row of ``pages``: its id, ``host``, ``path``, ``rule`` (the listed rule that fits, else null),
    ``verdict``, and the method's ``mined_rule`` and ``confidence`` where that decided.

    ``labelled`` (columns ``url``, ``label``) is what is mined; by default, the pages that a listed rule judges.
    A URL that no rule of either kind fits gets ``default``. A null URL, or one without ``://``, has an empty
    host and path and no tokens. Repeated rows and null ids each get their row; an empty table gives none.
    """
    work = pages.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{url_col}`").alias("url"))
    work = work.select("_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    work = work.withColumns({"rule": rule, "listed": verdict})
    known = labelled if labelled is not None else work.where(F.col("listed").isNotNull()).select("url", F.col("listed").alias("label"))
    mined = mine(known.select(tokens_of(F.col("url")).alias("tokens"), "label"), **mining)
    open_urls = work.where(F.col("listed").isNull() & F.col("url").isNotNull()).select("url").distinct()
    judged = match(open_urls.select("url", tokens_of(F.col("url")).alias("tokens")), mined)
    found = work.join(judged, "url", "left")
    by_method = F.col("listed").isNull()
    return found.select(F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("listed", "mined_verdict", F.lit(default)).alias("verdict"),
                        *[F.when(by_method, F.col(c)).alias(c) for c in ("mined_rule", "confidence")])
