"""The corpus operators as registered queries on the given tables, with SQL where SQL can ask the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from bizmetrics.llm import (bpe_codec, bpe_count, cotraining, decontaminate, hnsw, lattice, license_scan, merkle, phrases, secret_scan,
                            simhash, url_rules, warc)
from bizmetrics.llm.common import row_key, table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

#: The listed URL rules.
URL_RULES = [url_rules.Rule("block", "net", "/"), url_rules.Rule("allow", "example.net", "/en/"),
             url_rules.Rule("block", "example.com", "/de/"), url_rules.Rule("allow", "org", "/fr/")]


def meta_columns() -> list:
    """The documents' metadata: source, language, and the length's order of magnitude."""
    return [F.col("source"), F.col("lang"), F.floor(F.log2(F.col("n_chars") + 1))]


def owner_columns() -> dict:
    """Who has a document: its source is the owner, a source's language its repository."""
    return {"owner": F.col("source"), "repository": F.concat_ws("/", "source", "lang")}


def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"), shingle=3, max_bits=2)


def op2_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return url_rules.judge(table(spark, folder, "pages"), URL_RULES)


def op3_license_scans(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.licenses(table(spark, folder, "documents"))


def op4_hnsw(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    return hnsw.nearest(rows, rows.where(F.col("vec_id") % 20 == 0), k=20)


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    return cotraining.quality(table(spark, folder, "documents"), table(spark, folder, "labels"), meta_columns()).drop("key")


def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archived(table(spark, folder, "pages"))


def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("key")


def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return bpe_count.token_counts(table(spark, folder, "documents"), BYTE_BPE, limit=512)


def op9_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.secrets(table(spark, folder, "documents"), **owner_columns())


def op10_pieces(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(row_key().alias("key"), "doc_id", "text")
    return lattice.round_trip(docs, PIECES)


def op11_merkle(spark: SparkSession, folder: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return merkle.verified(table(spark, folder, "documents"), tampered)


def op12_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents"), min_count=100, most_words=5, absorbed=100, top=2000)


def op13_bpe_codec(spark: SparkSession, folder: str) -> DataFrame:
    encoded = bpe_codec.encode(table(spark, folder, "documents"), BYTE_BPE)
    return bpe_codec.decode(encoded, BYTE_BPE).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(bpe_codec.id_bytes(), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_simhash, op2_url_filters, op3_license_scans, op4_hnsw, op5_quality, op6_warc,
                            op7_decontamination, op8_token_counts, op9_secrets, op10_pieces, op11_merkle, op12_phrases, op13_bpe_codec)}

_WORDS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"

_LEAF = "sha256(" + " || ".join(
    f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", "text")) + ")"
_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(str_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, nothing:
        CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295)"""
_LEVEL = """SELECT g, lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos))
    FROM (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM {t}) x WHERE c > 1 GROUP BY g, lvl, pos // 3"""

SQL: dict[str, str] = {
    "op12_phrases": r"""
        WITH p AS (SELECT lang, row_number() OVER () AS piece, w FROM (
                     SELECT lang, list_filter(string_split(replace(piece, chr(9), ' '), ' '), lambda x: x <> '') AS w FROM (
                       SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
                         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\f\r]')) AS piece FROM documents) x) y WHERE len(w) > 0),
             total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
             f AS (SELECT lang, k, ph, count(*) AS a FROM (
                     SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS ph FROM (
                       SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest(range(1, 6)) AS k) ks WHERE len(w) >= k) x) y
                   GROUP BY lang, k, ph HAVING count(*) >= 100),
             c AS (SELECT lang, k, ph, a, string_split(ph, ' ') AS w FROM f WHERE k > 1),
             cuts AS (SELECT lang, ph, a, w, unnest(range(1, k)) AS first FROM c),
             scored AS (SELECT lang, cuts.ph, cuts.a, first, x.a AS l, y.a AS r, n, CAST((1000::HUGEINT * cuts.a * n) // (x.a::HUGEINT * y.a) AS BIGINT) AS score
                        FROM cuts JOIN f x USING (lang) JOIN f y USING (lang) JOIN total USING (lang)
                        WHERE x.ph = array_to_string(w[1 : first], ' ') AND y.ph = array_to_string(w[first + 1 : len(w)], ' ')),
             best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, first) = 1),
             longer AS (SELECT DISTINCT s.lang, s.ph FROM c s JOIN c b ON s.lang = b.lang AND b.k > s.k
                        AND contains(' ' || b.ph || ' ', ' ' || s.ph || ' ') WHERE 100 * b.a >= 100 * s.a)
        SELECT lang, rank, phrase, a, l, r, n, score FROM (
            SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, ph) AS rank, ph AS phrase, a, l, r, n, score
            FROM best ANTI JOIN longer USING (lang, ph)) z WHERE rank <= 2000""",
    "op11_merkle": f"""
        WITH RECURSIVE d AS (SELECT doc_id, coalesce('1' || source, '0') AS g, {_LEAF} AS leaf,
                    CASE WHEN {_CRC32} % 2 = 0 THEN {_LEAF.replace("text::VARCHAR", "replace(text::VARCHAR, chr(10), '')")} END AS other FROM documents),
             l AS (SELECT *, row_number() OVER (ORDER BY g, doc_id NULLS FIRST, leaf) AS id,
                          row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
             t(g, lvl, pos, h) AS (SELECT g, 0, pos, leaf FROM l UNION ALL {_LEVEL.format(t="t")}),
             subroots AS (SELECT g, max(lvl) AS height, max_by(h, lvl) AS subroot, row_number() OVER (ORDER BY g) - 1 AS place FROM t GROUP BY g),
             u(g, lvl, pos, h) AS (SELECT '', 0, place, subroot FROM subroots UNION ALL {_LEVEL.format(t="u")}),
             whole AS (SELECT max(lvl) AS height, max_by(h, lvl) AS root FROM u),
             steps AS (SELECT id, g, pos, 0 AS part, unnest(range(height)) AS lvl FROM l JOIN subroots USING (g)
                       UNION ALL SELECT id, '', place, 1, unnest(range(whole.height)) FROM l JOIN subroots USING (g), whole),
             nodes AS (SELECT 0 AS part, * FROM t UNION ALL SELECT 1, * FROM u),
             ways AS (SELECT id, part, lvl, row_number() OVER (PARTITION BY id ORDER BY part, lvl) AS step,
                             coalesce(string_agg(h, '' ORDER BY n.pos) FILTER (n.pos < s.pos // (3 ** lvl)::BIGINT), '') AS before,
                             coalesce(string_agg(h, '' ORDER BY n.pos) FILTER (n.pos > s.pos // (3 ** lvl)::BIGINT), '') AS after
                      FROM steps s JOIN nodes n USING (part, g, lvl) WHERE n.pos // 3 = s.pos // (3 ** (lvl + 1))::BIGINT GROUP BY id, part, lvl),
             proofs AS (SELECT id, string_agg(before || after, '' ORDER BY step) AS siblings FROM ways GROUP BY id),
             f(id, step, h) AS (SELECT id, 1, coalesce(other, leaf) FROM l
                                UNION ALL SELECT f.id, f.step + 1, sha256(before || f.h || after) FROM f JOIN ways USING (id, step)),
             folded AS (SELECT id, max_by(h, step) AS folded_root FROM f GROUP BY id)
        SELECT doc_id, leaf, subroot, root, sha256(coalesce(siblings, '')) AS proof_sha256, folded_root, folded_root = root AS verified
        FROM l JOIN subroots USING (g) JOIN folded USING (id) LEFT JOIN proofs USING (id), whole""",
    "op6_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS size, sha256(coalesce(html, '')) AS digest FROM pages),
             f AS (SELECT digest, min(page_id) AS first FROM p WHERE size >= 100 GROUP BY digest)
        SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, digest AS payload_digest,
               CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first <> page_id THEN first END AS refers_to
        FROM p LEFT JOIN f USING (digest)""",
    "op7_decontamination": f"""
        WITH d AS (SELECT DISTINCT doc_id, {_WORDS} AS w FROM documents),
             b AS (SELECT DISTINCT item_id, {_WORDS} AS w FROM benchmark),
             i AS (SELECT item_id, least(5, len(w)) AS k, list_distinct(list_transform(range(1, len(w) - least(5, len(w)) + 2),
                       lambda j: array_to_string(w[j : j + least(5, len(w)) - 1], ' '))) AS shingles FROM b WHERE len(w) > 0),
             s AS (SELECT item_id, k, CAST(len(shingles) AS INTEGER) AS n, unnest(shingles) AS shingle FROM i),
             places AS (SELECT DISTINCT doc_id, k, array_to_string(w[j : j + k - 1], ' ') AS shingle
                        FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS j FROM d, (SELECT DISTINCT k FROM i) ks) x)
        SELECT doc_id, item_id, n AS n_shingles, CAST(count(*) AS INTEGER) AS n_found, count(*) / n AS containment
        FROM s JOIN places USING (k, shingle) GROUP BY doc_id, item_id, n HAVING count(*) * 10 >= n * 8""",
}
