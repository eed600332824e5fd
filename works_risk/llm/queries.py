"""The registered queries of this folder and, where SQL can say it, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from works_risk.llm import (
    bpe_lexicon,
    embedding_dedup,
    filter_audit,
    language_id,
    line_dedup,
    minhash_dedup,
    packing,
    quality_rules,
    rans_tokens,
    toxicity,
    url_rules,
    warc,
    whitening,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BYTE_BPE, BYTE_BPE_SIZE = "byte_bpe_50k.json", 50_257


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality_rules.ledger(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = quality_rules.POLICIES["base-1"]
    return quality_rules.apply_policy(book, quality_rules.POLICIES["prose-1"]).select(
        "doc_id",
        *quality_rules.MEASURES,
        (F.col("failed_bits").bitwiseAND(F.lit(base).cast("long")) != 0).alias("base_failed"),
        "failed_bits",
        "kept",
    )


def op3_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    written = rans_tokens.write(docs, public_tokenizers.path(BYTE_BPE), BYTE_BPE_SIZE)
    found = rans_tokens.read(spark, written)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_bpe_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path(BYTE_BPE)
    name = bpe_lexicon.ship(docs, bpe_lexicon.build(docs, path, public_tokenizers.PATTERN))
    return bpe_lexicon.round_trip(docs, name, path, public_tokenizers.PATTERN).select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.links(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.classes(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write(_table(spark, sf_dir, "pages"))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return warc.read(spark, manifest).select(*columns)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = language_id.id_remainder(F.col("doc_id"), 3) == 1
    labels = _table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.fit(docs.filter(~held_out).join(labels, "doc_id"))
    scored = toxicity.predict(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = language_id.id_remainder(F.col("doc_id"), 4) == 2
    model = language_id.fit(docs.filter(~held_out))
    scored = language_id.predict(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return filter_audit.audit(docs, _table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))


URL_RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]


def op12_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judge(pages, url_rules.rule_table(spark, URL_RULES)).drop("url")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_rans_tokens": op3_rans_tokens,
    "op4_packing": op4_packing,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_minhash_dedup": op6_minhash_dedup,
    "op7_warc": op7_warc,
    "op8_toxicity": op8_toxicity,
    "op9_bpe_lexicon": op9_bpe_lexicon,
    "op10_language_id": op10_language_id,
    "op11_filter_audit": op11_filter_audit,
    "op12_url_rules": op12_url_rules,
    "op13_whitening": op13_whitening,
}

_OP1 = r"""
WITH l AS (
  SELECT doc_id, i, string_split(text, chr(10))[i] AS line
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)
), solid AS (
  SELECT doc_id, i, trim(line, ' ' || chr(9) || chr(13)) AS t, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k
  FROM l WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''
), w AS (
  SELECT doc_id, k, i AS a, lead(i, 1) OVER d AS b, lead(i, 2) OVER d AS c, t AS x, lead(t, 1) OVER d AS y, lead(t, 2) OVER d AS z
  FROM solid WINDOW d AS (PARTITION BY doc_id ORDER BY k)
), later AS (
  SELECT doc_id, a, b, c FROM w WHERE c IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY x, y, z ORDER BY doc_id, k) > 1
), gone AS (
  SELECT DISTINCT doc_id, i FROM (SELECT doc_id, unnest([a, b, c]) AS i FROM later)
), cut AS (
  SELECT l.doc_id, count(gone.i) AS n_removed,
         coalesce(string_agg(CASE WHEN gone.i IS NULL THEN line END, chr(10) ORDER BY l.i), '') AS text
  FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.i = l.i GROUP BY l.doc_id
)
SELECT d.doc_id, cut.text, CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS n_lines,
       coalesce(cut.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN cut ON cut.doc_id = d.doc_id
"""

_OP2 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda x: regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g') <> '') AS ls
  FROM documents
), pos AS (
  SELECT doc_id, w, unnest(range(len(w) - 2)) AS i FROM d WHERE len(w) >= 3
), win AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i + 1], w[i + 2], w[i + 3]) AS n FROM pos
), cov AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, i + unnest([0, 1, 2]) AS p FROM win WHERE n >= 2) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) AS BIGINT) AS n_lines,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN cov ON cov.doc_id = d.doc_id
), b AS (
  SELECT *, CAST(CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
       + CASE WHEN 100 * n_symbols > 10 * n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END
       + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 15 * n_words THEN 32 ELSE 0 END AS BIGINT) AS failed_bits
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, failed_bits, failed_bits = 0 AS kept
FROM b
"""

_OP5 = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.9
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, link.y FROM reach JOIN link ON link.x = reach.b
), n AS (
  SELECT x, COUNT(*) AS n FROM link GROUP BY x
), c AS (
  SELECT a, MIN(b) AS component_id FROM reach GROUP BY a
)
SELECT vec_id, COALESCE(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON c.a = vec_id LEFT JOIN n ON n.x = vec_id
"""

_OP6 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, g, COUNT(*) AS n FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w)
  GROUP BY doc_id, g
), t AS (
  SELECT doc_id, SUM(n) AS t FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, SUM(least(a.n, b.n)) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY x, y
), l AS (
  SELECT x, y FROM p JOIN t tx ON tx.doc_id = x JOIN t ty ON ty.doc_id = y WHERE CAST(c AS DOUBLE) / CAST(tx.t + ty.t - c AS DOUBLE) >= 0.8
), link AS (
  SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, link.y FROM reach JOIN link ON link.x = reach.b
)
SELECT a AS doc_id, MIN(b) AS class_id, COUNT(*) AS class_size, a = MIN(b) AS kept FROM reach GROUP BY a
"""

_OP7 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, MAX(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages
)
SELECT page_id, octet_length(encode(body)) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(sha1(body), CAST(1 + 5 * (i // 4) AS INT), 5) AS BIGINT)
      >> CAST(5 * (3 - i % 4) AS INT)) & 31) AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
FROM p
"""

_OP11 = r"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), f AS (
  SELECT doc_id, part, CAST(len(w) < 100 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 80 * len(w) AS INT)
       + 4 * CAST(100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 10 * length(text) AS INT)
       + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INT)
       + 16 * CAST(coalesce(doc_id > MIN(doc_id) OVER (PARTITION BY text), FALSE) AS INT) AS bits
  FROM t
), p AS (
  SELECT part, bits, COUNT(*) AS n, COUNT(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) AS good,
         COUNT(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS toxic
  FROM f GROUP BY part, bits
), s AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS b
), o AS (
  SELECT s1.x || s2.x || s3.x || s4.x || s5.x AS filter_order, [s1.b, s2.b, s3.b, s4.b, s5.b] AS b
  FROM s s1 JOIN s s2 ON s2.x <> s1.x JOIN s s3 ON s3.x NOT IN (s1.x, s2.x) JOIN s s4 ON s4.x NOT IN (s1.x, s2.x, s3.x)
       JOIN s s5 ON s5.x NOT IN (s1.x, s2.x, s3.x, s4.x)
), e AS (
  SELECT filter_order, step, b[step] AS bit, CAST(coalesce(list_sum(b[1:step - 1]), 0) AS INT) AS before
  FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), r AS (
  SELECT part, filter_order, step, bit,
         SUM(n) FILTER ((bits & (bit | before)) = 0) AS kept, SUM(n) FILTER ((bits & bit) <> 0 AND (bits & before) = 0) AS removed,
         SUM(n) FILTER ((bits & bit) <> 0 AND (bits & before) <> 0) AS redundant, SUM(n) FILTER (bits = bit) AS unique_fails,
         SUM(good) FILTER ((bits & bit) <> 0 AND (bits & before) = 0) AS good_lost,
         SUM(toxic) FILTER ((bits & bit) <> 0 AND (bits & before) = 0) AS toxic_lost
  FROM p, e GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
       CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
       CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
       CAST(coalesce(SUM(removed) OVER (PARTITION BY part, bit), 0) AS BIGINT) AS shapley
FROM r
"""

_OP12 = r"""
WITH p AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), u AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM p
), j AS (
  SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path,
    CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
         WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
         WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
         WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM u
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM j
"""

ORACLE: dict[str, str] = {
    "op1_line_dedup": _OP1,
    "op2_quality_rules": _OP2,
    "op5_embedding_dedup": _OP5,
    "op6_minhash_dedup": _OP6,
    "op7_warc": _OP7,
    "op11_filter_audit": _OP11,
    "op12_url_rules": _OP12,
}
