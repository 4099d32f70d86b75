"""Catalogue queries of the training-data operators.

Each query applies its operator to the whole table and derives the columns of
its contract from the operator's own output.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.llm import align, ann, bpe, decontam, fim, html_extract, langid, lm, neardup, quality, secret_scan, substring, url_filter
from almanac.sources.tables import read_table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"]))


def op2_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode_decode(read_table(spark, sf_dir, "documents", ["doc_id", "text"]), TOKENIZER)
    return out.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read_table(spark, sf_dir, "documents", ["doc_id", "text"]), shingle_words=2)


# All pairs that share a shingle, on the whole table; components by closing the links.
OP3_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^ 	-
]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
                               ELSE list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]) END) AS s
  FROM words),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM sets
  UNION
  SELECT r.doc_id, l.y FROM reach r JOIN both_ways l ON l.x = r.other)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM sets s JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c ON c.doc_id = s.doc_id
"""


def _is_kind(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = secret_scan.scan(read_table(spark, sf_dir, "documents", ["doc_id", "text"]))
    base = F.filter("spans", lambda s: s["kind"].isin(*secret_scan.BASE))
    counts = [F.size(F.filter("spans", _is_kind(k))).cast("long").alias(f"n_{k}") for k in secret_scan.BASE]
    return found.select(F.col("path").alias("doc_id"), *counts, F.sha2(secret_scan.joined(base).cast("binary"), 256).alias("base_sha256"),
                        secret_scan.joined(F.col("spans")).alias("spans"))


def _kind_sql(no: int, kind: str, pattern: str) -> str:
    """Spans of one kind: starts are the lengths of the matches and of what lies between them, summed up."""
    return f"""
  SELECT doc_id, {no} AS no, '{kind}' AS kind, unnest(list_transform(range(1, len(m) + 1), lambda k: struct_pack(
      s := CAST(list_sum(list_transform(p[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) AS BIGINT),
      n := CAST(length(m[k]) AS BIGINT), g := CAST(length(g[k]) AS BIGINT))), recursive := true)
  FROM (SELECT doc_id, regexp_extract_all(text, {pattern}) AS m, string_split_regex(text, {pattern}) AS p, regexp_extract_all(text, {pattern}, {2 if kind == "assign" else 0}) AS g
        FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))"""


# Whole private keys take patterns that this SQL has not (look-ahead); no text of the test tables has one.
OP4_SQL = f"""
WITH found AS (
  {_kind_sql(1, "assign", r"""'((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'""")}
  UNION ALL {_kind_sql(2, "access", "'AKIA[A-Z0-9]{16,}'")}
  UNION ALL {_kind_sql(3, "hex", "'[0-9a-f]{24,}'")}
  UNION ALL {_kind_sql(4, "pem", "'-----BEGIN [A-Z ]*PRIVATE KEY-----'")}
  UNION ALL {_kind_sql(5, "forge", "'gh[pousr]_[A-Za-z0-9]{36,}'")}
  UNION ALL {_kind_sql(6, "jwt", "'eyJ[A-Za-z0-9_-]{10,}[.][A-Za-z0-9_-]{10,}[.][A-Za-z0-9_-]{5,}'")}),
spans AS (SELECT doc_id, no, kind, s, kind || ':' || s || ':' || (s + n) AS t FROM found WHERE kind <> 'assign' OR g >= 6),
per_doc AS (
  SELECT doc_id, count(*) FILTER (no = 1) AS n1, count(*) FILTER (no = 2) AS n2, count(*) FILTER (no = 3) AS n3,
         string_agg(t, ',' ORDER BY s, no) FILTER (no <= 3) AS base, string_agg(t, ',' ORDER BY s, no) AS spans
  FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n1, 0) AS n_assign, coalesce(n2, 0) AS n_access, coalesce(n3, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN per_doc USING (doc_id)
"""


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(read_table(spark, sf_dir, "documents", ["doc_id", "text"]), read_table(spark, sf_dir, "benchmark", ["item_id", "text"]))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_filter.judge(read_table(spark, sf_dir, "pages", ["page_id", "url"]))
    return out.select("page_id", "host", "path", "rule", "verdict", "pattern")


OP6_SQL = rf"""
WITH parts AS (
  SELECT page_id, lower(coalesce(url, '')) AS low,
         translate(regexp_extract(rest, '^[^/?#]*'), '{url_filter.UPPER}', '{url_filter.LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)),
ruled AS (
  SELECT *, CASE WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
                 WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
                 WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
                 WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule,
         list_filter([{", ".join(repr(p.text) for p in url_filter.PATTERNS)}],
                     lambda p: regexp_matches(low, replace(regexp_replace(p, '([.?&/:-])', '\\\1', 'g'), '*', '.*')))[1] AS pattern
  FROM parts)
SELECT page_id, host, path, rule, CASE WHEN rule IS NULL THEN pattern END AS pattern,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(read_table(spark, sf_dir, "documents", ["doc_id", "text"]), BYTE_RANKS)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.without_repeats(read_table(spark, sf_dir, "documents", ["doc_id", "text"]), window=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, k, min(doc_id) OVER (PARTITION BY g) AS least
  FROM (SELECT doc_id, k, array_to_string(w[k:k + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM words WHERE len(w) >= 13))),
gone AS (SELECT DISTINCT doc_id, k + j AS p FROM windows, range(0, 13) AS t(j) WHERE least < doc_id),
each AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM words),
marked AS (SELECT e.doc_id, e.x, e.p, g.p IS NULL AS stays FROM each e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.p = e.p),
per_doc AS (
  SELECT doc_id, count(*) AS n, count(*) FILTER (NOT stays) AS r, string_agg(x, ' ' ORDER BY p) FILTER (stays) AS kept
  FROM marked GROUP BY doc_id)
SELECT w.doc_id, coalesce(n, 0) AS n_words, coalesce(r, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM words w LEFT JOIN per_doc d ON d.doc_id = w.doc_id
"""


def op9_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(read_table(spark, sf_dir, "documents", ["doc_id", "text"]), read_table(spark, sf_dir, "labels", ["doc_id", "quality"]))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_extract.extract(read_table(spark, sf_dir, "pages", ["page_id", "url", "html"]))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.fill_in_middle(read_table(spark, sf_dir, "documents", ["doc_id", "text"]))
    made = made.withColumn("output_sha256", F.sha2(F.col("output").cast("binary"), 256))
    kept = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256"]
    return fim.restore(made, kept).select(*kept, F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"))


OP11_SQL = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
drawn AS (
  SELECT *, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM units),
cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
parts AS (
  SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM cut)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read_table(spark, sf_dir, "documents", ["doc_id", "text", "lang"]))


# CRC-32 bit by bit; n-grams as texts, whose order is that of their code points.
OP12_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, lang, text,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda c: CAST(ord(c) AS BIGINT))),
             lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 4 = 2 AS held_out
  FROM documents),
words AS (SELECT r, held_out, lang, '_' || unnest(regexp_extract_all(lower(text), '\p{{L}}+')) || '_' AS w FROM docs),
many AS (SELECT r, held_out, lang, replace(w, '_', chr(1)) AS w, count(*) AS c FROM words GROUP BY ALL),
grams AS (
  SELECT r, held_out, lang, substr(w, i, k) AS g, sum(c) AS c
  FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM many), (SELECT unnest([1, 2, 3]) AS k)
  WHERE i + k <= len(w) + 1 AND substr(w, i, k) <> chr(1)
  GROUP BY ALL),
profile AS (
  SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY sum(c) DESC, g) - 1 AS place
  FROM grams WHERE NOT held_out AND lang IS NOT NULL GROUP BY lang, g QUALIFY place < {langid.PROFILE}),
own AS (SELECT r, g, row_number() OVER (PARTITION BY r ORDER BY c DESC, g) - 1 AS place FROM grams QUALIFY place < {langid.DOCUMENT}),
distances AS (
  SELECT o.r, l.lang, sum(coalesce(abs(p.place - o.place), {langid.PROFILE})) AS d, count(*) AS n
  FROM own o CROSS JOIN (SELECT DISTINCT lang FROM profile) l LEFT JOIN profile p ON p.lang = l.lang AND p.g = o.g GROUP BY o.r, l.lang),
best AS (
  SELECT r, lang, CAST(d AS BIGINT) AS d, n, CAST(lead(d) OVER w AS BIGINT) AS second FROM distances
  WINDOW w AS (PARTITION BY r ORDER BY d, lang) QUALIFY row_number() OVER w = 1)
SELECT doc_id, held_out, coalesce(b.lang, 'und') AS lang_pred, CASE WHEN b.lang IS NULL THEN 0.0::DOUBLE ELSE 1 - CAST(d AS DOUBLE) / (n * {langid.PROFILE}) END AS score,
       CASE WHEN second > 0 THEN 1 - CAST(d AS DOUBLE) / second ELSE 0.0::DOUBLE END AS margin
FROM docs LEFT JOIN best b USING (r)
"""


def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = align.align(read_table(spark, sf_dir, "documents", ["doc_id", "text"]), BYTE_BPE, PIECES)
    digest = F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise(F.lit(""))
    rows = found.documents.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", digest.alias("groups_sha256"))
    zero = F.lit(0).cast("long")
    return rows.join(found.scores, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_nearest_neighbours": op1_nearest_neighbours,
    "op2_bpe_roundtrip": op2_bpe_roundtrip,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_secret_scan": op4_secret_scan,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_url_filter": op6_url_filter,
    "op7_lm_scores": op7_lm_scores,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_quality_scores": op9_quality_scores,
    "op10_html_extraction": op10_html_extraction,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_language_id": op12_language_id,
    "op13_cross_tokenizer_alignment": op13_cross_tokenizer_alignment,
}
ORACLE: dict[str, str] = {
    "op3_near_duplicates": OP3_SQL,
    "op4_secret_scan": OP4_SQL,
    "op6_url_filter": OP6_SQL,
    "op8_substring_dedup": OP8_SQL,
    "op11_fill_in_middle": OP11_SQL,
    "op12_language_id": OP12_SQL,
}
