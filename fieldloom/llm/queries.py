"""The queries that apply the operators to whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat, decontaminate, divergence, fingerprints, lines, minhash, packing, pii, quality, secret_scan, spelling, substrings, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    return quality.rate_quality(docs, quality.train_quality(docs, labels))


@query
def op2_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.find_items(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op3_urls(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels").select(F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad"))
    return urls.judge_pages(table(spark, folder, "pages"), labels).select("page_id", "host", "path", "rule", "verdict")


@query
def op4_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"), percent=85)


@query
def op5_lines(spark: SparkSession, folder: str) -> DataFrame:
    cut = lines.drop_repeated_lines(table(spark, folder, "documents"))
    return cut.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query
def op6_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, folder, "documents"))
    counts = [secret_scan.count_kind("base", k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(secret_scan.spans_text(F.col("base")), 256).alias("base_sha256"),
                        secret_scan.spans_text(F.concat("base", "added")).alias("spans"))


@query
def op7_substring(spark: SparkSession, folder: str) -> DataFrame:
    cut = substrings.remove_repeats(table(spark, folder, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query
def op8_chat(spark: SparkSession, folder: str) -> DataFrame:
    own = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    return chat.read_back(chat.format_turns(own.unionByName(extra)))


@query
def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op10_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, folder, "documents"))
    counts = [pii.count_kind("base", k).alias(f"n_{k}") for k in pii.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.spans_text(F.col("base")), 256).alias("base_sha256"),
                        pii.spans_text(F.concat("base", "added")).alias("spans"))


@query
def op11_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit_sources(table(spark, folder, "documents"))


SQL["op11_divergence"] = r"""
WITH docs AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS doc,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
tokens AS (SELECT lang, source, doc, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS total FROM tokens GROUP BY lang, term HAVING count(DISTINCT doc) >= 3),
langs AS (SELECT d.lang, count(k.term) AS terms, coalesce(sum(k.total), 0) AS total FROM (SELECT DISTINCT lang FROM docs) d LEFT JOIN kept k USING (lang) GROUP BY d.lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM tokens GROUP BY lang, source, term),
held AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.total
         FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sums AS (SELECT lang, source, sum(n) AS n FROM held GROUP BY lang, source),
shares AS (
  SELECT h.lang, h.source, h.term, h.n,
         1 + (1000000000::HUGEINT * (h.n + 1)) // (s.n + l.terms) AS p,
         1 + (1000000000::HUGEINT * (h.total + 1)) // (l.total + l.terms) AS q
  FROM held h JOIN sums s USING (lang, source) JOIN langs l USING (lang)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""


@query
def op12_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, folder, "documents"))


#: The CRC-32 folds the bytes of "<doc_id>:<run>"; letters beyond ASCII have two bytes, 195 and the code point less 64.
SQL["op12_spelling"] = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i::BIGINT)) AS t),
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS doc, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[A-Za-z\x{C0}-\x{FF}]+')) AS run
  FROM documents WHERE text IS NOT NULL),
counted AS (SELECT doc, run, count(*) AS n FROM runs GROUP BY doc, run),
coded AS (
  SELECT run, n, list_reduce(flatten(list_transform(string_split(doc || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END)),
         lambda s, b: xor(crc.t[(xor(s, b::BIGINT) & 255) + 1], s >> 8), 4294967295::BIGINT) AS s
  FROM counted, crc),
hashed AS (SELECT run, n, xor(s, 4294967295::BIGINT) AS h FROM coded),
results AS (
  SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INTEGER) || substring(run, (h % length(run))::INTEGER + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM results WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cuts AS (
  SELECT word, n, i, left(word, i::INTEGER) || substring(word, i::INTEGER + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS other, max(n) AS other_n FROM near GROUP BY word),
led AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.other_n >= 2 * w.n THEN b.other END AS form, CASE WHEN b.other_n >= 2 * w.n THEN b.other_n END AS form_n
  FROM words w LEFT JOIN best b USING (word)),
way AS (SELECT word, word AS root FROM led UNION ALL SELECT w.word, l.form FROM way w JOIN led l ON l.word = w.root WHERE l.form IS NOT NULL),
roots AS (SELECT w.word, w.root FROM way w JOIN led l ON l.word = w.root WHERE l.form IS NULL)
SELECT l.word, l.form, r.root, l.n, l.n_near, l.form_n FROM led l JOIN roots r USING (word)
"""


@query
def op13_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.compare_edited(table(spark, folder, "documents"))
