"""Registered queries of the corpus operators, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hindsight.llm import (
    byte_bpe,
    collocations,
    divergence,
    exact_dedup,
    language,
    line_dedup,
    packing,
    pii,
    sharding,
    simhash,
    substrings,
    topk,
    url_filter,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

UPPER_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op7_sharding")
def op7_sharding(spark: SparkSession, folder: str) -> DataFrame:
    rows, _ = sharding.assign(table(spark, folder, "documents"), shards=24)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op10_exact_dedup", f"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), {UPPER_LOWER})) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
""")
def op10_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = exact_dedup.deduplicate(table(spark, folder, "documents"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@query("op2_byte_bpe")
def op2_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.digests(table(spark, folder, "documents"), path, public_tokenizers.PATTERN)


#: What the address list says: verdict, host, path.
LISTED = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


@query("op8_url_filter")
def op8_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge(table(spark, folder, "pages"), LISTED).drop("url")


@query("op3_packing")
def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op9_substring_dedup")
def op9_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, folder, "documents"))


@query("op1_simhash_near_dedup")
def op1_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = simhash.near_duplicates(table(spark, folder, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op5_language_id")
def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op4_pii")
def op4_pii(spark: SparkSession, folder: str) -> DataFrame:
    rows = pii.with_spans(table(spark, folder, "documents"), keep=["doc_id"])
    counts = [pii.counted("base", k).alias(f"n_{k}") for k in pii.KINDS]
    return rows.select("row.doc_id", *counts, F.sha2(pii.written("base"), 256).alias("base_sha256"), pii.written("spans").alias("spans"))


@query("op6_topk_search", f"""
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, {UPPER_LOWER}), '[^\\x20\\x09-\\x0D]+')) AS w FROM documents WHERE text IS NOT NULL),
tf AS (SELECT doc_id, w, count(*)::DOUBLE AS f FROM words GROUP BY ALL),
len AS (SELECT d.doc_id, count(w)::DOUBLE AS l FROM documents d LEFT JOIN words USING (doc_id) GROUP BY ALL),
df AS (SELECT w, count(*)::DOUBLE AS n FROM tf GROUP BY w),
base AS (SELECT count(*)::DOUBLE AS n, avg(l) AS mean FROM len),
scored AS (
  SELECT q.doc_id AS query_id, t.doc_id,
         round(sum(ln(1 + (base.n - df.n + 0.5) / (df.n + 0.5)) * t.f * 2.2 / (t.f + 1.2 * (0.25 + 0.75 * len.l / base.mean))), 6) AS score
  FROM tf q JOIN tf t USING (w) JOIN df USING (w) JOIN len ON len.doc_id = t.doc_id CROSS JOIN base
  WHERE q.doc_id % 100 = 0 GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scored QUALIFY rank <= 10
""")
def op6_topk_search(spark: SparkSession, folder: str) -> DataFrame:
    return topk.search(table(spark, folder, "documents"), F.col("doc_id") % 100 == 0)


SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query("op11_line_dedup", f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT row, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d),
k AS (SELECT *, translate(trim(line, {SPACE}), {UPPER_LOWER}) AS key FROM l),
common AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT row) >= 10)
SELECT doc_id, count(*) AS n_lines, count(common.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE common.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN common USING (key) GROUP BY row, doc_id
""")
def op11_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = line_dedup.deduplicate(table(spark, folder, "documents"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


@query("op12_collocations", f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), {UPPER_LOWER}), '[.,;:!?\n\x0B\x0C\r]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM pieces),
k AS (SELECT lang, w, unnest([1, 2, 3, 4]) AS k FROM w WHERE len(w) > 0),
i AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM k),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM i GROUP BY ALL),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
often AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE f >= 30),
candidate AS (SELECT * FROM often WHERE k > 1),
cut AS (SELECT *, unnest(range(1, k)) AS cut FROM candidate),
scored AS (
  SELECT c.lang, c.phrase, c.f AS a, l.f AS l, r.f AS r, cut, (2000000::HUGEINT * c.f // (l.f + r.f))::BIGINT AS score
  FROM cut c
  JOIN often l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:cut], ' ')
  JOIN often r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[cut + 1:c.k], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
part AS (SELECT *, unnest(range(2, k)) AS n FROM candidate WHERE k > 2),
spot AS (SELECT *, unnest(range(1, k - n + 2)) AS s FROM part),
longer AS (SELECT lang, array_to_string(w[s:s + n - 1], ' ') AS phrase, max(f) AS longer FROM spot GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best LEFT JOIN longer USING (lang, phrase) JOIN total USING (lang)
WHERE longer IS NULL OR 100::HUGEINT * longer < 80 * a QUALIFY rank <= 2000
""")
def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.mine(table(spark, folder, "documents"))


@query("op13_source_divergence", f"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), {UPPER_LOWER}) AS text FROM documents),
t AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT row) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM d),
size AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
own AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
share AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (coalesce(own.total, 0)::HUGEINT + size.v) AS p
  FROM groups g JOIN kept k ON k.lang = g.lang JOIN size ON size.lang = g.lang
  LEFT JOIN own ON own.lang = g.lang AND own.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
lang_n AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL),
lang_total AS (SELECT lang, sum(n) AS total FROM c GROUP BY lang),
lang_share AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (n::HUGEINT + 1) // (total::HUGEINT + v) AS q FROM lang_n JOIN lang_total USING (lang) JOIN size USING (lang)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(v.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
             FROM share a JOIN share b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) v
  ON v.lang = a.lang AND v.source = a.source AND v.item = b.source),
over AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM share JOIN lang_share USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM pairs
UNION ALL
SELECT * FROM (SELECT lang, source, 'term' AS part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM over) WHERE rank <= 200
""")
def op13_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(table(spark, folder, "documents"))
