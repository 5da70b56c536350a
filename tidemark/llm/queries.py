"""The operators applied to whole tables: one query each, and SQL where SQL can say it."""

from __future__ import annotations

import string

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bpe_ops import bpe_round_trip
from tidemark.llm.conversations import repaired_conversations
from tidemark.llm.exact_dedup import exact_dedup
from tidemark.llm.filter_audit import audited_documents
from tidemark.llm.jaccard import jaccard_components
from tidemark.llm.language import language
from tidemark.llm.line_dedup import line_dedup
from tidemark.llm.media import media_columns
from tidemark.llm.packing import pack_documents
from tidemark.llm.quality import quality
from tidemark.llm.sharding import sharded_documents
from tidemark.llm.suffix_dedup import suffix_dedup
from tidemark.llm.toxicity import toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = F.col("suffix_dedup")
    return out.select("doc_id", found.n_bytes.alias("n_bytes"), found.n_removed.alias("n_removed"), found.n_spans.alias("n_spans"), F.sha2(found.kept, 256).alias("kept_sha256"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        F.col("line_dedup.n_lines").cast("long").alias("n_lines"),
        F.col("line_dedup.n_removed").cast("long").alias("n_removed"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), size=3, percent=90)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_conversations(table(spark, sf_dir, "conversations"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded_documents(table(spark, sf_dir, "documents"))


OP9_SQL = f"""
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, h AS text_sha256
FROM t WINDOW w AS (PARTITION BY h)
"""

OP6_SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, ls, unnest(range(len(ls))) AS i FROM d),
w AS (SELECT doc_id, i, array_to_string(ls[i + 1:i + 3], chr(10)) AS s FROM l WHERE i + 3 <= len(ls)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS n FROM w),
c AS (SELECT DISTINCT doc_id, i + k AS i FROM r, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1),
k AS (SELECT l.doc_id, string_agg(l.ls[l.i + 1], chr(10) ORDER BY l.i) AS kept, count(*) AS n
      FROM l ANTI JOIN c ON l.doc_id = c.doc_id AND l.i = c.i GROUP BY l.doc_id)
SELECT d.doc_id, len(d.ls) AS n_lines, len(d.ls) - coalesce(k.n, 0) AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""

OP11_SQL = r"""
WITH RECURSIVE o AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '') AS chars
  FROM conversations
),
k AS (  -- crc32, bit by bit
  SELECT conv_id, turn, role, text, xor(list_reduce(list_transform(chars, lambda x: ord(x)::BIGINT),
           lambda c, x: list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda d, y: xor(d >> 1, 3988292384 * (d & 1)), xor(c, x)), 4294967295::BIGINT), 4294967295) % 20 AS kind
  FROM o
),
d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM k WHERE kind <> 0
),
p AS (
  SELECT *, row_number() OVER w AS i, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS bare, substr(role, 1, 1) AS ini,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again, lag(substr(role, 1, 1)) OVER w AS before
  FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy)
),
f AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM p
),
m AS (
  SELECT conv_id, i, role, text, ini, CASE fault WHEN '' THEN 0 WHEN 'truncated' THEN 5 ELSE 1000000000 END AS more FROM f
),
n AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i > 1 AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM f GROUP BY conv_id
),
v AS (  -- costs to go in the states: nothing yet, after s, after u, after a
  SELECT conv_id, n + 1 AS i, [0, 10, 5, 0]::BIGINT[] AS v FROM n
  UNION ALL
  SELECT conv_id, i, [least(b[1], 5 + b[3], 10 + b[4]), least(b[2], 5 + b[3], 10 + b[4]), least(b[3], 5 + b[4]), least(b[4], 5 + b[3])] AS v
  FROM (
    SELECT m.conv_id, m.i, [
      least(2 + v[1], more + CASE ini WHEN 's' THEN v[2] WHEN 'u' THEN v[3] ELSE 1 + v[3] END, 1 + more + v[3]),
      least(2 + v[2], more + CASE ini WHEN 'u' THEN v[3] ELSE 1 + v[3] END),
      least(2 + v[3], more + CASE ini WHEN 'a' THEN v[4] ELSE 1 + v[4] END),
      least(2 + v[4], more + CASE ini WHEN 'u' THEN v[3] ELSE 1 + v[3] END)] AS b
    FROM v JOIN m ON m.conv_id IS NOT DISTINCT FROM v.conv_id AND m.i = v.i - 1
  )
),
e AS (  -- the walk: q is the state, from 1
  SELECT conv_id, 1::BIGINT AS i, 1 AS q, '' AS audit, []::VARCHAR[] AS lines FROM n
  UNION ALL
  SELECT conv_id, CASE WHEN edit = 'I' THEN i ELSE i + 1 END, CASE edit WHEN 'D' THEN q WHEN 'K' THEN stays ELSE fits END, audit || edit,
         CASE edit WHEN 'D' THEN lines ELSE list_append(lines, CASE WHEN edit = 'K' THEN role ELSE CASE fits WHEN 3 THEN 'user' ELSE 'assistant' END END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END) END
  FROM (
    SELECT *, CASE WHEN i <= n AND now[q] = 2 + next[q] THEN 'D' WHEN now[q] = 5 + now[fits] THEN 'I'
                   WHEN stays > 0 AND now[q] = more + next[stays] THEN 'K' ELSE 'R' END AS edit
    FROM (
      SELECT e.*, n.n, m.role, m.text, m.more, a.v AS now, b.v AS next, CASE WHEN e.q = 3 THEN 4 ELSE 3 END AS fits,
             CASE WHEN e.q = 1 AND ini = 's' THEN 2 WHEN e.q <> 3 AND ini = 'u' THEN 3 WHEN e.q = 3 AND ini = 'a' THEN 4 ELSE 0 END AS stays
      FROM e JOIN n ON n.conv_id IS NOT DISTINCT FROM e.conv_id JOIN v a ON a.conv_id IS NOT DISTINCT FROM e.conv_id AND a.i = e.i
        LEFT JOIN v b ON b.conv_id IS NOT DISTINCT FROM e.conv_id AND b.i = e.i + 1 LEFT JOIN m ON m.conv_id IS NOT DISTINCT FROM e.conv_id AND m.i = e.i
      WHERE e.i <= n.n OR a.v[e.q] > 0
    )
  )
),
w AS (SELECT conv_id, arg_max(audit, length(audit)) AS audit, arg_max(lines, length(audit)) AS lines FROM e GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(v.v[1], 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM c.conv_id
  LEFT JOIN v ON v.conv_id IS NOT DISTINCT FROM c.conv_id AND v.i = 1 LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM c.conv_id
"""

OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x FROM documents),
w AS (SELECT *, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY x) AS first FROM d),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         CASE WHEN len(words) < 50 THEN 'A' ELSE '' END
         || CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END
         || CASE WHEN 100 * (length(x) - length(regexp_replace(x, '[A-Z]', '', 'g'))) > 5 * length(x) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN coalesce(doc_id > first, false) THEN 'E' ELSE '' END AS fails
  FROM w LEFT JOIN l USING (doc_id)
),
cells AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS t FROM m GROUP BY part, fails),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order
  FROM f a JOIN f b ON b.f <> a.f JOIN f c ON c.f NOT IN (a.f, b.f) JOIN f d ON d.f NOT IN (a.f, b.f, c.f) JOIN f e ON e.f NOT IN (a.f, b.f, c.f, d.f)
),
steps AS (SELECT filter_order, k AS step, substr(filter_order, k, 1) AS f, substr(filter_order, 1, k - 1) AS before FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS k)),
held AS (
  SELECT part, filter_order, step, f, n, g, t, fails, contains(fails, f) AS hit,
         before <> '' AND fails <> '' AND regexp_matches(fails, '[' || before || '-]') AS gone
  FROM steps, cells
),
counted AS (
  SELECT part, filter_order, step, f,
         coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (hit AND NOT gone), 0) AS removed,
         coalesce(sum(n) FILTER (hit AND gone), 0) AS redundant, coalesce(sum(n) FILTER (fails = f), 0) AS unique_fails,
         coalesce(sum(g) FILTER (hit AND NOT gone), 0) AS good_lost, coalesce(sum(t) FILTER (hit AND NOT gone), 0) AS toxic_lost
  FROM held GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM counted
"""

QUERIES = {
    "op1_media_columns": op1_media_columns,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_bpe": op3_bpe,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_language": op5_language,
    "op6_line_dedup": op6_line_dedup,
    "op7_quality": op7_quality,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_filter_audit": op12_filter_audit,
    "op13_sharding": op13_sharding,
}
ORACLE_SQL = {"op6_line_dedup": OP6_SQL, "op9_exact_dedup": OP9_SQL, "op11_conversation_repair": OP11_SQL, "op12_filter_audit": OP12_SQL}
