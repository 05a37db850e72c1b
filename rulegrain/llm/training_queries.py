"""Queries on whole corpora: mixing, deduplication, toxicity, chat."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulegrain.llm import chat_repair, line_dedup, ngram_jaccard, source_mix, substring_dedup, toxicity
from rulegrain.llm.registry import query
from rulegrain.llm.storage import read_table

_MIX_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS sk, coalesce(length(text), 0) AS chars,
         md5('mix' || coalesce(cast(doc_id AS varchar), '') || '/' || coalesce(text, '')) AS k FROM documents),
tot AS (SELECT sk, sum(chars) AS chars FROM d GROUP BY sk),
fr AS (SELECT greatest({source_mix.FRAME}, 4 * count(*)) AS frame, count(*) AS n FROM tot),
w AS (SELECT sk, chars, pow(cast(greatest(chars, 1) AS double), 0.5) AS weight FROM tot),
share AS (SELECT sk, chars, weight / sum(weight) OVER () * (frame - n) AS exact, frame, n FROM w, fr),
quota AS (SELECT sk, chars, cast(frame AS int) AS frame, cast(1 + floor(exact) + CASE WHEN row_number() OVER (
    ORDER BY floor(exact) - exact, sk) <= frame - n - sum(floor(exact)) OVER () THEN 1 ELSE 0 END AS int) AS m
  FROM share),
src AS (SELECT list(sk ORDER BY sk) AS s, list(m ORDER BY sk) AS m, any_value(frame) AS frame FROM quota),
plan(t, used, pick) AS (
  SELECT 0, list_transform(m, lambda x: 0), 0 FROM src
  UNION ALL
  SELECT t + 1, list_transform(used, lambda u, j: CASE WHEN j = best THEN u + 1 ELSE u END), best
  FROM (SELECT t, used, list_min(list_filter(list_transform(range(1, len(m) + 1), lambda j:
          CASE WHEN used[j] < m[j] AND cast(used[j] AS bigint) * frame // m[j] <= t
            THEN ((cast(used[j] + 1 AS bigint) * frame + m[j] - 1) // m[j]) * 100000 + j END),
          lambda x: x IS NOT NULL)) % 100000 AS best
        FROM plan, src WHERE t < frame)),
layout AS (SELECT s[pick] AS sk, t - 1 AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS nth
  FROM plan, src WHERE t > 0),
cum AS (SELECT d.*, coalesce(sum(chars) OVER (PARTITION BY sk ORDER BY k, doc_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d),
blk AS (SELECT c.doc_id, c.source, c.sk, c.before, q.m, q.frame, least(
   cast(c.before AS bigint) // {source_mix.BLOCK_CHARS},
   greatest(0, (cast(q.chars AS bigint) + {source_mix.BLOCK_CHARS} - 1) // {source_mix.BLOCK_CHARS} - 1)) AS block
  FROM cum c JOIN quota q USING (sk))
SELECT doc_id, source, cast(block AS bigint) AS block,
       cast((block // m) * frame + l.slot AS bigint) AS slot, cast(before AS bigint) AS chars_before
FROM blk b JOIN layout l ON l.sk = b.sk AND l.nth = b.block % b.m"""


@query("op5_source_mix", _MIX_SQL)
def mixed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return source_mix.mix(docs).selectExpr("doc_id", "source", "mix_block AS block", "mix_slot AS slot",
                                           "mix_chars_before AS chars_before")


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_SUBSTRING_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') AS t
  FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
late AS (SELECT r, i FROM (SELECT r, i, doc_id, min(doc_id) OVER (PARTITION BY t) AS least FROM win)
  WHERE doc_id > least),
gone AS (SELECT DISTINCT r, i + j AS p FROM late, (SELECT unnest(range(0, 13)) AS j)),
word AS (SELECT r, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
kept AS (SELECT word.r, string_agg(word, ' ' ORDER BY word.p) AS text
  FROM word LEFT JOIN gone ON gone.r = word.r AND gone.p = word.p WHERE gone.r IS NULL GROUP BY word.r),
n AS (SELECT r, count(*) AS n_removed FROM gone GROUP BY r)
SELECT doc_id, cast(len(w) AS bigint) AS n_words, cast(coalesce(n_removed, 0) AS bigint) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN n USING (r) LEFT JOIN kept USING (r)"""


@query("op9_substring_dedup", _SUBSTRING_SQL)
def substring_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.remove_repeats(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op1_ngram_jaccard")
def jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_jaccard.join(docs, width=4, num=85, den=100)


_LINES_SQL = rf"""
WITH l AS (
  SELECT doc_id, i, regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS body, x
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS line,
             lead(body) OVER (PARTITION BY doc_id ORDER BY i) AS following FROM l WHERE body <> ''),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, line) AS one,
         row_number() OVER (PARTITION BY body, following ORDER BY doc_id, line) AS two FROM n),
gone AS (
  SELECT doc_id, line FROM ranked
  WHERE one > 1 AND len(regexp_extract_all(body, '[^\x20\x09-\x0D]+')) >= {line_dedup.MIN_WORDS}
  UNION SELECT doc_id, line + k FROM ranked, (SELECT unnest([0, 1]) AS k) WHERE two > 1 AND following IS NOT NULL),
lost AS (SELECT doc_id, i FROM n JOIN gone USING (doc_id, line)),
counts AS (SELECT doc_id, count(*) AS n_lines FROM n GROUP BY doc_id),
dropped AS (SELECT doc_id, count(*) AS n_deleted FROM lost GROUP BY doc_id),
kept AS (SELECT l.doc_id, string_agg(x, chr(10) ORDER BY l.i) AS text FROM l LEFT JOIN lost USING (doc_id, i)
  WHERE lost.i IS NULL GROUP BY l.doc_id)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_deleted, 0) AS n_deleted,
       sha256(coalesce(kept.text, '')) AS text_sha256
FROM documents LEFT JOIN counts USING (doc_id) LEFT JOIN dropped USING (doc_id) LEFT JOIN kept USING (doc_id)"""


@query("op3_line_dedup", _LINES_SQL)
def line_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.remove_repeated_lines(docs).select(
        "doc_id", F.col("line_counts.n_lines").alias("n_lines"), F.col("line_counts.n_deleted").alias("n_deleted"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


@query("op6_chat_format")
def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations")
    return chat_repair.repair(turns).select("conv_id", "turn", "role", "action", "new_role", "inserted", "cost", "rendered")


@query("op4_toxicity")
def toxic_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = toxicity.learn(docs, read_table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.score(docs, chain)
