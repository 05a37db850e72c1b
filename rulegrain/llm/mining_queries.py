"""Queries on single rows and vectors: extraction, encoding, search, quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulegrain.llm import bpe, exact_topk, html_extract, quality_rules
from rulegrain.llm.registry import query
from rulegrain.llm.storage import Scratch, read_table


@query("op2_main_text")
def main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract(pages).select("page_id", "url", "text", "n_chars")


@query("op7_byte_bpe")
def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
                      with_ids=False)


_TOPK_SQL = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x AS double)) AS bigint)) AS cells
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, cast(list_inner_product(q.cells, c.cells) AS bigint) AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS int) AS rank,
       vec_id, score
FROM scored
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20"""


@query("op8_exact_topk", _TOPK_SQL)
def exact_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = exact_topk.quantized(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return exact_topk.search(vectors, vectors.filter("vec_id % 20 = 0"), 20)


@query("op10_quality_rules")
def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "quality")
    stats = scratch.write(quality_rules.statistics(
        read_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    rules = quality_rules.learn(stats, read_table(spark, sf_dir, "labels"))
    s = F.col("stats")
    return stats.select(
        "doc_id", *[s[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        quality_rules.base_failed(s).alias("base_failed"), quality_rules.verdict(s, rules).alias("kept"),
        quality_rules.rule_number(s, rules).alias("rule"))
