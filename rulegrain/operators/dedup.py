"""Keep one row per key, and once-per-content work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rulegrain import reference_values as V
from rulegrain.functions import scalars as S


def _one_per_key(df: DataFrame, keys: list[Column | str], order: Column) -> DataFrame:
    # `row_number() = 1` is cut to one row per key and task before the shuffle, so a key held
    # by a third of the rows reaches its task as one row per upstream task
    w = W.partitionBy(*keys).orderBy(order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def first_per_key(df: DataFrame, keys: list[Column | str], pos: str = "pos") -> DataFrame:
    return _one_per_key(df, keys, F.asc(pos))


def last_per_key(df: DataFrame, keys: list[Column | str], pos: str = "pos") -> DataFrame:
    return _one_per_key(df, keys, F.desc(pos))


def first_per_guid(records: DataFrame, url: str, pos: str = "pos") -> DataFrame:
    """First record of each document id; records without one are all kept."""
    tagged = records.withColumn("_guid", S.guid(F.col(url)))
    blank = F.col("_guid") == ""
    return (first_per_key(tagged.filter(~blank), ["_guid"], pos)
            .unionByName(tagged.filter(blank)).drop("_guid"))


# --- content ---------------------------------------------------------------------------------


def has_text(text: Column, least: int = V.MIN_USABLE_CHARS) -> Column:
    return F.coalesce(F.length(F.trim(text)) >= least, F.lit(False))


def with_content_sha(docs: DataFrame, text: str = "text") -> DataFrame:
    """Hash of every usable text; null marks a document that needs OCR."""
    return docs.withColumn("source_sha256",
                           F.when(has_text(F.col(text)), S.content_sha(F.col(text))))


def content_groups(hashed: DataFrame, pos: str = "pos") -> DataFrame:
    """(source_sha256, first_pos, copies): narrow, combined before the shuffle."""
    return (hashed.filter(F.col("source_sha256").isNotNull())
                  .groupBy("source_sha256")
                  .agg(F.min(pos).alias("first_pos"), F.count("*").alias("copies")))


def content_sketches(hashed: DataFrame, by: list[str], lg_k: int = 14) -> DataFrame:
    """(by…, sketch): a mergeable sketch of the different contents of each group, of a fixed size.

    A batch's sketches are stored once; its texts and hashes are not needed again."""
    return (hashed.filter(F.col("source_sha256").isNotNull()).groupBy(*by)
            .agg(F.hll_sketch_agg("source_sha256", F.lit(lg_k)).alias("sketch")))


def distinct_contents(sketches: DataFrame, by: list[str]) -> DataFrame:
    """(by…, contents): about how many different contents the groups' stored sketches have seen together."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("contents"))


def unique_texts(hashed: DataFrame, pos: str = "pos") -> DataFrame:
    """The first document of every distinct content.  Texts cross the network once."""
    first = content_groups(hashed, pos).select(F.col("first_pos").alias(pos))
    return hashed.join(first, pos, "left_semi")


def work_list(unique: DataFrame, cache: DataFrame) -> DataFrame:
    """Contents without a cached result."""
    return unique.join(cache.select("source_sha256"), "source_sha256", "left_anti")


def cached(unique: DataFrame, cache: DataFrame) -> DataFrame:
    return unique.join(cache.select("source_sha256"), "source_sha256", "left_semi")
