"""Keyed merges of row sets: splice, fan-out of results, changed rows, verify-and-hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulegrain.functions import scalars as S
from rulegrain.operators.dedup import last_per_key


def with_key(rows: DataFrame, permalink: str = "permalink", name: str = "hospital") -> DataFrame:
    return rows.withColumn("key", S.row_key(F.col(permalink), F.col(name)))


def _replace(left: DataFrame, right: DataFrame, take: Column, flag: str) -> DataFrame:
    """Left rows, replaced whole by the right row of the same `key` where `take` holds.

    `take` may read `_new` (the right row, null when unmatched) and the left columns."""
    columns = [c for c in left.columns if c != "key"]
    new = right.select("key", F.struct(*columns).alias("_new"))
    joined = left.join(new, "key", "left").withColumn(flag, F.coalesce(take, F.lit(False)))
    picked = [F.when(F.col(flag), F.col("_new")[c]).otherwise(F.col(c)).alias(c)
              for c in columns]
    return joined.select("key", *picked, flag)


def splice(rows: DataFrame, second: DataFrame, pos: str = "pos") -> DataFrame:
    """Rows waiting for OCR are replaced by the other dataset's extracted row of the same key.

    Both inputs carry `key`; of duplicate keys on the right the last wins.  Adds `spliced`."""
    ready = last_per_key(second.filter(F.col("status") == "extracted"), ["key"], pos)
    return _replace(rows, ready, (F.col("status") == "needs_ocr") & F.col("_new").isNotNull(),
                    "spliced")


def merge_changed(served: DataFrame, fresh: DataFrame, pos: str = "pos") -> DataFrame:
    """Fresh extracted rows replace served ones and add new keys; fresh rows that failed leave
    the served row as it is.  Adds `action`: replaced, held, kept or added."""
    columns = [c for c in served.columns if c != "key"]
    good = F.col("status") == "extracted"
    # of several fresh extracted rows the last one counts; two rows a key are left, of which one is extracted
    latest = last_per_key(fresh, ["key", good], pos).groupBy("key").agg(
        F.first(F.when(good, F.struct(*columns)), ignorenulls=True).alias("_new"),
        F.coalesce(F.bool_or(F.col("status") != "extracted"), F.lit(False)).alias("_failed"))
    met = served.withColumn("_served", F.lit(True)).join(latest, "key", "full_outer")
    fits = F.col("_new").isNotNull()
    action = (F.when(F.col("_served").isNull(), F.lit("added")).when(fits, F.lit("replaced"))
               .when(F.col("_failed"), F.lit("held")).otherwise(F.lit("kept")))
    picked = [F.when(fits, F.col("_new")[c]).otherwise(F.col(c)).alias(c) for c in columns]
    return met.filter(F.col("_served").isNotNull() | fits).select("key", *picked, action.alias("action"))


def verify_and_hold(served: DataFrame, reread: DataFrame, numbers: list[str], pos: str = "pos") -> DataFrame:
    """A re-read row is adopted only when all its numbers equal the served ones; of several rows of
    one key the last by `pos` is the re-read one."""
    same = F.lit(True)
    for name in numbers:
        same = same & F.col(f"_new.{name}").eqNullSafe(F.col(name))
    columns = [c for c in served.columns if c != "key"]
    last = last_per_key(reread, ["key"], pos).select("key", F.struct(*columns).alias("_new"))
    joined = served.join(last, "key", "left").withColumn(
        "action", F.when(F.col("_new").isNull(), "kept").when(same, "adopted").otherwise("held"))
    return joined.select("key", *[F.when(F.col("action") == "adopted", F.col("_new")[c]).otherwise(F.col(c)).alias(c)
                                  for c in columns], "action")


def stamp_sha(records: DataFrame, extracted: DataFrame, pos: str = "pos") -> DataFrame:
    """Attach the last extracted content hash by key."""
    known = last_per_key(extracted.filter(S.blank_to_null(F.col("source_sha256")).isNotNull()),
                         ["key"], pos).select("key", F.col("source_sha256").alias("content_sha"))
    return records.join(known, "key", "left")


def map_results(records: DataFrame, results: DataFrame) -> DataFrame:
    """Fan one result per content out to every record that shares it.

    `results`: source_sha256, policy, error.  Adds status, policy, error."""
    joined = records.join(results.withColumn("_hit", F.lit(True)), "source_sha256", "left")
    status = (F.when(F.col("source_sha256").isNull(), F.lit("needs_ocr"))
               .when(F.col("error").isNotNull(), F.lit("extraction_error"))
               .otherwise(F.lit("extracted")))
    return joined.withColumn("status", status).drop("_hit")
