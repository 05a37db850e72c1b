"""From raw documents to token ids: the stages of a training corpus, each written and read again.

A stage takes (spark, docs, sf_dir) and returns the rows that go on, with the columns of `docs` (the
last one returns token ids).  Columns beyond those of documents travel along under any name.  The
places of the mix are a side table, as order does not outlive a table that is read again: the
metadata of doc_id name it, which Parquet keeps, and the last stage joins it back.

Defined cases: rows without text or with few words fail the quality rules; a document that loses all
its lines goes; rows with a null id are kept by every stage that compares documents; of rows with
one id and text one goes on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rulegrain.llm import bpe, line_dedup, ngram_jaccard, quality_rules, source_mix
from rulegrain.llm.storage import Scratch, read_table
from rulegrain.session import scratch_path

_OWN = ("doc_id", "text", "source")
_PLACE_KEY = ("doc_id", "text_key", "source")
_PLACES = "mix_places"


def _packed(docs: DataFrame) -> DataFrame:
    """The columns that stages look at, and the others out of the way of names they add."""
    rest = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c not in _OWN]
    return docs.select(*_OWN, F.struct(*rest, F.lit(0).alias("none")).alias("others"))


def _unpacked(rows: DataFrame, like: DataFrame) -> DataFrame:
    return rows.select(*[F.col(c) if c in _OWN else F.col(f"others.c{i}").alias(c)
                         for i, c in enumerate(like.columns)])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base and the learned rules keep."""
    stats = Scratch(spark, "quality").write(
        quality_rules.statistics(docs.select("doc_id", "text")).drop("text"))
    rules = quality_rules.learn(stats, read_table(spark, sf_dir, "labels"))
    counted = quality_rules.statistics(_packed(docs))
    return _unpacked(counted.filter(quality_rules.verdict(F.col("stats"), rules)), docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of repeated lines; texts with nothing left go."""
    done = line_dedup.remove_repeated_lines(_packed(docs))
    counts = F.col("line_counts")
    left = done.filter((counts.n_deleted == 0) | (counts.n_deleted < counts.n_lines))
    out = left.withColumn("cut", counts.n_deleted > 0)
    rows = _unpacked(out, docs)
    if "n_chars" not in docs.columns:
        return rows
    at = docs.columns.index("n_chars")
    return out.select(*[
        F.when(F.col("cut"), F.char_length("text").cast(docs.schema["n_chars"].dataType))
        .otherwise(F.col(f"others.c{at}")).alias(c) if c == "n_chars"
        else F.col(c) if c in _OWN else F.col(f"others.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of links (five words, four fifths) the document with the smallest id."""
    found = ngram_jaccard.join(docs.select("doc_id", "text"), width=5, num=4, den=5)
    stay = Scratch(spark, "jaccard-kept").write(
        found.filter("doc_id = component_id").select(F.col("doc_id").alias("kept_id")).distinct())
    rows = _packed(docs)
    one = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("source")
    kept = (rows.join(stay, F.col("doc_id") == F.col("kept_id"), "left_semi")
                .withColumn("copy", F.row_number().over(one)).filter("copy = 1").drop("copy"))
    return _unpacked(kept.unionByName(rows.filter("doc_id IS NULL")), docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix, and their places in it in a side table."""
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    mixed = source_mix.mix(_packed(docs).withColumn("text_key", F.xxhash64("text")))
    places = scratch_path(spark, "mix-places")
    mixed.select(*_PLACE_KEY, "mix_slot", "mix_chars_before").write.parquet(places)
    rows = _unpacked(source_mix.in_order(mixed, tasks), docs)
    return rows.withMetadata("doc_id", {**docs.schema["doc_id"].metadata, _PLACES: places})


def _placed(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows with mix_slot and mix_chars_before, sorted by them.

    Copies, which may only differ in columns that the mix does not look at, are numbered on both
    sides, so that each place is given once."""
    path = docs.schema["doc_id"].metadata.get(_PLACES)
    if path is None:
        raise ValueError("the rows do not come from the source mix")
    table = spark.read.parquet(path)
    one = Window.partitionBy(*_PLACE_KEY)
    places = table.select(*[F.col(c).alias(f"place_{c}") for c in _PLACE_KEY], "mix_slot", "mix_chars_before",
                          F.row_number().over(one.orderBy("mix_slot", "mix_chars_before")).alias("place_copy"))
    rows = docs.withColumn("text_key", F.xxhash64("text"))
    rows = rows.withColumn("copy", F.row_number().over(one.orderBy("lang" if "lang" in docs.columns else "text_key")))
    same = F.col("copy") == F.col("place_copy")
    for c in _PLACE_KEY:
        same &= F.col(c).eqNullSafe(F.col(f"place_{c}"))
    lost = F.raise_error(F.lit("a row has no place in the mix")).cast("bigint")
    found = rows.join(places.hint("merge"), same, "left").select(
        *docs.columns, F.coalesce("mix_slot", lost).alias("mix_slot"), "mix_chars_before")
    return source_mix.in_order(found, int(spark.conf.get("spark.sql.shuffle.partitions")))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document and the hash of what they decode to, in the order of the mix:
    sorted by (mix_slot, mix_chars_before, doc_id)."""
    import public_tokenizers

    own = [c for c in ("doc_id", "lang", "source") if c in docs.columns]
    return bpe.encode(_placed(spark, docs.select(*own, "text")), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                      public_tokenizers.PATTERN, keep=[*own, "mix_slot", "mix_chars_before"])


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram jaccard join", near_duplicates),
          ("source mix", mix), ("byte-level bpe", token_ids)]

#: Learned rules and merges have no SQL form; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
