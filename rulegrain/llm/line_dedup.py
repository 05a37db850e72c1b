"""Removal of repeated line runs with a suffix array over line ids.

A document is its sequence of lines that hold a word (blank lines are passed over and stay).  A line
is a pair of 64-bit hashes of its bytes without surrounding white space.  The suffix array of all
sequences is built by prefix doubling: suffixes are ranked by their first line, then by pairs of ranks
2^h lines apart, so that after h rounds they are in the order of their first 2^h lines.  Ranks come from
a range-partitioned sort of the distinct pairs and a running count over partitions.  A suffix that
shares its rank with no other is settled: no run that starts there is repeated, and it leaves.

Suffixes that share their first L lines stand next to each other: they are the intervals of the array
whose longest common prefixes are L or more.  A run counts as repeated when it has `min_lines` lines,
or when a single line has `min_words` words.  Doubling therefore goes on until prefixes of `min_lines`
lines are told apart, as longer ones lie in the same intervals.  In each interval the first suffix
(smallest document id, then row, then line) keeps its lines and those of all others are deleted;
overlapping intervals of a document join to its maximal repeated runs.

Defined cases: null and empty texts stay as they are; a null id counts as the largest; rows of one id
and one text are one document, and all of them stay; a text all of whose lines with words are deleted
keeps its blank lines."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulegrain.llm.storage import Scratch

MIN_LINES = 2
MIN_WORDS = 8
_SPACE = r"\x20\x09-\x0D"
_LINE = ["doc", "text_key", "line"]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("doc", F.coalesce(F.col("doc_id").cast("bigint"), F.lit((1 << 63) - 1))).withColumn(
        "text_key", F.xxhash64("text"))


def _lines(keyed: DataFrame) -> DataFrame:
    """(doc, text_key, line, place, first, second, n_words): lines with words, numbered without the
    others; `place` counts all."""
    trimmed = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.struct(
        i.alias("place"), F.regexp_replace(x, f"^[{_SPACE}]+|[{_SPACE}]+$", "").alias("body")))
    cut = keyed.select("doc", "text_key", F.posexplode_outer(F.filter(trimmed, lambda x: x.body != "")).alias(
        "line", "at")).filter("line IS NOT NULL")
    return cut.select("doc", "text_key", "line", "at.place", F.xxhash64("at.body").alias("first"),
                      F.xxhash64(F.lit("second"), "at.body").alias("second"),
                      F.regexp_count("at.body", F.lit(f"[^{_SPACE}]+")).alias("n_words"))


def _ranks(suffixes: DataFrame, scratch: Scratch) -> DataFrame:
    """(first, second, rank, n, kept): distinct pairs with the number of suffixes before them in the
    order of pairs, of those that share them, and the first of these."""
    counted = suffixes.groupBy("first", "second").agg(F.count("*").alias("n"), F.min(_order()).alias("kept"))
    tasks = int(suffixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = scratch.write(counted.repartitionByRange(tasks, "first", "second")
                            .sortWithinPartitions("first", "second").withColumn("part", F.spark_partition_id()))
    sums = ordered.groupBy("part").agg(F.sum("n").alias("size"))
    ahead = scratch.write(sums.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("ahead")))
    inside = Window.partitionBy("part").orderBy("first", "second").rowsBetween(Window.unboundedPreceding, -1)
    return ordered.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(
        F.broadcast(ahead), "part").select("first", "second", (F.col("before") + F.col("ahead")).alias("rank"), "n", "kept")


def _ranked(suffixes: DataFrame, scratch: Scratch) -> DataFrame:
    """Suffixes whose pair somebody shares, with its rank and whether an earlier one has it; the others
    are settled.  Copies of one line may be a third of all rows; the skew join splits such a key."""
    ranks = scratch.write(_ranks(suffixes, scratch).filter("n > 1").drop("n"))
    joined = suffixes.join(ranks, ["first", "second"])
    return scratch.write(joined.withColumn("later", _order() != F.col("kept")).drop("first", "second", "kept"))


def _order() -> Column:
    return F.struct("doc", "text_key", "line")


def repeated_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """Lines with words of `docs` (doc_id, text), and those of them to delete (doc, text_key, place)."""
    scratch = Scratch(docs.sparkSession, "lines")
    lines = scratch.write(_lines(_keyed(docs)))
    ranked = _ranked(lines.select(*_LINE, "n_words", "first", "second"), scratch)
    deleted = ranked.filter(F.col("later") & (F.col("n_words") >= min_words)).select(*_LINE, F.lit(1).alias("length"))
    reach, current = 1, ranked.select(*_LINE, "rank", "later")
    while reach < min_lines:
        step = min(reach, min_lines - reach)  # the last step overlaps, to end at min_lines
        following = current.select("doc", "text_key", (F.col("line") - step).alias("line"),
                                   F.col("rank").alias("second")).distinct()
        pairs = current.drop("later").withColumnRenamed("rank", "first").join(following, _LINE)
        current, reach = _ranked(pairs, scratch), reach + step
    deleted = deleted.unionByName(current.filter("later").select(*_LINE, F.lit(reach).alias("length")))
    gone = deleted.select("doc", "text_key", F.explode(F.sequence(
        F.col("line"), F.col("line") + F.col("length") - 1)).alias("line")).distinct()
    return lines, lines.join(gone, _LINE).select("doc", "text_key", "place").distinct()


def _delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            texts, n_lines, n_deleted = [], [], []
            for text, places in zip(part.column("line_text").to_pylist(), part.column("line_places").to_pylist(), strict=True):
                cut = [] if text is None else text.split("\n")
                gone = set(places or ())
                n_lines.append(sum(1 for x in cut if x.strip(" \t\n\x0b\x0c\r")))
                n_deleted.append(len(gone))
                texts.append(text if not gone else "\n".join([x for i, x in enumerate(cut) if i not in gone]))
            others = [c for c in part.schema.names if c not in ("line_text", "line_places")]
            yield pa.RecordBatch.from_arrays(
                [part.column(c) for c in others] + [pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()),
                                                    pa.array(n_deleted, pa.int64())],
                names=[*others, "line_text", "line_n", "line_gone"])


def remove_repeated_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """`docs` with the deleted lines taken out of `text`, and n_lines (lines with words before) and
    n_deleted in a struct column `line_counts`."""
    _, gone = repeated_lines(docs.select("doc_id", "text"), min_lines, min_words)
    places = gone.groupBy("doc", "text_key").agg(F.collect_list("place").alias("line_places"))  # of one text
    names = [f"c{i}" for i in range(len(docs.columns))]
    key = _keyed(docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`").alias(n) for c, n in zip(
        docs.columns, names, strict=True) if c != "text"]).alias("row")))
    joined = key.join(places, ["doc", "text_key"], "left").select(
        "row.*", F.col("text").alias("line_text"), "line_places")
    schema = T.StructType([*[f for f in joined.schema.fields if f.name not in ("line_text", "line_places")],
                           T.StructField("line_text", T.StringType()), T.StructField("line_n", T.LongType()),
                           T.StructField("line_gone", T.LongType())])
    done = joined.mapInArrow(_delete, schema)
    return done.select(*[F.col("line_text" if c == "text" else n).alias(c) for c, n in zip(
        docs.columns, names, strict=True)], F.struct(F.col("line_n").alias("n_lines"),
                                                      F.col("line_gone").alias("n_deleted")).alias("line_counts"))
