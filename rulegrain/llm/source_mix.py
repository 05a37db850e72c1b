"""Mixing sources to target weights with a Pfair schedule.

The texts of a source, in a shuffled order that depends on ids alone, are cut into blocks of
`block_chars` characters.  Time is counted in slots of one block and a frame has a fixed number of
slots, of which source s owns m(s) >= 1, its weight in whole slots.  Block i of a frame (from 1) is
released at floor((i-1) * frame / m) and due at ceil(i * frame / m); each slot goes to the released
block with the earliest deadline.  So at every slot each source is within one block of its share,
and after a frame all shares are exact, which makes the schedule periodic: one frame is laid out, by
a fold over its slots, and every block finds its slot from its number alone.  A source that has run
out leaves its slots empty and the others keep their order.

Defined cases: a null source is a source of its own; a null text has no characters; a text longer
than a block spans the following block numbers; texts without characters go with the block where
they fall; repeated rows all stay; an empty table gives no rows; other columns come back whatever their
names.  No row is dropped or repeated.

Weights are rounded to 1/FRAME and the frame repeats, so against unrounded weights the deviation grows with the
number of frames; within one block it stays only against the rounded ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulegrain.llm.storage import Scratch

FRAME = 1024  # slots; weights are rounded to 1/FRAME
BLOCK_CHARS = 65536
BUCKET_ROWS = 4096  # rows of a source that are numbered in one task, on average
PLACE = ["mix_slot", "mix_block", "mix_chars_before"]  # columns of these names in the input are replaced
_KEY = "coalesce(concat('=', source), '')"


def source_totals(docs: DataFrame) -> DataFrame:
    """One row a source: (source_key, n_rows, chars)."""
    return docs.groupBy(F.expr(_KEY).alias("source_key")).agg(
        F.count("*").alias("n_rows"), F.sum(F.coalesce(F.char_length("text"), F.lit(0))).alias("chars"))


def tempered(totals: DataFrame, power: float) -> DataFrame:
    """Target weights in proportion to a power of a source's size."""
    return totals.select("source_key", F.pow(F.greatest(F.col("chars"), F.lit(1)).cast("double"), F.lit(power))
                         .alias("weight"))


def quotas(weights: DataFrame, frame: int = FRAME) -> DataFrame:
    """Whole slots of a frame by largest remainder, one at least for each source."""
    everything = Window.partitionBy(F.lit(0))
    n = F.count("*").over(everything)
    share = weights.select("source_key", (F.col("weight") / F.sum("weight").over(everything)
                                          * (F.lit(frame) - n)).alias("exact"), n.alias("n"))
    rest = (F.lit(frame) - F.col("n") - F.sum(F.floor("exact")).over(everything)).cast("bigint")
    order = Window.partitionBy(F.lit(0)).orderBy((F.floor("exact") - F.col("exact")).asc(), "source_key")
    return share.select("source_key", (1 + F.floor("exact") + F.when(
        F.row_number().over(order) <= rest, 1).otherwise(0)).cast("int").alias("slots"))


def frame_layout(quota: DataFrame) -> DataFrame:
    """(source_key, nth, slot): which slot the nth block (from 0) of a source takes in a frame.

    One row of state, the frame times the sources in size; it doesn't grow with the texts."""
    sources = quota.agg(F.array_sort(F.collect_list(F.struct("source_key", "slots"))).alias("s"),
                        F.sum("slots").cast("int").alias("frame"))
    return sources.withColumn("plan", F.expr("""
      aggregate(sequence(0, frame - 1),
        named_struct('used', transform(s, x -> 0), 'taken', slice(array(0), 1, 0)),
        (acc, t) -> aggregate(
          array(array_min(filter(transform(s, (x, j) -> named_struct(
              'late', acc.used[j] >= x.slots
                      OR cast(acc.used[j] AS bigint) * frame div x.slots > t,
              'due', (cast(acc.used[j] + 1 AS bigint) * frame + x.slots - 1) div x.slots,
              'at', j)), x -> NOT x.late)).at),
          acc,
          (a, pick) -> named_struct(
            'used', transform(a.used, (u, j) -> IF(j = pick, u + 1, u)),
            'taken', concat(a.taken, array(pick)))),
        acc -> acc.taken)""")).select("s", F.posexplode("plan").alias("slot", "at")).select(
        F.expr("s[at].source_key").alias("source_key"), "slot",
        (F.row_number().over(Window.partitionBy("at").orderBy("slot")) - 1).alias("nth"))


def _own(docs: DataFrame) -> list[str]:
    return [c for c in docs.columns if c not in PLACE]


def _renamed(docs: DataFrame) -> list[Column]:
    """The rows' own columns under names that meet no others; one by one, so that unused ones are not read."""
    return [F.col(f"`{c}`").alias(f"mix_own_{i}") for i, c in enumerate(_own(docs))]


def _numbered(docs: DataFrame, totals: DataFrame, seed: str) -> DataFrame:
    """Each row with its source's characters before it.

    A source is dealt into buckets of its shuffled order, as many as its rows need, so a source
    that holds most rows is summed in many tasks: within buckets first, then over bucket totals."""
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("/"),
                         F.coalesce("text", F.lit(""))))
    wide = docs.select(*_renamed(docs), "doc_id", F.expr(_KEY).alias("mix_source"), key.alias("mix_key"),
                       F.coalesce(F.char_length("text"), F.lit(0)).cast("bigint").alias("mix_chars"))
    buckets = totals.select(F.col("source_key").alias("mix_source"), "chars",
                            F.greatest(F.lit(1), F.ceil(F.col("n_rows") / BUCKET_ROWS)).alias("n_buckets"))
    place = F.floor(F.conv(F.substring("mix_key", 1, 8), 16, 10).cast("bigint") * F.col("n_buckets")
                    / F.lit(1 << 32))
    return wide.join(buckets, "mix_source").withColumn("mix_bucket", place).drop("n_buckets")


def mix(docs: DataFrame, weights: DataFrame | None = None, power: float = 0.5, frame: int = FRAME,
        block_chars: int = BLOCK_CHARS, seed: str = "mix") -> DataFrame:
    """Every row of `docs` with mix_slot, mix_block, mix_chars_before: sorted by (mix_slot,
    mix_chars_before, doc_id) they are the mix.  `weights` has (source_key, weight); left out,
    targets are the sources' sizes to `power`."""
    scratch = Scratch(docs.sparkSession, "mix")
    totals = scratch.write(source_totals(docs))
    wanted = tempered(totals, power) if weights is None else totals.select("source_key").join(
        weights, "source_key", "left").fillna(0.0, ["weight"])
    quota = scratch.write(quotas(wanted, max(frame, 4 * totals.count())))
    layout = scratch.write(frame_layout(quota))
    numbered = _numbered(docs, totals, seed)
    # bucket totals need no text and no order
    sums = numbered.groupBy("mix_source", "mix_bucket").agg(F.sum("mix_chars").alias("mix_sum"))
    ahead = sums.select("mix_source", "mix_bucket", F.coalesce(F.sum("mix_sum").over(
        Window.partitionBy("mix_source").orderBy("mix_bucket").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("mix_ahead"))
    inner = Window.partitionBy("mix_source", "mix_bucket").orderBy("mix_key", "doc_id").rowsBetween(
        Window.unboundedPreceding, -1)
    located = (numbered.withColumn("mix_within", F.coalesce(F.sum("mix_chars").over(inner), F.lit(0)))
                       .join(scratch.write(ahead), ["mix_source", "mix_bucket"])
                       .withColumn("mix_chars_before", F.col("mix_ahead") + F.col("mix_within")))
    last = F.greatest(F.lit(0), F.ceil(F.col("chars") / block_chars) - 1)
    block = F.least(F.floor(F.col("mix_chars_before") / block_chars), last)
    slots = quota.select(F.col("source_key").alias("mix_source"), "slots", F.sum("slots").over(
        Window.partitionBy(F.lit(0))).alias("mix_frame"))
    placed = (located.withColumn("mix_block", block.cast("bigint")).join(slots, "mix_source")
              .withColumn("mix_nth", (F.col("mix_block") % F.col("slots")).cast("int"))
              .join(layout.select(F.col("source_key").alias("mix_source"), F.col("nth").alias("mix_nth"), "slot"),
                    ["mix_source", "mix_nth"])
              .withColumn("mix_slot", F.floor(F.col("mix_block") / F.col("slots")) * F.col("mix_frame")
                          + F.col("slot")))
    return placed.select(*[F.col(f"mix_own_{i}").alias(c) for i, c in enumerate(_own(docs))], *PLACE)


def in_order(mixed: DataFrame, tasks: int) -> DataFrame:
    """The rows in the order of the mix, a stretch of it in each task."""
    order: list[str | Column] = ["mix_slot", "mix_chars_before", "doc_id"]
    return mixed.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
