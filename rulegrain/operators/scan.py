"""Ordered state machines as an associative scan.

A message is a function from step to next step; functions compose, so the step before each
message is a prefix product.  Messages are composed in chunks of bounded length, chunks in
chunks of chunks, and entry steps are handed down again.  A sender with any number of messages
thus spreads over tasks, and nothing but a chunk is ever held together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulegrain.operators.flatten import unnest

FANOUT = 2048
LEVELS = 3          # 2048 ** 3 messages per sender before the top level grows


def _compose(first: Column, then: Column) -> Column:
    return F.struct(
        F.transform(first["move"], lambda s: F.get(then["move"], s)).alias("move"),
        (first["resets"] + then["resets"]).alias("resets"))


def _product(items: Column, steps: int) -> Column:
    identity = F.struct(F.expr(f"sequence(0, {steps - 1})").alias("move"),
                        F.lit(0).cast("bigint").alias("resets"))
    return F.aggregate(items, identity, lambda acc, item: _compose(acc, item))


def _entries(items: Column, step: Column, resets: Column) -> Column:
    """(at, step, resets) before each item, given what holds before the first."""
    start = F.struct(
        step.alias("step"), resets.alias("resets"),
        F.expr("CAST(array() AS array<struct<at:bigint,step:int,resets:bigint>>)").alias("out"))

    def advance(acc: Column, item: Column) -> Column:
        here = F.struct(item["at"].alias("at"), acc["step"].alias("step"),
                        acc["resets"].alias("resets"))
        return F.struct(F.get(item["move"], acc["step"]).alias("step"),
                        (acc["resets"] + item["resets"]).alias("resets"),
                        F.array_append(acc["out"], here).alias("out"))

    return F.aggregate(items, start, advance, lambda acc: acc["out"])


def steps_before(messages: DataFrame, steps: int, entry: DataFrame | None = None,
                 key: str = "sender", at: str = "at", fanout: int = FANOUT,
                 levels: int = LEVELS) -> DataFrame:
    """(key, at, step, resets) before each message.

    `messages`: key, at (unique per key, counting up from 0), move (array<int>, next step by
    step), resets (how often it restarts).  `entry` (key, step, resets) continues earlier
    messages; without it every key starts at step 0."""
    level = messages.select(key, F.col(at).cast("bigint").alias("at"), "move",
                            F.col("resets").cast("bigint").alias("resets"))
    chunks = []
    for depth in range(levels):
        last = depth == levels - 1
        group = F.lit(0).cast("bigint") if last else F.floor(F.col("at") / fanout)
        grouped = (level.withColumn("_g", group)
                   .groupBy(key, "_g")
                   .agg(F.sort_array(F.collect_list(F.struct("at", "move", "resets")))
                        .alias("_items")))
        chunks.append(grouped)
        level = grouped.select(key, F.col("_g").alias("at"),
                               _product(F.col("_items"), steps).alias("_p")) \
                       .select(key, "at", "_p.move", "_p.resets")
    zero = F.lit(0)
    if entry is None:
        known = chunks[-1].withColumn("_step", zero).withColumn("_resets", zero.cast("bigint"))
    else:
        known = (chunks[-1].join(entry.select(key, F.col("step").alias("_step"),
                                              F.col("resets").cast("bigint").alias("_resets")),
                                 key, "left")
                 .withColumn("_step", F.coalesce("_step", zero))
                 .withColumn("_resets", F.coalesce("_resets", zero.cast("bigint"))))
    for depth in range(levels - 1, -1, -1):
        placed = known.withColumn("_before", _entries(F.col("_items"), F.col("_step"),
                                                      F.col("_resets")))
        flat = unnest(placed, "_before", "_b", [key]).select(key, "_b.*")
        if depth == 0:
            return flat
        below = flat.select(key, F.col("at").alias("_g"), F.col("step").alias("_step"),
                            F.col("resets").alias("_resets"))
        known = chunks[depth - 1].join(below, [key, "_g"])
    raise AssertionError("levels must be positive")


