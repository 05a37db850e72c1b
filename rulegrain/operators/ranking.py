"""Numbering rows in a total order without a single-task window.

A window without (or with a hot) partition key sorts everything in one task.  Here rows are
range-partitioned by the full order, so a hot group spreads over many tasks; the row number is
a per-partition offset plus the position inside the partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rulegrain.session import settle

_POSITION_BITS = 33       # monotonically_increasing_id: partition id above, position below


def number_rows(df: DataFrame, order: list[str], out: str = "n") -> DataFrame:
    """Add `out`: 1..n by `order`, which must be a total order.

    Runs a job: the sorted rows are written with their positions, which both passes read."""
    spread = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    placed = settle(spread.withColumn("_id", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_id", _POSITION_BITS))
    # one row per partition
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_size"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0))
                           .alias("_before"))
    within = F.col("_id").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    return (placed.join(F.broadcast(offsets), "_part")     # as many rows as partitions
                  .withColumn(out, F.col("_before") + within + 1)
                  .drop("_id", "_part", "_before"))


def number_within(df: DataFrame, group: list[str], order: list[str],
                  out: str = "n") -> DataFrame:
    """Add `out`: 1..n within each group; groups may be of any size."""
    placed = number_rows(df, [*group, *order], out="_n")
    first = placed.groupBy(*group).agg(F.min("_n").alias("_first")) \
                  .withColumnsRenamed({g: f"_of_{g}" for g in group})
    same = [F.col(g).eqNullSafe(F.col(f"_of_{g}")) for g in group]
    return placed.join(first, same).select(
        *df.columns, (F.col("_n") - F.col("_first") + 1).alias(out))
