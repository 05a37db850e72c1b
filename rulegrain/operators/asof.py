"""As-of join: each row with the last version that is in effect on its date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rulegrain.session import settle

_POSITION_BITS = 33       # monotonically_increasing_id: partition id above, position below


def as_of(rows: DataFrame, versions: DataFrame, on: str, effective: str, by: list[str] | None = None,
          out: str = "version") -> DataFrame:
    """Add `out`, the struct of the version with the latest `effective` date up to `on` among those of the
    same `by` values; null where none is in effect yet, where `on` is null, or where a `by` value is.

    Both sides are sorted together by range, so neither a date nor a `by` value that many rows share is one
    task's work.  Each row takes the last version before it in its range; what a range begins with comes from one
    row per range.  Of versions with one date the largest counts.  Runs a job."""
    by = by or []
    names = versions.columns
    keys = [F.col(c).alias(f"_by{i}") for i, c in enumerate(by)]
    own = rows.select(*keys, F.col(on).alias("_at"), F.lit(1).alias("_kind"), F.struct(*rows.columns).alias("_row"),
                      F.lit(None).cast(versions.select(F.struct(*names).alias("v")).schema["v"].dataType).alias("_v"))
    known = versions.filter(F.col(effective).isNotNull()).select(
        *keys, F.col(effective).alias("_at"), F.lit(0).alias("_kind"),
        F.lit(None).cast(own.schema["_row"].dataType).alias("_row"), F.struct(*names).alias("_v"))
    order = [*[f"_by{i}" for i in range(len(by))], "_at", "_kind"]
    spread = F.xxhash64("_row")                                  # parts rows of one date
    merged = own.unionByName(known).withColumn("_spread", spread)
    placed = settle(merged.repartitionByRange(*order, "_spread").sortWithinPartitions(*order, "_v")
                    .withColumn("_id", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_id", _POSITION_BITS))
    ends = placed.filter("_kind = 0").groupBy("_part").agg(F.max_by("_v", "_id").alias("_last"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = placed.select("_part").distinct().join(ends, "_part", "left").select(
        "_part", F.last("_last", ignorenulls=True).over(before).alias("_carried"))   # a row per range
    upto = W.partitionBy("_part").orderBy("_id").rowsBetween(W.unboundedPreceding, 0)
    met = (placed.withColumn("_here", F.last("_v", ignorenulls=True).over(upto)).filter("_kind = 1")
           .join(parts, "_part").withColumn("_found", F.coalesce("_here", "_carried")))
    same = F.col("_at").isNotNull()
    for i, c in enumerate(by):
        same = same & F.coalesce(F.col(f"_by{i}") == F.col("_found")[c], F.lit(False))
    return met.select("_row.*", F.when(same, F.col("_found")).alias(out))
