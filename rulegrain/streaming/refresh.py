"""Incremental refresh: every arriving snapshot is compared, guarded and, if sound, merged."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rulegrain import reference_values as V
from rulegrain.operators import snapshots as N
from rulegrain.sources.readers import exists
from rulegrain.sources.sinks import KeyedTable

SNAPSHOT = ("key string, hospital string, charity_care struct<url:string,effective_date:string>, "
            "discount_payment struct<url:string,effective_date:string>, content_sha string")
METRICS = "n bigint, removed bigint, current bigint, baseline bigint"
BUCKETS = 64


def baseline_table(spark, folder: str, buckets: int = BUCKETS) -> KeyedTable:
    return KeyedTable(spark, f"{folder}/baseline", SNAPSHOT, buckets)


def refresh(current: DataFrame, folder: str, batch_id: int,
            on_change: Callable[[DataFrame, int], None] | None = None,
            max_changed: int = V.REFRESH_MAX_CHANGED,
            max_removed: int = V.REFRESH_MAX_REMOVED, buckets: int = BUCKETS) -> str:
    """One refresh run; returns the decision.

    The first snapshot becomes the baseline.  A later one is merged into it only when the guards let it
    proceed and `on_change` (re-extraction of the changed keys) succeeded; otherwise the
    baseline stays, so the change is seen again next time.  Only buckets that hold a changed key are
    rewritten.

    A run that is started again finds its changes and counts written and goes on from there; merging
    them twice gives the same baseline.  Changes are written with the records they bring, so a snapshot
    is read once and no copy of it is kept; the stream shows a batch that runs again the same snapshot."""
    spark = current.sparkSession
    at = lambda kind: f"{folder}/{kind}/batch={batch_id:012d}"
    baseline = baseline_table(spark, folder, buckets)
    if batch_id == 0:
        baseline.merge(N.last_records(current))
        return "established"
    if not exists(spark, f"{at('metrics')}/_SUCCESS"):
        found, counts = N.observed_diff(current, baseline.read(), unique_baseline=True, with_rows=True)
        found.write.mode("overwrite").parquet(at("changes"), compression="zstd")
        spark.createDataFrame([N.observed_metrics(counts)], METRICS).write.mode("overwrite").parquet(at("metrics"))
    changes = spark.read.parquet(at("changes"))
    verdict = N.decide(spark.read.schema(METRICS).parquet(at("metrics")), max_changed, max_removed)
    decision = verdict.select("decision").first()[0]        # one row
    if decision == "proceed":
        if on_change is not None:
            on_change(changes.filter(F.col("change").isin("changed", "new")).drop("now"), batch_id)
        baseline.merge(changes.filter("change <> 'removed'").select("now.*"), changes.filter("change = 'removed'").select("key"))
    return decision


def refresh_stream(snapshots: DataFrame, folder: str, **kwargs) -> StreamingQuery:
    """Run `refresh` for every trigger; each trigger must bring one whole snapshot."""
    trigger = kwargs.pop("trigger", {"availableNow": True})

    def step(batch: DataFrame, batch_id: int) -> None:
        refresh(batch, folder, batch_id, **kwargs)

    return (snapshots.writeStream.foreachBatch(step)
            .option("checkpointLocation", f"{folder}/checkpoint").trigger(**trigger).start())
