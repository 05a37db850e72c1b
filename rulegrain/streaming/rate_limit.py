"""Rate-limit admission of a hit stream, in Spark's own keyed state.

The state of a key are its admitted hits of the last window, `limit` numbers at most.  With a `ttl`, Spark
drops a key that is silent for so many seconds of processing time: where hits are taken as they arrive, a
window's length of silence leaves nothing to remember, so a ttl of the window or more changes no answer.
It needs a trigger that goes on; a run over what is there (`availableNow`) keeps all keys."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from rulegrain import reference_values as V
from rulegrain.operators.admission import from_micros, micros, pass_hits
from rulegrain.streaming.state import use_state_store


_COLUMNS = ["_k", "_t", "_id", "_group"]


class Admission(StatefulProcessor):
    """Hits of a trigger are taken by (time, id); refused ones are jumped over."""

    def __init__(self, limit: int, span: int, ttl_ms: int | None):
        self.limit, self.span, self.ttl_ms = limit, span, ttl_ms

    def init(self, handle) -> None:
        self.recent = handle.getValueState("recent", "times array<bigint>", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        recent = deque(self.recent.get()[0] if self.recent.exists() else [])
        hits = pd.concat([frame.set_axis(_COLUMNS, axis=1) for frame in rows]).sort_values(["_t", "_id"])  # times and ids of one key and trigger
        times = hits["_t"].to_numpy(np.int64)
        admitted = pass_hits(times, np.zeros(len(times), bool), recent, self.limit, self.span)
        self.recent.update(([int(t) for t in recent],))
        yield pd.DataFrame({"_k": hits["_k"].to_numpy(), "_t": times, "_id": hits["_id"].to_numpy(), "admitted": admitted})

    def close(self) -> None:
        pass


def admission_stream(hits: DataFrame, limit: int = V.RATE_LIMIT, window: float = V.RATE_WINDOW_SECONDS,
                     ttl: float | None = None) -> DataFrame:
    """(key, ts, id, admitted) of a stream of (key, ts, id)."""
    use_state_store(hits.sparkSession)
    kinds = dict(hits.dtypes)
    narrow = hits.select(F.col("key").alias("_k"), micros(hits, "ts").alias("_t"), F.col("id").alias("_id"))
    kept = None if ttl is None else int(max(window, ttl) * 1000)
    # state is kept under a text that a null key has as well
    grouped = narrow.withColumn("_group", F.coalesce(F.concat(F.lit("="), F.col("_k").cast("string")), F.lit(""))) \
        .select(*_COLUMNS)
    decided = grouped.groupBy("_group").transformWithStateInPandas(
        Admission(limit, int(window * 1_000_000), kept),
        f"_k {kinds['key']}, _t bigint, _id {kinds['id']}, admitted boolean", "append",
        "none" if kept is None else "processingTime")
    return decided.select(F.col("_k").alias("key"), from_micros(F.col("_t"), kinds["ts"]).alias("ts"),
                          F.col("_id").alias("id"), "admitted")
