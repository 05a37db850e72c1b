"""Rate-limit admission: a hit passes if fewer than `limit` admitted hits of its key lie in the
last `window` seconds.  Denied hits do not count, so a window frame cannot say it.

The fold is cut where its state is known without it.  Admitted hits are a subset of all hits, so
a hit with fewer than `limit` raw predecessors in its window is admitted for certain; after a
window of such hits the state is exactly those hits.  A key's time line therefore falls apart
into runs that fold independently, and only runs that ever reach the limit fold at all — a hot
key is one task's work only for as long as it is being refused without pause, and that task
jumps over the refused hits.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rulegrain import reference_values as V

_BLOCK_WINDOWS = 16          # width of a time block in windows


def micros(df: DataFrame, ts: str) -> Column:
    """Microseconds since 1970 of either timestamp type, whatever the session's zone."""
    if dict(df.dtypes)[ts] == "timestamp_ntz":
        return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), F.col(ts))
    return F.unix_micros(ts)


def from_micros(t: Column, kind: str) -> Column:
    epoch = F.lit("1970-01-01 00:00:00Z" if kind == "timestamp" else "1970-01-01 00:00:00").cast(kind)
    return F.timestamp_add("MICROSECOND", t, epoch)


def admit(hits: DataFrame, limit: int = V.RATE_LIMIT, window: float = V.RATE_WINDOW_SECONDS,
          key: str = "key", ts: str = "ts", hit_id: str = "id",
          earlier: DataFrame | None = None) -> DataFrame:
    """(key, ts, id, admitted).  Hits of a key are taken by (ts, id).

    `earlier` (key, ts) are hits admitted before this batch; they count but are not returned."""
    span = int(window * 1_000_000)
    width = span * _BLOCK_WINDOWS
    kinds = dict(hits.dtypes)
    own = hits.select(F.col(key).alias("_k"), micros(hits, ts).alias("_t"),
                      F.col(hit_id).alias("_id"), F.lit(False).alias("_seed"))
    if earlier is not None:
        own = own.unionByName(earlier.select(
            F.col(key).alias("_k"), micros(earlier, ts).alias("_t"),
            F.lit("0").cast(kinds[hit_id]).alias("_id"), F.lit(True).alias("_seed")))
    own = own.withColumn("_block", F.floor(F.col("_t") / width).cast("bigint")) \
             .withColumn("_own", F.lit(True))
    in_tail = F.col("_t") >= (F.col("_block") + 1) * width - span
    # the last window of a block also opens the next one
    both = own.unionByName(own.filter(in_tail).withColumn("_block", F.col("_block") + 1)
                           .withColumn("_own", F.lit(False)))
    recent = F.count("*").over(W.partitionBy("_k", "_block").orderBy("_t")
                               .rangeBetween(-(span - 1), 0))
    counted = both.withColumn("_dense", recent > limit)
    # a block that ends dense hands an unknown state to the next block
    blocks = counted.groupBy("_k", "_block").agg(
        F.max(F.col("_dense") & F.col("_own")).alias("_any"),
        F.max(F.col("_dense") & F.col("_own") & in_tail).alias("_tail"),
        F.max("_own").alias("_has_own"))
    # one row per key and block of time, not per hit
    line = W.partitionBy("_k").orderBy("_block")
    linked = (F.lag("_block").over(line) == F.col("_block") - 1) & F.lag("_tail").over(line)
    starts = blocks.withColumn("_start", F.when(~F.coalesce(linked, F.lit(False)),
                                                F.col("_block")))
    run = F.last("_start", ignorenulls=True).over(line.rowsBetween(W.unboundedPreceding, 0))
    runs = starts.withColumn("_run", run)
    dense_runs = runs.groupBy("_k", "_run").agg(F.max("_any").alias("_fold"))
    placed = runs.select("_k", "_block", "_run").join(dense_runs, ["_k", "_run"])
    rows = counted.join(placed, ["_k", "_block"])
    free = rows.filter(~F.col("_fold") & F.col("_own") & ~F.col("_seed")) \
               .select("_k", "_t", "_id", F.lit(True).alias("admitted"))
    # a run is opened by its own hits and, before its first block, by hits known to be admitted
    fold = rows.filter(F.col("_fold") & (F.col("_own") | (F.col("_block") == F.col("_run")))) \
               .withColumn("_known", F.col("_seed") | ~F.col("_own")) \
               .select("_k", "_run", "_t", "_id", "_known")
    folded = (fold.repartition("_k", "_run").sortWithinPartitions("_k", "_run", "_t", "_id")
              .mapInPandas(_folder(limit, span), f"_k {kinds[key]}, _t bigint, "
                                                 f"_id {kinds[hit_id]}, admitted boolean"))
    return free.unionByName(folded).select(
        F.col("_k").alias(key), from_micros(F.col("_t"), kinds[ts]).alias(ts),
        F.col("_id").alias(hit_id), "admitted")


def pass_hits(times: np.ndarray, known: np.ndarray, recent: deque, limit: int, span: int) -> np.ndarray:
    """Which of one key's hits pass, in order of time; `recent` are admitted times before them and is brought
    up to date, `known` ones pass whatever the window holds.

    A refused hit changes nothing: from a full window the next hit that can pass is the first one a window after
    the oldest admitted one, found by a binary search.  Steps grow with the admitted hits alone."""
    out, at, n = known.copy(), 0, len(times)
    sure = np.append(np.flatnonzero(known), n)
    while at < n:
        while recent and recent[0] <= times[at] - span:
            recent.popleft()
        if known[at] or len(recent) < limit:
            out[at] = True
            recent.append(int(times[at]))
            at += 1
        else:
            free = int(np.searchsorted(times, recent[len(recent) - limit] + span)) if limit else n
            at = min(max(free, at + 1), int(sure[np.searchsorted(sure, at)]))
    return out


def _folder(limit: int, span: int):
    """Folds the runs of a task, which come together and in order of time."""
    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, recent = None, deque()
        for frame in frames:
            codes = pd.factorize(frame["_k"])[0]  # a null key is a key
            runs, times = frame["_run"].to_numpy(np.int64), frame["_t"].to_numpy(np.int64)
            known = frame["_known"].to_numpy(bool)
            edges = [0, *(np.flatnonzero((codes[1:] != codes[:-1]) | (runs[1:] != runs[:-1])) + 1), len(frame)]
            parts = []
            for begin, end in zip(edges, edges[1:], strict=False):
                if begin == end:
                    continue
                own = None if codes[begin] < 0 else frame["_k"].iloc[begin], runs[begin]
                if own != current:
                    current, recent = own, deque()
                parts.append(pass_hits(times[begin:end], known[begin:end], recent, limit, span))
            if parts:
                yield frame[["_k", "_t", "_id"]].assign(admitted=np.concatenate(parts))[~known]
    return fold
