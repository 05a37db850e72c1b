"""Exact top-k inner products: tiles of queries times shards, a partial selection in each tile,
and a tree that merges the lists of a query.

Vectors are packed into blocks.  Every query block meets every shard in one task, as a matrix
product; the pairs of a tile never leave it, only `k` rows a query do.  Lists are merged
`FAN_IN` tiles at a time, so a merge holds `FAN_IN * k` rows however many shards there are.

Defined cases: a vector that is null or holds a null, NaN or infinity takes no part; vectors of
unequal length are no candidates of each other; an empty vector scores 0 against empty ones;
a null id takes no part; rows of the same id are never each other's candidates and each of them
is one candidate; of equal scores the smaller id comes first; scores beyond 64 bits are held at
the end of the range."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulegrain.llm.storage import Scratch

BLOCK_ROWS = 2048
FAN_IN = 16
_TOP = "array<struct<score:bigint,vec_id:bigint>>"
_BLOCK = "width int, n int, ids binary, cells binary"
_LONG = np.iinfo(np.int64)


def quantized(vectors: DataFrame, id_col: str, vector: str, scale: float = 64.0) -> DataFrame:
    """(vec_id, cells): floor(scale * x) of each component, x as double; unusable rows left out."""
    usable = (F.col(id_col).isNotNull() & F.col(vector).isNotNull()
              & ~F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    cells = F.transform(F.col(vector), lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("bigint"))
    return vectors.filter(usable).select(F.col(id_col).cast("bigint").alias("vec_id"), cells.alias("cells"))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of one width; a task's rest blocks may be smaller."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def block(width, parts):
        ids, cells = (np.concatenate(x) for x in zip(*parts, strict=True))
        return pa.RecordBatch.from_arrays(
            [pa.array([width], pa.int32()), pa.array([len(ids)], pa.int32()),
             pa.array([ids.tobytes()], pa.binary()), pa.array([cells.tobytes()], pa.binary())],
            names=["width", "n", "ids", "cells"])

    for batch in batches:
        ids = np.asarray(batch.column("vec_id"))
        lists = batch.column("cells")
        offsets = np.asarray(lists.offsets)
        flat = np.asarray(lists.values)
        widths = np.diff(offsets)
        for width in np.unique(widths):
            at = np.flatnonzero(widths == width)
            cells = flat[(offsets[at][:, None] + np.arange(width)[None, :]).ravel()]
            for i in range(0, len(at), BLOCK_ROWS):
                part = slice(i, i + BLOCK_ROWS)
                held.setdefault(int(width), []).append(
                    (ids[at[part]], cells[i * width:(i + BLOCK_ROWS) * width]))
                if sum(len(x) for x, _ in held[width]) >= BLOCK_ROWS:
                    yield block(int(width), held.pop(width))
    for width, parts in held.items():
        yield block(width, parts)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact: in doubles while every partial sum is below 2^53, else in 64 bits, else in whole
    numbers of any size."""
    width = a.shape[1]
    bound = (int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, width)
             if _LONG.min not in (a.min(initial=0), b.min(initial=0)) else 1 << 64)
    if bound < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound < 1 << 63:
        return a @ b.T
    wide = a.astype(object) @ b.astype(object).T
    return np.clip(wide, _LONG.min, _LONG.max).astype(np.int64)


def _select(score: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Places of the k best, equal scores by id."""
    at = np.flatnonzero(ids != own)
    if len(at) > k:
        cut = np.partition(score[at], len(at) - k)[len(at) - k]
        at = at[score[at] >= cut]  # with all that tie with the last one
    return at[np.lexsort((ids[at], ~score[at]))[:k]]  # ~ turns the order round, without overflow


def _tiles(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q_ids, ids = (np.frombuffer(row[x], np.int64) for x in ("q_ids", "ids"))
                q = np.frombuffer(row["q_cells"], np.int64).reshape(len(q_ids), row["width"])
                shard = np.frombuffer(row["cells"], np.int64).reshape(len(ids), row["width"])
                scores = _products(q, shard)
                tops = [_select(scores[i], ids, int(q_ids[i]), k) for i in range(len(q_ids))]
                sizes = np.array([len(x) for x in tops])
                which, at = np.repeat(np.arange(len(tops)), sizes), np.concatenate(tops)
                hits = pa.StructArray.from_arrays([pa.array(scores[which, at]), pa.array(ids[at])],
                                                  names=["score", "vec_id"])
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), hits)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q_ids), pa.array(np.full(len(q_ids), row["shard"])), lists],
                    names=["query_id", "tile", "top"])
    return run


def _blocks(vectors: DataFrame, name: str) -> DataFrame:
    """Full blocks, numbered; rows are dealt out first so that no task is left with a few."""
    tasks = max(1, -(-vectors.count() // (4 * BLOCK_ROWS)))
    return (vectors.repartition(tasks).mapInArrow(_pack, _BLOCK)
                   .withColumn(name, F.monotonically_increasing_id()))


def _best(lists: Column, k: int) -> Column:
    ordered = F.array_sort(F.flatten(lists), lambda a, b: F.when(a.score > b.score, -1)
                           .when(a.score < b.score, 1).when(a.vec_id < b.vec_id, -1)
                           .when(a.vec_id > b.vec_id, 1).otherwise(0))
    return F.slice(ordered, 1, k)


def search(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of both tables' (vec_id, cells) rows.

    Of query rows with one id the smallest vector is asked."""
    scratch = Scratch(vectors.sparkSession, "topk")
    shards = scratch.write(_blocks(vectors, "shard"))
    one_each = queries.groupBy("vec_id").agg(F.min("cells").alias("cells"))
    asked = scratch.write(_blocks(one_each, "asked"))
    # every query block is sent to each group of shards: tiles are spread over the groups
    n_shards = shards.count()
    groups = max(1, round(n_shards ** 0.5))
    left = asked.select("width", F.col("ids").alias("q_ids"), F.col("cells").alias("q_cells"),
                        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"))
    right = shards.select("width", "shard", "ids", "cells",
                          F.pmod(F.xxhash64("shard"), F.lit(groups)).cast("int").alias("part"))
    tiles = left.join(right, ["width", "part"]).select("width", "shard", "q_ids", "q_cells", "ids", "cells")
    level = tiles.mapInArrow(_tiles(k), f"query_id bigint, tile bigint, top {_TOP}")
    n_left, place = n_shards, F.xxhash64("tile")
    while True:
        n_left = -(-n_left // FAN_IN)
        level = (level.groupBy("query_id", F.pmod(place, F.lit(max(1, n_left))).alias("tile"))
                      .agg(_best(F.collect_list("top"), k).alias("top")))
        place = F.col("tile")
        if n_left <= 1:
            break
    return level.select("query_id", F.posexplode("top").alias("place", "hit")).select(
        "query_id", (F.col("place") + 1).cast("int").alias("rank"),
        F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))
