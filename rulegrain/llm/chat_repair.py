"""Minimum-cost repair of chat roles, and the rendered chat.

A legal chat is an optional system turn, then user and assistant turns by turns, from the user on.  Each
turn is kept, relabelled, merged into the turn before it, or preceded by empty turns of missing
roles; a shortest path through the automaton of legal turns chooses, for the whole conversation.

A turn is a 4 x 4 matrix of costs from state to state, and a conversation the min-plus product of its
turns.  Turns are sorted by range and numbered; a segment is the turns of one conversation within
`SEGMENT` numbers, so none is longer, however long the conversation.  Segments of longer
conversations are joined by scans over their matrices: backwards for the cheapest way to end after a
segment, forwards for the state it begins in.  Scans go up and down a tree of fan `FAN`, so no task holds a
conversation.  At each turn the smallest of the equally cheap next states is taken, which makes the
repair independent of how turns are dealt into segments.

The chat is rendered in pieces, one a turn, whose concatenation in order is the chat.

Defined cases: rows without a conversation id form one conversation; turns without a number come last,
equal numbers are ordered by role and text; a null or unknown role fits any role at the price of a
relabelling; a null text is empty; marks of the format inside texts are broken by a blank; fully equal
rows are turns of their own; a chat may end with a user turn."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulegrain.llm.storage import Scratch

SEGMENT = 512
FAN = 256
MERGE, RELABEL, INSERT, TO_SYSTEM = 1, 2, 3, 2  # prices; the last on top, for a turn relabelled as system
ROLES = ["system", "user", "assistant"]
#: Other spellings of roles, as fixed values.
ALIASES = {"human": "user", "prompter": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant",
           "ai": "assistant", "developer": "system", "instruction": "system"}
# states: 0 nothing yet, then the role of the last turn
_NEXT = {(0, "system"): 1, (0, "user"): 2, (1, "user"): 2, (2, "assistant"): 3, (3, "user"): 2}
_STATE_ROLE = [None, *ROLES]
_FAR = 1 << 40
UNKNOWN, NOTHING = 3, 4  # codes after those of ROLES; NOTHING pads and changes nothing


def _insertions(start: int) -> dict[int, list[str]]:
    """Empty turns that lead from one state to each other one, as few as can be."""
    found: dict[int, list[str]] = {start: []}
    queue = [start]
    for state in queue:
        for (at, role), to in sorted(_NEXT.items()):
            if at == state and to not in found:
                found[to] = [*found[state], role]
                queue.append(to)
    return found


def _actions() -> dict[tuple[int, int, int], tuple[int, str, list[str]]]:
    """(code, from, to) -> (cost, action, empty turns before): the cheapest way, the first of equals."""
    out: dict[tuple[int, int, int], tuple[int, str, list[str]]] = {}
    for code, start, role in product(range(4), range(4), ROLES):
        own = code < 3 and ROLES[code] == role
        price, name = (0, "keep") if own else (RELABEL + TO_SYSTEM * (role == "system"), "relabel")
        ways = []
        if _STATE_ROLE[start] == role:
            ways.append((start, price + MERGE, "merge" if own else "relabel+merge", []))
        for via, empty in _insertions(start).items():
            if (via, role) in _NEXT:
                ways.append((_NEXT[via, role], price + INSERT * len(empty),
                             name if not empty else f"insert+{name}" if not own else "insert", empty))
        for to, cost, action, empty in ways:
            if (code, start, to) not in out or cost < out[code, start, to][0]:
                out[code, start, to] = cost, action, empty
    return out


ACTIONS = _actions()
COSTS = np.full((5, 4, 4), _FAR, np.int64)
for (_c, _s, _t), (_cost, _, _) in ACTIONS.items():
    COSTS[_c, _s, _t] = _cost
COSTS[NOTHING][np.arange(4), np.arange(4)] = 0


def _padded(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.asarray(lists.value_lengths()).astype(np.int64)
    flat = np.asarray(lists.flatten()).astype(np.int64)
    out = np.full((len(sizes), int(sizes.max(initial=0))), NOTHING)
    out[np.repeat(np.arange(len(sizes)), sizes),
        np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out, sizes


def _backwards(codes: np.ndarray, after: np.ndarray) -> list[np.ndarray]:
    """Cheapest ends before each turn, from those after the last (rows x states x columns)."""
    ends = [after]
    for i in range(codes.shape[1] - 1, -1, -1):
        step = COSTS[codes[:, i]][:, :, :, None] + ends[-1][:, None, :, :]
        ends.append(np.minimum(step.min(axis=2), _FAR))
    return ends[::-1]


def _walk(codes: np.ndarray, after: np.ndarray, state: np.ndarray) -> list[np.ndarray]:
    """States before each turn and after the last (rows x columns), from the given ones."""
    ends, states, rows = _backwards(codes, after[:, :, None]), [state], np.arange(len(codes))[:, None]
    for i in range(codes.shape[1]):
        price = COSTS[codes[:, i]][rows, states[-1]] + ends[i + 1][:, None, :, 0]
        states.append(np.argmin(price, axis=2))
    return states


def _matrix_step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        codes, _ = _padded(batch.column("codes"))
        unit = np.where(np.eye(4, dtype=bool), 0, _FAR)
        matrix = _backwards(codes, np.broadcast_to(unit, (len(codes), 4, 4)))[0]
        yield _with(batch, ["conv", "seg"], value=_fixed(matrix.reshape(len(codes), 16)))


def _map_step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        codes, _ = _padded(batch.column("codes"))
        after = _square(batch.column("carry"), 16).reshape(-1, 4, 4).min(axis=2)
        states = np.broadcast_to(np.arange(4), (len(codes), 4))
        yield _with(batch, ["conv", "seg"], value=_fixed(_walk(codes, after, states)[-1]))


def _path_step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        codes, sizes = _padded(batch.column("codes"))
        after = _square(batch.column("ends"), 16).reshape(-1, 4, 4).min(axis=2)
        begin = _square(batch.column("begins"), 4)[:, :1]
        states = np.stack([s[:, 0] for s in _walk(codes, after, begin)], axis=1)
        rows = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        yield pa.RecordBatch.from_arrays(
            [batch.column("seqs").flatten(), pa.array(codes[rows, place].astype(np.int32)),
             pa.array(states[rows, place].astype(np.int32)), pa.array(states[rows, place + 1].astype(np.int32)),
             batch.column("last").take(pa.array(rows))], names=["seq", "code", "state", "next", "last"])


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _fixed(values: np.ndarray) -> pa.Array:
    flat = np.ascontiguousarray(values).astype(np.int64).ravel()
    return pa.ListArray.from_arrays(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1], flat)


def _square(lists: pa.Array, width: int) -> np.ndarray:
    return np.asarray(lists.flatten()).reshape(-1, width)


def _with(batch: pa.RecordBatch, kept: list[str], **more: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *more.values()], names=[*kept, *more])


# --- scans over the segments of a conversation ---------------------------------------------------------
def _then_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x, y = a.reshape(4, 4), b.reshape(4, 4)
    return np.minimum((x[:, :, None] + y[None, :, :]).min(axis=1), _FAR).ravel()


def _then_map(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return b[a]


def _scan(values: DataFrame, join: Callable, unit: np.ndarray, backwards: bool, scratch: Scratch) -> DataFrame:
    """(conv, seg, carry): all values of a conversation after (or before) each segment, joined."""
    unit_column = F.array(*[F.lit(int(x)).cast("bigint") for x in unit])
    levels = [values]
    while levels[-1].groupBy("conv").count().filter("count > 1").limit(1).count():
        def up(table: pa.Table) -> pa.Table:
            table = table.sort_by("seg")
            total = None
            for value in table.column("value").to_pylist():
                total = np.array(value) if total is None else join(total, np.array(value))
            return pa.table({"conv": table.column("conv")[:1], "seg": table.column("up")[:1],
                             "value": pa.array([total.tolist()], pa.list_(pa.int64()))})

        parents = levels[-1].withColumn("up", F.floor(F.col("seg") / FAN)).groupBy("conv", "up").applyInArrow(
            up, "conv string, seg bigint, value array<bigint>")
        levels.append(scratch.write(parents))
    carry = levels.pop().select("conv", "seg", unit_column.alias("carry"))
    while levels:
        def down(table: pa.Table) -> pa.Table:
            table = table.sort_by([("seg", "descending" if backwards else "ascending")])
            now, carries = np.array(table.column("carry")[0].as_py()), []
            for value in table.column("value").to_pylist():
                carries.append(now.tolist())
                now = join(np.array(value), now) if backwards else join(now, np.array(value))
            return pa.table({"conv": table.column("conv"), "seg": table.column("seg"),
                             "carry": pa.array(carries, pa.list_(pa.int64()))})

        children = levels.pop().withColumn("up", F.floor(F.col("seg") / FAN))
        carry = scratch.write(children.join(carry.withColumnRenamed("seg", "up"), ["conv", "up"])
                              .groupBy("conv", "up").applyInArrow(down, "conv string, seg bigint, carry array<bigint>"))
    return carry


def _codes(role: str) -> F.Column:
    named = F.lower(F.trim(F.col(role)))
    for other, own in ALIASES.items():
        named = F.when(F.lower(F.trim(F.col(role))) == other, own).otherwise(named)
    out = F.lit(UNKNOWN)
    for i, r in enumerate(ROLES):
        out = F.when(named == r, i).otherwise(out)
    return F.when(F.col(role).isNull(), UNKNOWN).otherwise(out)


def repair(turns: DataFrame) -> DataFrame:
    """Each row of `turns` (conv_id, turn, role, text) with action, new_role, inserted (roles of empty
    turns put before it), cost, and `rendered`, its piece of the chat."""
    spark = turns.sparkSession
    scratch = Scratch(spark, "chat")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv", "late", "turn", "role", "text"]
    rows = scratch.write(
        turns.select("conv_id", "turn", "role", "text")
             .withColumn("conv", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")))
             .withColumn("late", F.col("turn").isNull())
             .repartitionByRange(tasks, *order).sortWithinPartitions(*order)
             .withColumn("seq", F.monotonically_increasing_id()).withColumn("code", _codes("role")))
    cut = rows.groupBy("conv", F.floor(F.col("seq") / SEGMENT).alias("seg")).agg(
        F.array_sort(F.collect_list(F.struct("seq", "code"))).alias("t"))  # SEGMENT turns at most
    spans = rows.groupBy("conv").agg(F.max("seq").alias("last_seq"), F.min("seq").alias("first_seq"))
    segments = scratch.write(cut.select("conv", "seg", F.col("t.seq").alias("seqs"), F.col("t.code").alias("codes")).join(
        spans, "conv").withColumn("several", F.floor(F.col("first_seq") / SEGMENT) != F.floor(
            F.col("last_seq") / SEGMENT)))
    long = segments.filter("several").select("conv", "seg", "codes")
    unit = np.where(np.eye(4, dtype=bool), 0, _FAR).ravel()
    matrices = scratch.write(long.mapInArrow(_matrix_step, "conv string, seg bigint, value array<bigint>"))
    ends = _scan(matrices, _then_matrix, unit, True, scratch)
    maps = scratch.write(long.join(ends, ["conv", "seg"]).mapInArrow(
        _map_step, "conv string, seg bigint, value array<bigint>"))
    begins = _scan(maps, _then_map, np.arange(4), False, scratch)
    whole = lambda values: F.array(*[F.lit(int(x)).cast("bigint") for x in values])
    path = (segments.join(ends.withColumnRenamed("carry", "ends"), ["conv", "seg"], "left")
                    .join(begins.withColumnRenamed("carry", "begins"), ["conv", "seg"], "left")
                    .select("seqs", "codes", F.coalesce("ends", whole(unit)).alias("ends"),
                            F.coalesce("begins", whole(range(4))).alias("begins"), F.col("last_seq").alias("last"))
                    .mapInArrow(_path_step, "seq bigint, code int, state int, next int, last bigint"))
    table = [(c, s, t, cost, action, "".join(f"{x} " for x in empty).strip())
             for (c, s, t), (cost, action, empty) in ACTIONS.items()]
    chosen = F.create_map(*[x for c, s, t, cost, action, empty in table for x in (
        F.lit(c * 16 + s * 4 + t), F.struct(F.lit(cost).alias("cost"), F.lit(action).alias("action"),
                                            F.lit(empty).alias("inserted")))])
    picked = rows.join(path.drop("code"), "seq").withColumn(
        "way", chosen[F.col("code") * 16 + F.col("state") * 4 + F.col("next")]).withColumn(
        "new_role", F.element_at(F.array(*[F.lit(r) for r in ROLES]), F.col("next")))
    body = F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |"))
    merged = F.col("way.action").endswith("merge")
    empties = F.when(F.col("way.inserted") == "", "").otherwise(F.array_join(F.transform(
        F.split("way.inserted", " "), lambda r: F.concat(F.lit("<|"), r, F.lit("|>\n<|end|>\n"))), ""))
    head = F.concat(F.when(F.col("state") > 0, "<|end|>\n").otherwise(""), empties, F.lit("<|"), F.col("new_role"),
                    F.lit("|>\n"))
    piece = F.concat(F.when(merged, F.lit("\n")).otherwise(head), body,
                     F.when(F.col("seq") == F.col("last"), "<|end|>\n").otherwise(""))
    return picked.select("conv_id", "turn", "role", "text", F.col("way.action").alias("action"), "new_role",
                         F.col("way.inserted").alias("inserted"), F.col("way.cost").alias("cost"),
                         piece.alias("rendered"), F.col("seq").alias("position"))
