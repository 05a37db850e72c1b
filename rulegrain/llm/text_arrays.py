"""Words, lines and their hashes as numpy arrays over the text buffers of Arrow batches.

Texts are cut at whole rows into chunks of about `CHUNK_BYTES`; a longer text is a chunk of its
own, so memory follows the longest text and not the batch.  Words are maximal runs of bytes other
than space and \\t..\\r.  Hashes are 64-bit: a random value per byte, a polynomial over positions
and a final mix, the same in every process."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(9, 14)]] = True
_BYTE_VALUES = np.random.Generator(np.random.PCG64(20240611)).integers(
    0, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C13)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C13, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Finishing step: every input bit reaches every output bit, and no two inputs meet."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, _BASE), np.full(size, _BASE_INVERSE)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, in tables that double in size."""
    return _powers(1 << max(21, (n - 1).bit_length()))


@dataclass
class Chunk:
    """Rows of a batch with their texts end to end in `data`; row i is data[offsets[i]:offsets[i+1]]."""

    batch: pa.RecordBatch
    data: np.ndarray
    offsets: np.ndarray


def chunks(batches: Iterable[pa.RecordBatch], text: str = "text",
           size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Null texts count as empty."""
    for batch in batches:
        column = pc.fill_null(batch.column(text).cast(pa.large_string()), "")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        start = 0
        while start < len(column):
            end = int(np.searchsorted(offsets, offsets[start] + size, "right")) - 1
            end = min(len(column), max(start + 1, end))
            low, high = int(offsets[start]), int(offsets[end])
            yield Chunk(batch.slice(start, end - start), data[low:high], offsets[start:end + 1] - low)
            start = end


@dataclass
class Spans:
    """Pieces of a chunk: data[starts[k]:ends[k]]; row r has pieces first[r]:first[r+1]."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(chunk: Chunk) -> Spans:
    inside = ~_SPACE[chunk.data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = chunk.offsets[:-1][np.diff(chunk.offsets) > 0]
    begins[edge] = inside[edge]
    last = edge[1:] - 1
    ends[last] = inside[last]
    starts = np.flatnonzero(begins)
    return Spans(starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, chunk.offsets))


def lines(chunk: Chunk) -> Spans:
    """The pieces between \\n; an empty text has one empty line."""
    breaks = np.flatnonzero(chunk.data == 10)
    # every row begins one line, and every break begins another
    starts = np.sort(np.concatenate([chunk.offsets[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([chunk.offsets[1:], breaks]), kind="stable")
    per_row = 1 + np.diff(np.searchsorted(breaks, chunk.offsets))
    return Spans(starts, ends, np.concatenate([[0], np.cumsum(per_row)]))


def span_hashes(data: np.ndarray, spans: Spans, fold: np.ndarray | None = None) -> np.ndarray:
    """One hash a piece; `fold` maps bytes first (LOWER)."""
    values = _BYTE_VALUES if fold is None else _BYTE_VALUES[fold]
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * up[:len(data)], out=total[1:])
    sums = (total[spans.ends] - total[spans.starts]) * down[spans.starts]
    return mix(sums + (spans.ends - spans.starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every `width` consecutive items, over the whole array: callers drop the windows
    that cross rows."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(width))
    for i in range(width):
        out *= np.uint64(0xA24BAED4963EE407)
        out += hashes[i:i + n]
        if i % 4 == 3 or i == width - 1:
            out = mix(out)
    return out


def window_starts(first: np.ndarray, width: int) -> np.ndarray:
    """For each item whether a window of that width begins there inside its row."""
    ok = np.zeros(int(first[-1]), bool)
    counts = np.diff(first)
    marks = np.zeros(int(first[-1]) + 1, np.int64)
    has = counts >= width
    np.add.at(marks, first[:-1][has], 1)
    np.add.at(marks, first[:-1][has] + counts[has] - width + 1, -1)
    ok[:] = np.cumsum(marks[:-1]) > 0
    return ok


def count_by_row(first: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Per row the sum of an item-wise array."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]


def count_in_ranges(offsets: np.ndarray, places: np.ndarray) -> np.ndarray:
    """How many of the sorted `places` lie in each row's stretch."""
    return np.diff(np.searchsorted(places, offsets))


def long_array(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64)
                    if values.dtype == np.uint64 else values.astype(np.int64), pa.int64())


def ids_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(name).cast(pa.int64())
