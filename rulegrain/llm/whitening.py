"""Whitening embeddings with eigenpairs found by contour integration (FEAST).

Each component x becomes the whole number floor(scale * x).  The fit list is every distinct whole vector
once; vectors of one width have a fit of their own.  Sums and products are whole numbers of any
size, centred at the nearest whole mean before they are multiplied, so the covariance is exact until its last
division.  What a task adds up is one row of (width x width); rows are merged `FAN_IN` at a time, so
no task gathers a row from every other.

FEAST: inertia counts (signs of the pivots of a shifted covariance) bisect for an interval that holds the
wanted eigenvalues.  The spectral projector of the interval is a quadrature of resolvents (zI - V)^-1 on a
circle around it; projected random directions are orthonormalised, Rayleigh-Ritz extracts
eigenpairs from them, and both steps repeat until the residuals are at rounding level.  The inertia
count of the interval must equal the number of pairs found in it, else the subspace is enlarged, up
to the whole space.

Vectors travel in blocks of `BLOCK_ROWS`, so the small model of a width is joined to blocks, not to rows.

Defined cases: a vector that is null or holds a null, NaN or infinity takes no part; null ids and repeated rows
each get their rows; components of eigenvalue zero are left out (a single distinct vector has none), as are
more components than a vector is wide; equal eigenvalues share any orthonormal basis; a deviation beyond
64 bits is held at the end of the range; empty vectors and empty tables give no rows; other columns are not read."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulegrain.llm.storage import Scratch

SCALE = 256.0
COMPONENTS = 4
BLOCK_ROWS = 1024
FAN_IN = 16
NODES = 16  # of the whole circle; conjugate nodes are solved once
ROUNDS = 40
_LONG = np.iinfo(np.int64)
_BLOCK = "width int, ids array<bigint>, cells binary"
_MODEL = "width int, n bigint, model binary"


# --- the eigenvalue solver --------------------------------------------------------------------------------
def count_above(v: np.ndarray, shift: float) -> int:
    """Eigenvalues of the symmetric `v` above `shift`: positive pivots of v - shift * I."""
    a = v - shift * np.eye(len(v))
    tiny = np.finfo(float).eps * max(np.abs(v).max(initial=0), np.finfo(float).tiny)
    above = 0
    for i in range(len(a)):
        pivot = a[i, i] if abs(a[i, i]) > tiny else -tiny  # a zero pivot stands for a value at the shift
        above += pivot > 0
        row = a[i, i + 1:]
        a[i + 1:, i + 1:] -= np.outer(row, row / pivot)
    return above


def _interval(v: np.ndarray, wanted: int) -> tuple[float, float, int]:
    """(low, high, count): holds the largest `wanted` eigenvalues, or more if they are tied with others;
    low lies in the middle of the gap below them."""
    top = float(np.abs(v).sum(axis=1).max())  # no eigenvalue is larger
    below, low = -top * 1e-3, top
    for _ in range(60):  # below: too many above it; low: at most `wanted` above it
        middle = (below + low) / 2
        if count_above(v, middle) > wanted:
            below = middle
        else:
            low = middle
        if count_above(v, low) == wanted:
            break
    if count_above(v, low) != wanted:  # tied: all of them
        low = below - top * 1e-9
        return low, top * 1.01, count_above(v, low)
    inside = top
    for _ in range(24):  # how far the gap reaches to both sides
        middle = (low + inside) / 2
        if count_above(v, middle) == wanted:
            low = middle
        else:
            inside = middle
        lower = (below + low) / 2
        if count_above(v, lower) > wanted:
            below = lower
    return (below + low) / 2, top * 1.01, wanted


def feast(v: np.ndarray, wanted: int, seed: int = 20240611) -> tuple[np.ndarray, np.ndarray]:
    """The `wanted` largest eigenvalues, falling, and their unit eigenvectors as columns."""
    d, scale = len(v), float(np.abs(v).max(initial=0))
    if not d or not scale:
        return np.zeros(0), np.zeros((d, 0))
    v, wanted = v / scale, min(wanted, d)
    low, high, count = _interval(v, wanted)
    centre, radius = (low + high) / 2, (high - low) / 2
    angles = np.pi * (np.arange(NODES // 2) + 0.5) / (NODES // 2)
    shifted = [(np.exp(1j * t), (centre + radius * np.exp(1j * t)) * np.eye(d) - v) for t in angles]
    size = min(d, 2 * count + 4)
    draw = np.random.Generator(np.random.PCG64(seed))
    while True:
        y = draw.standard_normal((d, size))
        for _ in range(ROUNDS):
            projected = sum((radius * weight * np.linalg.solve(a, y)).real for weight, a in shifted) * 2 / NODES
            basis, _ = np.linalg.qr(projected)
            values, turn = np.linalg.eigh(basis.T @ v @ basis)
            y = basis @ turn
            found = values > low
            residual = np.linalg.norm(v @ y[:, found] - y[:, found] * values[found], axis=0).max(initial=0)
            if residual <= 64 * np.finfo(float).eps * high:
                break
        missed = count_above(v, low) - int(found.sum())
        if (not missed and residual <= 1e-12 * high) or size == d:
            break
        size = min(d, 2 * size)
    order = np.argsort(-values, kind="stable")[:wanted]
    vectors = y[:, order]
    return values[order] * scale, vectors / np.linalg.norm(vectors, axis=0)


# --- whole-number sums -----------------------------------------------------------------------------------
def _gram(x: np.ndarray) -> np.ndarray:
    """x'x as whole numbers of any size."""
    top = max(-int(x.min(initial=0)), int(x.max(initial=0)))
    if top * top * len(x) < 1 << 53:  # every partial sum is exact
        return (x.astype(np.float64).T @ x.astype(np.float64)).astype(np.int64).astype(object)
    wide = x.astype(object)
    return wide.T @ wide


def _sum(x: np.ndarray) -> np.ndarray:
    top = max(-int(x.min(initial=0)), int(x.max(initial=0)))
    return (x.sum(axis=0) if top * len(x) < 1 << 62 else x.astype(object).sum(axis=0)).astype(object)


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers: of 8 bytes each if they fit, else as text."""
    flat = values.ravel().tolist()
    if all(_LONG.min <= x <= _LONG.max for x in flat):
        return b"8" + np.array(flat, np.int64).tobytes()
    return b"t" + " ".join(map(str, flat)).encode()


def _unpacked(data: bytes) -> np.ndarray:
    if data[:1] == b"8":
        return np.frombuffer(data, np.int64, offset=1).astype(object)
    return np.array([int(x) for x in data[1:].split()], object)


# --- blocks ----------------------------------------------------------------------------------------------
def quantized(vectors: DataFrame, vector: str, vec_id: str | None = None, scale: float = SCALE) -> DataFrame:
    """(vec_id, cells): floor(scale * x) of each component, x as double; unusable rows left out."""
    column = F.col(f"`{vector}`")
    usable = column.isNotNull() & (F.size(column) > 0) & ~F.exists(
        column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    cells = F.transform(column, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("bigint"))
    own = F.lit(None) if vec_id is None else F.col(f"`{vec_id}`")
    return vectors.filter(usable).select(own.cast("bigint").alias("vec_id"), cells.alias("cells"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of one width; a task's rest blocks may be smaller."""
    held: dict[int, list[tuple[list, np.ndarray]]] = {}

    def block(width: int) -> pa.RecordBatch:
        ids, cells = zip(*held.pop(width), strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array([width], pa.int32()), pa.array([sum(ids, [])], pa.list_(pa.int64())),
             pa.array([np.concatenate(cells).tobytes()], pa.binary())], names=["width", "ids", "cells"])

    for batch in batches:
        lists, ids = batch.column("cells"), batch.column("vec_id")
        offsets, flat = np.asarray(lists.offsets), np.asarray(lists.values)
        widths = np.diff(offsets)
        for width in np.unique(widths).tolist():
            at = np.flatnonzero(widths == width)
            for i in range(0, len(at), BLOCK_ROWS):
                some = at[i:i + BLOCK_ROWS]
                cells = flat[(offsets[some][:, None] + np.arange(width)[None, :]).ravel()]
                held.setdefault(width, []).append((ids.take(pa.array(some)).to_pylist(), cells))
                if sum(len(x) for x, _ in held[width]) >= BLOCK_ROWS:
                    yield block(width)
    for width in list(held):
        yield block(width)


def _cells(row: dict) -> np.ndarray:
    return np.frombuffer(row["cells"], np.int64).reshape(-1, row["width"])


def _per_task(measure: Callable[[dict, np.ndarray], list], merge: Callable[[list, list], list]):
    """One row a task and width: its blocks' measures merged."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                new, width = measure(row, _cells(row)), row["width"]
                sums[width] = merge(sums[width], new) if width in sums else new
        for width, (n, data) in sums.items():
            yield _row(width, n, data)
    return run


def _row(width: int, n: int, data: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), pa.array([n], pa.int64()), pa.array(
        [data.tobytes() if data.dtype == np.float64 else _packed(data)], pa.binary())], names=["width", "n", "model"])


def _read(row: dict, real: bool) -> list:
    return [row["n"], np.frombuffer(row["model"], np.float64) if real else _unpacked(row["model"])]


def _total(blocks: DataFrame, measure: Callable, merge: Callable, real: bool, finish: Callable,
           scratch: Scratch) -> DataFrame:
    """One row a width, `finish`ed, through a tree of merges."""
    rows = scratch.write(blocks.mapInArrow(_per_task(measure, merge), _MODEL).withColumn(
        "part", F.monotonically_increasing_id()))
    left = rows.select(F.shiftright("part", 33)).distinct().count()

    def join(last: bool) -> Callable[[pa.Table], pa.Table]:
        def run(table: pa.Table) -> pa.Table:
            parts = [_read(row, real) for row in table.to_pylist()]
            total = parts[0]
            for part in parts[1:]:
                total = merge(total, part)
            width = table.column("width")[0].as_py()
            return pa.Table.from_batches([_row(width, *(finish(width, *total) if last else total))])
        return run

    while True:
        left, last = -(-left // FAN_IN), left <= FAN_IN
        rows = rows.withColumn("part", F.pmod(F.xxhash64("part"), F.lit(max(1, left))))
        rows = rows.groupBy("width", "part").applyInArrow(join(last), _MODEL)
        if last:
            return scratch.write(rows)
        rows = scratch.write(rows.withColumn("part", F.monotonically_increasing_id()))


# --- the model of a width: n, S, eigenvectors, eigenvalues, explained -------------------------------------
def _add(a: list, b: list) -> list:
    return [a[0] + b[0], a[1] + b[1]]


def _centre(n: int, sums: np.ndarray) -> np.ndarray:
    return np.array([(2 * int(s) + n) // (2 * n) for s in sums], object)


def _centred(row: dict, x: np.ndarray) -> list:
    """Sums and products of x less the nearest whole mean."""
    centre = _centre(row["n"], _unpacked(row["model"]))
    small = np.abs(x).max(initial=0) < 1 << 61 and _LONG.min not in x and max(map(abs, centre)) < 1 << 61
    y = x - centre.astype(np.int64) if small else x.astype(object) - centre
    upper = np.triu_indices(x.shape[1])
    return [len(x), np.concatenate([_sum(y), _gram(y)[upper]])]


def covariance(n: int, width: int, data: np.ndarray) -> np.ndarray:
    """From exact sums and products; one division, by n squared."""
    sums, upper = data[:width], np.triu_indices(width)
    values = [float((n * int(g) - int(sums[i]) * int(sums[j])) / (n * n)) for g, i, j in zip(
        data[width:], *upper, strict=True)]
    out = np.zeros((width, width))
    out[upper] = values
    return out + np.triu(out, 1).T


def _components(wanted: int):
    def finish(width: int, n: int, data: np.ndarray) -> tuple[int, np.ndarray]:
        v = covariance(n, width, data)
        values, vectors = feast(v, wanted)
        real = values > 1e-12 * np.trace(v)
        values, vectors = values[real], vectors[:, real]
        return n, np.concatenate([[len(values)], values, values / np.trace(v) if len(values) else [], vectors.T.ravel()])
    return finish


def _parts(data: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    flat = np.frombuffer(data, np.float64)
    k = int(flat[0])
    return flat[1:k + 1], flat[k + 1:2 * k + 1], flat[2 * k + 1:].reshape(k, width)


def _whitened(row: dict, x: np.ndarray) -> np.ndarray:
    """(x - S/n) on the components, over the roots of their eigenvalues; S/n in two doubles, whose sum
    is within one rounding of the true difference."""
    values, _, vectors = _parts(row["components"], row["width"])
    n, sums = row["n"], _unpacked(row["sums"])
    centre = _centre(n, sums)
    rest = np.array([float((int(s) - n * int(c)) / n) for s, c in zip(sums, centre, strict=True)])
    small = np.abs(x).max(initial=0) < 1 << 61 and _LONG.min not in x and max(map(abs, centre)) < 1 << 61
    y = (x - centre.astype(np.int64) if small else x.astype(object) - centre).astype(np.float64) - rest
    return (y @ vectors.T) / np.sqrt(values)


def _moments(row: dict, x: np.ndarray) -> list:
    """Mean and centred products of the whitened fit list."""
    w = _whitened(row, x)
    mean = w.mean(axis=0)
    return [len(w), np.concatenate([mean, ((w - mean).T @ (w - mean)).ravel()])]


def _split(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    k = (int(round((1 + 4 * len(data)) ** 0.5)) - 1) // 2  # k means and k * k products
    return data[:k], data[k:]


def _merge_moments(a: list, b: list) -> list:
    (na, da), (nb, db), n = a, b, a[0] + b[0]
    (ma, pa_), (mb, pb) = _split(da), _split(db)
    step = mb - ma
    return [n, np.concatenate([ma + step * nb / n, pa_ + pb + np.outer(step, step).ravel() * na * nb / n])]


def _error(width: int, n: int, data: np.ndarray) -> tuple[int, np.ndarray]:
    means, products = _split(data)
    k = len(means)
    return n, np.array([np.abs(products.reshape(k, k) / n - np.eye(k)).max(initial=0)])


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """Sum over dimensions of (n*x - S)^2, exact, held at the end of 64 bits."""
    top = n * max(-int(x.min(initial=0)), int(x.max(initial=0))) + max(map(abs, sums), default=0)
    if top * top * x.shape[1] < 1 << 63:
        return ((n * x - sums.astype(np.int64)) ** 2).sum(axis=1)
    wide = ((n * x.astype(object) - sums) ** 2).sum(axis=1)
    return np.array([min(int(d), _LONG.max) for d in wide], np.int64)


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            x = _cells(row)
            whitened, (values, explained, _) = _whitened(row, x), _parts(row["components"], row["width"])
            k, rows = len(values), len(x)
            if k:
                yield pa.RecordBatch.from_pydict({
                    "vec_id": pa.array(row["ids"], pa.int64()).take(pa.array(np.repeat(np.arange(rows), k))),
                    "component": pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()),
                    "n": np.full(rows * k, row["n"]),
                    "deviation": np.repeat(deviations(x, row["n"], _unpacked(row["sums"])), k),
                    "whitened": whitened.ravel(), "explained": np.tile(explained, rows),
                    "identity_error": np.full(rows * k, np.frombuffer(row["error"], np.float64)[0])})


def whiten(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS,
           scale: float = SCALE) -> DataFrame:
    """One row for each usable vector and component: vec_id, component, n, deviation, whitened, explained,
    identity_error.  Fits and results are those of the vectors of the same width."""
    scratch = Scratch(vectors.sparkSession, "whitening")
    rows = scratch.write(quantized(vectors, vector, vec_id, scale).mapInArrow(_blocks, _BLOCK))
    distinct = quantized(vectors, vector, None, scale).groupBy("cells").agg(F.first("vec_id").alias("vec_id"))
    fit = scratch.write(distinct.select("vec_id", "cells").mapInArrow(_blocks, _BLOCK))
    whole = lambda width, n, data: (n, data)
    sums = _total(fit, lambda row, x: [len(x), _sum(x)], _add, False, whole, scratch)
    pairs = _total(fit.join(sums, "width"), _centred, _add, False, _components(components), scratch)
    model = scratch.write(sums.select("width", "n", F.col("model").alias("sums")).join(
        pairs.select("width", F.col("model").alias("components")), "width"))
    errors = _total(fit.join(model, "width"), _moments, _merge_moments, True, _error, scratch)
    whole_model = model.join(errors.select("width", F.col("model").alias("error")), "width")
    return rows.join(whole_model, "width").mapInArrow(
        _apply, "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, "
                "identity_error double")
