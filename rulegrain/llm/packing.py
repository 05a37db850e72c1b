"""Packing token ids into sequences: first-fit decreasing over a tournament tree of bin capacities,
independently in randomised groups of documents.

Rows are dealt out by a hash of their place in the scan, so a group is a random sample, whatever an
id or a source holds.  A task takes its rows in the order of that hash and closes a group at
`GROUP_TOKENS` tokens or `GROUP_DOCS` documents, which bounds its memory; a retried task meets the same rows
in the same order.

Whole multiples of the capacity are sequences by themselves.  The rests are sorted by falling length;
each goes to the first bin that still holds it.  The tree keeps in every inner node the largest free
capacity below it, so that bin is found, and a new one opened, in one descent.  First-fit leaves small gaps:
the emptiest bins are then cut into the gaps of the fullest, until one bin of a group is left
with a rest, and that one is cut into sequences whose lengths are powers of two, which need no padding.  So no
sequence is padded, and few documents are cut.

Words are cut at blanks and line ends, over which the tokenizer's rules do not reach; a worker remembers
`KNOWN_WORDS` of them, then starts anew.

Defined cases: a null or empty text is the end id alone; null ids and repeated rows are documents of
their own; a text of any length is cut into as many sequences as it needs; an empty table
gives no rows; columns other than the id and the text are not read."""

from __future__ import annotations

import gc
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CAPACITY = 4096
END_ID = 2
GROUP_TOKENS = 1 << 22
GROUP_DOCS = 1 << 15
KNOWN_WORDS = 700_000
SLICE_ROWS = 256  # texts that are cut into words together
_MARKS = frozenset(".,;:!?")


class Words:
    """Token ids of words, by the tokenizer of one file."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallel part
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # the byte alphabet of byte-level models: printing bytes stand for themselves, others from 256 on
        printing = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printing]
        self.letters = {b: b for b in printing} | {b: 256 + i for i, b in enumerate(others)}
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {"": 0}  # an empty word has no ids
        self.flat = np.zeros(1 << 20, np.int32)
        self.begin, self.size = np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int32)
        self.used = 0

    def _own_ids(self, words: list[str]) -> list[list[int]]:
        """Lower-case letters in composed form are a single piece of the model; other words take the
        whole way."""
        plain = [w.isalpha() and w == w.lower() and is_normalized("NFC", w) for w in words]
        rest = iter(self.tokenizer.encode_batch_fast([w for w, p in zip(words, plain, strict=True) if not p],
                                                     add_special_tokens=False))
        pieces = [w if not p or w.isascii() else w.encode().decode("latin-1").translate(self.letters)
                  for w, p in zip(words, plain, strict=True)]
        return [[t.id for t in self.model.tokenize(w)] if p else next(rest).ids
                for w, p in zip(pieces, plain, strict=True)]

    def learn(self, new: set[str]) -> None:
        """A word of letters alone keeps its ids when one mark follows; its letters are lowered, but for
        sigma, whose small form depends on its place."""
        parts, asked = {}, set()
        for word in new:
            core, mark = (word[:-1], word[-1]) if word[-1] in _MARKS else (word, "")
            low = core.lower()
            if core.isalpha() and low.isalpha() and "\u03a3" not in core:
                core = low
            else:
                core, mark = word, ""
            parts[word] = core, mark
            asked.add(core)
        ids = dict(zip(asked, self._own_ids(list(asked)), strict=True))
        ids |= dict(zip(_MARKS, self._own_ids(list(_MARKS)), strict=True)) | {"": []}
        found = [ids[core] + ids[mark] if mark else ids[core] for core, mark in parts.values()]
        sizes = np.fromiter(map(len, found), np.int32, len(found))
        begin = self.used + np.cumsum(sizes, dtype=np.int64) - sizes
        k = len(self.number)
        self.number.update(zip(parts, range(k, k + len(parts)), strict=True))
        self.begin, self.size = _put(self.begin, k, begin), _put(self.size, k, sizes)
        self.flat = _put(self.flat, self.used, np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum())))
        self.used += int(sizes.sum())

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = [t.replace("\n", " ").split(" ") for t in texts]
        new = set().union(*cut).difference(self.number)
        if len(self.number) + len(new) > KNOWN_WORDS:
            self.forget()
            new = set().union(*cut).difference(self.number)
        if new:
            gc.disable()  # its many small lists would be walked again and again
            try:
                self.learn(new)
            finally:
                gc.enable()
        number = self.number.__getitem__
        counts = np.array([len(c) for c in cut])
        which = np.fromiter(map(number, chain.from_iterable(cut)), np.int64, int(counts.sum()))
        sizes = self.size[which]
        ends = np.cumsum(sizes, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        source = np.arange(total) + np.repeat(self.begin[which] - (ends - sizes), sizes)
        ids = self.flat[source]
        cuts = np.concatenate([[0], ends])[np.cumsum(counts)]
        return np.split(ids, cuts[:-1])


def _put(array: np.ndarray, at: int, values: np.ndarray) -> np.ndarray:
    """`values` from place `at` on, in an array that doubles when it is full."""
    while at + len(values) > len(array):
        array = np.concatenate([array, np.zeros_like(array)])
    array[at:at + len(values)] = values
    return array


@lru_cache(maxsize=2)
def words(path: str) -> Words:
    return Words(path)


class CapacityTree:
    """Free room of bins 0..n-1 as leaves; an inner node has the largest room below it."""

    def __init__(self, n_bins: int, capacity: int):
        self.leaves = 1 << max(0, n_bins - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def take(self, size: int) -> int:
        """The first bin with room for `size`, which it loses; there must be one."""
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            if room[at] < size:
                at += 1
        room[at] -= size
        found = at - self.leaves
        while at > 1:
            at //= 2
            top = max(room[2 * at], room[2 * at + 1])
            if room[at] == top:
                break
            room[at] = top
        return found


Piece = tuple[int, int, int]  # document, start, length


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Items of each bin, in the order they came in; items are at most of the capacity."""
    tree = CapacityTree(len(sizes), capacity)
    bins: list[list[int]] = []
    for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = tree.take(sizes[item])
        if found == len(bins):
            bins.append([])
        bins[found].append(item)
    return bins


def fill_gaps(bins: list[list[Piece]], capacity: int) -> list[list[Piece]]:
    """Cuts the emptiest bins into the gaps of the fullest; the last one into powers of two."""
    fill = [sum(p[2] for p in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda i: (-fill[i], i))
    bins, gaps = [bins[i] for i in order], [capacity - fill[i] for i in order]
    low, high = 0, len(bins) - 1
    while low < high:
        if not gaps[low]:
            low += 1
        elif not bins[high]:
            high -= 1
        else:
            doc, start, length = bins[high].pop()
            moved = min(length, gaps[low])
            bins[low].append((doc, start, moved))
            gaps[low] -= moved
            gaps[high] += moved
            if moved < length:
                bins[high].append((doc, start + moved, length - moved))
    out = [b for b in bins[:low] if b]
    return out + (_in_powers(bins[low]) if low < len(bins) else [])


def _in_powers(pieces: list[Piece]) -> list[list[Piece]]:
    left, out = sum(p[2] for p in pieces), []
    queue = pieces[::-1]
    while left:
        size = want = 1 << left.bit_length() - 1
        out.append([])
        while want:
            doc, start, length = queue.pop()
            moved = min(length, want)
            out[-1].append((doc, start, moved))
            if moved < length:
                queue.append((doc, start + moved, length - moved))
            want -= moved
        left -= size
    return out


def sequences(lengths: list[int], capacity: int) -> list[list[Piece]]:
    """All of a group's sequences, as pieces of its documents."""
    whole = [[(doc, start, capacity)] for doc, n in enumerate(lengths)
             for start in range(0, n - n % capacity, capacity)]
    rest = [(doc, n - n % capacity, n % capacity) for doc, n in enumerate(lengths) if n % capacity]
    bins = [[rest[i] for i in b] for b in first_fit_decreasing([r[2] for r in rest], capacity)]
    return whole + fill_gaps(bins, capacity)


def _packer(path: str, capacity: int, end_id: int, with_ids: bool, id_type: pa.DataType):
    def rows(ids: list[np.ndarray], doc_ids: list, first: int) -> tuple[pa.RecordBatch, int]:
        found = sequences([len(x) for x in ids], capacity)
        flat = [(doc, start, n, first + k) for k, s in enumerate(found) for doc, start, n in s]
        doc, start, n, sequence = (np.array(x, np.int64) for x in zip(*flat, strict=True))
        ends = np.cumsum(n)
        begins = np.concatenate([[0], ends[:-1]])
        heads = np.flatnonzero(np.diff(sequence, prepend=-1))
        offset = begins - np.repeat(begins[heads], np.diff(np.append(heads, len(n))))
        parts = [ids[d][s:s + k] for d, s, k, _ in flat]
        columns = {"doc": pa.array(doc_ids, id_type).take(pa.array(doc)), "start": start, "length": n,
                   "ids_crc32": pa.array([zlib.crc32(p.astype("<u4").tobytes()) for p in parts], pa.int64()),
                   "doc_tokens": np.array([len(x) for x in ids], np.int64)[doc], "sequence_id": sequence, "offset": offset}
        if with_ids:
            columns["ids"] = pa.ListArray.from_arrays(np.append(begins, ends[-1]).astype(np.int32), np.concatenate(parts))
        return pa.RecordBatch.from_pydict(columns), len(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, first = words(path), TaskContext.get().partitionId() << 32
        ids: list[np.ndarray] = []
        doc_ids: list = []
        held = 0
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                texts = [t or "" for t in part.column("text").to_pylist()]
                for doc_id, found in zip(part.column("doc").to_pylist(), own.encode(texts), strict=True):
                    ids.append(np.append(found, np.int32(end_id)))
                    doc_ids.append(doc_id)
                    held += len(found) + 1
                    if held >= GROUP_TOKENS or len(ids) >= GROUP_DOCS:
                        out, n = rows(ids, doc_ids, first)
                        yield out
                        first, ids, doc_ids, held = first + n, [], [], 0
        if ids:
            yield rows(ids, doc_ids, first)[0]
    return run


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, doc_id: str = "doc_id",
         text: str = "text", with_ids: bool = True) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked
    for, the piece's ids.  `path` is a tokenizer file that every machine has."""
    if not 0 < capacity < 1 << 31:
        raise ValueError("capacity must be positive")
    from pyspark.sql.pandas.types import to_arrow_type

    rows = docs.select(F.col(f"`{doc_id}`").alias("doc"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["doc"].dataType
    dealt = rows.withColumn("at", F.xxhash64(F.monotonically_increasing_id(), F.lit(20240611)))
    dealt = dealt.repartition("at").sortWithinPartitions("at").select("doc", "text")
    fields = [T.StructField("doc", kind), *[T.StructField(n, T.LongType()) for n in (
        "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    return dealt.mapInArrow(_packer(path, capacity, end_id, with_ids, to_arrow_type(kind)),
                            T.StructType(fields)).withColumnRenamed("doc", doc_id)
