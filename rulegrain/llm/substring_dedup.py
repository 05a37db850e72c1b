"""Removal of word windows that also start in a document with a smaller id, by super-k-mers.

A window is `WINDOW` consecutive words.  Its minimiser is the smallest hash among its runs of
`SEED` words.  Consecutive windows with one minimiser form a super-k-mer: their words travel once, as
one packed string, to the bucket of the minimiser, where every window with the same words arrives.
A bucket sorts its windows by hash and document, compares equal hashes byte by byte, and marks the
windows of all but the smallest document.

Before anything is sent, a task settles super-k-mers it has met already: one that equals an
earlier one of a smaller document is marked on the spot, so a passage that a third of all
documents share is sent once a task and not once a document.

Defined cases: null and empty texts and texts shorter than a window keep all their words; a null id
neither removes nor loses words; rows with one id are one document, so they remove nothing from each
other; equal windows inside one document stay."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulegrain.llm import text_arrays as A

WINDOW = 13
SEED = 4
BUCKET_BYTES = 5 << 20  # text a bucket, on average
FLUSH_BYTES = 8 << 20  # text a task packs at a time
_SENT = "bucket int, local boolean, n int, packed binary"
_MARKS = "doc_id bigint, text_key int, low int, high int"


def _minimisers(seeds: np.ndarray, span: int) -> np.ndarray:
    """Minimum of every `span` neighbours, by doubling."""
    low, width = seeds, 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = span - width
    return np.minimum(low[:len(low) - rest], low[rest:]) if rest else low


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of all items of the given stretches, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def _merged(doc: np.ndarray, key: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[np.ndarray]:
    """Neighbouring word ranges that overlap or touch as one; others may still overlap."""
    order = np.lexsort((low, key, doc))
    doc, key, low, high = doc[order], key[order], low[order], high[order]
    if not len(doc):
        return [doc, key, low, high]
    same = (doc[1:] == doc[:-1]) & (key[1:] == key[:-1])
    begin = np.concatenate([[True], ~(same & (low[1:] <= high[:-1]))])
    at = np.flatnonzero(begin)
    return [doc[at], key[at], low[at], np.maximum.reduceat(high, at)]


class _Packer:
    """What one task has met and not sent yet."""

    def __init__(self, n_buckets: int, window: int):
        self.n_buckets, self.window = n_buckets, window
        self.texts: list[np.ndarray] = []
        self.size = 0
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.marks: list[tuple[np.ndarray, ...]] = []
        # super-k-mers sent before: hash, minimiser, document
        self.hash = self.low = np.zeros(0, np.uint64)
        self.doc = np.zeros(0, np.int64)

    def add(self, chunk: A.Chunk) -> None:
        words = A.words(chunk)
        lengths = words.ends - words.starts
        hashes = A.span_hashes(chunk.data, words)
        begins = A.window_starts(words.first, self.window)[:max(0, len(hashes) - self.window + 1)]
        if not begins.any():
            return
        low = _minimisers(A.window_hashes(hashes, SEED), self.window - SEED + 1)
        at = np.flatnonzero(begins)
        low = low[at]
        # a new super-k-mer where the minimiser or the row changes
        first = np.concatenate([[True], (low[1:] != low[:-1]) | (at[1:] != at[:-1] + 1)])
        head = np.flatnonzero(first)
        n_windows = np.diff(np.append(head, len(at)))
        start, low = at[head], low[head]
        n_words = n_windows + self.window - 1
        rows = words.rows[start]
        doc = np.asarray(chunk.batch.column("doc_id").cast(pa.int64()))[rows]
        key = np.asarray(chunk.batch.column("text_key"))[rows]
        place = start - words.first[rows]
        # words joined by single blanks
        joined = np.full(int(lengths.sum()) + len(lengths), 32, np.uint8)
        begin = np.cumsum(lengths + 1) - (lengths + 1)
        joined[_spread(begin, lengths)] = chunk.data[_spread(words.starts, lengths)]
        text_start = begin[start]
        text_size = begin[start + n_words - 1] + lengths[start + n_words - 1] + 1 - text_start
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * A.powers(len(hashes))[0][:len(hashes)], out=sums[1:])
        whole = A.mix((sums[start + n_words] - sums[start]) * A.powers(len(hashes) + 1)[1][start]
                      + n_words.astype(np.uint64))
        settled = self._settle(whole, low, doc)
        self.marks.append((doc[settled], key[settled], place[settled], (place + n_words)[settled]))
        new = ~settled
        self.parts.append((low[new] % np.uint64(self.n_buckets), doc[new], key[new], place[new], n_words[new],
                           text_start[new] + self.size, text_size[new]))
        self.texts.append(joined)
        self.size += len(joined)

    def _settle(self, whole: np.ndarray, low: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Super-k-mers that equal one of a smaller document met here."""
        met = np.full(len(doc), np.iinfo(np.int64).max)
        at = np.searchsorted(self.hash, whole)
        inside = np.flatnonzero(at < len(self.hash))
        hit = inside[(self.hash[at[inside]] == whole[inside]) & (self.low[at[inside]] == low[inside])]
        met[hit] = self.doc[at[hit]]
        order = np.lexsort((doc, low, whole))
        w, m, d = whole[order], low[order], doc[order]
        head = np.concatenate([[True], (w[1:] != w[:-1]) | (m[1:] != m[:-1])])
        least = d[np.flatnonzero(head)][np.cumsum(head) - 1]
        met[order] = np.minimum(met[order], least)
        fresh = order[head][met[order[head]] == doc[order[head]]]  # the smallest so far
        stay = np.ones(len(self.hash), bool)
        again = np.intersect1d(fresh, hit, assume_unique=True)
        stay[at[again]] = False
        joined = np.concatenate([self.hash[stay], whole[fresh]])
        turn = np.argsort(joined, kind="stable")
        self.hash = joined[turn]
        self.low = np.concatenate([self.low[stay], low[fresh]])[turn]
        self.doc = np.concatenate([self.doc[stay], doc[fresh]])[turn]
        return met < doc

    def flush(self) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=5)
        if self.parts:
            bucket, doc, key, place, n_words, start, size = (np.concatenate(x) for x in zip(*self.parts, strict=True))
            text = np.concatenate(self.texts)
            order = np.argsort(bucket, kind="stable")
            edges = np.flatnonzero(np.diff(bucket[order])) + 1
            for at in np.split(order, edges):
                if len(at):
                    packed = b"".join([doc[at].tobytes(), key[at].astype(np.int32).tobytes(),
                                       place[at].astype(np.int32).tobytes(), n_words[at].astype(np.int32).tobytes(),
                                       text[_spread(start[at], size[at])].tobytes()])
                    yield self._row(int(bucket[at[0]]), False, len(at), press.compress(packed))
        if any(len(x[0]) for x in self.marks):
            doc, key, low, high = _merged(*(np.concatenate(x) for x in zip(*self.marks, strict=True)))
            packed = b"".join([doc.tobytes(), *[x.astype(np.int32).tobytes() for x in (key, low, high)]])
            yield self._row(int(doc[0] % self.n_buckets), True, len(doc), press.compress(packed))
        self.texts, self.parts, self.marks, self.size = [], [], [], 0

    @staticmethod
    def _row(bucket: int, local: bool, n: int, packed: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([bucket], pa.int32()), pa.array([local]), pa.array([n], pa.int32()),
             pa.array([packed], pa.binary())], names=["bucket", "local", "n", "packed"])


def _pack(n_buckets: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(n_buckets, window)
        for chunk in A.chunks(batches):
            packer.add(chunk)
            if packer.size >= FLUSH_BYTES:
                yield from packer.flush()
        yield from packer.flush()
    return run


def _equal(data: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether data[a:a+n] and data[b:b+n] hold the same bytes, for each pair."""
    out = np.ones(len(a), bool)
    for i in range(0, len(a), 50_000):
        n = lengths[i:i + 50_000]
        differs = data[_spread(a[i:i + 50_000], n)] != data[_spread(b[i:i + 50_000], n)]
        total = np.concatenate([[0], np.cumsum(differs)])
        ends = np.cumsum(n)
        out[i:i + 50_000] = total[ends] == total[ends - n]
    return out


def _later_windows(data, text_starts, text_ends, hashes, doc) -> np.ndarray:
    """Windows whose words also start in a smaller document of the bucket."""
    order = np.lexsort((doc, hashes))
    h, d = hashes[order], doc[order]
    head = np.concatenate([[True], h[1:] != h[:-1]])
    leader = np.flatnonzero(head)[np.cumsum(head) - 1]
    late = np.flatnonzero(d > d[leader])
    mine, lead = order[late], order[leader[late]]
    size, lead_size = text_ends[mine] - text_starts[mine], text_ends[lead] - text_starts[lead]
    same = size == lead_size
    same[same] = _equal(data, text_starts[mine[same]], text_starts[lead[same]], size[same])
    flags = np.zeros(len(doc), bool)
    flags[mine[same]] = True
    if not same.all():  # words that differ under one hash: those groups are settled by their text
        for value in np.unique(h[late[~same]]):
            at = order[np.searchsorted(h, value):np.searchsorted(h, value, "right")]
            least: dict[bytes, int] = {}
            texts = [data[text_starts[i]:text_ends[i]].tobytes() for i in at]
            for t, i in zip(texts, at, strict=True):
                least[t] = min(least.get(t, int(doc[i])), int(doc[i]))
            flags[at] = [doc[i] > least[t] for t, i in zip(texts, at, strict=True)]
    return flags


def _bucket(window: int):
    def run(table: pa.Table) -> pa.Table:
        unpress = zstandard.ZstdDecompressor()
        docs, keys, places, counts, texts, marks = [], [], [], [], [], []
        for local, n, packed in zip(*(table.column(c).to_pylist() for c in ("local", "n", "packed")), strict=True):
            raw = np.frombuffer(unpress.decompress(packed), np.uint8)
            head = raw[:8 * n].view(np.int64)
            rest = [raw[8 * n + 4 * n * k:8 * n + 4 * n * (k + 1)].view(np.int32) for k in range(3)]
            if local:
                marks.append((head, *rest))
            else:
                docs.append(head), keys.append(rest[0]), places.append(rest[1]), counts.append(rest[2])
                texts.append(raw[20 * n:])
        if docs:
            data = np.concatenate(texts)
            texts.clear()
            doc, key, place, count = (np.concatenate(x) for x in (docs, keys, places, counts))
            ends = np.flatnonzero(data == 32)
            starts = np.concatenate([[0], ends[:-1] + 1])
            first = np.concatenate([[0], np.cumsum(count, dtype=np.int64)])
            hashes = np.zeros(len(starts), np.uint64)
            for i in range(0, len(starts), 200_000):  # hashes need eight bytes a byte, so by stretches
                part = slice(i, min(i + 200_000, len(starts)))
                base = starts[part.start]
                spans = A.Spans(starts[part] - base, ends[part] - base, np.zeros(1, np.int64))
                hashes[part] = A.span_hashes(data[base:ends[part.stop - 1]], spans)
            at = np.flatnonzero(A.window_starts(first, window))
            wins = A.window_hashes(hashes, window)[at]
            owner = np.repeat(np.arange(len(doc)), count - window + 1)
            flags = _later_windows(data, starts[at], ends[at + window - 1], wins, doc[owner])
            owner, offset = owner[flags], (at - first[owner])[flags]
            low = place[owner] + offset
            marks.append((doc[owner], key[owner], low, low + window))
        doc, key, low, high = _merged(*(np.concatenate(x) for x in zip(*marks, strict=True)))
        return pa.table({"doc_id": doc, "text_key": key.astype(np.int32), "low": low.astype(np.int32),
                         "high": high.astype(np.int32)})
    return run


def repeated_ranges(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text_key, low, high): word ranges of `docs` (doc_id, text, text_key) to be removed."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    sent = (docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text_key", "text")
                .mapInArrow(_pack(n_buckets, window), _SENT))
    return sent.groupBy("bucket").applyInArrow(_bucket(window), _MARKS)


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk in A.chunks(batches, "kept_text"):
        words = A.words(chunk)
        n = len(words.starts)
        ranges = chunk.batch.column("ranges")
        owner = np.repeat(np.arange(len(ranges)), np.asarray(ranges.value_lengths().fill_null(0)))
        flat = ranges.flatten()
        change = np.zeros(n + 1, np.int64)
        base = words.first[owner]
        np.add.at(change, base + np.asarray(flat.field("low")), 1)
        np.add.at(change, base + np.asarray(flat.field("high")), -1)
        gone = np.cumsum(change[:-1]) > 0
        kept = ~gone
        lengths = (words.ends - words.starts)[kept]
        text = np.full(int(lengths.sum()) + len(lengths), 32, np.uint8)
        text[_spread(np.cumsum(lengths + 1) - (lengths + 1), lengths)] = \
            chunk.data[_spread(words.starts[kept], lengths)]
        per_row = A.count_by_row(words.first, kept)
        ends = np.concatenate([[0], np.cumsum(lengths + 1)])[np.concatenate([[0], np.cumsum(per_row)])]
        raw = text.tobytes()
        texts = [raw[a:max(a, b - 1)].decode() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        others = [c for c in chunk.batch.schema.names if c not in ("kept_text", "ranges")]
        yield pa.RecordBatch.from_arrays(
            [chunk.batch.column(c) for c in others]
            + [A.long_array(np.diff(words.first)), A.long_array(A.count_by_row(words.first, gone)),
               pa.array(texts, pa.string())], names=[*others, "n_words", "n_removed", "kept_text"])


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) for each row of `docs` (doc_id, text): the kept words,
    joined by one blank."""
    keyed = docs.select("doc_id", "text", F.pmod(F.xxhash64("text"), F.lit(2147483647)).cast("int").alias("text_key"))
    ranges = repeated_ranges(keyed, window).groupBy("doc_id", "text_key").agg(
        F.collect_list(F.struct("low", "high")).alias("ranges"))  # as many as the text has windows, at most
    joined = keyed.join(ranges, ["doc_id", "text_key"], "left").select(
        "doc_id", "ranges", F.col("text").alias("kept_text"))
    schema = T.StructType([joined.schema["doc_id"], T.StructField("n_words", T.LongType()),
                           T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])
    return joined.mapInArrow(_keep, schema)
