"""Byte-level BPE by rank files, with DuckDB recursive queries inside each partition.

Texts are cut by the pattern; pieces are encoded once a worker.  In DuckDB a piece is a row with a
list of its tokens, each with the rank of the pair it makes with the next one and its place; a
recursive query contracts the leftmost pair of minimum rank of every piece, looks the two pairs it
changed up in the merge table, and goes on with the pieces that changed until none does.  The bytes
of a text are decoded from its ids.

The merge table is read from the file on each worker and is of the vocabulary's size.  A worker
remembers about `KNOWN_PIECES` pieces and a task `KNOWN_SEGMENTS` segments, those it met last, so
memory is bounded whatever the texts hold.  The query holds each piece once, so its memory is linear
in them; its time is quadratic in a piece, and one of more than `LONG_BYTES` (a run of letters or
signs without a break) is merged outside DuckDB, by a heap of pairs, in n log n time and memory
linear in the piece.

Defined cases: a null or empty text has no tokens and decodes to nothing; special tokens do not
exist, their spelling is ordinary text; null ids and repeated rows are passed through."""

from __future__ import annotations

import base64
import gc
import hashlib
import heapq
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulegrain.llm import text_arrays as A

KNOWN_PIECES = 350_000  # pieces a worker remembers
KNOWN_SEGMENTS = 500_000  # segments a task remembers
BATCH_BYTES = 3 << 19  # text that is looked up together
STEP_BYTES = 500_000  # bytes a recursive query takes
LONG_BYTES = 1000  # longer pieces are merged one by one

# A token in the query: rank of its pair with the next one, place in the piece, token.
_TOKEN, _PLACE = 21, 20  # bits
_MASK = (1 << _TOKEN) - 1  # stands before a piece as a token of its own, which makes no pairs
_RANK = _TOKEN + _PLACE
_NONE = 1 << _TOKEN  # rank of what is no pair


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class Recent:
    """What was found for about `size` keys met last: those since a turn, and those of the turn before."""

    def __init__(self) -> None:
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def missing(self, keys: set[str], size: int) -> set[str]:
        """Those of the keys that are not remembered; the others are among the young now."""
        new = keys.difference(self.young)
        if len(self.young) + len(new) > size // 2:
            self.old, self.young, new = self.young, {}, keys
        back = {k: self.old[k] for k in new if k in self.old}
        self.young.update(back)
        return new.difference(back)


class Tables:
    """The merge table of one rank file in an in-memory DuckDB, and what its tokens stand for."""

    def __init__(self, path: str):
        import duckdb

        ranks = read_ranks(path)
        if max(ranks.values()) >= _MASK:
            raise ValueError(f"ranks of {_MASK} or more: {path}")
        left, right, rank = [], [], []
        self.byte_pairs = np.full(1 << 16, _NONE, np.int64)
        for token, r in ranks.items():
            if len(token) == 2:
                self.byte_pairs[token[0] << 8 | token[1]] = r
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), rank.append(r)
        self.ranks, self.bytes_of = ranks, {r: t for t, r in ranks.items()}
        self.name_of = {r: str(r) for r in self.bytes_of}
        self.byte_ids = [ranks[bytes([b])] for b in range(256)]
        self.known = Recent()
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        self.con.register("merges_in", pa.table({
            "pair": np.array(left, np.int64) << _TOKEN | np.array(right, np.int64),
            "rank": np.array(rank, np.int64) << _RANK}))
        self.con.execute("CREATE TABLE merges AS SELECT * FROM merges_in")
        self.con.unregister("merges_in")

    # low: the least code of a piece, which is the leftmost pair of minimum rank; its place in the list is at
    _MERGE = f"""
      WITH RECURSIVE state(piece, codes, low) AS (
        SELECT piece, codes, list_min(codes) FROM start
        UNION ALL
        SELECT piece, codes, list_min(codes) FROM (
          SELECT s.piece, list_concat(
            s.codes[:s.at - 2],
            [(s.codes[s.at - 1] & {(1 << _RANK) - 1}) + coalesce(l.rank, {_NONE << _RANK}),
             (s.low & {(1 << _RANK) - 1 - _MASK}) + (s.low >> {_RANK}) + coalesce(r.rank, {_NONE << _RANK})],
            s.codes[s.at + 2:]) AS codes
          FROM (SELECT *, list_position(codes, low)::INT AS at FROM state WHERE low < {_NONE << _RANK}) s
          LEFT JOIN merges l ON l.pair = ((s.codes[s.at - 1] & {_MASK}) << {_TOKEN}) + (s.low >> {_RANK})
          LEFT JOIN merges r ON r.pair = ((s.low >> {_RANK}) << {_TOKEN}) + (s.codes[s.at + 2] & {_MASK})))
      SELECT piece, codes FROM state WHERE low >= {_NONE << _RANK} ORDER BY piece"""

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Each piece's ids, as the bytes of 32-bit numbers."""
        lengths = np.array([len(p) for p in pieces])
        ends = np.cumsum(lengths)
        begin = ends - lengths
        data = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
        rank = self.byte_pairs[data << 8 | np.append(data[1:], 0)]
        rank[ends - 1] = _NONE
        place = np.arange(len(data)) - np.repeat(begin, lengths)
        code = rank << _RANK | place << _TOKEN | np.array(self.byte_ids, np.int64)[data]
        code = np.insert(code, begin, _NONE << _RANK | _MASK)
        offsets = np.append(0, ends + np.arange(1, len(pieces) + 1)).astype(np.int32)
        self.con.register("start", pa.table({"piece": np.arange(len(pieces), dtype=np.int32),
                                             "codes": pa.ListArray.from_arrays(offsets, code)}))
        found = self.con.sql(self._MERGE).to_arrow_table()["codes"].combine_chunks()
        self.con.unregister("start")
        ids = (found.flatten().to_numpy() & _MASK).astype(np.int32).tobytes()
        offsets = ((found.offsets.to_numpy() - found.offsets[0].as_py()) * 4).tolist()
        return [ids[a + 4:b] for a, b in pairwise(offsets)]

    def merge_long(self, piece: bytes) -> bytes:
        """The same for one piece of any length: the leftmost pair of minimum rank comes off a heap;
        entries whose pair has changed since are passed over."""
        n, ranks, bytes_of = len(piece), self.ranks, self.bytes_of
        token: list[int] = [self.byte_ids[b] for b in piece]
        prev, after = list(range(-1, n - 1)), list(range(1, n + 1))

        def rank(p: int) -> int | None:
            q = after[p]
            return ranks.get(bytes_of[token[p]] + bytes_of[token[q]]) if q < n else None

        pair = [rank(p) for p in range(n)]
        heap = [(r, p) for p, r in enumerate(pair) if r is not None]
        heapq.heapify(heap)
        while heap:
            r, p = heapq.heappop(heap)
            if pair[p] != r:
                continue
            q = after[p]
            token[p], after[p], pair[q] = r, after[q], None
            if after[q] < n:
                prev[after[q]] = p
            for at in (prev[p], p):
                if at >= 0:
                    pair[at] = new = rank(at)
                    if new is not None:
                        heapq.heappush(heap, (new, at))
        out, p = [], 0
        while p < n:
            out.append(token[p])
            p = after[p]
        return np.array(out, np.int32).tobytes()

    def coded(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of each of the pieces: known ones are looked up, the rest merged."""
        new, known = self.known.missing(pieces, KNOWN_PIECES), self.known.young
        out = {p: known[p] for p in pieces.difference(new)}
        for part in _steps(new):
            texts, encoded = zip(*part, strict=True)
            long = len(encoded[0]) > LONG_BYTES
            found = dict(zip(texts, [self.merge_long(encoded[0])] if long else self.merge(encoded), strict=True))
            out.update(found)
            if not long:  # long ones are not remembered
                known.update(found)
        return out


@lru_cache(maxsize=2)
def tables(path: str) -> Tables:
    return Tables(path)


def _steps(pieces: set[str]) -> Iterator[list[tuple[str, bytes]]]:
    """Pieces, with their bytes, that are merged together; one of more than LONG_BYTES is alone."""
    held, size = [], 0
    for piece, data in sorted(((p, p.encode()) for p in pieces), key=lambda x: len(x[1])):  # as many steps go together
        n = len(data)
        if held and (size + n > STEP_BYTES or n > LONG_BYTES):
            yield held
            held, size = [], 0
        held.append((piece, data))
        size += n
    if held:
        yield held


class _Texts:
    """Texts to ids and decoded bytes, through segments: a text may be cut before any space that
    a non-space follows, because no match of the pattern reaches over such a place."""

    def __init__(self, path: str, pattern: str):
        import re

        import regex

        self.cut, self.own = regex.compile(pattern), tables(path)
        self.odd = re.compile(r" (?!\S)")
        self.known = Recent()

    def segments(self, text: str) -> list[str]:
        if self.odd.search(text):
            return self.cut.findall(text)
        head, *rest = text.split(" ")
        return [head, *[" " + x for x in rest]] if head else [" " + x for x in rest]

    def learn(self, segments: set[str]) -> list[str]:
        """Makes all segments known; returns those that are too long to be remembered."""
        new, known = list(self.known.missing(segments, KNOWN_SEGMENTS)), self.known.young
        gc.disable()  # its many small lists would be walked again and again
        try:
            pieces = list(map(self.cut.findall, new))
            read = self.own.coded(set(chain.from_iterable(pieces)))
            for segment, parts in zip(new, pieces, strict=True):
                known[segment] = read[parts[0]] if len(parts) == 1 else b"".join([read[p] for p in parts])
        finally:
            gc.enable()
        return [s for s in new if len(s) > LONG_BYTES]

    def tokens(self, texts: list[str]) -> Iterator[np.ndarray]:
        cut = [self.segments(t) for t in texts]
        long = self.learn(set(chain.from_iterable(cut)))
        known = self.known.young.__getitem__
        for segments in cut:
            yield np.frombuffer(b"".join(map(known, segments)), np.int32)
        for segment in long:
            del self.known.young[segment]

    def spelled(self, tokens: np.ndarray) -> tuple[str, bytes]:
        """Ids joined by blanks, and what they decode to."""
        ids = tokens.tolist()
        return " ".join(map(self.own.name_of.__getitem__, ids)), b"".join(map(self.own.bytes_of.__getitem__, ids))

    def encode(self, texts: list[str]) -> Iterator[tuple[str, bytes]]:
        return map(self.spelled, self.tokens(texts))


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, np.concatenate(parts) if parts else np.zeros(0, np.int32))


def _encoder(path: str, pattern: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = _Texts(path, pattern)
        for chunk in A.chunks(batches, "bpe_text", BATCH_BYTES):
            counts, id_hashes, text_hashes, id_lists = [], [], [], []
            for tokens in work.tokens([t or "" for t in chunk.batch.column("bpe_text").to_pylist()]):
                ids, decoded = work.spelled(tokens)
                counts.append(len(tokens))
                id_hashes.append(hashlib.sha256(ids.encode()).hexdigest())
                text_hashes.append(hashlib.sha256(decoded).hexdigest())
                if with_ids:
                    id_lists.append(tokens)
            kept = [c for c in chunk.batch.schema.names if c != "bpe_text"]
            columns = [pa.array(counts, pa.int64()), pa.array(id_hashes, pa.string()),
                       pa.array(text_hashes, pa.string())]
            names = ["bpe_n", "bpe_ids", "bpe_decoded"]
            if with_ids:
                columns.append(_lists(id_lists))
                names.append("bpe_list")
            yield pa.RecordBatch.from_arrays([chunk.batch.column(c) for c in kept] + columns, names=kept + names)
    return run


def encode(rows: DataFrame, path: str, pattern: str, text: str = "text", keep: list[str] | None = None,
           with_ids: bool = True) -> DataFrame:
    """The `keep` columns (all but the text, if left out) with n_tokens, ids_sha256,
    decoded_sha256 and, if asked for, the ids themselves.

    `path` must exist on every machine, as the libraries of a worker do."""
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    keep = [c for c in rows.columns if c != text] if keep is None else keep
    plain = rows.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)],
                        F.col(f"`{text}`").alias("bpe_text"))
    out = [T.StructField("bpe_n", T.LongType()), T.StructField("bpe_ids", T.StringType()),
           T.StructField("bpe_decoded", T.StringType())]
    if with_ids:
        out.append(T.StructField("bpe_list", T.ArrayType(T.IntegerType())))
    done = plain.mapInArrow(_encoder(path, pattern, with_ids),
                            T.StructType([*plain.schema.fields[:-1], *out]))
    names = {"bpe_n": "n_tokens", "bpe_ids": "ids_sha256", "bpe_decoded": "decoded_sha256", "bpe_list": "ids"}
    return done.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)],
                       *[F.col(f.name).alias(names[f.name]) for f in out])
