"""Toxicity by a chain of linear classifiers.

Features are the presence of words and of word beginnings, as 64-bit hashes.  Those that go with
toxic labels are chosen by their log-likelihood ratio, counted with Spark over the sample.  The chain predicts
categories one after the other: how densely and how often a text uses such words (weak labels, from the
labels and the chosen features), and last whether it is toxic.  Each link is a logistic regression on
the features and on the probabilities of all earlier links; in training those are out-of-fold
predictions, so no link sees what an earlier one has memorised.  The threshold of the last link is the
one with the best F1 out of fold.

The fit sees a bounded sample: at most `SAMPLE_ROWS` labelled rows, about the first by a hash of their id.
Scoring reads every whole text in one pass; the model, of `FEATURES` weights a link, travels with the code.

Defined cases: null and empty texts hold no feature and get the probabilities of such a text; null ids
and repeated rows are passed through; labels other than 0 and 1 are not used; without labels of both
kinds nothing is toxic."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulegrain.llm import text_arrays as A
from rulegrain.llm.storage import Scratch

SAMPLE_ROWS = 8000
FEATURES = 256
FOLDS = 5
BEGINNINGS = (4, 5, 6, 7)  # bytes
CATEGORIES = ("dense", "repeated", "toxic")
DENSE_WORDS = 40  # a text is dense with a chosen word for every so many words
REPEATED = 3
_MARKS = np.isin(np.arange(256), list(b".,;:!?\"'()[]"))


def _features(chunk: A.Chunk) -> tuple[A.Spans, list[tuple[np.ndarray, np.ndarray]]]:
    """Words, and (word number, hash) of each kind of feature."""
    words = A.words(chunk)
    ends = words.ends.copy()
    for _ in range(3):  # marks at the end of a word don't belong to it
        cut = (ends > words.starts + 1) & _MARKS[chunk.data[ends - 1]]
        ends[cut] -= 1
    every = np.arange(len(ends))
    kinds = [(every, A.span_hashes(chunk.data, A.Spans(words.starts, ends, words.first), A.LOWER))]
    for size in BEGINNINGS:
        at = np.flatnonzero(ends - words.starts >= size)
        spans = A.Spans(words.starts[at], words.starts[at] + size, words.first)
        kinds.append((at, A.mix(A.span_hashes(chunk.data, spans, A.LOWER) + np.uint64(size))))
    return words, kinds


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk in A.chunks(batches):
        words, kinds = _features(chunk)
        rows = words.rows
        row = np.concatenate([rows[at] for at, _ in kinds])
        found = np.concatenate([h for _, h in kinds])
        order = np.lexsort((found, row))
        row, found = row[order], found[order]
        head = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (found[1:] != found[:-1])])) \
            if len(row) else np.zeros(0, np.int64)
        times = np.diff(np.append(head, len(row)))
        ends = np.searchsorted(row[head], np.arange(len(chunk.batch) + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [chunk.batch.column("doc_id"), chunk.batch.column("mark"), A.long_array(np.diff(words.first)),
             pa.ListArray.from_arrays(ends, A.long_array(found[head])),
             pa.ListArray.from_arrays(ends, A.long_array(times))],
            names=["doc_id", "mark", "n_words", "found", "times"])


@dataclass
class Chain:
    """`features` are sorted hashes; `links` hold the weights of features, text length, earlier
    probabilities, and the constant."""

    features: np.ndarray
    links: list[np.ndarray] = field(default_factory=list)
    threshold: float = 0.5

    def probabilities(self, present: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        x = _inputs(present, n_words)
        out: list[np.ndarray] = []
        for weights in self.links:
            out.append(_probability(np.column_stack([x, *out]), weights))
        return np.column_stack(out)


def _inputs(present: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(n_words)), np.log1p(n_words) / 5, present])


def _probability(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 12) -> np.ndarray:
    """Newton steps with a quadratic penalty on all but the constant."""
    weights = np.zeros(x.shape[1])
    cost = np.full(x.shape[1], penalty)
    cost[0] = 1e-3
    for _ in range(steps):
        p = _probability(x, weights)
        slope = x.T @ (p - y) + cost * weights
        curve = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag(cost)
        move = np.linalg.solve(curve, slope)
        weights = weights - move
        if np.abs(move).max() < 1e-5:
            break
    return weights


def fit_chain(features: np.ndarray, present: np.ndarray, n_words: np.ndarray, labels: np.ndarray,
              folds: np.ndarray) -> Chain:
    """Links in the order of the columns of `labels`; the last one decides."""
    chain, x = Chain(features), _inputs(present, n_words)
    for y in labels.T.astype(float):
        guessed = np.zeros(len(y))
        for k in range(FOLDS):
            test = folds == k
            guessed[test] = _probability(x[test], _logistic(x[~test], y[~test]))
        chain.links.append(_logistic(x, y))
        x = np.column_stack([x, guessed])
    order = np.argsort(-guessed, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    best = int(np.argmax(f1))
    following = guessed[order[best + 1]] if best + 1 < len(order) else 0.0
    chain.threshold = float((guessed[order[best]] + following) / 2)
    return chain


def draw(labels: DataFrame, label: str = "toxic", rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, mark, fold) of a bounded sample, by a hash of the id."""
    marked = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select(
        "doc_id", F.col(label).alias("mark"), F.xxhash64("doc_id").alias("draw"))
    share = min(1.0, 1.2 * rows / max(1, marked.count()))  # so that tasks send what the sample needs
    low = min((1 << 63) - 1, -(1 << 63) + int(share * (1 << 64)))
    return marked.filter(F.col("draw") <= low).orderBy("draw", "doc_id", "mark").limit(rows).select(
        "doc_id", "mark", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).alias("fold"))


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample_rows: int = SAMPLE_ROWS,
          n_features: int = FEATURES) -> Chain | None:
    """The chain from `docs` (doc_id, text) and `labels` (doc_id, label)."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    sample = scratch.write(draw(labels, label, sample_rows))
    # the sample is bounded, so it may be sent to every task
    marked = docs.join(F.broadcast(sample.select("doc_id", "mark").dropDuplicates(["doc_id"])), "doc_id")
    described = scratch.write(marked.select("doc_id", "text", "mark").mapInArrow(
        _describe, "doc_id bigint, mark int, n_words bigint, found array<bigint>, times array<bigint>"))
    total, toxic = described.agg(F.count("*"), F.coalesce(F.sum("mark"), F.lit(0))).first()
    if not toxic or toxic == total:
        return None
    seen = described.select("mark", F.explode("found").alias("feature")).groupBy("feature").agg(
        F.sum("mark").alias("a"), F.count("*").alias("n")).filter("a >= 3")
    part = lambda k, of, share: F.when(k > 0, k * F.log(k / (of * share))).otherwise(0.0)
    a, n, rate = F.col("a"), F.col("n"), toxic / total
    scored = seen.filter(a / n > rate).withColumn("score", part(a, n, rate) + part(n - a, n, 1 - rate))
    chosen = [r[0] for r in scored.orderBy(F.desc("score"), "feature").limit(n_features).select("feature").collect()]
    features = np.sort(np.array(chosen, np.int64).view(np.uint64))
    wanted = F.array(*[F.lit(x) for x in features.view(np.int64).tolist()]) if len(features) else F.array().cast("array<bigint>")
    narrow = described.join(F.broadcast(sample.select("doc_id", "fold").dropDuplicates(["doc_id"])), "doc_id").select(
        "mark", "fold", "n_words", F.filter(F.arrays_zip("found", "times"), lambda x: F.array_contains(wanted, x.found)).alias("hits"))
    rows = narrow.collect()  # the sample's hits among the chosen features
    present = np.zeros((len(rows), len(features)))
    uses = np.zeros(len(rows))
    for i, row in enumerate(rows):
        for hit in row.hits:
            present[i, np.searchsorted(features, np.int64(hit.found).view(np.uint64))] = 1.0
        uses[i] = max([hit.times for hit in row.hits], default=0)
        uses[i] = max(uses[i], len(row.hits) / 3)
    n_words = np.array([r.n_words for r in rows], float)
    mark = np.array([r.mark for r in rows])
    weak = np.column_stack([(mark == 1) & (uses * DENSE_WORDS >= n_words), (mark == 1) & (uses >= REPEATED), mark == 1])
    return fit_chain(features, present, n_words, weak, np.array([r.fold for r in rows]))


def _score(chain: Chain | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in A.chunks(batches):
            size = len(chunk.batch)
            if chain is None:
                p, toxic = np.zeros((size, len(CATEGORIES))), np.zeros(size, bool)
            else:
                words, kinds = _features(chunk)
                present = np.zeros((size, len(chain.features)))
                rows = words.rows
                for at, hashes in kinds:
                    if len(chain.features):
                        place = np.minimum(np.searchsorted(chain.features, hashes), len(chain.features) - 1)
                        hit = chain.features[place] == hashes
                        present[rows[at[hit]], place[hit]] = 1.0
                p = chain.probabilities(present, np.diff(words.first).astype(float))
                toxic = p[:, -1] >= chain.threshold
            yield pa.RecordBatch.from_arrays(
                [chunk.batch.column("doc_id"), *[pa.array(np.round(x, 6)) for x in p.T], pa.array(toxic)],
                names=["doc_id", *[f"p_{c}" for c in CATEGORIES], "toxic"])
    return run


def score(docs: DataFrame, chain: Chain | None) -> DataFrame:
    """(doc_id, a probability for each category, toxic) for each row of `docs` (doc_id, text)."""
    schema = "doc_id bigint, " + ", ".join(f"p_{c} double" for c in CATEGORIES) + ", toxic boolean"
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_score(chain), schema)
