"""Quality rules: text statistics, and decision lists learned from labelled ones.

`statistics` counts over whole texts in one pass of array operations.  `fit` is sequential covering:
conjunctions of thresholds are grown on two thirds of the labelled rows to single out low quality,
pruned on the last third, and kept in the order they were found while they stay precise there; rows
that a rule covers leave before the next one is grown.  `verdict` is the list as one ordered Spark
conditional: the first rule that holds rejects, what no rule rejects is kept.

Only the fit sees a bounded sample: at most `SAMPLE_ROWS` labelled rows, the first by a hash of
their id.  Everything else covers every row.

Defined cases: a null or empty text has no words, so it fails the base; a null id is passed
through; repeated rows each get a row; without labels of both kinds no rule is learned and the
base alone decides; labels other than 0 and 1 are not used."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulegrain.llm import text_arrays as A

SAMPLE_ROWS = 20_000
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper",
          "n_digits", "n_marks"]


def _duplicated(first: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Items whose key occurs again in their row, and those that repeat an earlier item."""
    rows = np.repeat(np.arange(len(first) - 1, dtype=np.uint64), np.diff(first))
    tied = A.mix(keys + rows * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(tied, kind="stable")
    same = tied[order][1:] == tied[order][:-1]
    again, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:][same]] = True
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    return again, later


def _counts(chunk: A.Chunk) -> list[np.ndarray]:
    data, offsets = chunk.data, chunk.offsets
    words, lines = A.words(chunk), A.lines(chunk)
    heads = (data & 0xC0) != 0x80  # one a code point
    in_rows = lambda flags: A.count_in_ranges(offsets, np.flatnonzero(flags))
    spaces = np.isin(data, np.array([32, 9, 10, 11, 12, 13], np.uint8))
    # lines with a word
    starts = np.searchsorted(words.starts, lines.starts)
    filled = np.searchsorted(words.starts, lines.ends) > starts
    kept_first = np.concatenate([[0], np.cumsum(A.count_by_row(lines.first, filled))])
    kept = A.Spans(lines.starts[filled], lines.ends[filled], kept_first)
    _, later = _duplicated(kept_first, A.span_hashes(data, kept))
    # three-word windows
    word_hashes = A.span_hashes(data, words)
    begins = np.flatnonzero(A.window_starts(words.first, 3))
    triples = A.window_hashes(word_hashes, 3)[begins] if len(begins) else np.zeros(0, np.uint64)
    again, _ = _duplicated(np.searchsorted(begins, words.first), triples)
    covered = np.zeros(len(word_hashes), bool)
    for k in range(3):
        covered[begins[again] + k] = True
    return [np.diff(words.first), in_rows(heads & ~spaces), in_rows(SYMBOLS[data]),
            A.count_by_row(kept_first, later), A.count_by_row(words.first, covered), np.diff(kept_first),
            in_rows((data >= 65) & (data <= 90)), in_rows((data >= 48) & (data <= 57)),
            in_rows((data == 33) | (data == 63))]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk in A.chunks(batches, "stat_text"):
        kept = [c for c in chunk.batch.schema.names if c != "stat_text"]
        yield pa.RecordBatch.from_arrays(
            [chunk.batch.column(c) for c in kept] + [A.long_array(x) for x in _counts(chunk)],
            names=kept + [f"stat_{c}" for c in COUNTS])


def statistics(rows: DataFrame, text: str = "text") -> DataFrame:
    """`rows` with their counts in one struct column `stats`; rows may hold any other columns."""
    names = [f"c{i}" for i in range(len(rows.columns))]
    plain = rows.toDF(*names)
    at = rows.columns.index(text)
    schema = T.StructType([*plain.schema.fields, *[T.StructField(f"stat_{c}", T.LongType()) for c in COUNTS]])
    counted = plain.withColumn("stat_text", F.col(names[at])).mapInArrow(_count, schema)
    stats = F.struct(*[F.col(f"stat_{c}").alias(c) for c in COUNTS]).alias("stats")
    return counted.select(*[F.col(n).alias(c) for n, c in zip(names, rows.columns, strict=True)], stats)


def base_failed(stats: Column) -> Column:
    return (stats.n_words < 50) | (100 * stats.n_repeat_words > 50 * stats.n_words)


# --- what rules may test: a share, as numerator, denominator ----------------------------------------
FEATURES = {
    "words": ("n_words", None), "word_length": ("word_chars", "n_words"), "symbols": ("n_symbols", "n_words"),
    "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"),
    "line_words": ("n_words", "n_lines"), "upper": ("n_upper", "word_chars"),
    "digits": ("n_digits", "word_chars"), "marks": ("n_marks", "n_words"),
}


def feature(stats: Column, name: str) -> Column:
    top, bottom = FEATURES[name]
    value = stats[top].cast("double")
    return value if bottom is None else value / F.greatest(stats[bottom], F.lit(1)).cast("double")


@dataclass(frozen=True)
class Test:
    name: str
    above: bool
    threshold: float

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        return table[self.name] >= self.threshold if self.above else table[self.name] < self.threshold

    def column(self, stats: Column) -> Column:
        value = feature(stats, self.name)
        return value >= F.lit(self.threshold) if self.above else value < F.lit(self.threshold)


Rule = tuple[Test, ...]


def _holds(rule: Rule, table: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(table.values()))), bool)
    for test in rule:
        out &= test.holds(table)
    return out


def _best_test(table: dict[str, np.ndarray], bad: np.ndarray) -> tuple[float, Test | None]:
    """The threshold with the largest FOIL gain, over every cut between two neighbouring values."""
    total_p, total = bad.sum(), len(bad)
    best: tuple[float, Test | None] = (1e-9, None)
    for name, values in table.items():
        order = np.argsort(values, kind="stable")
        v, p = values[order], np.cumsum(bad[order])
        cuts = np.flatnonzero(v[1:] > v[:-1])
        for above in (False, True):
            pos = (total_p - p[cuts]) if above else p[cuts]
            n = (total - 1 - cuts) if above else cuts + 1
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(pos > 0, pos * (np.log2(pos / n) - np.log2(total_p / total)), 0.0)
            if len(gain) and gain.max() > best[0]:
                at = int(np.argmax(gain))
                best = float(gain[at]), Test(name, above, float((v[cuts[at]] + v[cuts[at] + 1]) / 2))
    return best


def _grow(table: dict[str, np.ndarray], bad: np.ndarray, max_tests: int) -> Rule:
    rule: Rule = ()
    live = np.arange(len(bad))
    while len(rule) < max_tests and bad[live].any() and not bad[live].all():
        _, test = _best_test({k: v[live] for k, v in table.items()}, bad[live])
        if test is None:
            break
        rule += (test,)
        live = live[test.holds({test.name: table[test.name][live]})]
    return rule


def _worth(rule: Rule, table: dict[str, np.ndarray], bad: np.ndarray) -> float:
    covered = _holds(rule, table)
    p, n = int((covered & bad).sum()), int((covered & ~bad).sum())
    return (p - n) / (p + n) if p + n else -1.0


def fit(table: dict[str, np.ndarray], bad: np.ndarray, prune: np.ndarray, max_rules: int = 12,
        max_tests: int = 4, min_precision: float = 0.9, min_covered: int = 4) -> list[Rule]:
    """Rules for `bad` rows; `prune` marks the rows that rules are pruned and judged on."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    while len(rules) < max_rules:
        grow_at, prune_at = np.flatnonzero(left & ~prune), np.flatnonzero(left & prune)
        if bad[grow_at].sum() < min_covered:
            break
        part = lambda at: {k: v[at] for k, v in table.items()}
        rule = _grow(part(grow_at), bad[grow_at], max_tests)
        if not rule:
            break
        kept = max((rule[:n] for n in range(len(rule), 0, -1)),
                   key=lambda r: _worth(r, part(prune_at), bad[prune_at]))
        covered = _holds(kept, table) & left
        p, n = int((covered & bad).sum()), int(covered.sum())
        if _worth(kept, part(prune_at), bad[prune_at]) < 2 * min_precision - 1 \
                or p < min_covered or p < min_precision * n:
            break
        rules.append(kept)
        left &= ~covered
    return rules


def learn(stats: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS,
          **limits) -> list[Rule]:
    """Rules from `labels` (doc_id, label: 0 is low quality) and a table (doc_id, stats)."""
    marked = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select(
        "doc_id", F.col(label).alias("mark"))
    # tasks send about what the sample needs, however many labels there are
    share = min(1.0, 1.2 * sample_rows / max(1, marked.count()))
    marked = marked.filter(F.xxhash64("doc_id") <= min((1 << 63) - 1, -(1 << 63) + int(share * (1 << 64))))
    rows = (stats.select("doc_id", "stats").join(marked, "doc_id")
                 .filter(~base_failed(F.col("stats")))
                 .select(F.xxhash64("doc_id").alias("draw"), "doc_id", "mark",
                         *[feature(F.col("stats"), n).alias(n) for n in FEATURES])
                 .orderBy("draw", "doc_id", "mark").limit(sample_rows).toPandas())
    if rows.empty or rows["mark"].nunique() < 2:
        return []
    table = {n: rows[n].to_numpy() for n in FEATURES}
    return fit(table, rows["mark"].to_numpy() == 0, rows["draw"].to_numpy() % 3 == 0, **limits)


def rule_number(stats: Column, rules: list[Rule]) -> Column:
    """The first rule that holds (from 1), or null."""
    out = F.lit(None).cast("int")
    for i in range(len(rules), 0, -1):
        every = F.lit(True)
        for test in rules[i - 1]:
            every = every & test.column(stats)
        out = F.when(every, F.lit(i)).otherwise(out)
    return out


def verdict(stats: Column, rules: list[Rule]) -> Column:
    return ~base_failed(stats) & rule_number(stats, rules).isNull()
