import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rulegrain.llm import line_dedup, ngram_jaccard, substring_dedup, text_arrays as A
from tests.llm import brute

DOCS = "doc_id long, text string"


def test_words_and_lines_of_chunks():
    texts = ["a b  c", None, "", " x\ty\x0bz ", "héé A\n\nb", "\n", "tail"]
    batch = pa.record_batch({"text": pa.array(texts)})
    for size in (1, 5, 1 << 20):
        words, lines = [], []
        for c in A.chunks([batch], size=size):
            for spans, out in ((A.words(c), words), (A.lines(c), lines)):
                out += [[bytes(c.data[spans.starts[k]:spans.ends[k]]) for k in range(spans.first[r], spans.first[r + 1])]
                        for r in range(len(c.batch))]
        assert words == [(t or "").encode().split() for t in texts]
        assert lines == [(t or "").encode().split(b"\n") for t in texts]


def test_equal_words_hash_alike_wherever_they_stand():
    batch = pa.record_batch({"text": pa.array(["one two one", "two  ONE"])})
    chunk = next(A.chunks([batch]))
    h = A.span_hashes(chunk.data, A.words(chunk), A.LOWER)
    assert h[0] == h[2] == h[4] and h[1] == h[3] and h[0] != h[1]
    assert np.array_equal(A.window_starts(A.words(chunk).first, 2), [True, True, False, True, False])


def corpus(seed=0, n=60):
    """Texts with exact and near copies, shared passages, ties, odd rows, and one that is long."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["Ünï", "#", "a"]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    rows = []
    for i in range(n):
        kind = rng.random()
        if rows and kind < 0.2:
            text = rng.choice(rows)[1]
        elif rows and kind < 0.55:
            w = (rng.choice(rows)[1] or "").split()
            for _ in range(rng.choice([1, 1, 2, 6])):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocabulary)
            text = " ".join(w)
        else:
            w = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 4, 8, 40, 90, 200]))]
            if kind > 0.75:
                at = rng.randrange(len(w) + 1)
                w[at:at] = passage
            text = rng.choice([" ", "\n"]).join(w)
        rows.append((i * 3 % (2 * n), text))
    rows += [(1000, None), (1001, ""), (None, rows[5][1]), (None, None), (1002, " \n\t "), rows[3], rows[3],
             (1003, " ".join(rng.choice(vocabulary) for _ in range(20_000))), (1004, "x" * 50_000),
             (1005, "same " * 300), (1006, "SAME " * 300)]
    return rows


@pytest.mark.parametrize(("width", "num", "den"), [(4, 85, 100), (5, 4, 5), (2, 1, 2)])
def test_jaccard_against_all_pairs(spark, width, num, den):
    rows = corpus(width)
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_jaccard.join(df, width, num, den).collect()), key=repr)
    assert got == sorted(brute.components(rows, width, num, den), key=repr)


def test_jaccard_of_a_large_group_whose_members_do_not_all_link(spark, monkeypatch):
    rng = random.Random(2)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for at in rng.sample(range(120), rng.choice([0, 1, 2, 3, 4])):
            w[at] = f"e{i}.{at}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, DOCS)
    got = {(r.doc_id, r.component_id) for r in ngram_jaccard.join(df, 4, 85, 100).collect()}
    assert got == {(d, c) for d, _, c in brute.components(rows, 4, 85, 100)}
    monkeypatch.setattr(ngram_jaccard, "BLOCK_SETS", 20)  # several tiles
    monkeypatch.setattr(ngram_jaccard, "BLOCK_GRAMS", 2000)
    monkeypatch.setattr(ngram_jaccard, "FRAGMENT_GRAMS", 16)
    assert {(r.doc_id, r.component_id) for r in ngram_jaccard.join(df, 4, 85, 100).collect()} == got


def test_jaccard_of_no_documents(spark):
    none = spark.createDataFrame([], DOCS)
    assert ngram_jaccard.join(none).collect() == []


def test_fragment_cuts_leave_no_pair_of_sizes_out():
    cuts = ngram_jaccard.Cuts(85, 100)
    for a in range(1, 400):
        for b in range(a, a * 100 // 85 + 1):
            if 100 * a >= 85 * b:  # the smaller inside the larger
                shared = {c for c, _ in cuts.of(a)} & {c for c, _ in cuts.of(b)}
                assert any(dict(cuts.of(a))[c] > b - a for c in shared)


@pytest.mark.parametrize("window", [13, 5])
def test_substrings_against_all_windows(spark, window):
    rows = [(d, t) for d, t in corpus(window, 80)]
    df = spark.createDataFrame(rows, DOCS).repartition(6)
    got = sorted(tuple(r) for r in substring_dedup.remove_repeats(df, window).collect() if r.doc_id is not None)
    assert got == sorted(r for r in brute.repeats_removed(rows, window) if r[0] is not None)
    nameless = [tuple(r) for r in substring_dedup.remove_repeats(df, window).collect() if r.doc_id is None]
    assert all(r[2] == 0 for r in nameless) and len(nameless) == 2


def test_substrings_settled_in_one_task_and_across_tasks(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"h{i} {passage} t{i}") for i in range(400)]
    for tasks in (1, 7):
        df = spark.createDataFrame(rows, DOCS).repartition(tasks)
        got = {r.doc_id: (r.n_removed, r.kept_text) for r in substring_dedup.remove_repeats(df).collect()}
        assert got[0][0] == 0 and all(got[i] == (60, f"h{i} t{i}") for i in range(1, 400))


def test_windows_of_one_hash_and_other_words_stay_apart():
    data = np.frombuffer(b"aa bb aa cc aa bb", np.uint8)
    starts, ends = np.array([0, 6, 12]), np.array([5, 11, 17])
    flags = substring_dedup._later_windows(data, starts, ends, np.array([7, 7, 7], np.uint64), np.array([1, 2, 3]))
    assert flags.tolist() == [False, False, True]


def test_substrings_of_no_documents(spark):
    assert substring_dedup.remove_repeats(spark.createDataFrame([], DOCS)).collect() == []


def line_corpus():
    rng = random.Random(4)
    lines = [" ".join(f"l{i}.{k}" for k in range(rng.choice([1, 2, 9, 12]))) for i in range(25)]
    rows = []
    for i in range(60):
        text = [rng.choice(lines + ["", "  ", "only once %d" % i, "\t" + lines[0] + " "]) for _ in range(rng.randrange(9))]
        if rows and rng.random() < 0.3:
            text += (rng.choice(rows)[1] or "").split("\n")
        rows.append((i, "\n".join(text)))
    return rows + [(100, None), (101, ""), (102, "\n\n"), (None, rows[7][1] + "\nthe last one is nobody's"),
                   (103, "\n".join(f"long {i} line of more than eight words in it all" for i in range(3000)))]


@pytest.mark.parametrize("min_lines", [2, 3, 5])
def test_lines_against_all_runs(spark, min_lines):
    rows = line_corpus()
    df = spark.createDataFrame([(d, t, "kept", 7) for d, t in rows], DOCS + ", line_counts string, c0 int").repartition(4)
    out = line_dedup.remove_repeated_lines(df, min_lines, 8)
    assert out.columns == [*df.columns, "line_counts"]
    got = {r[0]: r[1] for r in out.collect()}
    assert got == {d: t for (d, _), t in zip(rows, brute.lines_deleted(rows, min_lines, 8), strict=True)}
    assert all(r[2] == "kept" and r[3] == 7 for r in out.collect())


def test_equal_rows_are_one_document(spark):
    rows = [(1, "a line of eight words or more is this one\nb"), (1, "a line of eight words or more is this one\nb"),
            (2, "a line of eight words or more is this one\nc")]
    got = sorted((r.doc_id, r.text) for r in line_dedup.remove_repeated_lines(spark.createDataFrame(rows, DOCS)).collect())
    assert got == [*rows[:2], (2, "c")]
    assert line_dedup.remove_repeated_lines(spark.createDataFrame([], DOCS)).count() == 0


def test_no_checkpoint_is_local_and_nothing_is_capped(spark):
    """Counts follow the input: twice the rows under new ids, twice the sets and windows."""
    rows = corpus(9)
    more = rows + [(None if d is None else d + 5000, None if t is None else t.replace("w", "v")) for d, t in rows]
    small = ngram_jaccard.join(spark.createDataFrame(rows, DOCS)).agg(F.sum("n_shingles")).first()[0]
    assert ngram_jaccard.join(spark.createDataFrame(more, DOCS)).agg(F.sum("n_shingles")).first()[0] == 2 * small
