"""Conversation structure, whitening and packing, against plain versions."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rulegrain.llm import conversation_repair, packing, structure_queries, whitening

TURNS = "conv_id long, turn long, role string, text string"
BLANK = set(" \t\n\x0b\x0c\r")


# --- conversation structure -----------------------------------------------------------------------------
def spoilt(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def mended(turns):
    """(cost, audit, repaired turns) by a search over the turns and the role that stands last."""
    seen, faults = set(), []
    for role, text in turns:
        solid = [c for c in text if c not in BLANK]
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen
                      else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    best = {"": (0, "", ())}

    def offer(table, state, way):
        if state not in table or way[:2] < table[state][:2]:
            table[state] = way

    def filled(table):
        for _ in range(4):
            for state, (cost, audit, done) in list(table.items()):
                for r in "ua":
                    if (state, r) in NEXT:
                        offer(table, r, (cost + 5, audit + "I", (*done, ({"u": "user", "a": "assistant"}[r], ""))))
        return table

    for (role, text), fault in zip(turns, faults, strict=True):
        after = {}
        for state, (cost, audit, done) in filled(best).items():
            offer(after, state, (cost + 2, audit + "D", done))
            if fault in ("", "truncated"):
                stay = 5 * (fault == "truncated")
                if (state, role[:1]) in NEXT:
                    offer(after, NEXT[state, role[:1]], (cost + stay, audit + "K", (*done, (role, text))))
                for new in ("user", "assistant"):
                    if (state, new[0]) in NEXT:
                        offer(after, new[0], (cost + stay + 1, audit + "R", (*done, (new, text))))
        best = after
    cost, audit, done = min(way for state, way in filled(best).items() if state in ("", "a"))
    assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in done))
    return cost, audit, done, faults


def repaired(rows):
    convs = defaultdict(list)
    for row in spoilt(rows):
        convs[row[0]].append(row)
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted(convs[conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        cost, audit, done, faults = mended([r[2:] for r in own])
        numbers = {r[1] for r in own} - {None}
        heads = [r[2][:1] for r in own]
        out[conv] = (max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, faults.count("blank"),
                     faults.count("duplicate"), faults.count("truncated"),
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(heads, heads[1:], strict=False)), cost, audit,
                     hashlib.sha256("\n".join(f"{r}:{t}" for r, t in done).encode()).hexdigest())
    return out


def conversations(rng):
    texts = ["Yes.", "No!", "a b", "", " \t\n", None, "Why?  \n", "é…", "x. y", "Good.\x85", "'“?", "long " * 3000 + "."]
    roles = ["user"] * 6 + ["assistant"] * 6 + ["system", "System", "", None, "tool", "u"]
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rng.choice([1, 2, 4, 7, 30])):
            rows.append((conv, rng.choice([turn, turn, turn, turn, turn + 3, None]), rng.choice(roles), rng.choice(texts)))
    hot = [(-1, t, ["user", "assistant"][t % 2 ^ (rng.random() < 0.2)], f"{t % 97}{'.' * (t % 5 > 0)}") for t in range(600)]
    return [*rows, *rows[:40], *hot, (10**6, 1 << 62, "user", "a."), (10**6, -(1 << 62), "user", "b.")]


@pytest.mark.parametrize("segment", [3, 64, 4096])
def test_conversations_are_repaired_at_least_cost(spark, tmp_path, monkeypatch, segment):
    rows = conversations(random.Random(segment))
    spark.createDataFrame(rows, TURNS).withColumn("seq", F.lit("mine")).withColumn("conv", F.lit(1)).repartition(
        5).write.parquet(f"{tmp_path}/conversations.parquet")
    own = conversation_repair.repair
    monkeypatch.setattr(conversation_repair, "repair", lambda turns: own(turns, segment))
    found = structure_queries.repaired_conversations(spark, str(tmp_path))
    expected = repaired(rows)
    got = {r[0]: tuple(r)[1:] for r in found.collect()}
    assert got == expected


def test_stack_automaton():
    own = conversation_repair.automaton()
    for text in ("", "ua", "sua", "uaua", "suaua", "s", "u", "a", "ss", "us", "uau", "sa", "uaa"):
        stack = 0
        for symbol in text:
            stack = None if stack is None else own.shift[stack].get(symbol)
        assert (stack is not None and own.accepts[stack]) == bool(re.fullmatch("(s?(ua)+)?", text)), text


def test_edits_of_each_turn(spark):
    rows = [(1, 1, "user", "Hi."), (1, 2, "user", "You?"), (1, 3, "assistant", "Yes."), (1, 4, "assistant", "")]
    found = conversation_repair.edits(spark.createDataFrame(rows, TURNS)).orderBy("seq").collect()
    assert [(r.inserted, r.edit, r.new_role, r.after) for r in found] == [
        ("", "D", None, ""), ("", "K", None, ""), ("", "K", None, ""), ("", "D", None, "")]


def test_no_conversations(spark, tmp_path):
    spark.createDataFrame([], TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    assert structure_queries.repaired_conversations(spark, str(tmp_path)).collect() == []


# --- whitening ----------------------------------------------------------------------------------------------
VECTORS = "vec_id long, embedding array<float>"


def by_numpy(rows, wanted=4):
    """{width: (n, S, eigenvalues, vectors, V)} of the distinct whole vectors."""
    whole = defaultdict(set)
    for _, vector in rows:
        if vector and all(x is not None and np.isfinite(x) for x in vector):
            whole[len(vector)].add(tuple(int(np.floor(256 * float(np.float32(x)))) for x in vector))
    out = {}
    for width, fit in whole.items():
        x = np.array(sorted(fit), float)
        v = np.cov(x.T, bias=True).reshape(width, width)
        e, u = np.linalg.eigh(v)
        out[width] = len(fit), x.sum(axis=0), e[::-1][:wanted], u[:, ::-1][:, :wanted], v
    return out


def test_whitening_against_a_full_decomposition(spark):
    rng = np.random.default_rng(4)
    mixed = rng.standard_normal((9, 9)) * np.linspace(0.3, 2, 9)[:, None]
    rows = [(i, (rng.standard_normal(9) @ mixed).astype(np.float32).tolist()) for i in range(3000)]
    rows += [(5000 + i, rng.standard_normal(2).astype(np.float32).tolist()) for i in range(50)]
    rows += [(None, rows[0][1]), rows[1], rows[1], (9000, None), (9001, [None] * 9), (9002, [float("nan")] * 9),
             (9003, [float("inf")] + [0.0] * 8), (9004, []), (9005, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, VECTORS).withColumn("n", F.lit("mine")).withColumn("cells", F.lit(None)).repartition(37)
    found = whitening.whiten(df).collect()
    models = by_numpy(rows)
    expected = sum(min(4, len(v)) for _, v in rows if v and all(x is not None and np.isfinite(x) for x in v)) - 3
    assert len(found) == expected  # the only vector of width 3 has no components
    byid = defaultdict(dict)
    for r in found:
        byid[r.vec_id][r.component] = r
        assert r.identity_error <= 1e-9
    for vec_id, vector in rows[:100] + rows[3000:3050]:
        n, sums, e, u, v = models[len(vector)]
        x = np.floor(256 * np.array(vector, np.float32).astype(float))
        for c, r in byid[vec_id].items():
            assert r.n == n and r.deviation == int(((n * x - sums) ** 2).sum())
            own = (x - sums / n) @ u[:, c - 1] / np.sqrt(e[c - 1])
            assert abs(abs(r.whitened) - abs(own)) < 1e-9
            assert abs(r.explained / (e[c - 1] / np.trace(v)) - 1) < 1e-10


def test_copies_weigh_once_and_large_values_are_exact(spark):
    rng = random.Random(2)
    some = [[rng.uniform(-1e16, 1e16) for _ in range(3)] for _ in range(20)]
    rows = [(i, some[0] if i % 3 else some[i % 20]) for i in range(300)]
    found = whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()
    assert {r.n for r in found} == {20} and len(found) == 900
    assert all(r.identity_error < 1e-4 and r.deviation == (1 << 63) - 1 for r in found)


@pytest.mark.parametrize("values", [[9, 7, 5, 5, 5, 5, 1, 1], [1] * 8, [4, 3, 2, 1], [3, 1, 0, 0, 0], [2], [1, 1 - 1e-9, .5, .2, .1]])
def test_eigenpairs(values):
    q, _ = np.linalg.qr(np.random.default_rng(1).standard_normal((len(values), len(values))))
    v = q @ np.diag(np.array(values, float)) @ q.T
    v = (v + v.T) / 2
    found, vectors = whitening.feast(v, 4)
    assert np.abs(found - sorted(values)[::-1][:4]).max() < 1e-13 * max(values)
    assert np.abs(v @ vectors - vectors * found).max() < 1e-12 and np.abs(vectors.T @ vectors - np.eye(len(found))).max() < 1e-12
    for shift in (0.05, 0.6, 2.5, 8.0):
        assert whitening.count_above(v, shift) == sum(x > shift for x in values)


def test_merges_go_up_a_tree(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    rng = np.random.default_rng(7)
    rows = [(i, rng.standard_normal(6).astype(np.float32).tolist()) for i in range(500)]
    found = whitening.whiten(spark.createDataFrame(rows, VECTORS).repartition(23)).collect()
    assert len(found) == 2000 and {r.n for r in found} == {500} and max(r.identity_error for r in found) < 1e-9


def test_no_vectors(spark):
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], VECTORS)).collect() == []


# --- packing ------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def word_file():
    tokenizers = pytest.importorskip("public_tokenizers")
    return tokenizers.path("word_bpe_49k.json")


def plain_first_fit(sizes, capacity):
    bins, room = [], []
    for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = next((b for b, r in enumerate(room) if r >= sizes[item]), len(room))
        if at == len(room):
            bins.append([])
            room.append(capacity)
        bins[at].append(item)
        room[at] -= sizes[item]
    return bins


def test_tree_finds_the_first_fit():
    rng = random.Random(1)
    for _ in range(60):
        capacity = rng.choice([1, 7, 64, 4096])
        sizes = [rng.randint(1, capacity) for _ in range(rng.choice([0, 1, 2, 3, 50, 300]))]
        assert packing.first_fit_decreasing(sizes, capacity) == plain_first_fit(sizes, capacity)


def test_sequences_hold_every_token_and_no_padding():
    rng = random.Random(2)
    for capacity in (1, 3, 64, 4096):
        for n in (0, 1, 2, 200):
            lengths = [rng.choice([1, rng.randint(1, capacity), rng.randint(1, 5 * capacity)]) for _ in range(n)]
            seen = defaultdict(list)
            found = packing.sequences(lengths, capacity)
            for pieces in found:
                total = sum(p[2] for p in pieces)
                assert total == capacity or total.bit_count() == 1 and total < capacity
                for doc, start, length in pieces:
                    seen[doc] += range(start, start + length)
            assert all(sorted(seen[d]) == list(range(k)) for d, k in enumerate(lengths))
            assert sum(sum(p[2] for p in s) < capacity for s in found) <= capacity.bit_length()


ODD = ["", None, "  \n\n x", "İ. Foo", "WORD... don't I'll O'Brien's", "<|endoftext|> a<|startoftext|>b", "́a é. 가.",
       "ΟΔΟΣ. ΟΔΟΣ ὈΔΥΣΣΕΎΣ", "a b c\x1cd\te", "日本語。テスト.", "x\r\ny", "ﬁ. Ǆ, ß! ẞ ǅ ª Éa ŉ", "가. Å K ſ",
       "x" * 9000, "一" * 3000, "word " * 9000]


def test_words_have_the_ids_of_whole_texts(word_file, monkeypatch):
    from tokenizers import Tokenizer

    rng = random.Random(5)
    pick = lambda: chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x500), rng.randrange(0x1E00, 0x2000),
                                   rng.randrange(0xAC00, 0xAD00), 32, 46, 10]))
    texts = [t or "" for t in ODD] + ["".join(pick() for _ in range(60)) for _ in range(800)]
    expected = [e.ids for e in Tokenizer.from_file(word_file).encode_batch(texts, add_special_tokens=False)]
    monkeypatch.setattr(packing, "KNOWN_WORDS", 500)  # forgotten again and again
    own = packing.Words(word_file)
    assert [x.tolist() for at in range(0, len(texts), 9) for x in own.encode(texts[at:at + 9])] == expected


def test_pieces_tell_where_every_id_is(spark, word_file, monkeypatch):
    from tokenizers import Tokenizer

    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "Gamma,", "δ", "42"]) for _ in range(rng.randrange(0, 900)))) for i in range(300)]
    rows += [(1000 + i, t) for i, t in enumerate(ODD)] + [(None, "a b"), (None, None), rows[0], rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("at", F.lit("x"))
    monkeypatch.setattr(packing, "GROUP_TOKENS", 20_000)
    capacity = 256
    found = packing.pack(df.repartition(3), word_file, capacity=capacity).collect()
    library = Tokenizer.from_file(word_file)
    expected = sorted((-1 if d is None else d, tuple(e.ids + [2])) for (d, _), e in zip(rows, library.encode_batch(
        [t or "" for _, t in rows], add_special_tokens=False), strict=True))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in found:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length > 0
        by_doc[-1 if r.doc_id is None else r.doc_id, r.doc_tokens].append((r.start, r.ids))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == capacity or at.bit_count() == 1
    # documents of one id and length are told apart by their pieces' content
    whole = defaultdict(list)
    for d, ids in expected:
        whole[d, len(ids)].append(ids)
    assert set(whole) == set(by_doc)
    for key, copies in whole.items():
        assert sum(len(ids) for _, ids in by_doc[key]) == len(copies) * key[1]
        if len(copies) == 1:
            assert [x for _, ids in sorted(by_doc[key]) for x in ids] == list(copies[0])
        else:
            assert all(any(tuple(ids) == c[s:s + len(ids)] for c in copies) for s, ids in by_doc[key])


def test_nothing_to_pack(spark, word_file):
    assert packing.pack(spark.createDataFrame([], "doc_id string, text string"), word_file).collect() == []
