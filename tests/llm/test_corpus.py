"""Mixing, chats and the pipeline."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rulegrain.llm import chat_repair, source_mix
from tests.llm import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# --- mixing ---------------------------------------------------------------------------------------------
@pytest.mark.parametrize("slots", [{"a": 3, "b": 2, "c": 1}, {"a": 512, "b": 256, "c": 256}, {"a": 1},
                                   {f"s{i:02d}": 1 + 7 * i for i in range(15)}])
def test_layout_is_pfair(spark, slots):
    quota = spark.createDataFrame([(s, m) for s, m in slots.items()], "source_key string, slots int")
    rows = source_mix.frame_layout(quota).collect()
    plan = [r.source_key for r in sorted(rows, key=lambda r: r.slot)]
    assert plan == brute.pfair(slots)
    frame, used = len(plan), Counter()
    for t, s in enumerate(plan, 1):
        used[s] += 1
        assert all(abs(used[x] - m * t / frame) < 1 for x, m in slots.items())
    for s in slots:
        assert sorted(r.nth for r in rows if r.source_key == s) == list(range(slots[s]))


def test_mix_follows_the_weights_and_keeps_every_row(spark):
    rng = random.Random(1)
    rows = [(i, "x" * rng.randrange(1, 40), "en", rng.choice(["hot"] * 6 + ["b", "c", None]), 1) for i in range(3000)]
    rows += [(7000, None, None, "b", None), (7001, "", "en", "only empty", 0), (None, "y", "en", "c", 1), rows[0], rows[0],
             (7002, "z" * 5000, "en", "c", 1)]
    df = spark.createDataFrame(rows, DOCS).withColumn("mix_slot", F.lit("mine"))
    out = source_mix.mix(df.drop("mix_slot"), frame=64, block_chars=100).collect()
    assert Counter(tuple(r[:5]) for r in out) == Counter(rows)
    weights = spark.createDataFrame([("=hot", 1.0), ("=b", 2.0), ("=c", 1.0)], "source_key string, weight double")
    mixed = source_mix.mix(df.drop("mix_slot"), weights, frame=64, block_chars=100)
    slots = Counter()
    shares = {r.source_key: r.slots for r in source_mix.quotas(
        weights.union(spark.createDataFrame([("", 0.0), ("=only empty", 0.0)], weights.schema)), 64).collect()}
    assert sum(shares.values()) == 64 and min(shares.values()) == 1 and shares["=b"] > 1.8 * shares["=hot"]
    for r in mixed.select("source", "mix_slot", "mix_block").distinct().collect():
        slots[r.source, r.mix_slot] += 1
    assert max(slots.values()) == 1  # a slot holds one block
    in_slot = mixed.groupBy("mix_slot").agg(F.count_distinct(F.coalesce("source", F.lit("")))).collect()
    assert {r[1] for r in in_slot} == {1}
    ordered = source_mix.in_order(mixed, 5).select("mix_slot", "mix_chars_before").collect()
    assert ordered == sorted(ordered)


def test_mix_with_columns_of_its_own_names(spark):
    rows = [(i, "x" * (i % 90), "en", "ab"[i % 2], 1) for i in range(300)]
    df = spark.createDataFrame(rows, DOCS)
    names = ["chars", "slots", "slot", "n_buckets", "mix_frame", "mix_source", "mix_bucket", "mix_within", "mix_key", "mix_nth", "mix_own_0"]
    clash = df.withColumns({n: F.lit(f"mine {n}") for n in [*names, *source_mix.PLACE]})
    got = source_mix.mix(clash, frame=64, block_chars=100)
    own = source_mix.mix(df, frame=64, block_chars=100)
    assert sorted(map(tuple, got.select(own.columns).collect())) == sorted(map(tuple, own.collect()))
    assert {tuple(r) for r in got.select(names).collect()} == {tuple(f"mine {n}" for n in names)}


def test_mix_of_nothing(spark):
    assert source_mix.mix(spark.createDataFrame([], DOCS)).collect() == []


# --- chats ----------------------------------------------------------------------------------------------
def least_cost(codes):
    costs = {0: 0}
    for c in codes:
        after = {}
        for s, v in costs.items():
            for t in range(4):
                if (c, s, t) in chat_repair.ACTIONS:
                    after[t] = min(after.get(t, 1 << 60), v + chat_repair.ACTIONS[c, s, t][0])
        costs = after
    return min(costs.values())


CODES = {"system": 0, "user": 1, "assistant": 2, None: 3, "Human": 1, " GPT ": 2, "zzz": 3}


def test_chats_are_legal_and_cheapest_however_they_are_cut(spark, monkeypatch):
    rng = random.Random(5)
    rows, truth = [], {}
    for c in [*range(40), None]:
        roles = [rng.choice(list(CODES)) for _ in range(rng.choice([1, 2, 3, 8, 40]))]
        truth[c] = least_cost([CODES[r] for r in roles])
        rows += [(c, i, r, rng.choice([f"t{c}.{i}", "", None, "<|user|>\nsly"]), "x") for i, r in enumerate(roles)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, rendered string").repartition(3)
    seen = []
    for segment, fan in ((4, 2), (512, 256)):
        monkeypatch.setattr(chat_repair, "SEGMENT", segment)
        monkeypatch.setattr(chat_repair, "FAN", fan)
        out = sorted(chat_repair.repair(df).collect(), key=lambda r: r.position)
        assert len(out) == len(rows)
        cost, text = Counter(), Counter()
        texts = {}
        for r in out:
            cost[r.conv_id] += r.cost
            texts[r.conv_id] = texts.get(r.conv_id, "") + r.rendered
        assert {c: cost[c] for c in truth} == truth
        for t in texts.values():
            roles = re.findall(r"<\|(system|user|assistant)\|>\n", t)
            assert re.fullmatch(r"s?(ua)*u?", "".join(r[0] for r in roles)) and t.count("<|end|>\n") == len(roles)
        seen.append(texts)
        assert not text
    assert seen[0] == seen[1]


def test_a_clean_chat_stays(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, None, "user", "last"), (2, 0, "assistant", "alone")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): r for r in chat_repair.repair(df).collect()}
    assert [got[1, t].action for t in (0, 1, None)] == ["keep"] * 3
    assert "".join(got[1, t].rendered for t in (0, 1, None)) == (
        "<|user|>\na<|end|>\n<|assistant|>\nb<|end|>\n<|user|>\nlast<|end|>\n")
    assert (got[2, 0].action, got[2, 0].new_role) in (("relabel", "user"),)
    assert chat_repair.repair(df.limit(0)).collect() == []


# --- the pipeline -----------------------------------------------------------------------------------------
def small_corpus(rng):
    vocabulary = [f"word{i}" for i in range(900)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = [(i, "\n".join(say(30) for _ in range(rng.choice([2, 3, 5]))), "en", f"s{i % 3}", 1) for i in range(80)]
    near = rows[4][1].split(" ")
    near[10] = "changed"
    shared = "one passage of words that stands alone on its line everywhere"
    rows += [(200, rows[3][1], "en", "s1", 1), (201, " ".join(near), "en", "s1", 1), (202, None, None, None, None),
             (203, "", "en", "s1", 0), (204, "too few words", "en", "s1", 3), (205, "again and again " * 60, "en", "s2", 5),
             (None, say(120), "fr", None, None), rows[7], (206, shared + "\n" + say(70), "en", "s0", 1),
             (207, say(70) + "\n" + shared, "en", "s0", 1), (208, say(20_000), "en", "s0", 1)]
    return rows


def test_stages(spark, tmp_path):
    rng = random.Random(8)
    rows = small_corpus(rng)
    sf_dir = str(tmp_path)
    columns = DOCS + ", stats string, line_counts int, mix_slot int, c0 double"
    docs = spark.createDataFrame([(*r, "s", 1, 2, 0.5) for r in rows], columns)
    docs.write.parquet(f"{sf_dir}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(
        f"{sf_dir}/labels.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality rules", "line dedup", "n-gram jaccard join", "source mix", "byte-level bpe"]
    out, seen = docs, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, out, sf_dir)
        if k < 4:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(f"{sf_dir}/{k}")
        out = spark.read.parquet(f"{sf_dir}/{k}")
        seen[name] = out.collect()
    ids = lambda name: sorted((r.doc_id for r in seen[name]), key=str)
    kept = [r[0] for r in rows if r[0] not in (202, 203, 204, 205)]
    assert ids("quality rules") == sorted(kept, key=str)
    # row 200 is a whole copy; 207 loses the passage that 206 has
    assert ids("line dedup") == sorted([i for i in kept if i != 200], key=str)
    texts = {r.doc_id: r for r in seen["line dedup"]}
    assert texts[207].text == rows[-2][1].split("\n")[0] and texts[207].n_chars == len(texts[207].text)
    assert texts[206].n_chars == 1 and (texts[5].stats, texts[5].line_counts, texts[5].mix_slot, texts[5].c0) == ("s", 1, 2, 0.5)
    left = [i for i in kept if i not in (200, 201)]
    left.remove(7)  # given twice
    lines = {r.doc_id: r.text for r in seen["line dedup"] if r.doc_id is not None}
    again = brute.components(list(lines.items()), 5, 4, 5)
    assert {d for d, _, c in again if d == c} == {i for i in left if i is not None} | ({201} - {d for d, _, c in again if d != c})
    assert ids("n-gram jaccard join") == sorted([d for d, _, c in again if d == c] + [None], key=str)
    assert ids("source mix") == ids("n-gram jaccard join") == ids("byte-level bpe")
    import public_tokenizers as P
    import tiktoken

    from rulegrain.llm import bpe

    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(
        P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    last = {r.doc_id: r.text for r in seen["source mix"]}
    for r in seen["byte-level bpe"]:
        assert r.ids == library.encode_ordinary(last[r.doc_id]) and r.decoded_sha256 == brute.sha(last[r.doc_id])
    whole = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.ids_sha256) for r in whole if r.doc_id is not None) == sorted(
        (r.doc_id, r.ids_sha256) for r in seen["byte-level bpe"] if r.doc_id is not None)


def test_stages_of_nothing(spark, tmp_path):
    sf_dir = str(tmp_path)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf_dir}/labels.parquet")
    out = spark.createDataFrame([], DOCS)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out, sf_dir).write.parquet(f"{sf_dir}/{k}")
        out = spark.read.parquet(f"{sf_dir}/{k}")
        assert out.count() == 0


def slots_by_brute_force(rows):
    """(slot, characters before) of each (id, text, source) row, with all defaults of the mix."""
    sources = {}
    for doc, text, source in rows:
        key = "" if source is None else "=" + source
        shuffled = hashlib.md5(f"mix{'' if doc is None else doc}/{text}".encode()).hexdigest()
        sources.setdefault(key, []).append((shuffled, doc, text))
    chars = {s: sum(len(x[2]) for x in of) for s, of in sources.items()}
    whole = sum(c ** 0.5 for c in chars.values())
    exact = {s: c ** 0.5 / whole * (source_mix.FRAME - len(chars)) for s, c in chars.items()}
    slots = {s: 1 + int(e) for s, e in exact.items()}
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))[:source_mix.FRAME - sum(slots.values())]:
        slots[s] += 1
    at = {}
    for t, s in enumerate(brute.pfair(slots)):
        at.setdefault(s, []).append(t)
    out = []
    for s, of in sources.items():
        before = 0
        for _, doc, text in sorted(of, key=lambda x: x[0]):
            block = min(before // source_mix.BLOCK_CHARS, -(-chars[s] // source_mix.BLOCK_CHARS) - 1)
            out.append((block // slots[s] * source_mix.FRAME + at[s][block % slots[s]], before, doc, brute.sha(text)))
            before += len(text)
    return out


def test_the_mix_reaches_the_token_ids(spark, tmp_path):
    rng = random.Random(9)
    words = [f"word{i}" for i in range(900)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, say(rng.choice([200, 12_000])), "en", rng.choice(["a", "a", "b", None]), 1) for i in range(40)]
    twin = (None, say(300), "en", None, 1)
    rows += [twin, twin, (None, say(300), "en", "b", 1)]
    sf_dir = str(tmp_path)
    spark.createDataFrame(rows, DOCS).repartition(5).write.parquet(f"{sf_dir}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf_dir}/labels.parquet")
    out = corpus_pipeline.run(spark, sf_dir)
    got = [(r.mix_slot, r.mix_chars_before, r.doc_id, r.decoded_sha256) for r in out.collect()]
    want = slots_by_brute_force([(r[0], r[1], r[3]) for r in rows])
    assert len({x[0] for x in want}) > 20
    assert Counter(got) == Counter(want)
    assert [x[:2] for x in got] == sorted(x[:2] for x in got)


def test_token_ids_ask_for_the_mix(spark):
    with pytest.raises(ValueError):
        corpus_pipeline.token_ids(spark, spark.createDataFrame([], DOCS), "")
