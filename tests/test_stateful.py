import datetime as dt
import random
import time
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from rulegrain import reference_values as V
from rulegrain.operators import dialogue as D
from rulegrain.operators.admission import admit
from rulegrain.operators import directory as Y
from rulegrain.operators import snapshots
from rulegrain.operators.admission import pass_hits
from rulegrain.sources.sinks import KeyedTable
from rulegrain.streaming import conversation, rate_limit, refresh

START = dt.datetime(2026, 1, 1)


def python_admit(hits, limit, window):
    recent, out = {}, {}
    for key, ts, hit in sorted(hits, key=lambda h: (h[0], h[1], h[2])):
        q = recent.setdefault(key, deque())
        while q and q[0] <= ts - dt.timedelta(seconds=window):
            q.popleft()
        out[hit] = len(q) < limit
        if out[hit]:
            q.append(ts)
    return out


def random_hits(seed, n=1500, hot=0.5):
    """One hot key in bursts, a few quiet ones."""
    rng, clock, hits = random.Random(seed), {}, []
    for i in range(n):
        key = "hot" if rng.random() < hot else rng.choice("abc")
        pause = rng.choice([0, 0, 1, 5, 20, 60, 61, 300]) if rng.random() < .7 else rng.randint(0, 2500)
        clock[key] = clock.get(key, 0) + pause
        hits.append((key, START + dt.timedelta(seconds=clock[key]), f"{i:05d}"))
    return hits


@pytest.mark.parametrize("seed,limit", [(1, 3), (2, 1), (3, 5)])
def test_admission_against_the_fold(spark, seed, limit):
    hits = random_hits(seed)
    df = spark.createDataFrame(hits, "key string, ts timestamp, id string").repartition(4)
    got = {r.id: r.admitted for r in admit(df, limit, 60).collect()}
    want = python_admit(hits, limit, 60)
    assert not all(want.values())
    assert got == want


def test_exactly_one_window_old_is_expired(spark):
    hits = [("k", START, "1"), ("k", START + dt.timedelta(seconds=60), "2"),
            ("k", START + dt.timedelta(seconds=119.999), "3")]
    df = spark.createDataFrame(hits, "key string, ts timestamp, id string")
    assert {r.id: r.admitted for r in admit(df, 1, 60).collect()} == {"1": True, "2": True, "3": False}


def test_refused_hits_are_jumped_over():
    """Ten million hits of one key, of which thirty a minute pass."""
    times = np.arange(10_000_000, dtype=np.int64) * 10_000          # a hundred a second, for a day and more
    began = time.perf_counter()
    passed = pass_hits(times, np.zeros(len(times), bool), deque(), 30, 60_000_000)
    assert time.perf_counter() - began < 10
    assert passed.sum() == 30 * -(-len(times) // 6000) and passed[:30].all() and not passed[30:6000].any()


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_jumps_with_hits_that_pass_in_any_case(seed):
    rng = random.Random(seed)
    times = np.cumsum([rng.choice([0, 0, 1, 3, 20, 70]) for _ in range(3000)]).astype(np.int64)
    known = np.array([rng.random() < 0.05 for _ in times])
    recent, want = deque(), []
    for t, sure in zip(times, known):
        while recent and recent[0] <= t - 60:
            recent.popleft()
        want.append(bool(sure) or len(recent) < 4)
        if want[-1]:
            recent.append(t)
    held, got = deque(), []
    for at in range(0, 3000, 700):  # the state goes from one stretch to the next
        got += pass_hits(times[at:at + 700], known[at:at + 700], held, 4, 60).tolist()
    assert got == want and list(held) == list(recent)


def test_admission_stream_equals_batch(spark, tmp_path):
    hits = sorted(random_hits(4, n=400), key=lambda h: h[1])
    hits = [(None if k == "a" else k, ts, i) for k, ts, i in hits]
    # pieces end where time moves on
    cuts = [0, next(i for i in range(200, 400) if hits[i][1] > hits[i - 1][1]), 400]
    for a, b in zip(cuts, cuts[1:]):
        spark.createDataFrame(hits[a:b], "key string, ts timestamp, id string").write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema("key string, ts timestamp, id string").parquet(str(tmp_path / "in"))
        (rate_limit.admission_stream(source, 3, 60).writeStream.format("parquet").option("path", str(tmp_path / "out"))
         .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination())
    got = {r.id: r.admitted for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == python_admit([(k or "", ts, i) for k, ts, i in hits], 3, 60)


class PythonTalk:
    """The conversation rules, one message at a time."""

    def __init__(self):
        self.step, self.session, self.es = 0, 0, False

    def say(self, text, target):
        low = text.strip().lower()
        number = text.replace("$", "").replace(",", "").strip()
        n = int(number) if number.lstrip("+-").isdigit() else None
        yn = low in V.YES_WORDS + V.NO_WORDS
        if low in V.RESTART_WORDS:
            self.session += 1
            self.es = False
            before, self.step = self.step, 1
            return before, self.session, "restart"
        before = self.step
        if before == 1:
            self.es = low.startswith("2") or low.startswith("es")
        ok = {0: True, 1: True, 2: target is not None, 3: n is not None, 4: n is not None and n >= 1,
              5: yn, 6: yn, 7: False}[before]
        reply = {0: "welcome", 1: "ask_hospital", 2: "ask_income" if ok else "hospital_not_found",
                 3: "ask_household" if ok else "ask_number", 4: "ask_insurance" if ok else "ask_number",
                 5: "ask_collections" if ok else "ask_insurance", 6: "plan" if ok else "ask_collections",
                 7: "letter_sent" if low in V.LETTER_WORDS else "plan_footer"}[before]
        self.step += ok
        return before, self.session, reply


def random_talk(seed, senders=4, n=60):
    rng, rows = random.Random(seed), []
    for s in range(senders):
        for at in range(n):
            text = rng.choice(["hi", "2", "1", "Alpha", "30,000", "$5", "0", "3", "yes", "NO", "maybe", "carta",
                               "START" if rng.random() < .3 else "4"])
            rows.append((f"s{s}", at, text, 7 if text == "Alpha" else None))
    return rows


@pytest.mark.parametrize("fanout,levels", [(3, 3), (2048, 3), (8, 2)])
def test_conversation_against_the_rules(spark, fanout, levels):
    rows = random_talk(11)
    df = spark.createDataFrame(rows, "sender string, at long, text string, target long").repartition(3)
    got = {(r.sender, r["at"]): (r.step, r.session, r.reply)
           for r in D.converse(df, fanout=fanout, levels=levels).collect()}
    talks, want = {}, {}
    for sender, at, text, target in rows:
        want[sender, at] = talks.setdefault(sender, PythonTalk()).say(text, target)
    assert got == want


def test_anonymous_messages_start_afresh(spark):
    df = spark.createDataFrame([("", 0, "30000", None), ("", 1, "start", None), (None, 2, "yes", None)],
                               "sender string, at long, text string, target long")
    assert sorted((r["at"], r.reply) for r in D.converse(df).collect()) == [
        (0, "welcome"), (1, "restart"), (2, "welcome")]


def test_answers_of_a_session(spark):
    talk = ["hi", "2", "Alpha", "30,000", "4", "no", "yes", "start", "1", "Alpha", "5"]
    df = spark.createDataFrame([("s", i, t, 7 if t == "Alpha" else None) for i, t in enumerate(talk)],
                               "sender string, at long, text string, target long")
    rows = {r["at"]: r for r in D.converse(df).collect()}
    plan = rows[6]
    assert (plan.reply, plan.lang, plan.income, plan.household, plan.insured, plan.in_collections) == (
        "plan", "es", 30000, 4, False, True)
    assert (rows[10].reply, rows[10].lang, rows[10].income) == ("ask_household", "en", 5)


def test_conversation_stream_answers_every_message(spark, tmp_path):
    """The stream's replies, plans and letters are those of the batch, message by message."""
    rows = [(s, at, text) for s, at, text, _ in random_talk(5, senders=3, n=80)] + [
        ("", 0, "hello"), ("", 1, "start"), (None, 2, None)]
    df = spark.createDataFrame(rows, "sender string, at long, text string")
    places = spark.createDataFrame([(7, "ALPHA", "X"), (8, "OMEGA", "Y")], "pos long, hospital string, city string")
    policies = spark.createDataFrame(
        [(7, "ALPHA", "OR", ((200.0,), (None,), (400.0, [])), None)],
        "pos long, hospital string, state string, policy struct<free_care:struct<fpl_ceiling_pct:double>,"
        "high_medical_cost:struct<oop_threshold_pct_of_income:double>,discount_payment:struct<fpl_ceiling_pct:double,"
        "tiers:array<struct<fpl_low_pct:double,fpl_high_pct:double,benefit:string,discount_basis:string,"
        "patient_pays_pct:double>>>>, grounding struct<verdict:string>")
    index = Y.name_index(places)
    folder = str(tmp_path)
    for piece in ("at < 37", "at >= 37"):
        df.filter(piece).repartition(3).write.mode("append").parquet(f"{folder}/in")
        arriving = spark.readStream.schema(df.schema).parquet(f"{folder}/in")
        conversation.land_resolved(arriving, index, Y.gram_index(index), folder, availableNow=True).awaitTermination()
        conversation.answer_resolved(spark, policies, folder, "July 1, 2026", availableNow=True).awaitTermination()
    told = D.converse(Y.find_hospitals(df.withColumn("name", F.trim("text")), index).drop("name"))
    some = ["sender", "at", "step", "session", "reply", "lang"]
    read = lambda kind: spark.read.parquet(f"{folder}/{kind}").drop("batch")
    same = lambda a, b: sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
    assert read("replies").count() == len(rows) and same(read("replies").select(some), told.select(some))
    plans, letters = D.plan_replies(told, policies), D.letter_replies(told, policies, "July 1, 2026")
    assert plans.count() and letters.count()
    assert same(read("plans").select(plans.columns), plans) and same(read("letters").select(letters.columns), letters)
    assert "Oregon" in letters.first().letter or "ORS" in letters.first().letter


def _snapshot(spark, keys, date="d"):
    return spark.createDataFrame([(k, k, ("u", date), ("u", "d"), None) for k in keys], refresh.SNAPSHOT)


def test_refresh_guards_and_adoption(spark, tmp_path):
    folder, seen = str(tmp_path), []

    def run(batch_id, keys, **kw):
        return refresh.refresh(_snapshot(spark, keys, **kw), folder, batch_id,
                               on_change=lambda df, b: seen.append(sorted(r.key for r in df.collect())))

    keys = [f"k{i:03d}" for i in range(100)]
    assert run(0, keys) == "established"
    assert run(1, keys) == "none"
    assert run(2, keys[:50]) == "degenerate"
    assert run(3, keys + ["new"]) == "proceed"
    assert run(4, keys + ["new"], date="d2") == "cap"
    assert run(5, keys + ["new"]) == "none"
    assert seen == [["new"]]
    assert refresh.baseline_table(spark, folder).read().count() == 101
    assert run(6, keys[1:] + ["newer"]) == "proceed"
    assert run(6, keys[1:] + ["newer"]) == "proceed"        # a replayed batch decides and leaves the same
    left = {r.key: r.charity_care.effective_date for r in refresh.baseline_table(spark, folder).read().collect()}
    assert set(left) == {*keys[1:], "newer"} and set(left.values()) == {"d"}


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), "key string, v int", buckets=8)
    table.merge(spark.createDataFrame([(f"k{i}", i) for i in range(200)], "key string, v int"))
    files = lambda: {p.relative_to(tmp_path): p.stat().st_mtime_ns for p in tmp_path.glob("t/rows/bucket=*/part-*.parquet")}
    before = files()
    touched = table.merge(spark.createDataFrame([("k3", -3), ("fresh", 1)], "key string, v int"),
                          spark.createDataFrame([("k5",)], "key string"))
    assert len(before) == 8 and 1 <= len(touched) <= 3
    changed = {str(p) for p in set(before) ^ set(files())}
    assert {int(p.split("bucket=")[1].split("/")[0]) for p in changed} == set(touched)
    want = {f"k{i}": i for i in range(200) if i != 5} | {"k3": -3, "fresh": 1}
    assert {r.key: r.v for r in table.read().collect()} == want
    gone = spark.createDataFrame([(k,) for k in want], "key string")
    table.merge(spark.createDataFrame([], "key string, v int"), gone)      # every bucket loses all its rows
    assert table.read().collect() == []


def test_observed_counts(spark):
    cur = _snapshot(spark, [f"k{i}" for i in range(50)], date="d2")
    base = _snapshot(spark, [f"k{i}" for i in range(20, 90)], date="d2").unionByName(_snapshot(spark, ["x"]))
    found, counts = snapshots.observed_diff(cur, base)
    rows = found.collect()
    metrics = snapshots.guard_metrics(snapshots.diff(cur, base), cur, base).first()
    assert snapshots.observed_metrics(counts) == tuple(metrics) and len(rows) == metrics.n + metrics.removed


def test_refresh_keeps_no_copy_of_a_snapshot(spark, tmp_path):
    folder, names = str(tmp_path), lambda: {p.name for p in tmp_path.iterdir()}
    first = _snapshot(spark, [f"k{i:03d}" for i in range(100)])
    assert refresh.refresh(first, folder, 0) == "established"
    assert names() == {"baseline"} and {p.name for p in (tmp_path / "baseline").iterdir()} == {"rows"}
    repeated = _snapshot(spark, ["k001", "new"], date="d2").unionByName(_snapshot(spark, ["k001", "new"], date="d1"))
    assert refresh.refresh(first.filter("key <> 'k001' AND key <> 'k002'").unionByName(repeated), folder, 1) == "proceed"
    assert names() == {"baseline", "changes", "metrics"}
    left = {r.key: r.charity_care.effective_date for r in refresh.baseline_table(spark, folder).read().collect()}
    assert left == {f"k{i:03d}": "d" for i in range(100) if i != 2} | {"k001": "d2", "new": "d2"}
