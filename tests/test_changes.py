from pyspark.sql import functions as F

from rulegrain.operators import dedup as D
from rulegrain.operators import snapshots as N
from rulegrain.operators import splice as J

SCHEMA = "key string, pos long, status string, amount int"


def rows_of(df, *names):
    return {tuple(r[n] for n in names) for r in df.collect()}


def test_splice_takes_the_last_extracted_duplicate(spark):
    left = spark.createDataFrame([("a", 1, "needs_ocr", 0), ("b", 2, "extracted", 0),
                                  ("c", 3, "needs_ocr", 0)], SCHEMA)
    right = spark.createDataFrame([("a", 1, "extracted", 1), ("a", 2, "extracted", 2),
                                   ("a", 3, "needs_ocr", 3), ("b", 4, "extracted", 4)], SCHEMA)
    assert rows_of(J.splice(left, right), "key", "amount", "spliced") == {
        ("a", 2, True), ("b", 0, False), ("c", 0, False)}


def test_merge_changed_holds_failures(spark):
    served = spark.createDataFrame([("a", 1, "extracted", 1), ("b", 2, "extracted", 1),
                                    ("c", 3, "extracted", 1)], SCHEMA)
    fresh = spark.createDataFrame([("a", 1, "extracted", 9), ("b", 2, "needs_ocr", 0),
                                   ("d", 3, "extracted", 9), ("e", 4, "extraction_error", 0)], SCHEMA)
    assert rows_of(J.merge_changed(served, fresh), "key", "amount", "action") == {
        ("a", 9, "replaced"), ("b", 1, "held"), ("c", 1, "kept"), ("d", 9, "added")}


def test_verify_and_hold(spark):
    served = spark.createDataFrame([("a", 1, "x", 1), ("b", 2, "x", None), ("c", 3, "x", 3)], SCHEMA)
    reread = spark.createDataFrame([("a", 1, "y", 1), ("b", 2, "y", None), ("c", 3, "y", 4)], SCHEMA)
    assert rows_of(J.verify_and_hold(served, reread, ["amount"]), "key", "status", "amount", "action") == {
        ("a", "y", 1, "adopted"), ("b", "y", None, "adopted"), ("c", "x", 3, "held")}
    twice = reread.union(spark.createDataFrame([("a", 9, "z", 5)], SCHEMA))
    assert rows_of(J.verify_and_hold(served, twice, ["amount"]), "key", "status", "amount", "action") == {
        ("a", "x", 1, "held"), ("b", "y", None, "adopted"), ("c", "x", 3, "held")}


SNAP = ("key string, hospital string, charity_care struct<url:string,effective_date:string>, "
        "discount_payment struct<url:string,effective_date:string>, content_sha string")


def test_diff(spark):
    base = spark.createDataFrame([
        ("same", "S", ("u", "d"), ("u", "d"), "x"), ("gone", "G", ("u", "d"), ("u", "d"), None),
        ("date", "D", ("u", "d"), ("u", "d"), "x"), ("silent", "Q", ("u", "d"), ("u", "d"), "x"),
        ("nohash", "N", ("u", "d"), ("u", "d"), None), ("both", "B", ("u", None), ("u", "d"), "x")], SNAP)
    cur = spark.createDataFrame([
        ("same", "S", ("u", "d"), ("u", "d"), "x"), ("new", "W", ("u", "d"), ("u", "d"), None),
        ("date", "D", ("u", "d2"), ("u", "d"), "y"), ("silent", "Q", ("u", "d"), ("u", "d"), "y"),
        ("nohash", "N", ("u", "d"), ("u", "d"), "y"), ("both", "B", ("u2", "d"), ("u3", "d"), "y")], SNAP)
    got = {r.key: (r.change, r.deltas) for r in N.diff(cur, base).collect()}
    assert got == {
        "gone": ("removed", []), "new": ("new", []),
        "date": ("changed", ["charity_care.date d -> d2"]),
        "silent": ("changed", ["content"]),
        "both": ("changed", ["charity_care.date None -> d", "charity_care.url", "discount_payment.url"])}


def test_diff_of_repeated_keys(spark):
    """The last record of a key counts on both sides, wherever the rows stand."""
    schema = SNAP + ", pos int"
    old, new = ("k", "K", ("u", "d"), ("u", "d"), "x"), ("k", "K", ("v", "d"), ("u", "d"), "x")
    base = spark.createDataFrame([(*new, 2), (*old, 1)], schema)
    cur = spark.createDataFrame([(*old, 1), (*new, 3), (*old, 2)], schema)
    assert N.diff(cur, base).count() == 0
    assert [r.deltas for r in N.diff(cur, spark.createDataFrame([(*old, 1)], schema)).collect()] == [["charity_care.url"]]


def test_decisions(spark):
    m = spark.createDataFrame([(0, 0, 100, 100), (5, 0, 100, 100), (41, 0, 100, 100), (5, 16, 100, 100),
                               (5, 0, 94, 100), (5, 0, 10, 0), (50, 16, 100, 100)],
                              "n long, removed long, current long, baseline long")
    assert [(r.decision, r.exit_code) for r in N.decide(m).collect()] == [
        ("none", 0), ("proceed", 0), ("cap", 2), ("degenerate", 2), ("degenerate", 2),
        ("proceed", 0), ("degenerate", 2)]


def test_guard_metrics_of_nothing(spark):
    none = spark.createDataFrame([], SNAP)
    changes = N.diff(none, none)
    assert tuple(N.guard_metrics(changes, none, none).first()) == (0, 0, 0, 0)


def test_content_dedup(spark):
    docs = spark.createDataFrame([(0, "short"), (1, "a" * 500), (2, "b" * 500), (3, "a" * 500)],
                                 "pos long, text string")
    hashed = D.with_content_sha(docs)
    assert rows_of(D.content_groups(hashed), "first_pos", "copies") == {(1, 2), (2, 1)}
    assert rows_of(D.unique_texts(hashed), "pos") == {(1,), (2,)}


def test_first_per_key_of_a_hot_key(spark):
    df = spark.range(10000).select(F.lit("hot").alias("k"), F.col("id").alias("pos"))
    assert D.first_per_key(df, ["k"]).first().pos == 0
    assert D.last_per_key(df, ["k"]).first().pos == 9999
