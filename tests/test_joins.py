"""As-of joins, proximity as rows, sketches."""

import bisect
import random
import time

from pyspark.sql import functions as F

from rulegrain.functions import evidence as T
from rulegrain.operators import dedup
from rulegrain.operators import proximity as P
from rulegrain.operators.asof import as_of


def test_as_of_against_a_search(spark):
    rng = random.Random(1)
    versions = [(rng.choice(["a", "b", None]), rng.choice([None, *range(0, 400, 7)]), i) for i in range(120)]
    # one date holds a third of the rows
    rows = [(i, rng.choice(["a", "a", "b", "c", None]), rng.choice([70, None, *rng.sample(range(-20, 450), 2)])) for i in range(3000)]
    v = spark.createDataFrame(versions, "kind string, since int, n int").repartition(3)
    r = spark.createDataFrame(rows, "id int, kind string, day int").repartition(5)
    got = {x.id: x.n for x in as_of(r, v, "day", "since", ["kind"], "v").select("id", "v.n").collect()}
    known = {k: sorted((s, n) for kind, s, n in versions if kind == k and s is not None) for k in "abc"}

    def find(kind, day):
        at = bisect.bisect_right(known.get(kind, []), (day, 1 << 40)) if day is not None and kind is not None else 0
        return known[kind][at - 1][1] if at else None
    assert got == {i: find(kind, day) for i, kind, day in rows} and len(got) == 3000


def test_as_of_without_groups_or_versions(spark):
    r = spark.createDataFrame([(1, 5), (2, None)], "id int, day int")
    v = spark.createDataFrame([(3, "x"), (5, "y"), (5, "z")], "since int, name string")
    assert {x.id: x.v and x.v.name for x in as_of(r, v, "day", "since", out="v").collect()} == {1: "z", 2: None}
    assert [x.v for x in as_of(r, v.limit(0), "day", "since", out="v").collect()] == [None, None]


def test_rows_ground_as_texts_do(spark):
    rng = random.Random(4)
    parts = ["200%", "75 percent", "FPL", "federal poverty", "x" * 30, "lorem ipsum"]
    texts = [(i, " ".join(rng.choice(parts) for _ in range(rng.randrange(1, 60)))) for i in range(60)]
    df = spark.createDataFrame(texts, "doc int, text string")
    for window in (0, 10, 40, 600):
        claims = df.select("doc", F.explode(F.array(F.lit(200.0), F.lit(75.0), F.lit(1.0))).alias("value")).withColumn("label", F.lit("l"))
        got = P.ground_exploded(claims, P.mention_rows(df, "doc"), P.marker_rows(df, "doc"), "doc", window)
        inside = df.select("doc", F.explode(F.transform(F.array(F.lit(200.0), F.lit(75.0), F.lit(1.0)), lambda v: F.struct(
            v.alias("value"), T.is_grounded(v, T.percent_mentions(F.col("text")), T.marker_spans(F.col("text")), F.lit(window)).alias("ok")))).alias("g"))
        assert {(r.doc, r.value): r.grounded for r in got.collect()} == {(r.doc, r.g.value): r.g.ok for r in inside.collect()}


def test_a_text_of_many_mentions_and_markers(spark):
    """A hundred thousand of either: pairs are those of neighbouring bins, not all ten milliards."""
    places = spark.range(100_000)
    mentions = places.select(F.lit(1).alias("doc"), (F.col("id") % 500).cast("double").alias("value"), (F.col("id") * 24).cast("int").alias("start"))
    markers = places.select(F.lit(1).alias("doc"), (F.col("id") * 24 + 12).cast("int").alias("start"), (F.col("id") * 24 + 15).cast("int").alias("end"))
    claims = spark.range(1000).select(F.lit(1).alias("doc"), F.lit("l").alias("label"), F.col("id").cast("double").alias("value"))
    began = time.perf_counter()
    rows = P.ground_exploded(claims, mentions, markers, "doc").collect()
    assert sum(r.grounded for r in rows) == 500 and time.perf_counter() - began < 60


def test_sketches_of_batches_are_merged(spark):
    hashed = spark.range(60_000).select((F.col("id") % 5).alias("batch"), F.lit("g").alias("kind"),
                                        F.sha2((F.col("id") % 20_000).cast("string"), 256).alias("source_sha256"))
    stored = dedup.content_sketches(hashed, ["batch", "kind"])
    assert stored.count() == 5
    assert abs(dedup.distinct_contents(stored, ["kind"]).first().contents - 20_000) <= 400
