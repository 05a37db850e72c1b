import random
import re

import pytest
from pyspark.sql import functions as F

from rulegrain.operators import catalog as C
from rulegrain.operators import directory as Y
from rulegrain.operators.ranking import number_rows, number_within


# (row, name, city, id) -> slug, and whether the row is the last to use it
SLUGS = [
    ((1, "Oak Clinic", "Bend", "7"), "oak-clinic", False),      # overwritten by row 9
    ((2, "Oak Clinic", "Bend", "8"), "oak-clinic-bend", True),
    ((3, "Oak Clinic", "Bend", "9"), "oak-clinic-9", True),     # base and city form are taken
    ((4, "Oak Clinic Bend", "Rye", None), "oak-clinic-bend-rye", True),  # its base is row 2's city form
    ((5, "Oak Clinic Bend", "Rye", "5"), "oak-clinic-bend-5", True),
    ((6, "Elm & Sons", None, None), "elm-sons", True),
    ((7, "elm sons", "", "x"), "elm-sons-x", True),             # without a city the city form is the base
    ((8, "Oak", "Clinic", "1"), "oak", True),
    ((9, "Oak", "Clinic", "clinic"), "oak-clinic", True),       # ends on an id form that row 1 uses
    ((10, "Fir", "A", "1"), "fir", True),
    ((11, "Fir", "A", "2"), "fir-a", True),
    ((12, "Fir A", "B", "3"), "fir-a-b", True),                 # each displaces the next
    ((13, "Fir A B", "C", "4"), "fir-a-b-c", True),
    ((14, "Fir A B C", "D", "5"), "fir-a-b-c-d", True),
    ((15, "Fir A B C D", "E", "6"), "fir-a-b-c-d-e", True),
]


def test_slugs(spark):
    df = spark.createDataFrame([row for row, _, _ in SLUGS], "pos long, hospital string, city string, oshpdid string")
    got = {r.pos: (r.slug, r.owner) for r in Y.assign_slugs(df).collect()}
    assert got == {row[0]: (slug, owner) for row, slug, owner in SLUGS}


def plain_slugs(rows):
    slug = lambda x: re.sub("[^a-z0-9]+", "-", (x or "").lower()).strip("-")
    used, owner = set(), {}
    out = {}
    for pos, name, city, ident in sorted(rows):
        base = slug(name)
        form = next((f for f in (base, slug(f"{name or ''}-{city or ''}")) if f not in used), f"{base}-{ident or ''}")
        used.add(form)
        owner[form] = pos
        out[pos] = form
    return {pos: (form, owner[form] == pos) for pos, form in out.items()}


@pytest.mark.parametrize("seed,hot", [(1, 0.0), (2, 0.3), (3, 0.6), (4, 0.0)])
def test_slugs_against_one_pass(spark, seed, hot):
    rng = random.Random(seed)
    words = ["oak", "elm", "fir"] if seed != 4 else ["oak", "elm", "", "-"]
    rows = [(i, "oak" if rng.random() < hot else "-".join(rng.choice(words) for _ in range(rng.randrange(1, 4))),
             rng.choice(["oak", "elm", "fir", "fir elm", "", None]), rng.choice(["1", "2", "oak", "elm-fir", None])) for i in range(400)]
    df = spark.createDataFrame(rows, "pos long, hospital string, city string, oshpdid string").repartition(5)
    assert {r.pos: (r.slug, r.owner) for r in Y.assign_slugs(df).collect()} == plain_slugs(rows)


def test_a_chain_of_displacements_takes_no_more_jobs(spark):
    def run(n):
        rows = [(0, "w", "c0", "i")] + [(i + 1, "-".join(["w", *(f"c{k}" for k in range(i))][:i + 1]), f"c{i}", str(i)) for i in range(n)]
        tracker, group = spark.sparkContext.statusTracker(), f"slugs-{n}"
        spark.sparkContext.setJobGroup(group, group)
        got = {r.pos: (r.slug, r.owner) for r in Y.assign_slugs(spark.createDataFrame(
            rows, "pos long, hospital string, city string, oshpdid string")).collect()}
        jobs = len(tracker.getJobIdsForGroup(group))
        spark.sparkContext.setJobGroup("other", "other")
        assert got == plain_slugs(rows)
        return jobs
    assert abs(run(40) - run(400)) <= 3      # the optimizer may merge a stage


# hospitals in order, and which one a request names
PLACES = [(1, "Harbor Medical Center", "Fresno"), (2, "Twin Hospital", "Fresno"), (3, "Twin Hospital", "Eureka"),
          (4, "St. Mary Medical", None), (5, "Harbor Medical", "Ukiah"), (6, "Twin Hospital", None)]
REQUESTS = [("harbor medical center", 1), ("HARBOR MEDICAL", 5), ("twin hospital", 2), ("Twin Hospital (Eureka)", 3),
            ("medical", 1), ("  mary ", 4), ("win hospital (e", 3), ("hosp", 2), ("abc", None), ("", None), ("x", None),
            ("nowhere at all", None)]


def test_lookup(spark):
    df = spark.createDataFrame(PLACES, "pos long, hospital string, city string")
    req = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(REQUESTS)], "id int, name string")
    got = {r.id: r.target for r in Y.find_hospitals(req, Y.name_index(df)).collect()}
    assert got == {i: target for i, (_, target) in enumerate(REQUESTS)}
    kept = Y.gram_index(Y.name_index(df)).collect()
    assert {r.key for r in kept if r.gram == "MARY"} == {"ST. MARY MEDICAL"} and max(len(r.gram) for r in kept) == 4


def test_lookup_against_a_scan(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("aab c") for _ in range(rng.randrange(1, 14)))
    names = [word().strip() or "x" for _ in range(300)]
    index = spark.createDataFrame([(n.upper(), i, i) for i, n in enumerate(dict.fromkeys(names))], "key string, ord long, target long")
    keys = [(r.key, r.target) for r in index.collect()]
    asked = [word() for _ in range(400)] + ["", None, "a" * 5000]
    got = {r.id: r.target for r in Y.find_hospitals(spark.createDataFrame(list(enumerate(asked)), "id int, name string"), index).collect()}

    def scan(name):
        exact = [t for k, t in keys if name is not None and k == name.upper()]
        needle = (name or "").upper().strip(" ")
        return exact[0] if exact else next((t for k, t in keys if len(needle) >= 4 and needle in k), None)
    assert got == {i: scan(name) for i, name in enumerate(asked)}


def test_lookup_prefers_the_id(spark):
    df = spark.createDataFrame([(1, "A hospital", "x"), (2, "B hospital", "x")], "pos long, hospital string, city string")
    req = spark.createDataFrame([(1, "A hospital", "9"), (2, "A hospital", "none")], "id int, name string, oshpdid string")
    ids = spark.createDataFrame([("9", 2)], "oshpdid string, target long")
    got = {r.id: r.target for r in Y.find_hospitals(req, Y.name_index(df), ids).collect()}
    assert got == {1: 2, 2: 1}


def test_nearby_peers(spark):
    df = spark.range(30).select(F.col("id").alias("pos"), F.lit("K").alias("county"),
                                F.format_string("s%02d", "id").alias("slug"))
    got = {r.slug: r.peers for r in Y.nearby_peers(df).collect()}
    assert got["s00"] == [f"s{i:02d}" for i in range(1, 11)]
    assert got["s29"] == [f"s{i:02d}" for i in range(10)]
    twins = df.withColumn("slug", F.when(F.col("pos") < 2, "s00").otherwise(F.col("slug")))
    assert {len(r.peers) for r in Y.nearby_peers(twins).collect()} == {10}


def test_numbering(spark):
    rng = random.Random(1)
    values = [(rng.choice(["hot", "hot", "cold", None]), i) for i in range(500)]
    rng.shuffle(values)
    df = spark.createDataFrame(values, "g string, i int").repartition(5)
    flat = number_rows(df, ["i"], "n").collect()
    assert sorted((r.i, r.n) for r in flat) == [(i, i + 1) for i in range(500)]
    within = number_within(df, ["g"], ["i"], "n").collect()
    for g in ("hot", "cold", None):
        mine = sorted(r.i for r in within if r.g == g)
        assert [(r.i, r.n) for r in sorted((r for r in within if r.g == g), key=lambda r: r.i)] == [
            (i, n) for n, i in enumerate(mine, 1)]


CATALOG = [("en", "a", "k", "english {x}"), ("es", "a", "k", "spanish {x}"), ("en", "b", "k", "later {x}"),
           ("en", "a", "only", "only en"), ("es", "a", "blank", ""), ("en", "a", "blank", "filled")]
SCHEMA = "lang string, section string, key string, template string"


def test_catalog_fallback_and_overlay(spark):
    catalog = spark.createDataFrame(CATALOG, SCHEMA)
    merged = C.overlay(catalog, ["a", "b"])
    want = spark.createDataFrame([("es", "k"), ("fr", "k"), ("es", "only"), ("es", "blank"), ("es", "none")], "lang string, key string")
    got = {(r.lang, r.key): r.template for r in C.resolve(want, merged).collect()}
    assert got == {("es", "k"): "spanish {x}", ("fr", "k"): "later {x}", ("es", "only"): "only en",
                   ("es", "blank"): "filled", ("es", "none"): None}


def test_gaps_and_drift(spark):
    catalog = spark.createDataFrame(CATALOG, SCHEMA)
    allowed = spark.createDataFrame([("b", "k")], "section string, key string")
    assert {(r.lang, r.section, r.key) for r in C.key_gaps(catalog, allowed).collect()} == {("es", "a", "only")}
    pairs = spark.createDataFrame([
        ("es", "We send {x} to RulesEngine <b>now</b>", "Enviamos {x} a RulesEngine <b>ya</b>"),
        ("es", "We send {x} to RulesEngine", "Enviamos {y} al motor de calculo"),
        ("zh", "a long english sentence", "短句短句短句"), ("es", "a long english sentence", "corta")],
        "lang string, en string, template string")
    got = [r.problems for r in C.drift(pairs, ["RulesEngine"]).collect()]
    assert got == [[], ["token RulesEngine", "fields"], [], ["length"]]
