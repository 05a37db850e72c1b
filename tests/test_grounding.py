import random
import re

import pytest
from pyspark.sql import functions as F

from rulegrain import reference_values as V
from rulegrain.functions import evidence as T
from rulegrain.operators import grounding as G

MARK, PCT = re.compile(V.POVERTY_WORDING, re.I), re.compile(V.PERCENT_VALUE, re.I)


def python_ground(value, text, window):
    """Brute force over every mention and marker."""
    marks = [(m.start(), m.end()) for m in MARK.finditer(text)]
    for m in PCT.finditer(text):
        if float(m.group(1)) != value:
            continue
        for a, b in marks:
            if min(abs(m.start() - b), abs(a - m.start())) <= window or a <= m.start() <= b:
                lo, hi = max(0, min(m.start(), a) - 60), min(len(text), max(m.start(), b) + 60)
                return True, " ".join(text[lo:hi].split())
    return False, None


def random_text(rng):
    words = ["FPL", "fpg", "federal  poverty", "poverty\nlevel", "200%", "200.5 percent", "350 per cent",
             "200", "1200%", "lorem", "ipsúm", "ñandú", "xFPLx", "poverty guidelines", "25 %"]
    return " ".join(rng.choice(words) if rng.random() < .4 else "x" * rng.randint(1, 30)
                    for _ in range(rng.randint(0, 60)))


def test_random_texts_against_brute_force(spark):
    rng = random.Random(7)
    rows = [(i, random_text(rng), rng.choice([200.0, 200.5, 350.0, 25.0]), rng.choice([5, 40, 120]))
            for i in range(300)]
    df = spark.createDataFrame(rows, "id int, corpus string, value double, w int")
    made = G.with_mentions(df).withColumn("g", T.grounding_of(
        F.col("value"), F.col("corpus"), F.col("_mentions"), F.col("_markers"), F.col("w")))
    got = {r.id: (r.g.grounded, r.g.evidence) for r in made.collect()}
    assert got == {i: python_ground(v, t, w) for i, t, v, w in rows}


def test_spans_match_python(spark):
    rng = random.Random(8)
    rows = [(i, random_text(rng)) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, t string")
    got = {r.id: [(s.start, s.end) for s in r.s]
           for r in df.select("id", T.marker_spans(F.col("t")).alias("s")).collect()}
    assert got == {i: [m.span() for m in MARK.finditer(t)] for i, t in rows}


ENGLISH = "The hospital offers care for the patient and the income of the family. " * 20
SPANISH = "Los pacientes y las familias con bajos ingresos para la atención de el hospital. " * 20
GARBLE = "456578ÿ ÿ4565ÿÿ ÿ !65ÿ##$% " * 60
CLAIM = [("free_care.fpl_ceiling_pct", 200.0)]
EDGE = CLAIM + [("discount_payment.tiers[0].fpl_high_pct", 333.0)]
STATED = ENGLISH + " up to 200% of the Federal Poverty Level."


@pytest.mark.parametrize("corpus,claims,sha,channel,verdict", [
    (None, CLAIM, None, None, "unverifiable"),
    ("short", CLAIM, None, None, "unverifiable"),
    ("short", CLAIM, None, "pdf_ocr", "ocr_extracted"),
    (GARBLE, CLAIM, None, "pdf_ocr", "ocr_extracted"),
    (GARBLE, CLAIM, None, None, "unreadable_source"),
    (STATED, CLAIM, "0" * 64, None, "stale_source"),
    (STATED, CLAIM, "", None, "grounded"),
    (STATED, [], None, None, "unverifiable"),
    (STATED, CLAIM, None, "pdf_ocr", "grounded"),
    (STATED, EDGE, None, None, "tier_edges_ungrounded"),
    (ENGLISH, CLAIM, None, None, "ungrounded"),
    (SPANISH + " 200 por ciento FPL 200 %", CLAIM, None, None, "grounded"),
    (ENGLISH + " FPL" + " x" * 400 + " 200%", CLAIM, None, None, "ungrounded"),
])
def test_verdict_order(spark, corpus, claims, sha, channel, verdict):
    df = spark.createDataFrame([(corpus, claims, sha, channel)],
                               f"corpus string, claims {G.CLAIMS}, source_sha256 string, extraction_channel string")
    got = G.annotate(G.verdicts(df), "2026-08-03").first()
    assert got.verdict == verdict
    assert got.last_verified_at == ("2026-08-03" if verdict == "grounded" else None)


def test_intelligible(spark):
    df = spark.createDataFrame([(ENGLISH,), (SPANISH,), (GARBLE,), ("",), (None,)], "t string")
    assert [r.o for r in df.select(T.intelligible(F.col("t")).alias("o")).collect()] == [
        True, True, False, False, False]
