import json

import pandas as pd
from pyspark.sql import functions as F

from rulegrain import schemas
from rulegrain.operators import catalog as C
from rulegrain.plans import flows
from rulegrain.sources import readers, sinks

WORDS = "The hospital offers care for the patient and the income of the family. " * 10
RESULT = "source_sha256 string, policy string, error string"


def _extractor(frames):
    for frame in frames:
        rows = []
        for sha, text in zip(frame["source_sha256"], frame["text"]):
            policy = {"free_care": {"fpl_ceiling_pct": 200}, "discount_payment": {
                "fpl_ceiling_pct": 400, "tiers": []}, "extraction_confidence": 0.9,
                "contact": {"phone": "1"}}
            rows.append((sha, None, "model refused") if "BROKEN" in text else (sha, json.dumps(policy), None))
        yield pd.DataFrame(rows, columns=["source_sha256", "policy", "error"])


def _records(spark):
    def section(url):
        return {"current_policy_url": url, "current_effective_date": "01/02/2020", "application_url": "https://a"}
    data = [("A", "pa", {"charity_care": section("x?id=g1"), "discount_payment": section("x?id=g1")}),
            ("B", "pb", {"charity_care": section("y?id=g1"), "discount_payment": section("x?id=g1")}),
            ("C", "pc", {"charity_care": section("x?id=g2")}), ("D", "pd", {"charity_care": section("x?id=g3")}),
            ("E", "pe", {"charity_care": section("x?id=g1"), "discount_payment": section("x?id=g2")})]
    names = schemas.SOURCE_RECORD.names
    return spark.createDataFrame([tuple({"post_title": t, "permalink": p, "policies": s}.get(n) for n in names)
                                  for t, p, s in data], schemas.SOURCE_RECORD)


def stored(df, tmp_path, version):
    """Stages hand over written datasets, as a scheduled job would."""
    path = sinks.write_dataset(df, str(tmp_path / "dataset"), version)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def test_extract_then_ground_then_score(spark, tmp_path):
    texts = spark.createDataFrame([("g1", WORDS + " up to 200% of FPL and 400% FPL"), ("g2", "short"),
                                   ("g3", WORDS + " BROKEN")], "guid string, text string")
    cache = sinks.ResultCache(spark, str(tmp_path / "cache"), RESULT)
    args = (cache, _extractor, RESULT, "m", "2026-08-03", "2026-08-03")
    rows = stored(flows.extract_dataset(_records(spark), texts, *args), tmp_path, "1")
    got = {r.hospital: (r.status, r.needs_review, r.review_reasons) for r in rows.collect()}
    assert got["A"] == got["B"] == got["E"] == ("extracted", False, [])
    assert got["C"][0] == "needs_ocr" and got["D"] == ("extraction_error", True, ["model refused"])
    assert cache.read().count() == 3            # A and B share a corpus, C has none
    flows.extract_dataset(_records(spark), texts, *args).count()
    assert spark.read.parquet(str(tmp_path / "cache")).count() == 3     # nothing is extracted twice

    corpora = rows.select("permalink").withColumn("text", F.lit("===== CHARITY_CARE POLICY =====\n" + WORDS
                                                                + " up to 200% of FPL and 400% FPL"))
    usable = rows.filter("status = 'extracted'").withColumn("extraction_channel", F.lit(None).cast("string"))
    grounded = stored(flows.ground_dataset(usable, corpora, "2026-08-03"), tmp_path, "2")
    verdicts = {r.hospital: (r.grounding.verdict, r.last_verified_at) for r in grounded.collect()}
    assert verdicts == {"A": ("grounded", "2026-08-03"), "B": ("grounded", "2026-08-03"),
                        "E": ("stale_source", None)}

    served = grounded.withColumn("pos", F.ascii("hospital").cast("long"))
    asked = spark.createDataFrame([
        (1, "a", None, "1", "20000", "uninsured", "Ana B", True, False),
        (2, "nowhere", None, "2", "", "", "", False, True), (3, "nowhere", None, "2", "", "", "", False, False),
        (4, "A", None, "many", "1", "", "", False, False), (5, "E", None, "1", "20000", "", "", False, False)],
        "id int, name string, oshpdid string, household string, income string, insurance string, "
        "full_name string, in_collections boolean, generic boolean")
    plans, errors = flows.score_requests(asked, served)
    made = {r.id: json.loads(r.plan) for r in plans.collect()}
    assert made[1]["tier"] == "free" and made[1]["charity"]["income_ceiling"] == 31920
    assert made[1]["closing_step"] == 4 and len(made[1]["debt"]) == 4
    assert made[2]["not_in_directory"] and made[2]["charity"]["message"] == "cc_no_hospital"
    assert made[5]["tier"] == "unknown"         # its source contradicts the number
    assert {r.id: r.error for r in errors.collect()} == {
        3: "hospital not found", 4: "income and household must be numbers"}


def test_catalog_files_and_rendering(spark, tmp_path):
    (tmp_path / "en.json").write_text(json.dumps({"plan": {"a": "At ~{pct:.0f}% of {law}.", "b": "Up to {cap}."}}))
    (tmp_path / "es.json").write_text(json.dumps({"plan": {"a": "A ~{pct:.0f}% de {law}.", "b": ""}}))
    catalog = readers.read_catalog(spark, str(tmp_path))
    df = spark.createDataFrame([(1, "es", ["a", "b"], 137.6, "X"), (2, "en", ["b"], 1.0, "Y"), (3, "fr", ["a"], 2.0, "Z")],
                               "id int, lang string, keys array<string>, pct double, law string")
    out = C.render(df, ["id"], "keys", catalog, {"pct": F.col("pct"), "law": F.col("law"), "cap": F.lit(5)},
                   numeric=("pct", "cap"))
    assert {r.id: r.text for r in out.collect()} == {1: "A ~138% de X. Up to 5.", 2: "Up to 5.", 3: "At ~2% of Z."}


def test_rendering_fills_in_one_pass_where_a_row_stands(spark):
    catalog = spark.createDataFrame([("en", "a", "{law} at {pct:.0f}% {pct:,} {pct} {open}"), ("en", "b", "b"), ("es", "a", ""), ("es", "b", "{{law}}")],
                                    "lang string, key string, template string")
    df = spark.createDataFrame([(1, "en", ["a", None, "b"], 1137.5, "{pct}"), (2, "es", ["b", "a"], None, "L"), (3, None, ["b", "none"], 1.0, "L"),
                                (4, "en", [], 1.0, "L"), (5, "en", None, 1.0, "L"), (6, "en", [None], 1.0, "L"), (7, "es", ["none"], 1.0, "L")],
                               "id int, lang string, keys array<string>, pct double, law string")
    out = C.render(df, ["id"], "keys", catalog, {"law": F.col("law"), "pct": F.col("pct")}, numeric=("pct",))
    assert {r.id: r.text for r in out.collect()} == {
        1: "{pct} at 1138% 1,137 1137.5 {open} b", 2: "{L} L at None% None None {open}", 3: "b", 7: ""}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan
