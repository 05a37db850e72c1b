import json

import pytest
from pyspark.sql import functions as F

from rulegrain import reference_values as V
from rulegrain import rules as R
from rulegrain import schemas
from rulegrain.operators import eligibility as E
from rulegrain.operators import ingest as I
from rulegrain.sources import readers, sinks


def test_json_array_with_dollar_keys(spark, tmp_path):
    path = tmp_path / "rows.json"
    path.write_text(json.dumps([
        {"hospital": "A", "status": "extracted", "free_care_income_ceiling_by_household": {"1": 10, "2": 20},
         "policy": {"free_care": {"fpl_ceiling_pct": 200}, "source_quotes": {"a": "b"}}},
        {"hospital": "B", "status": "needs_ocr", "policy": None}], indent=2))
    rows = {r.hospital: r for r in readers.read_records(spark, str(path), schemas.EXTRACTED_ROW).collect()}
    assert rows["A"].free_care_income_ceiling_by_household == {1: 10, 2: 20}
    assert rows["A"].policy.free_care.fpl_ceiling_pct == 200.0
    assert json.loads(rows["A"].policy.source_quotes) == {"a": "b"}
    assert rows["B"].policy is None


@pytest.mark.parametrize("indent", [1, 2, 4])
def test_indented_arrays_are_cut_where_records_close(spark, tmp_path, indent):
    rows = [{"hospital": f"H{i}\n}},", "policy": {"free_care": {"fpl_ceiling_pct": i}, "contact": {"notes": "[]},\n  },"}},
             "review_reasons": ["]", "}"]} for i in range(200)]
    for n in (0, 1, 200):
        (tmp_path / f"{n}.json").write_text(json.dumps(rows[:n], indent=indent))
        records, broken = readers.read_checked(spark, str(tmp_path / f"{n}.json"), schemas.EXTRACTED_ROW, indent=indent)
        assert sorted(r.policy.free_care.fpl_ceiling_pct for r in records.collect()) == list(range(n)) and broken.count() == 0
        assert {r.hospital for r in records.collect()} == {r["hospital"] for r in rows[:n]}


def test_broken_lines_come_out_beside(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"hospital": "A"}\n\n{"hospital": "B", \n  \nnot json\n{"hospital": null}\n')
    records, broken = readers.read_checked(spark, str(tmp_path / "a.jsonl"), schemas.EXTRACTED_ROW)
    assert [r.hospital for r in records.collect()] == ["A", None]
    assert {r.corrupt for r in broken.collect()} == {'{"hospital": "B", ', "not json"}


def test_roster_csv_with_byte_order_mark(spark, tmp_path):
    path = tmp_path / "roster.csv"
    header = ("Facility ID,Facility Name,Address,City/Town,State,ZIP Code,County/Parish,Telephone Number,"
              "Hospital Type,Hospital Ownership\n")
    path.write_bytes(b"\xef\xbb\xbf" + (header +
        "060001,St. Mary's,1 St,Denver,CO,80000,EL PASO,(555) 010-0000,Critical Access Hospitals,Proprietary\n"
        "060002,Vets,1 St,Denver,CO,80000,,,,Veterans Health Administration\n"
        "060003, ,1 St,Denver,CO,80000,,,,Proprietary\n"
        "060004,Else,1 St,Reno,NV,80000,,,,Proprietary\n").encode())
    raw = readers.read_roster_csv(spark, str(path))
    rows = I.normalize_roster(I.roster_filter(raw, "co"), F.lit("CO")).collect()
    assert [r.asDict() for r in rows] == [{
        "hospital": "ST. MARY'S", "ccn": "060001", "city": "DENVER", "county": "El Paso", "zip": "80000",
        "state": "CO", "phone": "(555) 010-0000", "ownership": "Proprietary",
        "hospital_type": "Critical Access Hospitals", "status": "statutory"}]


def test_first_available(spark, tmp_path):
    (tmp_path / "b.json").write_text("[]")
    assert readers.first_available(spark, [str(tmp_path / "a.json"), str(tmp_path / "b.json")]).endswith("b.json")


def test_binary_documents(spark, tmp_path):
    (tmp_path / "abc-1.pdf").write_bytes(b"text of it")
    texts = I.text_of_binary(readers.binary_documents(spark, str(tmp_path)), F.decode("content", "UTF-8"))
    assert [(r.guid, r.text) for r in texts.collect()] == [("abc-1", "text of it")]


def test_cache_and_report(spark, tmp_path):
    cache = sinks.ResultCache(spark, str(tmp_path / "cache"), "source_sha256 string, policy string")
    assert cache.read().count() == 0
    cache.append(spark.createDataFrame([("a", "1"), ("b", "2")], cache.schema))
    cache.append(spark.createDataFrame([("a", "later")], cache.schema))
    assert {tuple(r) for r in cache.read().collect()} == {("a", "later"), ("b", "2")}
    sinks.write_text_report(spark.createDataFrame([(2, "two"), (1, "one")], "n int, line string"),
                            str(tmp_path / "report"), ["n"])
    lines = [line for f in sorted((tmp_path / "report").glob("part-*")) for line in f.read_text().splitlines()]
    assert lines == ["one", "two"]


def _python_tier(rule, rural, ccn, pct):
    free, disc = rule.get("free_pct"), rule.get("discount_pct")
    if rural:
        free, disc = rule.get("free_rural_pct") or free, rule.get("discount_rural_pct") or disc
    if rule["code"] == "WA" and ccn in V.UPPER_TIER_CCNS:
        free, disc = 300, 400
    if free is not None and pct <= free:
        return "free"
    return "discount" if disc is not None and pct <= disc else "over"


def test_every_state_at_its_boundaries(spark):
    cases = [(rule["code"], kind, ccn, edge + step)
             for rule in V.RULES for kind in (V.RURAL_TYPE, "Acute") for ccn in ("500015", "1")
             for edge in (100, 125, 150, 200, 250, 300, 400, 600) for step in (-0.1, 0.0, 0.1)]
    df = spark.createDataFrame(cases, "state string, hospital_type string, ccn string, fpl_pct double")
    got = E.with_statutory_bands(df).withColumn("t", E.band_tier(
        F.col("fpl_pct"), F.col("free_band"), F.col("discount_band")))
    rules = {r["code"]: r for r in V.RULES}
    for r in got.collect():
        want = _python_tier(rules[r.state], r.hospital_type == V.RURAL_TYPE, r.ccn, r.fpl_pct)
        assert r.t == want, r


def test_rules_lookup(spark):
    df = spark.createDataFrame([(None,), ("",), ("il",), ("TX",), ("CA",)], "state string")
    assert [r.c for r in R.with_rules(df).select(F.col("rules.code").alias("c")).collect()] == [
        "CA", "CA", "IL", "US", "CA"]


def test_program_currency(spark):
    table = R.rules_table(spark, {"NC": {"program_suspended": True}, "IL": {"is_program": True}})
    got = {r.code: (r.currency, r.days_left, r.problem)
           for r in E.program_currency(table, F.lit("2026-07-01").cast("date")).collect()}
    assert got == {"NC": ("SUSPENDED", None, True), "IL": ("UNTRACKED", None, False)}
    days = {"2026-05-01": "OK", "2026-05-16": "WARN", "2026-06-30": "WARN", "2026-07-01": "STALE"}
    for today, status in days.items():
        row = E.program_currency(R.rules_table(spark), F.lit(today).cast("date")).first()
        assert row.currency == status


def test_search_hits_and_results(spark):
    body = json.dumps({"hits": {"hits": [{"_source": {"post_title": "A", "permalink": "p", "meta": {
        "hfbp_city": [{"value": "X"}], "hfbp_zip": []}}}]}})
    row = I.flatten_search_hits(spark.createDataFrame([(body,)], "body string")).first()
    assert tuple(row) == ("A", "p", "X", None, None)
    lines = ['{"custom_id":"c0","result":{"type":"succeeded","message":{"content":[{"type":"text"},{"type":"tool_use","input":{"a":1}}]}}}',
             '{"custom_id":"c1","result":{"type":"succeeded","message":{"content":[]}}}',
             '{"custom_id":"c2","result":{"type":"errored","error":{"m":"' + "x" * 300 + '"}}}', "  ",
             '{"custom_id":"zz","result":{"type":"expired"}}']
    ids = spark.createDataFrame([(f"c{i}", f"s{i}") for i in range(3)], "custom_id string, source_sha256 string")
    got = {r.source_sha256: (r.policy, r.error) for r in I.read_results(
        spark.createDataFrame([(x,) for x in lines], "value string"), ids).collect()}
    assert got["s0"] == ('{"a":1}', None) and got["s1"] == (None, "no tool_use block")
    assert got["s2"][1].startswith('batch_errored: {"m":"xxx') and len(got["s2"][1]) == 15 + 200


def test_parse_rules(spark):
    texts = ["Full Charity is given at 200% of the Federal Poverty Level\nup to 350% FPL",
             "At or below 150% of FPL", "FPL limit 90% or less", "nothing here 20% FPL",
             "free care at 999% FPL\ncharity care 250% FPL", "300% or less\nof the federal poverty level"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = [(r.free_care_fpl_pct, r.discount_max_fpl_pct, r.confidence)
           for r in I.parse_rules(df).orderBy("i").collect()]
    assert got == [(200, 350, "high"), (150, 150, "high"), (90, None, "medium"), (None, None, "low"),
                   (250, 250, "high"), (None, None, "low")]
