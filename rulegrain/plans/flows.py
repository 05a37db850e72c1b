"""The three end-to-end flows, as plain compositions of the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulegrain import reference_values as V
from rulegrain.functions import scalars as S
from rulegrain.operators import dedup as D
from rulegrain.operators import directory as Y
from rulegrain.operators import eligibility as E
from rulegrain.operators import grounding as G
from rulegrain.operators import ingest as I
from rulegrain.operators import quality as Q
from rulegrain.operators import splice as J
from rulegrain.schemas import POLICY
from rulegrain.sources.sinks import ResultCache


def extract_dataset(records: DataFrame, texts: DataFrame, cache: ResultCache, extractor,
                    schema: str, model: str, extracted_at: str, today: str,
                    max_chars: int | None = None) -> DataFrame:
    """Source records and document texts -> extracted rows, reviewed, with dollar tables.

    Each distinct corpus is built, hashed and extracted once; results are kept in the cache, so
    a run that stops is resumed where it was.  Runs jobs."""
    signed = I.corpus_signatures(records)
    corpora = I.build_corpora(signed, texts, max_chars)
    hashed = (D.with_content_sha(corpora.withColumnRenamed("corpus", "text"))
              .withColumn("pos", F.col("signature")))
    todo = D.work_list(D.unique_texts(hashed), cache.read())
    cache.append(I.extract_with(todo, extractor, schema))
    located = signed.join(hashed.select("signature", "source_sha256", "truncated"), "signature")
    base = I.provenance(located, model, extracted_at)
    flags = hashed.filter(F.col("source_sha256").isNotNull()).groupBy("source_sha256").agg(
        F.bool_or("truncated").alias("_clipped"))
    results = cache.read().join(flags, "source_sha256").select(
        "source_sha256", F.from_json("policy", POLICY).withField("_truncated", F.col("_clipped"))
        .alias("policy"), "error")
    rows = J.map_results(base, results)
    extracted = F.col("status") == "extracted"
    reviewed = Q.with_review(rows.withColumn("state", F.lit(None).cast("string")),
                             F.lit(today).cast("date"))
    reasons = (F.when(F.col("status") == "needs_ocr",
                      F.array(F.lit("awaits_ocr")))
                .when(F.col("status") == "extraction_error", F.array("error"))
                .otherwise(F.col("review_reasons")))
    return (reviewed.withColumn("review_reasons", reasons)
            .withColumn("needs_review", F.size("review_reasons") > 0)
            .withColumn("free_care_income_ceiling_by_household", F.when(
                extracted, S.dollar_table(F.col(Q.FC))))
            .withColumn("discount_income_ceiling_by_household", F.when(
                extracted, S.dollar_table(F.col(Q.DC)))))


def ground_dataset(rows: DataFrame, corpora: DataFrame, run_date: str) -> DataFrame:
    """Every row's verdict against its source text, written into the row."""
    claimed = G.join_corpora(rows, corpora).withColumn(
        "claims", G.published_thresholds(F.col("policy")))
    return G.annotate(G.verdicts(claimed), run_date).drop("corpus", "claims", "verdict",
                                                         "checked", "has_record")


def _by_law() -> Column:
    """Is the request for a hospital of a state whose law decides, by its certification number?"""
    lawful = [r["code"] for r in V.RULES if r["code"] not in (V.DEFAULT_CODE, V.HOME_CODE)
              and (r.get("free_pct") is not None or r.get("discount_pct") is not None)]
    return F.coalesce(F.col("state").isin(lawful) & (F.col("ccn") != ""), F.lit(False))


def score_requests(requests: DataFrame, rows: DataFrame, pos: str = "pos", request_id: str = "id",
                   roster: DataFrame | None = None, today: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Raw requests -> (plans, rejected): against extracted rows or, for hospitals of states whose law decides,
    against the law.

    `requests`: id, name, oshpdid, household, income, insurance, full_name, in_collections,
    generic — all as sent; with a `roster` also st and sid, its state and certification number.  A
    request that names both goes by the law alone; names never find a statutory hospital."""
    ids = rows.filter(S.blank_to_null(F.col("oshpdid")).isNotNull()).groupBy("oshpdid").agg(
        F.max(pos).alias("target"))
    by_name = requests
    if roster is not None:
        named = requests.withColumn("state", F.upper(F.trim("st"))).withColumn("ccn", F.trim("sid"))
        by_name = named.filter(~_by_law()).drop("state", "ccn")
        found = Y.find_by_ccn(named.filter(_by_law()), roster, pos)
        lawful, lost_by_law = E.match_or_generic(found.drop("state", "ccn"), F.col("target").isNotNull())
        lawful = lawful.withColumn("route", F.when(F.col("route") == "hospital", "statutory").otherwise(F.col("route")))
    served, lost = E.match_or_generic(Y.find_hospitals(by_name, Y.name_index(rows, pos), ids), F.col("target").isNotNull())
    if roster is not None:
        kind = served.schema["target"].dataType
        served = served.unionByName(lawful.withColumn("target", F.col("target").cast(kind)))
        lost = lost.unionByName(lost_by_law.withColumn("target", F.col("target").cast(kind)))
    accepted, invalid = E.coerce_intakes(served)
    scored = accepted.withColumn("fpl_pct", S.fpl_percent(
        F.col("annual_income"), F.col("household_size"))).withColumn(
        "insured", S.is_insured(F.col("insurance")))
    wanted = ["policy", "hospital", "needs_review", "grounding", "free_care_income_ceiling_by_household"]
    wanted += [c for c in E.PLAN_LINKS if c in rows.columns]
    hospitals = rows.select(F.col(pos).alias("target"), *wanted)
    own = E.plan_struct(E.with_policy_tier(
        scored.filter("route = 'hospital'").join(hospitals, "target")), today=today)
    general = E.generic_plan(scored.filter("route = 'generic'")
                             .withColumn("hospital_name", F.col("name")))
    made = [own, general]
    if roster is not None:
        places = E.with_statutory_bands(roster).select(
            F.col(pos).alias("target"), "hospital", "state", "rules", "rural", "free_band", "discount_band")
        made.append(E.statutory_plan(E.statutory_facts(scored.filter("route = 'statutory'").join(places, "target"))))
    plans = reduce(DataFrame.unionByName, [p.select(request_id, "route", F.to_json("plan").alias("plan")) for p in made])
    errors = lost.select(request_id, "error").unionByName(invalid.select(request_id, "error"))
    return plans, errors
