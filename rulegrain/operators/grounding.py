"""The evidence gate: is every published number stated in its source?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulegrain import reference_values as V
from rulegrain.functions import evidence as T
from rulegrain.functions import scalars as S
from rulegrain.operators.dedup import last_per_key
from rulegrain.operators.flatten import unnest

CLAIMS = "array<struct<label:string,value:double>>"


def published_thresholds(policy: Column) -> Column:
    """(label, value) of every number the row publishes; lower tier bounds are derived and left
    out."""
    def claim(label: Column, value: Column) -> Column:
        return F.when(value.isNotNull(), F.struct(label.alias("label"), value.alias("value")))

    def tier(t: Column, i: Column) -> Column:
        label = F.concat(F.lit("discount_payment.tiers["), i.cast("string"),
                         F.lit("].fpl_high_pct"))
        return claim(label, t["fpl_high_pct"])

    discount = policy["discount_payment"]
    head = F.array(
        claim(F.lit("free_care.fpl_ceiling_pct"), policy["free_care"]["fpl_ceiling_pct"]),
        claim(F.lit("discount_payment.fpl_ceiling_pct"), discount["fpl_ceiling_pct"]))
    tiers = F.coalesce(F.transform(discount["tiers"], tier), F.array().cast(CLAIMS))
    return F.array_compact(F.concat(head, tiers))


def join_corpora(rows: DataFrame, corpora: DataFrame, key: str = "permalink") -> DataFrame:
    """Attach each row's source text; rows without a record keep none and lose any old verdict.

    Of several records of one key the last by `pos` counts; without that column, the largest text."""
    if "pos" in corpora.columns:
        corpora = last_per_key(corpora, [key])
    else:
        corpora = corpora.groupBy(key).agg(F.max("text").alias("text"))
    texts = corpora.select(key, F.col("text").alias("corpus"), F.lit(True).alias("has_record"))
    joined = rows.join(texts, key, "left")
    if "grounding" in rows.columns:
        joined = joined.withColumn("grounding", F.when(F.col("has_record"), F.col("grounding")))
    return joined


def with_mentions(rows: DataFrame, corpus: str = "corpus",
                  value_pattern: str = T.PERCENTS,
                  marker_pattern: str = T.MARKERS) -> DataFrame:
    """`_markers` and `_mentions`, found once per text; texts without a marker skip the rest."""
    text = F.col(corpus)
    found = rows.withColumn("_markers", T.marker_spans(text, marker_pattern))
    none = F.expr("CAST(array() AS array<struct<value:double,start:int>>)")
    return found.withColumn("_mentions", F.when(
        F.size("_markers") > 0, T.percent_mentions(text, value_pattern)).otherwise(none))


def ground_claims(rows: DataFrame, window: Column | None = None, claims: str = "claims",
                  corpus: str = "corpus") -> DataFrame:
    """Explode `claims` and ground each: (…, label, value, grounded, evidence)."""
    window = F.lit(V.EVIDENCE_WINDOW) if window is None else window
    keep = [c for c in rows.columns if c not in (claims, corpus)]
    made = with_mentions(rows, corpus)
    graded = made.withColumn("_g", F.transform(claims, lambda c: F.struct(
        c["label"].alias("label"), c["value"].alias("value"),
        T.grounding_of(c["value"], F.col(corpus), F.col("_mentions"), F.col("_markers"), window)
         .alias("g"))))
    return unnest(graded, "_g", "_c", keep).select(
        *keep, "_c.label", "_c.value", "_c.g.grounded", "_c.g.evidence")


def verdicts(rows: DataFrame, window: Column | None = None) -> DataFrame:
    """Add `verdict` and `checked` to rows with claims, corpus, source_sha256 and
    extraction_channel."""
    window = F.lit(V.EVIDENCE_WINDOW) if window is None else window
    corpus = F.col("corpus")
    # the text checks are columns of their own, so each text is scanned once for each
    made = (with_mentions(rows)
            .withColumn("_short", T.short_text(corpus))
            .withColumn("_readable", T.intelligible(corpus)))
    unusable = F.col("_short") | ~F.col("_readable")
    stored = S.blank_to_null(F.col("source_sha256"))
    passed = F.transform("claims", lambda c: F.struct(
        T.is_grounded(c["value"], F.col("_mentions"), F.col("_markers"), window).alias("ok"),
        c["label"].contains("tiers").alias("edge")))
    graded = made.withColumn("_passed", passed)
    verdict = (
        F.when(corpus.isNull(), F.lit("unverifiable"))
         .when((F.col("extraction_channel") == "pdf_ocr") & unusable, F.lit("ocr_extracted"))
         .when(F.col("_short"), F.lit("unverifiable"))
         .when(~F.col("_readable"), F.lit("unreadable_source"))
         .when(stored != S.content_sha(corpus), F.lit("stale_source"))
         .when(F.size("claims") <= 0, F.lit("unverifiable"))
         .when(F.forall("_passed", lambda p: p["ok"]), F.lit("grounded"))
         .when(F.exists("_passed", lambda p: ~p["ok"] & ~p["edge"]), F.lit("ungrounded"))
         .otherwise(F.lit("tier_edges_ungrounded")))
    reached = F.col("verdict").isin("grounded", "ungrounded", "tier_edges_ungrounded")
    return (graded.withColumn("verdict", verdict)
            .withColumn("checked", F.when(reached, F.size("claims")).otherwise(0))
            .drop("_markers", "_mentions", "_short", "_readable", "_passed"))


def annotate(graded: DataFrame, run_date: str) -> DataFrame:
    """`grounding` from the verdict; `last_verified_at` only where a number was confirmed."""
    return (graded
            .withColumn("grounding", F.struct("verdict", "checked"))
            .withColumn("last_verified_at", F.when(F.col("verdict") == "grounded",
                                                   F.lit(run_date))))


def verdict_tally(graded: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Counts per verdict and the auto-verification rate over checkable rows."""
    group = group or []
    names = ["grounded", "ungrounded", "tier_edges_ungrounded", "unverifiable", "ocr_extracted",
             "unreadable_source", "stale_source"]
    counted = graded.groupBy(*group).agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("verdict") == n).alias(n) for n in names])
    checkable = (F.col("total") - F.col("unverifiable") - F.col("ocr_extracted")
                 - F.col("unreadable_source") - F.col("stale_source"))
    return counted.withColumn("auto_rate", F.round(
        F.try_divide(F.col("grounded") * F.lit(100.0), checkable), 1))


def window_sweep(rows: DataFrame, windows: list[int]) -> DataFrame:
    """Grounded / ungrounded claims for several windows; texts are scanned once."""
    def under(window: int) -> Column:
        ok = F.transform("claims", lambda c: T.is_grounded(
            c["value"], F.col("_mentions"), F.col("_markers"), F.lit(window)))
        return F.struct(F.lit(window).alias("window"), ok.alias("ok"))

    graded = with_mentions(rows).withColumn("_sweep", F.array(*[under(w) for w in windows]))
    per_claim = unnest(unnest(graded, "_sweep", "s", []).select("s.*"), "ok", "ok", ["window"])
    return per_claim.groupBy("window").agg(F.count_if("ok").alias("grounded"),
                                           F.count_if(~F.col("ok")).alias("ungrounded"))
