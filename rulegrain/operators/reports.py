"""Coverage and distribution reports over an assembled dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FC = "policy.free_care.fpl_ceiling_pct"
DC = "policy.discount_payment.fpl_ceiling_pct"


def usable(rows: DataFrame) -> DataFrame:
    return rows.filter((F.col("status") == "extracted") & F.col("policy").isNotNull())


def status_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count("*").alias("n"))


def floor_pct(part: Column, total: Column) -> Column:
    """Whole percent, rounded down; an empty total counts as one."""
    return F.floor(part * 100 / F.greatest(total, F.lit(1))).cast("bigint")


def coverage(rows: DataFrame) -> DataFrame:
    """One row of totals over a merged dataset (`spliced` marks replaced rows)."""
    is_usable = (F.col("status") == "extracted") & F.col("policy").isNotNull()
    out = rows.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("spliced")).alias("spliced"),
        F.count_if(is_usable).alias("usable"),
        F.count_if(is_usable & F.col(FC).isNotNull()).alias("with_free"),
        F.count_if(F.col("needs_review")).alias("needs_review"))
    return out.withColumn("usable_pct", floor_pct(F.col("usable"), F.col("total")))


def ceiling_distribution(rows: DataFrame) -> DataFrame:
    """(kind, ceiling, n): free ceilings of rows that state free care, and discount ceilings."""
    sides = F.array(
        F.when(F.col("policy.free_care").isNotNull(),
               F.struct(F.lit("free").alias("kind"), F.col(FC).alias("ceiling"))),
        F.struct(F.lit("discount").alias("kind"), F.col(DC).alias("ceiling")))
    return (usable(rows).select(F.inline(F.array_compact(sides)))
            .groupBy("kind", "ceiling").agg(F.count("*").alias("n"))
            .orderBy("kind", F.asc_nulls_last("ceiling")))


def county_counts(rows: DataFrame, pos: str = "pos") -> DataFrame:
    return usable(rows).groupBy("county").agg(F.count("*").alias("n"),
                                              F.min(pos).alias("first_pos"))


def top_counties(rows: DataFrame, n: int = 5, pos: str = "pos") -> DataFrame:
    """Most frequent counties; ties go to the county seen first."""
    return county_counts(rows, pos).orderBy(F.desc("n"), "first_pos").limit(n)


def confidence_counts(parsed: DataFrame) -> DataFrame:
    return parsed.groupBy("confidence").agg(F.count("*").alias("n"))


def household_benefits(people: DataFrame, key: str = "household") -> DataFrame:
    """Person values and the tax-unit credit of a household, rolled up.

    `people`: key, medicaid, is_medicaid_eligible, aca_ptc (one value per tax unit)."""
    return people.groupBy(key).agg(
        F.bool_or("is_medicaid_eligible").alias("medicaid_eligible"),
        F.rint(F.sum("medicaid")).cast("bigint").alias("medicaid_value"),
        F.rint(F.max("aca_ptc")).cast("bigint").alias("aca_ptc"))


def benefit_leads(benefits: DataFrame) -> DataFrame:
    """Lead keys of a rolled-up household; a fallback key when nothing applies."""
    leads = F.array_compact(F.array(
        F.when(F.col("medicaid_eligible"), F.lit("pe_medicaid")),
        F.when(F.col("aca_ptc") > 0, F.lit("pe_aca"))))
    return benefits.withColumn("leads", F.when(F.size(leads) > 0, leads)
                               .otherwise(F.array(F.lit("pe_over"))))


def region_counts(roster: DataFrame, home: str = "CA") -> DataFrame:
    """Hospitals per state, the home state first."""
    return (roster.groupBy("state").agg(F.count("*").alias("n"))
            .orderBy((F.col("state") != home).cast("int"), "state"))


def labels(rows: DataFrame) -> DataFrame:
    return rows.select("label").distinct().orderBy("label")


def review_count(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_if(F.col("status") == "extracted").alias("extracted"),
                    F.count_if("needs_review").alias("needs_review"),
                    F.count_if(F.col("status") == "needs_ocr").alias("needs_ocr"))
