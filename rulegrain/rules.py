"""The rules and guideline dimensions as DataFrames.

Both are fixed at a few dozen rows however large the data grows, so they are the only
inputs the engine broadcasts without measuring them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rulegrain import reference_values as V
from rulegrain import schemas
from rulegrain.sources.inline import inline_table, struct_literal


def _rule_values(overrides: dict[str, dict] | None) -> list[dict]:
    flags = {f.name: False for f in schemas.RULES.fields if f.dataType == schemas.BOOL}
    return [{**flags, **entry, **(overrides or {}).get(entry["code"], {})} for entry in V.RULES]


def rules_table(spark: SparkSession, overrides: dict[str, dict] | None = None) -> DataFrame:
    """One row per modelled jurisdiction plus the default row (code ``US``)."""
    rows = [tuple(entry.get(name) for name in schemas.RULES.names)
            for entry in _rule_values(overrides)]
    return inline_table(spark, rows, schemas.RULES)


def default_rules(overrides: dict[str, dict] | None = None) -> Column:
    """The default row as one literal struct."""
    entry = next(e for e in _rule_values(overrides) if e["code"] == V.DEFAULT_CODE)
    return F.expr(struct_literal(entry, schemas.RULES))


def guideline_table(spark: SparkSession) -> DataFrame:
    rows = [(year, size, usd)
            for year, g in V.GUIDELINES.items() for size, usd in enumerate(g["sizes"], 1)]
    return inline_table(spark, rows, schemas.GUIDELINE)


def lookup_code(state: Column) -> Column:
    """Missing state means the home state; any other code is upper-cased."""
    return F.upper(F.coalesce(F.nullif(state, F.lit("")), F.lit(V.HOME_CODE)))


def with_rules(df: DataFrame, state: str = "state", out: str = "rules",
               overrides: dict[str, dict] | None = None) -> DataFrame:
    """Attach each row's rules as one struct column; unmodelled codes get the default row."""
    fields = schemas.RULES.names
    modelled = (rules_table(df.sparkSession, overrides)
                .filter(F.col("code") != V.DEFAULT_CODE)
                .select(F.col("code").alias("_rule_code"), F.struct(*fields).alias("_rule")))
    return (df.withColumn("_rule_code", lookup_code(F.col(state)))
              .join(F.broadcast(modelled), "_rule_code", "left")
              .withColumn(out, F.coalesce("_rule", default_rules(overrides)))
              .drop("_rule", "_rule_code"))


def is_statutory(rules: Column) -> Column:
    return rules["free_pct"].isNotNull() | rules["discount_pct"].isNotNull()


def with_bands(df: DataFrame, rules: str = "rules", ccn: str = "ccn",
               hospital_type: str = "hospital_type") -> DataFrame:
    """Effective free / discount ceilings of each row's hospital.

    Rural hospitals take the rural bands where the law has them; hospitals on the published
    upper-tier list take that tier's bands; everyone else the jurisdiction's floor.
    """
    r = F.col(rules)
    rural = F.coalesce(F.col(hospital_type) == V.RURAL_TYPE, F.lit(False))
    upper = F.coalesce((r["code"] == V.UPPER_TIER_STATE) & F.col(ccn).isin(V.UPPER_TIER_CCNS),
                       F.lit(False))

    def pick(base: str, rural_field: str, tier_value: int) -> Column:
        return (F.when(upper, F.lit(tier_value))
                 .when(rural & r[rural_field].isNotNull(), r[rural_field])
                 .otherwise(r[base]))

    return (df.withColumn("rural", rural)
              .withColumn("free_band", pick("free_pct", "free_rural_pct", V.UPPER_TIER_FREE_PCT))
              .withColumn("discount_band", pick("discount_pct", "discount_rural_pct",
                                                V.UPPER_TIER_DISCOUNT_PCT)))
