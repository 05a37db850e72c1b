"""How the engine's inputs are read out of the star-schema tables.

Each binding has a Spark form (a DataFrame in the engine's own schema) and a SQL form (a
CTE with scalar columns) saying the same thing for the oracle.  All rows of a table are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulegrain.functions import scalars as S
from rulegrain.session import SCAN_TASKS


#: Tables whose rows are costly to work on, in long texts.
_TEXTS = {"documents", "pages", "conversations"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return dealt(rows) if name in _TEXTS else rows


def dealt(rows: DataFrame) -> DataFrame:
    """The rows in as many tasks as the session's `spark.rulegrain.scanTasks` says; as they are scanned without it.

    A file of one row group is read by one task whatever its size: where tables are stored so, costly work on their
    rows needs dealing out first.  Large tables have many row groups and need no setting."""
    tasks = rows.sparkSession.conf.get(SCAN_TASKS, None)
    return rows.repartition(int(tasks)) if tasks else rows


# --- SQL spellings shared by oracles ---------------------------------------------------------


def sql_limit(n: str) -> str:
    return (f"(CASE WHEN greatest({n},1) <= 8 THEN [15960,21640,27320,33000,38680,44360,50040,"
            f"55720][greatest({n},1)] ELSE 55720 + (greatest({n},1)-8)*5680 END)")


def sql_pct(income: str, n: str) -> str:
    return (f"round(cast(greatest({income},0) as double)/cast({sql_limit(n)} as double)"
            f"*100::double, 1)")


def sql_num(v: str) -> str:
    return (f"(CASE WHEN {v} = floor({v}) THEN cast(cast({v} as bigint) as varchar) "
            f"ELSE cast(cast({v} as double) as varchar) END)")


def sql_title(x: str) -> str:
    return (f"array_to_string(list_transform(regexp_extract_all(lower({x}), "
            f"'[a-z]+|[^a-z]+'), lambda t: upper(t[1]) || t[2:]), '')")


def sql_slug(x: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({x},'')), '[^a-z0-9]+', '-', 'g'), '-')"


def sql_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


# --- intake: one household per customer ------------------------------------------------------

_INSURANCE = """CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'uninsured' WHEN 'MACHINERY' THEN ''
 WHEN 'BUILDING' THEN 'Self-Pay' WHEN 'AUTOMOBILE' THEN 'Medicare' ELSE ' none ' END"""


def intakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS intake_id", "c_name AS full_name", "c_nationkey AS region_key",
        "CAST(floor(c_acctbal * 20) AS BIGINT) AS annual_income",
        "CAST(c_custkey % 11 AS INT) AS household_size",
        f"{_INSURANCE} AS insurance",
        "c_custkey % 3 = 0 AS in_collections")


SQL_INTAKE = f"""intake AS (SELECT c_custkey AS intake_id, c_name AS full_name,
 c_nationkey AS region_key, cast(floor(c_acctbal*20) as bigint) AS annual_income,
 cast(c_custkey % 11 as int) AS household_size, {_INSURANCE} AS insurance,
 c_custkey % 3 = 0 AS in_collections FROM customer)"""

# --- roster: one hospital per supplier -------------------------------------------------------

_STATES = ["CA", "IL", "NY", "MD", "WA", "NJ", "CO", "OR", "RI", "ME", "MA", "OH", "VT", "NC",
           "ZZ", None]
_STATE_CASE = ("CASE s_nationkey % 16 " + " ".join(
    f"WHEN {i} THEN '{s}'" for i, s in enumerate(_STATES) if s) + " END")
_TYPE_CASE = ("CASE WHEN s_suppkey % 4 = 0 THEN 'Critical Access Hospitals' "
              "ELSE 'Acute Care Hospitals' END")
_ROSTER = f"""s_suppkey AS pos, upper(s_name) AS hospital,
 CAST(500000 + s_suppkey AS STRING) AS ccn, upper(n_name) AS city,
 CASE WHEN s_suppkey % 23 = 5 THEN NULL ELSE n_name END AS county, {_STATE_CASE} AS state,
 concat('(555) 010-', lpad(CAST(s_suppkey % 10000 AS STRING), 4, '0')) AS phone,
 {_TYPE_CASE} AS hospital_type, 'statutory' AS status"""


def roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier")
    nations = table(spark, sf_dir, "nation")
    joined = suppliers.join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.selectExpr(*[c.strip() for c in split_top(_ROSTER)])


def split_top(text: str) -> list[str]:
    """Split a select list at its top-level commas."""
    out, depth, start = [], 0, 0
    for i, ch in enumerate(text):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out.append(text[start:i])
            start = i + 1
    return [*out, text[start:]]


SQL_ROSTER = (f"roster AS (SELECT {_ROSTER.replace('STRING', 'VARCHAR')} "
              "FROM supplier JOIN nation ON s_nationkey = n_nationkey)")


def sql_rules() -> str:
    """The rules dimension as a VALUES list."""
    from rulegrain import reference_values as V
    from rulegrain import schemas

    names = [f.name for f in schemas.RULES.fields]

    def lit(entry, field):
        v = entry.get(field.name)
        kind = {"string": "varchar", "int": "int", "boolean": "boolean"}[
            field.dataType.simpleString()]
        if v is None and kind == "boolean":
            v = False
        if v is None:
            return f"cast(null as {kind})"
        return sql_list([v]) if isinstance(v, str) else str(v).lower()

    rows = ",\n".join("(" + ",".join(lit(e, f) for f in schemas.RULES.fields) + ")"
                      for e in V.RULES)
    return f"rules({', '.join(names)}) AS (VALUES {rows})"


# roster rows with their rules and effective bands
SQL_BANDS = """banded AS (SELECT r.*, coalesce(m.code, d.code) AS rule_code,
 coalesce(r.hospital_type = 'Critical Access Hospitals', false) AS rural,
 CASE WHEN m.code = 'WA' AND r.ccn IN (SELECT ccn FROM upper_tier) THEN 300
  WHEN r.hospital_type = 'Critical Access Hospitals' AND m.free_rural_pct IS NOT NULL
   THEN m.free_rural_pct WHEN m.code IS NULL THEN d.free_pct ELSE m.free_pct END AS free_band,
 CASE WHEN m.code = 'WA' AND r.ccn IN (SELECT ccn FROM upper_tier) THEN 400
  WHEN r.hospital_type = 'Critical Access Hospitals' AND m.discount_rural_pct IS NOT NULL
   THEN m.discount_rural_pct WHEN m.code IS NULL THEN d.discount_pct
  ELSE m.discount_pct END AS discount_band
 FROM roster r LEFT JOIN (SELECT * FROM rules WHERE code <> 'US') m
  ON m.code = upper(coalesce(nullif(r.state, ''), 'CA'))
 JOIN (SELECT * FROM rules WHERE code = 'US') d ON true)"""


def sql_upper_tier() -> str:
    from rulegrain import reference_values as V
    return ("upper_tier(ccn) AS (VALUES "
            + ",".join(f"('{c}')" for c in V.UPPER_TIER_CCNS) + ")")


def sql_roster_with_bands() -> str:
    return ",\n".join([sql_rules(), sql_upper_tier(), SQL_ROSTER, SQL_BANDS])


# --- bills: one per order line: which household owes which hospital --------------------------


def bills(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    return (lines.join(orders, lines.l_orderkey == orders.o_orderkey)
                 .select(F.col("o_custkey").alias("intake_id"),
                         F.col("l_suppkey").alias("pos")))


SQL_BILLS = """bills AS (SELECT o_custkey AS intake_id, l_suppkey AS pos
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

# --- policies: one extracted row per part ----------------------------------------------------

_POLICY_SCALARS = {
    "k": "p_partkey",
    "hospital": "upper(p_name)",
    "city": "p_brand",
    "county": "CASE WHEN p_size = 9 THEN NULL ELSE p_type END",
    "state": ("CASE p_type WHEN 'ECONOMY' THEN 'CA' WHEN 'LARGE' THEN 'IL' WHEN 'MEDIUM' "
              "THEN 'oh' WHEN 'PROMO' THEN 'TX' WHEN 'STANDARD' THEN 'VT' END"),
    "permalink": ("CASE WHEN p_partkey % 19 = 0 THEN '' "
                  "ELSE concat('https://example.org/p/', p_partkey) END"),
    "status": ("CASE WHEN p_size <= 4 THEN 'needs_ocr' WHEN p_size = 5 THEN 'extraction_error' "
               "WHEN p_size = 6 THEN 'queued' ELSE 'extracted' END"),
    "error": "CASE WHEN p_size = 5 THEN concat('timeout ', p_partkey) END",
    "source_sha256": "CASE WHEN p_size = 7 THEN NULL ELSE sha256(p_name) END",
    "fc": "CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE CAST(100 + (p_partkey % 9) * 50 AS DOUBLE) END",
    "dc": "CASE WHEN p_partkey % 15 = 0 THEN NULL ELSE CAST(250 + (p_partkey % 14) * 50 AS DOUBLE) END",
    "conf": "CASE WHEN p_size = 13 THEN NULL ELSE CAST(p_size AS DOUBLE) / 50 END",
    "truncated": "p_size % 17 = 0",
    "phone": ("CASE p_brand WHEN 'Brand#3' THEN NULL WHEN 'Brand#5' THEN '' "
              "ELSE concat('(555) 010-', lpad(CAST(p_partkey % 10000 AS STRING), 4, '0')) END"),
    "oop": "CASE p_partkey % 4 WHEN 0 THEN CAST(10 AS DOUBLE) WHEN 1 THEN CAST(0 AS DOUBLE) END",
    "interest_free": "p_partkey % 2 = 0",
    "needs_review": "p_partkey % 9 = 0",
    "verdict": ("CASE p_partkey % 7 WHEN 0 THEN 'grounded' WHEN 1 THEN 'ungrounded' "
                "WHEN 2 THEN 'stale_source' WHEN 3 THEN 'unverifiable' "
                "WHEN 4 THEN 'unreadable_source' END"),
}
_TIER_SCALARS = {
    "n_tiers": "CASE WHEN k % 6 = 0 OR dc IS NULL THEN 0 ELSE 2 END",
    "lo1": "coalesce(fc, CAST(100 AS DOUBLE)) + 1",
    "hi1": "coalesce(fc, CAST(100 AS DOUBLE)) + 50 + k % 3",
    "lo2": ("CASE WHEN k % 12 = 1 THEN NULL ELSE coalesce(fc, CAST(100 AS DOUBLE)) + 51 + k % 3 "
            "+ CASE k % 4 WHEN 0 THEN 0 WHEN 1 THEN 10 WHEN 2 THEN -5 ELSE 0 END END"),
    "hi2": "dc + CASE WHEN k % 5 = 0 THEN 50 ELSE 0 END",
    "ben1": "CASE WHEN k % 7 = 0 THEN NULL ELSE 'reduced bill' END",
    "basis1": "CASE WHEN k % 2 = 0 THEN 'Medicare' END",
    "pays1": "CASE WHEN k % 8 = 7 THEN NULL WHEN k % 7 = 0 THEN NULL ELSE CAST((k % 5) * 20 AS DOUBLE) END",
    "pays2": "CAST(50 AS DOUBLE)",
    "swapped": "k % 11 = 0",
    "free_table_pct": "CASE WHEN k % 13 = 0 THEN coalesce(fc, CAST(100 AS DOUBLE)) + 50 ELSE fc END",
    "disc_table_pct": "CASE WHEN k % 23 = 0 THEN NULL ELSE dc END",
    "pos": "k",
}


def policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in the extracted-row shape (plus `pos`)."""
    spark_scalars = {n: e.replace("sha256(p_name)", "sha2(p_name, 256)")
                     for n, e in _POLICY_SCALARS.items()}
    flat = (table(spark, sf_dir, "part")
            .selectExpr(*[f"{e} AS {n}" for n, e in spark_scalars.items()])
            .selectExpr("*", *[f"{e} AS {n}" for n, e in _TIER_SCALARS.items()]))
    tier = "named_struct('fpl_low_pct', {lo}, 'fpl_high_pct', {hi}, 'benefit', {ben}, 'discount_basis', {basis}, 'patient_pays_pct', {pays})"
    one = tier.format(lo="lo1", hi="hi1", ben="ben1", basis="basis1", pays="pays1")
    two = tier.format(lo="lo2", hi="hi2", ben="CAST(NULL AS STRING)",
                      basis="CAST(NULL AS STRING)", pays="pays2")
    policy = F.expr(f"""named_struct(
      'free_care', named_struct('fpl_ceiling_pct', fc),
      'high_medical_cost', named_struct('oop_threshold_pct_of_income', oop),
      'discount_payment', named_struct('fpl_ceiling_pct', dc, 'tiers',
         CASE WHEN n_tiers = 0 THEN slice(array({one}), 1, 0)
              WHEN swapped THEN array({two}, {one}) ELSE array({one}, {two}) END),
      'payment_plans', named_struct('interest_free', interest_free),
      'contact', named_struct('phone', phone),
      'extraction_confidence', conf, '_truncated', truncated)""")
    return flat.select(
        "pos", "hospital", "city", "county", "state", "permalink", "status", "error",
        "source_sha256", "needs_review", policy.alias("policy"),
        S.dollar_table(F.col("free_table_pct")).alias("free_care_income_ceiling_by_household"),
        S.dollar_table(F.col("disc_table_pct")).alias("discount_income_ceiling_by_household"),
        F.expr("CASE WHEN verdict IS NOT NULL THEN "
               "named_struct('verdict', verdict, 'checked', 1) END").alias("grounding"))


SQL_POLICY = ("pol0 AS (SELECT " + ", ".join(
    f"{e.replace('STRING', 'VARCHAR')} AS {n}" for n, e in _POLICY_SCALARS.items())
    + " FROM part), pol AS (SELECT *, " + ", ".join(
        f"{e} AS {n}" for n, e in _TIER_SCALARS.items()) + " FROM pol0)")

# tiers in array order: idx 0 and 1
SQL_TIERS = """tier AS (
 SELECT k, CASE WHEN swapped THEN 1 ELSE 0 END AS idx, lo1 AS lo, hi1 AS hi, ben1 AS benefit,
  basis1 AS basis, pays1 AS pays FROM pol WHERE n_tiers > 0
 UNION ALL
 SELECT k, CASE WHEN swapped THEN 0 ELSE 1 END, lo2, hi2, NULL, NULL, pays2
  FROM pol WHERE n_tiers > 0)"""
