"""Validation, findings and the review queue over policies (part)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rulegrain import rules as R
from rulegrain.functions import scalars as S
from rulegrain.operators import quality as Q
from rulegrain.operators import reports as P
from rulegrain.plans import bindings as B
from rulegrain.plans.registry import query
from rulegrain.plans.scalar_queries import SPARK_DATE_TEXT, SQL_DATE_TEXT, TODAY

# policies with their jurisdiction's bounds
SQL_BOUNDED = f"""{B.sql_rules()}, {B.SQL_POLICY}, {B.SQL_TIERS},
prow AS (SELECT p.*, coalesce(m.floor_pct, d.floor_pct) AS floor_pct,
 coalesce(m.discount_implausible_pct, d.discount_implausible_pct) AS d_high,
 coalesce(m.free_unusual_pct, d.free_unusual_pct) AS f_unusual,
 coalesce(m.free_implausible_pct, d.free_implausible_pct) AS f_high
 FROM pol p LEFT JOIN (SELECT * FROM rules WHERE code <> 'US') m
  ON m.code = upper(coalesce(nullif(p.state, ''), 'CA'))
 JOIN (SELECT * FROM rules WHERE code = 'US') d ON true)"""

_n = B.sql_num
SQL_REASONS = f"""reason AS (
 SELECT k, 1 AS o, 'thresholds_missing' AS reason FROM prow
  WHERE fc IS NULL AND dc IS NULL AND n_tiers = 0
 UNION ALL SELECT k, 2, 'free_range|' || {_n('fc')} FROM prow WHERE fc < 0 OR fc > f_high
 UNION ALL SELECT k, 3, 'discount_range|' || {_n('dc')} FROM prow WHERE dc < 0 OR dc > d_high
 UNION ALL SELECT k, 4, 'free_above_discount|' || {_n('fc')} || '|' || {_n('dc')}
  FROM prow WHERE fc > dc
 UNION ALL SELECT k, 5, 'tiers_unordered' FROM prow
  WHERE n_tiers > 0 AND CASE WHEN swapped THEN lo2 > lo1 ELSE lo1 > lo2 END
 UNION ALL SELECT DISTINCT k, 6, 'tier_without_terms' FROM tier
  WHERE (lo IS NOT NULL OR hi IS NOT NULL) AND coalesce(benefit, '') = '' AND pays IS NULL AND coalesce(basis, '') = ''
 UNION ALL SELECT k, 7, 'text_cut' FROM prow WHERE truncated
 UNION ALL SELECT k, 8, 'confidence|' || coalesce(cast(conf AS varchar), 'none') FROM prow
  WHERE coalesce(conf, 0) < 0.6)"""

SQL_GEOMETRY = f"""st AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY lo, idx) AS rn FROM tier
 WHERE lo IS NOT NULL AND hi IS NOT NULL),
pair AS (SELECT a.k, a.lo AS alo, a.hi AS ahi, b.lo AS blo, b.hi AS bhi FROM st a JOIN st b ON a.k = b.k AND b.rn = a.rn + 1),
geometry AS (
 SELECT k, 'MEDIUM' AS severity, 'pays_unordered|[' ||
   string_agg({_n('pays')}, ', ' ORDER BY rn) || ']' AS detail FROM st WHERE pays IS NOT NULL GROUP BY k
  HAVING array_agg(pays ORDER BY rn) <> array_agg(pays ORDER BY pays)
 UNION ALL SELECT k, 'MEDIUM', 'tiers_overlap|' || {_n('alo')} || '-' || {_n('ahi')} || '|' || {_n('blo')} || '-' || {_n('bhi')}
  FROM pair WHERE ahi >= blo
 UNION ALL SELECT k, 'LOW', 'tiers_apart|' || {_n('ahi')} || '|' || {_n('blo')}
  FROM pair WHERE ahi < blo AND blo - ahi > 1
 UNION ALL SELECT st.k, 'MEDIUM', 'tier_beyond_ceiling|' || {_n('hi')} || '|' || {_n('dc')}
  FROM st JOIN prow USING (k) WHERE hi > dc)"""

_EXEMPT = "'none'"
SQL_FINDINGS = f"""{SQL_BOUNDED}, {SQL_REASONS}, {SQL_GEOMETRY},
ok AS (SELECT * FROM prow WHERE status = 'extracted'),
finding AS (
 SELECT k, 'MEDIUM' AS severity, 'unresolved' AS "check", CASE status
   WHEN 'needs_ocr' THEN 'awaits_ocr'
   WHEN 'extraction_error' THEN 'reader_failed|' || error ELSE 'status_unknown|' || status END AS detail
  FROM prow WHERE status <> 'extracted'
 UNION ALL SELECT k, CASE WHEN split_part(reason, '|', 1) IN ('thresholds_missing', 'free_range', 'discount_range', 'free_above_discount')
   THEN 'HIGH' ELSE 'MEDIUM' END, 'validator', reason FROM reason SEMI JOIN ok USING (k)
 UNION ALL SELECT k, 'HIGH', 'reextract_candidate', 'silent_gap|' || cast(conf AS varchar)
  FROM ok WHERE fc IS NULL AND dc IS NULL AND n_tiers = 0 AND conf >= 0.8
 UNION ALL SELECT k, 'HIGH', 'statutory', 'discount_implausible|' || {_n('dc')} || '|' || d_high FROM ok WHERE dc > d_high
 UNION ALL SELECT k, 'HIGH', 'statutory', 'free_implausible|' || {_n('fc')} || '|' || f_high FROM ok WHERE fc > f_high
 UNION ALL SELECT k, 'MEDIUM', 'outlier', 'free_generous|' || {_n('fc')} || '|' || floor_pct
  FROM ok WHERE fc > f_unusual AND fc <= f_high
 UNION ALL SELECT k, 'HIGH', 'statutory', 'tier_implausible|' || {_n('hi')} || '|' || d_high
  FROM tier JOIN ok USING (k) WHERE hi > d_high
 UNION ALL SELECT k, severity, 'tier_geometry', detail FROM geometry SEMI JOIN ok USING (k)
 UNION ALL SELECT k, 'LOW', 'single_tier', 'ceilings_equal|' || {_n('fc')} || '|' || n_tiers FROM ok WHERE fc = dc
 UNION ALL SELECT k, 'HIGH', 'dollar_table', 'dollars_differ|free care'
  FROM ok WHERE fc IS DISTINCT FROM free_table_pct
 UNION ALL SELECT k, 'HIGH', 'dollar_table', 'dollars_differ|discount'
  FROM ok WHERE dc IS DISTINCT FROM disc_table_pct
 UNION ALL SELECT k, 'LOW', 'coverage', 'phone_missing' FROM ok WHERE coalesce(phone, '') = ''),
chain AS (SELECT source_sha256, count(*) AS members FROM ok WHERE source_sha256 IS NOT NULL GROUP BY 1
 HAVING count(*) > 1 AND count(DISTINCT concat_ws('|', coalesce(fc, -1), coalesce(dc, -1), n_tiers, coalesce(lo1, -1), coalesce(lo2, -1),
  coalesce(hi1, -1), coalesce(hi2, -1), coalesce(ben1, '-'), coalesce(basis1, '-'), coalesce(pays1, -1), swapped,
  coalesce(oop, -1), interest_free, coalesce(phone, '-'), coalesce(conf, -1), truncated)) > 1),
everything AS (SELECT * FROM finding UNION ALL
 SELECT k, 'HIGH', 'chain', 'sources_disagree|' || substr(source_sha256, 1, 10) || '|' || members FROM ok JOIN chain USING (source_sha256))"""


@query("r01_validate", f"WITH {SQL_BOUNDED}, {SQL_REASONS} SELECT k, reason FROM reason")
def validate(spark, sf_dir):
    rows = R.with_rules(B.policies(spark, sf_dir))
    return rows.select(F.col("pos").alias("k"), F.explode(Q.validation_reasons()).alias("reason"))


@query("r02_needs_review", f"""WITH {SQL_BOUNDED}, {SQL_REASONS},
dated AS (SELECT p_partkey AS k, {SQL_DATE_TEXT.replace('o_orderkey', 'p_partkey').replace('o_orderdate', "(DATE '1996-01-01' + p_size * 45)")} AS d FROM part),
issue AS (SELECT k FROM dated WHERE coalesce(d, '') <> '' AND (NOT regexp_full_match(d, '[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}')
 OR try_strptime(d, '%m/%d/%Y') > DATE '{TODAY}')),
n AS (SELECT k, count(*) AS c FROM (SELECT k FROM reason UNION ALL SELECT k FROM issue) GROUP BY k)
SELECT k, coalesce(c, 0) > 0 AS needs_review, cast(coalesce(c, 0) as int) AS reasons FROM pol LEFT JOIN n USING (k)""")
def needs_review(spark, sf_dir):
    dates = B.table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS pos",
        SPARK_DATE_TEXT.replace("o_orderkey", "p_partkey")
        .replace("o_orderdate", "date_add(DATE'1996-01-01', p_size * 45)")
        + " AS charity_effective_date")
    rows = B.policies(spark, sf_dir).drop("needs_review").join(dates, "pos")
    reviewed = Q.with_review(rows, F.lit(TODAY).cast("date"))
    return reviewed.select(F.col("pos").alias("k"), "needs_review",
                           F.size("review_reasons").alias("reasons"))


@query("r03_check_row", f"""WITH {SQL_FINDINGS} SELECT k, severity, "check", detail FROM finding""")
def check_row(spark, sf_dir):
    checked = Q.check_rows(B.policies(spark, sf_dir).withColumnRenamed("pos", "k"))
    return Q.explode_findings(checked, ["k"])


@query("w04_tier_neighbours", f"""WITH {SQL_BOUNDED}, {SQL_GEOMETRY} SELECT k, severity, detail FROM geometry""")
def tier_neighbours(spark, sf_dir):
    return Q.tier_geometry(B.policies(spark, sf_dir).withColumnRenamed("pos", "k"), ["k"])


@query("a05_chain_divergence", f"""WITH {SQL_FINDINGS}
SELECT k, severity, detail FROM everything WHERE "check" = 'chain'""")
def chain_divergence(spark, sf_dir):
    rows = B.policies(spark, sf_dir).withColumnRenamed("pos", "k")
    return Q.chain_findings(rows, ["k"]).drop("check")


@query("a05_chain_names", f"""WITH {SQL_FINDINGS}
SELECT DISTINCT source_sha256, hospital FROM ok SEMI JOIN chain USING (source_sha256)""")
def chain_names(spark, sf_dir):
    return Q.chain_names(B.policies(spark, sf_dir))


@query("r04_qa_report", f"""WITH {SQL_FINDINGS}, per AS (SELECT k,
 count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium,
 count(*) FILTER (severity = 'LOW') AS low FROM everything GROUP BY k)
SELECT count(*) AS total, count(*) FILTER (status = 'extracted') AS extracted,
 count(*) FILTER (status = 'extracted' AND high IS NULL) AS clean, count(high) AS flagged,
 cast(sum(high) as bigint) AS high, cast(sum(medium) as bigint) AS medium, cast(sum(low) as bigint) AS low,
 cast(sum(high) > 0 as int) AS exit_code FROM prow LEFT JOIN per USING (k)""")
def qa_report(spark, sf_dir):
    return Q.quality_summary(B.policies(spark, sf_dir))


@query("a06_severity_tally", f"""WITH {SQL_FINDINGS}
SELECT severity, "check", count(*) AS n, count(DISTINCT k) AS flagged_rows FROM everything GROUP BY ALL""")
def severity_tally(spark, sf_dir):
    found = Q.all_findings(B.policies(spark, sf_dir), ["pos"])
    per_row = found.groupBy("severity", "check", "pos").agg(F.count("*").alias("c"))
    return per_row.groupBy("severity", "check").agg(
        F.sum("c").alias("n"), F.count("*").alias("flagged_rows"))


@query("w05_worksheet_rank", f"""WITH {SQL_FINDINGS}
SELECT k, hospital, min(CASE severity WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END) AS rank, count(*) AS findings
FROM everything JOIN prow USING (k) GROUP BY k, hospital ORDER BY rank, hospital, k""")
def worksheet_rank(spark, sf_dir):
    rows = B.policies(spark, sf_dir).withColumnRenamed("pos", "k")
    return Q.review_queue(rows, row_id="k")


@query("l04_worksheet_order", f"""WITH {SQL_FINDINGS}, w AS (SELECT k, hospital,
 min(CASE severity WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END) AS rank FROM everything JOIN prow USING (k) GROUP BY k, hospital)
SELECT row_number() OVER (ORDER BY rank, hospital, k) AS line, k, hospital FROM w""")
def worksheet_order(spark, sf_dir):
    from rulegrain.operators.ranking import number_rows
    rows = B.policies(spark, sf_dir).withColumnRenamed("pos", "k")
    queue = Q.review_queue(rows, row_id="k")
    return number_rows(queue, ["rank", "hospital", "k"], out="line").select("line", "k", "hospital")


_QUOTES = """CASE k % 5 WHEN 0 THEN '{"free":"up to ' || k || '%","gap":"","disc":"half"}' WHEN 1 THEN '["a ' || k || '","","b"]'
 WHEN 2 THEN '"plain ' || k || '"' WHEN 3 THEN '   ' END"""


@query("t13_source_quotes", f"""SELECT k, CASE k % 5 WHEN 0 THEN 'free: "up to ' || k || '%" | disc: "half"'
 WHEN 1 THEN '"a ' || k || '" | "b"' WHEN 2 THEN '"plain ' || k || '"' END AS quotes
FROM (SELECT p_partkey AS k FROM part)""")
def source_quotes(spark, sf_dir):
    df = B.table(spark, sf_dir, "part").selectExpr("p_partkey AS k")
    return df.select("k", Q.flatten_quotes(F.expr(_QUOTES)).alias("quotes"))


# --- reports ---------------------------------------------------------------------------------


@query("p03_usable_rows", f"WITH {B.SQL_POLICY} SELECT k, hospital FROM pol WHERE status = 'extracted'")
def usable_rows(spark, sf_dir):
    return P.usable(B.policies(spark, sf_dir)).select(F.col("pos").alias("k"), "hospital")


@query("a01_status_counts", f"WITH {B.SQL_POLICY} SELECT status, count(*) AS n FROM pol GROUP BY 1")
def status_counts(spark, sf_dir):
    return P.status_counts(B.policies(spark, sf_dir))


@query("a03_ceiling_distribution", f"""WITH {B.SQL_POLICY}, u AS (SELECT * FROM pol WHERE status = 'extracted')
SELECT 'free' AS kind, fc AS ceiling, count(*) AS n FROM u GROUP BY ALL
UNION ALL SELECT 'discount', dc, count(*) FROM u GROUP BY ALL""")
def ceiling_distribution(spark, sf_dir):
    return P.ceiling_distribution(B.policies(spark, sf_dir))


@query("a04_county_coverage", f"""WITH {B.SQL_POLICY}
SELECT county, count(*) AS n, min(k) AS first_pos FROM pol WHERE status = 'extracted' GROUP BY 1""")
def county_coverage(spark, sf_dir):
    return P.county_counts(B.policies(spark, sf_dir))


@query("a04_top_counties", f"""WITH {B.SQL_POLICY}
SELECT county, count(*) AS n, min(k) AS first_pos FROM pol WHERE status = 'extracted' GROUP BY 1
ORDER BY n DESC, first_pos LIMIT 5""")
def top_counties(spark, sf_dir):
    return P.top_counties(B.policies(spark, sf_dir))


@query("a09_household_benefits", """SELECT c_nationkey AS household, bool_or(c_acctbal < 3000) AS medicaid_eligible,
 cast(round_even(sum(c_custkey * 0.25::double), 0) as bigint) AS medicaid_value,
 cast(round_even(max(c_custkey * 0.5::double), 0) as bigint) AS aca_ptc,
 CASE WHEN bool_or(c_acctbal < 3000) THEN 'pe_medicaid,' ELSE '' END || 'pe_aca' AS leads
FROM customer GROUP BY 1""")
def household_benefits(spark, sf_dir):
    people = B.table(spark, sf_dir, "customer").selectExpr(
        "c_nationkey AS household", "c_custkey * 0.25D AS medicaid",
        "c_acctbal < 3000 AS is_medicaid_eligible", "c_custkey * 0.5D AS aca_ptc")
    return P.benefit_leads(P.household_benefits(people)).withColumn(
        "leads", F.array_join("leads", ","))


@query("a18_review_count", f"""WITH {B.SQL_POLICY} SELECT count(*) FILTER (status = 'extracted') AS extracted,
 count(*) FILTER (needs_review) AS needs_review, count(*) FILTER (status = 'needs_ocr') AS needs_ocr FROM pol""")
def review_count(spark, sf_dir):
    return P.review_count(B.policies(spark, sf_dir))
