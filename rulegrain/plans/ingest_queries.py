"""Readers, page parsing, corpora and extraction over whole tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from rulegrain import schemas
from rulegrain.functions import markup as M
from rulegrain.functions import scalars as S
from rulegrain.operators import dedup as D
from rulegrain.operators import ingest as I
from rulegrain.operators import quality as Q
from rulegrain.operators.flatten import unnest_fields
from rulegrain.plans import bindings as B
from rulegrain.plans.registry import query
from rulegrain.session import scratch_path
from rulegrain.sources import readers, sinks

# --- rosters ---------------------------------------------------------------------------------

_RAW = """' {fac} ' || s_name AS "Facility Name", cast(s_suppkey as {str}) AS "Facility ID",
 CASE WHEN s_suppkey % 3 = 0 THEN ' ' ELSE lower(n_name) END AS "City/Town",
 CASE WHEN s_suppkey % 2 = 0 THEN ' co ' ELSE 'CO' END AS "State", '0' || s_nationkey AS "ZIP Code",
 CASE WHEN s_suppkey % 4 = 1 THEN '' ELSE 'EL D''' || n_name END AS "County/Parish",
 CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE '(555) 010-0000' END AS "Telephone Number",
 CASE s_suppkey % 7 WHEN 0 THEN 'Department of Defense' WHEN 1 THEN 'Veterans Health Administration' ELSE 'Proprietary' END AS "Hospital Ownership",
 CASE WHEN s_suppkey % 4 = 0 THEN 'Critical Access Hospitals' END AS "Hospital Type" """
_SQL_RAW = f"raw AS (SELECT s_suppkey AS pos, {_RAW.format(fac="st. o''brien", str='varchar')} FROM supplier JOIN nation ON s_nationkey = n_nationkey)"


def raw_roster(spark, sf_dir):
    """Header-named text columns as a roster file has them."""
    suppliers, nations = B.table(spark, sf_dir, "supplier"), B.table(spark, sf_dir, "nation")
    cells = _RAW.format(fac="st. o''brien", str="string").replace("''", "\\'")
    cells = cells.replace("THEN \\' ELSE", "THEN '' ELSE").replace('"', "`")
    joined = suppliers.join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.selectExpr("s_suppkey AS pos", *[c.strip() for c in B.split_top(cells)])


_SQL_NORMAL = f"""upper(trim("Facility Name")) AS hospital, "Facility ID" AS ccn, upper(trim("City/Town")) AS city,
 {B.sql_title('nullif(trim("County/Parish"), ' + "''" + ')')} AS county, "ZIP Code" AS zip, 'CO' AS state, "Telephone Number" AS phone,
 "Hospital Ownership" AS ownership, "Hospital Type" AS hospital_type, 'statutory' AS status"""


@query("p01_normalize_roster", f"WITH {_SQL_RAW} SELECT pos, {_SQL_NORMAL} FROM raw")
def normalize_roster(spark, sf_dir):
    return I.normalize_roster(raw_roster(spark, sf_dir), F.lit("CO"), extra=["pos"])


@query("p02_roster_filter", f"""WITH {_SQL_RAW} SELECT pos FROM raw
WHERE "Hospital Ownership" NOT IN ('Department of Defense', 'Veterans Health Administration')""")
def roster_filter(spark, sf_dir):
    return I.roster_filter(raw_roster(spark, sf_dir), "co").select("pos")


@query("io02_read_roster_csv", f"WITH {_SQL_RAW} SELECT {_SQL_NORMAL} FROM raw")
def read_roster_csv(spark, sf_dir):
    """Write the roster as CSV with a byte-order mark before the header, read it back."""
    path = scratch_path(spark, "roster-csv")
    rows = raw_roster(spark, sf_dir).drop("pos")
    marked = rows.withColumnRenamed("Facility Name", "﻿Facility Name")
    marked.write.option("header", True).csv(path)
    raw = readers.read_roster_csv(spark, path)
    return I.normalize_roster(raw, F.lit("CO"))


@query("l01_roster_by_name", f"""WITH {B.SQL_ROSTER} SELECT row_number() OVER (ORDER BY hospital, pos) AS line, pos, hospital FROM roster""")
def roster_by_name(spark, sf_dir):
    from rulegrain.operators.ranking import number_rows
    rows = B.roster(spark, sf_dir).select("pos", "hospital")
    return number_rows(rows, ["hospital", "pos"], "line")


@query("l02_first_rows", "SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 25")
def first_rows(spark, sf_dir):
    """The operator's own limit: the first rows in file order."""
    return B.table(spark, sf_dir, "part").select("p_partkey", "p_name").orderBy("p_partkey").limit(25)


# --- records, datasets, reports --------------------------------------------------------------


@query("io01_read_records", f"WITH {B.SQL_POLICY} SELECT hospital, permalink, status, fc, n_tiers, free_table_pct IS NULL AS no_table FROM pol")
def read_records(spark, sf_dir):
    """Extracted rows written as JSON and read with the declared schema."""
    path = scratch_path(spark, "records-json")
    B.policies(spark, sf_dir).drop("pos").write.json(path)
    rows = readers.read_records(spark, path, schemas.EXTRACTED_ROW, lines=True)
    table = F.col("free_care_income_ceiling_by_household")
    return rows.select(
        "hospital", "permalink", "status", F.col("policy.free_care.fpl_ceiling_pct").alias("fc"),
        F.size("policy.discount_payment.tiers").alias("n_tiers"),
        F.coalesce(F.size(table) <= 0, F.lit(True)).alias("no_table"))


@query("io01_broken_lines", f"""WITH {B.SQL_POLICY} SELECT status, cast(count_if(k % 97 <> 5) as bigint) AS records, cast(count_if(k % 97 = 5) as bigint) AS broken FROM pol GROUP BY 1""")
def broken_lines(spark, sf_dir):
    """Some lines are cut short: they come out beside the records, not as rows of nulls."""
    path = scratch_path(spark, "broken-json")
    line = F.to_json(F.struct(*[c for c in B.policies(spark, sf_dir).columns if c != "pos"]))
    cut = F.when(F.col("pos") % 97 == 5, F.expr("substring(line, 1, length(line) - 9)")).otherwise(F.col("line"))
    lines = B.policies(spark, sf_dir).withColumn("line", line).select(cut.alias("value"))
    lines.write.text(path)
    records, broken = readers.read_checked(spark, path, schemas.EXTRACTED_ROW)
    told = F.regexp_extract("corrupt", '"status":"([a-z_]+)"', 1)
    counts = records.groupBy("status").agg(F.count("*").alias("records"))
    lost = broken.groupBy(told.alias("status")).agg(F.count("*").alias("broken"))
    return counts.join(lost, "status", "full").select(
        "status", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("records", "broken")])


@query("io05_first_available", "SELECT p_type, count(*) AS n FROM part GROUP BY 1")
def first_available(spark, sf_dir):
    path = readers.first_available(spark, [f"{sf_dir}/extracted_full.parquet",
                                           f"{sf_dir}/part.parquet", f"{sf_dir}/supplier.parquet"])
    return spark.read.parquet(path).groupBy("p_type").agg(F.count("*").alias("n"))


@query("io06_write_dataset", f"WITH {B.SQL_POLICY} SELECT k, hospital, fc, status FROM pol")
def write_dataset(spark, sf_dir):
    root = scratch_path(spark, "dataset")
    rows = B.policies(spark, sf_dir).withColumnRenamed("pos", "k")
    path = sinks.write_dataset(rows, root, "1")
    return spark.read.schema(rows.schema).parquet(path).select(
        "k", "hospital", F.col("policy.free_care.fpl_ceiling_pct").alias("fc"), "status")


@query("io07_text_report", f"""WITH {B.SQL_POLICY} SELECT '## ' || hospital || '  (' || city || ', ' || coalesce(county, '') || ' County) #' || k AS line FROM pol""")
def text_report(spark, sf_dir):
    path = scratch_path(spark, "report")
    rows = B.policies(spark, sf_dir).select("hospital", "pos", F.concat(
        F.lit("## "), "hospital", F.lit("  ("), "city", F.lit(", "),
        F.coalesce("county", F.lit("")), F.lit(" County) #"), "pos").alias("line"))
    sinks.write_text_report(rows, path, ["hospital", "pos"])
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("io08_result_cache", """SELECT DISTINCT sha256(text) AS source_sha256, cast(length(text) as varchar) AS policy FROM documents""")
def result_cache(spark, sf_dir):
    """Two appends that overlap; reading gives each content once."""
    cache = sinks.ResultCache(spark, scratch_path(spark, "cache"),
                              "source_sha256 string, policy string")
    results = B.table(spark, sf_dir, "documents").select(
        F.sha2("text", 256).alias("source_sha256"), F.length("text").cast("string").alias("policy"))
    cache.append(results)
    cache.append(results)
    return cache.read()


@query("io09_raw_pages", "SELECT page_id, url, length(html) AS chars FROM pages")
def raw_pages(spark, sf_dir):
    return readers.raw_pages(spark, f"{sf_dir}/pages.parquet").select(
        "page_id", "url", F.length("html").cast("bigint").alias("chars"))


_HIT = """'{{"hits":{{"hits":[{{"_source":{{"post_title":"' || s_name || '","permalink":"https://x/' || s_suppkey || '","meta":{{"hfbp_city":[{{"value":"' || n_name || '"}},{{"value":"other"}}],"hfbp_zip":[],"hfbp_county":[{{"value":"' || s_nationkey || '"}}]}}}}}},{{"_source":{{"post_title":"second ' || s_suppkey || '","meta":{{}}}}}}]}}}}'""".replace("{{", "{").replace("}}", "}")


@query("io03_flatten_search_hits", """SELECT s_suppkey AS page, s_name AS post_title, 'https://x/' || s_suppkey AS permalink, n_name AS city, cast(null as varchar) AS zip,
 cast(s_nationkey as varchar) AS county FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT s_suppkey, 'second ' || s_suppkey, NULL, NULL, NULL, NULL FROM supplier""")
def flatten_search_hits(spark, sf_dir):
    responses = (B.table(spark, sf_dir, "supplier")
                 .join(B.table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
                 .selectExpr("s_suppkey AS page", f"{_HIT} AS body"))
    return I.flatten_search_hits(responses)


_LINE = """CASE event_id % 5 WHEN 0 THEN ''
 WHEN 1 THEN '{"custom_id":"c' || event_id || '","result":{"type":"errored","error":{"type":"overloaded","user":' || user_id || '}}}'
 WHEN 2 THEN '{"custom_id":"c' || event_id || '","result":{"type":"expired"}}'
 WHEN 3 THEN '{"custom_id":"c' || event_id || '","result":{"type":"succeeded","message":{"content":[{"type":"text"}]}}}'
 ELSE '{"custom_id":"c' || event_id || '","result":{"type":"succeeded","message":{"content":[{"type":"text"},{"type":"tool_use","input":{"value":' || user_id || '}}]}}}' END"""


@query("io04_read_jsonl_results", f"""WITH line AS (SELECT *, {_LINE} AS line FROM events), p AS (SELECT *, json_extract_string(line, '$.result.type') AS kind,
 json_extract(line, '$.result.message.content[1].input') AS made FROM line WHERE trim(line) <> '' AND event_type <> 'view')
SELECT md5(event_type || event_id) AS source_sha256, cast(made as varchar) AS policy, CASE WHEN kind = 'succeeded' AND made IS NULL THEN 'no tool_use block'
 WHEN kind <> 'succeeded' THEN 'batch_' || kind || ': ' || coalesce(cast(json_extract(line, '$.result.error') as varchar), '"' || kind || '"') END AS error FROM p""")
def read_jsonl_results(spark, sf_dir):
    """Result lines written as text, read back, joined to the known ids."""
    events = B.table(spark, sf_dir, "events")
    path = scratch_path(spark, "results")
    events.select(F.expr(_LINE).alias("value")).write.text(path)
    ids = events.filter("event_type <> 'view'").select(
        F.concat(F.lit("c"), "event_id").alias("custom_id"),
        F.md5(F.concat("event_type", "event_id")).alias("source_sha256"))
    return I.read_results(readers.result_lines(spark, path), ids)


# --- pages -----------------------------------------------------------------------------------

_SQL_CLEAN = r"""trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace({h},
 '<(script)[^a-z].*?</script>', ' ', 'gsi'), '<(style)[^a-z].*?</style>', ' ', 'gsi'), '<[^>]+>', ' ', 'gs'),
 '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&'), '&amp', '&'), '\s+', ' ', 'g'))"""


@query("t01_clean_text", f"SELECT page_id, md5({_SQL_CLEAN.format(h='html')}) AS clean FROM pages")
def clean_text(spark, sf_dir):
    return B.table(spark, sf_dir, "pages").select(
        "page_id", F.md5(M.clean_text(F.col("html"))).alias("clean"))


_DAY = "strftime(o_orderdate, '%m/%d/%Y')"
_LI = """'<li class="doc"><span class="date" x> ' || {day} || ' </span><a href="https://host/Attachment?id=' || {id} || '">x</a></li>'"""
_PAGE = ("""'<html><h2>Charity Care Policy</h2><ul>' || {a} || {b} || {a} || '<li><a href="/menu">no</a></li></ul><h3 class="f"> Application</h3><ul>' || {c} || '</ul>'
 || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '<h2>Discount Payment Policy</h2>' || CASE WHEN o_orderkey % 2 = 0 THEN {b} ELSE '<LI>none</LI>' END
 || '<a href="SearchDetail.aspx?oshpdid=' || o_custkey || '">old</a>' END || ' Debt Collection Policy ' || CASE WHEN o_orderkey % 5 = 0 THEN {d} ELSE '' END || '</html>'"""
 ).format(a=_LI.format(day="{day}", id="md5('a' || o_orderkey)"), b=_LI.format(day="'1/2/2020'", id="'b' || o_orderkey"),
          c=_LI.format(day="'3/4/2021'", id="'c' || o_orderkey"), d="'<li><a href=\"https://host/Attachment?id=d' || o_orderkey || '\">u</a></li>'")
_SPARK_PAGE = _PAGE.format(day="date_format(o_orderdate, 'MM/dd/yyyy')")


def _policy_pages(spark, sf_dir):
    return B.dealt(B.table(spark, sf_dir, "orders")).selectExpr("o_orderkey AS page", f"{_SPARK_PAGE} AS html")


_A, _Bu, _C, _D = ("'https://host/Attachment?id=' || md5('a' || o_orderkey)", "'https://host/Attachment?id=b' || o_orderkey",
                   "'https://host/Attachment?id=c' || o_orderkey", "'https://host/Attachment?id=d' || o_orderkey")


@query("t09_policy_page_parse", f"""SELECT o_orderkey AS page, 'charity_care' AS section, {_A} AS current_policy_url, {_DAY} AS current_effective_date,
 {_Bu} || '@1/2/2020' AS archived, {_C} AS application_url, '3/4/2021' AS application_effective_date, cast(null as varchar) AS archive_oshpdid FROM orders
UNION ALL SELECT o_orderkey, 'discount_payment', CASE WHEN o_orderkey % 2 = 0 THEN {_Bu} END, CASE WHEN o_orderkey % 2 = 0 THEN '1/2/2020' END, '', NULL, NULL,
 cast(o_custkey as varchar) FROM orders WHERE o_orderkey % 3 <> 0
UNION ALL SELECT o_orderkey, 'debt_collection', CASE WHEN o_orderkey % 5 = 0 THEN {_D} END, NULL, '', NULL, NULL, NULL FROM orders""")
def policy_page_parse(spark, sf_dir):
    parsed = I.parse_policy_pages(_policy_pages(spark, sf_dir))
    rows = parsed.withColumn("_entries", F.map_entries("policies"))
    flat = unnest_fields(rows, "_entries", ["page"]).select(
        "page", F.col("key").alias("section"), "value.*")
    archived = F.array_join(F.transform("archived_policies", lambda a: F.concat(
        a["url"], F.lit("@"), F.coalesce(a["effective_date"], F.lit("")))), " ")
    return flat.withColumn("archived", archived).drop("archived_policies")


@query("t10_top_level_id", """SELECT o_orderkey AS page, CASE WHEN o_orderkey % 3 <> 0 THEN cast(o_custkey as varchar) END AS archive_oshpdid FROM orders""")
def top_level_id(spark, sf_dir):
    return I.parse_policy_pages(_policy_pages(spark, sf_dir)).select("page", "archive_oshpdid")


_DETAIL = """'<html><style>p{}</style><body>Hospital: ' || p_name || ' ' || (p_partkey % 90 + 1) || ' Elm St<br>Total Beds: ' || p_size || '<b>Emergency Room: ' || p_type
 || '</b> web <i>https://h.org/' || p_partkey || '</i> Free Care: ' || (100 + p_partkey % 9 * 25) || CASE WHEN p_partkey % 4 = 0 THEN '' ELSE ' %' END
 || ' <p>FPL Range: ' || (p_size * 5) || '.5 %- ' || (p_size * 10) || ' %</p><p>FPL Range: 0% - 0.0% Payment Basis: Medicare</p> Policy Effective Date: 1/2/2020 &amp; '
 || 'Application Form Eff Date: 3/4/2021 call (555) 010-1234 now</body></html>'"""


@query("t11_detail_page_parse", f"""SELECT p_partkey AS page, p_name AS hospital, cast(p_size as varchar) AS total_beds, p_type AS emergency_room, 'https://h.org/' || p_partkey AS website,
 CASE WHEN p_partkey % 4 <> 0 THEN cast(100 + p_partkey % 9 * 25 as double) END AS free_care_fpl_pct, 'Medicare' AS discount_payment_basis, '1/2/2020' AS policy_effective_date,
 cast(null as varchar) AS discount_effective_date, '3/4/2021' AS application_effective_date, '(555) 010-1234' AS business_office_phone,
 (p_size * 5) || '.5-' || (p_size * 10) || '.0' AS tiers, cast(p_size * 10 as double) AS discount_ceiling,
 cast(round_even(33000 * (p_size * 10) / 100, 0) as bigint) AS discount_4 FROM part""")
def detail_page_parse(spark, sf_dir):
    pages = B.table(spark, sf_dir, "part").selectExpr("p_partkey AS page", f"{_DETAIL} AS html")
    parsed = I.parse_detail_pages(pages)
    tiers = F.array_join(F.transform("discount_tiers", lambda t: F.concat(
        t["fpl_low_pct"].cast("string"), F.lit("-"), t["fpl_high_pct"].cast("string"))), ",")
    table = F.col("discount_income_ceiling_by_household")
    return parsed.withColumn("tiers", tiers).withColumn("discount_4", S.dollars_for(table, F.lit(4))) \
        .drop("discount_tiers", "free_care_income_ceiling_by_household",
              "discount_income_ceiling_by_household")


@query("p08_drop_empty_tiers", f"""WITH {B.SQL_POLICY}, {B.SQL_TIERS}, z AS (SELECT k, lo, CASE WHEN k % 3 = 0 AND lo IS NULL THEN 0 WHEN k % 5 = 0 AND pays = 50 THEN 0 ELSE hi END AS hi,
 CASE WHEN k % 5 = 0 AND pays = 50 THEN 0 ELSE lo END AS lo2 FROM tier)
SELECT k, count(*) FILTER (lo2 <> 0 OR hi <> 0) AS kept, max(hi) FILTER (lo2 <> 0 OR hi <> 0) AS ceiling FROM z GROUP BY k
UNION ALL SELECT k, 0, NULL FROM pol WHERE n_tiers = 0""")
def drop_empty_tiers(spark, sf_dir):
    zero = F.lit(0.0)
    emptied = F.transform("policy.discount_payment.tiers", lambda t: F.struct(
        F.when((F.col("pos") % 5 == 0) & (t["patient_pays_pct"] == 50), zero)
         .otherwise(t["fpl_low_pct"]).alias("fpl_low_pct"),
        F.when((F.col("pos") % 3 == 0) & t["fpl_low_pct"].isNull(), zero)
         .when((F.col("pos") % 5 == 0) & (t["patient_pays_pct"] == 50), zero)
         .otherwise(t["fpl_high_pct"]).alias("fpl_high_pct")))
    kept = B.policies(spark, sf_dir).select(F.col("pos").alias("k"),
                                            I.drop_empty_tiers(emptied).alias("tiers"))
    return kept.select("k", F.size("tiers").cast("bigint").alias("kept"),
                       I.ceiling_of(F.col("tiers")).alias("ceiling"))


@query("t12_link_id_harvest", r"""WITH linked AS (SELECT page_id, regexp_extract_all(
 html || '<a href=''/SearchDetail.aspx?oshpdid=' || page_id || '''>x</a><a href=''/SearchDetail.aspx?oshpdid=7''></a><a href=''/SearchDetail.aspx?oshpdid=' || page_id || '''>',
 'oshpdid=([0-9]+)', 1) AS ids FROM pages)
SELECT page_id, array_to_string(list_transform(list_sort(list_distinct(list_transform(ids, lambda x: list_position(ids, x)))), lambda i: ids[i]), ',') AS ids FROM linked""")
def link_id_harvest(spark, sf_dir):
    html = F.expr("html || \"<a href='/SearchDetail.aspx?oshpdid=\" || page_id || \"'>x</a>"
                  "<a href='/SearchDetail.aspx?oshpdid=7'></a><a href='/SearchDetail.aspx?oshpdid=\" || page_id || \"'>\"")
    ids = I.harvest_ids(html)
    return B.table(spark, sf_dir, "pages").select("page_id", F.array_join(ids, ",").alias("ids"))


@query("p09_url_ok", """SELECT page_id, page_id % 3 <> 0 AS ok FROM pages""")
def url_ok(spark, sf_dir):
    url = F.expr("CASE page_id % 3 WHEN 0 THEN replace(url, 'http', 'ftp') ELSE url END")
    return B.table(spark, sf_dir, "pages").select("page_id", S.url_ok(url).alias("ok"))


# --- corpora and extraction ------------------------------------------------------------------

_DOC_URL = "concat('https://h/a?id=', lpad(cast({} as {}), 36, '0'))"


def corpus_records(spark, sf_dir):
    """Each document's record points at its own text and at two earlier ones."""
    def url(expr):
        return f"named_struct('current_policy_url', {_DOC_URL.format(expr, 'string')})"
    return B.table(spark, sf_dir, "documents").selectExpr("doc_id", f"""map('charity_care', {url('doc_id')},
      'discount_payment', {url('cast(floor(doc_id / 2) as bigint)')},
      'debt_collection', {url('cast(floor(doc_id / 3) as bigint)')}) AS policies""")


@query("t07_build_corpus", """WITH piece AS (SELECT doc_id, 0 AS o, 'CHARITY_CARE' AS s, doc_id AS t FROM documents
 UNION ALL SELECT doc_id, 1, 'DISCOUNT_PAYMENT', doc_id // 2 FROM documents WHERE doc_id // 2 <> doc_id
 UNION ALL SELECT doc_id, 2, 'DEBT_COLLECTION', doc_id // 3 FROM documents WHERE doc_id // 3 <> doc_id AND doc_id // 3 <> doc_id // 2),
c AS (SELECT p.doc_id, string_agg('===== ' || s || ' POLICY =====' || chr(10) || d.text, chr(10) || chr(10) ORDER BY o) AS corpus
 FROM piece p JOIN documents d ON d.doc_id = p.t WHERE trim(d.text) <> '' GROUP BY 1)
SELECT doc_id, md5(coalesce(corpus, '')) AS corpus_md5, length(coalesce(corpus, '')) > 200000 AS truncated FROM documents LEFT JOIN c USING (doc_id)""")
def build_corpus(spark, sf_dir):
    texts = B.table(spark, sf_dir, "documents").selectExpr(
        "lpad(cast(doc_id as string), 36, '0') AS guid", "text")
    signed = I.corpus_signatures(corpus_records(spark, sf_dir))
    corpora = I.build_corpora(signed, texts).select(
        "signature", F.md5("corpus").alias("corpus_md5"), "truncated")
    return signed.select("doc_id", "signature").join(corpora, "signature").drop("signature")


_POLICY_LINE = """CASE doc_id % 6 WHEN 0 THEN '' WHEN 1 THEN chr(10) || 'Full Charity is for those at ' || (60 + doc_id % 300) || '% of the Federal Poverty Level' || chr(10) || 'up to 350% FPL.'
 WHEN 2 THEN chr(10) || 'Patients at or below ' || (doc_id % 500) || ' % of the FPL and 400% fpl' WHEN 3 THEN chr(10) || (120 + doc_id % 100) || '% or less of the federal poverty line' || chr(13) || 'up to 999% FPL'
 WHEN 4 THEN chr(10) || 'FPL limit ' || (70 + doc_id % 90) || '% or less' ELSE ' 20% FPL' END"""
_CUE = r"(?i)full charity|free care|zero \(full|100%\s*(?:charity|assistance)|charity care"
_FPLP = r"(?i)([0-9]{2,3})\s*%\s*(?:of\s*(?:the\s*)?)?(?:federal poverty|fpl)"
_SQL_FREE = [r"(?i)([0-9]{2,3})\s*%\s*(?:or less|and below|or below).{0,60}?(?:federal poverty|fpl)",
             r"(?i)(?:at or below|below|up to|less than or equal to)\s*([0-9]{2,3})\s*%.{0,40}?(?:federal poverty|fpl)",
             r"(?i)(?:federal poverty level|fpl)[^.\n]{0,60}?([0-9]{2,3})\s*%\s*(?:or less|and below)"]
_SQL_PARSED = f"""d AS (SELECT doc_id, text || {_POLICY_LINE} AS t FROM documents),
ln AS (SELECT doc_id, generate_subscripts(x, 1) AS i, unnest(x) AS line FROM (SELECT doc_id, string_split_regex(t, '\\r\\n|[\\n\\r]') AS x FROM d)),
cue AS (SELECT doc_id, try_cast(regexp_extract(line, '{_FPLP}', 1) as int) AS v, i FROM ln WHERE regexp_matches(line, '{_CUE}')),
best AS (SELECT doc_id, arg_min(v, i) AS v FROM cue WHERE v BETWEEN 50 AND 300 GROUP BY 1),
pats AS (SELECT doc_id, {", ".join(f"try_cast(regexp_extract(t, '{p}', 1) as int) AS v{i}" for i, p in enumerate(_SQL_FREE))},
 list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(t, '{_FPLP}', 1), lambda x: cast(x as int)), lambda x: x BETWEEN 50 AND 400))) AS seen FROM d),
parsed AS (SELECT doc_id, coalesce(best.v, CASE WHEN v0 BETWEEN 50 AND 400 THEN v0 END, CASE WHEN v1 BETWEEN 50 AND 400 THEN v1 END,
 CASE WHEN v2 BETWEEN 50 AND 400 THEN v2 END) AS free_care_fpl_pct, seen, list_max(seen) AS discount_max_fpl_pct FROM pats LEFT JOIN best USING (doc_id)),
rated AS (SELECT *, CASE WHEN free_care_fpl_pct <= discount_max_fpl_pct THEN 'high' WHEN free_care_fpl_pct IS NOT NULL OR discount_max_fpl_pct IS NOT NULL THEN 'medium' ELSE 'low' END AS confidence FROM parsed)"""


def policy_texts(spark, sf_dir):
    return B.table(spark, sf_dir, "documents").selectExpr(
        "doc_id", f"text || {_POLICY_LINE.replace('chr(', 'char(')} AS text")


@query("t08_heuristic_rules", f"WITH {_SQL_PARSED} SELECT doc_id, free_care_fpl_pct, discount_max_fpl_pct, confidence FROM rated")
def heuristic_rules(spark, sf_dir):
    return I.parse_rules(policy_texts(spark, sf_dir)).select(
        "doc_id", "free_care_fpl_pct", "discount_max_fpl_pct", "confidence")


@query("a13_confidence_counts", f"WITH {_SQL_PARSED} SELECT confidence, count(*) AS n FROM rated GROUP BY 1")
def confidence_counts(spark, sf_dir):
    from rulegrain.operators.reports import confidence_counts as count
    return count(I.parse_rules(policy_texts(spark, sf_dir)))


@query("a14_pcts_seen", f"WITH {_SQL_PARSED} SELECT doc_id, array_to_string(seen, ',') AS seen, list_max(seen) AS top FROM rated")
def pcts_seen(spark, sf_dir):
    seen = policy_texts(spark, sf_dir).withColumn("pcts", M.fpl_percents_seen(F.col("text")))
    return seen.select("doc_id", F.array_join("pcts", ",").alias("seen"),
                       F.array_max("pcts").alias("top"))


@query("p05_provenance", """SELECT 'doc ' || doc_id AS hospital, 'https://h/a?id=' || lpad(cast(doc_id as varchar), 36, '0') AS charity_policy_url,
 'https://h/a?id=' || lpad(cast(doc_id // 2 as varchar), 36, '0') AS discount_policy_url, 'rules-1' AS model, '2026-08-03T00:00:00+00:00' AS extracted_at, sha256(text) AS source_sha256 FROM documents""")
def provenance(spark, sf_dir):
    texts = B.table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "sha2(text, 256) AS source_sha256", "source AS city", "lang AS county")
    none = F.lit(None).cast("string")
    records = corpus_records(spark, sf_dir).withColumn("policies", F.transform_values(
        "policies", lambda _, v: F.struct(v["current_policy_url"].alias("current_policy_url"),
                                          none.alias("current_effective_date"),
                                          none.alias("application_url"))))
    full = (records.join(texts, "doc_id").withColumn("post_title", F.concat(F.lit("doc "), "doc_id"))
            .withColumns({c: none for c in ("archive_oshpdid", "zip", "permalink")}))
    return I.provenance(full, "rules-1", "2026-08-03T00:00:00+00:00").select(
        "hospital", "charity_policy_url", "discount_policy_url", "model", "extracted_at",
        "source_sha256")


def _count_words(batches):
    """A user's extractor: one result per content, errors as text."""
    for frame in batches:
        words = frame["text"].str.split().map(len)
        yield pd.DataFrame({
            "source_sha256": frame["source_sha256"],
            "policy": words.map(lambda n: f'{{"words": {n}}}' if n >= 100 else None),
            "error": words.map(lambda n: None if n >= 100 else "too short")})


@query("f02_extraction_backend", r"""WITH u AS (SELECT DISTINCT sha256(text) AS source_sha256, text FROM documents WHERE length(trim(text)) >= 500),
w AS (SELECT source_sha256, len(regexp_extract_all(text, '\S+')) AS n FROM u)
SELECT source_sha256, CASE WHEN n >= 100 THEN '{"words": ' || n || '}' END AS policy, CASE WHEN n < 100 THEN 'too short' END AS error FROM w""")
def extraction_backend(spark, sf_dir):
    docs = B.table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "pos")
    unique = D.unique_texts(D.with_content_sha(docs))
    return I.extract_with(unique, _count_words, "source_sha256 string, policy string, error string")


@query("f03_document_text_hook", """SELECT lpad(cast(doc_id as varchar), 36, '0') AS guid, md5('page 1: ' || text) AS text_md5 FROM documents""")
def document_text_hook(spark, sf_dir):
    """A binary-to-text function applied to stored documents."""
    files = B.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("docs/"), F.lpad(F.col("doc_id").cast("string"), 36, "0"),
                 F.lit(".pdf")).alias("path"), F.encode("text", "UTF-8").alias("content"))
    texts = I.text_of_binary(files, F.concat(F.lit("page 1: "), F.decode("content", "UTF-8")))
    return texts.select("guid", F.md5("text").alias("text_md5"))
