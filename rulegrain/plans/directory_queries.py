"""Names, slugs, pages and message catalogs."""

from __future__ import annotations

from pyspark.sql import functions as F

from rulegrain import reference_values as V
from rulegrain.functions import scalars as S
from rulegrain.operators import catalog as C
from rulegrain.operators import directory as Y
from rulegrain.operators import eligibility as E
from rulegrain.operators import reports as P
from rulegrain.operators.flatten import unnest
from rulegrain.operators.ranking import number_rows
from rulegrain.plans import bindings as B
from rulegrain.plans.eligibility_queries import SQL_SCORED, SQL_TIER, scored_bills
from rulegrain.plans.registry import query

# --- names with collisions: parts ------------------------------------------------------------


def named_rows(spark, sf_dir):
    return B.table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS pos", "upper(p_name) AS hospital", "p_brand AS city", "p_partkey AS oshpdid")


_SQL_NAMED = "named AS (SELECT p_partkey AS pos, upper(p_name) AS hospital, p_brand AS city FROM part)"
_SQL_LABELLED = f"""{_SQL_NAMED}, counted AS (SELECT *, count(*) OVER (PARTITION BY hospital) AS n FROM named),
labelled AS (SELECT *, n > 1 AS shared, {B.sql_title('hospital')} || CASE WHEN n > 1 THEN ' (' || {B.sql_title('city')} || ')' ELSE '' END AS label FROM counted),
idx AS (SELECT hospital AS key, min(pos) * 2 AS ord, min(pos) AS target FROM named GROUP BY 1
 UNION ALL SELECT upper(label), min(pos) * 2 + 1, max(pos) FROM labelled WHERE shared GROUP BY 1)"""


# names that hold another row's city, so that base, city and id forms displace one another
_SLUG_NAME = "CASE WHEN p_partkey % 5 = 3 THEN concat(p_name, ' ', p_brand) WHEN p_partkey % 11 = 4 THEN concat(p_name, ' ', p_brand, ' ', p_brand) ELSE p_name END"


@query("w01_slug_assignment", f"""WITH RECURSIVE named AS (SELECT row_number() OVER (ORDER BY p_partkey) AS rn, p_partkey AS pos, {B.sql_slug(_SLUG_NAME)} AS base,
 {B.sql_slug(f"{_SLUG_NAME} || '-' || p_brand")} AS cs FROM part),
walk AS (SELECT 0::BIGINT AS rn, 0::BIGINT AS pos, '' AS slug, cast([] AS VARCHAR[]) AS taken
 UNION ALL SELECT rn, pos, slug, list_append(taken, slug) FROM (SELECT n.rn, n.pos, w.taken, CASE WHEN NOT list_contains(w.taken, base) THEN base
  WHEN NOT list_contains(w.taken, cs) THEN cs ELSE base || '-' || n.pos END AS slug FROM walk w JOIN named n ON n.rn = w.rn + 1))
SELECT pos, slug, pos = max(pos) OVER (PARTITION BY slug) AS owner FROM walk WHERE rn > 0""")
def slug_assignment(spark, sf_dir):
    rows = B.table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS pos", f"{_SLUG_NAME} AS hospital", "p_brand AS city", "p_partkey AS oshpdid")
    return Y.assign_slugs(rows).select("pos", "slug", "owner")


@query("w02_name_labels", f"WITH {_SQL_LABELLED} SELECT pos, label FROM labelled")
def name_labels(spark, sf_dir):
    return Y.name_labels(named_rows(spark, sf_dir)).select("pos", "label")


@query("a17_label_list", f"WITH {_SQL_LABELLED} SELECT DISTINCT label FROM labelled ORDER BY label")
def label_list(spark, sf_dir):
    return P.labels(Y.name_labels(named_rows(spark, sf_dir)))


_ASKED = """CASE c_custkey % 6 WHEN 0 THEN lower(p_name) WHEN 1 THEN p_name || ' (' || p_brand || ')'
 WHEN 2 THEN ' ' || substr(p_name, 3, 6) || ' ' WHEN 3 THEN substr(p_name, 1, 3) WHEN 4 THEN c_name ELSE 'nothing like it' END"""
_ASKED_ID = "CASE WHEN c_custkey % 10 = 7 THEN c_custkey END"


def lookup_requests(spark, sf_dir):
    customers, parts = B.table(spark, sf_dir, "customer"), B.table(spark, sf_dir, "part")
    return customers.join(parts, F.col("c_custkey") == F.col("p_partkey")).selectExpr(
        "c_custkey AS id", f"{_ASKED} AS name", f"{_ASKED_ID} AS oshpdid")


SQL_LOOKUP = f"""{_SQL_LABELLED}, ask AS (SELECT c_custkey AS id, {_ASKED} AS name, {_ASKED_ID} AS oshpdid FROM customer JOIN part ON c_custkey = p_partkey),
within AS (SELECT needle, arg_min(target, ord) AS target FROM (SELECT DISTINCT trim(upper(name)) AS needle FROM ask) JOIN idx ON contains(key, needle)
 WHERE length(needle) >= 4 GROUP BY 1),
looked AS (SELECT a.id, a.name, a.oshpdid, coalesce(a.oshpdid, e.target, w.target) AS target FROM ask a LEFT JOIN idx e ON e.key = upper(a.name) LEFT JOIN within w ON w.needle = trim(upper(a.name)))"""


def looked_up(spark, sf_dir):
    rows = named_rows(spark, sf_dir)
    ids = rows.select("oshpdid", F.col("pos").alias("target"))
    return Y.find_hospitals(lookup_requests(spark, sf_dir), Y.name_index(rows), ids)


@query("j09_hospital_lookup", f"WITH {SQL_LOOKUP} SELECT id, name, target FROM looked")
def hospital_lookup(spark, sf_dir):
    return looked_up(spark, sf_dir).select("id", "name", "target")


@query("j11_match_or_generic", f"""WITH {SQL_LOOKUP}, g AS (SELECT *, id % 2 = 0 AS generic FROM looked)
SELECT id, CASE WHEN target IS NOT NULL THEN 'hospital' WHEN generic THEN 'generic' ELSE 'hospital not found' END AS outcome FROM g""")
def match_or_generic(spark, sf_dir):
    asked = looked_up(spark, sf_dir).withColumn("generic", F.col("id") % 2 == 0)
    served, rejected = E.match_or_generic(asked, F.col("target").isNotNull())
    return served.select("id", F.col("route").alias("outcome")).unionByName(
        rejected.select("id", F.col("error").alias("outcome")))


@query("j11_generic_plan", f"""WITH {B.SQL_INTAKE}, i AS (SELECT *, {B.sql_pct('annual_income', 'household_size')} AS fpl_pct,
 insurance <> '' AND lower(insurance) NOT IN ('none', 'uninsured', 'self-pay') AS insured FROM intake)
SELECT intake_id, 'unknown' AS tier, 'cc_no_hospital' AS message, {B.sql_title('full_name')} AS name, CASE WHEN insured THEN 'ben_insured' WHEN fpl_pct <= 138 THEN 'ben_medicaid_heuristic'
 WHEN fpl_pct <= 400 THEN 'ben_aca_heuristic' ELSE 'ben_over_heuristic' END AS benefit, cast(3 + cast(in_collections as int) as int) AS closing_step FROM i""")
def generic_plan(spark, sf_dir):
    intakes = B.intakes(spark, sf_dir).withColumn("hospital_name", F.col("full_name")).withColumn(
        "fpl_pct", S.fpl_percent(F.col("annual_income"), F.col("household_size")))
    return E.generic_plan(intakes).select(
        "intake_id", "plan.tier", "plan.charity.message", "plan.hospital.name",
        F.get("plan.benefits", F.lit(0)).alias("benefit"), "plan.closing_step")


@query("j10_statutory_id_lookup", f"""WITH {B.SQL_ROSTER}, ask AS (SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'IL' WHEN 1 THEN 'NY' ELSE 'CO' END AS state,
 cast(500000 + c_custkey as varchar) AS ccn FROM customer)
SELECT a.id, r.pos AS target FROM ask a LEFT JOIN roster r ON r.state = a.state AND r.ccn = a.ccn""")
def statutory_id_lookup(spark, sf_dir):
    asked = B.table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS id", "CASE c_custkey % 3 WHEN 0 THEN 'IL' WHEN 1 THEN 'NY' ELSE 'CO' END AS state",
        "CAST(500000 + c_custkey AS STRING) AS ccn")
    return Y.find_by_ccn(asked, B.roster(spark, sf_dir)).select("id", "target")


# --- roster listings -------------------------------------------------------------------------


def slugged_roster(spark, sf_dir):
    return B.roster(spark, sf_dir).withColumn("slug", S.slugify(F.col("hospital")))


_SQL_SLUGGED = f"{B.SQL_ROSTER}, slugged AS (SELECT *, {B.sql_slug('hospital')} AS slug FROM roster)"


@query("j14_nearby_peers", f"""WITH {_SQL_SLUGGED}, r AS (SELECT a.slug, a.county, b.slug AS peer, b.pos, row_number() OVER (PARTITION BY a.pos ORDER BY b.pos) AS rn
 FROM slugged a JOIN slugged b ON a.county = b.county AND a.slug <> b.slug)
SELECT slug, county, string_agg(peer, ',' ORDER BY pos) AS peers FROM r WHERE rn <= 10 GROUP BY ALL""")
def nearby_peers(spark, sf_dir):
    return Y.nearby_peers(slugged_roster(spark, sf_dir)).withColumn(
        "peers", F.array_join("peers", ","))


@query("a10_region_counts", f"WITH {B.SQL_ROSTER} SELECT state, count(*) AS n FROM roster GROUP BY 1")
def region_counts(spark, sf_dir):
    return P.region_counts(B.roster(spark, sf_dir))


@query("a11_county_index", f"""WITH {B.SQL_ROSTER} SELECT {B.sql_slug('county')} AS county_slug, arg_min(county, pos) AS name FROM roster WHERE county IS NOT NULL GROUP BY 1""")
def county_index(spark, sf_dir):
    return Y.county_index(B.roster(spark, sf_dir))


@query("a12_directory_grouping", f"""WITH {_SQL_SLUGGED}, l AS (SELECT coalesce(county, 'Other') AS county, hospital, slug FROM slugged)
SELECT county, hospital, slug, row_number() OVER (PARTITION BY county ORDER BY hospital, slug) AS rank, count(*) OVER (PARTITION BY county) AS size FROM l""")
def directory_grouping(spark, sf_dir):
    return Y.directory(slugged_roster(spark, sf_dir))


@query("w06_numbered_index", f"""WITH {B.SQL_ROSTER} SELECT row_number() OVER (ORDER BY coalesce(county, ''), hospital, pos) AS line, county, hospital FROM roster""")
def numbered_index(spark, sf_dir):
    rows = B.roster(spark, sf_dir).select(F.coalesce("county", F.lit("")).alias("_county"),
                                          "hospital", "pos", "county")
    return number_rows(rows, ["_county", "hospital", "pos"], "line").select("line", "county", "hospital")


@query("l03_top_peers_and_documents", """SELECT o_custkey, string_agg(cast(o_orderkey as varchar), ',' ORDER BY o_orderkey) AS documents FROM
 (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 6) GROUP BY 1""")
def top_documents(spark, sf_dir):
    """The six documents a page shows; each customer's cut happens before the shuffle."""
    from pyspark.sql import Window as W
    w = W.partitionBy("o_custkey").orderBy("o_orderkey")
    six = B.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey") \
        .withColumn("rn", F.row_number().over(w)).filter("rn <= 6")
    grouped = six.groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("d"))
    return grouped.select("o_custkey", F.array_join("d", ",").alias("documents"))


_LANGS = "(VALUES " + ",".join(f"('{c}')" for c in V.LANGUAGES) + ") l(lang)"
_SQL_URL = """'https://example.org' || CASE WHEN lang = 'en' THEN '/' ELSE '/' || lang || '/' END || CASE WHEN {state} = 'CA' THEN '' ELSE lower({state}) || '/' END || {seg}"""


@query("j18_language_fanout", f"""WITH {_SQL_SLUGGED} SELECT pos, lang, {_SQL_URL.format(state="coalesce(state, 'CA')", seg="'hospital/' || slug")} AS url FROM slugged, {_LANGS}""")
def language_fanout(spark, sf_dir):
    pages = slugged_roster(spark, sf_dir)
    state = F.coalesce("state", F.lit("CA"))
    return Y.page_urls(pages, "https://example.org", F.lit("hospital"), F.col("slug"), state) \
            .select("pos", "lang", "url")


@query("u02_url_union", f"""WITH {_SQL_SLUGGED}, counties AS (SELECT DISTINCT {B.sql_slug('county')} AS cs FROM roster WHERE county IS NOT NULL)
SELECT {_SQL_URL.format(state="coalesce(state, 'CA')", seg="'hospital/' || slug")} AS url FROM slugged, {_LANGS}
UNION ALL SELECT {_SQL_URL.format(state="'CA'", seg="'hospitals/' || cs")} FROM counties, {_LANGS}""")
def url_union(spark, sf_dir):
    rows = slugged_roster(spark, sf_dir)
    counties = Y.county_index(rows)
    hospital_urls = Y.page_urls(rows, "https://example.org", F.lit("hospital"), F.col("slug"),
                                F.coalesce("state", F.lit("CA")))
    county_urls = Y.page_urls(counties, "https://example.org", F.lit("county"),
                              F.col("county_slug"), F.lit("CA"))
    return hospital_urls.select("url").unionByName(county_urls.select("url"))


@query("u03_hub_union", f"""WITH {B.sql_rules()}, {B.SQL_ROSTER} SELECT 'California' AS name, 'CA' AS code, count(*) AS hospitals FROM part
UNION ALL SELECT r.name, s.state, count(*) FROM roster s JOIN rules r ON r.code = s.state WHERE r.free_pct IS NOT NULL OR r.discount_pct IS NOT NULL GROUP BY ALL""")
def hub_union(spark, sf_dir):
    """The home state's own rows, then every statutory state of the roster."""
    from rulegrain import rules as R
    home = named_rows(spark, sf_dir).agg(F.count("*").alias("hospitals")).select(
        F.lit("California").alias("name"), F.lit("CA").alias("code"), "hospitals")
    statutory = (R.with_rules(B.roster(spark, sf_dir))
                 .filter(R.is_statutory(F.col("rules")))
                 .groupBy("rules.name", F.col("rules.code").alias("code"))
                 .agg(F.count("*").alias("hospitals")))
    return home.unionByName(statutory)


@query("r19_page_metadata", f"""WITH {B.SQL_POLICY}, l AS (SELECT *, CASE WHEN k % 2 = 0 THEN 'en' ELSE 'es' END AS lang FROM pol)
SELECT k, '{{"@type":"BreadcrumbList","itemListElement":[{{"@type":"ListItem","position":1,"name":"Home","item":"https://e/"}},{{"@type":"ListItem","position":2,"name":"'
 || {B.sql_title('hospital')} || '","item":"https://e/' || k || '"}}]}}' AS crumb,
 CASE WHEN lang = 'en' THEN concat_ws(',', CASE WHEN free_table_pct > 0 AND fc > 0 THEN 'faq_free' END, 'faq_assistance', CASE WHEN coalesce(phone, '') <> '' THEN 'faq_apply' END) END AS faq FROM l""")
def page_metadata(spark, sf_dir):
    rows = B.policies(spark, sf_dir).withColumnRenamed("pos", "k")
    crumb = Y.breadcrumb([F.lit("Home"), S.py_title(F.col("hospital"))],
                         [F.lit("https://e/"), F.concat(F.lit("https://e/"), "k")])
    lang = F.when(F.col("k") % 2 == 0, F.lit("en")).otherwise(F.lit("es"))
    faq = Y.faq_keys(lang, S.dollars_for(F.col("free_care_income_ceiling_by_household"), F.lit(4)),
                     F.col("policy.free_care.fpl_ceiling_pct"), F.col("policy.contact.phone"))
    return rows.select("k", F.to_json(crumb).alias("crumb"), F.array_join(faq, ",").alias("faq"))


# --- catalogs: documents by language ---------------------------------------------------------

_KEY = "'text' || cast(floor(doc_id / 3) as {s})"  # three documents a key, of different sections: none is lost
_TEMPLATE = """text || CASE WHEN lang = 'de' AND doc_id % 5 = 0 THEN ' {pct} {nome}' ELSE ' {pct:.0f} {name}' END
 || CASE WHEN doc_id % 3 = 0 THEN ' <a href="https://h/' || (doc_id % 4) || '">RulesEngine</a>' ELSE '' END"""
_SQL_CATALOG = f"""entries AS (SELECT lang, 'sec' || (doc_id % 3) AS section, {_KEY.format(s='bigint')} AS key, doc_id, CASE WHEN doc_id % 11 = 0 THEN '' ELSE {_TEMPLATE} END AS template FROM documents),
catalog AS (SELECT lang, section, key, arg_min(template, doc_id) AS template FROM entries GROUP BY ALL)"""


def catalog(spark, sf_dir):
    entries = B.table(spark, sf_dir, "documents").selectExpr(
        "lang", "concat('sec', doc_id % 3) AS section", f"{_KEY.format(s='bigint')} AS key", "doc_id",
        f"CASE WHEN doc_id % 11 = 0 THEN '' ELSE {_TEMPLATE} END AS template")
    return entries.groupBy("lang", "section", "key").agg(
        F.min_by("template", "doc_id").alias("template"))


_ORDER = ["sec1", "sec0", "sec2"]
_SQL_OVERLAY = """merged AS (SELECT lang, key, template, section FROM catalog
 QUALIFY row_number() OVER (PARTITION BY lang, key ORDER BY CASE section WHEN 'sec1' THEN 0 WHEN 'sec0' THEN 1 ELSE 2 END DESC) = 1)"""


@query("u04_string_overlay", f"WITH {_SQL_CATALOG}, {_SQL_OVERLAY} SELECT lang, key, section, md5(template) AS text_md5 FROM merged")
def string_overlay(spark, sf_dir):
    merged = C.overlay(catalog(spark, sf_dir), _ORDER)
    return merged.select("lang", "key", "section", F.md5("template").alias("text_md5"))


_WANT = """event_id, CASE event_type WHEN 'view' THEN 'en' WHEN 'click' THEN 'es' WHEN 'signup' THEN 'fr' WHEN 'error' THEN 'de' ELSE 'zh' END AS lang,
 'text' || (event_id % 300) AS key"""


@query("j17_catalog_fallback", f"""WITH {_SQL_CATALOG}, {_SQL_OVERLAY}, want AS (SELECT {_WANT} FROM events), full_text AS (SELECT * FROM merged WHERE coalesce(template, '') <> '')
SELECT w.event_id, md5(coalesce(o.template, e.template)) AS text_md5 FROM want w LEFT JOIN full_text o ON o.lang = w.lang AND o.key = w.key
 LEFT JOIN full_text e ON e.lang = 'en' AND e.key = w.key""")
def catalog_fallback(spark, sf_dir):
    wanted = B.table(spark, sf_dir, "events").selectExpr(*[c.strip() for c in B.split_top(_WANT)])
    merged = C.overlay(catalog(spark, sf_dir), _ORDER)
    return C.resolve(wanted, merged).select("event_id", F.md5("template").alias("text_md5"))


@query("u05_key_gaps", f"""WITH {_SQL_CATALOG}, en AS (SELECT DISTINCT section, key FROM catalog WHERE lang = 'en'), langs AS (SELECT DISTINCT lang FROM catalog WHERE lang <> 'en'),
allowed AS (SELECT DISTINCT 'sec' || (doc_id % 3) AS section, {_KEY.format(s='bigint')} AS key FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)
SELECT lang, section, key FROM (SELECT * FROM en, langs) ANTI JOIN catalog USING (lang, section, key) ANTI JOIN allowed USING (section, key)""")
def key_gaps(spark, sf_dir):
    labels = B.table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")
    allowed = B.table(spark, sf_dir, "documents").join(labels, "doc_id").selectExpr(
        "concat('sec', doc_id % 3) AS section", f"{_KEY.format(s='bigint')} AS key")
    return C.key_gaps(catalog(spark, sf_dir), allowed)


@query("u05_complete_languages", f"""WITH {_SQL_CATALOG}, need AS (SELECT DISTINCT section, key FROM catalog WHERE lang = 'es'),
h AS (SELECT lang, count(*) AS present FROM catalog SEMI JOIN need USING (section, key) GROUP BY 1), l AS (SELECT DISTINCT lang FROM catalog),
r AS (SELECT lang, coalesce(present, 0) AS present, (SELECT count(*) FROM need) AS wanted FROM l LEFT JOIN h USING (lang))
SELECT *, CASE WHEN present = wanted THEN 'full' WHEN present = 0 THEN 'none' ELSE 'partial' END AS state FROM r""")
def complete_languages(spark, sf_dir):
    table = catalog(spark, sf_dir)
    return C.complete_languages(table, table.filter("lang = 'es'").select("section", "key"))


_SQL_FIELDS = r"list_sort(list_distinct(regexp_extract_all({t}, '\{([A-Za-z_]+)(?::[^}]*)?\}', 1)))"
_SQL_TAG = " ".join(f"CASE WHEN length(t) - length(replace(t, '{tag}', '')) <> length(e) - length(replace(e, '{tag}', '')) THEN 'count {tag}' END," for tag in V.PINNED_TAGS)


@query("r18_catalog_drift", f"""WITH {_SQL_CATALOG}, {_SQL_OVERLAY}, p AS (SELECT m.lang, m.key, m.template AS t, e.template AS e FROM merged m JOIN merged e ON e.lang = 'en' AND e.key = m.key
 WHERE m.lang <> 'en' AND m.template <> '' AND e.template <> '')
SELECT lang, key, concat_ws(',', CASE WHEN contains(t, 'RulesEngine') <> contains(e, 'RulesEngine') THEN 'token RulesEngine' END, {_SQL_TAG}
 CASE WHEN regexp_extract_all(t, 'href="([^"]+)"', 1) <> regexp_extract_all(e, 'href="([^"]+)"', 1) THEN 'links' END,
 CASE WHEN {_SQL_FIELDS.replace('{t}', 't')} <> {_SQL_FIELDS.replace('{t}', 'e')} THEN 'fields' END,
 CASE WHEN NOT (length(t) / greatest(length(e), 1) BETWEEN 0.5 AND 2.5) THEN 'length' END) AS problems FROM p""")
def catalog_drift(spark, sf_dir):
    merged = C.overlay(catalog(spark, sf_dir), _ORDER).filter("template <> ''")
    english = merged.filter("lang = 'en'").select("key", F.col("template").alias("en"))
    pairs = merged.filter("lang <> 'en'").join(english, "key")
    return C.drift(pairs, ["RulesEngine"]).select("lang", "key",
                                                   F.array_join("problems", ",").alias("problems"))


@query("r18_leaked_fields", f"""WITH {_SQL_CATALOG}, {_SQL_OVERLAY}
SELECT lang, key, contains(template, '{{nome}}') AS leaked FROM merged""")
def leaked_fields(spark, sf_dir):
    """Templates filled with the known fields; what is left over shows."""
    merged = C.overlay(catalog(spark, sf_dir), _ORDER)
    filled = S.fill(F.col("template"), {"pct": F.lit(137.5), "name": F.col("key")}, numeric=("pct",))
    return merged.select("lang", "key", C.leaked(filled).alias("leaked"))


def sql_letter(full_name: str = "full_name", household_size: str = "household_size",
               annual_income: str = "annual_income") -> str:
    """The letter as the inside of a SQL text."""
    out = C.LETTER.replace("'", "''")
    for field, value in {
            "name": f"coalesce(nullif(trim({full_name}), ''), '[Your full name]')", "address": "'[Your address]'",
            "phone": "'[Your phone]'", "today": "'July 14, 2026'", "hospital": B.sql_title("hospital"),
            "account": "'[account number if known]'", "service_date": "'[date of service]'",
            "ask": "CASE WHEN tier = 'free' THEN 'free (fully charity) care' ELSE 'a charity-care discount' END",
            "law": "law", "household": household_size, "income:,": f"format('{{:,}}', {annual_income})",
            "pct:.0f": "cast(round_even(fpl_pct, 0) as bigint)"}.items():
        out = out.replace("{" + field + "}", f"' || {value} || '")
    return out


@query("r17_letter_merge", f"""WITH {SQL_SCORED}, t AS (SELECT s.*, {SQL_TIER} AS tier, CASE WHEN coalesce(state, 'CA') = 'CA' THEN 'California''s Hospital Fair Pricing Act' ELSE r.law END AS law
 FROM scored s JOIN rules r ON r.code = s.rule_code)
SELECT intake_id, pos, md5('{sql_letter()}') AS letter_md5 FROM t""")
def letter_merge(spark, sf_dir):
    scored = scored_bills(spark, sf_dir).drop("phone").withColumn("law", F.col("rules.law")).withColumn(
        "tier", E.band_tier(F.col("fpl_pct"), F.col("free_band"), F.col("discount_band")))
    return C.letters(scored, "July 14, 2026").select("intake_id", "pos",
                                                     F.md5("letter").alias("letter_md5"))


_TWIN = "{name}|{address}|{phone}|{today}|{hospital}|{account}|{service_date}|Solicito {ask} por {law}: {household} personas, {income:,} USD ({pct:.0f}%)."
_SQL_TWIN = _TWIN
for _field, _value in {"name": "coalesce(nullif(trim(full_name), ''), '[Your full name]')", "address": "'[Your address]'", "phone": "'[Your phone]'",
                       "today": "'July 14, 2026'", "hospital": B.sql_title("hospital"), "account": "'[account number if known]'",
                       "service_date": "'[date of service]'", "ask": "CASE WHEN tier = 'free' THEN 'atención gratuita' ELSE 'un descuento' END",
                       "law": "law", "household": "household_size", "income:,": "format('{:,}', annual_income)",
                       "pct:.0f": "cast(round_even(fpl_pct, 0) as bigint)"}.items():
    _SQL_TWIN = _SQL_TWIN.replace("{" + _field + "}", f"' || {_value} || '")


@query("r17_letter_twin", f"""WITH {SQL_SCORED}, t AS (SELECT s.*, {SQL_TIER} AS tier, CASE WHEN coalesce(state, 'CA') = 'CA' THEN 'California''s Hospital Fair Pricing Act' ELSE r.law END AS law
 FROM scored s JOIN rules r ON r.code = s.rule_code)
SELECT intake_id, pos, md5('{_SQL_TWIN}') AS letter_md5 FROM t""")
def letter_twin(spark, sf_dir):
    """The letter's twin in another language: its template and its wording of the request."""
    scored = scored_bills(spark, sf_dir).drop("phone").withColumn("law", F.col("rules.law")).withColumn(
        "tier", E.band_tier(F.col("fpl_pct"), F.col("free_band"), F.col("discount_band")))
    ask = F.when(F.col("tier") == "free", F.lit("atención gratuita")).otherwise(F.lit("un descuento"))
    return C.letters(scored, "July 14, 2026", template=_TWIN, ask=ask).select("intake_id", "pos", F.md5("letter").alias("letter_md5"))
