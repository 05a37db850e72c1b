"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rulegrain import reference_values as V
from rulegrain.functions import scalars as S
from rulegrain.operators.asof import as_of
from rulegrain.plans import bindings as B
from rulegrain.plans.registry import query

TODAY = "2000-06-30"


@query("s01_poverty_limit", f"""WITH {B.SQL_INTAKE}
SELECT intake_id, cast({B.sql_limit('household_size')} as bigint) AS usd FROM intake""")
def poverty_limit(spark, sf_dir):
    return B.intakes(spark, sf_dir).select(
        "intake_id", S.poverty_limit(F.col("household_size")).alias("usd"))


@query("s02_fpl_percent", f"""WITH {B.SQL_INTAKE}
SELECT intake_id, {B.sql_pct('annual_income', 'household_size')} AS fpl_pct FROM intake""")
def fpl_percent(spark, sf_dir):
    return B.intakes(spark, sf_dir).select(
        "intake_id",
        S.fpl_percent(F.col("annual_income"), F.col("household_size")).alias("fpl_pct"))


@query("s03_dollar_table", f"""WITH {B.SQL_POLICY}, n AS (SELECT unnest(range(1, 9)) AS size)
SELECT k, cast(size as int) AS size,
 cast(round_even({B.sql_limit('size')} * fc / 100, 0) as bigint) AS usd
FROM pol, n WHERE fc IS NOT NULL AND fc <> 0""")
def dollar_table(spark, sf_dir):
    fc = F.col("policy.free_care.fpl_ceiling_pct")
    return B.policies(spark, sf_dir).select(
        F.col("pos").alias("k"), F.explode(S.dollar_table(fc)).alias("size", "usd"))


@query("s04_versioned_guideline", """SELECT o_orderkey,
 CASE WHEN y >= 2026 THEN 2026 WHEN y >= 2025 THEN 2025 WHEN y >= 2024 THEN 2024 END AS guideline_year,
 cast(CASE WHEN y >= 2026 THEN 15960 + 5680 * (n - 1) WHEN y >= 2025 THEN 15650 + 5500 * (n - 1)
      WHEN y >= 2024 THEN 15060 + 5380 * (n - 1) END as bigint) AS usd
FROM (SELECT o_orderkey, year(o_orderdate) + 25 AS y, greatest(o_custkey % 11, 1) AS n FROM orders)""")
def versioned_guideline(spark, sf_dir):
    year = F.year("o_orderdate") + 25
    return B.table(spark, sf_dir, "orders").select(
        "o_orderkey", S.guideline_year(year).alias("guideline_year"),
        S.poverty_limit_as_of(F.col("o_custkey") % 11, year).alias("usd"))


# the guideline as announced: a revision for each order status every January and July from 1993 on
_REVISIONS = """SELECT st AS status, make_date(1993 + i // 2, CASE WHEN i % 2 = 0 THEN 1 ELSE 7 END, 1) AS effective, 9000 + i * 310 + length(st) AS first_usd, 2000 + i * 55 AS next_usd"""


@query("s04_guideline_as_of", f"""WITH v AS ({_REVISIONS.replace("length(st)", "ascii(st)")} FROM (SELECT unnest(['F', 'O']) AS st), (SELECT unnest(range(14)) AS i))
SELECT o_orderkey, effective, cast(first_usd + next_usd * (greatest(o_custkey % 11, 1) - 1) as bigint) AS usd
FROM orders o ASOF LEFT JOIN v ON o.o_orderstatus = v.status AND o.o_orderdate >= v.effective""")
def guideline_as_of(spark, sf_dir):
    """The guideline in force on each order's date; there is none before the first revision and none for some."""
    revisions = spark.range(28).selectExpr("CASE WHEN id < 14 THEN 'F' ELSE 'O' END AS st", "CAST(id % 14 AS INT) AS i").selectExpr(
        *[c.strip() for c in B.split_top(_REVISIONS.removeprefix("SELECT ").replace("length(st)", "ascii(st)").replace("//", "div"))])
    orders = B.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", F.col("o_orderstatus").alias("status"))
    found = as_of(orders, revisions, "o_orderdate", "effective", by=["status"], out="v")
    size = F.greatest(F.col("o_custkey") % 11, F.lit(1))
    return found.select("o_orderkey", "v.effective", (F.col("v.first_usd") + F.col("v.next_usd") * (size - 1)).cast("bigint").alias("usd"))


@query("s05_dollars_for", f"""WITH {B.SQL_POLICY}
SELECT k, cast(k % 11 as int) AS household_size, CASE WHEN k % 11 BETWEEN 1 AND 8 AND
 free_table_pct <> 0 THEN cast(round_even({B.sql_limit('k % 11')} * free_table_pct / 100, 0) as bigint)
 END AS ceiling FROM pol""")
def dollars_for(spark, sf_dir):
    size = (F.col("pos") % 11).cast("int")
    return B.policies(spark, sf_dir).select(
        F.col("pos").alias("k"), size.alias("household_size"),
        S.dollars_for(F.col("free_care_income_ceiling_by_household"), size).alias("ceiling"))


# order dates written in the spellings the operators meet
_DATE_TEXT = """CASE o_orderkey % 11 WHEN 0 THEN {d:%m/%d/%Y} WHEN 1 THEN {d:%Y-%m-%d}
 WHEN 2 THEN {d:%m/%d/%y} WHEN 3 THEN {d:%m/%Y} WHEN 4 THEN {d:%B %d, %Y}
 WHEN 5 THEN {d:%b %d, %Y} WHEN 6 THEN {d:%B %Y} WHEN 7 THEN {d:%Y} WHEN 8 THEN ''
 WHEN 9 THEN 'upon request' END"""
_SPARK_FORMATS = {"%m/%d/%Y": "MM/dd/yyyy", "%Y-%m-%d": "yyyy-MM-dd", "%m/%d/%y": "MM/dd/yy",
                  "%m/%Y": "MM/yyyy", "%B %d, %Y": "MMMM dd, yyyy", "%b %d, %Y": "MMM dd, yyyy",
                  "%B %Y": "MMMM yyyy", "%Y": "yyyy"}


def _date_text(function: str, formats) -> str:
    text = _DATE_TEXT
    for name in _SPARK_FORMATS:
        text = text.replace("{d:" + name + "}", f"{function}(o_orderdate, '{formats(name)}')")
    return text


SPARK_DATE_TEXT = _date_text("date_format", _SPARK_FORMATS.get)
SQL_DATE_TEXT = _date_text("strftime", lambda name: name)


@query("s06_effective_date_issue", f"""WITH t AS (SELECT o_orderkey, {SQL_DATE_TEXT} AS d FROM orders)
SELECT o_orderkey, CASE WHEN coalesce(d, '') = '' THEN NULL
 WHEN NOT regexp_full_match(d, '[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}')
  THEN 'unparseable effective date: ''' || d || ''''
 WHEN strptime(d, '%m/%d/%Y') > DATE '{TODAY}' THEN 'effective date is in the future: ' || d
 END AS issue FROM t""")
def effective_date_issue(spark, sf_dir):
    orders = B.table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", S.effective_date_issue(
        F.expr(SPARK_DATE_TEXT), F.lit(TODAY).cast("date")).alias("issue"))


@query("s07_effective_date_display", f"""WITH t AS (SELECT o_orderkey, o_orderdate, {SQL_DATE_TEXT} AS d FROM orders),
p AS (SELECT o_orderkey, nullif(d, '') AS d, CASE WHEN o_orderkey % 11 IN (0, 1, 2, 4, 5) THEN o_orderdate::date
 WHEN o_orderkey % 11 IN (3, 6) THEN date_trunc('month', o_orderdate)::date
 WHEN o_orderkey % 11 = 7 THEN date_trunc('year', o_orderdate)::date END AS parsed FROM t)
SELECT o_orderkey, CASE WHEN parsed > DATE '{TODAY}' THEN NULL ELSE d END AS shown FROM p""")
def effective_date_display(spark, sf_dir):
    orders = B.table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", S.effective_date_display(
        F.expr(SPARK_DATE_TEXT), F.lit(TODAY).cast("date")).alias("shown"))


@query("s08_slugify", f"""SELECT page_id, {B.sql_slug('url')} AS slug FROM pages
UNION ALL SELECT p_partkey, {B.sql_slug("p_name || ' / ' || p_brand")} FROM part""")
def slugify(spark, sf_dir):
    urls = B.table(spark, sf_dir, "pages").select("page_id", S.slugify(F.col("url")).alias("slug"))
    parts = B.table(spark, sf_dir, "part").select(
        "p_partkey", S.slugify(F.concat("p_name", F.lit(" / "), "p_brand")).alias("slug"))
    return urls.union(parts)


@query("s09_title_case", f"""WITH t AS (SELECT o_orderkey, o_orderpriority || ' o''brien d/p-aph ' || o_orderkey || 'rd' AS x FROM orders)
SELECT o_orderkey, {B.sql_title('x')} AS titled FROM t""")
def title_case(spark, sf_dir):
    text = F.concat("o_orderpriority", F.lit(" o'brien d/p-aph "), "o_orderkey", F.lit("rd"))
    return B.table(spark, sf_dir, "orders").select("o_orderkey", S.py_title(text).alias("titled"))


@query("s10_money", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL
 ELSE '$' || format('{:,}', cast(floor(o_totalprice) as bigint)) END AS usd FROM orders""")
def money(spark, sf_dir):
    text = F.when(F.col("o_orderstatus") == "P", F.lit("call us")).otherwise(
        F.floor("o_totalprice").cast("string"))
    return B.table(spark, sf_dir, "orders").select("o_orderkey", S.money(text).alias("usd"))


_FILL = "~{pct:.0f}% of {n}, ${income:,} for {name} ({pct}) {left}"


@query("s11_fill_template", f"""WITH {B.SQL_INTAKE}, p AS (SELECT *,
 {B.sql_pct('annual_income', 'household_size')} AS pct FROM intake)
SELECT intake_id, '~' || cast(round_even(pct, 0) as bigint) || '% of ' || household_size || ', $'
 || format('{{:,}}', annual_income) || ' for ' || full_name || ' (' || {B.sql_num('pct')} || ') {{left}}'
 AS filled FROM p""")
def fill_template(spark, sf_dir):
    df = B.intakes(spark, sf_dir).withColumn("template", F.lit(_FILL))
    pct = S.fpl_percent(F.col("annual_income"), F.col("household_size"))
    return df.select("intake_id", S.fill(F.col("template"), {
        "pct": pct, "n": F.col("household_size"), "income": F.col("annual_income"),
        "name": F.col("full_name")}, numeric=("pct", "n", "income")).alias("filled"))


@query("s12_escape_and_quote", r"""SELECT page_id,
 md5(replace(replace(replace(replace(replace(html,'&','&amp;'),'<','&lt;'),'>','&gt;'),'"','&quot;'),'''','&#x27;')) AS escaped,
 replace(url_encode(url || ' *~é'), '%2F', '/') AS quoted,
 md5('"' || replace(replace(replace(replace(replace(html,'\','\\'),'"','\"'),chr(10),'\n'),chr(13),'\r'),chr(9),'\t') || '"') AS json_text
FROM pages""")
def escape_and_quote(spark, sf_dir):
    return B.table(spark, sf_dir, "pages").select(
        "page_id", F.md5(S.html_escape(F.col("html"))).alias("escaped"),
        S.url_quote(F.concat("url", F.lit(" *~é"))).alias("quoted"),
        F.md5(S.json_quote(F.col("html"))).alias("json_text"))


@query("s13_guid", """WITH t AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN url || '?id=' || md5(url) || '-tail-beyond'
 WHEN 1 THEN url || '?id=1&id=' || page_id END AS u FROM pages)
SELECT page_id, substr(list_last(string_split(coalesce(u, ''), 'id=')), 1, 36) AS guid FROM t""")
def guid(spark, sf_dir):
    url = F.expr("CASE page_id % 3 WHEN 0 THEN concat(url, '?id=', md5(url), '-tail-beyond') "
                 "WHEN 1 THEN concat(url, '?id=1&id=', page_id) END")
    return B.table(spark, sf_dir, "pages").select("page_id", S.guid(url).alias("guid"))


@query("s14_phone", r"""SELECT doc_id, nullif(regexp_extract(text, '\([0-9]{3}\)\s*[0-9]{3}-[0-9]{4}'), '') AS found,
 md5(regexp_replace(text, '[^0-9+]', '', 'g')) AS digits FROM documents
UNION ALL SELECT s_suppkey, '(555) 010-' || lpad(cast(s_suppkey % 10000 as varchar), 4, '0'),
 md5('555010' || lpad(cast(s_suppkey % 10000 as varchar), 4, '0')) FROM supplier""")
def phone(spark, sf_dir):
    docs = B.table(spark, sf_dir, "documents").select("doc_id", "text")
    cards = B.table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(
        F.lit("call (555) 010-"), F.lpad((F.col("s_suppkey") % 10000).cast("string"), 4, "0"),
        F.lit(" today")))
    return docs.union(cards).select(
        "doc_id", S.phone_find(F.col("text")).alias("found"),
        F.md5(S.phone_digits(F.col("text"))).alias("digits"))


@query("s15_sha256", "SELECT doc_id, sha256(text) AS sha FROM documents")
def sha256(spark, sf_dir):
    return B.table(spark, sf_dir, "documents").select("doc_id",
                                                      S.content_sha(F.col("text")).alias("sha"))


@query("s16_canonical_json", """SELECT p_partkey, '{' || CASE WHEN p_partkey % 10 = 0 THEN '' ELSE
 '"ceiling":' || (100 + (p_partkey % 9) * 50) || ',' END || '"name":"' || p_name || '","tiers":[{"high":'
 || p_size || '}]}' AS canon FROM part""")
def canonical_json(spark, sf_dir):
    value = F.struct(
        F.expr("CASE WHEN p_partkey % 10 <> 0 THEN 100 + (p_partkey % 9) * 50 END").alias("ceiling"),
        F.col("p_name").alias("name"),
        F.array(F.struct(F.col("p_size").alias("high"))).alias("tiers"))
    return B.table(spark, sf_dir, "part").select("p_partkey", S.canonical_json(value).alias("canon"))


_KINDS = "CASE s_suppkey % 3 WHEN 0 THEN 'hospital' WHEN 1 THEN 'county' ELSE 'directory' END"
_SLUG = "CASE WHEN s_suppkey % 3 = 2 THEN NULL ELSE lower(s_name) END"
_SLUG_SPARK = f"regexp_replace({_SLUG}, '#', '-')"
_SLUG_SQL = f"replace({_SLUG}, '#', '-')"
_STATE = "CASE s_suppkey % 4 WHEN 0 THEN 'CA' WHEN 1 THEN 'IL' WHEN 2 THEN 'VT' ELSE 'ZZ' END"
_LANGS_SQL = "(VALUES " + ",".join(f"('{code}')" for code in V.LANGUAGES) + ") l(lang)"
_SQL_PATH = """(CASE WHEN {lang} = 'en' THEN '/' ELSE '/' || {lang} || '/' END
 || CASE WHEN state = 'CA' THEN '' ELSE lower(state) || '/' END
 || CASE WHEN kind = 'county' THEN 'hospitals/' || slug WHEN slug IS NOT NULL THEN 'hospital/' || slug
  ELSE CASE state WHEN 'IL' THEN 'illinois-hospitals' WHEN 'VT' THEN 'vermont-hospitals'
   ELSE 'california-hospitals' END END)"""
_SQL_PLACES = f"""places AS (SELECT s_suppkey AS k, {_KINDS} AS kind, {_SLUG_SQL} AS slug, {_STATE} AS state FROM supplier)"""


def _places(spark, sf_dir):
    return B.table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS k", f"{_KINDS} AS kind", f"{_SLUG_SPARK} AS slug", f"{_STATE} AS state")


def _languages() -> F.Column:
    return F.explode(F.array(*[F.lit(code) for code in V.LANGUAGES]))


@query("s17_localized_path", f"""WITH {_SQL_PLACES}
SELECT k, lang, {_SQL_PATH.format(lang='lang')} AS path,
 CASE WHEN lang = 'en' THEN '/' ELSE '/' || lang || '/' END AS home,
 CASE WHEN lang = 'en' THEN '/' ELSE '/' || lang || '/' END || 'faq' AS faq
FROM places, {_LANGS_SQL}""")
def localized_path(spark, sf_dir):
    df = _places(spark, sf_dir).withColumn("lang", _languages())
    return df.select(
        "k", "lang",
        S.page_path(F.col("lang"), F.col("slug"), F.col("kind"), F.col("state")).alias("path"),
        S.site_path(F.col("lang"), F.lit("home")).alias("home"),
        S.site_path(F.col("lang"), F.lit("faq")).alias("faq"))


@query("s18_alternate_links", f"""WITH {_SQL_PLACES}, cur AS (SELECT *, CASE WHEN k % 2 = 0 THEN 'en' ELSE 'es' END AS cur FROM places)
SELECT k, 'alternate' AS rel, lang AS hreflang, 'https://example.org' || {_SQL_PATH.format(lang='lang')} AS url FROM cur, {_LANGS_SQL}
UNION ALL SELECT k, 'alternate', 'x-default', 'https://example.org' || {_SQL_PATH.format(lang="'en'")} FROM cur
UNION ALL SELECT k, 'canonical', cur, 'https://example.org' || {_SQL_PATH.format(lang='cur')} FROM cur""")
def alternate_links(spark, sf_dir):
    current = F.expr("CASE WHEN k % 2 = 0 THEN 'en' ELSE 'es' END")
    links = S.alternate_links("https://example.org", current, F.col("slug"), F.col("kind"),
                              F.col("state"))
    return _places(spark, sf_dir).select("k", F.inline(links))


@query("s19_strip_emphasis", "SELECT doc_id, md5(replace(text, '**', '')) AS plain FROM documents")
def strip_emphasis(spark, sf_dir):
    return B.table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(S.strip_emphasis(F.col("text"))).alias("plain"))


@query("s20_card_and_qr", f"""WITH {_SQL_PLACES}
SELECT k, CASE WHEN state = 'CA' AND kind IN ('hospital', 'county') AND slug IS NOT NULL
 THEN 'https://example.org/og/' || kind || '/' || slug || '.png' ELSE 'https://example.org/og-image.png' END AS card,
 '/qr/' || CASE WHEN state = 'CA' THEN '' ELSE lower(state) || '/' END || kind || '/' || slug || '.svg' AS qr
FROM places""")
def card_and_qr(spark, sf_dir):
    kind, slug, state = F.col("kind"), F.col("slug"), F.col("state")
    return _places(spark, sf_dir).select(
        "k", S.share_card("https://example.org", kind, slug, state).alias("card"),
        S.qr_path(kind, slug, state).alias("qr"))
