"""Merges, content dedup and snapshot changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from rulegrain.operators import dedup as D
from rulegrain.operators import reports as P
from rulegrain.operators import snapshots as N
from rulegrain.operators import splice as J
from rulegrain.plans import bindings as B
from rulegrain.plans.registry import query
from rulegrain.session import scratch_path

# --- splice: orders by status; the second dataset has one row per order line -----------------

_STATUS = "CASE o_orderstatus WHEN 'P' THEN 'needs_ocr' WHEN 'F' THEN 'extracted' ELSE 'extraction_error' END"
_LINE_STATUS = "CASE WHEN l_returnflag = 'R' THEN 'needs_ocr' ELSE 'extracted' END"
_LINE_POS = "l_partkey * 1000000 + l_suppkey * 100 + l_linenumber"
SQL_SPLICE = f"""o AS (SELECT cast(o_orderkey as varchar) AS key, o_orderkey AS pos, {_STATUS} AS status,
 cast(floor(o_totalprice) as bigint) AS amount, o_custkey % 2 = 0 AS needs_review FROM orders),
l AS (SELECT cast(l_orderkey as varchar) AS key, {_LINE_POS} AS pos, {_LINE_STATUS} AS status,
 cast(floor(l_extendedprice) as bigint) AS amount, l_quantity > 25 AS needs_review FROM lineitem),
ready AS (SELECT * FROM l WHERE status = 'extracted' QUALIFY row_number() OVER (PARTITION BY key ORDER BY pos DESC) = 1)"""


_BASE = ["CAST(o_orderkey AS STRING) AS key", "o_orderkey AS pos", f"{_STATUS} AS status",
         "CAST(floor(o_totalprice) AS BIGINT) AS amount", "o_custkey % 2 = 0 AS needs_review"]


def base_rows(spark, sf_dir):
    return B.table(spark, sf_dir, "orders").selectExpr(*_BASE)


def second_rows(spark, sf_dir):
    return B.table(spark, sf_dir, "lineitem").selectExpr(
        "CAST(l_orderkey AS STRING) AS key", f"{_LINE_POS} AS pos", f"{_LINE_STATUS} AS status",
        "CAST(floor(l_extendedprice) AS BIGINT) AS amount", "l_quantity > 25 AS needs_review")


@query("j01_splice", f"""WITH {SQL_SPLICE}
SELECT o.key, CASE WHEN t THEN r.pos ELSE o.pos END AS pos, CASE WHEN t THEN r.status ELSE o.status END AS status,
 CASE WHEN t THEN r.amount ELSE o.amount END AS amount, t AS spliced
FROM (SELECT o.*, o.status = 'needs_ocr' AND r.key IS NOT NULL AS t FROM o LEFT JOIN ready r USING (key)) o LEFT JOIN ready r USING (key)""")
def splice(spark, sf_dir):
    return J.splice(base_rows(spark, sf_dir), second_rows(spark, sf_dir)).drop("needs_review")


@query("a02_coverage_metrics", f"""WITH {B.SQL_POLICY}, keyed AS (SELECT *, coalesce(nullif(permalink, ''), hospital) AS key FROM pol),
r AS (SELECT * FROM keyed WHERE k % 2 = 0 QUALIFY row_number() OVER (PARTITION BY key ORDER BY k DESC) = 1),
s AS (SELECT t AS spliced, CASE WHEN t THEN 'extracted' ELSE status END AS status, CASE WHEN t THEN rfc ELSE fc END AS fc, CASE WHEN t THEN rr ELSE needs_review END AS needs_review
 FROM (SELECT p.*, r.fc AS rfc, r.needs_review AS rr, coalesce(p.status = 'needs_ocr' AND r.key IS NOT NULL, false) AS t FROM keyed p LEFT JOIN r ON r.key = p.key))
SELECT count(*) AS total, count(*) FILTER (spliced) AS spliced, count(*) FILTER (status = 'extracted') AS usable,
 count(*) FILTER (status = 'extracted' AND fc IS NOT NULL) AS with_free, count(*) FILTER (needs_review) AS needs_review,
 cast(floor(100 * count(*) FILTER (status = 'extracted') / greatest(count(*), 1)) as bigint) AS usable_pct FROM s""")
def coverage_metrics(spark, sf_dir):
    """Coverage after half of the policies came back read from their pictures."""
    rows = J.with_key(B.policies(spark, sf_dir))
    second = rows.filter("pos % 2 = 0").withColumn("status", F.lit("extracted"))
    return P.coverage(J.splice(rows, second).drop("key"))


@query("j20_merge_changed", f"""WITH {SQL_SPLICE}, served AS (SELECT * FROM o SEMI JOIN (SELECT o_orderkey AS pos FROM orders WHERE o_orderdate < DATE '2001-01-01') USING (pos)),
fail AS (SELECT DISTINCT key FROM l WHERE status <> 'extracted'),
m AS (SELECT s.key, CASE WHEN r.key IS NOT NULL THEN r.amount ELSE s.amount END AS amount,
 CASE WHEN r.key IS NOT NULL THEN r.status ELSE s.status END AS status,
 CASE WHEN r.key IS NOT NULL THEN 'replaced' WHEN f.key IS NOT NULL THEN 'held' ELSE 'kept' END AS action
 FROM served s LEFT JOIN ready r USING (key) LEFT JOIN fail f USING (key)
 UNION ALL SELECT key, amount, status, 'added' FROM ready ANTI JOIN served USING (key))
SELECT * FROM m""")
def merge_changed(spark, sf_dir):
    """Orders before the last refresh are served already; later ones are new keys."""
    served = B.table(spark, sf_dir, "orders").filter("o_orderdate < DATE'2001-01-01'") \
        .selectExpr(*_BASE)
    merged = J.merge_changed(served, second_rows(spark, sf_dir))
    return merged.select("key", "amount", "status", "action")


@query("j21_verify_and_hold", f"""WITH {SQL_SPLICE}, reread AS (SELECT key, amount - (pos % 3) AS amount FROM o WHERE NOT needs_review)
SELECT o.key, o.amount, CASE WHEN r.key IS NULL THEN 'kept' WHEN r.amount = o.amount THEN 'adopted' ELSE 'held' END AS action
FROM o LEFT JOIN reread r USING (key)""")
def verify_and_hold(spark, sf_dir):
    served = base_rows(spark, sf_dir)
    reread = served.filter(~F.col("needs_review")).withColumn(
        "amount", F.col("amount") - F.col("pos") % 3)
    return J.verify_and_hold(served, reread, ["amount"]).select("key", "amount", "action")


# --- content: documents ----------------------------------------------------------------------

SQL_HASHED = """hashed AS (SELECT doc_id AS pos, text, source, lang,
 CASE WHEN length(trim(text)) >= 500 THEN sha256(text) END AS source_sha256 FROM documents),
grouped AS (SELECT source_sha256, min(pos) AS first_pos, count(*) AS copies FROM hashed WHERE source_sha256 IS NOT NULL GROUP BY 1)"""


def hashed(spark, sf_dir):
    docs = B.table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "pos")
    return D.with_content_sha(docs)


@query("a08_content_dedup", f"WITH {SQL_HASHED} SELECT * FROM grouped")
def content_dedup(spark, sf_dir):
    return D.content_groups(hashed(spark, sf_dir))


@query("a08_distinct_sketches", f"""WITH {SQL_HASHED} SELECT lang, count(DISTINCT source_sha256) AS exact, true AS close FROM hashed WHERE source_sha256 IS NOT NULL GROUP BY 1""")
def distinct_sketches(spark, sf_dir):
    """Eight batches leave their sketches in a table; their union is held against the exact number."""
    path, docs = scratch_path(spark, "sketches"), hashed(spark, sf_dir).withColumn("batch", F.col("pos") % 8)
    D.content_sketches(docs, ["batch", "lang"]).write.partitionBy("batch").parquet(path)
    about = D.distinct_contents(spark.read.parquet(path), ["lang"])
    exact = docs.filter("source_sha256 IS NOT NULL").groupBy("lang").agg(F.countDistinct("source_sha256").alias("exact"))
    known = about.withColumnRenamed("lang", "_lang")
    return exact.join(known, exact["lang"].eqNullSafe(known["_lang"])).select(
        "lang", "exact", (F.abs(F.col("contents") - F.col("exact")) <= F.col("exact") * 0.02).alias("close"))


@query("a08_unique_texts", f"""WITH {SQL_HASHED} SELECT h.pos, length(text) AS chars FROM hashed h JOIN grouped g ON h.pos = g.first_pos""")
def unique_texts(spark, sf_dir):
    return D.unique_texts(hashed(spark, sf_dir)).select("pos", F.length("text").cast("bigint").alias("chars"))


# a cache of results: contents of labelled documents
SQL_CACHE = """cache AS (SELECT DISTINCT sha256(text) AS source_sha256 FROM documents JOIN labels USING (doc_id))"""


def cache(spark, sf_dir):
    labels = B.table(spark, sf_dir, "labels").select("doc_id")
    docs = B.table(spark, sf_dir, "documents").join(labels, "doc_id", "left_semi")
    return docs.select(F.sha2("text", 256).alias("source_sha256")).distinct()


@query("j05_work_list", f"""WITH {SQL_HASHED}, {SQL_CACHE}
SELECT first_pos AS pos, source_sha256, 'to do' AS part FROM grouped ANTI JOIN cache USING (source_sha256)
UNION ALL SELECT first_pos, source_sha256, 'cached' FROM grouped SEMI JOIN cache USING (source_sha256)""")
def work_list(spark, sf_dir):
    unique = D.content_groups(hashed(spark, sf_dir)).select(F.col("first_pos").alias("pos"),
                                                            "source_sha256")
    known = cache(spark, sf_dir)
    return (D.work_list(unique, known).withColumn("part", F.lit("to do"))
            .unionByName(D.cached(unique, known).withColumn("part", F.lit("cached")))
            .select("pos", "source_sha256", "part"))


@query("j04_map_results_back", f"""WITH {SQL_HASHED}, results AS (SELECT source_sha256, CASE WHEN first_pos % 9 = 4 THEN 'batch_errored: ' || first_pos END AS error,
 CASE WHEN first_pos % 9 <> 4 THEN cast(copies as varchar) END AS policy FROM grouped)
SELECT pos, source_sha256, CASE WHEN source_sha256 IS NULL THEN 'needs_ocr' WHEN error IS NOT NULL THEN 'extraction_error' ELSE 'extracted' END AS status,
 policy, error FROM hashed LEFT JOIN results USING (source_sha256)""")
def map_results_back(spark, sf_dir):
    rows = hashed(spark, sf_dir)
    results = D.content_groups(rows).selectExpr(
        "source_sha256", "CASE WHEN first_pos % 9 = 4 THEN concat('batch_errored: ', first_pos) END AS error",
        "CASE WHEN first_pos % 9 <> 4 THEN CAST(copies AS STRING) END AS policy")
    return J.map_results(rows.select("pos", "source_sha256"), results).select(
        "pos", "source_sha256", "status", "policy", "error")


@query("j03_stamp_hash", f"""WITH {SQL_HASHED}, known AS (SELECT source AS key, source_sha256 FROM hashed WHERE source_sha256 IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY source ORDER BY pos DESC) = 1)
SELECT pos, source_sha256 AS content_sha FROM (SELECT pos, source AS key FROM hashed) LEFT JOIN known USING (key)""")
def stamp_hash(spark, sf_dir):
    rows = hashed(spark, sf_dir).withColumnRenamed("source", "key")
    return J.stamp_sha(rows.select("pos", "key"), rows.select("key", "pos", "source_sha256")) \
            .select("pos", "content_sha")


@query("w03_first_occurrence", """WITH t AS (SELECT doc_id AS pos, CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'https://h/a?id=' || md5(text) END AS url FROM documents)
SELECT pos, url FROM t WHERE url <> '' QUALIFY row_number() OVER (PARTITION BY url ORDER BY pos) = 1
UNION ALL SELECT pos, url FROM t WHERE url = ''""")
def first_occurrence(spark, sf_dir):
    docs = B.table(spark, sf_dir, "documents").selectExpr(
        "doc_id AS pos", "CASE WHEN doc_id % 4 = 0 THEN '' ELSE concat('https://h/a?id=', md5(text)) END AS url")
    return D.first_per_guid(docs, "url")


# --- snapshots: orders by customer and priority; the two spans cover all of them ---------------------

BASE, CURRENT = "o_orderdate <= DATE'2000-06-01'", "o_orderdate > DATE'1996-03-01'"
_RECORD = """o_custkey * 10 + cast(substr(o_orderpriority, 1, 1) AS bigint) AS key, c_name AS hospital, c_nationkey AS region, o_orderkey % 3 AS c_url,
 o_orderstatus AS d_url, concat('01/01/', year(o_orderdate)) AS day, CASE WHEN o_orderkey % 5 <> 0 THEN {sha} END AS content_sha"""


def _sql_snapshot(name: str, span: str) -> str:
    return f"""{name} AS (SELECT key, hospital, region, 'https://c/' || c_url AS c_url, day AS c_date, 'https://d/' || d_url AS d_url, day AS d_date, content_sha
 FROM (SELECT {_RECORD.format(sha="sha256(cast(o_orderkey AS varchar))")}, o_orderdate, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE {span})
 QUALIFY row_number() OVER (PARTITION BY key ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)"""


def snapshot(spark, sf_dir, span):
    """Records of a snapshot; keys repeat, and `pos` says which record is the last."""
    orders = B.table(spark, sf_dir, "orders").filter(span)
    customers = B.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")

    def section(prefix, part):
        return F.struct(F.concat(F.lit(prefix), part).alias("url"), F.col("day").alias("effective_date"))

    flat = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).selectExpr(
        *[c.strip() for c in B.split_top(_RECORD.format(sha="sha2(cast(o_orderkey AS string), 256)"))],
        "struct(o_orderdate, o_orderkey) AS pos")
    return flat.select("key", "hospital", "region", section("https://c/", F.col("c_url")).alias("charity_care"),
                       section("https://d/", F.col("d_url")).alias("discount_payment"), "content_sha", "pos")


SQL_SNAPSHOTS = f"{_sql_snapshot('base', BASE)}, {_sql_snapshot('cur', CURRENT)}"
SQL_DIFF = f"""{SQL_SNAPSHOTS}, pairs AS (SELECT coalesce(c.key, b.key) AS key, coalesce(c.hospital, b.hospital) AS hospital,
 coalesce(c.region, b.region) AS region, b.key IS NULL AS is_new, c.key IS NULL AS is_removed,
 concat_ws('; ', CASE WHEN c.c_date IS DISTINCT FROM b.c_date THEN 'charity_care.date ' || coalesce(b.c_date, 'None') || ' -> ' || coalesce(c.c_date, 'None') END,
  CASE WHEN c.c_url IS DISTINCT FROM b.c_url THEN 'charity_care.url' END,
  CASE WHEN c.d_date IS DISTINCT FROM b.d_date THEN 'discount_payment.date ' || coalesce(b.d_date, 'None') || ' -> ' || coalesce(c.d_date, 'None') END,
  CASE WHEN c.d_url IS DISTINCT FROM b.d_url THEN 'discount_payment.url' END) AS stated,
 CASE WHEN c.content_sha <> b.content_sha THEN 'content' ELSE '' END AS silent
 FROM cur c FULL JOIN base b ON c.key = b.key), changes AS (SELECT key, hospital, region,
 CASE WHEN is_new THEN 'new' WHEN is_removed THEN 'removed' ELSE 'changed' END AS change,
 CASE WHEN is_new OR is_removed THEN '' WHEN stated <> '' THEN stated ELSE silent END AS deltas FROM pairs
 WHERE is_new OR is_removed OR stated <> '' OR silent <> '')"""


def changes(spark, sf_dir):
    return N.diff(snapshot(spark, sf_dir, CURRENT), snapshot(spark, sf_dir, BASE))


@query("j02_snapshot_diff", f"WITH {SQL_DIFF} SELECT key, hospital, change, deltas FROM changes")
def snapshot_diff(spark, sf_dir):
    return changes(spark, sf_dir).withColumn("deltas", F.array_join("deltas", "; "))


@query("u01_key_sets", f"""WITH {SQL_SNAPSHOTS} SELECT key, 'new' AS membership FROM cur ANTI JOIN base USING (key)
UNION ALL SELECT key, 'removed' FROM base ANTI JOIN cur USING (key) UNION ALL SELECT key, 'common' FROM cur SEMI JOIN base USING (key)""")
def key_sets(spark, sf_dir):
    return N.key_sets(snapshot(spark, sf_dir, CURRENT), snapshot(spark, sf_dir, BASE))


@query("l05_sorted_keys", f"""WITH {SQL_DIFF} SELECT key, change, row_number() OVER (ORDER BY change, key) AS line FROM changes""")
def sorted_keys(spark, sf_dir):
    from rulegrain.operators.ranking import number_rows
    return number_rows(changes(spark, sf_dir).select("key", "change"), ["change", "key"], "line")


@query("l03_shown_changes", f"""WITH {SQL_DIFF} SELECT key, change FROM changes
QUALIFY row_number() OVER (PARTITION BY change ORDER BY key) <= CASE change WHEN 'changed' THEN 40 ELSE 20 END""")
def shown_changes(spark, sf_dir):
    """The report prints 40 changed, 20 new and 20 removed keys."""
    found = changes(spark, sf_dir).select("key", "change")
    parts = [found.filter(F.col("change") == name).orderBy("key").limit(n)
             for name, n in (("changed", 40), ("new", 20), ("removed", 20))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("a15_guard_metrics", f"""WITH {SQL_DIFF} SELECT (SELECT count(*) FROM changes WHERE change <> 'removed') AS n,
 (SELECT count(*) FROM changes WHERE change = 'removed') AS removed, (SELECT count(*) FROM cur) AS current, (SELECT count(*) FROM base) AS baseline""")
def guard_metrics(spark, sf_dir):
    cur, base = (N.last_records(snapshot(spark, sf_dir, x)) for x in (CURRENT, BASE))
    return N.guard_metrics(N.diff(cur, base), cur, base)


@query("a15_observed_guards", f"""WITH {SQL_DIFF} SELECT (SELECT count(*) FROM changes WHERE change <> 'removed') AS n,
 (SELECT count(*) FROM changes WHERE change = 'removed') AS removed, (SELECT count(*) FROM cur) AS current, (SELECT count(*) FROM base) AS baseline""")
def observed_guards(spark, sf_dir):
    """The same counts, collected while the changes are written."""
    found, counts = N.observed_diff(snapshot(spark, sf_dir, CURRENT), snapshot(spark, sf_dir, BASE))
    found.write.parquet(scratch_path(spark, "changes"))
    return spark.createDataFrame([N.observed_metrics(counts)], "n bigint, removed bigint, current bigint, baseline bigint")


@query("a16_refresh_decision", f"""WITH {SQL_DIFF}, t AS (SELECT region, change <> 'removed' AS n, change = 'removed' AS removed, false AS c, false AS b FROM changes
 UNION ALL SELECT region, false, false, true, false FROM cur UNION ALL SELECT region, false, false, false, true FROM base),
m AS (SELECT region, count_if(n) AS n, count_if(removed) AS removed, count_if(c) AS current, count_if(b) AS baseline FROM t GROUP BY 1),
d AS (SELECT *, CASE WHEN removed > 40 OR (baseline > 0 AND current < baseline * 0.95) THEN 'degenerate' WHEN n = 0 THEN 'none' WHEN n > 120 THEN 'cap' ELSE 'proceed' END AS decision FROM m)
SELECT region, cast(n as bigint) AS n, cast(removed as bigint) AS removed, cast(current as bigint) AS current, cast(baseline as bigint) AS baseline, decision,
 cast(CASE WHEN decision IN ('degenerate', 'cap') THEN 2 ELSE 0 END as int) AS exit_code FROM d""")
def refresh_decision(spark, sf_dir):
    """The guards, region by region."""
    cur, base = (N.last_records(snapshot(spark, sf_dir, x)) for x in (CURRENT, BASE))
    regions = cur.select("key", "region").unionByName(base.select("key", "region")).distinct()
    found = N.diff(cur, base).join(regions, "key")
    return N.decide(N.guard_metrics(found, cur, base, ["region"]), max_changed=120, max_removed=40)
