"""Text evidence over whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from rulegrain.functions import evidence as T
from rulegrain.operators import grounding as G
from rulegrain.operators import proximity as P
from rulegrain.plans import bindings as B
from rulegrain.plans.registry import query

_FILLER = "'. ' || repeat('lorem ipsum dolor ', 80)"
# each document gains a closing sentence: none, near, far, wrong number, other spelling
_SENTENCE = """CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN ' Free care up to ' || n || '% of the Federal Poverty Level.'
 WHEN 2 THEN ' The FPL applies' || {filler} || n || ' percent.' WHEN 3 THEN ' Free care up to ' || (n + 13) || '% of the federal  poverty level.'
 ELSE ' Care is free below ' || n || ' per cent of FPL, and ' || (n + 50) || '.5% of the FPG.' END"""
_CLAIM_SQL = f"""src AS (SELECT doc_id, lang, text, 100 + (doc_id % 7) * 50 AS n FROM documents),
doc AS (SELECT *, text || {_SENTENCE.format(filler=_FILLER)} AS corpus FROM src),
sized AS (SELECT *, sha256(corpus) AS real_sha FROM doc)"""


_GAP = "CASE WHEN doc_id % 17 = 16 THEN NULL ELSE corpus END"


def claim_docs(spark, sf_dir, gaps=False):
    """Documents as corpora with the claims published about them; `gaps` takes some corpora away."""
    sentence = _SENTENCE.format(filler=_FILLER)
    return (B.table(spark, sf_dir, "documents")
            .selectExpr("doc_id", "lang", "text", "100 + (doc_id % 7) * 50 AS n")
            .selectExpr("doc_id", "lang", "n", f"text || {sentence} AS corpus")
            .selectExpr(
                "doc_id", "lang", f"{_GAP if gaps else 'corpus'} AS corpus",
                "CASE WHEN doc_id % 11 = 4 THEN sha2('other', 256) WHEN doc_id % 11 = 5 THEN '' ELSE sha2(corpus, 256) END AS source_sha256",
                "CASE WHEN doc_id % 13 = 0 THEN 'pdf_ocr' END AS extraction_channel",
                """CASE WHEN doc_id % 19 = 0 THEN slice(array(named_struct('label', '', 'value', 0D)), 1, 0)
                 WHEN doc_id % 3 = 0 THEN array(named_struct('label', 'free_care.fpl_ceiling_pct', 'value', CAST(n AS DOUBLE)),
                   named_struct('label', 'discount_payment.tiers[0].fpl_high_pct', 'value', n + 50.5D))
                 ELSE array(named_struct('label', 'free_care.fpl_ceiling_pct', 'value', CAST(n AS DOUBLE))) END AS claims"""))


SQL_CLAIMS = f"""{_CLAIM_SQL}, prepared AS (SELECT doc_id, lang, n, corpus,
 CASE WHEN doc_id % 11 = 4 THEN sha256('other') WHEN doc_id % 11 = 5 THEN '' ELSE real_sha END AS stored,
 CASE WHEN doc_id % 13 = 0 THEN 'pdf_ocr' END AS channel FROM sized),
claim AS (SELECT doc_id, 0 AS i, 'free_care.fpl_ceiling_pct' AS label, cast(n as double) AS value FROM prepared WHERE doc_id % 19 <> 0
 UNION ALL SELECT doc_id, 1, 'discount_payment.tiers[0].fpl_high_pct', n + 50.5::double FROM prepared WHERE doc_id % 19 <> 0 AND doc_id % 3 = 0)"""

SQL_CLAIMS_GAPS = SQL_CLAIMS.replace("lang, n, corpus,", f"lang, n, {_GAP} AS corpus,")

_STEMS = "the|and|of|to|for|is|or|patient|hospital|income|los|las|de|para|con|el|la|que|paciente|ingresos|atenci"
_SQL_HITS = rf"len(regexp_extract_all({{t}}, '(?i)(^|[^\p{{{{L}}}}\p{{{{N}}}}_])({_STEMS})[\p{{{{L}}}}\p{{{{N}}}}_]*'))"
_SQL_DENSITY = "(1000.0::double * {hits} / greatest(length({t}), 1))"


def _density(t: str) -> str:
    return _SQL_DENSITY.format(hits=_SQL_HITS.format(t=t).replace("{{", "{").replace("}}", "}"), t=t)


_PCT = r"(?i)([0-9]{1,4}(?:\.[0-9]+)?)\s*(?:%|percent\b|per\s*cent\b)"
_MARK = r"(?i)\bFPL\b|\bFPG\b|federal\s+poverty|poverty\s+level|poverty\s+guideline|poverty\s+income"


def _spans_sql(name: str, source: str, column: str, pattern: str) -> str:
    """Offsets by a running sum over the pieces between matches."""
    return f"""{name}0 AS (SELECT doc_id, generate_subscripts(h, 1) AS i, unnest(h) AS hit, unnest(list_slice(g, 1, len(h))) AS gap
 FROM (SELECT doc_id, regexp_extract_all({column}, '{pattern}') AS h, string_split_regex({column}, '{pattern}') AS g FROM {source} WHERE {column} IS NOT NULL)),
{name} AS (SELECT *, cast(sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id ORDER BY i) - length(hit) as int) AS s,
 cast(sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id ORDER BY i) as int) AS e FROM {name}0)"""


SQL_SPANS = f"""{_spans_sql('mention', 'prepared', 'corpus', _PCT)}, {_spans_sql('mark', 'prepared', 'corpus', _MARK)},
support AS (SELECT c.doc_id, c.i AS ci, m.i AS mi, k.i AS ki, m.s AS pos, k.s AS ms, k.e AS me,
 least(abs(m.s - k.e), abs(k.s - m.s)) AS dist, m.s BETWEEN k.s AND k.e AS inside
 FROM claim c JOIN mention m ON m.doc_id = c.doc_id AND cast(regexp_extract(m.hit, '^[0-9]+(\\.[0-9]+)?') as double) = c.value
 JOIN mark k ON k.doc_id = c.doc_id)"""


@query("t02_intelligible", f"""SELECT doc_id, round({_density('text')}, 6) AS density, {_density('text')} >= 10 AS readable FROM documents""")
def intelligible(spark, sf_dir):
    text = F.col("text")
    return B.table(spark, sf_dir, "documents").select(
        "doc_id", F.round(T.stopword_density(text), 6).alias("density"),
        T.intelligible(text).alias("readable"))


@query("p04_route_unusable", f"""SELECT doc_id, length(trim(text)) < 500 OR NOT ({_density('text')} >= 10) AS needs_ocr, length(trim(text)) < 500 AS short FROM documents""")
def route_unusable(spark, sf_dir):
    text = F.col("text")
    return B.table(spark, sf_dir, "documents").select(
        "doc_id", (T.short_text(text) | ~T.intelligible(text)).alias("needs_ocr"),
        T.short_text(text).alias("short"))


@query("t03_percent_mentions", f"""WITH {SQL_CLAIMS}, {_spans_sql('mention', 'prepared', 'corpus', _PCT)}
SELECT doc_id, cast(regexp_extract(hit, '^[0-9]+(\\.[0-9]+)?') as double) AS value, s AS start FROM mention""")
def percent_mentions(spark, sf_dir):
    return claim_docs(spark, sf_dir).select(
        "doc_id", F.inline(T.percent_mentions(F.col("corpus"))))


@query("t04_marker_spans", f"""WITH {SQL_CLAIMS}, {_spans_sql('mark', 'prepared', 'corpus', _MARK)}
SELECT doc_id, s AS start, e AS "end", hit FROM mark""")
def marker_spans(spark, sf_dir):
    return claim_docs(spark, sf_dir).select("doc_id", F.inline(T.marker_spans(F.col("corpus"))))


@query("t05_ground_value", f"""WITH {SQL_CLAIMS}, {SQL_SPANS},
best AS (SELECT * FROM support WHERE dist <= 600 OR inside QUALIFY row_number() OVER (PARTITION BY doc_id, ci ORDER BY mi, ki) = 1)
SELECT c.doc_id, c.label, c.value, b.doc_id IS NOT NULL AS grounded,
 CASE WHEN b.doc_id IS NOT NULL THEN trim(regexp_replace(substr(p.corpus, greatest(0, least(pos, ms) - 60) + 1,
  least(length(p.corpus), greatest(pos, me) + 60) - greatest(0, least(pos, ms) - 60)), '\\s+', ' ', 'g')) END AS evidence
FROM claim c JOIN prepared p USING (doc_id) LEFT JOIN best b ON b.doc_id = c.doc_id AND b.ci = c.i
WHERE p.corpus IS NOT NULL""")
def ground_value(spark, sf_dir):
    docs = claim_docs(spark, sf_dir).filter("corpus IS NOT NULL").select("doc_id", "corpus", "claims")
    return G.ground_claims(docs)


@query("j13_proximity", f"""WITH {SQL_CLAIMS}, {SQL_SPANS}
SELECT c.doc_id, c.label, coalesce(bool_or(dist <= 40 OR inside), false) AS near
FROM claim c LEFT JOIN support s ON s.doc_id = c.doc_id AND s.ci = c.i GROUP BY ALL""")
def proximity(spark, sf_dir):
    """The same join with another window, as a yes/no per claim."""
    docs = G.with_mentions(claim_docs(spark, sf_dir))
    near = F.transform("claims", lambda c: F.struct(
        c["label"].alias("label"),
        F.coalesce(T.is_grounded(c["value"], F.col("_mentions"), F.col("_markers"), F.lit(40)),
                   F.lit(False)).alias("near")))
    return docs.select("doc_id", F.inline(near))


_SQL_VERDICT = f"""{SQL_CLAIMS_GAPS}, {SQL_SPANS}, ok AS (SELECT DISTINCT doc_id, ci FROM support WHERE dist <= 600 OR inside),
graded AS (SELECT c.doc_id, count(*) AS claims, count(ok.ci) AS good, count_if(ok.ci IS NULL AND label NOT LIKE '%tiers%') AS head_failed
 FROM claim c LEFT JOIN ok ON ok.doc_id = c.doc_id AND ok.ci = c.i GROUP BY 1),
state AS (SELECT p.*, coalesce(claims, 0) AS claims, good, head_failed, length(trim(corpus)) < 500 AS short, {_density('corpus')} >= 10 AS readable,
 sha256(corpus) AS live FROM prepared p LEFT JOIN graded USING (doc_id)),
verdict AS (SELECT doc_id, lang, claims, CASE WHEN corpus IS NULL THEN 'unverifiable' WHEN channel = 'pdf_ocr' AND (short OR NOT readable) THEN 'ocr_extracted'
 WHEN short THEN 'unverifiable' WHEN NOT readable THEN 'unreadable_source' WHEN nullif(stored, '') <> live THEN 'stale_source' WHEN claims = 0 THEN 'unverifiable'
 WHEN good = claims THEN 'grounded' WHEN head_failed > 0 THEN 'ungrounded' ELSE 'tier_edges_ungrounded' END AS verdict FROM state)"""


@query("r05_grounding_verdict", f"""WITH {_SQL_VERDICT} SELECT doc_id, verdict,
 cast(CASE WHEN verdict IN ('grounded', 'ungrounded', 'tier_edges_ungrounded') THEN claims ELSE 0 END as int) AS checked FROM verdict""")
def grounding_verdict(spark, sf_dir):
    return G.verdicts(claim_docs(spark, sf_dir, gaps=True)).select("doc_id", "verdict", "checked")


@query("r06_annotate", f"""WITH {_SQL_VERDICT} SELECT doc_id, verdict AS grounding, CASE WHEN verdict = 'grounded' THEN '2026-08-03' END AS last_verified_at FROM verdict""")
def annotate(spark, sf_dir):
    marked = G.annotate(G.verdicts(claim_docs(spark, sf_dir, gaps=True)), "2026-08-03")
    return marked.select("doc_id", F.col("grounding.verdict").alias("grounding"),
                         "last_verified_at")


@query("a07_verdict_tally", f"""WITH {_SQL_VERDICT}, t AS (SELECT lang, count(*) AS total, {", ".join(f"count(*) FILTER (verdict = '{v}') AS {v}" for v in ("grounded", "ungrounded", "tier_edges_ungrounded", "unverifiable", "ocr_extracted", "unreadable_source", "stale_source"))} FROM verdict GROUP BY 1)
SELECT *, round(100.0::double * grounded / nullif(total - unverifiable - ocr_extracted - unreadable_source - stale_source, 0), 1) AS auto_rate FROM t""")
def verdict_tally(spark, sf_dir):
    return G.verdict_tally(G.verdicts(claim_docs(spark, sf_dir, gaps=True)), ["lang"])


_WINDOWS = [10, 20, 300, 600, 1600]


@query("t06_window_sweep", f"""WITH {SQL_CLAIMS}, {SQL_SPANS}, w(win) AS (VALUES {", ".join(f"({w})" for w in _WINDOWS)}),
g AS (SELECT win, c.doc_id, c.i, coalesce(bool_or(dist <= win OR inside), false) AS ok FROM claim c
 JOIN prepared p USING (doc_id) JOIN w ON true LEFT JOIN support s ON s.doc_id = c.doc_id AND s.ci = c.i WHERE p.corpus IS NOT NULL GROUP BY ALL)
SELECT cast(win as int) AS "window", count(*) FILTER (ok) AS grounded, count(*) FILTER (NOT ok) AS ungrounded FROM g GROUP BY 1""")
def window_sweep(spark, sf_dir):
    return G.window_sweep(claim_docs(spark, sf_dir).filter("corpus IS NOT NULL"), _WINDOWS)


@query("j12_claims_to_corpus", f"""WITH {B.SQL_POLICY}, recs AS (SELECT 'https://example.org/p/' || doc_id AS permalink, text FROM documents)
SELECT k, length(r.text) AS chars, CASE WHEN r.permalink IS NOT NULL THEN verdict END AS verdict FROM pol p LEFT JOIN recs r ON r.permalink = p.permalink""")
def claims_to_corpus(spark, sf_dir):
    corpora = B.table(spark, sf_dir, "documents").selectExpr(
        "concat('https://example.org/p/', doc_id) AS permalink", "text")
    joined = G.join_corpora(B.policies(spark, sf_dir), corpora)
    return joined.select(F.col("pos").alias("k"),
                         F.length("corpus").cast("bigint").alias("chars"),
                         F.col("grounding.verdict").alias("verdict"))


@query("p06_published_thresholds", f"""WITH {B.SQL_POLICY}, {B.SQL_TIERS}
SELECT k, 'free_care.fpl_ceiling_pct' AS label, fc AS value FROM pol WHERE fc IS NOT NULL
UNION ALL SELECT k, 'discount_payment.fpl_ceiling_pct', dc FROM pol WHERE dc IS NOT NULL
UNION ALL SELECT k, 'discount_payment.tiers[' || idx || '].fpl_high_pct', hi FROM tier WHERE hi IS NOT NULL""")
def published_thresholds(spark, sf_dir):
    return B.policies(spark, sf_dir).select(
        F.col("pos").alias("k"), F.inline(G.published_thresholds(F.col("policy"))))


@query("j13_proximity_exploded", f"""WITH {SQL_CLAIMS}, {SQL_SPANS}, best AS (SELECT * FROM support WHERE dist <= 600 OR inside QUALIFY row_number() OVER (PARTITION BY doc_id, ci ORDER BY mi, ki) = 1)
SELECT c.doc_id, c.label, c.value, b.doc_id IS NOT NULL AS grounded, b.pos AS start, b.ms AS marker_start, b.me AS marker_end
FROM claim c LEFT JOIN best b ON b.doc_id = c.doc_id AND b.ci = c.i""")
def proximity_exploded(spark, sf_dir):
    """Claims, mentions and markers as rows that meet in bins of the window's width."""
    docs = claim_docs(spark, sf_dir)
    texts = docs.select("doc_id", F.col("corpus").alias("text"))
    claims = docs.select("doc_id", F.inline("claims"))
    return P.ground_exploded(claims, P.mention_rows(texts, "doc_id"), P.marker_rows(texts, "doc_id"), "doc_id")
