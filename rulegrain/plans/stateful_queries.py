"""Stateful operators: admission, conversations and refresh, as batches and as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from rulegrain.operators import dialogue as D
from rulegrain.operators import directory as Y
from rulegrain.operators.admission import admit
from rulegrain.operators.snapshots import last_records
from rulegrain.plans import bindings as B
from rulegrain import reference_values as V
from rulegrain.plans.change_queries import CURRENT, SQL_SNAPSHOTS, snapshot
from rulegrain.plans.directory_queries import _SQL_LABELLED, named_rows, sql_letter
from rulegrain.plans.eligibility_queries import _SQL_BAND, _SQL_MATCH
from rulegrain.plans.registry import query
from rulegrain.session import scratch_path, settle
from rulegrain.streaming import conversation, rate_limit, refresh

# --- admission: events by user, two in six hours ---------------------------------------------

LIMIT, HOURS = 2, 6
_WINDOW = HOURS * 3600
_SQL_ADMIT = f"""WITH RECURSIVE h AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
f AS (SELECT user_id, event_id, rn, [t] AS recent, true AS admitted FROM h WHERE rn = 1
 UNION ALL SELECT h.user_id, h.event_id, h.rn,
  CASE WHEN len(list_filter(f.recent, lambda x: x > h.t - {_WINDOW * 1_000_000})) < {LIMIT} THEN list_append(list_filter(f.recent, lambda x: x > h.t - {_WINDOW * 1_000_000}), h.t)
   ELSE f.recent END, len(list_filter(f.recent, lambda x: x > h.t - {_WINDOW * 1_000_000})) < {LIMIT} FROM f JOIN h ON h.user_id = f.user_id AND h.rn = f.rn + 1)
SELECT user_id, event_id, admitted FROM f"""


def request_log(spark, sf_dir):
    return B.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("key"), "ts", F.col("event_id").alias("id"))


@query("w08_rate_limit_admission", _SQL_ADMIT)
def rate_limit_admission(spark, sf_dir):
    return admit(request_log(spark, sf_dir), LIMIT, _WINDOW).select(
        F.col("key").alias("user_id"), F.col("id").alias("event_id"), "admitted")


@query("st02_rate_limit_stream", _SQL_ADMIT)
def rate_limit_stream(spark, sf_dir):
    """The same decisions from a file stream, in pieces that arrive one after the other."""
    source, folder = scratch_path(spark, "hits"), scratch_path(spark, "admission")
    log = request_log(spark, sf_dir)
    first, last = log.agg(F.min("ts"), F.max("ts")).first()
    half = first + (last - first) / 2
    for piece in (F.col("ts") < F.lit(half), F.col("ts") >= F.lit(half)):
        log.filter(piece).write.mode("append").parquet(source)
        hits = spark.readStream.schema(log.schema).parquet(source)
        (rate_limit.admission_stream(hits, LIMIT, _WINDOW).writeStream.format("parquet")
         .option("path", f"{folder}/decided").option("checkpointLocation", f"{folder}/checkpoint")
         .trigger(availableNow=True).start().awaitTermination())
    return spark.read.parquet(f"{folder}/decided").select(
        F.col("key").alias("user_id"), F.col("id").alias("event_id"), "admitted")


# --- conversations: a sender holds five dialogues in a row; every text is followed by a scripted word ------

_SCRIPT = """CASE (conv_id % 5 * 5 + turn) % 12 WHEN 0 THEN 'hi' WHEN 1 THEN CASE WHEN conv_id % 2 = 0 THEN '2' ELSE 'English' END
 WHEN 2 THEN CASE conv_id % 3 WHEN 0 THEN ' small ring ' WHEN 1 THEN 'red' ELSE 'l ring' END WHEN 3 THEN ' small ring ' WHEN 4 THEN '$40,' || lpad(cast(conv_id % 1000 as {s}), 3, '0')
 WHEN 5 THEN cast(conv_id % 7 as {s}) WHEN 6 THEN 'maybe' WHEN 7 THEN 'NO' WHEN 8 THEN 'yes' WHEN 9 THEN 'CARTA' WHEN 10 THEN CASE WHEN conv_id % 4 = 0 THEN 'inicio' ELSE '3' END ELSE 'carta' END"""
_SENDER = "CASE WHEN conv_id % 29 = 3 THEN '' ELSE 'tel:' || (conv_id // 5) END"


_AT = "conv_id % 5 * 1000000 + turn * 2"


def inbound(spark, sf_dir):
    """Every text of the table as a message of its sender, and a word of the script after it."""
    said = F.explode(F.array(F.struct(F.lit(0).alias("nth"), F.col("text").alias("said")),
                             F.struct(F.lit(1).alias("nth"), F.expr(_SCRIPT.format(s="string")).alias("said"))))
    sender = _SENDER.replace("conv_id // 5", "conv_id div 5")
    return B.table(spark, sf_dir, "conversations").select("conv_id", "turn", said.alias("m")).selectExpr(
        f"{sender} AS sender", f"{_AT} + m.nth AS at", "m.said AS text", "conv_id", "turn")


def inbound_resolved(spark, sf_dir):
    index = Y.name_index(named_rows(spark, sf_dir))
    asked = inbound(spark, sf_dir).withColumn("name", F.trim("text"))
    return Y.find_hospitals(asked, index).drop("name")


_SQL_TALK = f"""{_SQL_LABELLED}, msg AS (SELECT {_SENDER} AS sender, {_AT} AS "at", conv_id, turn, text FROM conversations
 UNION ALL SELECT {_SENDER}, {_AT} + 1, conv_id, turn, {_SCRIPT.format(s='varchar')} FROM conversations),
within AS (SELECT needle, arg_min(target, ord) AS target FROM (SELECT DISTINCT upper(trim(text)) AS needle FROM msg) JOIN idx ON contains(key, needle) WHERE length(needle) >= 4 GROUP BY 1),
feat AS (SELECT m.*, lower(trim(text)) AS w, coalesce(e.target, x.target) AS target, CASE WHEN regexp_full_match(trim(regexp_replace(trim(text), '[$,]', '', 'g')), '[+-]?[0-9]+')
  THEN try_cast(trim(regexp_replace(trim(text), '[$,]', '', 'g')) as bigint) END AS num,
  row_number() OVER (PARTITION BY sender ORDER BY "at") AS rn FROM msg m LEFT JOIN idx e ON e.key = upper(trim(text)) LEFT JOIN within x ON x.needle = upper(trim(text)) WHERE sender <> ''),
m AS (SELECT *, w IN ('start', 'restart', 'reset', 'inicio') AS restart, w LIKE '2%' OR w LIKE 'es%' AS es, w IN ('y', 'yes', 'yeah', 'yep', 'si', 'sí', 's', '1', 'true', 'n', 'no', 'nope', '0', 'false') AS yn,
  w IN ('letter', 'carta') AS letter FROM feat),
talk AS (SELECT sender, "at", conv_id, turn, rn, 0 AS step, cast(restart as bigint) AS session, CASE WHEN restart THEN 'restart' ELSE 'welcome' END AS reply, 'en' AS lang, 1 AS nxt, false AS said_es,
  cast(null as bigint) AS hosp, cast(null as bigint) AS inc, cast(null as bigint) AS hh, false AS insured, false AS coll FROM m WHERE rn = 1
 UNION ALL SELECT m.sender, m."at", m.conv_id, m.turn, m.rn, t.nxt, t.session + cast(m.restart as bigint),
  CASE WHEN m.restart THEN 'restart' WHEN t.nxt = 1 THEN 'ask_hospital' WHEN t.nxt = 2 THEN CASE WHEN target IS NULL THEN 'hospital_not_found' ELSE 'ask_income' END
   WHEN t.nxt = 3 THEN CASE WHEN num IS NULL THEN 'ask_number' ELSE 'ask_household' END WHEN t.nxt = 4 THEN CASE WHEN num >= 1 THEN 'ask_insurance' ELSE 'ask_number' END
   WHEN t.nxt = 5 THEN CASE WHEN yn THEN 'ask_collections' ELSE 'ask_insurance' END WHEN t.nxt = 6 THEN CASE WHEN yn THEN 'plan' ELSE 'ask_collections' END
   WHEN letter THEN 'letter_sent' ELSE 'plan_footer' END,
  CASE WHEN m.restart THEN 'en' WHEN t.nxt = 1 THEN CASE WHEN es THEN 'es' ELSE 'en' END WHEN t.said_es THEN 'es' ELSE 'en' END,
  CASE WHEN m.restart THEN 1 WHEN t.nxt = 7 THEN 7 WHEN t.nxt = 2 AND target IS NULL THEN 2 WHEN t.nxt = 3 AND num IS NULL THEN 3 WHEN t.nxt = 4 AND NOT coalesce(num >= 1, false) THEN 4
   WHEN t.nxt IN (5, 6) AND NOT yn THEN t.nxt ELSE t.nxt + 1 END,
  CASE WHEN m.restart THEN false WHEN t.nxt = 1 THEN es ELSE t.said_es END,
  CASE WHEN t.nxt = 2 THEN target ELSE t.hosp END, CASE WHEN t.nxt = 3 THEN num ELSE t.inc END, CASE WHEN t.nxt = 4 THEN num ELSE t.hh END,
  CASE WHEN t.nxt = 5 THEN w IN ('y', 'yes', 'yeah', 'yep', 'si', 'sí', 's', '1', 'true') ELSE t.insured END,
  CASE WHEN t.nxt = 6 THEN w IN ('y', 'yes', 'yeah', 'yep', 'si', 'sí', 's', '1', 'true') ELSE t.coll END
 FROM talk t JOIN m ON m.sender = t.sender AND m.rn = t.rn + 1)"""


_SQL_ALONE = """SELECT sender, "at", conv_id, turn, 0 AS step, cast(lower(trim(text)) IN ('start', 'restart', 'reset', 'inicio') as bigint) AS session,
 CASE WHEN lower(trim(text)) IN ('start', 'restart', 'reset', 'inicio') THEN 'restart' ELSE 'welcome' END AS reply, 'en' AS lang FROM msg WHERE sender = ''"""
_SQL_TOLD = f"""told AS (SELECT sender, "at", conv_id, turn, cast(step as int) AS step, session, reply, lang FROM talk UNION ALL {_SQL_ALONE})"""


@query("st01_intake_conversation", f"""WITH RECURSIVE {_SQL_TALK}, {_SQL_TOLD} SELECT sender, conv_id, turn, "at", step, session, reply, lang FROM told""")
def intake_conversation(spark, sf_dir):
    return D.converse(inbound_resolved(spark, sf_dir)).select(
        "sender", "conv_id", "turn", "at", "step", "session", "reply", "lang")


_SQL_LINES = """CASE WHEN tier = 'unknown' THEN 'sorry' ELSE 'plan_' || tier || ',plan_apply,plan_benefit' || CASE WHEN coll THEN ',plan_debt' ELSE '' END || ',plan_letter,plan_footer' END"""
_SQL_ANSWERED = f"""done AS (SELECT t.*, p.* EXCLUDE (city), {B.sql_pct('t.inc', 't.hh')} AS fpl_pct FROM talk t JOIN pol p ON p.k = t.hosp WHERE t.reply IN ('plan', 'letter_sent')),
b AS (SELECT *, {_SQL_BAND} AS band FROM done), c AS (SELECT *, split_part({_SQL_MATCH}, ':', 1) AS tier FROM b)"""
_SQL_LETTERS = f"""lawful AS (SELECT c.*, CASE WHEN upper(coalesce(nullif(c.state, ''), 'CA')) = 'CA' THEN 'California''s Hospital Fair Pricing Act' ELSE coalesce(m.law, d.law) END AS law
 FROM c LEFT JOIN (SELECT * FROM rules WHERE code <> 'US') m ON m.code = upper(coalesce(nullif(c.state, ''), 'CA')) JOIN (SELECT * FROM rules WHERE code = 'US') d ON true WHERE c.reply = 'letter_sent'),
letters AS (SELECT sender, "at", md5('{sql_letter(full_name="'" + V.ANONYMOUS + "'", household_size="hh", annual_income="inc")}') AS letter_md5 FROM lawful)"""
_TODAY = "July 14, 2026"


@query("st01_conversation_stream", f"""WITH RECURSIVE {_SQL_TALK}, {_SQL_TOLD}, {B.SQL_POLICY}, {B.sql_rules()}, {_SQL_ANSWERED}, {_SQL_LETTERS}
SELECT t.sender, t."at", t.step, t.session, t.reply, t.lang, {_SQL_LINES} AS lines, l.letter_md5
FROM told t LEFT JOIN c ON c.sender = t.sender AND c."at" = t."at" AND c.reply = 'plan' LEFT JOIN letters l ON l.sender = t.sender AND l."at" = t."at" """)
def conversation_stream(spark, sf_dir):
    """The same replies from keyed streams, with the plans and letters that they send."""
    source, folder = scratch_path(spark, "messages"), scratch_path(spark, "talk")
    known = Y.name_index(named_rows(spark, sf_dir))
    index, postings = settle(known), settle(Y.gram_index(known))
    messages, policies = inbound(spark, sf_dir).select("sender", "at", "text"), settle(B.policies(spark, sf_dir))
    for piece in ("at < 2000000", "at >= 2000000"):  # in the order of the messages of a sender
        messages.filter(piece).write.mode("append").parquet(source)
        arriving = spark.readStream.schema(messages.schema).parquet(source)
        conversation.land_resolved(arriving, index, postings, folder, availableNow=True).awaitTermination()
        conversation.answer_resolved(spark, policies, folder, _TODAY, availableNow=True).awaitTermination()
    kept = lambda kind: spark.read.parquet(f"{folder}/{kind}").drop("batch")
    plans = kept("plans").select("sender", "at", F.array_join("lines", ",").alias("lines"))
    letters = kept("letters").select("sender", "at", F.md5("letter").alias("letter_md5"))
    told = kept("replies").select("sender", "at", "step", "session", "reply", "lang")
    return told.join(plans, ["sender", "at"], "left").join(letters, ["sender", "at"], "left")


@query("st01_plan_replies", f"""WITH RECURSIVE {_SQL_TALK}, {B.SQL_POLICY}, {_SQL_ANSWERED} SELECT sender, "at", lang, tier, fpl_pct, {_SQL_LINES} AS lines FROM c WHERE reply = 'plan'""")
def plan_replies(spark, sf_dir):
    """Plan messages of completed conversations."""
    told = D.converse(inbound_resolved(spark, sf_dir))
    return D.plan_replies(told, B.policies(spark, sf_dir)).withColumn(
        "lines", F.array_join("lines", ","))


# --- refresh: snapshots that are merged, held back for their number, refused and merged ----------------------

#: Which of the table's records each arriving snapshot shows, and for which of them it shows a new url.
_ARRIVING = [("true", "false"), ("true", "key BETWEEN 11 AND 35"), ("true", "key % 3 = 0"), ("key % 2 = 0", "false"),
             ("key NOT BETWEEN 71 AND 95", "key BETWEEN 111 AND 135")]
_BUCKETS = 16


@query("st03_incremental_refresh", f"""WITH {SQL_SNAPSHOTS} SELECT cast(key as varchar) AS key, hospital, CASE WHEN key BETWEEN 111 AND 135 THEN 'https://new/' || key ELSE c_url END AS c_url,
 c_date, d_url, d_date, content_sha FROM cur WHERE key NOT BETWEEN 71 AND 95""")
def incremental_refresh(spark, sf_dir):
    """Five snapshots arrive as a stream under the guards in force: one is merged, one exceeds the number of
    changes, one has lost half its rows, the last one is merged; the merged table."""
    source, folder = scratch_path(spark, "snapshots"), scratch_path(spark, "refresh")
    whole = settle(last_records(snapshot(spark, sf_dir, CURRENT)).drop("region", "pos"))
    for shown, renewed in _ARRIVING:
        url = F.when(F.expr(renewed), F.concat(F.lit("https://new/"), F.col("key"))).otherwise(F.col("charity_care.url"))
        piece = whole.filter(shown).withColumn("charity_care", F.col("charity_care").withField("url", url))
        piece.withColumn("key", F.col("key").cast("string")).write.mode("append").parquet(source, compression="zstd")
        arriving = spark.readStream.schema(refresh.SNAPSHOT).parquet(source)
        refresh.refresh_stream(arriving, folder, buckets=_BUCKETS).awaitTermination()
    return refresh.baseline_table(spark, folder, _BUCKETS).read().select(
        "key", "hospital", F.col("charity_care.url").alias("c_url"), F.col("charity_care.effective_date").alias("c_date"),
        F.col("discount_payment.url").alias("d_url"), F.col("discount_payment.effective_date").alias("d_date"), "content_sha")
