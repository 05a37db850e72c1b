"""The intake conversation: one question per message, per sender, in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulegrain import reference_values as V
from rulegrain.functions import scalars as S
from rulegrain.operators.scan import FANOUT, LEVELS, steps_before
from rulegrain.rules import with_rules
from rulegrain.session import settle

STEPS = ["welcome", "lang", "hospital", "income", "household", "insurance", "collections", "done"]
WELCOME, LANG, HOSPITAL, INCOME, HOUSEHOLD, INSURANCE, COLLECTIONS, DONE = range(8)


def message_features(messages: DataFrame, text: str = "text") -> DataFrame:
    """What a message can mean at any step; `target` (the hospital it names) is given."""
    word = F.lower(F.trim(F.coalesce(F.col(text), F.lit(""))))
    number = S.parse_int_loose(F.col(text))
    return (messages.withColumn("_word", word)
            .withColumn("restart", F.col("_word").isin(V.RESTART_WORDS))
            .withColumn("says_es", F.col("_word").startswith("2") | F.col("_word").startswith("es"))
            .withColumn("number", number)
            .withColumn("says_yes", F.col("_word").isin(V.YES_WORDS))
            .withColumn("yes_or_no", F.col("_word").isin(V.YES_WORDS + V.NO_WORDS))
            .withColumn("wants_letter", F.col("_word").isin(V.LETTER_WORDS))
            .drop("_word"))


def accepted_at(step: int) -> Column:
    """Does the message move this step forward?"""
    return {
        WELCOME: F.lit(True), LANG: F.lit(True), HOSPITAL: F.col("target").isNotNull(),
        INCOME: F.col("number").isNotNull(), HOUSEHOLD: F.coalesce(F.col("number") >= 1, F.lit(False)),
        INSURANCE: F.col("yes_or_no"), COLLECTIONS: F.col("yes_or_no"), DONE: F.lit(False),
    }[step]


def move() -> Column:
    """Next step by step, as an array."""
    forward = [F.when(accepted_at(s), F.lit(s + 1)).otherwise(F.lit(s)) for s in range(len(STEPS))]
    restarted = F.array(*[F.lit(LANG)] * len(STEPS))
    return F.when(F.col("restart"), restarted).otherwise(F.array(*forward))


def reply_key(step: Column) -> Column:
    """The reply to a message taken at `step`."""
    def ask(n: int, yes: str, no: str) -> Column:
        return F.when(accepted_at(n), F.lit(yes)).otherwise(F.lit(no))
    return (F.when(F.col("restart"), F.lit("restart"))
             .when(step == WELCOME, F.lit("welcome"))
             .when(step == LANG, F.lit("ask_hospital"))
             .when(step == HOSPITAL, ask(HOSPITAL, "ask_income", "hospital_not_found"))
             .when(step == INCOME, ask(INCOME, "ask_household", "ask_number"))
             .when(step == HOUSEHOLD, ask(HOUSEHOLD, "ask_insurance", "ask_number"))
             .when(step == INSURANCE, ask(INSURANCE, "ask_collections", "ask_insurance"))
             .when(step == COLLECTIONS, ask(COLLECTIONS, "plan", "ask_collections"))
             .when(F.col("wants_letter"), F.lit("letter_sent"))
             .otherwise(F.lit("plan_footer")))


def converse(messages: DataFrame, entry: DataFrame | None = None, fanout: int = FANOUT,
             levels: int = LEVELS) -> DataFrame:
    """Add `step`, `session`, `reply`, `lang` and the answers known to each message's session.

    `messages`: sender, at (unique per sender, from 0), text, target.  A message without sender
    is answered as a conversation of its own.  Runs a job."""
    alone = messages.filter(S.blank_to_null(F.col("sender")).isNull())
    known = messages.filter(S.blank_to_null(F.col("sender")).isNotNull())
    # the features feed every level of the scan: computed once and kept reliably
    featured = settle(message_features(known).withColumn("move", move())
                      .withColumn("resets", F.col("restart").cast("bigint")))
    before = steps_before(featured, len(STEPS), entry=entry, fanout=fanout, levels=levels)
    placed = featured.drop("move", "resets").join(before, ["sender", "at"]) \
        .withColumn("session", F.col("resets") + F.col("restart").cast("bigint"))
    step, live = F.col("step"), ~F.col("restart")

    def answer(n: int, value: Column, name: str) -> Column:
        """A step is passed once per session, so any aggregate finds its answer."""
        return F.max(F.when(live & (step == n) & accepted_at(n), value)).alias(name)

    lang_said = F.when(F.col("says_es"), F.lit("es")).otherwise(F.lit("en"))
    answers = placed.groupBy("sender", "session").agg(
        answer(LANG, lang_said, "said_lang"), answer(HOSPITAL, F.col("target"), "hospital_id"),
        answer(INCOME, F.col("number"), "income"), answer(HOUSEHOLD, F.col("number"), "household"),
        answer(INSURANCE, F.col("says_yes"), "insured"),
        answer(COLLECTIONS, F.col("says_yes"), "in_collections"))
    told = placed.join(answers, ["sender", "session"]) \
        .withColumn("reply", reply_key(step)) \
        .withColumn("lang", F.when(F.col("restart") | (step == WELCOME), F.lit("en"))
                    .otherwise(F.coalesce("said_lang", F.lit("en"))))
    return told.unionByName(answered_alone(message_features(alone)), allowMissingColumns=True)


def answered_alone(featured: DataFrame) -> DataFrame:
    """Messages without sender: each one opens a conversation that nobody remembers."""
    return (featured.withColumn("step", F.lit(WELCOME)).withColumn("session", F.col("restart").cast("bigint"))
            .withColumn("reply", reply_key(F.lit(WELCOME))).withColumn("lang", F.lit("en")))


def _scored(told: DataFrame, reply: str, policies: DataFrame, row_id: str) -> DataFrame:
    """Messages with that reply, scored by their session's answers against the hospital named in it."""
    from rulegrain.operators import eligibility as E

    done = told.filter(F.col("reply") == reply).select(
        "sender", "at", "lang", "hospital_id", "insured", "in_collections",
        F.col("income").alias("annual_income"),
        F.col("household").cast("int").alias("household_size"))
    scored = (done.join(policies, F.col("hospital_id") == F.col(row_id))
              .withColumn("fpl_pct", S.fpl_percent(F.col("annual_income"),
                                                   F.col("household_size"))))
    return E.with_policy_tier(scored)


def letter_replies(told: DataFrame, policies: DataFrame, today: str, row_id: str = "pos") -> DataFrame:
    """(sender, at, tier, letter): the letters asked for after a plan.  The sender is anonymous, so the
    letter addresses the hospital in the name of `V.ANONYMOUS`."""
    from rulegrain.operators import catalog as C

    asked = _scored(told, "letter_sent", policies, row_id).withColumn("full_name", F.lit(V.ANONYMOUS))
    if "state" not in asked.columns:
        asked = asked.withColumn("state", F.lit(None).cast("string"))
    lawful = with_rules(asked, out="_rules").withColumn("law", F.col("_rules.law")).drop("_rules", "phone", "address")
    return C.letters(lawful, today).select("sender", "at", "tier", "letter")


def plan_replies(told: DataFrame, policies: DataFrame, row_id: str = "pos") -> DataFrame:
    """The plan message of conversations that just completed, as ordered text keys.

    A tier without a text of its own (an unreadable policy) gives the apology reply."""
    tiered = _scored(told, "plan", policies, row_id)
    lines = F.array_compact(F.array(
        F.concat(F.lit("plan_"), F.col("tier")), F.lit("plan_apply"), F.lit("plan_benefit"),
        F.when(F.col("in_collections"), F.lit("plan_debt")), F.lit("plan_letter"),
        F.lit("plan_footer")))
    return tiered.select("sender", "at", "lang", "tier", "fpl_pct", F.when(
        F.col("tier") == "unknown", F.array(F.lit("sorry"))).otherwise(lines).alias("lines"))
