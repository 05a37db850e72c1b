"""The intake conversation as a keyed stateful stream.

Two streams follow each other.  The first finds the hospital that a message names, as a batch
operator on each trigger's messages, and lands the messages.  The second keeps each sender's step and
answers in Spark's own keyed state and writes the replies, the plans of conversations that have just come to
their end and the letters asked for.  A message without sender is answered from a state that is
thrown away."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from rulegrain.functions import scalars as S
from rulegrain.operators import dialogue as D
from rulegrain.operators import directory as Y
from rulegrain.sources.readers import exists
from rulegrain.streaming.state import use_state_store

STATE = ("step int, session bigint, said_es boolean, hospital_id bigint, income bigint, household bigint, "
         "insured boolean, in_collections boolean")
REPLIES = ("sender string, at bigint, step int, session bigint, reply string, lang string, hospital_id bigint, "
           "income bigint, household bigint, insured boolean, in_collections boolean")
RESOLVED = "sender string, at bigint, text string, target bigint"
_FRESH = (0, 0, False, None, None, None, None, None)


class Talk(StatefulProcessor):
    """One sender: messages are taken one by one, in order of `at`; a trigger's messages of a sender
    are narrow (no text) and as many as the source's trigger options let through."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle) -> None:
        self.talk = handle.getValueState("talk", STATE, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        step, session, said_es, *answers = self.talk.get() if self.talk.exists() else _FRESH
        for m in sorted(rows, key=lambda row: row["at"]):
            before, moved = step, m["move"][step] > step
            if m["restart"]:
                session, said_es, answers = session + 1, False, [None] * 5
            elif step == D.LANG:
                said_es = m["says_es"]
            elif moved and D.HOSPITAL <= step <= D.COLLECTIONS:
                answers[step - D.HOSPITAL] = {D.HOSPITAL: m["target"], D.INCOME: m["number"], D.HOUSEHOLD: m["number"],
                                              D.INSURANCE: m["says_yes"], D.COLLECTIONS: m["says_yes"]}[step]
            spanish = said_es and not m["restart"] and before != D.WELCOME
            step = m["move"][step]
            yield Row(sender=key[0], at=m["at"], step=before, session=session, reply=m["replies"][before],
                      lang="es" if spanish else "en", hospital_id=answers[0], income=answers[1], household=answers[2],
                      insured=answers[3], in_collections=answers[4])
        self.talk.update((step, session, said_es, *answers))

    def close(self) -> None:
        pass


def conversation_stream(messages: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Replies to a stream of (sender, at, text, target).  A sender's state stays, or is dropped
    by Spark after `ttl_ms` of silence (with a trigger that goes on: `availableNow` needs None)."""
    use_state_store(messages.sparkSession)
    featured = D.message_features(messages)
    known = (featured.filter(S.blank_to_null(F.col("sender")).isNotNull())
             .withColumn("move", D.move())
             .withColumn("replies", F.array(*[D.reply_key(F.lit(s)) for s in range(len(D.STEPS))]))
             .select("sender", "at", "restart", "says_es", "number", "says_yes", "target", "move", "replies"))
    told = known.groupBy("sender").transformWithState(
        Talk(ttl_ms), REPLIES, "append", "none" if ttl_ms is None else "processingTime")
    once = D.answered_alone(featured.filter(S.blank_to_null(F.col("sender")).isNull()))
    return told.unionByName(once.select("sender", "at", "step", "session", "reply", "lang"), allowMissingColumns=True)


def land_resolved(messages: DataFrame, index: DataFrame, postings: DataFrame, folder: str, **trigger) -> StreamingQuery:
    """Start the stream that adds `target` and lands the messages below `folder`/resolved.

    A trigger that has landed is not landed again."""
    def step(batch: DataFrame, batch_id: int) -> None:
        out = f"{folder}/resolved/batch={batch_id:012d}"
        if not exists(batch.sparkSession, f"{out}/_SUCCESS"):
            named = Y.find_hospitals(batch.withColumn("name", F.trim("text")), index, postings=postings)
            named.select("sender", "at", "text", "target").write.mode("overwrite").parquet(out)
    return (messages.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/landing")
            .trigger(**trigger).start())


def answer_resolved(spark: SparkSession, policies: DataFrame, folder: str, today: str, ttl_ms: int | None = None,
                    **trigger) -> StreamingQuery:
    """Start the stream from landed messages to `folder`/replies, /plans and /letters."""
    def step(batch: DataFrame, batch_id: int) -> None:
        at = lambda kind: f"{folder}/{kind}/batch={batch_id:012d}"
        batch.write.mode("overwrite").parquet(at("replies"))
        told = batch.sparkSession.read.schema(REPLIES).parquet(at("replies"))
        D.plan_replies(told, policies).write.mode("overwrite").parquet(at("plans"))
        D.letter_replies(told, policies, today).write.mode("overwrite").parquet(at("letters"))
    landed = spark.readStream.schema(RESOLVED).option("recursiveFileLookup", True).parquet(f"{folder}/resolved")
    return (conversation_stream(landed, ttl_ms).writeStream.foreachBatch(step)
            .option("checkpointLocation", f"{folder}/talk").trigger(**trigger).start())
