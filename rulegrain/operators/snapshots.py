"""Change detection between two snapshots of the source, and the guards on acting on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from rulegrain import reference_values as V
from rulegrain.operators.dedup import last_per_key

COMPARED = ["charity_care", "discount_payment"]      # debt_collection is not compared


def fingerprints(records: DataFrame, sha: Column | None = None) -> DataFrame:
    """(key, hospital, charity_care, discount_payment, content_sha) of source records, with `pos` where
    the records have one."""
    def signal(section: str) -> Column:
        entry = F.try_element_at("policies", F.lit(section))
        return F.struct(entry["current_policy_url"].alias("url"),
                        entry["current_effective_date"].alias("effective_date"))
    return records.select(
        F.coalesce(F.nullif("permalink", F.lit("")), "post_title").alias("key"),
        F.col("post_title").alias("hospital"),
        *[signal(s).alias(s) for s in COMPARED], *[c for c in records.columns if c == "pos"],
        (sha if sha is not None else F.lit(None).cast("string")).alias("content_sha"))


def _or_none(value: Column) -> Column:
    return F.coalesce(value, F.lit("None"))


def diff(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """(key, hospital, change, deltas) for every key that is new, removed or changed.

    Of several records of one key the last counts (`last_records`)."""
    return _diff(last_records(current), last_records(baseline), None)


def observed_diff(current: DataFrame, baseline: DataFrame, unique_baseline: bool = False,
                  with_rows: bool = False) -> tuple[DataFrame, Observation]:
    """`diff`, and what the guards count, collected while its rows are made.

    A baseline with one record a key needs no search for the last one.  `with_rows` adds `now`, the
    current record of a new or changed key.

    Both sides are counted by key where they meet, in the stage whose tasks make the result, so a
    task that runs again counts once.  The counts are there after one action on the rows."""
    counts = Observation()
    return _diff(last_records(current), baseline if unique_baseline else last_records(baseline), counts, with_rows), counts


def observed_metrics(counts: Observation) -> tuple[int, int, int, int]:
    """(n, removed, current, baseline) as `guard_metrics` has them for snapshots without repeated keys."""
    return tuple(counts.get[name] for name in ("n", "removed", "current", "baseline"))


def _diff(current: DataFrame, baseline: DataFrame, counts: Observation | None, with_rows: bool = False) -> DataFrame:
    c, b = current.alias("c"), baseline.alias("b")
    joined = c.join(b, F.col("c.key") == F.col("b.key"), "full_outer")
    deltas = []
    for section in COMPARED:
        now, was = F.col(f"c.{section}"), F.col(f"b.{section}")
        deltas.append(F.when(
            ~now["effective_date"].eqNullSafe(was["effective_date"]),
            F.concat(F.lit(f"{section}.date "), _or_none(was["effective_date"]),
                     F.lit(" -> "), _or_none(now["effective_date"]))))
        deltas.append(F.when(~now["url"].eqNullSafe(was["url"]),
                             F.lit(f"{section}.url")))
    stated = F.array_compact(F.array(*deltas))
    cs, bs = F.nullif("c.content_sha", F.lit("")), F.nullif("b.content_sha", F.lit(""))
    silent = F.array_compact(F.array(F.when(
        cs != bs, F.lit("content"))))
    no_deltas = F.array().cast("array<string>")
    met = joined.select(
        F.coalesce("c.key", "b.key").alias("key"),
        F.coalesce("c.hospital", "b.hospital").alias("hospital"),
        F.when(F.col("b.key").isNull(), F.lit("new"))
         .when(F.col("c.key").isNull(), F.lit("removed"))
         .otherwise(F.lit("common")).alias("change"),
        stated.alias("_stated"), silent.alias("_silent"),
        *([F.when(F.col("c.key").isNotNull(), F.struct("c.*")).alias("now")] if with_rows else [])) \
        .withColumn("deltas", F.when(F.col("change") != "common", no_deltas)
                    .when(F.size("_stated") > 0, F.col("_stated")).otherwise(F.col("_silent")))
    differs = (F.col("change") != "common") | (F.size("deltas") > 0)
    if counts is not None:
        met = met.observe(counts, F.count_if(differs & (F.col("change") != "removed")).alias("n"),
                          F.count_if(F.col("change") == "removed").alias("removed"),
                          F.count_if(F.col("change") != "removed").alias("current"),
                          F.count_if(F.col("change") != "new").alias("baseline"))
    return met.filter(differs).select("key", "hospital", F.when(F.col("change") == "common", F.lit("changed"))
                                      .otherwise(F.col("change")).alias("change"), "deltas", *(["now"] if with_rows else []))


def last_records(snapshot: DataFrame) -> DataFrame:
    """One record a key: the last by `pos`; without that column, the largest by its columns."""
    if "pos" in snapshot.columns:
        return last_per_key(snapshot, ["key"])
    rest = [c for c in snapshot.columns if c != "key"]
    return snapshot.groupBy("key").agg(F.max(F.struct(*rest)).alias("last")).select("key", "last.*")


def key_sets(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """(key, membership): new, removed or common."""
    now = current.select("key").distinct()
    was = baseline.select("key").distinct()
    label = lambda df, name: df.withColumn("membership", F.lit(name))
    return (label(now.join(was, "key", "left_anti"), "new")
            .unionByName(label(was.join(now, "key", "left_anti"), "removed"))
            .unionByName(label(now.join(was, "key", "left_semi"), "common")))


def guard_metrics(changes: DataFrame, current: DataFrame, baseline: DataFrame,
                  group: list[str] | None = None) -> DataFrame:
    """changed + new, removed, and both snapshot sizes; one row per group (or one in all).

    All inputs carry the group columns.  Counts are tagged, united and summed, so an empty
    side still gives its zero."""
    group = group or []
    nothing = F.lit(0).cast("bigint")
    names = ["n", "removed", "current", "baseline"]

    def counts(df: DataFrame, **values: Column) -> DataFrame:
        return df.select(*group, *[values.get(name, nothing).alias(name) for name in names])

    change = F.col("change")
    tagged = (counts(changes, n=change.isin("changed", "new").cast("bigint"),
                     removed=(change == "removed").cast("bigint"))
              .unionByName(counts(current, current=F.lit(1).cast("bigint")))
              .unionByName(counts(baseline, baseline=F.lit(1).cast("bigint"))))
    return tagged.groupBy(*group).agg(*[F.coalesce(F.sum(c), nothing).alias(c) for c in names])


def decide(metrics: DataFrame, max_changed: int = V.REFRESH_MAX_CHANGED,
           max_removed: int = V.REFRESH_MAX_REMOVED) -> DataFrame:
    """Add `decision` and `exit_code` to guard metrics."""
    degenerate = (F.col("removed") > max_removed) | (
        (F.col("baseline") > 0) & (F.col("current") < F.col("baseline") * V.REFRESH_MIN_SHARE))
    decision = (F.when(degenerate, F.lit("degenerate"))
                 .when(F.col("n") == 0, F.lit("none"))
                 .when(F.col("n") > max_changed, F.lit("cap"))
                 .otherwise(F.lit("proceed")))
    return metrics.withColumn("decision", decision).withColumn(
        "exit_code", F.when(F.col("decision").isin("degenerate", "cap"), 2).otherwise(0)
        .cast("int"))
