"""Proximity of mentions and markers as rows: a banded range join.

The in-row form (`functions.evidence`) looks at every marker for every mention of a text.  Here both
sides are rows, dealt into bins as wide as the window: a marker goes to each bin that its window reaches, a
mention to the one it stands in, and they meet by equality of (document, bin).  Places within a text differ, so a
bin holds as many of either as characters allow, whatever the length of the text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulegrain import reference_values as V
from rulegrain.functions import evidence as T
from rulegrain.operators.flatten import unnest


def mention_rows(texts: DataFrame, doc: str, text: str = "text", pattern: str = T.PERCENTS) -> DataFrame:
    """(doc, value, start) of every percentage."""
    found = texts.select(doc, T.percent_mentions(F.col(text), pattern).alias("_m"))
    return unnest(found, "_m", "m", [doc]).select(doc, "m.value", "m.start")


def marker_rows(texts: DataFrame, doc: str, text: str = "text", pattern: str = T.MARKERS) -> DataFrame:
    """(doc, start, end) of every marker."""
    found = texts.select(doc, T.marker_spans(F.col(text), pattern).alias("_m"))
    return unnest(found, "_m", "m", [doc]).select(doc, "m.start", "m.end")


def near_markers(mentions: DataFrame, markers: DataFrame, doc: str, window: int = V.EVIDENCE_WINDOW) -> DataFrame:
    """Each mention that a marker is near to, with the first such marker: (doc, value, start, marker_start, marker_end)."""
    width = max(1, window)
    bin_of = lambda c: F.floor(c / F.lit(width)).cast("bigint")
    wide = markers.withColumn("_bins", F.sequence(bin_of(F.greatest(F.col("start") - window, F.lit(0))), bin_of(F.col("end") + window)))
    reached = unnest(wide, "_bins", "_bin", [doc, "start", "end"]).select(
        doc, "_bin", F.col("start").alias("marker_start"), F.col("end").alias("marker_end"))
    placed = mentions.withColumn("_bin", bin_of(F.col("start")))
    close = (F.least(F.abs(F.col("start") - F.col("marker_end")), F.abs(F.col("marker_start") - F.col("start"))) <= window) \
        | F.col("start").between(F.col("marker_start"), F.col("marker_end"))
    return (placed.join(reached, [doc, "_bin"]).filter(close).groupBy(doc, "value", "start")
            .agg(F.min(F.struct("marker_start", "marker_end")).alias("_k")).select(doc, "value", "start", "_k.*"))


def ground_exploded(claims: DataFrame, mentions: DataFrame, markers: DataFrame, doc: str,
                    window: int = V.EVIDENCE_WINDOW) -> DataFrame:
    """Each claim (doc, label, value) with `grounded` and the first supporting pair's places."""
    first = near_markers(mentions, markers, doc, window).groupBy(doc, "value").agg(
        F.min(F.struct("start", "marker_start", "marker_end")).alias("_p"))
    return claims.join(first, [doc, "value"], "left").select(
        *claims.columns, F.col("_p").isNotNull().alias("grounded"), "_p.start", "_p.marker_start", "_p.marker_end")
