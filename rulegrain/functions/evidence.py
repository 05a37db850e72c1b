"""Text evidence as Columns: stopword density, percentages and markers with offsets, proximity.

Offsets come from the pieces between matches: a match starts where the pieces and matches
before it end.  Everything stays inside the row, so no text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rulegrain import reference_values as V
from rulegrain.functions.binding import let

# words, digits and blanks are Unicode here, as the word lists need
STOPWORDS = r"(?iU)\b(?:" + "|".join(V.STOPWORD_STEMS) + r")\w*\b"
MARKERS = r"(?iU)" + V.POVERTY_WORDING
PERCENTS = r"(?iU)" + V.PERCENT_VALUE


def stopword_density(text: Column) -> Column:
    """Stopwords per 1000 characters."""
    hits = F.regexp_count(text, F.lit(STOPWORDS)).cast("double")
    return hits * 1000.0 / F.greatest(F.length(text), F.lit(1))


def intelligible(text: Column) -> Column:
    """False for empty texts and for characters that form no words."""
    return F.coalesce((F.length(text) > 0)
                      & (stopword_density(text) >= V.MIN_STOPWORDS_PER_1000), F.lit(False))


def short_text(text: Column) -> Column:
    return F.length(F.trim(text)) < V.MIN_USABLE_CHARS


#: Matches that are placed together; lists grow by copying, so no list grows longer than this at once.
STRETCH = 256


def spans(text: Column, pattern: str) -> Column:
    """array<struct<start,end,hit>> of all matches, 0-based, end exclusive.

    Matches are placed stretch by stretch, from where each stretch begins, so a text with many of
    them costs in proportion to their number."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern)
    pairs = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"))
    # the last piece has no match after it
    found = F.filter(pairs, lambda p: p["hit"].isNotNull())
    none = F.expr("CAST(array() AS array<struct<start:int,end:int,hit:string>>)")
    no_starts = F.expr("named_struct('at', 0, 'out', CAST(array() AS array<int>))")

    def advance(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["gap"])
        end = start + F.length(p["hit"])
        item = F.struct(start.alias("start"), end.alias("end"), p["hit"].alias("hit"))
        return F.struct(end.alias("at"), F.array_append(acc["out"], item).alias("out"))

    def placed(matches: Column) -> Column:
        stretches = F.sequence(F.lit(0), F.floor(F.greatest(F.size(matches) - 1, F.lit(0)) / STRETCH).cast("int"))

        def of(i: Column) -> Column:
            return F.slice(matches, i * STRETCH + 1, F.lit(STRETCH))

        sizes = F.transform(stretches, lambda i: F.aggregate(
            of(i), F.lit(0), lambda n, p: n + F.length(p["gap"]) + F.length(p["hit"])))
        starts = F.aggregate(sizes, no_starts, lambda acc, n: F.struct(
            (acc["at"] + n).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"])
        return F.flatten(F.zip_with(stretches, starts, lambda i, at: F.aggregate(
            of(i), F.struct(at.alias("at"), none.alias("out")), advance, lambda acc: acc["out"])))

    return let(found, placed)


# every poverty wording holds one of these, so most texts need no regular expression
_MARKER_HINTS = ["fpl", "fpg", "poverty"]


def marker_spans(text: Column, pattern: str = MARKERS) -> Column:
    if pattern != MARKERS:
        return spans(text, pattern)
    lower = F.lower(text)
    hinted = lower.contains(_MARKER_HINTS[0])
    for hint in _MARKER_HINTS[1:]:
        hinted = hinted | lower.contains(hint)
    none = F.expr("CAST(array() AS array<struct<start:int,end:int,hit:string>>)")
    return F.when(hinted, spans(text, pattern)).otherwise(none)


def percent_mentions(text: Column, pattern: str = PERCENTS) -> Column:
    """array<struct<value,start>>: every percentage with its offset."""
    return F.transform(spans(text, pattern), lambda s: F.struct(
        F.regexp_extract(s["hit"], r"^[0-9]+(?:\.[0-9]+)?", 0).try_cast("double").alias("value"),
        s["start"].alias("start")))


def _near(pos: Column, marker: Column, window: Column) -> Column:
    return ((F.least(F.abs(pos - marker["end"]), F.abs(marker["start"] - pos)) <= window)
            | pos.between(marker["start"], marker["end"]))


def is_grounded(value: Column, mentions: Column, markers: Column, window: Column) -> Column:
    """Is the value stated within `window` characters of a marker?"""
    return F.exists(mentions, lambda m: (m["value"] == value) & F.exists(
        markers, lambda k: _near(m["start"], k, window)))


def grounding_of(value: Column, text: Column, mentions: Column, markers: Column,
                 window: Column) -> Column:
    """struct<grounded,evidence>; evidence is the text around the first supporting pair."""
    def first_pair(supporting: Column) -> Column:
        pos = F.get(supporting, F.lit(0))["start"]
        return F.when(F.size(supporting) > 0, F.struct(pos.alias("pos"), F.get(F.filter(
            markers, lambda k: _near(pos, k, window)), F.lit(0)).alias("mk")))

    def shown(pair: Column) -> Column:
        pos, mk = pair["pos"], pair["mk"]
        low = F.greatest(F.lit(0), F.least(pos, mk["start"]) - V.EVIDENCE_MARGIN)
        high = F.least(F.length(text), F.greatest(pos, mk["end"]) + V.EVIDENCE_MARGIN)
        cut = F.substring(text, low + 1, high - low)
        tidy = F.trim(F.regexp_replace(cut, r"(?U)\s+", " "))
        return F.struct(pair.isNotNull().alias("grounded"),
                        F.when(pair.isNotNull(), tidy).alias("evidence"))

    supporting = F.filter(mentions, lambda m: (m["value"] == value) & F.exists(
        markers, lambda k: _near(m["start"], k, window)))
    return let(let(supporting, first_pair), shown)
