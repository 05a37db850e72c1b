"""HTML pages and policy texts to fields."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulegrain import reference_values as V
from rulegrain.functions import scalars as S
from rulegrain.functions.binding import let

LINK = "struct<url:string,effective_date:string>"


@F.pandas_udf(T.StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def unescape_entities(text: Column) -> Column:
    """Character references to characters; the only step Spark has no built-in for."""
    return _unescape(text)


def drop_tags(markup: Column) -> Column:
    """Scripts and styles go with their content, other tags become blanks."""
    bare = F.regexp_replace(markup, r"(?is)<(script|style).*?</\1>", " ")
    return F.regexp_replace(bare, r"(?s)<[^>]+>", " ")


def clean_text(markup: Column) -> Column:
    plain = unescape_entities(drop_tags(markup))
    return F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))


def first_group(text: Column, pattern: str) -> Column:
    """Trimmed first group of the first match, null without one."""
    found = F.get(F.regexp_extract_all(text, F.lit("(?i)" + pattern), F.lit(1)), F.lit(0))
    return F.trim(found)


def all_groups(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


# --- policy pages ----------------------------------------------------------------------------


def policy_links(markup: Column, attachment: str = V.ATTACHMENT_PATH) -> Column:
    """(url, effective_date) per list item that links a document, repeats of a url dropped."""
    escaped = attachment.replace(".", r"\.")
    target = rf'(?i)href="(https?://[^"]*{escaped}\?id=[^"]+)"'
    dated = r'(?i)class="date"[^>]*>\s*(\d{1,2}/\d{1,2}/\d{4})'
    items = F.regexp_extract_all(markup, F.lit(r"(?is)<li\b[^>]*>(.*?)</li>"), F.lit(1))
    links = F.filter(F.transform(items, lambda li: F.struct(
        S.blank_to_null(F.regexp_extract(li, target, 1)).alias("url"),
        S.blank_to_null(F.regexp_extract(li, dated, 1)).alias("effective_date"))),
        lambda link: link["url"].isNotNull())
    return let(links, lambda found: let(
        F.transform(found, lambda link: link["url"]), lambda urls: F.filter(
            found, lambda link, i: F.array_position(urls, link["url"]) == i + 1)))


def section_spans(page: Column) -> Column:
    """array<struct<at,key>> of the headings found, in page order (1-based)."""
    found = []
    for key, heading in V.SECTIONS:
        exact = F.locate(f">{heading}<", page)
        at = F.when(exact > 0, exact).otherwise(F.locate(heading, page))
        found.append(F.when(at > 0, F.struct(at.alias("at"), F.lit(key).alias("key"))))
    return F.array_sort(F.array_compact(F.array(*found)))


def section_parts(page: Column, spans: Column) -> Column:
    """array<struct<key,policies,application,archive>>: markup of each section, cut at its
    application heading."""
    def part(span: Column, i: Column) -> Column:
        following = F.get(spans, i + 1)["at"]
        end = F.coalesce(following, F.length(page) + 1)
        return let(F.substring(page, span["at"], end - span["at"]), lambda body: let(
            F.regexp_instr(body, F.lit(r"(?i)<h3[^>]*>\s*Application")),
            lambda cut: split(span, body, cut)))

    def split(span: Column, body: Column, cut: Column) -> Column:
        return F.struct(
            span["key"].alias("key"),
            F.when(cut > 0, F.substring(body, F.lit(1), cut - 1)).otherwise(body)
             .alias("policies"),
            F.when(cut > 0, F.substring(body, cut, F.length(body))).otherwise(F.lit(""))
             .alias("application"),
            S.blank_to_null(F.regexp_extract(
                body, r"(?i)SearchDetail\.aspx\?oshpdid=(\d+)", 1)).alias("archive"))
    return F.transform(spans, part)


def section_record(part: Column, attachment: str = V.ATTACHMENT_PATH) -> Column:
    """The document pointers of one section."""
    def record(docs: Column, apps: Column) -> Column:
        first, form = F.get(docs, F.lit(0)), F.get(apps, F.lit(0))
        return F.struct(
            first["url"].alias("current_policy_url"),
            first["effective_date"].alias("current_effective_date"),
            F.slice(docs, F.lit(2), F.greatest(F.size(docs) - 1, F.lit(0)))
             .alias("archived_policies"),
            form["url"].alias("application_url"),
            form["effective_date"].alias("application_effective_date"),
            part["archive"].alias("archive_oshpdid"))
    return let(policy_links(part["policies"], attachment), lambda docs: let(
        policy_links(part["application"], attachment), lambda apps: record(docs, apps)))


# --- rules stated in plain text --------------------------------------------------------------

_LINE_ENDS = r"\r\n|[\n\x0b\f\r\x1c\x1d\x1e\x85  ]"


def _band(text: Column, low: int, high: int) -> Column:
    """The number when it lies in the band."""
    number = text.try_cast("int")
    return F.when(number.between(low, high), number)


def free_on_cue_line(text: Column) -> Column:
    """First line that holds a free-care cue and an FPL percentage from 50 to 300."""
    lines = F.filter(F.split(text, _LINE_ENDS), lambda ln: F.lower(ln).rlike(V.FREE_CUE))
    values = F.transform(lines, lambda ln: _band(
        F.regexp_extract(ln, "(?i)" + V.FPL_PERCENT, 1), 50, 300))
    return F.get(F.filter(values, lambda v: v.isNotNull()), F.lit(0))


def free_by_patterns(text: Column) -> Column:
    """First of three wordings whose first match lies from 50 to 400."""
    # `.` stops at line feeds only
    return F.coalesce(*[_band(F.regexp_extract(text, "(?id)" + p, 1), 50, 400)
                        for p in V.FREE_PATTERNS])


def fpl_percents_seen(text: Column) -> Column:
    """Sorted distinct FPL percentages from 50 to 400."""
    found = F.transform(F.regexp_extract_all(text, F.lit("(?i)" + V.FPL_PERCENT), F.lit(1)),
                        lambda t: _band(t, 50, 400))
    return F.array_sort(F.array_distinct(F.array_compact(found)))


def rule_confidence(free: Column, discount: Column) -> Column:
    return (F.when(free <= discount, F.lit("high"))
             .when(free.isNotNull() | discount.isNotNull(), F.lit("medium"))
             .otherwise(F.lit("low")))
