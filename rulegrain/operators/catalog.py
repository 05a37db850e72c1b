"""Message catalogs: fallback, overlays, gaps, drift, and filled texts.

A catalog is a table (lang, section, key, template); it is data the user brings, so it is
joined, never compiled in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulegrain import reference_values as V
from rulegrain.functions import scalars as S


def resolve(wanted: DataFrame, catalog: DataFrame, lang: str = "lang",
            key: str = "key") -> DataFrame:
    """Add `template`: the language's text, else the English one; blanks count as missing."""
    texts = catalog.filter(S.blank_to_null(F.col("template")).isNotNull())
    own = texts.select(F.col("lang").alias(lang), F.col("key").alias(key),
                       F.col("template").alias("_own"))
    english = texts.filter(F.col("lang") == "en").select(
        F.col("key").alias(key), F.col("template").alias("_en"))
    return (wanted.join(own, [lang, key], "left").join(english, key, "left")
            .withColumn("template", F.coalesce("_own", "_en")).drop("_own", "_en"))


def overlay(catalog: DataFrame, order: list[str]) -> DataFrame:
    """Merge sections per language; of a repeated key the later section wins."""
    rank = F.lit(-1)
    for i, name in enumerate(order):
        rank = F.when(F.col("section") == name, F.lit(i)).otherwise(rank)
    ranked = catalog.withColumn("_rank", rank).filter("_rank >= 0")
    return ranked.groupBy("lang", "key").agg(
        F.max_by("template", "_rank").alias("template"),
        F.max_by("section", "_rank").alias("section"))


def key_gaps(catalog: DataFrame, allowed: DataFrame) -> DataFrame:
    """(lang, section, key): English keys a language lacks and may not lack."""
    english = catalog.filter(F.col("lang") == "en").select("section", "key").distinct()
    # one array of language codes, as long as there are languages
    langs = catalog.filter(F.col("lang") != "en").agg(
        F.sort_array(F.collect_set("lang"))).scalar()
    wanted = english.withColumn("lang", F.explode(langs))
    have = catalog.select("lang", "section", "key").distinct()
    return (wanted.join(have, ["lang", "section", "key"], "left_anti")
            .join(allowed.select("section", "key"), ["section", "key"], "left_anti")
            .select("lang", "section", "key"))


def complete_languages(catalog: DataFrame, required: DataFrame) -> DataFrame:
    """(lang, present, wanted, state): full, none or partial supply of the required keys."""
    need = required.select("section", "key").distinct()
    hits = catalog.join(need, ["section", "key"], "left_semi") \
        .select("lang", "section", "key").distinct() \
        .groupBy("lang").agg(F.count("*").alias("present"))
    wanted = need.agg(F.count("*")).scalar()
    langs = catalog.select("lang").distinct()
    out = langs.join(hits, "lang", "left").withColumn(
        "present", F.coalesce("present", F.lit(0))).withColumn("wanted", wanted)
    return out.withColumn("state", F.when(F.col("present") == F.col("wanted"), F.lit("full"))
                          .when(F.col("present") == 0, F.lit("none")).otherwise(F.lit("partial")))


def placeholders(template: Column) -> Column:
    """Sorted distinct field names of a template."""
    return F.array_sort(F.array_distinct(
        F.regexp_extract_all(template, F.lit(r"\{([A-Za-z_]+)(?::[^}]*)?\}"), F.lit(1))))


def leaked(text: Column) -> Column:
    """A filled text that still shows a field or a missing number."""
    return text.rlike(r"\{[A-Za-z_]+(?::[^}]*)?\}") | text.contains("None%")


def _count_of(text: Column, part: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)


def drift(pairs: DataFrame, tokens: list[str], counted: list[str] | None = None,
          english: str = "en", translated: str = "template") -> DataFrame:
    """Add `problems`: how a translation departs from its English text.

    Tokens must be present in both or neither; counted tokens and tags equally often; links
    equal; the length ratio within its language's bounds."""
    src, dst = F.col(english), F.col(translated)
    links = [F.regexp_extract_all(t, F.lit(r'href="([^"]+)"'), F.lit(1)) for t in (src, dst)]
    low, high = (F.lit(v) for v in V.LENGTH_RATIO_DEFAULT)
    for lang, (lo, hi) in V.LENGTH_RATIOS.items():
        low = F.when(F.col("lang") == lang, F.lit(lo)).otherwise(low)
        high = F.when(F.col("lang") == lang, F.lit(hi)).otherwise(high)
    ratio = F.length(dst) / F.greatest(F.length(src), F.lit(1))
    checks = [F.when(src.contains(t) != dst.contains(t), F.lit(f"token {t}")) for t in tokens]
    checks += [F.when(_count_of(src, t) != _count_of(dst, t), F.lit(f"count {t}"))
               for t in [*(counted or []), *V.PINNED_TAGS]]
    checks += [F.when(links[0] != links[1], F.lit("links")),
               F.when(placeholders(src) != placeholders(dst), F.lit("fields")),
               F.when(~ratio.between(low, high), F.lit("length"))]
    return pairs.withColumn("problems", F.array_compact(F.array(*checks)))


# --- letters ---------------------------------------------------------------------------------

# this engine's own wording; a catalog row with key `letter` replaces it
LETTER = """{name}
{address}
{phone}

Date: {today}

{hospital}
Financial Assistance Office
Re: request for financial assistance
Account: {account}
Service: {service_date}

I ask for {ask} under your Financial Assistance Policy, {law} and IRS Section 501(r).
We are {household} in our household with a yearly income of about ${income:,}, which is {pct:.0f}% of
the Federal Poverty Level.

Please send the application and the list of documents you need, hold any collection while you
review it, apply the result to the bill as already issued, and send an itemized copy of it.

{name}
"""

_BLANKS = {"address": "[Your address]", "phone": "[Your phone]",
           "account": "[account number if known]", "service_date": "[date of service]"}


def _cut_catalog(catalog: DataFrame, args: dict[str, Column], numeric: tuple[str, ...]) -> Column:
    """lang -> key -> its templates, each cut at its fields: one value, of the catalog's size."""
    texts = catalog.filter(S.blank_to_null(F.col("template")).isNotNull() & F.col("lang").isNotNull()
                           & F.col("key").isNotNull())
    cut = texts.select("lang", "key", "template").distinct().withColumn(
        "_cut", S.cut_template(F.col("template"), args, numeric))
    # a key has one template, or one of each section that spells it
    keys = cut.groupBy("lang", "key").agg(F.collect_list("_cut").alias("_cuts"))
    langs = keys.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("key", "_cuts"))).alias("_keys"))
    return langs.agg(F.map_from_entries(F.collect_list(F.struct("lang", "_keys")))).scalar()


def render(df: DataFrame, ids: list[str], keys: str, catalog: DataFrame, args: dict[str, Column],
           numeric: tuple[str, ...] = (), out: str = "text") -> DataFrame:
    """(ids…, out): each row's message keys resolved in its `lang`, filled and joined in order.

    `ids` identify a row; a row carries a handful of keys.  Templates are cut at their fields once, and a
    row is filled where it stands: nothing is unnested or shuffled."""
    kept = df.filter(F.array_max(keys).isNotNull())  # some key
    held = kept.select(*ids, F.col(keys).alias("_wanted"), F.col("lang").alias("_lang"),
                       S.shown_arguments(args, numeric).alias("_shown"))

    def message(texts: Column, key: Column) -> Column:
        own, english = (F.try_element_at(F.try_element_at(texts, lang), key) for lang in (F.col("_lang"), F.lit("en")))
        # naming `_shown` twice keeps the optimizer from making it anew for every field
        filled = [F.transform(cuts, lambda parts: S.fill_cut(parts, F.col("_shown"))) for cuts in (own, english)]
        return F.sort_array(F.coalesce(*filled, F.array().cast("array<string>")))

    # the catalog is named once and bound by a lambda: as a column of the rows, each would copy it
    text = F.transform(F.array("_catalog"), lambda texts: F.array_join(
        F.flatten(F.transform("_wanted", lambda key: message(texts, key))), " "))
    return held.withColumn("_catalog", _cut_catalog(catalog, args, numeric)).select(*ids, text[0].alias(out))


def letters(scored: DataFrame, today: str, template: Column | None = None,
            ask: Column | None = None, out: str = "letter") -> DataFrame:
    """One letter per scored intake; what the intake leaves open shows as a bracket.

    A translated twin takes its language's `template` and `ask` texts as columns.

    Needs: hospital, state, law, tier, fpl_pct, household_size, annual_income, full_name and,
    where given, address, phone, account, service_date."""
    def given(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(_BLANKS[name])) if name in scored.columns \
            else F.lit(_BLANKS[name])

    code = F.upper(F.coalesce(S.blank_to_null(F.col("state")), F.lit(V.HOME_CODE)))
    law = F.when(code == V.HOME_CODE, F.lit("California's Hospital Fair Pricing Act")) \
           .otherwise(F.col("law"))
    name = F.coalesce(S.blank_to_null(F.trim(F.col("full_name"))), F.lit("[Your full name]"))
    if ask is None:
        ask = F.when(F.col("tier") == "free", F.lit("free (fully charity) care")) \
               .otherwise(F.lit("a charity-care discount"))
    filled = S.fill(template if template is not None else LETTER, {
        "name": name, "address": given("address"), "phone": given("phone"),
        "today": F.lit(today), "hospital": S.py_title(F.col("hospital")),
        "account": given("account"), "service_date": given("service_date"), "ask": ask,
        "law": law, "household": F.col("household_size"), "income": F.col("annual_income"),
        "pct": F.col("fpl_pct")}, numeric=("household", "income", "pct"))
    return scored.withColumn(out, filled)
