"""Scalar Column functions: guideline arithmetic, dates, names, paths, formatting."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from rulegrain import reference_values as V

# --- guideline arithmetic --------------------------------------------------------------------


def poverty_limit(size: Column, year: int = V.GUIDELINE_YEAR) -> Column:
    """USD a year for a household; sizes below one count as one."""
    table = V.GUIDELINES[year]
    sizes, extra = table["sizes"], table["each_extra"]
    people = F.greatest(size, F.lit(1)).cast("bigint")
    beyond = (people - len(sizes)) * extra + sizes[-1]
    listed = F.expr("array({})".format(", ".join(f"{v}L" for v in sizes)))
    return F.when(people <= len(sizes), F.get(listed, people.cast("int") - 1)).otherwise(beyond)


def guideline_year(year: Column) -> Column:
    """The latest published guideline year not after `year`; null before the first."""
    out = F.lit(None).cast("int")
    for known in sorted(V.GUIDELINES):
        out = F.when(year >= known, F.lit(known)).otherwise(out)
    return out


def poverty_limit_as_of(size: Column, year: Column) -> Column:
    """USD a year by the guideline in force in `year`."""
    in_force = guideline_year(year)
    out = F.lit(None).cast("bigint")
    for known in sorted(V.GUIDELINES):
        out = F.when(in_force == known, poverty_limit(size, known)).otherwise(out)
    return out


def fpl_percent(income: Column, size: Column, year: int = V.GUIDELINE_YEAR) -> Column:
    """Income as a percentage of the guideline, one decimal; a loss counts as zero."""
    earned = F.greatest(income, F.lit(0))
    return F.round(earned / poverty_limit(size, year) * F.lit(100), 1)


def dollar_table(pct: Column, year: int = V.GUIDELINE_YEAR) -> Column:
    """Household size 1..8 to the income ceiling at `pct`; empty for null and for zero."""
    limits = F.expr("array({})".format(", ".join(f"{v}D" for v in V.GUIDELINES[year]["sizes"])))
    amounts = F.transform(limits, lambda usd: F.rint(usd * pct / 100.0).cast("bigint"))
    filled = F.map_from_arrays(F.expr("sequence(1, 8)"), amounts)
    return F.when(pct != 0, filled).otherwise(_no_dollars())


def _no_dollars() -> Column:
    return F.expr("CAST(map() AS map<int,bigint>)")


def dollars_for(table: Column, size: Column) -> Column:
    """The stored ceiling for a household, null where the table has none."""
    return F.try_element_at(table, size.cast("int"))


def same_dollars(left: Column, right: Column) -> Column:
    """Equal as sets of (size, amount); null counts as empty."""
    def pairs(m: Column) -> Column:
        entries = F.map_entries(F.coalesce(m, _no_dollars()))
        return F.array_sort(entries)
    return pairs(left) == pairs(right)


# --- truthiness ------------------------------------------------------------------------------


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def row_key(permalink: Column, name: Column) -> Column:
    return F.coalesce(blank_to_null(permalink), name)


def is_insured(insurance: Column) -> Column:
    """Non-empty and not one of the uninsured words; surrounding blanks are kept."""
    word = F.lower(F.coalesce(insurance, F.lit("")))
    return (word != "") & ~word.isin(V.UNINSURED_WORDS)


def is_uninsured(insurance: Column) -> Column:
    """Routing variant: surrounding blanks are dropped and empty counts as uninsured."""
    word = F.trim(F.lower(F.coalesce(insurance, F.lit(""))))
    return word.isin(["", *V.UNINSURED_WORDS])


def parse_int_loose(text: Column) -> Column:
    """Whole number after dropping ``$``, ``,`` and outer blanks; null otherwise."""
    bare = F.trim(F.regexp_replace(text, r"[$,]", ""))
    return F.when(bare.rlike(r"^[+-]?[0-9]+$"), bare.try_cast("bigint"))


# --- dates -----------------------------------------------------------------------------------


def effective_date_issue(text: Column, today: Column) -> Column:
    day = F.try_to_timestamp(F.trim(text), F.lit("M/d/yyyy")).cast("date")
    return (F.when(blank_to_null(text).isNull(), F.lit(None).cast("string"))
             .when(day.isNull(), F.concat(F.lit("unparseable effective date: '"), text, F.lit("'")))
             .when(day > today, F.concat(F.lit("effective date is in the future: "), text)))


# accepted spellings, first that parses wins; (shape, format)
_DATE_SHAPES = [
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{1,2}/\d{1,2}/\d{2}$", "M/d/yy"),
    (r"^\d{1,2}/\d{4}$", "M/yyyy"),
    (r"^[A-Za-z]+ +\d{1,2}, +\d{4}$", "MMMM d, yyyy"),
    (r"^[A-Za-z]+ +\d{1,2}, +\d{4}$", "MMM d, yyyy"),
    (r"^[A-Za-z]+ +\d{4}$", "MMMM yyyy"),
    (r"^\d{4}$", "yyyy"),
]


def parse_any_date(text: Column) -> Column:
    """Date by the eight accepted spellings; null when none fits."""
    # month names are matched whatever their case; two-digit years pivot at 69
    tidy = F.regexp_replace(F.initcap(F.lower(text)), r" +", " ")
    tries = []
    for shape, fmt in _DATE_SHAPES:
        value = tidy if fmt.startswith("MMM") else text
        if fmt == "M/d/yy":
            year = F.regexp_extract(text, r"(\d{2})$", 1)
            century = F.when(year >= "69", F.lit("19")).otherwise(F.lit("20"))
            value = F.concat(F.regexp_replace(text, r"\d{2}$", ""), century, year)
            fmt = "M/d/yyyy"
        day = F.try_to_timestamp(value, F.lit(fmt)).cast("date")
        tries.append(F.when(text.rlike(shape), day))
    return F.coalesce(*tries)


def effective_date_display(text: Column, today: Column) -> Column:
    """The stated date, or null when missing or in the future; odd spellings pass unchanged."""
    tidy = blank_to_null(F.trim(text))
    return F.when(F.coalesce(parse_any_date(tidy) > today, F.lit(False)),
                  F.lit(None).cast("string")).otherwise(tidy)


# --- names, numbers, text --------------------------------------------------------------------


def slugify(text: Column) -> Column:
    dashed = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9]+", "-")
    return F.regexp_replace(dashed, r"^-|-$", "")


def py_title(text: Column) -> Column:
    """Title case that restarts after every non-letter (O'Brien, D/P-Aph, 3Rd)."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda run: F.initcap(run)), "")


def number_text(value: Column) -> Column:
    """200.0 prints as 200, 62.5 as 62.5."""
    value = value.cast("double")
    return F.when(value == F.floor(value), value.cast("bigint").cast("string")) \
            .otherwise(value.cast("string"))


def whole_text(value: Column) -> Column:
    """Rounded half to even, no decimals."""
    return F.rint(value.cast("double")).cast("bigint").cast("string")


def thousands(value: Column) -> Column:
    return F.format_number(value.cast("bigint"), 0)


def money(value: Column) -> Column:
    """``$1,234``; null for anything that is not a number."""
    return F.concat(F.lit("$"), F.format_number(value.try_cast("bigint"), 0))


def _shown(value: Column, spec: str, numeric: bool) -> Column:
    """A field's text under its format: ``.0f``, ``,`` or none."""
    if not numeric:
        text = value.cast("string")
    elif spec == ".0f":
        text = whole_text(value)
    elif spec == ",":
        text = thousands(value)
    else:
        text = number_text(value)
    return F.coalesce(text, F.lit("None"))


_FIELD = re.compile(r"\{(\w+)(?::([^}]*))?\}")


def fill(template: Column | str, args: Mapping[str, Column],
         numeric: tuple[str, ...] = ()) -> Column:
    """Replace ``{name}`` — and for numeric names ``{name:.0f}`` and ``{name:,}`` too.

    A template known while planning is cut at its fields once; one that comes from a column is
    filled by replacement."""
    if isinstance(template, str):
        parts, at = [], 0
        for field in _FIELD.finditer(template):
            name, spec = field.group(1), field.group(2) or ""
            if name in args:
                parts += [F.lit(template[at:field.start()]),
                          _shown(args[name], spec, name in numeric)]
                at = field.end()
        return F.concat(*parts, F.lit(template[at:]))
    out = template
    for name, value in args.items():
        for spec in ((".0f", ",", "") if name in numeric else ("",)):
            mark = "{" + name + (":" + spec if spec else "") + "}"
            out = F.replace(out, F.lit(mark), _shown(value, spec, name in numeric))
    return out


def _marks(args: Mapping[str, Column], numeric: tuple[str, ...]) -> list[tuple[str, str, str]]:
    """(mark, name, spec) of every field that a template may hold."""
    return [("{" + n + (":" + spec if spec else "") + "}", n, spec)
            for n in args for spec in ((".0f", ",", "") if n in numeric else ("",))]


def cut_template(template: Column, args: Mapping[str, Column], numeric: tuple[str, ...] = ()) -> Column:
    """A template of a column cut at its fields: each piece of text with the number of the mark behind
    it, null behind the last."""
    marks = [m for m, _, _ in _marks(args, numeric)]
    if not marks:
        return F.array(F.struct(template.alias("text"), F.lit(None).cast("int").alias("mark")))
    field = F.lit("|".join(re.sub(r"([{}.])", r"\\\1", m) for m in marks))
    numbers = F.transform(F.regexp_extract_all(template, field, F.lit(0)),
                          lambda m: F.array_position(F.array(*map(F.lit, marks)), m).cast("int"))
    return F.zip_with(F.split(template, field, -1), numbers, lambda t, m: F.struct(t.alias("text"), m.alias("mark")))


def shown_arguments(args: Mapping[str, Column], numeric: tuple[str, ...] = ()) -> Column:
    """The text of every mark of `cut_template`, in the order of its numbers."""
    return F.array(*[_shown(args[n], spec, n in numeric) for _, n, spec in _marks(args, numeric)]).cast("array<string>")


def fill_cut(parts: Column, shown: Column) -> Column:
    """A cut template with its arguments in place; one pass, whatever they hold."""
    return F.array_join(F.transform(parts, lambda p: F.concat(
        p["text"], F.when(p["mark"].isNull(), F.lit("")).otherwise(F.try_element_at(shown, p["mark"])))), "")


def strip_emphasis(text: Column) -> Column:
    return F.replace(text, F.lit("**"), F.lit(""))


_ESCAPES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")]


def html_escape(text: Column) -> Column:
    for char, entity in _ESCAPES:
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def url_quote(text: Column) -> Column:
    """Percent-encoding that keeps ``/`` and ``~``; blanks become ``%20``."""
    out = F.url_encode(text)
    for made, wanted in [("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")]:
        out = F.replace(out, F.lit(made), F.lit(wanted))
    return out


def json_quote(text: Column) -> Column:
    """A JSON string literal."""
    for char, escaped in [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"),
                          ("\t", "\\t")]:
        text = F.replace(text, F.lit(char), F.lit(escaped))
    return F.concat(F.lit('"'), text, F.lit('"'))


def guid(url: Column) -> Column:
    """Up to 36 characters after the last ``id=``."""
    return F.substring(F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)^.*id=", ""), 1, 36)


def url_ok(url: Column) -> Column:
    return F.coalesce(url.rlike(r"^https?://"), F.lit(False))


def phone_digits(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9+]", "")


def phone_find(text: Column) -> Column:
    return blank_to_null(F.regexp_extract(text, V.PHONE, 0))


def content_sha(text: Column) -> Column:
    return F.sha2(text, 256)


def canonical_json(value: Column) -> Column:
    """JSON text in declared field order; null fields are left out."""
    return F.to_json(value)


# --- paths -----------------------------------------------------------------------------------


def _directory_slug(state: Column) -> Column:
    slug = F.lit(V.DIRECTORY_SLUGS[V.HOME_CODE])
    for code, name in V.DIRECTORY_SLUGS.items():
        slug = F.when(state == code, F.lit(name)).otherwise(slug)
    return slug


def page_path(lang: Column, slug: Column, kind: Column, state: Column) -> Column:
    """Path of a hospital, county or directory page; English and the home state unprefixed."""
    segment = (F.when(kind == "county", F.concat(F.lit("hospitals/"), slug))
                .when(blank_to_null(slug).isNotNull(), F.concat(F.lit("hospital/"), slug))
                .otherwise(_directory_slug(state)))
    region = F.when(state != V.HOME_CODE, F.concat(F.lower(state), F.lit("/"))).otherwise(F.lit(""))
    prefix = F.when(lang == "en", F.lit("/")).otherwise(F.concat(F.lit("/"), lang, F.lit("/")))
    return F.concat(prefix, region, segment)


def site_path(lang: Column, page: Column) -> Column:
    """Path of a plain page; the home page is the root of its language."""
    segment = F.when(page.isin("", "home"), F.lit("")).otherwise(page)
    return F.when(lang == "en", F.concat(F.lit("/"), segment)) \
            .otherwise(F.concat(F.lit("/"), lang, F.lit("/"), segment))


def alternate_links(base: str, current: Column, slug: Column, kind: Column,
                    state: Column) -> Column:
    """(rel, lang, url) for every language, then x-default, then the canonical one."""
    def link(rel: str, label: Column, lang: Column) -> Column:
        return F.struct(F.lit(rel).alias("rel"), label.alias("hreflang"),
                        F.concat(F.lit(base), page_path(lang, slug, kind, state)).alias("url"))
    links = [link("alternate", F.lit(code), F.lit(code)) for code in V.LANGUAGES]
    links.append(link("alternate", F.lit("x-default"), F.lit("en")))
    links.append(link("canonical", current, current))
    return F.array(*links)


def share_card(base: str, kind: Column, slug: Column, state: Column) -> Column:
    own = (state == V.HOME_CODE) & kind.isin("hospital", "county") & blank_to_null(slug).isNotNull()
    return F.when(F.coalesce(own, F.lit(False)),
                  F.concat(F.lit(base + "/og/"), kind, F.lit("/"), slug, F.lit(".png"))) \
            .otherwise(F.lit(base + "/og-image.png"))


def qr_path(kind: Column, slug: Column, state: Column) -> Column:
    region = F.when(state == V.HOME_CODE, F.lit("")).otherwise(F.concat(F.lower(state), F.lit("/")))
    return F.concat(F.lit("/qr/"), region, kind, F.lit("/"), slug, F.lit(".svg"))
