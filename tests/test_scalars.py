import datetime
import html
import urllib.parse

import pytest
from pyspark.sql import functions as F

from rulegrain import reference_values as V
from rulegrain.functions import markup as M
from rulegrain.functions import scalars as S


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def over(spark, values, fn, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r.o for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


TEXTS = ["ST. MARY'S", "o'brien d/p-aph", "3rd ward", "a&b <c> \"d\" 'e'", "x y/z~w*q+é", "", "  ",
         "SAN JOSÉ", "{n} 50%"]


def test_titles_escapes_and_quotes_match_python(spark):
    assert over(spark, TEXTS, S.py_title) == [t.title() for t in TEXTS]
    assert over(spark, TEXTS, S.html_escape) == [html.escape(t) for t in TEXTS]
    assert over(spark, TEXTS, S.url_quote) == [urllib.parse.quote(t) for t in TEXTS]


def test_guideline(spark):
    assert over(spark, [-3, 0, 1, 4, 8, 9, 12], S.poverty_limit, "int") == [
        15960, 15960, 15960, 33000, 55720, 61400, 78440]
    df = spark.createDataFrame([(30000, 1), (-50, 2), (0, 0), (33000, 4)], "i long, n int")
    got = [r.p for r in df.select(S.fpl_percent(F.col("i"), F.col("n")).alias("p")).collect()]
    assert got == [188.0, 0.0, 0.0, 100.0]


def test_dollar_table(spark):
    got = over(spark, [200.0, 0.0, None, 137.5], S.dollar_table, "double")
    assert got[0] == {n + 1: round(v * 200 / 100) for n, v in enumerate(V.GUIDELINES[2026]["sizes"])}
    assert got[1] == {} and got[2] == {}
    assert got[3] == {n + 1: round(v * 137.5 / 100) for n, v in enumerate(V.GUIDELINES[2026]["sizes"])}


def test_versioned_guideline(spark):
    got = over(spark, [2023, 2024, 2025, 2030], lambda y: S.poverty_limit_as_of(F.lit(1), y), "int")
    assert got == [None, 15060, 15650, 15960]


@pytest.mark.parametrize("text,issue", [
    (None, None), ("", None), ("01/02/2026", None), ("1/2/2026", None),
    ("13/45/2026", "unparseable effective date: '13/45/2026'"),
    ("soon", "unparseable effective date: 'soon'"),
    ("01/01/2030", "effective date is in the future: 01/01/2030")])
def test_effective_date_issue(spark, text, issue):
    today = F.lit("2026-08-01").cast("date")
    assert one(spark, S.effective_date_issue(F.lit(text).cast("string"), today)) == issue


def _python_display(text, today):
    text = (text or "").strip()
    if not text:
        return None
    for fmt in ("%m/%d/%Y", "%Y-%m-%d", "%m/%d/%y", "%m/%Y", "%B %d, %Y", "%b %d, %Y", "%B %Y", "%Y"):
        try:
            day = datetime.datetime.strptime(text, fmt).date()
        except ValueError:
            continue
        return None if day > today else text
    return text


def test_effective_date_display_matches_python(spark):
    texts = ["01/02/2026", "2026-1-2", "2030-01-01", "01/02/31", "01/02/70", "12/2026", "1/2026",
             "January 5, 2026", "Jan 5, 2026", "JAN 5, 2031", "march 2027", "March 2020", "2026",
             "2027", "26", "upon request", "13/13/2020", " 05/06/2020 ", None, ""]
    today = datetime.date(2026, 8, 1)
    got = over(spark, texts, lambda t: S.effective_date_display(t, F.lit(today)))
    assert got == [_python_display(t, today) for t in texts]


def test_small_texts(spark):
    assert over(spark, ["$30,000", " 12 ", "12k", "-5", "1.5", None], S.parse_int_loose) == [
        30000, 12, None, -5, None, None]
    assert over(spark, ["1234567", "x", None], S.money) == ["$1,234,567", None, None]
    assert over(spark, ["St. Mary's -- Hospital!", None], S.slugify) == ["st-mary-s-hospital", ""]
    assert over(spark, ["u?id=a&id=" + "b" * 40, "plain", None], S.guid) == ["b" * 36, "plain", ""]
    assert over(spark, ["http://a", "https://b", "ftp://c", None], S.url_ok) == [
        True, True, False, False]
    assert over(spark, ["none", " none ", "", None, "Medicare"], S.is_insured) == [
        False, True, False, False, True]
    assert over(spark, ["none", " none ", "", None, "Medicare"], S.is_uninsured) == [
        True, True, True, True, False]


def test_fill_both_ways(spark):
    template = "{pct:.0f}% of {income:,} for {name} {other} {pct}"
    args = {"pct": F.lit(138.5), "income": F.lit(30000), "name": F.lit("A")}
    want = "138% of 30,000 for A {other} 138.5"
    assert one(spark, S.fill(template, args, ("pct", "income"))) == want
    assert one(spark, S.fill(F.lit(template), args, ("pct", "income"))) == want


def test_paths(spark):
    def path(lang, slug, kind, state):
        return one(spark, S.page_path(F.lit(lang), F.lit(slug).cast("string"), F.lit(kind), F.lit(state)))
    assert path("en", "a", "hospital", "CA") == "/hospital/a"
    assert path("es", "a", "county", "IL") == "/es/il/hospitals/a"
    assert path("en", None, "hospital", "VT") == "/vt/vermont-hospitals"


def test_clean_text(spark):
    page = "<p>A&nbsp;&amp; B</p><script>x='</p>'</script><STYLE>y</STYLE> caf&eacute; &#39;q&#39;"
    assert one(spark, M.clean_text(F.lit(page))) == "A & B café 'q'"
