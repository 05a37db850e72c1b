"""Names, slugs and pages: who is called what, and where it is listed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rulegrain import reference_values as V
from rulegrain.functions import scalars as S
from rulegrain.operators.flatten import unnest
from rulegrain.session import settle

# --- slugs -----------------------------------------------------------------------------------


def assign_slugs(rows: DataFrame, pos: str = "pos", name: str = "hospital", city: str = "city",
                 ident: str = "oshpdid") -> DataFrame:
    """Add `slug` and `owner`: base slug for the first row, then name-city, then base-id.

    A row takes its first form that no earlier row uses; the id form is taken in any case.  Most rows need
    no order at all.  After the first row of a base the base is in use, and after two rows of one
    base and city the city form is, so all further ones have the id form.  Where nobody else claims a
    form, who has it is known from those ranks.  What is left are two rows at most for each base and city whose
    form somebody else claims as well.  All forms of a row begin with its base, so rivals have bases of which one
    continues the other: they share the shortest such base, and each of these groups is settled in one ordered
    pass that remembers the forms in use.  The number of jobs is fixed, whatever displaces what.

    `owner` is false for rows whose slug a later row overwrote."""
    base = S.slugify(F.col(name))
    narrow = settle(rows.select(
        F.col(pos).alias("_pos"), base.alias("_base"),
        S.slugify(F.concat(F.col(name), F.lit("-"), F.coalesce(city, F.lit("")))).alias("_city"),
        F.concat(base, F.lit("-"), F.coalesce(F.col(ident).cast("string"), F.lit(""))).alias("_ident")))
    ranked = F.row_number().over(W.partitionBy("_base", "_city").orderBy("_pos"))
    heads = narrow.withColumn("_rank", ranked).filter("_rank <= 2")
    openers = heads.filter("_rank = 1").groupBy("_base").agg(F.min_by("_city", "_pos").alias("_first_city"))
    one = lambda kind, *cols: narrow.select(*cols).distinct().select(F.col(cols[-1]).alias("_form"), F.lit(kind).alias("_kind"))
    claims = one("base", "_base").unionByName(one("city", "_base", "_city")).unionByName(one("ident", "_ident"))
    rival = settle(claims.groupBy("_form").count().filter("count > 1").select("_form"))
    marked = lambda df, form, out: df.join(rival.select(F.col("_form").alias(form), F.lit(True).alias(out)), form, "left")
    opening = F.col("_city") == F.col("_first_city")         # the class of the base's first row
    told = marked(marked(heads.join(openers, "_base"), "_base", "_base_rival"), "_city", "_city_rival")
    told = settle(told.withColumn("_opens", opening & (F.col("_rank") == 1)).withColumn("_contested", F.coalesce(
        F.col("_city_rival"), F.lit(False)) | (opening & F.coalesce(F.col("_base_rival"), F.lit(False))))
        .select("_pos", "_base", "_city", "_ident", "_opens", "_contested", F.when(F.col("_opens"), F.col("_base"))
                .when((F.col("_rank") == 1) | opening, F.col("_city")).otherwise(F.col("_ident")).alias("slug")))
    later = narrow.join(told.select("_pos"), "_pos", "left_anti").withColumn("slug", F.col("_ident"))
    known = told.filter("NOT _contested").select(*later.columns).unionByName(later)
    # the earliest use of a rival form by a row that is settled already
    taken = known.filter("slug = _ident").join(rival, F.col("slug") == F.col("_form"), "left_semi") \
                 .groupBy("_base", "slug").agg(F.min("_pos").alias("_pos"))
    turns = told.filter("_contested").select(
        "_base", "_pos", F.when(F.col("_opens"), F.col("_base")).alias("_1"), F.col("_city").alias("_2"),
        F.col("_ident").alias("_3")).unionByName(taken.select(
            "_base", "_pos", F.lit(None).cast("string").alias("_1"), F.lit(None).cast("string").alias("_2"),
            F.col("slug").alias("_3")).withColumn("_fixed", F.lit(True)), allowMissingColumns=True)
    kind = narrow.schema["_pos"].dataType.simpleString()
    passed = (turns.join(_shortest_base(turns), "_base").repartition("_root").sortWithinPartitions("_root", "_pos")
              .select("_root", "_pos", "_1", "_2", "_3", F.coalesce("_fixed", F.lit(False)).alias("_fixed")).mapInPandas(_take_turns, f"_pos {kind}, slug string"))
    decided = settle(known.select("_pos", "slug").unionByName(passed))
    last = decided.groupBy("slug").agg(F.max("_pos").alias("_last"))
    owned = decided.join(last, "slug").select(
        F.col("_pos").alias(pos), "slug", (F.col("_pos") == F.col("_last")).alias("owner"))
    return rows.join(owned, pos)


def _shortest_base(turns: DataFrame) -> DataFrame:
    """(_base, _root): the shortest of all bases that this one continues at a hyphen; a base without any
    letter is continued by all."""
    bases = turns.select("_base").distinct()
    words = F.split("_base", "-")
    begins = F.array_append(F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(
        F.slice(words, 1, n), "-")), F.lit(""))
    return (unnest(bases.withColumn("_begins", begins), "_begins", "_root", ["_base"])
            .join(bases.select(F.col("_base").alias("_root")), "_root")
            .groupBy("_base").agg(F.min_by("_root", F.length("_root")).alias("_root")))


def _take_turns(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of a root come together and in order; each takes its first form that is not in use."""
    root, used = None, set()
    for frame in frames:
        slugs = []
        for own, *forms, fixed in zip(frame["_root"], frame["_1"], frame["_2"], frame["_3"], frame["_fixed"]):
            if own != root:
                root, used = own, set()
            slug = next((f for f in forms[:2] if f is not None and f not in used), forms[2])
            used.add(slug)
            slugs.append(None if fixed else slug)
        out = frame[["_pos"]].assign(slug=slugs)
        yield out[out["slug"].notna()]


# --- names -----------------------------------------------------------------------------------


def name_labels(rows: DataFrame, pos: str = "pos", name: str = "hospital",
                city: str = "city") -> DataFrame:
    """Add `label`: the titled name, with its city where several rows share the name."""
    named = rows.filter(S.blank_to_null(F.col(name)).isNotNull()) \
                .withColumn("_upper", F.upper(name))
    counts = named.groupBy("_upper").agg(F.count("*").alias("_n"), F.min(pos).alias("_first"))
    shared = (F.col("_n") > 1) & S.blank_to_null(F.col(city)).isNotNull()
    label = F.when(shared, F.concat(S.py_title(F.col(name)), F.lit(" ("),
                                    S.py_title(F.col(city)), F.lit(")"))) \
             .otherwise(S.py_title(F.col(name)))
    return (named.join(counts, "_upper").withColumn("label", label)
            .withColumn("shared", shared).drop("_n"))


def name_index(rows: DataFrame, pos: str = "pos", name: str = "hospital",
               city: str = "city") -> DataFrame:
    """(key, ord, target): every lookup key, its index order and the row it means.

    A bare name means its first row; a name with city means the last row so labelled."""
    labelled = name_labels(rows, pos, name, city)
    bare = labelled.groupBy(F.col("_upper").alias("key")).agg(
        (F.min(pos) * 2).alias("ord"), F.min(pos).alias("target"))
    with_city = (labelled.filter("shared").groupBy(F.upper("label").alias("key"))
                 .agg((F.min(pos) * 2 + 1).alias("ord"), F.max(pos).alias("target")))
    return bare.unionByName(with_city)


GRAM = 4            # the shortest text that may be part of a name


def _grams(text: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - (GRAM - 1)),
                                        lambda at: F.substring(text, at, F.lit(GRAM))))


def gram_index(index: DataFrame) -> DataFrame:
    """(gram, key, ord, target): an inverted index of four-character grams over a `name_index`.

    A key has as many rows as distinct grams.  Batches build it when they need it, a stream's is written once."""
    long = index.filter(F.length("key") >= GRAM).withColumn("_grams", _grams(F.col("key")))
    return unnest(long, "_grams", "gram", ["key", "ord", "target"])


def first_containing(needles: DataFrame, postings: DataFrame) -> DataFrame:
    """(_needle, _within): the first key, in index order, that contains each of the different texts.

    A text is joined on the rarest of its grams alone and then compared, so rows grow with the
    postings of rare grams; a gram that no key has ends the search of its text."""
    longest = postings.agg(F.max(F.length("key"))).scalar()  # a longer text is in no key
    asked = needles.filter(F.length("_needle").between(F.lit(GRAM), longest))
    parts = unnest(asked.withColumn("_grams", _grams(F.col("_needle"))), "_grams", "gram", ["_needle"])
    sizes = postings.groupBy("gram").agg(F.count("*").alias("_n"))
    rarest = (parts.join(sizes, "gram", "left").groupBy("_needle")
              .agg(F.min_by("gram", F.coalesce("_n", F.lit(0))).alias("gram"), F.count_if(F.col("_n").isNull()).alias("_none"))
              .filter("_none = 0").select("_needle", "gram"))
    return (rarest.join(postings, "gram").filter(F.contains("key", "_needle"))
            .groupBy("_needle").agg(F.min_by("target", "ord").alias("_within")))


def find_hospitals(requests: DataFrame, index: DataFrame, ids: DataFrame | None = None,
                   postings: DataFrame | None = None) -> DataFrame:
    """Add `target`: by exact id, else exact name, else the first key (in index order) that
    contains the name, if the name has four characters or more.

    `requests`: name and, with `ids` (oshpdid, target), oshpdid; `postings` is the `gram_index`
    of the index where it is kept.  Only distinct names without an exact match are searched for."""
    postings = gram_index(index) if postings is None else postings
    named = requests.withColumn("_key", F.upper("name")).withColumn("_needle", F.trim("_key"))
    exact = index.select(F.col("key").alias("_key"), F.col("target").alias("_exact"))
    joined = named.join(exact, "_key", "left")
    found = first_containing(joined.filter(F.col("_exact").isNull()).select("_needle").distinct(), postings)
    out = joined.join(found, "_needle", "left")
    best = F.coalesce("_exact", "_within")
    if ids is not None:
        by_id = ids.select(F.col("oshpdid"), F.col("target").alias("_by_id"))
        out = out.join(by_id, "oshpdid", "left")
        best = F.coalesce("_by_id", "_exact", "_within")
    return out.withColumn("target", best).select(*requests.columns, "target")


def find_by_ccn(requests: DataFrame, roster: DataFrame, pos: str = "pos") -> DataFrame:
    """Add `target` by (state, ccn) only; names never resolve a statutory hospital."""
    keyed = roster.filter(S.blank_to_null(F.col("ccn")).isNotNull()).groupBy("state", "ccn").agg(
        F.max(pos).alias("target"))
    return requests.join(keyed, ["state", "ccn"], "left")


# --- listings --------------------------------------------------------------------------------


def nearby_peers(rows: DataFrame, n: int = 10, pos: str = "pos", county: str = "county",
                 slug: str = "slug") -> DataFrame:
    """(slug, peers): the first n other hospitals of the county, in index order.

    Each county gives its first n + 1 rows, cut per task before the shuffle; a county of any
    size costs n + 1 rows."""
    w = W.partitionBy(county).orderBy(pos)
    head = (rows.filter(F.col(county).isNotNull()).withColumn("_rn", F.row_number().over(w))
            .filter(F.col("_rn") <= n + 1))
    heads = head.groupBy(county).agg(                                  # n + 1 at most
        F.sort_array(F.collect_list(F.struct(F.col("_rn"), F.col(slug).alias("s"), F.col(pos).alias("p"))))
         .alias("_head"))
    others = F.transform(F.filter("_head", lambda h: h["p"] != F.col(pos)), lambda h: h["s"])
    return (rows.join(heads, county)
            .withColumn("peers", F.slice(others, 1, n))
            .filter(F.size("peers") > 0).select(slug, county, "peers"))


def county_index(rows: DataFrame, county: str = "county", pos: str = "pos") -> DataFrame:
    """County slug to the name it was first seen with."""
    return (rows.filter(S.blank_to_null(F.col(county)).isNotNull())
            .groupBy(S.slugify(F.col(county)).alias("county_slug"))
            .agg(F.min(pos).alias("_first"))
            .join(rows.select(F.col(pos).alias("_first"), F.col(county).alias("name")), "_first")
            .select("county_slug", "name"))


def directory(rows: DataFrame, county: str = "county", name: str = "hospital",
              slug: str = "slug") -> DataFrame:
    """Counties in order, hospitals by name within each: (county, size, rank, hospital, slug).

    Kept as ordered rows: a county of any size spreads over tasks."""
    from rulegrain.operators.ranking import number_within

    listed = rows.select(F.coalesce(county, F.lit("Other")).alias("county"),
                         F.col(name).alias("hospital"), F.col(slug).alias("slug"))
    sizes = listed.groupBy("county").agg(F.count("*").alias("size"))
    return number_within(listed, ["county"], ["hospital", "slug"], "rank").join(sizes, "county")


def page_urls(pages: DataFrame, base: str, kind: Column, slug: Column,
              state: Column) -> DataFrame:
    """Every page in every language."""
    langs = F.array(*[F.lit(code) for code in V.LANGUAGES])
    fanned = pages.select("*", F.explode(langs).alias("lang"))
    return fanned.withColumn("url", F.concat(F.lit(base),
                                             S.page_path(F.col("lang"), slug, kind, state)))


def breadcrumb(names: list[Column], urls: list[Column]) -> Column:
    items = [F.struct(F.lit("ListItem").alias("@type"), F.lit(i).alias("position"),
                      n.alias("name"), u.alias("item"))
             for i, (n, u) in enumerate(zip(names, urls), 1)]
    return F.struct(F.lit("BreadcrumbList").alias("@type"),
                    F.array(*items).alias("itemListElement"))


def faq_keys(lang: Column, family_ceiling: Column, free_pct: Column, phone: Column) -> Column:
    """Which questions an English page answers; translated pages carry none."""
    asked = F.array_compact(F.array(
        F.when((family_ceiling > 0) & (free_pct > 0), F.lit("faq_free")),
        F.lit("faq_assistance"),
        F.when(F.coalesce(phone, F.lit("")) != "", F.lit("faq_apply"))))
    return F.when(lang == "en", asked)
