"""Raw inputs to typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulegrain import reference_values as V
from rulegrain import schemas
from rulegrain.functions import markup as M
from rulegrain.functions import scalars as S
from rulegrain.operators.flatten import unnest

# --- rosters ---------------------------------------------------------------------------------


def _first_filled(df: DataFrame, *names: str) -> Column:
    """First non-blank value among the header variants the file has."""
    present = [S.blank_to_null(F.trim(F.col(f"`{n}`"))) for n in names if n in df.columns]
    return F.coalesce(*present, F.lit(None).cast("string"))


def roster_filter(raw: DataFrame, state: str) -> DataFrame:
    """The state's rows, without federal hospitals and rows without a name."""
    def tidy(name: str) -> Column:
        return F.trim(F.coalesce(F.col(f"`{name}`"), F.lit("")))
    return raw.filter((F.upper(tidy("State")) == state.upper())
                      & ~tidy("Hospital Ownership").isin(V.FEDERAL_OWNERSHIP)
                      & (tidy("Facility Name") != ""))


def normalize_roster(raw: DataFrame, state: Column, extra: list[str] | None = None) -> DataFrame:
    blank = F.lit("")
    return raw.select(
        *(extra or []),
        F.upper(F.coalesce(_first_filled(raw, "Facility Name"), blank)).alias("hospital"),
        F.coalesce(_first_filled(raw, "Facility ID", "CCN"), blank).alias("ccn"),
        F.upper(F.coalesce(_first_filled(raw, "City/Town", "City"), blank)).alias("city"),
        S.py_title(_first_filled(raw, "County/Parish", "County Name")).alias("county"),
        F.coalesce(_first_filled(raw, "ZIP Code", "ZIP"), blank).alias("zip"),
        state.alias("state"),
        _first_filled(raw, "Telephone Number").alias("phone"),
        _first_filled(raw, "Hospital Ownership").alias("ownership"),
        _first_filled(raw, "Hospital Type").alias("hospital_type"),
        F.lit("statutory").alias("status"))


# --- search results and batch results --------------------------------------------------------


def flatten_search_hits(responses: DataFrame, body: str = "body") -> DataFrame:
    """One row per hit of every response; of a meta list the first value counts."""
    parsed = responses.withColumn("_r", F.from_json(body, schemas.SEARCH_HITS)) \
                      .withColumn("_hits", F.col("_r.hits.hits"))
    keep = [c for c in responses.columns if c != body]

    def meta(name: str) -> Column:
        return F.get(F.col(f"_hit._source.meta.{name}"), F.lit(0))["value"].alias(name[5:])

    return unnest(parsed, "_hits", "_hit", keep).select(
        *keep, "_hit._source.post_title", "_hit._source.permalink",
        meta("hfbp_city"), meta("hfbp_zip"), meta("hfbp_county"))


def read_results(lines: DataFrame, ids: DataFrame, line: str = "value") -> DataFrame:
    """Result lines -> (source_sha256, policy JSON text, error).

    `ids`: custom_id, source_sha256.  Blank lines and unknown ids drop out."""
    parsed = (lines.filter(F.trim(F.col(line)) != "")
                   .select(F.from_json(line, schemas.RESULT_LINE).alias("r"))
                   .select("r.custom_id", "r.result"))
    joined = parsed.join(ids, "custom_id")
    made = F.get(F.filter(F.col("result.message.content"), lambda b: b["type"] == "tool_use"),
                 F.lit(0))
    ok = F.col("result.type") == "succeeded"
    kind = F.col("result.type")
    detail = F.substring(F.coalesce(S.blank_to_null(F.col("result.error")),
                                    S.json_quote(kind)), 1, 200)
    error = (F.when(ok & made["input"].isNull(), F.lit("no tool_use block"))
              .when(~ok, F.concat(F.lit("batch_"), kind, F.lit(": "), detail)))
    return joined.select("source_sha256", F.when(ok, made["input"]).alias("policy"),
                         error.alias("error"))


# --- pages -----------------------------------------------------------------------------------


def parse_policy_pages(pages: DataFrame, html: str = "html",
                       attachment: str = V.ATTACHMENT_PATH) -> DataFrame:
    """Add `policies` (section -> document pointers) and the top-level `archive_oshpdid`."""
    keep = [c for c in pages.columns if c != html]
    spans = pages.withColumn("_spans", M.section_spans(F.col(html)))
    parts = spans.withColumn("_parts", M.section_parts(F.col(html), F.col("_spans")))
    entries = F.transform("_parts", lambda p: F.struct(
        p["key"].alias("key"), M.section_record(p, attachment).alias("value")))
    ids = F.filter(F.transform("_parts", lambda p: p["archive"]), lambda v: v.isNotNull())
    return parts.select(*keep, F.map_from_entries(entries).alias("policies"),
                        F.get(ids, F.lit(0)).alias("archive_oshpdid"))


def parse_detail_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """Labelled fields of a detail page, empty tiers dropped, with both dollar tables."""
    keep = [c for c in pages.columns if c != html]
    text = F.col("_text")
    pair = r"(?i)FPL Range:\s*(\d+(?:\.\d+)?)\s*%\s*-\s*(\d+(?:\.\d+)?)\s*%"
    bounds = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(pair), F.lit(1)).alias("lo"),
        F.regexp_extract_all(text, F.lit(pair), F.lit(2)).alias("hi"))
    tiers = drop_empty_tiers(F.transform(bounds, lambda b: F.struct(
        b["lo"].try_cast("double").alias("fpl_low_pct"),
        b["hi"].try_cast("double").alias("fpl_high_pct"))))
    fields = {
        "hospital": r"Hospital:\s*(.+?)\s+\d+\s+\w", "total_beds": r"Total Beds:\s*(\d+)",
        "emergency_room": r"Emergency Room:\s*(\w+)", "website": r"(https?://[^\s]+)",
        "discount_payment_basis": r"FPL Range:.*?Payment Basis:\s*([A-Za-z]+)",
        "policy_effective_date": r"Policy Effective Date:\s*(\d{1,2}/\d{1,2}/\d{4})",
        "discount_effective_date":
            r"Discount Payment Effective Date:\s*(\d{1,2}/\d{1,2}/\d{4})",
        "application_effective_date": r"Application Form Eff Date:\s*(\d{1,2}/\d{1,2}/\d{4})",
    }
    free = M.first_group(text, r"Free Care:\s*(\d+(?:\.\d+)?)\s*%").try_cast("double")
    found = (pages.withColumn("_text", M.clean_text(F.col(html)))
             .select(*keep, *[M.first_group(text, p).alias(n) for n, p in fields.items()],
                     free.alias("free_care_fpl_pct"), tiers.alias("discount_tiers"),
                     S.phone_find(text).alias("business_office_phone")))
    return (found.withColumn("discount_ceiling", ceiling_of(F.col("discount_tiers")))
            .withColumn("free_care_income_ceiling_by_household",
                        S.dollar_table(F.col("free_care_fpl_pct")))
            .withColumn("discount_income_ceiling_by_household",
                        S.dollar_table(F.col("discount_ceiling"))))


def drop_empty_tiers(tiers: Column) -> Column:
    return F.filter(tiers, lambda t: (t["fpl_low_pct"] != 0) | (t["fpl_high_pct"] != 0))


def ceiling_of(tiers: Column) -> Column:
    return F.array_max(F.transform(tiers, lambda t: t["fpl_high_pct"]))


def harvest_ids(html: Column) -> Column:
    """Facility ids linked from a list page, first occurrence order."""
    return F.array_distinct(M.all_groups(html, r"href='/SearchDetail\.aspx\?oshpdid=(\d+)'"))


# --- corpora ---------------------------------------------------------------------------------


def corpus_signatures(records: DataFrame) -> DataFrame:
    """Add `sections` (array<struct<ord,section,guid>>, repeated documents dropped) and
    `signature`, the same for all records that point at the same documents."""
    entries = F.array_compact(F.array(*[
        F.when(S.blank_to_null(F.try_element_at("policies", F.lit(key))["current_policy_url"])
               .isNotNull(),
               F.struct(F.lit(i).alias("ord"), F.lit(key).alias("section"),
                        S.guid(F.try_element_at("policies", F.lit(key))["current_policy_url"])
                         .alias("guid")))
        for i, (key, _) in enumerate(V.SECTIONS)]))
    made = records.withColumn("_all", entries) \
                  .withColumn("_guids", F.transform("_all", lambda e: e["guid"]))
    first = F.filter("_all", lambda e, i: F.array_position(F.col("_guids"), e["guid"]) == i + 1)
    return (made.withColumn("sections", first)
            .withColumn("signature", F.array_join(F.transform(
                "sections", lambda e: F.concat(e["section"], F.lit(":"), e["guid"])), "|"))
            .drop("_all", "_guids"))


def build_corpora(signed: DataFrame, texts: DataFrame, max_chars: int | None = None) -> DataFrame:
    """One corpus per distinct signature: (signature, corpus, truncated).

    `texts`: guid, text.  Each corpus is built once however many records share it, from at
    most one text per section.  `truncated` says whether it exceeds the published limit; it is
    cut only when `max_chars` is given."""
    wanted = signed.select("signature", "sections").dropDuplicates(["signature"])
    pieces = unnest(wanted, "sections", "s", ["signature"]).select(
        "signature", "s.ord", "s.section", "s.guid").join(texts, "guid")
    headed = pieces.filter(F.trim("text") != "").select(
        "signature", F.struct("ord", F.concat(
            F.lit("===== "), F.upper("section"), F.lit(" POLICY =====\n"), F.col("text"))
            .alias("body")).alias("piece"))
    joined = headed.groupBy("signature").agg(
        F.array_sort(F.collect_list("piece")).alias("pieces"))      # three at most
    corpus = F.array_join(F.transform("pieces", lambda p: p["body"]), "\n\n")
    whole = (wanted.select("signature").join(joined, "signature", "left")
             .withColumn("corpus", F.coalesce(corpus, F.lit(""))).drop("pieces"))
    limit = F.lit(max_chars or V.CORPUS_MAX_CHARS)
    out = whole.withColumn("truncated", F.length("corpus") > limit)
    return out.withColumn("corpus", F.substring("corpus", 1, max_chars)) if max_chars else out


# --- extraction ------------------------------------------------------------------------------


def parse_rules(texts: DataFrame, text: str = "text") -> DataFrame:
    """The built-in extraction: ceilings stated in plain wording."""
    t = F.col(text)
    found = (texts.withColumn("free_care_fpl_pct",
                              F.coalesce(M.free_on_cue_line(t), M.free_by_patterns(t)))
             .withColumn("fpl_pcts_seen", M.fpl_percents_seen(t)))
    return (found.withColumn("discount_max_fpl_pct", F.array_max("fpl_pcts_seen"))
            .withColumn("confidence", M.rule_confidence(F.col("free_care_fpl_pct"),
                                                        F.col("discount_max_fpl_pct"))))


def provenance(records: DataFrame, model: str, extracted_at: str) -> DataFrame:
    """Base columns of an extracted row, carried over from its source record."""
    def pointer(section: str, field: str) -> Column:
        return F.try_element_at("policies", F.lit(section))[field]
    return records.select(
        F.col("post_title").alias("hospital"), F.col("archive_oshpdid").alias("oshpdid"),
        "city", "county", "zip", "permalink",
        pointer("charity_care", "current_policy_url").alias("charity_policy_url"),
        pointer("charity_care", "current_effective_date").alias("charity_effective_date"),
        pointer("discount_payment", "current_policy_url").alias("discount_policy_url"),
        pointer("charity_care", "application_url").alias("application_url"),
        F.lit(extracted_at).alias("extracted_at"), F.lit(model).alias("model"),
        "source_sha256")


def extract_with(unique: DataFrame, extractor, schema: str) -> DataFrame:
    """Run a user's batch extractor over unique contents.

    `extractor` maps an iterator of pandas frames (source_sha256, text) to frames of `schema`,
    which carries source_sha256, policy and error."""
    return unique.select("source_sha256", "text").mapInPandas(extractor, schema)


def text_of_binary(files: DataFrame, to_text: Column) -> DataFrame:
    """A user's document-to-text function over a `binaryFile` frame: (path, guid, text)."""
    name = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return files.select("path", name.alias("guid"), F.coalesce(to_text, F.lit("")).alias("text"))
