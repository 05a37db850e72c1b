"""Eligibility: which help a household gets from a law or from a hospital's own policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulegrain import reference_values as V
from rulegrain import rules as R
from rulegrain.functions import scalars as S
from rulegrain.sources.inline import inline_table

SUPPRESSING = ["ungrounded", "stale_source", "unreadable_source"]

# --- the law ---------------------------------------------------------------------------------


def band_tier(pct: Column, free: Column, discount: Column) -> Column:
    return (F.when(pct <= free, F.lit("free"))
             .when(pct <= discount, F.lit("discount"))
             .otherwise(F.lit("over")))


def with_statutory_bands(roster: DataFrame) -> DataFrame:
    """Roster rows with `rules`, `rural`, `free_band`, `discount_band`."""
    return R.with_bands(R.with_rules(roster))


FACT_FIELDS = ["income_cap_pct", "payment_cap_pct", "payment_cap_ceiling_pct",
               "payment_cap_pct_professional", "payment_cap_pct_comprehensive",
               "payment_cap_payoff_months", "hardship_ceiling_pct", "hardship_debt_pct",
               "catastrophic_cap_pct", "catastrophic_ceiling_pct", "medical_hardship_entry_pct",
               "program_suspended"]


def statutory_facts(scored: DataFrame) -> DataFrame:
    """Rows that carry `rules`, bands and `fpl_pct` -> the fact columns the law states.

    A state whose law sets no band gets null facts (`statutory` false)."""
    r = F.col("rules")
    on = R.is_statutory(r)

    def fact(value: Column) -> Column:
        return F.when(on, value)

    return (scored.withColumn("statutory", on)
            .withColumn("fact_state", fact(r["code"]))
            .withColumn("fact_law", fact(r["law"]))
            .withColumn("tier", fact(band_tier(F.col("fpl_pct"), F.col("free_band"),
                                               F.col("discount_band"))))
            .withColumns({name: fact(r[name]) for name in FACT_FIELDS}))


def statutory_message_keys() -> Column:
    """Message keys, in order, for a row of `statutory_facts`."""
    return F.array_compact(_message_keys())


def _message_keys() -> Column:
    """Those keys with a null for every one that does not apply."""
    tier, pct = F.col("tier"), F.col("fpl_pct")
    free, disc = F.col("free_band"), F.col("discount_band")
    base = (F.when(tier == "free", F.lit("cc_statutory_free"))
             .when((tier == "discount") & free.isNull(), F.lit("cc_statutory_discount_only"))
             .when((tier == "discount") & F.col("income_cap_pct").isNull(),
                   F.lit("cc_statutory_discount_nocap"))
             .when(tier == "discount", F.lit("cc_statutory_discount"))
             .when((tier == "over") & disc.isNull() & free.isNotNull(),
                   F.lit("cc_statutory_over_free_only"))
             .when(tier == "over", F.lit("cc_statutory_over")))
    within_cap = (F.col("payment_cap_pct") > 0) & (pct <= F.col("payment_cap_ceiling_pct"))
    payoff = F.coalesce(F.col("payment_cap_payoff_months") > 0, F.lit(False))
    over = tier == "over"
    cap_note = (F.when((tier == "discount") & payoff & (pct <= F.col("payment_cap_ceiling_pct")),
                       F.lit("cc_payment_cap_payoff"))
                 .when(over & ~payoff & within_cap, F.lit("cc_payment_cap")))
    hardship = (F.when(over & (F.col("hardship_debt_pct") > 0)
                       & (pct <= F.col("hardship_ceiling_pct")), F.lit("cc_hardship_extend"))
                 .when(over & (F.col("catastrophic_cap_pct") > 0)
                       & (pct <= F.col("catastrophic_ceiling_pct")), F.lit("cc_catastrophic"))
                 .when(over & (F.col("medical_hardship_entry_pct") > 0),
                       F.lit("cc_medical_hardship")))
    return (F.when(~F.col("statutory"), F.lit(None).cast("array<string>"))
             .when(F.col("program_suspended"), F.array(F.lit("cc_program_suspended")))
             .otherwise(F.array(base, cap_note, hardship)))


#: What each statutory message is filled with, by its key; facts keep their names.
MESSAGE_ARGUMENTS = {
    "cc_statutory_free": ["name", "law", "pct", "free_pct"],
    "cc_statutory_discount": ["name", "law", "pct", "free_pct", "discount_pct", "cap"],
    "cc_statutory_discount_nocap": ["name", "law", "pct", "free_pct", "discount_pct"],
    "cc_statutory_discount_only": ["name", "law", "pct", "discount_pct", "cap"],
    "cc_statutory_over": ["name", "law", "pct", "discount_pct"],
    "cc_statutory_over_free_only": ["name", "law", "pct", "free_pct"],
    "cc_payment_cap_payoff": ["law", "payment_cap_pct", "payment_cap_pct_professional", "payment_cap_pct_comprehensive",
                              "payment_cap_payoff_months", "payment_cap_ceiling_pct"],
    "cc_payment_cap": ["law", "payment_cap_pct", "payment_cap_ceiling_pct"],
    "cc_hardship_extend": ["law", "hardship_ceiling_pct", "hardship_debt_pct"],
    "cc_catastrophic": ["law", "catastrophic_cap_pct", "catastrophic_ceiling_pct"],
    "cc_medical_hardship": ["law", "medical_hardship_entry_pct"],
    "cc_program_suspended": ["name"],
}


def statutory_message_args(title: str | None = None) -> dict[str, Column]:
    """The arguments of those messages, for a row of `statutory_facts` with its `hospital`, or with a column
    that has the hospital's name in title case."""
    own = {"name": F.col(title) if title else S.py_title(F.col("hospital")), "law": F.col("fact_law"), "pct": F.col("fpl_pct"),
           "free_pct": F.col("free_band"), "discount_pct": F.col("discount_band"), "cap": F.col("income_cap_pct")}
    own |= {f: F.col(f) for f in FACT_FIELDS if f not in ("income_cap_pct", "program_suspended")}
    # a fact that the law does not state is in no message of its state
    return {n: c if n == "pct" else F.coalesce(c.cast("string"), F.lit("")) for n, c in own.items()}


def statutory_texts(facts: DataFrame, ids: list[str], catalog: DataFrame, out: str = "text",
                    title: str | None = None) -> DataFrame:
    """(ids…, out): the statutory message of each row of `statutory_facts` in the row's `lang`, from the catalog's
    templates (English where a language lacks one).  Rows outside the law's reach have none.  Many rows name
    few hospitals: `title` is a column with their names in title case, made before they met the bills."""
    from rulegrain.operators import catalog as C

    keyed = facts.filter("statutory").withColumn("_keys", _message_keys())
    return C.render(keyed, ids, "_keys", catalog, statutory_message_args(title), numeric=("pct",), out=out)


def page_note_keys() -> Column:
    """Keys of the notes a statutory hospital page shows, in page order."""
    r, free, disc = F.col("rules"), F.col("free_band"), F.col("discount_band")
    program, cap = r["is_program"], r["income_cap_pct"]

    def shaped(stem: str, otherwise: Column) -> Column:
        return (F.when(disc.isNull(), F.lit(stem + "_free_only"))
                 .when(free.isNull(), F.lit(stem + "_discount_only")).otherwise(otherwise))

    def by_program(stem: str) -> Column:
        return F.when(program, F.lit(stem + "_program")).otherwise(F.lit(stem))

    def note(condition: Column, key: str) -> Column:
        return F.when(condition, F.lit(key))

    rural_bands = r["free_rural_pct"].isNotNull() | r["discount_rural_pct"].isNotNull()
    body = F.array_compact(F.array(
        by_program("s_law_h"),
        shaped("s_law_p", F.when(cap.isNotNull(), F.lit("s_law_p")).otherwise(F.lit("s_law_p_nocap"))),
        note(F.col("rural") & rural_bands, "s_rural_note"),
        by_program("s_minimum_note"),
        note(program, "s_program_currency"),
        F.when((r["payment_cap_pct"] > 0) & (r["payment_cap_ceiling_pct"] > 0),
               F.when(r["payment_cap_payoff_months"] > 0, F.lit("s_payment_cap_payoff"))
                .otherwise(F.lit("s_payment_cap"))),
        note(r["immigration_excluded"], "s_immigration"),
        note(r["names_medicaid_cap"], "s_medicaid_cap"),
        note(r["bars_debt_lawsuits"], "s_debt_protection"),
        note(r["apply_deadline_days"] > 0, "s_apply_deadline"),
        note((r["hardship_ceiling_pct"] > 0) & (r["hardship_debt_pct"] > 0), "s_hardship_extend"),
        note((r["catastrophic_cap_pct"] > 0) & (r["catastrophic_ceiling_pct"] > 0),
             "s_catastrophic_cap"),
        note(r["medical_hardship_entry_pct"] > 0, "s_medical_hardship"),
        note(r["charity_excess_pct"] > 0, "s_charity_excess"),
        note(r["debt_suit_floor_usd"] > 0, "s_debt_protection_md")))
    head = F.array(shaped("s_meta", by_program("s_meta")),
                   shaped("s_h_lead", by_program("s_h_lead")))
    guarantee = F.when(r["program_suspended"], F.array(F.lit("s_program_suspended"))) \
                 .otherwise(body)
    return F.when(R.is_statutory(r), F.concat(head, guarantee))


def plan_extra_keys() -> Column:
    """Extra notes of a statutory plan: only where a guarantee was stated."""
    r, tier = F.col("rules"), F.col("tier")
    notes = F.array_compact(F.array(
        F.lit("s_minimum_note"),
        F.when((tier == "discount") & r["names_medicaid_cap"], F.lit("s_medicaid_cap")),
        F.when(r["bars_debt_lawsuits"], F.lit("s_debt_protection")),
        F.when(r["apply_deadline_days"] > 0, F.lit("s_apply_deadline"))))
    return F.when(tier.isin("free", "discount"), notes) \
            .otherwise(F.array().cast("array<string>"))


def program_currency(rules: DataFrame, today: Column) -> DataFrame:
    """Whether each program-based authority is still confirmed on `today`."""
    days = F.date_diff(F.col("program_confirmed_through").try_cast("date"), today)
    status = (F.when(F.col("program_suspended"), F.lit("SUSPENDED"))
               .when(F.col("program_confirmed_through").isNull(), F.lit("UNTRACKED"))
               .when(days < 0, F.lit("STALE"))
               .when(days <= V.PROGRAM_WARN_DAYS, F.lit("WARN"))
               .otherwise(F.lit("OK")))
    return (rules.filter("is_program")
            .withColumn("currency", status)
            .withColumn("days_left", F.when(~F.col("program_suspended"), days))
            .withColumn("problem", F.col("currency").isin("SUSPENDED", "STALE")))


# --- a hospital's own policy -----------------------------------------------------------------


def suppressed(grounding: Column) -> Column:
    """True when the row's own source document contradicts its numbers."""
    return F.coalesce(grounding["verdict"].isin(SUPPRESSING), F.lit(False))


def first_band(tiers: Column, pct: Column) -> Column:
    """The first tier, in array order, whose closed band holds `pct`; null when none does."""
    return F.get(F.filter(tiers, lambda t: (t["fpl_low_pct"] <= pct) & (pct <= t["fpl_high_pct"])),
                 F.lit(0))


def with_policy_tier(df: DataFrame) -> DataFrame:
    """Rows holding `policy`, `grounding`, `fpl_pct`, `insured` -> `tier`, `message_key` and the
    message's numbers: `band` (struct), `ceiling`."""
    pct = F.col("fpl_pct")
    free = F.col("policy.free_care.fpl_ceiling_pct")
    disc = F.col("policy.discount_payment.fpl_ceiling_pct")
    tiers = F.col("policy.discount_payment.tiers")
    oop = F.col("policy.high_medical_cost.oop_threshold_pct_of_income")
    band = F.col("band")
    nothing = free.isNull() & disc.isNull() & (F.coalesce(F.size(tiers), F.lit(0)) <= 0)
    # one ordered decision; both outputs read it
    case = (F.when(suppressed(F.col("grounding")), F.lit("unknown:cc_unknown"))
             .when(pct <= free, F.lit("free:cc_free"))
             .when(band.isNotNull(), F.lit("discount:cc_discount_tier"))
             .when((pct <= disc) & (free.isNull() | (pct > free)),
                   F.lit("discount:cc_discount_ceiling"))
             .when(F.col("insured") & (oop != 0), F.lit("high_cost:cc_high_cost"))
             .when(nothing, F.lit("unknown:cc_unknown"))
             .otherwise(F.lit("over:cc_over")))
    return (df.withColumn("band", first_band(tiers, pct))
              .withColumn("_case", case)
              .withColumn("tier", F.split_part("_case", F.lit(":"), F.lit(1)))
              .withColumn("message_key", F.split_part("_case", F.lit(":"), F.lit(2)))
              .withColumn("ceiling", F.when(F.col("tier") == "over",
                                            F.coalesce(F.greatest(free, disc), F.lit(0.0))))
              .drop("_case"))


# --- help around the bill --------------------------------------------------------------------


def benefit_key(pct: Column, insurance: Column) -> Column:
    return (F.when(S.is_insured(insurance), F.lit("ben_insured"))
             .when(pct <= 138, F.lit("ben_medicaid_heuristic"))
             .when(pct <= 400, F.lit("ben_aca_heuristic"))
             .otherwise(F.lit("ben_over_heuristic")))


def debt_keys(in_collections: Column) -> Column:
    keys = ["debt_rights", "debt_retroactive", "debt_legalaid", "debt_credit_note"]
    return F.when(in_collections, F.array(*[F.lit(k) for k in keys])) \
            .otherwise(F.array().cast("array<string>"))


def _door(door_id: str, url: Column, phone: str | None, label: str) -> Column:
    return F.struct(F.lit(door_id).alias("id"), url.alias("url"),
                    F.lit(phone).cast("string").alias("phone"), F.lit(label).alias("label"))


def help_doors(df: DataFrame, doors: list[tuple] | None = None, out: str = "resources",
               pct: str = "fpl_pct", insurance: str = "insurance",
               in_collections: str = "in_collections") -> DataFrame:
    """Help destinations that apply to each row, in priority order.

    Each door brings its own SQL condition over `uninsured`, `pct` and `in_collections`."""
    frame = df.withColumn("_ctx", F.struct(
        S.is_uninsured(F.col(insurance)).alias("uninsured"), F.col(pct).alias("pct"),
        F.coalesce(F.col(in_collections), F.lit(False)).alias("in_collections")))

    def holds(condition: str) -> Column:
        for name in ("uninsured", "pct", "in_collections"):
            condition = _word_replace(condition, name, f"_ctx.{name}")
        return F.expr(condition)

    made = [F.when(holds(condition), _door(door_id, F.lit(url), phone, label))
            for door_id, url, phone, label, condition in (doors or V.HELP_DOORS)]
    return frame.withColumn(out, F.array_compact(F.array(*made))).drop("_ctx")


def _word_replace(text: str, word: str, new: str) -> str:
    import re
    return re.sub(rf"(?<![\w.]){word}\b", new, text)


_DOORS = T.StructType([T.StructField(n, T.StringType()) for n in ("_state", "_coverage", "_legal")])


def state_help_doors(df: DataFrame, out: str = "resources", state: str = "state",
                     insurance: str = "insurance",
                     in_collections: str = "in_collections") -> DataFrame:
    """The state's own doors; none for a state without an entry."""
    table = inline_table(df.sparkSession,
                         [(code, *urls) for code, urls in V.STATE_DOORS.items()], _DOORS)
    uninsured = S.is_uninsured(F.col(insurance))
    known = F.col("_coverage").isNotNull()
    doors = F.array(
        F.when(known & uninsured, _door("coverage", F.col("_coverage"), None, "res_coverage")),
        F.when(known & uninsured, _door("clinic", F.lit(V.CLINIC_URL), None, "res_clinic")),
        F.when(known & F.col(in_collections), _door("legalaid", F.col("_legal"), None,
                                                    "res_legalaid")))
    return (df.withColumn("_state", F.upper(F.coalesce(F.col(state), F.lit(""))))
              .join(F.broadcast(table), "_state", "left")     # one row per listed state
              .withColumn(out, F.array_compact(doors))
              .drop("_state", "_coverage", "_legal"))


def closing_step(has_benefits: Column, has_debt: Column) -> Column:
    return F.lit(2) + has_benefits.cast("int") + has_debt.cast("int")


# --- intake ----------------------------------------------------------------------------------

_LIMITS = {"account": 40, "service_date": 40, "address": 120, "phone": 40}


def coerce_intakes(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Text requests -> (accepted, rejected).

    Blank household means 1 and blank income 0; anything else that is no whole number rejects
    the row.  Optional texts are trimmed and cut."""
    def whole(name: str, default: int) -> Column:
        text = F.trim(F.col(name))
        return (F.when(S.blank_to_null(F.col(name)).isNull() | (text == "0"), F.lit(default))
                 .when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("bigint")))

    present = [c for c in _LIMITS if c in raw.columns]
    parsed = (raw.withColumn("household_size", whole("household", 1).cast("int"))
                 .withColumn("annual_income", whole("income", 0))
                 .withColumn("full_name", F.trim(F.coalesce("full_name", F.lit(""))))
                 .withColumn("first_name", F.coalesce(S.blank_to_null(F.split_part(
                     "full_name", F.lit(" "), F.lit(1))), F.lit("there")))
                 .withColumn("insurance", F.coalesce(S.blank_to_null(F.col("insurance")),
                                                     F.lit("uninsured")))
                 .withColumns({c: S.blank_to_null(F.substring(F.trim(F.col(c)), 1, _LIMITS[c]))
                               for c in present}))
    good = F.col("household_size").isNotNull() & F.col("annual_income").isNotNull()
    return parsed.filter(good), parsed.filter(~good).withColumn(
        "error", F.lit("income and household must be numbers"))


# --- the plan --------------------------------------------------------------------------------


def apply_keys(phone: Column, interest_free: Column) -> Column:
    has_phone = F.coalesce(phone, F.lit("")) != ""
    return F.array_compact(F.array(
        F.when(has_phone, F.lit("step1_apply_phone")).otherwise(F.lit("step1_apply_nophone")),
        F.lit("step1_retroactive"),
        F.when(interest_free, F.lit("step1_interest_free"))))


_LINKS = {"policy_url": "charity_policy_url", "application_url": "application_url", "discount_policy_url": "discount_policy_url"}


PLAN_LINKS = [*_LINKS.values(), "charity_effective_date"]


def _hospital_links(df: DataFrame, today: str | None) -> list[Column]:
    """Links and the date shown of a row's documents, as far as the row has them."""
    links = [S.blank_to_null(F.col(c)).alias(name) for name, c in _LINKS.items() if c in df.columns]
    if today is not None and "charity_effective_date" in df.columns:
        links.append(S.effective_date_display(F.col("charity_effective_date"), F.lit(today).cast("date")).alias("effective_date"))
    return links


def _first_name(df: DataFrame) -> list[Column]:
    return [F.col("first_name").alias("first")] if "first_name" in df.columns else []


def plan_struct(scored: DataFrame, out: str = "plan", today: str | None = None) -> DataFrame:
    """The nested plan of rows from `with_policy_tier`; texts are catalog keys.

    The first name, the links to the documents and the effective date (if it is not after `today`) are
    part of it where the rows have them.  Needs: policy, hospital, needs_review, the free-care table, household_size, annual_income,
    insurance, in_collections, fpl_pct, tier, message_key."""
    size = F.col("household_size")
    phone = F.col("policy.contact.phone")
    frame = help_doors(scored, out="_doors")
    debt = debt_keys(F.col("in_collections"))
    plan = F.struct(
        F.col("fpl_pct").alias("fpl_pct"), F.col("tier").alias("tier"),
        F.concat(F.lit("result_"), F.col("tier")).alias("headline"),
        F.struct(S.py_title(F.col("hospital")).alias("name"), phone.alias("phone"),
                 F.coalesce(F.col("needs_review"), F.lit(False)).alias("needs_review"),
                 *_hospital_links(scored, today)).alias("hospital"),
        F.struct(size.alias("household"), F.col("annual_income").alias("income"), *_first_name(scored))
         .alias("patient"),
        F.struct(F.col("message_key").alias("message"),
                 F.when(F.col("tier") == "free", S.dollars_for(
                     F.col("free_care_income_ceiling_by_household"), size))
                  .alias("income_ceiling"),
                 apply_keys(phone, F.col("policy.payment_plans.interest_free")).alias("apply"))
         .alias("charity"),
        F.array(benefit_key(F.col("fpl_pct"), F.col("insurance"))).alias("benefits"),
        debt.alias("debt"),
        F.transform("_doors", lambda d: d["label"]).alias("resources"),
        closing_step(F.lit(True), F.col("in_collections")).alias("closing_step"))
    return frame.withColumn(out, plan).drop("_doors")


def generic_plan(intakes: DataFrame, out: str = "plan") -> DataFrame:
    """The hospital-free plan: no ceiling is invented, the tier stays unknown.

    Needs: hospital_name, household_size, annual_income, insurance, in_collections, fpl_pct."""
    frame = help_doors(intakes, out="_doors")
    name = S.blank_to_null(F.trim(F.col("hospital_name")))
    plan = F.struct(
        F.col("fpl_pct").alias("fpl_pct"), F.lit("unknown").alias("tier"),
        F.lit(True).alias("not_in_directory"), F.lit("result_unknown").alias("headline"),
        F.struct(S.py_title(name).alias("name"), F.lit(False).alias("needs_review"))
         .alias("hospital"),
        F.struct(F.col("household_size").alias("household"),
                 F.col("annual_income").alias("income"), *_first_name(intakes)).alias("patient"),
        F.struct(F.lit("cc_no_hospital").alias("message"),
                 apply_keys(F.lit(None).cast("string"), F.lit(False)).alias("apply"))
         .alias("charity"),
        F.array(benefit_key(F.col("fpl_pct"), F.col("insurance"))).alias("benefits"),
        debt_keys(F.col("in_collections")).alias("debt"),
        F.transform("_doors", lambda d: d["label"]).alias("resources"),
        closing_step(F.lit(True), F.col("in_collections")).alias("closing_step"))
    return frame.withColumn(out, plan).drop("_doors")


def statutory_plan(facts: DataFrame, out: str = "plan") -> DataFrame:
    """The nested plan of rows of `statutory_facts` where the law sets a band: what the law gives, with no
    ceiling of the hospital's own and no benefits; help comes from the state's own doors.

    Needs also: hospital, state, household_size, annual_income, insurance, in_collections."""
    frame = state_help_doors(facts.filter("statutory"), out="_doors")
    owes = F.coalesce(F.col("in_collections"), F.lit(False))
    plan = F.struct(
        F.col("fpl_pct").alias("fpl_pct"), F.col("tier").alias("tier"),
        F.concat(F.lit("result_"), F.col("tier")).alias("headline"),
        F.struct(S.py_title(F.col("hospital")).alias("name"), F.col("fact_state").alias("state"),
                 F.col("fact_law").alias("law")).alias("hospital"),
        F.struct(F.col("household_size").alias("household"), F.col("annual_income").alias("income"),
                 *_first_name(facts)).alias("patient"),
        F.struct(statutory_message_keys().alias("messages"), plan_extra_keys().alias("notes")).alias("charity"),
        F.array().cast("array<string>").alias("benefits"), debt_keys(owes).alias("debt"),
        F.transform("_doors", lambda d: d["label"]).alias("resources"),
        closing_step(F.lit(False), owes).alias("closing_step"))
    return frame.withColumn(out, plan).drop("_doors")


def match_or_generic(matched: DataFrame, found: Column) -> tuple[DataFrame, DataFrame]:
    """Split resolved requests: (served or asking for general guidance, rejected).

    `matched` holds `generic`; `found` says whether a hospital was resolved."""
    keep = found | F.coalesce(F.col("generic"), F.lit(False))
    served = matched.filter(keep).withColumn(
        "route", F.when(found, F.lit("hospital")).otherwise(F.lit("generic")))
    return served, matched.filter(~keep).withColumn("error", F.lit("hospital not found"))
