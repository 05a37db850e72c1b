"""Declared schemas: no reader infers one."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


STR, INT, LONG, DBL, BOOL, DATE = (T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(),
                                   T.BooleanType(), T.DateType())

TIER = _struct(fpl_low_pct=DBL, fpl_high_pct=DBL, benefit=STR, discount_basis=STR,
               patient_pays_pct=DBL)

POLICY = _struct(
    free_care=_struct(fpl_ceiling_pct=DBL, applies_to=STR, notes=STR),
    high_medical_cost=_struct(oop_threshold_pct_of_income=DBL, fpl_ceiling_pct=DBL, notes=STR),
    discount_payment=_struct(fpl_ceiling_pct=DBL, tiers=T.ArrayType(TIER), agb_percentage=DBL,
                             agb_method=STR, notes=STR),
    payment_plans=_struct(interest_free=BOOL, notes=STR),
    eligibility_process=_struct(documentation_required=T.ArrayType(STR), notes=STR),
    contact=_struct(phone=STR, notes=STR),
    source_quotes=STR,              # object, list or plain text: kept as JSON text
    extraction_confidence=DBL,
    extraction_notes=STR,
    _truncated=BOOL,
)

DOLLARS = T.MapType(INT, LONG)

GROUNDING = _struct(verdict=STR, checked=INT)

EXTRACTED_ROW = _struct(
    hospital=STR, oshpdid=STR, city=STR, county=STR, zip=STR, state=STR, permalink=STR,
    charity_policy_url=STR, charity_effective_date=STR, discount_policy_url=STR,
    application_url=STR, extracted_at=STR, model=STR, source_sha256=STR, extraction_channel=STR,
    status=STR, error=STR, policy=POLICY,
    free_care_income_ceiling_by_household=DOLLARS,
    discount_income_ceiling_by_household=DOLLARS,
    needs_review=BOOL, review_reasons=T.ArrayType(STR),
    grounding=GROUNDING, last_verified_at=STR,
)

DOCUMENT_LINK = _struct(url=STR, effective_date=STR)

SECTION = _struct(current_policy_url=STR, current_effective_date=STR,
                  archived_policies=T.ArrayType(DOCUMENT_LINK), application_url=STR,
                  application_effective_date=STR, archive_oshpdid=STR)

SOURCE_RECORD = _struct(post_title=STR, permalink=STR, city=STR, zip=STR, county=STR,
                        archive_oshpdid=STR, policies=T.MapType(STR, SECTION))

ROSTER_ROW = _struct(hospital=STR, ccn=STR, city=STR, county=STR, zip=STR, state=STR, phone=STR,
                     ownership=STR, hospital_type=STR, status=STR)

ROSTER_CSV = T.StructType([T.StructField(name, STR, True) for name in (
    "Facility ID", "Facility Name", "Address", "City/Town", "State", "ZIP Code", "County/Parish",
    "Telephone Number", "Hospital Ownership", "Hospital Type")])

SEARCH_META = T.ArrayType(_struct(value=STR))
SEARCH_HITS = _struct(hits=_struct(hits=T.ArrayType(_struct(_source=_struct(
    post_title=STR, permalink=STR,
    meta=_struct(hfbp_city=SEARCH_META, hfbp_zip=SEARCH_META, hfbp_county=SEARCH_META))))))

# One line of a results file.  `input` and `error` stay JSON text.
RESULT_LINE = _struct(
    custom_id=STR,
    result=_struct(type=STR, error=STR,
                   message=_struct(content=T.ArrayType(_struct(type=STR, input=STR)))))

RULES = _struct(
    code=STR, name=STR, floor_pct=INT, discount_implausible_pct=INT, free_unusual_pct=INT,
    free_implausible_pct=INT, law=STR, free_pct=INT, discount_pct=INT, income_cap_pct=INT,
    free_rural_pct=INT, discount_rural_pct=INT, immigration_excluded=BOOL,
    bars_debt_lawsuits=BOOL, names_medicaid_cap=BOOL, apply_deadline_days=INT,
    payment_cap_pct=INT, payment_cap_ceiling_pct=INT, payment_cap_pct_professional=INT,
    payment_cap_pct_comprehensive=INT, payment_cap_payoff_months=INT, hardship_ceiling_pct=INT,
    hardship_debt_pct=INT, debt_suit_floor_usd=INT, catastrophic_cap_pct=INT,
    catastrophic_ceiling_pct=INT, medical_hardship_entry_pct=INT, charity_excess_pct=INT,
    is_program=BOOL, program_confirmed_through=STR, program_suspended=BOOL)

GUIDELINE = _struct(year=INT, size=INT, usd=LONG)
