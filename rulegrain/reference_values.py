"""Legal bands, guideline amounts, word lists and patterns.

Everything in this file is a published constant the results depend on.  Logic
lives elsewhere.
"""

from __future__ import annotations

# --- poverty guideline, USD per year: household sizes 1..8, then each extra person -----------
GUIDELINE_YEAR = 2026
GUIDELINES = {
    2024: {"sizes": [15060, 20440, 25820, 31200, 36580, 41960, 47340, 52720], "each_extra": 5380},
    2025: {"sizes": [15650, 21150, 26650, 32150, 37650, 43150, 48650, 54150], "each_extra": 5500},
    2026: {"sizes": [15960, 21640, 27320, 33000, 38680, 44360, 50040, 55720], "each_extra": 5680},
}

# --- one entry per modelled jurisdiction; absent fields are null / false ---------------------
RULES = [
    {"code": "CA", "name": "California", "floor_pct": 400, "discount_implausible_pct": 800,
     "free_unusual_pct": 400, "free_implausible_pct": 600,
     "law": "California's Hospital Fair Pricing Act (Health & Safety Code §127405)"},
    {"code": "US", "name": "", "floor_pct": 0, "discount_implausible_pct": 800,
     "free_unusual_pct": 800, "free_implausible_pct": 800,
     "law": "Section 501(r) of the Internal Revenue Code"},
    {"code": "IL", "name": "Illinois", "floor_pct": 600, "discount_implausible_pct": 900,
     "free_unusual_pct": 200, "free_implausible_pct": 400,
     "law": "Illinois Hospital Uninsured Patient Discount Act (210 ILCS 89)",
     "free_pct": 200, "discount_pct": 600, "income_cap_pct": 20,
     "free_rural_pct": 125, "discount_rural_pct": 300, "apply_deadline_days": 90},
    {"code": "NY", "name": "New York", "floor_pct": 400, "discount_implausible_pct": 800,
     "free_unusual_pct": 200, "free_implausible_pct": 400,
     "law": "New York Hospital Financial Assistance Law (Public Health Law §2807-k)",
     "free_pct": 200, "discount_pct": 400, "immigration_excluded": True,
     "bars_debt_lawsuits": True, "names_medicaid_cap": True},
    {"code": "MD", "name": "Maryland", "floor_pct": 300, "discount_implausible_pct": 800,
     "free_unusual_pct": 200, "free_implausible_pct": 400,
     "law": "Maryland Hospital Financial Assistance Law (Health-General §19-214.1)",
     "free_pct": 200, "discount_pct": 300, "immigration_excluded": True,
     "hardship_ceiling_pct": 500, "hardship_debt_pct": 25, "apply_deadline_days": 240,
     "debt_suit_floor_usd": 500},
    {"code": "WA", "name": "Washington", "floor_pct": 300, "discount_implausible_pct": 800,
     "free_unusual_pct": 200, "free_implausible_pct": 400,
     "law": "Washington Charity Care Law (RCW 70.170.060)",
     "free_pct": 200, "discount_pct": 300},
    {"code": "NJ", "name": "New Jersey", "floor_pct": 300, "discount_implausible_pct": 800,
     "free_unusual_pct": 200, "free_implausible_pct": 400,
     "law": "New Jersey Hospital Care Payment Assistance Program (N.J.S.A. 26:2H-18.60)",
     "free_pct": 200, "discount_pct": 300, "charity_excess_pct": 30},
    {"code": "CO", "name": "Colorado", "floor_pct": 250, "discount_implausible_pct": 800,
     "free_unusual_pct": 250, "free_implausible_pct": 400,
     "law": "Colorado Hospital Discounted Care law (HB21-1198, C.R.S. §25.5-3-501 et seq.)",
     "discount_pct": 250, "payment_cap_pct": 4, "payment_cap_ceiling_pct": 250,
     "payment_cap_pct_professional": 2, "payment_cap_pct_comprehensive": 6,
     "payment_cap_payoff_months": 36},
    {"code": "OR", "name": "Oregon", "floor_pct": 400, "discount_implausible_pct": 800,
     "free_unusual_pct": 200, "free_implausible_pct": 400,
     "law": "Oregon's hospital financial assistance law (ORS 442.614, HB 3076)",
     "free_pct": 200, "discount_pct": 400},
    {"code": "RI", "name": "Rhode Island", "floor_pct": 300, "discount_implausible_pct": 800,
     "free_unusual_pct": 200, "free_implausible_pct": 400,
     "law": "Rhode Island's hospital charity care regulation (216-RICR-40-10-23)",
     "free_pct": 200, "discount_pct": 300},
    {"code": "ME", "name": "Maine", "floor_pct": 200, "discount_implausible_pct": 800,
     "free_unusual_pct": 200, "free_implausible_pct": 400,
     "law": "Maine's hospital financial assistance law (22 M.R.S. §1716-A)",
     "free_pct": 200, "payment_cap_pct": 4, "payment_cap_ceiling_pct": 400},
    {"code": "MA", "name": "Massachusetts", "floor_pct": 300, "discount_implausible_pct": 800,
     "free_unusual_pct": 150, "free_implausible_pct": 400,
     "law": "the Massachusetts Health Safety Net (M.G.L. c.118E; 101 CMR 613.00)",
     "free_pct": 150, "discount_pct": 300, "immigration_excluded": True,
     "medical_hardship_entry_pct": 10},
    {"code": "OH", "name": "Ohio", "floor_pct": 100, "discount_implausible_pct": 800,
     "free_unusual_pct": 100, "free_implausible_pct": 300,
     "law": "Ohio's Hospital Care Assurance Program (Ohio Rev. Code §5168.14)",
     "free_pct": 100},
    {"code": "VT", "name": "Vermont", "floor_pct": 400, "discount_implausible_pct": 800,
     "free_unusual_pct": 250, "free_implausible_pct": 400,
     "law": "Vermont's hospital financial assistance law (18 V.S.A. §9482)",
     "free_pct": 250, "discount_pct": 400, "immigration_excluded": True,
     "catastrophic_cap_pct": 20, "catastrophic_ceiling_pct": 600},
    {"code": "NC", "name": "North Carolina", "floor_pct": 300, "discount_implausible_pct": 800,
     "free_unusual_pct": 200, "free_implausible_pct": 400,
     "law": "North Carolina's Medical Debt Relief Program",
     "free_pct": 200, "discount_pct": 300, "is_program": True,
     "program_confirmed_through": "2026-06-30"},
]

DEFAULT_CODE = "US"
HOME_CODE = "CA"

# Rural hospitals are recognised by this roster type.
RURAL_TYPE = "Critical Access Hospitals"

# --- hospitals on the state's published upper tier: free to 300 %, discount to 400 % ---------
UPPER_TIER_STATE = "WA"
UPPER_TIER_FREE_PCT = 300
UPPER_TIER_DISCOUNT_PCT = 400
UPPER_TIER_CCNS = [
    "500002", "500005", "500008", "500011", "500014", "500015", "500019", "500021", "500024",
    "500025", "500026", "500027", "500030", "500036", "500039", "500041", "500044", "500050",
    "500051", "500054", "500058", "500064", "500077", "500079", "500088", "500108", "500119",
    "500124", "500129", "500139", "500141", "500150", "500151", "500152", "500154", "501309",
    "501326", "501329", "501335", "501340", "503300", "503301", "504009", "504016",
]

# --- content hashes confirmed by hand to publish no income thresholds -----------------------
CONFIRMED_NO_THRESHOLD = [
    "d8e9b38fa61410e17f42fff77a55b47a3e80229b9e368fcf90e94334c71b5041",
    "805d73ea4326ffef08e1b1a07026f641ec8cae305d620514ce6cea4132da8cd0",
    "0dd344e329923588479a7cca4ffde7ef93ae9e60abaa7aa5ef481185f62aa541",
    "7607bb8f74183fd28b0b74aaa4de252d854e4ec73ce35a4b20742d921b907a91",
    "6c7f29b733ec901bca40bf146981c14dade0e837b51cd8ca6538f2f5a8196c14",
    "ac46358929cc81acbec7bb2e6f2a12395e1972d6c2d961a8b73f4f3be1333044",
    "c56d241856a07055a3ffac0ace184f5142a04b7a9625b8e5b1f24fc0c5e556fa",
    "d6ac2259d5b7e5bb7faf454c27224c8c524a50c0b31cc598bee88255626a5451",
]

FEDERAL_OWNERSHIP = ["Veterans Health Administration", "Department of Defense"]

# --- thresholds ------------------------------------------------------------------------------
MIN_USABLE_CHARS = 500
MIN_STOPWORDS_PER_1000 = 10.0
EVIDENCE_WINDOW = 600
EVIDENCE_MARGIN = 60
LOW_CONFIDENCE = 0.6
REEXTRACT_CONFIDENCE = 0.8
CORPUS_MAX_CHARS = 200_000
PROGRAM_WARN_DAYS = 45
REFRESH_MAX_CHANGED = 40
REFRESH_MAX_REMOVED = 15
REFRESH_MIN_SHARE = 0.95
RATE_LIMIT = 30
RATE_WINDOW_SECONDS = 60

# --- word lists ------------------------------------------------------------------------------
STOPWORD_STEMS = ["the", "and", "of", "to", "for", "is", "or", "patient", "hospital", "income",
                  "los", "las", "de", "para", "con", "el", "la", "que", "paciente", "ingresos",
                  "atenci"]
UNINSURED_WORDS = ["none", "uninsured", "self-pay"]
RESTART_WORDS = ["start", "restart", "reset", "inicio"]
LETTER_WORDS = ["letter", "carta"]
ANONYMOUS = "there"
YES_WORDS = ["y", "yes", "yeah", "yep", "si", "sí", "s", "1", "true"]
NO_WORDS = ["n", "no", "nope", "0", "false"]

# --- patterns --------------------------------------------------------------------------------
POVERTY_WORDING = (r"\bFPL\b|\bFPG\b|federal\s+poverty|poverty\s+level|poverty\s+guideline"
                   r"|poverty\s+income")
PERCENT_VALUE = r"(\d{1,4}(?:\.\d+)?)\s*(?:%|percent\b|per\s*cent\b)"
FREE_CUE = r"full charity|free care|zero \(full|100%\s*(?:charity|assistance)|charity care"
FPL_PERCENT = r"(\d{2,3})\s*%\s*(?:of\s*(?:the\s*)?)?(?:federal poverty|fpl)"
FREE_PATTERNS = [
    r"(\d{2,3})\s*%\s*(?:or less|and below|or below).{0,60}?(?:federal poverty|fpl)",
    r"(?:at or below|below|up to|less than or equal to)\s*(\d{2,3})\s*%.{0,40}?(?:federal poverty|fpl)",
    r"(?:federal poverty level|fpl)[^.\n]{0,60}?(\d{2,3})\s*%\s*(?:or less|and below)",
]
PHONE = r"\(\d{3}\)\s*\d{3}-\d{4}"

# --- policy page sections, in page order -----------------------------------------------------
SECTIONS = [("charity_care", "Charity Care Policy"),
            ("discount_payment", "Discount Payment Policy"),
            ("debt_collection", "Debt Collection Policy")]
ATTACHMENT_PATH = "Attachment"

# --- languages and directory names -----------------------------------------------------------
LANGUAGES = ["en", "es", "zh", "vi", "tl", "ko", "hy", "fa", "ar", "ru"]
RTL_LANGUAGES = ["fa", "ar"]
DIRECTORY_SLUGS = {
    "CA": "california-hospitals", "IL": "illinois-hospitals", "NY": "new-york-hospitals",
    "MD": "maryland-hospitals", "WA": "washington-hospitals", "NJ": "new-jersey-hospitals",
    "CO": "colorado-hospitals", "OR": "oregon-hospitals", "RI": "rhode-island-hospitals",
    "ME": "maine-hospitals", "MA": "massachusetts-hospitals", "OH": "ohio-hospitals",
    "VT": "vermont-hospitals", "NC": "north-carolina-hospitals",
}
# accepted length ratios of a translation to its English text
LENGTH_RATIOS = {"zh": (0.25, 1.0), "ko": (0.35, 1.3), "vi": (0.6, 2.8)}
LENGTH_RATIO_DEFAULT = (0.5, 2.5)
PINNED_TAGS = ["<b>", "</b>", "<a ", "</a>"]

# --- where to get help -----------------------------------------------------------------------
# (id, url, phone, label key, condition over uninsured / pct / in_collections), priority order
HELP_DOORS = [
    ("medical", "https://benefitscal.com/", None, "res_medical", "uninsured AND pct <= 200"),
    ("coveredca",
     "https://apply.coveredca.com/static/lw-enrollment/anon/locateAssistance/locateAssistanceType",
     "(800) 300-1506", "res_coveredca", "uninsured AND pct > 138"),
    ("clinic", "https://findahealthcenter.hrsa.gov/", None, "res_clinic", "uninsured"),
    ("legalaid", "https://healthconsumer.org/", "(888) 804-3536", "res_legalaid",
     "in_collections"),
]
# state -> (coverage portal, legal aid)
STATE_DOORS = {
    "IL": ("https://abe.illinois.gov/", "https://www.illinoislegalaid.org/"),
    "NY": ("https://nystateofhealth.ny.gov/", "https://www.lawhelpny.org/"),
    "MD": ("https://www.marylandhealthconnection.gov/", "https://www.mdlab.org/"),
    "WA": ("https://www.wahealthplanfinder.org/", "https://nwjustice.org/get-legal-help"),
    "NJ": ("https://www.getcovered.nj.gov/", "https://www.lsnjlaw.org/"),
    "CO": ("https://connectforhealthco.com/", "https://coloradolegalservices.org/"),
    "OR": ("https://one.oregon.gov/", "https://oregonlawhelp.org/"),
    "RI": ("https://healthsourceri.com/", "https://helprilaw.org/"),
    "ME": ("https://www.coverme.gov/", "https://www.ptla.org/"),
    "MA": ("https://www.mahealthconnector.org/", "https://healthlawadvocates.org/"),
    "OH": ("https://www.healthcare.gov/", "https://www.ohiolegalhelp.org/"),
    "VT": ("https://portal.healthconnect.vermont.gov/", "https://vtlawhelp.org/"),
    "NC": ("https://www.healthcare.gov/", "https://legalaidnc.org/"),
}
CLINIC_URL = "https://findahealthcenter.hrsa.gov/"
