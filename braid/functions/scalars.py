"""Derived columns of both domains. All built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from braid.functions.binding import let
from braid.operators.rules import lookup, ordered_rules, regex_rules

# ---------------------------------------------------------------- registry

UNKNOWN = "UNKNOWN"
NOT_APPLICABLE = "NOT_APPLICABLE"


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def phase(phases: Column) -> Column:
    """Normalised phase of an array of phase codes.

    No codes: UNKNOWN. Only NA: NOT_APPLICABLE. Otherwise PHASE followed by the
    distinct sorted suffixes of the codes that start with PHASE; if none does, the
    codes joined by a vertical bar (EARLY_PHASE1 stays as it is).
    """
    numbered = F.filter(phases, lambda p: p.startswith("PHASE"))
    suffixes = F.array_sort(F.array_distinct(F.transform(numbered, lambda p: F.replace(p, F.lit("PHASE"), F.lit("")))))
    return (
        F.when(phases.isNull() | (F.size(phases) == 0), F.lit(UNKNOWN))
        .when((F.size(phases) == 1) & (phases[0] == "NA"), F.lit(NOT_APPLICABLE))
        .when(F.size(numbered) > 0, F.concat(F.lit("PHASE"), F.array_join(suffixes, "/")))
        .otherwise(F.array_join(phases, "|"))
    )


def phase_raw(phases: Column) -> Column:
    return F.coalesce(F.array_join(phases, "|"), F.lit(""))


# Part of a year that one unit of age stands for (fixed values).
AGE_UNITS = {"year": 1.0, "month": 1 / 12, "week": 1 / 52, "day": 1 / 365}
_AGE = r"(?i)^\s*(\d+(?:\.\d+)?)\s*(year|month|week|day)"


def age_years(text: Column) -> Column:
    number = F.regexp_extract(text, _AGE, 1).try_cast("double")
    unit = lookup(F.lower(F.regexp_extract(text, _AGE, 2)), AGE_UNITS)
    return F.round(number * unit, 3)


def sponsor_type(cls: Column) -> Column:
    return ordered_rules(
        [
            (cls == "INDUSTRY", "Industry"),
            (cls.isin("NIH", "FED", "OTHER_GOV"), "Government"),
            (cls == "NETWORK", "Network"),
        ],
        "Academic / other",
    )


def phase_is_stated(p: Column) -> Column:
    return F.coalesce(p != UNKNOWN, F.lit(True))


def phase_is_numbered(p: Column) -> Column:
    """Stricter reading: the registry names a phase number."""
    return F.coalesce(p.startswith("PHASE"), F.lit(False))


def status_group(status: Column) -> Column:
    return ordered_rules(
        [
            (status.isin("RECRUITING", "NOT_YET_RECRUITING", "ENROLLING_BY_INVITATION", "AVAILABLE"), "Open"),
            (status == "ACTIVE_NOT_RECRUITING", "Ongoing, closed to entry"),
            (status == "COMPLETED", "Completed"),
            (status.isin("TERMINATED", "SUSPENDED", "WITHDRAWN"), "Stopped"),
        ],
        "Other",
    )


def start_year(date: Column) -> Column:
    return F.substring(date, 1, 4).try_cast("int")


# Region of each country, by the display names of the registry (fixed values).
REGION_COUNTRIES = {
    "North America": ["United States", "Canada", "Puerto Rico", "Guam"],
    "Asia-Pacific": [
        "China", "Japan", "South Korea", "North Korea", "Taiwan", "India", "Hong Kong", "Singapore", "Thailand",
        "Malaysia", "Vietnam", "Indonesia", "Philippines", "Australia", "New Zealand", "Pakistan", "Bangladesh",
        "Nepal", "Mongolia", "Kazakhstan",
    ],
    "Europe": [
        "United Kingdom", "France", "Germany", "Italy", "Spain", "Netherlands", "Belgium", "Sweden", "Denmark",
        "Norway", "Finland", "Ireland", "Austria", "Switzerland", "Poland", "Czechia", "Hungary", "Portugal",
        "Greece", "Romania", "Bulgaria", "Slovakia", "Croatia", "Slovenia", "Estonia", "Latvia", "Lithuania",
        "Luxembourg", "Malta", "Cyprus", "Iceland", "Monaco", "Serbia", "Bosnia and Herzegovina",
        "North Macedonia", "Montenegro", "Albania", "Russia", "Ukraine", "Belarus", "Moldova", "Georgia",
        "Armenia", "Azerbaijan",
    ],
    "Latin America": [
        "Brazil", "Argentina", "Mexico", "Chile", "Colombia", "Peru", "Costa Rica", "Guatemala", "Panama",
        "Uruguay", "Venezuela", "Ecuador", "El Salvador", "Honduras", "Cuba", "Dominican Republic", "Jamaica",
        "Barbados", "Trinidad and Tobago", "Martinique",
    ],
    "Middle East / North Africa": [
        "Israel", "Turkey (Türkiye)", "Saudi Arabia", "Egypt", "United Arab Emirates", "Lebanon", "Jordan", "Iran",
        "Iraq", "Qatar", "Oman", "Bahrain", "Syria", "Morocco", "Tunisia", "Algeria", "Palestinian Territories",
    ],
    "Sub-Saharan Africa": [
        "South Africa", "Nigeria", "Kenya", "Uganda", "Rwanda", "Botswana", "Ethiopia", "Ghana", "Malawi", "Niger",
    ],
}
UNMAPPED = "Other / unmapped"


def region(country: Column) -> Column:
    return ordered_rules([(country.isin(*names), name) for name, names in REGION_COUNTRIES.items()], UNMAPPED)


# Endpoint classes in order of precedence, matched on the upper-cased measure (fixed values).
ENDPOINT_RULES = [
    (r"OVERALL SURVIVAL|\bOS\b", "Overall survival"),
    (r"PROGRESSION[- ]FREE SURVIVAL|\bPFS\b", "Progression-free survival"),
    (
        r"EVENT[- ]FREE SURVIVAL|DISEASE[- ]FREE SURVIVAL|RECURRENCE[- ]FREE|RELAPSE[- ]FREE|\bDFS\b|\bEFS\b|\bRFS\b",
        "Disease/event-free survival",
    ),
    (r"PATHOLOGIC(AL)? COMPLETE RESPONSE|\bPCR\b", "Pathological complete response"),
    (r"DURATION OF RESPONSE|\bDOR\b", "Duration of response"),
    (r"DISEASE CONTROL|\bDCR\b|\bDC24\b", "Disease control rate"),
    (r"RELAPSE RATE|RECURRENCE RATE|LOCAL CONTROL", "Relapse / local control"),
    (r"DOSE[- ]LIMITING|MAXIMUM TOLERATED|\bDLT\b|\bMTD\b|RECOMMENDED PHASE", "Dose finding (DLT/MTD)"),
    (r"ADVERSE EVENT|TOXICIT|SAFETY|TOLERABILIT", "Safety / tolerability"),
    (r"PHARMACOKINET|\bAUC\b|\bCMAX\b|PLASMA CONCENTRATION|SERUM CONCENTRATION", "Pharmacokinetics"),
    (r"QUALITY OF LIFE|\bQOL\b|PATIENT[- ]REPORTED|EORTC|FACT-|\bPROMIS\b", "Quality of life"),
    (
        r"KNOWLEDGE|DECISION|DISTRESS|ANXIET|DEPRESS|INSOMNIA|SLEEP|FATIGUE|PAIN|SATISFACTION|WORK ABILIT",
        "Patient-reported / behavioural",
    ),
    (
        r"TUMOR VOLUME|TUMOUR VOLUME|IMAGING|\bMRI\b|\bPET\b|ULTRASOUND|PERFUSION|\bSUV\b|RADIOLOG|GRAYSCALE|DETECTION"
        r"|SENSITIVIT|SPECIFICIT",
        "Imaging / detection",
    ),
    (
        r"SURGIC|SURGERY|RESECTION|MARGIN|COMPLICATION|INFECTION|RECONSTRUCTION|CAPSULAR|LYMPHEDEMA",
        "Surgical / procedural",
    ),
    (
        r"PLASMA|SERUM|BIOMARKER|EXPRESSION|CIRCULATING|\bCTDNA\b|\bCRP\b|INTERLEUKIN|\bIL-[0-9]|TNF|CELL COUNT"
        r"|\bPD-L1\b",
        "Biomarker / laboratory",
    ),
    (r"FEASIBILIT|ACCRUAL|COMPLIANCE|ADHERENCE|UPTAKE|UTILIZATION|UTILISATION", "Feasibility / uptake"),
    (r"OBJECTIVE RESPONSE|RESPONSE RATE|TUMOR RESPONSE|TUMOUR RESPONSE|\bORR\b|RESPONSE", "Objective response rate"),
]
UNCLASSIFIED = "Other / unclassified"


def endpoint_category(measure: Column) -> Column:
    return let(F.upper(measure), lambda upper: regex_rules(upper, ENDPOINT_RULES, UNCLASSIFIED))


def sponsor_group(name: Column) -> Column:
    """Roll a sponsor up to its company: named exceptions first, then the text after SUBSIDIARY OF."""
    upper = F.upper(name)
    marker = F.lit("SUBSIDIARY OF ")
    at = F.instr(upper, marker)
    return (
        F.when(upper.contains("MERCK KGAA"), F.lit("Merck KGaA (Darmstadt)"))
        .when(upper.contains("MERCK SHARP") | upper.contains("MERCK & CO"), F.lit("Merck & Co."))
        .when(upper.contains("SUBSIDIARY OF PFIZER"), F.lit("Pfizer"))
        .when(at > 0, F.trim(F.substring(name, at + F.length(marker), F.length(name))))
        .otherwise(name)
    )


def screening_burden(criteria: Column) -> Column:
    """Band of the number of criteria; no criteria at all is the lightest band."""
    return ordered_rules(
        [(criteria >= 40, "4 · Very high"), (criteria >= 25, "3 · High"), (criteria >= 14, "2 · Moderate")], "1 · Light"
    )


def footprint(regions: Column) -> Column:
    return F.when(regions > 1, F.lit("Multi-region")).otherwise(F.lit("Single region"))


def cap_at(value: Column, limit: Column) -> Column:
    """LEAST with a null value staying null."""
    return F.when(value.isNotNull(), F.least(value, limit))


def per_share(value: Column, parts: Column) -> Column:
    return F.round(value / F.nullif(parts, F.lit(0)), 1)


# ---------------------------------------------------------------- payments

REVIEW_FROM, BLOCK_FROM = 0.30, 0.70


def decision(score: Column) -> Column:
    return ordered_rules([(score >= BLOCK_FROM, "BLOCK"), (score >= REVIEW_FROM, "REVIEW")], "APPROVE")


def analyst_outcome(label: Column) -> Column:
    return F.when(label, F.lit("CONFIRMED FRAUD")).when(~label, F.lit("CLEARED"))


def label_from_alert(status: Column) -> Column:
    return F.when(status == "CONFIRMED_FRAUD", F.lit(True)).when(status == "FALSE_POSITIVE", F.lit(False))


def is_night(ts: Column) -> Column:
    return (F.hour(ts) >= 22) | (F.hour(ts) < 6)


def is_weekend(ts: Column) -> Column:
    return F.dayofweek(ts).isin(1, 7)


# Base risk of each merchant category code (fixed values).
MCC_RISK = {
    "5812": 0.05, "5411": 0.05, "5541": 0.08, "5045": 0.20, "5999": 0.20, "5816": 0.30,
    "4511": 0.15, "7011": 0.15, "4829": 0.60, "6051": 0.65, "5933": 0.70, "7995": 0.75,
}


def mcc_risk(mcc: Column) -> Column:
    return lookup(mcc, MCC_RISK, 0.0)
