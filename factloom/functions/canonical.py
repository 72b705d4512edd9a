"""Canonical forms of entities, attributes, values, units, periods and currencies as Column expressions."""

from __future__ import annotations

import re
from functools import reduce
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import AMOUNT, PERIOD, blank_to_null, first_match, fmt_g, joined, normalize_token, squash, strip, strip_period_tokens, text, to_snake, word_in

# Fixed values that decide results: word lists, ordered lookups and patterns.
TEMPORAL = ["fiscal_year", "fiscalyear", "fiscal year", "fy", "year", "period", "calendar_year", "calendar year", "financial_year", "financial year", "date", "year_ended", "year ended"]
REVENUE_CHILDREN = [
    ("subscription", "subscription_revenue"),
    ("licensing", "licensing_revenue"),
    ("license", "licensing_revenue"),
    ("software", "product_revenue"),
    ("product", "product_revenue"),
    ("products", "product_revenue"),
    ("consulting", "services_revenue"),
    ("services", "services_revenue"),
    ("service", "services_revenue"),
]
CHILD_REVENUE = ["product_revenue", "services_revenue", "subscription_revenue", "licensing_revenue"]
LEVEL_ATTRIBUTES = ["total_revenue", *CHILD_REVENUE, "revenue"]
EMPLOYEE_NAMES = [
    "employees", "employee", "employee count", "employee_count", "headcount", "head count", "staff", "workforce", "workforce strength", "staff strength",
    "number of employees", "no of employees", "total employees", "total headcount", "permanent employees",
]
HEADCOUNT = r"(?U)^(?:total\s+|average\s+|permanent\s+|contract\s+|number\s+of\s+|no\.?\s+of\s+)*(?:employees?|headcount|head\s?count|workforce|staff)(?:\s+(?:count|strength|number))?$"
NO_HEADCOUNT = (
    "salary|salaries|benefit|benefits|compensation|option|options|share|shares|percent|percentage|pct|cost|costs|contribution|expense|expenses|revenue|"
    "payable|insurance|turnover|ratio|margin|rate|amount|value|esic|healthcare|session|training|attrition|wage|wages|remuneration|bonus"
)
DERIVED = "percentage|percent|pct|ratio|margin|cagr|growth|yoy|y o y|increase|decrease|proportion|share of|per share"
CURRENCY_WORDS = ["inr", "usd", "eur", "gbp", "rs", "rupee", "rupees", "dollar", "dollars", "euro", "euros", "pound", "pounds"]
CURRENCY_SIGNS = ["₹", "$", "€", "£"]
CURRENCY_TOKENS = [
    ("₹", "INR"), ("rs.", "INR"), ("rs ", "INR"), ("inr", "INR"), ("rupees", "INR"), ("rupee", "INR"), ("usd", "USD"), ("eur", "EUR"), ("gbp", "GBP"), ("$", "USD"), ("€", "EUR"), ("£", "GBP"),
]
CEO_NAMES = ["ceo", "chief executive", "chief executive officer", "managing director", "md"]
HEDGES = r"(?iuU)\b(approximately|approx|about|around|nearly|roughly|circa|estimated|almost)\b|~"
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
MONTH_NAMES = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
UNITS = [
    ("crores", "crore"), ("crore", "crore"), ("crs", "crore"), ("cr", "crore"), ("lacs", "lakh"), ("lakh", "lakh"), ("lac", "lakh"), ("million", "million"), ("billion", "billion"),
    ("mn", "million"), ("bn", "billion"), ("percent", "%"), ("percentage", "%"), ("pct", "%"),
]
ADDRESS_WORDS = [
    (r"\bst\.?(?=\W|$)", "street"), (r"\brd\.?(?=\W|$)", "road"), (r"\bave\.?(?=\W|$)", "avenue"), (r"\bblvd\.?(?=\W|$)", "boulevard"), (r"\bln\.?(?=\W|$)", "lane"),
    (r"\bapartment\b", "apt"), (r"\bapt\.?(?=\W|$)", "apt"), (r"\bpincode\b", "pin"), (r"\bpin code\b", "pin"), (r"\bzip code\b", "zip"), (r"\bzipcode\b", "zip"),
]
ADDRESS_HINTS = "street|st|road|rd|avenue|ave|boulevard|blvd|lane|ln|pin|zip|apt"
COUNT_WORDS = "shares?|equity shares?|options?|units?|parcels?|customers?|employees?|people|persons?"
SCALE_WORDS = "crore|lakh|million|billion|thousand"
HEADCOUNT_NOISE = r"(?iuU)[%₹$€£]|\b(share|shares|option|options|parcel|parcels|equity|percent|pct|crore|lakh|million|billion|thousand|mn|bn|inr|usd|eur|gbp|rs)\b"
COMPATIBLE = {"ratio": ["ratio"], "count": ["count", "plain"], "money": ["money", "scaled", "plain"], "scaled": ["money", "scaled", "plain"], "plain": ["money", "scaled", "plain", "count"]}
DAY_MONTH_YEAR = r"(?U)\b(\d{1,2})[/-](\d{1,2})[/-](\d{4})\b"
YEAR_MONTH_DAY = r"(?U)\b(\d{4})[-/](\d{1,2})[-/](\d{1,2})\b"
DAY_NAME_YEAR = r"(?U)\b(\d{1,2})\s+([A-Za-z]{3,9}),?\s+(\d{4})\b|\b([A-Za-z]{3,9})\s+(\d{1,2}),?\s+(\d{4})\b"
NAME_YEAR = r"(?U)\b([A-Za-z]{3,9})\s+(\d{4})\b"
PIPED_PERSON = r"(?iu)([A-Za-z][A-Za-z.]+(?:\s+[A-Za-z][A-Za-z.]+)+)\s*\|\s*(?:position|title|role)\s*=\s*(?:ceo|chief executive(?: officer)?)"
LABELED_PERSON = r"(?iu)(?:ceo|chief executive(?: officer)?)\s*[:|-]\s*([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)"


def _grouped(rules: list[tuple[str, str]]) -> list[tuple[str, list[str]]]:
    """Runs of neighbouring rules with one result; order decides, so equal results apart stay apart."""
    return [(name, [token for token, _ in run]) for name, run in groupby(rules, key=lambda rule: rule[1])]


def _any_of(tokens: list[str]) -> str:
    return "|".join(re.sub(r"([.$])", r"\\\1", t) for t in tokens)


# ---------------------------------------------------------------- periods, units, currencies


def canonicalize_period(period: Column, attribute: Column, entity: Column) -> Column:
    """The first fiscal, calendar or assessment year, or quarter, in the three texts; else the period as it is."""
    blob = joined(period, attribute, entity)
    found = F.regexp_extract(blob, PERIOD, 0)
    year, prefix = F.regexp_extract(blob, PERIOD, 2), F.upper(F.regexp_extract(blob, PERIOD, 1))
    return first_match(
        [
            (found == "", strip(period)),
            (F.lower(found).startswith("q"), F.replace(F.upper(found), F.lit(" "), F.lit(""))),
        ],
        F.concat(F.when(prefix == "", F.lit("FY")).otherwise(prefix), year),
    )


def is_currency_token(unit: Column) -> Column:
    raw = strip(unit)
    return (raw != "") & (raw.isin(CURRENCY_SIGNS) | F.regexp_replace(normalize_token(raw), r"\.+$", "").isin(CURRENCY_WORDS))


def currency_code(value: Column, unit: Column) -> Column:
    """Currency by ordered substring search; empty when there is none."""
    low = F.lower(joined(value, unit))
    return first_match([(low.rlike(_any_of(tokens)), F.lit(code)) for code, tokens in _grouped(CURRENCY_TOKENS)], F.lit(""))


def canonicalize_unit(unit: Column, value: Column) -> Column:
    low = F.lower(joined(unit, value))
    words = [(word_in(low, "|".join(tokens)), F.lit(name)) for name, tokens in _grouped(UNITS)]
    return first_match([(F.contains(low, F.lit("%")), F.lit("%")), *words, (is_currency_token(unit), F.lit(""))], strip(unit))


# ---------------------------------------------------------------- values


def _month(name: Column) -> Column:
    numbers = {n: f"{i % 12 + 1:02d}" for i, n in enumerate([*MONTHS, *MONTH_NAMES])}
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in numbers.items() for x in pair]), F.lower(name))


def _two(c: Column) -> Column:
    return F.lpad(c.try_cast("int").cast("string"), 2, "0")


def canonicalize_date(value: Column) -> Column:
    """``YYYY-MM-DD`` or ``YYYY-MM`` of the first date found anywhere in the text, else null."""
    t = strip(value)
    part = lambda pattern, k: F.regexp_extract(t, pattern, k)
    iso = F.when(part(YEAR_MONTH_DAY, 1) != "", F.concat_ws("-", part(YEAR_MONTH_DAY, 1), _two(part(YEAR_MONTH_DAY, 2)), _two(part(YEAR_MONTH_DAY, 3))))
    day_first = part(DAY_NAME_YEAR, 1) != ""
    month = _month(F.when(day_first, part(DAY_NAME_YEAR, 2)).otherwise(part(DAY_NAME_YEAR, 4)))
    year = F.when(day_first, part(DAY_NAME_YEAR, 3)).otherwise(part(DAY_NAME_YEAR, 6))
    day = F.when(day_first, part(DAY_NAME_YEAR, 1)).otherwise(part(DAY_NAME_YEAR, 5))
    named = F.when((F.regexp_extract(t, DAY_NAME_YEAR, 0) != "") & month.isNotNull(), F.concat_ws("-", year, month, _two(day)))
    d, m = part(DAY_MONTH_YEAR, 1).try_cast("int"), part(DAY_MONTH_YEAR, 2).try_cast("int")
    no_amount = ~F.regexp_replace(t, "[, ]", "").rlike(f"^(?:{AMOUNT})$")
    numeric = F.when((part(DAY_MONTH_YEAR, 3) != "") & no_amount & m.between(1, 12) & d.between(1, 31), F.concat_ws("-", part(DAY_MONTH_YEAR, 3), _two(part(DAY_MONTH_YEAR, 2)), _two(part(DAY_MONTH_YEAR, 1))))
    month_only = _month(part(NAME_YEAR, 1))
    monthly = F.when((part(NAME_YEAR, 2) != "") & month_only.isNotNull(), F.concat_ws("-", part(NAME_YEAR, 2), month_only))
    return F.coalesce(iso, named, numeric, monthly)


def canonicalize_money(value: Column, unit: Column, code: Column | None = None) -> Column:
    """``amount [currency] [scale]``, null for values that are no money or scaled amount; ``code``: the currency, where it is known."""
    blob = joined(value, unit)
    amount = F.regexp_extract(F.replace(blob, F.lit(","), F.lit("")), AMOUNT, 0)
    code, scale = F.nullif(currency_code(value, unit) if code is None else code, F.lit("")), F.nullif(canonicalize_unit(unit, value), F.lit(""))
    monetary = code.isNotNull() | scale.isNotNull() | word_in(F.lower(blob), "inr|usd|eur|gbp|rs|rupee|crore|lakh|million|billion")
    return F.when((amount != "") & monetary, F.concat_ws(" ", fmt_g(amount.try_cast("double")), code, scale))


def looks_like_address(value: Column, attribute: Column) -> Column:
    t = normalize_token(value)
    return normalize_token(attribute).rlike("address|location|office|hq|headquarters") | (word_in(t, ADDRESS_HINTS) & t.rlike(r"(?U)\d"))


def canonicalize_address(value: Column) -> Column:
    out = F.lower(squash(F.replace(text(value), F.lit(","), F.lit(" , "))))
    out = reduce(lambda c, rule: F.regexp_replace(c, f"(?U){rule[0]}", rule[1]), ADDRESS_WORDS, out)
    for pattern, into in ((r"(?U)\s+,", ","), (r"(?U),\s*", ", "), (r"(?U)\s+\.", ".")):
        out = F.regexp_replace(out, pattern, into)
    return squash(out)


def canonicalize_value(value: Column, unit: Column, attribute: Column) -> Column:
    t = squash(value)
    return chosen_value(t, F.coalesce(canonicalize_date(t), canonicalize_money(t, unit)), looks_like_address(t, attribute), canonicalize_address(t))


def chosen_value(t: Column, typed: Column, is_address: Column, address: Column) -> Column:
    """The date or amount that a value states, else its address, else its words."""
    return F.when(t == "", F.lit("")).otherwise(F.coalesce(typed, F.when(is_address, address), t))


def value_dimension(value: Column, unit: Column) -> Column:
    blob = joined(value, unit)
    return first_match(
        [
            (F.contains(blob, F.lit("%")), F.lit("ratio")),
            (currency_code(value, unit) != "", F.lit("money")),
            (word_in(blob, COUNT_WORDS), F.lit("count")),
            (word_in(blob, SCALE_WORDS), F.lit("scaled")),
        ],
        F.lit("plain"),
    )


def dimensions_compatible(left: Column, right: Column) -> Column:
    return first_match([(left == d, right.isin(others)) for d, others in COMPATIBLE.items()], left == right)


def normalized_value_key(value: Column, unit: Column) -> Column:
    """``number|unit`` of the first number, without hedges, commas and currency; else the normalised text."""
    plain = F.replace(F.regexp_replace(joined(value, unit), HEDGES, " "), F.lit(","), F.lit(""))
    amount = F.regexp_extract(plain, AMOUNT, 0)
    return F.when(amount != "", F.concat(fmt_g(amount.try_cast("double")), F.lit("|"), canonicalize_unit(unit, value))).otherwise(normalize_token(value))


def numeric_amount(key: Column) -> tuple[Column, Column]:
    """Number and unit of a value key; a key without a number has none."""
    return F.substring_index(key, "|", 1).try_cast("double"), F.when(F.contains(key, F.lit("|")), F.substring_index(key, "|", -1)).otherwise(F.lit(""))


def is_plausible_headcount(value: Column, unit: Column) -> Column:
    blob = joined(value, unit)
    number = F.regexp_extract(F.replace(blob, F.lit(","), F.lit("")), AMOUNT, 0).try_cast("double")
    return F.coalesce(~blob.rlike(HEADCOUNT_NOISE) & number.between(0, 5_000_000) & (number == F.floor(number)), F.lit(False))


# ---------------------------------------------------------------- attributes and entities


def is_temporal(attribute: Column) -> Column:
    t = normalize_token(attribute)
    return t.isin(TEMPORAL) | F.replace(t, F.lit(" "), F.lit("_")).isin(TEMPORAL)


def is_employee_metric(attribute: Column) -> Column:
    t = normalize_token(attribute)
    return (t != "") & ~word_in(t, NO_HEADCOUNT) & (t.isin(EMPLOYEE_NAMES) | t.rlike(HEADCOUNT))


def looks_like_person(value: Column) -> Column:
    t = strip(value)
    parts = F.filter(F.split(t, r"(?U)[\s|,]+"), lambda p: p != "")
    return (t != "") & ~normalize_token(t).isin(CEO_NAMES) & F.size(parts).between(2, 4) & F.forall(parts, lambda p: F.replace(p, F.lit("."), F.lit("")).rlike(r"^\p{L}+$"))


def is_ceo_role(attribute: Column, entity: Column, value: Column) -> Column:
    a, e, v = map(normalize_token, (attribute, entity, value))
    return (
        a.isin(CEO_NAMES)
        | e.isin(CEO_NAMES)
        | (a.isin("position", "title", "role", "designation") & v.isin(CEO_NAMES))
        | (v.isin(CEO_NAMES) & looks_like_person(entity))
        | normalize_token(joined(attribute, entity, value)).rlike(r"(?U)\bposition\s*=\s*(ceo|chief executive)\b")
    )


def extract_person(entity: Column, attribute: Column, value: Column) -> Column:
    left = strip(F.substring_index(strip(entity), "|", 1))
    blob = joined(entity, attribute, value)
    piped, labeled = F.regexp_extract(blob, PIPED_PERSON, 1), F.regexp_extract(blob, LABELED_PERSON, 1)
    return first_match(
        [
            (F.contains(text(entity), F.lit("|")) & looks_like_person(left), left),
            (looks_like_person(entity), strip(entity)),
            (looks_like_person(value), strip(value)),
            (piped != "", strip(piped)),
            (labeled != "", strip(labeled)),
        ],
        strip(F.coalesce(blank_to_null(value), entity)),
    )


def revenue_of(t: Column) -> Column:
    """Revenue category of a normalised text without periods, else null."""
    revenue = word_in(t, "revenues?|turnover|sales")
    cases = []
    for category, prefixes in _grouped(REVENUE_CHILDREN):
        alone = [p for p in prefixes if p in ("software", "consulting")]
        other = [p for p in prefixes if p not in alone]
        hit = word_in(t, "|".join(other)) & revenue
        cases.append(((word_in(t, "|".join(alone)) | hit) if alone else hit, F.lit(category)))
    return F.when(~word_in(t, DERIVED), first_match([*cases, (revenue, F.lit("total_revenue"))], F.lit(None).cast("string")))


def with_attribute(facts: DataFrame, raw_attribute: str, entity: str, value: str, out: str) -> DataFrame:
    """Adds the inferred metric name as column ``out``; steps are columns of their own to keep expressions small."""
    raw, ent = F.col("_raw"), F.col("_ent")
    f = facts.withColumns({"_raw": normalize_token(F.col(raw_attribute)), "_ent": normalize_token(F.col(entity))})
    f = f.withColumns(
        {
            "_rev": revenue_of(normalize_token(strip_period_tokens(joined(raw, ent)))),
            "_rev_ent": F.coalesce(revenue_of(normalize_token(strip_period_tokens(ent))), revenue_of(normalize_token(strip_period_tokens(joined(raw, ent, ent))))),
            "_plain": squash(F.regexp_replace(strip(strip_period_tokens(raw)), r"(?U)\b(total|overall|consolidated|combined|net|group)\b", " ")),
            "_role": is_ceo_role(raw, ent, F.col(value)),
        }
    )
    f = f.withColumn("_context", F.coalesce("_rev_ent", F.when((ent != "") & ~is_temporal(ent), to_snake(strip_period_tokens(ent))), F.lit("value")))
    plain = F.when((F.col("_plain") == "") | is_temporal(F.col("_plain")), F.col("_context")).otherwise(to_snake(F.col("_plain")))
    return f.withColumn(
        out,
        first_match([(is_temporal(raw), F.col("_context")), (F.col("_role"), F.lit("holder")), (is_employee_metric(raw), F.lit("employee_count"))], F.coalesce(F.col("_rev"), plain)),
    ).drop("_raw", "_ent", "_rev", "_rev_ent", "_plain", "_role", "_context")


def canonicalize_entity(entity: Column, attribute: Column, raw_attribute: Column) -> Column:
    e, revenue = strip(entity), attribute.endswith("_revenue")
    return first_match(
        [
            (attribute == "holder", F.lit("CEO")),
            (attribute == "employee_count", F.lit("Employees")),
            ((e != "") & ~is_temporal(e), F.when(revenue & word_in(e, "revenues?"), F.lit("Revenue")).otherwise(e)),
            (revenue, F.lit("Revenue")),
        ],
        F.coalesce(blank_to_null(e), blank_to_null(strip(strip_period_tokens(normalize_token(raw_attribute)))), F.lit("Entity")),
    )


def conflicts(attribute: Column, headcount: Column, ratio: Column) -> Column:
    """Does the value contradict the metric: no headcount, or a ratio for a revenue level?"""
    return ((attribute == "employee_count") & ~headcount) | (attribute.isin(LEVEL_ATTRIBUTES) & ratio)


def canonicalize(facts: DataFrame) -> DataFrame:
    """Facts (entity, attribute, value, unit, period and any other columns) with original_*, raw_attribute and canonical_*.

    Inputs are read from original_* where those exist, so a second run gives the same result. Columns are
    computed in steps, each one projection, that Catalyst may collapse.
    """
    for c in ("entity", "attribute", "value", "period"):
        if f"original_{c}" not in facts.columns:
            facts = facts.withColumn(f"original_{c}", F.col(c).cast("string"))
    f = facts.withColumns(
        {
            "raw_attribute": strip(F.coalesce(blank_to_null(F.col("original_attribute")), F.col("attribute"))),
            "value": squash(F.coalesce(blank_to_null(F.col("original_value")), F.col("value"))),
            "entity": text(F.col("original_entity")),
        }
    )
    f = f.withColumns(
        {
            "period": blank_to_null(canonicalize_period(F.coalesce(blank_to_null(F.col("original_period")), F.col("period")), F.col("raw_attribute"), F.col("entity"))),
            "unit": blank_to_null(canonicalize_unit(F.col("unit"), F.col("value"))),
            "_ceo": is_ceo_role(F.col("raw_attribute"), F.col("entity"), F.col("value")),
        }
    )
    person = extract_person(F.col("entity"), F.col("raw_attribute"), F.col("value"))
    f = f.withColumn("value", F.when(F.col("_ceo") & (person != ""), person).otherwise(F.col("value")))
    f = with_attribute(f, "raw_attribute", "entity", "value", "_attr")
    f = f.withColumns({"_t": squash(F.col("value")), "_code": currency_code(F.col("value"), F.col("unit")), "_fallback": to_snake(strip_period_tokens(F.col("raw_attribute")))})
    t, unit = F.col("_t"), F.col("unit")
    f = f.withColumns({"_typed": F.coalesce(canonicalize_date(t), canonicalize_money(t, unit, F.col("_code"))), "_address": canonicalize_address(t)})
    value_for = lambda attribute: chosen_value(t, F.col("_typed"), looks_like_address(t, F.col(attribute)), F.col("_address"))
    f = f.withColumn("_value", value_for("_attr"))
    f = f.withColumns({"_head": is_plausible_headcount(F.col("_value"), unit), "_ratio": value_dimension(F.col("_value"), unit) == "ratio"})
    wrong = lambda attribute: conflicts(F.col(attribute), F.col("_head"), F.col("_ratio"))
    fallback = F.when(F.col("_fallback").isin(TEMPORAL) | wrong("_fallback"), F.lit("value")).otherwise(F.col("_fallback"))
    f = f.withColumn("canonical_attribute", F.when(wrong("_attr"), fallback).otherwise(F.col("_attr")))
    f = f.withColumn("canonical_value", F.when(F.col("canonical_attribute") == F.col("_attr"), F.col("_value")).otherwise(value_for("canonical_attribute")))
    f = f.withColumn("canonical_entity", canonicalize_entity(F.col("entity"), F.col("canonical_attribute"), F.col("raw_attribute")))
    return f.withColumns(
        {
            "currency": blank_to_null(F.col("_code")),
            "attribute": F.col("canonical_attribute"),
            "entity": F.coalesce(blank_to_null(F.col("entity")), F.col("canonical_entity")),
        }
    ).drop("_ceo", "_attr", "_value", "_fallback", "_t", "_code", "_typed", "_address", "_head", "_ratio")


