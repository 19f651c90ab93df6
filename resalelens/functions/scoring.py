"""Score of a listing against its comparable sales."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from resalelens import settings as S
from resalelens.functions.text import contains_any, has_word


def condition_risk(card_text: Column, description: Column) -> Column:
    text = F.concat_ws(" ", F.coalesce(card_text, F.lit("")), F.coalesce(description, F.lit("")))
    return contains_any(text, S.RISK_PHRASES)


def resale_estimate(median: Column, avg: Column, at_risk: Column) -> Column:
    """Median (average if there is none), discounted for a condition risk."""
    base = F.coalesce(F.nullif(median, F.lit(0.0)), avg)
    return base * F.when(at_risk, S.CONDITION_DISCOUNT).otherwise(1.0)


def profit_ratio(resale: Column, price: Column) -> Column:
    return F.when(price > 0, F.try_divide(resale, price)).otherwise(0.0)


def confidence(n: Column) -> Column:
    return (
        F.when(n >= S.HIGH_COMPS, "HIGH")
        .when(n >= S.MED_COMPS, "MED")
        .otherwise("LOW")
    )


def recommend(ratio: Column, conf: Column) -> Column:
    return (
        F.when((ratio >= S.BUY_RATIO) & (conf != "LOW"), "BUY")
        .when(ratio >= S.MIN_RATIO, "WATCH")
        .otherwise("SKIP")
    )


def risk_flags(at_risk: Column) -> Column:
    return F.array_compact(F.array(F.when(at_risk, S.RISK_LABEL)))


def source_label(source: Column) -> Column:
    return F.when(source == S.PRIMARY_SOURCE, S.PRIMARY_LABEL).otherwise(S.SECONDARY_LABEL)


# Units of weight and how many pounds they are.
WEIGHT_UNITS = ((r"(?:lbs?|pounds?)\b", 1.0), (r"tons?\b", 2000.0), (r"(?:kgs?|kilos?|kilograms?)\b", 2.2046226218))


def weight_lb(text: Column) -> Column:
    """Largest weight named in a text, in pounds; NULL if none."""
    number = r"(\d[\d,]*(?:\.\d+)?)\s*"

    def largest(unit: str, pounds: float) -> Column:
        digits = F.regexp_extract_all(F.lower(text), F.lit(number + unit), F.lit(1))
        return F.array_max(F.transform(digits, lambda d: F.replace(d, F.lit(","), F.lit("")).try_cast("double") * pounds))

    return F.greatest(*(largest(unit, pounds) for unit, pounds in WEIGHT_UNITS))


def excluded_kind(text: Column) -> Column:
    """Vehicles, trailers, real estate and anything heavier than the limit."""
    heavy = F.coalesce(weight_lb(text) > S.MAX_WEIGHT_LB, F.lit(False))
    return has_word(text, S.EXCLUDED_WORDS) | heavy
