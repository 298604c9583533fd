"""Decisions on a row: nutrition filters, match reasons, warnings, deficiency issues."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from larder.enums import DISEASE_ISSUES, DISEASE_PRIORITY, ISSUE_LABELS, MATCH_REASONS, NUTRITION_FILTERS, RELIABLE_CONFIDENCE, STALE_DAYS, WARNINGS
from larder.functions.text import contains_all


def nutrition_filter(name: str, column=F.col) -> Column:
    """Whether a row's values meet the filter; null values do not. ``column`` finds a nutrient's column by name."""
    tests = [column(n) >= F.lit(v) if op == ">=" else column(n) <= F.lit(v) for n, op, v in NUTRITION_FILTERS[name]]
    return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False))


def reliable(source: Column, confidence: Column, least: float) -> Column:
    return F.when(source == "OFFICIAL", True).otherwise(F.coalesce(confidence >= least, F.lit(False)))


def stale(measured_at: Column, today: Column) -> Column:
    return F.date_add(measured_at, STALE_DAYS) < today


def age(birth: Column, today: Column) -> Column:
    return F.floor(F.months_between(today, birth) / 12).cast("int")


def match_reason(normalized: Column, name: Column, restaurant: Column, representative: Column, confidence: Column, tokens: Column) -> Column:
    """Rank of the reason (position in MATCH_REASONS): the first field that holds all tokens."""
    tag = MATCH_REASONS.index("FOOD_TYPE_TAG")
    sure = F.coalesce(confidence >= RELIABLE_CONFIDENCE, F.lit(False))
    return (
        F.when(F.size(tokens) == 0, tag)
        .when(contains_all(normalized, tokens) | contains_all(name, tokens), MATCH_REASONS.index("MENU_NAME"))
        .when(contains_all(restaurant, tokens), MATCH_REASONS.index("RESTAURANT_NAME"))
        .when(sure & contains_all(representative, tokens), MATCH_REASONS.index("REPRESENTATIVE_FOOD"))
        .otherwise(tag)
    )


def issue_union(diseases: Column) -> Column:
    """The sorted distinct issues of an array of diseases."""
    table = F.create_map(*[x for d, issues in DISEASE_ISSUES.items() for x in (F.lit(d), F.array(*map(F.lit, issues)))])
    none = F.array().cast("array<string>")
    found = F.transform(F.coalesce(diseases, none), lambda d: F.coalesce(F.element_at(table, d), none))
    return F.array_sort(F.array_distinct(F.flatten(found)))


def warnings(issues: Column, column=F.col) -> Column:
    """Messages for the issues whose nutrient is above its limit, in fixed order."""
    tests = [(F.arrays_overlap(issues, F.array(*map(F.lit, asked))) & (column(nutrient) > limit), text) for asked, nutrient, limit, text in WARNINGS]
    return F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(text)) for t, text in tests]))


def issue_label(issue: Column) -> Column:
    return F.element_at(F.create_map(*[x for k, v in ISSUE_LABELS.items() for x in (F.lit(k), F.lit(v))]), issue)


def fallback_summary(labels: Column) -> Column:
    return F.concat(F.array_join(labels, ", "), F.lit("에 신경 쓰며 균형 잡힌 식단을 유지해보세요."))


def disease_rank(disease: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, DISEASE_PRIORITY)), disease) - 1
