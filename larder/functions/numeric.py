"""Numeric functions as Column expressions. Rounding follows each rule's own: half up, half even or floor(x + 1/2)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from larder.enums import (
    CARBOHYDRATE_SHARE,
    EARTH_RADIUS_M,
    EXERCISE_FACTOR,
    FAT_SHARE,
    GATES,
    GOAL_CALORIES,
    INTENSITY_FACTOR,
    LEAST_CALORIES,
    METHOD_CONFIDENCE,
    PROTEIN_SHARE,
    WALK_METRES_A_MINUTE,
)


def choose(value: Column, table: dict, other=None) -> Column:
    first, *rest = table.items()
    return reduce(lambda c, kv: c.when(value == kv[0], F.lit(kv[1])), rest, F.when(value == first[0], F.lit(first[1]))).otherwise(F.lit(other))


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle metres, rounded half to even."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return F.bround(2 * EARTH_RADIUS_M * F.atan2(F.sqrt(a), F.sqrt(1 - a)), 0).cast("int")


def gate_distance(lat: Column, lng: Column, gate: str) -> Column:
    at = GATES[gate]
    return haversine(F.lit(at[0]), F.lit(at[1]), lat, lng)


def pick_distance(main: Column, back: Column, reference: str | None) -> Column:
    return back if reference == "BACK_GATE" else main


def walk_minutes(metres: Column) -> Column:
    return F.when(metres.isNotNull(), F.greatest(F.lit(1), F.floor(metres / WALK_METRES_A_MINUTE + 0.5).cast("int")))


def macro_kcal(carbohydrate: Column, protein: Column, fat: Column) -> Column:
    return carbohydrate.cast("double") * CARBOHYDRATE_SHARE[1] + protein.cast("double") * PROTEIN_SHARE[1] + fat.cast("double") * FAT_SHARE[1]


def match_rate(target: tuple[Column, Column, Column], menu: tuple[Column, Column, Column]) -> Column:
    """100 less the distance of two shares of calories by carbohydrate, protein and fat; null where a share is undefined."""
    weights = (CARBOHYDRATE_SHARE[1], PROTEIN_SHARE[1], FAT_SHARE[1])
    totals = [F.when(macro_kcal(*side) > 0, macro_kcal(*side)) for side in (target, menu)]
    shares = [[v.cast("double") * w / t for v, w in zip(side, weights)] for side, t in zip((target, menu), totals)]
    apart = reduce(lambda a, b: a + b, [F.abs(a - b) for a, b in zip(*shares)]) / 2
    return F.round((1 - apart) * 100, 1)


def protein_percent(protein: Column, daily: Column) -> Column:
    share = F.round(protein.cast("decimal(18,6)") / daily.cast("decimal(18,6)"), 4)
    return F.when(daily > 0, F.round(share * 100, 0).cast("int"))


def target_calories(bmr: Column, count: Column, intensity: Column, goal: Column) -> Column:
    base = choose(count, EXERCISE_FACTOR, EXERCISE_FACTOR["NONE"])
    idle = count.isNull() | (count == "NONE")
    factor = F.when(idle, base).otherwise(base * choose(intensity, INTENSITY_FACTOR, 1.0))
    return F.greatest(F.floor(bmr * factor + 0.5).cast("int") + choose(goal, GOAL_CALORIES), F.lit(LEAST_CALORIES))


def macro_grams(calories: Column, share: tuple[float, int]) -> Column:
    return F.round(calories * F.lit(share[0]) / share[1], 2).cast("decimal(8,2)")


def per_meal_int(value: Column) -> Column:
    return F.floor(value / 3).cast("int")


def per_meal(value: Column) -> Column:
    return F.round(value.cast("decimal(18,6)") / 3, 2).cast("decimal(8,2)")


def to_int(text: Column) -> Column:
    """A number's text rounded half to even; null where it is none."""
    return F.bround(F.trim(text).try_cast("double"), 0).cast("int")


def to_decimal(text: Column) -> Column:
    return F.trim(text).try_cast("decimal(8,2)")


def confidence(method: Column) -> Column:
    return choose(method, METHOD_CONFIDENCE).cast("decimal(4,3)")


def percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0)) * 100
