from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from larder.functions import answers, numeric, rules
from larder.operators import health


def row(spark, schema, values, **columns):
    return spark.createDataFrame([values], schema).select(*[c.alias(n) for n, c in columns.items()]).first()


NUTRIENTS = "calories int, carbohydrate decimal(8,2), protein decimal(8,2), fat decimal(8,2), sodium decimal(8,2)"


def menu(**v):
    return tuple(None if (x := v.get(k.split()[0])) is None else (x if k.startswith("calories") else Decimal(str(x))) for k in NUTRIENTS.split(", "))


@pytest.mark.parametrize(("name", "values", "want"), [
    ("HIGH_PROTEIN", {"protein": 11}, True), ("HIGH_PROTEIN", {"protein": 10.9}, False), ("LOW_CARB", {"carbohydrate": 20}, True), ("LOW_CARB", {"carbohydrate": 20.1}, False), ("HIGH_CARB", {"carbohydrate": 40}, True),
    ("HIGH_CARB", {"carbohydrate": 39.9}, False), ("LOW_SODIUM", {"sodium": 120}, True), ("LOW_FAT", {"fat": 3}, True), ("LOW_FAT", {"fat": 3.1}, False), ("REFLUX_SAFE", {"fat": 5, "sodium": 400}, True),
    ("REFLUX_SAFE", {"fat": 5}, False), ("HIGH_PROTEIN", {}, False),
])
def test_nutrition_filters(spark, name, values, want):
    assert row(spark, NUTRIENTS, menu(**values), ok=rules.nutrition_filter(name)).ok is want


@pytest.mark.parametrize(("target", "got", "rate"), [
    ((37.5, 22.5, 6.67), (37.5, 22.5, 6.67), 100.0), ((10.0, 0.0, 0.0), (0.0, 0.0, 10.0), 0.0), ((None, 1.0, 1.0), (1.0, 1.0, 1.0), None), ((1.0, 1.0, 1.0), (None, None, None), None), ((1.0, 1.0, 1.0), (0.0, 0.0, 0.0), None),
])
def test_match_rate(spark, target, got, rate):
    names = "abcdef"
    cols = [F.col(c) for c in names]
    assert row(spark, ", ".join(f"{c} double" for c in names), (*target, *got), r=numeric.match_rate(tuple(cols[:3]), tuple(cols[3:]))).r == rate


@pytest.mark.parametrize(("bmr", "count", "intensity", "goal", "calories"), [
    (1500.0, "NONE", "MEDIUM", "MAINTAIN", 1800), (2000.0, "THREE_TO_FOUR", "MEDIUM", "LOSS", 2600), (1600.0, "ONE_TO_TWO", "MEDIUM", "GAIN", 2500), (1000.0, "NONE", "MEDIUM", "LOSS", 1200), (1500.0, None, "HIGH", "MAINTAIN", 1800),
    (1500.0, "ONE_TO_TWO", None, "MAINTAIN", 2063),
])
def test_targets(spark, bmr, count, intensity, goal, calories):
    rows = spark.createDataFrame([(bmr, count, intensity, goal)], "bmr double, exercise_count string, exercise_intensity string, goal string")
    got = health.targets(rows).first()
    assert got.calories == calories
    if calories == 1800:
        assert (got.carbohydrate, got.protein, got.fat) == (Decimal("225.00"), Decimal("135.00"), Decimal("40.00"))


CARDS = {
    (): [("PROTEIN", []), ("CALORIE", []), ("CARBOHYDRATE", [])],
    ("DIABETES", "HYPERTENSION"): [("PROTEIN", []), ("CARBOHYDRATE_SUGAR", ["DIABETES"]), ("SODIUM", ["HYPERTENSION"])],
    ("HYPERLIPIDEMIA", "GASTROESOPHAGEAL_REFLUX"): [("PROTEIN", []), ("FAT", ["HYPERLIPIDEMIA", "GASTROESOPHAGEAL_REFLUX"]), ("DIETARY_FIBER", ["HYPERLIPIDEMIA"])],
    ("DIABETES", "HYPERLIPIDEMIA"): [("PROTEIN", []), ("CARBOHYDRATE_SUGAR", ["DIABETES"]), ("FAT", ["HYPERLIPIDEMIA"])],
}


def test_deficiency_cards(spark):
    members = spark.createDataFrame([(i, list(d)) for i, d in enumerate(CARDS)], "member_id long, diseases array<string>")
    got = {i: [] for i in range(len(CARDS))}
    for r in sorted(health.deficiency_cards(members).collect(), key=lambda r: (r.member_id, r.priority)):
        got[r.member_id].append((r.issue, r.related))
    assert list(got.values()) == list(CARDS.values())
    texts = {r.member_id: r for r in health.summaries(health.deficiency_cards(members)).collect()}
    assert texts[0].summary == "단백질, 칼로리, 탄수화물에 신경 쓰며 균형 잡힌 식단을 유지해보세요." and texts[0].descriptions[0] == "단백질 관리를 권장합니다."


def test_warnings_in_fixed_order_and_never_for_calories(spark):
    issues = rules.issue_union(F.array(*[F.lit(d) for d in ("DIABETES", "HYPERTENSION", "HYPERLIPIDEMIA", "GASTROESOPHAGEAL_REFLUX")]))
    got = row(spark, NUTRIENTS, menu(calories=900, carbohydrate=41, fat=16, sodium=601), w=rules.warnings(issues), none=rules.warnings(rules.issue_union(F.lit(None).cast("array<string>")))).asDict()
    assert got == {"w": ["나트륨 함량이 높은 메뉴예요", "지방 함량이 높은 메뉴예요", "탄수화물 함량이 높은 메뉴예요"], "none": []}
    assert row(spark, NUTRIENTS, menu(carbohydrate=40, fat=15, sodium=600), w=rules.warnings(issues)).w == []


def test_distances(spark):
    got = row(spark, "lat double, lng double", (37.579132, 126.923488), main=numeric.gate_distance(F.col("lat"), F.col("lng"), "MAIN_GATE"), back=numeric.gate_distance(F.col("lat"), F.col("lng"), "BACK_GATE"))
    assert got.main == 0 and abs(got.back - 195) <= 5
    none = row(spark, "lat double, lng double", (None, 126.9), main=numeric.gate_distance(F.col("lat"), F.col("lng"), "MAIN_GATE"))
    assert none.main is None
    walk = lambda m: row(spark, "m int", (m,), w=numeric.walk_minutes(F.col("m"))).w
    assert [walk(m) for m in (150, 300, 340, 90, 0, None)] == [2, 4, 5, 1, 1, None]
    at = lambda ref: row(spark, "a int, b int", (150, 300), d=numeric.pick_distance(F.col("a"), F.col("b"), ref)).d
    assert [at(None), at("MAIN_GATE"), at("BACK_GATE")] == [150, 150, 300]


def test_lenient_numbers(spark):
    got = [row(spark, "t string", (t,), i=numeric.to_int(F.col("t")), d=numeric.to_decimal(F.col("t"))) for t in ("2.5", " 3.5 ", "", "x", None)]
    assert [r.i for r in got] == [2, 4, None, None, None] and got[0].d == Decimal("2.50") and got[3].d is None


@pytest.mark.parametrize(("answer", "want"), [("3", (True, 3)), ("3번", (True, 3)), ("없음", (True, None)), ("0", (True, None)), ("None", (True, None)), ("9", (False, None)), ("", (False, None)), ("글쎄", (False, None)), (None, (False, None))])
def test_parse_choice(spark, answer, want):
    assert tuple(row(spark, "a string", (answer,), p=answers.parse_choice(F.col("a"), F.lit(5))).p) == want


def test_answer_lines(spark):
    lines = lambda raw: (got := row(spark, "r string", (raw,), a=answers.answer_lines(F.col("r"))).a) and [tuple(x) for x in got]
    assert lines("1: 3\n2: 없음") == [(1, "3"), (2, "없음")]
    assert lines("<think>1: 9\n2: 9</think>\n1) 7") == [(1, "7")]
    assert lines("<think>1: 9") is None
    assert not lines("hm")


def test_reply_extraction(spark):
    reply = 'x {"summary" : "a \\"b\\"\\nc", "cardDescriptions": ["d", "e\\\\f"]} y'
    got = row(spark, "r string", (reply,), s=answers.json_text(F.col("r"), "summary"), c=answers.json_texts(F.col("r"), "cardDescriptions"), n=answers.json_text(F.col("r"), "none"))
    assert (got.s, got.c, got.n) == ('a "b"\nc', ["d", "e\\f"], None)
