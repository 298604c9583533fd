"""Queries on members' history, targets, cards and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from larder.enums import DISEASE_ISSUES, DISEASE_PRIORITY, FALLBACK_ISSUES, ISSUE_LABELS
from larder.functions.rules import disease_rank
from larder.operators import health, scans, upsert
from larder.plans.catalog import query
from larder.plans.views import Views

DAY = lambda c="measured_at": F.col(c).cast("string").alias("measured_at")
_LATEST = "last AS (SELECT * FROM inbody QUALIFY row_number() OVER (PARTITION BY member_id ORDER BY measured_at DESC, id DESC) = 1)"
_DAYS = "days AS (SELECT * FROM inbody QUALIFY row_number() OVER (PARTITION BY member_id, measured_at ORDER BY id DESC) = 1), ranked AS (SELECT *, row_number() OVER (PARTITION BY member_id ORDER BY measured_at DESC) AS nth FROM days)"


@query("agg_keep_latest", f"WITH {_DAYS} SELECT id, member_id, CAST(measured_at AS STRING) AS measured_at FROM days")
def agg_keep_latest(v: Views) -> DataFrame:
    return health.keep_latest(v.inbody).select("id", "member_id", DAY())


@query("win_latest", f"WITH {_LATEST} SELECT member_id, id, CAST(measured_at AS STRING) AS measured_at, bmr FROM last")
def win_latest(v: Views) -> DataFrame:
    return health.latest(v.inbody).select("member_id", "id", DAY(), "bmr")


@query("win_history", "SELECT member_id, id, CAST(row_number() OVER (PARTITION BY member_id ORDER BY measured_at DESC, id DESC) AS INT) AS nth, measured_at + 14 < DATE '1998-01-10' AS stale FROM inbody")
def win_history(v: Views) -> DataFrame:
    return health.history(v.inbody, F.lit("1998-01-10").cast("date")).select("member_id", "id", "nth", "stale")


@query("win_trend", f"WITH {_DAYS} SELECT member_id, CAST(measured_at AS STRING) AS measured_at, inbody_score, CAST(row_number() OVER (PARTITION BY member_id ORDER BY measured_at) AS INT) AS place FROM ranked WHERE nth <= 4")
def win_trend(v: Views) -> DataFrame:
    return health.trend(v.inbody).select("member_id", DAY(), "inbody_score", "place")


@query("win_trend_expanded", f"WITH {_DAYS} SELECT member_id, CAST(measured_at AS STRING) AS measured_at, inbody_score, CAST(row_number() OVER (PARTITION BY member_id ORDER BY measured_at) AS INT) AS place FROM ranked WHERE nth <= 12")
def win_trend_expanded(v: Views) -> DataFrame:
    return health.trend(v.inbody, expanded=True).select("member_id", DAY(), "inbody_score", "place")


@query("win_analysis_history", f"WITH {_DAYS} SELECT member_id, CAST(measured_at AS STRING) AS measured_at, CAST(protein_target AS DOUBLE) AS protein_target, CAST(nth AS INT) AS nth FROM ranked WHERE nth <= 4")
def win_analysis_history(v: Views) -> DataFrame:
    return health.recent(v.inbody).select("member_id", DAY(), F.col("protein_target").cast("double"), "nth")


_KCAL = """greatest(CAST(floor(bmr * (CASE exercise_count WHEN 'ONE_TO_TWO' THEN 1.375e0 WHEN 'THREE_TO_FOUR' THEN 1.55e0 WHEN 'FIVE_TO_SIX' THEN 1.725e0 ELSE 1.2e0 END
    * CASE WHEN coalesce(exercise_count, 'NONE') = 'NONE' THEN 1e0 WHEN exercise_intensity = 'LOW' THEN 0.95e0 WHEN exercise_intensity = 'HIGH' THEN 1.05e0 ELSE 1e0 END) + 0.5) AS INT)
    + CASE goal WHEN 'LOSS' THEN -500 WHEN 'MAINTAIN' THEN 0 ELSE 300 END, 1200)"""
_TARGET = f"{_LATEST}, kcal AS (SELECT m.id, last.id AS source_inbody_id, CAST({_KCAL} AS INT) AS calories FROM member m JOIN last ON last.member_id = m.id)"


@query("fn_target_calories", f"WITH {_TARGET} SELECT id, source_inbody_id, calories FROM kcal")
def fn_target_calories(v: Views) -> DataFrame:
    return health.member_targets(v.member, v.inbody).select("id", "source_inbody_id", "calories")


#: Half up on the double's shortest decimal form.
_HALF_UP = "CAST(round(CAST(CAST({} AS STRING) AS DECIMAL(26,18)), 2) AS DOUBLE)"
_GRAMS = ", ".join(f"{_HALF_UP.format(x)} AS {n}" for n, x in (("carbohydrate", "calories * 0.5e0 / 4"), ("protein", "calories * 0.3e0 / 4"), ("fat", "calories * 0.2e0 / 9")))


@query("fn_macro_split", f"WITH {_TARGET} SELECT id, {_GRAMS} FROM kcal")
def fn_macro_split(v: Views) -> DataFrame:
    return health.member_targets(v.member, v.inbody).select("id", *[F.col(c).cast("double").alias(c) for c in ("carbohydrate", "protein", "fat")])


@query("fn_per_meal", f"WITH {_TARGET}, g AS (SELECT id, calories, CAST(round(calories * 0.5e0 / 4, 2) AS DECIMAL(18,6)) AS carbohydrate FROM kcal) SELECT id, calories // 3 AS calories, CAST(round(CAST(carbohydrate AS DOUBLE) / 3, 2) AS DOUBLE) AS carbohydrate FROM g")
def fn_per_meal(v: Views) -> DataFrame:
    return health.per_meal_targets(health.member_targets(v.member, v.inbody)).select("id", "calories", F.col("carbohydrate").cast("double").alias("carbohydrate"))


def old_targets(v: Views) -> DataFrame:
    """Targets, those of every third member from an earlier measurement, and some of members without any."""
    own = health.member_targets(v.member, v.inbody)
    moved = own.withColumn("source_inbody_id", F.when(F.col("id") % 3 == 0, F.col("source_inbody_id") - 1).otherwise(F.col("source_inbody_id")))
    lost = v.member.join(own.select("id"), "id", "left_anti").select("id", F.lit(-1).cast("long").alias("source_inbody_id"))
    return moved.select("id", "source_inbody_id").unionByName(lost)


@query("prj_outdated", f"WITH {_LATEST} SELECT m.id, coalesce(last.id IS NOT NULL AND m.id % 3 = 0, false) AS outdated FROM member m LEFT JOIN last ON last.member_id = m.id")
def prj_outdated(v: Views) -> DataFrame:
    return health.outdated(old_targets(v), v.inbody).select("id", "outdated")


@query("prj_has_target", f"WITH {_LATEST} SELECT m.id, last.id IS NOT NULL AS has_target FROM member m LEFT JOIN last ON last.member_id = m.id")
def prj_has_target(v: Views) -> DataFrame:
    own = health.member_targets(v.member, v.inbody).select("id", F.lit(True).alias("t"))
    return v.member.select("id").join(own, "id", "left").select("id", F.col("t").isNotNull().alias("has_target"))


@query("snk_target", f"WITH {_TARGET} SELECT m.id, kcal.calories FROM member m LEFT JOIN kcal ON kcal.id = m.id")
def snk_target(v: Views) -> DataFrame:
    old = v.member.select("id", F.lit(None).cast("int").alias("calories"))
    return upsert.upsert(old, health.member_targets(v.member, v.inbody).select("id", "calories"), ["id"], ["calories"])


_ISSUES = ", ".join(f"('{d}', '{i}', {rank}, {DISEASE_PRIORITY.index(d)})" for d, issues in DISEASE_ISSUES.items() for rank, i in enumerate(issues))
_CARDS = f"""
    WITH known AS (SELECT * FROM (VALUES {_ISSUES}) t(disease, issue, rank, weight)), asked AS (SELECT member_id, issue, rank, weight, disease FROM member_disease JOIN known USING (disease)),
    own AS (SELECT member_id, issue, min(rank * 10 + weight) AS place, string_agg(disease, ',' ORDER BY rank, weight) AS related FROM asked GROUP BY 1, 2),
    fall AS (SELECT m.id AS member_id, f.issue, 100 + f.i AS place, '' AS related FROM member m, (VALUES {', '.join(f"('{x}', {i})" for i, x in enumerate(FALLBACK_ISSUES))}) f(issue, i)
             WHERE NOT EXISTS (SELECT 1 FROM own WHERE own.member_id = m.id AND own.issue = f.issue)),
    allc AS (SELECT * FROM own UNION ALL SELECT * FROM fall),
    cards AS (SELECT id AS member_id, 1 AS priority, 'PROTEIN' AS issue, '' AS related FROM member
              UNION ALL SELECT member_id, CAST(1 + row_number() OVER (PARTITION BY member_id ORDER BY place) AS INT) AS priority, issue, related FROM allc QUALIFY priority <= 3)
"""


def cards(v: Views) -> DataFrame:
    return health.deficiency_cards(v.members.select(F.col("id").alias("member_id"), "diseases"))


@query("fn_deficiency_cards", _CARDS + "SELECT member_id, priority, issue, related FROM cards")
def fn_deficiency_cards(v: Views) -> DataFrame:
    return cards(v).select("member_id", "priority", "issue", F.array_join("related", ",").alias("related"))


@query("win_deficiency_topk", _CARDS + "SELECT member_id, count(*) AS cards, string_agg(issue, ',' ORDER BY priority) AS issues FROM cards GROUP BY member_id")
def win_deficiency_topk(v: Views) -> DataFrame:
    listed = cards(v).groupBy("member_id").agg(F.count("*").alias("cards"), F.array_sort(F.collect_list(F.struct("priority", "issue"))).alias("i"))
    return listed.select("member_id", "cards", F.array_join(F.transform("i", lambda c: c["issue"]), ",").alias("issues"))


@query("set_fallback_not_in", _CARDS + f"SELECT member_id, issue FROM cards WHERE related = '' AND issue IN ({', '.join(repr(x) for x in FALLBACK_ISSUES)})")
def set_fallback_not_in(v: Views) -> DataFrame:
    return cards(v).filter((F.size("related") == 0) & F.col("issue").isin(*FALLBACK_ISSUES)).select("member_id", "issue")


_LABEL = "CASE issue " + " ".join(f"WHEN '{k}' THEN '{x}'" for k, x in ISSUE_LABELS.items()) + " END"


@query("report_member", f"{_CARDS}, {_TARGET} SELECT c.member_id, any_value(inbody_score) AS inbody_score, any_value(calories) AS calories, concat(string_agg({_LABEL}, ', ' ORDER BY priority), '에 신경 쓰며 균형 잡힌 식단을 유지해보세요.') AS summary FROM cards c JOIN last ON last.member_id = c.member_id JOIN kcal ON kcal.id = c.member_id GROUP BY c.member_id")
def report_member(v: Views) -> DataFrame:
    return health.report(v.members, v.inbody).select("member_id", "inbody_score", "calories", "summary")


@query("ai_client", f"""
    {_CARDS}, {_TARGET}, w AS (SELECT c.member_id, any_value(inbody_score) AS score, string_agg(issue, ', ' ORDER BY priority) AS issues, string_agg(concat(issue, ' (', replace(related, ',', '/'), ')'), '|' ORDER BY priority) AS texts,
        string_agg({_LABEL}, ', ' ORDER BY priority) AS labels, string_agg(concat({_LABEL}, ' 관리를 권장합니다.'), '|' ORDER BY priority) AS plain FROM cards c LEFT JOIN last ON last.member_id = c.member_id GROUP BY c.member_id)
    SELECT member_id, CASE WHEN coalesce(score % 5, 0) <> 0 THEN 'model' ELSE 'template' END AS "by", CASE WHEN coalesce(score % 5, 0) <> 0 THEN texts ELSE plain END AS descriptions,
        CASE WHEN coalesce(score % 5, 0) <> 0 THEN concat(CAST(score AS STRING), ': ', issues) ELSE concat(labels, '에 신경 쓰며 균형 잡힌 식단을 유지해보세요.') END AS summary FROM w
""")
def ai_client(v: Views) -> DataFrame:
    texts = health.written_summaries(cards(v), health.latest(v.inbody).select("member_id", "inbody_score"), health.FakeWriter())
    return texts.select("member_id", "by", F.array_join("descriptions", "|").alias("descriptions"), "summary")


@query("fn_disease_rank", "SELECT member_id, disease, CASE disease " + " ".join(f"WHEN '{d}' THEN {i}" for i, d in enumerate(DISEASE_PRIORITY)) + " END AS rank FROM member_disease")
def fn_disease_rank(v: Views) -> DataFrame:
    return v.member_disease.select("member_id", "disease", disease_rank(F.col("disease")).cast("int").alias("rank"))


#: What a member's scan shows: (label, its height) and (value, its x, its y); some values are out of range or out of place.
SHEET = (
    ("체중", 1000, "50 + id % 40", "340 + id % 400", 1020), ("골격근량", 1100, "10 + id % 60", "500", 1120), ("체지방률", 1200, "5 + id % 50", "590 + id % 200", 1220),
    ("기초대사량", 1300, "400 + id % 3000", "340", 1305), ("내장지방레벨", 1400, "id % 25", "120", 1450), ("인바디점수", 1500, "id % 130", "250", 1580),
)


def member_scans(v: Views) -> DataFrame:
    def field(text: str, x: str, y: str) -> str:
        corners = ", ".join(f"named_struct('x', cast({x} as double) + {dx}, 'y', cast({y} as double) + {dy})" for dx in (-30, 30) for dy in (-10, 10))
        return f"named_struct('inferText', {text}, 'inferConfidence', 0.9D, 'boundingPoly', named_struct('vertices', array({corners})))"

    fields = [f for label, y, value, x, value_y in SHEET for f in (field(f"'{label}'", "100", str(y)), field(f"concat({value}, '점')", x, str(value_y)))]
    dated = field("'측정일 2024.02.03'", "700", "200")
    return v.member.select("id", F.expr(f"array(named_struct('fields', array({', '.join([*fields, dated])})))").alias("images"))


@query("scan_extract", """
    SELECT id, CASE WHEN NOT 240 + id % 400 BETWEEN 251 AND 599 THEN 'failed(weight)' WHEN 10 + id % 60 > 60 THEN 'failed(muscle_mass)' WHEN NOT 490 + id % 200 BETWEEN 500 AND 650 THEN 'failed(body_fat_percentage)'
        WHEN 400 + id % 3000 < 500 OR 400 + id % 3000 > 3000 THEN 'failed(bmr)' WHEN NOT id % 25 BETWEEN 1 AND 20 THEN 'failed(visceral_fat_level)' WHEN id % 130 > 100 THEN 'failed(inbody_score)' ELSE 'ok' END AS status,
        CASE WHEN 240 + id % 400 BETWEEN 251 AND 599 THEN CAST(50 + id % 40 AS DOUBLE) END AS weight, CAST(CASE WHEN 400 + id % 3000 BETWEEN 500 AND 3000 THEN 400 + id % 3000 END AS INT) AS bmr, '2024-02-03' AS measured_at
    FROM member
""")
def scan_extract(v: Views) -> DataFrame:
    return scans.extract(member_scans(v), "id").select("id", "status", F.col("weight").cast("double").alias("weight"), "bmr", DAY())


@query("jn_ocr_weight", "SELECT id, CAST(50 + id % 40 AS DOUBLE) AS value FROM member WHERE 240 + id % 400 BETWEEN 251 AND 599")
def jn_ocr_weight(v: Views) -> DataFrame:
    return scans.weight(scans.flatten_fields(member_scans(v), "id"), "id").select("id", F.col("value").cast("double"))
