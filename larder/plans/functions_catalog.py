"""Queries on scalar and rule functions."""

from __future__ import annotations

from string import ascii_lowercase

from pyspark.sql import DataFrame, functions as F

from larder.enums import CATEGORY_HINTS, DISEASE_ISSUES, ISSUE_LABELS, METHOD_CONFIDENCE, NUTRITION_FILTERS
from larder.functions import answers, numeric, rules, text
from larder.operators import aliasing, scans
from larder.plans.catalog import query
from larder.plans.views import BRANDS, Views

KEYWORDS = [("plate", "RICE"), ("ring", "NOODLE"), ("rod", "MEAT"), ("bolt", "SOUP"), ("gear", "SNACK"), ("hot", "SOUP"), ("hot plate", "-"), ("hot ring", "FRIED"), ("red ring", "PIZZA")]
CATEGORY_MAP = {"ECONOMY": ["RICE"], "LARGE": ["MEAT", "SOUP"], "PROMO": ["DESSERT"]}
_LIST = lambda values: ", ".join(f"'{x}'" for x in values)


def names(v: Views) -> DataFrame:
    return v.menu.select("name", "normalized_name").distinct()


@query("fn_nfc", "SELECT doc_id, md5(nfc_normalize(text || ' e' || chr(769))) AS digest FROM documents")
def fn_nfc(v: Views) -> DataFrame:
    rows = v.documents.select("doc_id", F.concat("text", F.lit(" é")).alias("text"))
    return rows.select("doc_id", F.md5(text.nfc(F.col("text"))).alias("digest"))


@query("fn_normalize_menu_name", "SELECT DISTINCT name, normalized_name FROM menu")
def fn_normalize_menu_name(v: Views) -> DataFrame:
    return v.menu.select("name").distinct().select("name", text.normalize_menu_name(F.col("name")).alias("normalized_name"))


@query("fn_is_notice", "SELECT page_id, regexp_matches(url || (CASE WHEN page_id % 3 = 0 THEN '주세요. ' ELSE '합니' END), '(합니다|주세요)\\.?\\s*$') AS notice FROM pages")
def fn_is_notice(v: Views) -> DataFrame:
    ending = F.when(F.col("page_id") % 3 == 0, "주세요. ").otherwise("합니")
    return v.pages.select("page_id", text.is_notice(F.concat("url", ending)).alias("notice"))


@query("fn_is_set_course", "SELECT DISTINCT normalized_name, normalized_name LIKE '% 특선' AS is_set FROM menu")
def fn_is_set_course(v: Views) -> DataFrame:
    return names(v).select("normalized_name", text.is_set_or_course(F.col("normalized_name")).alias("is_set")).distinct()


@query("fn_is_beverage", "SELECT DISTINCT name, name LIKE '%(355ml)%' AS beverage FROM menu")
def fn_is_beverage(v: Views) -> DataFrame:
    return v.menu.select("name").distinct().select("name", text.is_beverage(F.col("name")).alias("beverage"))


@query("fn_normalize_term", "SELECT page_id, lower(regexp_replace(html, '\\s+', '', 'g')) AS term FROM pages")
def fn_normalize_term(v: Views) -> DataFrame:
    return v.pages.select("page_id", text.normalize_term(F.col("html")).alias("term"))


_GRAMS = "list_distinct(list_transform(range(1, length(replace({0}, ' ', ''))), lambda i : substr(replace({0}, ' ', ''), i, 2)))"


@query("fn_bigrams", f"SELECT normalized_name, CAST(len({_GRAMS.format('normalized_name')}) AS INT) AS n, array_to_string(list_sort({_GRAMS.format('normalized_name')}), '|') AS grams FROM (SELECT DISTINCT normalized_name FROM menu)")
def fn_bigrams(v: Views) -> DataFrame:
    grams = text.bigrams(F.col("normalized_name"))
    return v.menu.select("normalized_name").distinct().select("normalized_name", F.size(grams).alias("n"), F.array_join(F.array_sort(grams), "|").alias("grams"))


@query("set_jaccard", f"""
    WITH g AS (SELECT food_code, {_GRAMS.format('food_name')} AS a, {_GRAMS.format('representative_name')} AS b FROM official_food), i AS (SELECT *, len(list_intersect(a, b)) AS n FROM g)
    SELECT food_code, round(n / (len(a) + len(b) - n), 6) AS jaccard FROM i
""")
def set_jaccard(v: Views) -> DataFrame:
    score = text.jaccard(text.bigrams(F.col("food_name")), text.bigrams(F.col("representative_name")))
    return v.official_food.select("food_code", F.round(score, 6).alias("jaccard"))


@query("set_strict_subset", """
    SELECT DISTINCT name, len(list_filter(string_split('hot ring', ' '), lambda t : NOT list_contains(string_split(name, ' '), t))) = 0 AND len(list_distinct(string_split(name, ' '))) > 2 AS inside FROM menu
""")
def set_strict_subset(v: Views) -> DataFrame:
    return v.menu.select("name").distinct().select("name", text.strict_subset(F.array(F.lit("hot"), F.lit("ring")), text.tokens(F.col("name"))).alias("inside"))


@query("fn_candidate_keys", """
    SELECT food_code, 0 AS ordinal, normalized_name AS key, true AS allow_contain FROM official_food
    UNION ALL SELECT food_code, 1, concat(split_part(normalized_name, '_', 2), split_part(normalized_name, '_', 1)), true FROM official_food WHERE normalized_name LIKE '%\\_%' ESCAPE '\\'
    UNION ALL SELECT food_code, 2, split_part(normalized_name, '_', 2), contains(split_part(normalized_name, '_', 2), split_part(normalized_name, '_', 1)) FROM official_food WHERE normalized_name LIKE '%\\_%' ESCAPE '\\'
""")
def fn_candidate_keys(v: Views) -> DataFrame:
    keys = v.official_food.select("food_code", F.explode(text.candidate_keys(F.col("normalized_name"))).alias("k"))
    return keys.select("food_code", "k.ordinal", "k.key", "k.allow_contain")


_RANK = "CASE WHEN origin LIKE '%외식%' AND origin LIKE '%분석%' THEN 0 WHEN origin LIKE '%외식%' THEN 1 WHEN origin LIKE '%분석%' THEN 2 ELSE 3 END"


@query("fn_origin_rank", f"SELECT food_code, {_RANK} AS origin_rank FROM official_food")
def fn_origin_rank(v: Views) -> DataFrame:
    return v.official_food.select("food_code", text.origin_rank(F.col("origin")).alias("origin_rank"))


@query("fn_basis_key", f"SELECT normalized_name, arg_min(food_code, struct_pack(b := CASE serving_basis WHEN '100g' THEN 0 ELSE 1 END, o := {_RANK}, c := food_code)) AS food_code FROM official_food GROUP BY 1")
def fn_basis_key(v: Views) -> DataFrame:
    order = text.basis_key(F.col("serving_basis"), F.col("origin"), F.col("food_code"))
    return v.official_food.groupBy("normalized_name").agg(F.min_by("food_code", order).alias("food_code"))


@query("fn_contains_brand", f"SELECT id, len(list_filter([{_LIST(BRANDS)}], lambda b : contains(lower(name), b))) > 0 AS has_brand FROM restaurant")
def fn_contains_brand(v: Views) -> DataFrame:
    return v.restaurant.select("id", text.has_term(F.lower("name"), BRANDS).alias("has_brand"))


@query("fn_guess_brand", "SELECT id, CASE WHEN name LIKE '%점' THEN regexp_replace(name, '\\s+\\S+$', '') ELSE '' END AS brand_guess FROM restaurant")
def fn_guess_brand(v: Views) -> DataFrame:
    return v.restaurant.select("id", text.guess_brand(F.col("name")).alias("brand_guess"))


def _keyword_sql(pairs: list[tuple[str, str]]) -> str:
    hits = "list_filter([" + ", ".join(f"{{'k': '{k}', 't': '{t}'}}" for k, t in pairs) + "], lambda e : contains(normalized_name, e.k))"
    return f"""
    WITH h AS (SELECT DISTINCT normalized_name, {hits} AS hits FROM menu)
    SELECT normalized_name, array_to_string(list_sort(list_distinct(list_transform(list_filter(hits, lambda a : a.t <> '-' AND len(list_filter(hits, lambda o : o.k <> a.k AND contains(o.k, a.k))) = 0), lambda a : a.t))), ',') AS tags FROM h
"""


KEYWORD_SQL = _keyword_sql(KEYWORDS)
#: Beside the keywords every pair of letters, so that the automaton finds them.
MANY_KEYWORDS = KEYWORDS + [(a + b, f"PAIR{(ord(a) + ord(b)) % 11}") for a in ascii_lowercase for b in ascii_lowercase]


@query("fn_keyword_tags", KEYWORD_SQL)
def fn_keyword_tags(v: Views) -> DataFrame:
    rows = v.menu.select("normalized_name").distinct()
    return rows.select("normalized_name", F.array_join(text.keyword_tags(F.col("normalized_name"), KEYWORDS), ",").alias("tags"))


@query("fn_keyword_tags_many", _keyword_sql(MANY_KEYWORDS))
def fn_keyword_tags_many(v: Views) -> DataFrame:
    rows = v.menu.select("normalized_name").distinct()
    return rows.select("normalized_name", F.array_join(text.keyword_tags(F.col("normalized_name"), MANY_KEYWORDS), ",").alias("tags"))


@query("fn_category_tags", "SELECT food_code, CASE major_category WHEN 'ECONOMY' THEN 'RICE' WHEN 'LARGE' THEN 'MEAT,SOUP' WHEN 'PROMO' THEN 'DESSERT' ELSE '' END AS tags FROM official_food")
def fn_category_tags(v: Views) -> DataFrame:
    return v.official_food.select("food_code", F.array_join(text.category_tags(F.col("major_category"), CATEGORY_MAP), ",").alias("tags"))


@query("fn_suggest_type", "WITH c AS (SELECT p_partkey, concat(p_type, CASE p_partkey % 4 WHEN 0 THEN ' 밥류' WHEN 1 THEN ' 국 및 탕류' WHEN 2 THEN ' 면 및 만두류' ELSE '' END) AS c FROM part) SELECT p_partkey, CASE " + " ".join(f"WHEN contains(c, '{h}') THEN '{t}'" for h, t in CATEGORY_HINTS) + " ELSE '' END AS suggested FROM c")
def fn_suggest_type(v: Views) -> DataFrame:
    k = F.col("p_partkey") % 4
    category = F.concat("p_type", F.when(k == 0, " 밥류").when(k == 1, " 국 및 탕류").when(k == 2, " 면 및 만두류").otherwise(""))
    return v.part.select("p_partkey", text.suggest_type(category).alias("suggested"))


_PRICE_TEXT = "CASE p_partkey % 5 WHEN 0 THEN '가격문의' WHEN 1 THEN concat('₩', CAST(p_partkey AS STRING), ',000원~9,000원') WHEN 2 THEN '0원' WHEN 3 THEN concat(CAST(p_partkey AS STRING), ' 원') END"


@query("fn_parse_price", f"WITH t AS (SELECT p_partkey, {_PRICE_TEXT} AS price FROM part) SELECT p_partkey, CAST(nullif(nullif(replace(regexp_extract(price, '[\\d,]+'), ',', ''), ''), '0') AS INT) AS price FROM t")
def fn_parse_price(v: Views) -> DataFrame:
    return v.part.select("p_partkey", text.parse_price(F.expr(_PRICE_TEXT)).alias("price"))


@query("fn_parse_menu_block", "SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN p_name END AS name, CASE WHEN p_partkey % 7 <> 0 THEN CAST(p_partkey % 90 + 1 AS INT) * 100 END AS price FROM part")
def fn_parse_menu_block(v: Views) -> DataFrame:
    name = F.when(F.col("p_partkey") % 7 == 0, "  \n").otherwise(F.concat(F.lit("\n "), "p_name", F.lit("\t")))
    price = F.concat(((F.col("p_partkey") % 90 + 1) * 100).cast("string"), F.lit("원"))
    return v.part.select("p_partkey", text.menu_block(name, price).alias("m")).select("p_partkey", "m.name", "m.price")


@query("fn_parse_menu_row", "SELECT p_partkey, CASE WHEN p_partkey % 5 = 4 THEN concat(p_name, ' 2인분 세트') ELSE concat('런치 ', p_name) END AS name, CASE WHEN p_partkey % 5 < 3 THEN 12000 END AS price FROM part")
def fn_parse_menu_row(v: Views) -> DataFrame:
    k = F.col("p_partkey") % 5
    row = F.when(k == 4, F.concat(F.lit(" \n"), "p_name", F.lit("\n2인분 세트"))).when(k == 3, F.concat(F.lit("런치\n"), "p_name", F.lit("\n시가"))).otherwise(F.concat(F.lit("런치\r\n  "), "p_name", F.lit("\n\n₩12,000 원 ")))
    return v.part.select("p_partkey", text.menu_row(row).alias("m")).select("p_partkey", "m.name", "m.price")


@query("fn_place_id", "SELECT id, CAST(id AS STRING) AS place_id FROM restaurant")
def fn_place_id(v: Views) -> DataFrame:
    return v.restaurant.select("id", text.place_id(F.concat("source_url", F.lit("/home?x=1"))).alias("place_id"))


@query("fn_coords_url", "SELECT id, latitude AS lat, longitude AS lng FROM restaurant")
def fn_coords_url(v: Views) -> DataFrame:
    url = F.when(F.col("latitude").isNotNull(), F.concat("source_url", F.lit("?a=1&c="), F.col("longitude").cast("string"), F.lit(","), F.col("latitude").cast("string"), F.lit(",15z"))).otherwise(F.col("source_url"))
    return v.restaurant.select("id", text.coords_of_url(url).alias("c")).select("id", "c.lat", "c.lng")


@query("fn_contains_all_tokens", "SELECT DISTINCT name, contains(lower(replace(name, ' ', '')), 'ri') AND contains(lower(replace(name, ' ', '')), 'hot') AS found FROM menu")
def fn_contains_all_tokens(v: Views) -> DataFrame:
    return v.menu.select("name").distinct().select("name", text.contains_all(F.col("name"), F.array(F.lit("ri"), F.lit("hot"))).alias("found"))


@query("lim_tokens", "SELECT page_id, array_to_string(list_slice(list_filter(regexp_split_to_array(lower(trim(html)), '\\s+'), lambda t : t <> ''), 1, 5), '|') AS tokens FROM pages")
def lim_tokens(v: Views) -> DataFrame:
    return v.pages.select("page_id", F.array_join(text.keyword_tokens(F.col("html"), 5), "|").alias("tokens"))


@query("fn_ocr_normalize", "SELECT doc, pos, replace(text, ' ', '') AS text FROM ocr_field")
def fn_ocr_normalize(v: Views) -> DataFrame:
    return v.ocr_field.select("doc", "pos", text.ocr_text(F.col("text")).alias("text"))


@query("fn_leading_number", "SELECT doc, pos, TRY_CAST(nullif(regexp_extract(replace(text, ' ', ''), '^\\d+(\\.\\d+)?'), '') AS DOUBLE) AS number FROM ocr_field")
def fn_leading_number(v: Views) -> DataFrame:
    return v.ocr_field.select("doc", "pos", text.leading_number(F.col("text")).cast("double").alias("number"))


@query("fn_ocr_date", "SELECT event_id, CAST(CASE WHEN event_id % 3 < 2 THEN CAST(ts AS DATE) END AS STRING) AS day FROM events")
def fn_ocr_date(v: Views) -> DataFrame:
    k = F.col("event_id") % 3
    shown = F.when(k == 0, F.date_format("ts", "yyyy.MM.dd")).when(k == 1, F.concat(F.lit("측정 "), F.date_format("ts", "yyyy/MM/dd"), F.lit(" 10:00"))).otherwise("2024.13.45")
    return v.events.select("event_id", text.ocr_date(shown).cast("string").alias("day"))


@query("fn_label_format", "SELECT food_code, concat(food_name, ' [', concat_ws(' · ', origin, major_category), ']') AS label FROM official_food")
def fn_label_format(v: Views) -> DataFrame:
    return v.official_food.select("food_code", text.food_label(F.col("food_name"), F.col("origin"), F.col("major_category")).alias("label"))


@query("fn_parse_choice", """
    SELECT row_no, raw_choice IS NOT NULL AND NOT coalesce(try_cast(raw_choice AS INT) > 2, false) AS ok, CASE WHEN try_cast(raw_choice AS INT) BETWEEN 1 AND 2 THEN CAST(raw_choice AS INT) END AS choice FROM label_row
""")
def fn_parse_choice(v: Views) -> DataFrame:
    shown = F.when(F.col("raw_choice").rlike(r"^\d"), F.concat(F.lit("후보 "), "raw_choice", F.lit("번"))).otherwise(F.col("raw_choice"))
    return v.label_row.select("row_no", answers.parse_choice(shown, F.lit(2)).alias("p")).select("row_no", "p.ok", "p.choice")


@query("fn_answer_lines", "SELECT row_no, 1 AS index, '2' AS answer FROM label_row UNION ALL SELECT row_no, 2, coalesce(raw_choice, '?') FROM label_row")
def fn_answer_lines(v: Views) -> DataFrame:
    raw = F.concat(F.lit("<think>1: 9\n</think>답\n 1: 2 \n설명\n2) "), F.coalesce("raw_choice", F.lit("?")))
    lines = v.label_row.select("row_no", F.explode(answers.answer_lines(raw)).alias("l"))
    return lines.select("row_no", "l.index", "l.answer")


@query("fn_parse_batch", """
    WITH c AS (SELECT row_no, raw_choice IS NOT NULL AND NOT coalesce(try_cast(raw_choice AS INT) > 2, false) AS ok, CASE WHEN try_cast(raw_choice AS INT) BETWEEN 1 AND 2 THEN CAST(raw_choice AS INT) END AS choice FROM label_row)
    SELECT concat(CAST(row_no AS STRING), '-1') AS normalized_name, 'matched' AS decision, 'a2' AS food_code, '2' AS raw_answer FROM c
    UNION ALL SELECT concat(CAST(row_no AS STRING), '-2'), CASE WHEN NOT ok THEN 'failed' WHEN choice IS NULL THEN 'abstained' ELSE 'matched' END, CASE choice WHEN 1 THEN 'b1' WHEN 2 THEN 'b2' END,
        CASE WHEN ok THEN coalesce(CAST(choice AS STRING), '없음') END FROM c
    UNION ALL SELECT concat(CAST(row_no AS STRING), '-3'), 'failed', NULL, NULL FROM c
""")
def fn_parse_batch(v: Views) -> DataFrame:
    """Of three items the first has a line out of range before one that can be read, and the third has none."""
    item = lambda i, *codes: F.struct(F.lit(i).alias("index"), F.concat(F.col("row_no").cast("string"), F.lit(f"-{i}")).alias("normalized_name"), F.array(*map(F.lit, codes)).alias("codes"))
    raw = F.concat(F.lit("<think>1: 1\n</think>\n1: 9\n1: 2\n1: 1\n9: 1\n2) "), F.coalesce("raw_choice", F.lit("?")))
    answered = v.label_row.select(F.col("row_no").cast("string").alias("batch"), raw.alias("raw"), F.array(item(1, "a1", "a2"), item(2, "b1", "b2"), item(3, "c1")).alias("items"))
    return aliasing.decisions(answered)


@query("fn_build_prompt", "SELECT food_code, concat('[메뉴 1]\n메뉴명: ', food_name, '\n식당: ', CASE WHEN partkey % 2 = 0 THEN '(알 수 없음)' ELSE 'r' END, '\n후보:\n  1. a\n  2. b\n') AS prompt FROM official_food")
def fn_build_prompt(v: Views) -> DataFrame:
    place = F.when(F.col("partkey") % 2 == 0, "").otherwise("r")
    return v.official_food.select("food_code", answers.prompt_item(F.lit(1), F.col("food_name"), place, F.array(F.lit("a"), F.lit("b"))).alias("prompt"))


@query("fn_food_code_like", "SELECT row_no, regexp_matches(answer, '^[A-Za-z]\\d+(-\\d+)+$') AS like_code FROM label_row")
def fn_food_code_like(v: Views) -> DataFrame:
    return v.label_row.select("row_no", F.col("answer").rlike(text.FOOD_CODE).alias("like_code"))


CLASS_SQL = """CASE WHEN trim(answer) = '' THEN 'unlabeled' WHEN trim(answer) IN ('제외', 'x', 'X') THEN 'excluded' WHEN try_cast(trim(answer) AS INT) = 0 THEN 'no_match'
    WHEN try_cast(trim(answer) AS INT) BETWEEN 1 AND 10 THEN 'rank' WHEN regexp_matches(trim(answer), '^[A-Za-z]\\d+(-\\d+)+$') THEN 'recall_miss' ELSE 'invalid' END"""


@query("fn_answer_class", f"SELECT row_no, {CLASS_SQL} AS class FROM label_row")
def fn_answer_class(v: Views) -> DataFrame:
    return v.label_row.select("row_no", answers.answer_class(F.col("answer"), 10).alias("class"))


_KM = "2 * 6371000 * atan2(sqrt(a), sqrt(1 - a))"
_HAV = "WITH h AS (SELECT id, pow(sin(radians(latitude - {0}) / 2), 2) + cos(radians({0})) * cos(radians(latitude)) * pow(sin(radians(longitude - {1}) / 2), 2) AS a FROM restaurant)"


@query("fn_haversine", _HAV.format(37.579132, 126.923488) + f" SELECT id, CAST(round_even({_KM}, 0) AS INT) AS metres FROM h")
def fn_haversine(v: Views) -> DataFrame:
    return v.restaurant.select("id", numeric.gate_distance(F.col("latitude"), F.col("longitude"), "MAIN_GATE").alias("metres"))


@query("fn_gate_distances", _HAV.format(37.5807266, 126.9244188) + f" SELECT id, CAST(round_even({_KM}, 0) AS INT) AS metres FROM h")
def fn_gate_distances(v: Views) -> DataFrame:
    return v.restaurant.select("id", numeric.gate_distance(F.col("latitude"), F.col("longitude"), "BACK_GATE").alias("metres"))


@query("fn_pick_distance", "SELECT id, distance_to_back_gate AS metres FROM restaurant")
def fn_pick_distance(v: Views) -> DataFrame:
    return v.restaurant.select("id", numeric.pick_distance(F.col("distance_to_main_gate"), F.col("distance_to_back_gate"), "BACK_GATE").alias("metres"))


@query("fn_walk_minutes", "SELECT id, CAST(greatest(1, floor(distance_to_main_gate / 75.0 + 0.5)) AS INT) AS minutes FROM restaurant WHERE distance_to_main_gate IS NOT NULL UNION ALL SELECT id, NULL FROM restaurant WHERE distance_to_main_gate IS NULL")
def fn_walk_minutes(v: Views) -> DataFrame:
    return v.restaurant.select("id", numeric.walk_minutes(F.col("distance_to_main_gate")).alias("minutes"))


RATE_SQL = """CASE WHEN carbohydrate * 4 + protein * 4 + fat * 9 > 0 THEN round((1 - (abs(0.5e0 - CAST(carbohydrate AS DOUBLE) * 4 / CAST(carbohydrate * 4 + protein * 4 + fat * 9 AS DOUBLE))
    + abs(0.3e0 - CAST(protein AS DOUBLE) * 4 / CAST(carbohydrate * 4 + protein * 4 + fat * 9 AS DOUBLE)) + abs(0.2e0 - CAST(fat AS DOUBLE) * 9 / CAST(carbohydrate * 4 + protein * 4 + fat * 9 AS DOUBLE))) / 2) * 100, 1) END"""


@query("fn_match_rate", f"SELECT food_code, {RATE_SQL} AS rate FROM official_food")
def fn_match_rate(v: Views) -> DataFrame:
    target = (F.lit(45.0), F.lit(27.0), F.lit(8.0))
    return v.official_food.select("food_code", numeric.match_rate(target, (F.col("carbohydrate"), F.col("protein"), F.col("fat"))).alias("rate"))


@query("agg_nutrition_sum", "SELECT food_code, CAST(carbohydrate * 4 + protein * 4 + fat * 9 AS DOUBLE) AS kcal FROM official_food")
def agg_nutrition_sum(v: Views) -> DataFrame:
    return v.official_food.select("food_code", numeric.macro_kcal(F.col("carbohydrate"), F.col("protein"), F.col("fat")).alias("kcal"))


@query("fn_protein_pct", "SELECT food_code, CAST(floor(floor(CAST(protein AS DOUBLE) / 109 * 10000 + 0.5) / 100 + 0.5) AS INT) AS pct FROM official_food")
def fn_protein_pct(v: Views) -> DataFrame:
    return v.official_food.select("food_code", numeric.protein_percent(F.col("protein"), F.lit("109").cast("decimal(8,2)")).alias("pct"))


@query("fn_to_int", "SELECT food_code, CAST(round_even(calories + partkey % 4 * 0.25, 0) AS INT) AS n FROM official_food UNION ALL SELECT concat(food_code, 'x'), NULL FROM official_food")
def fn_to_int(v: Views) -> DataFrame:
    shown = F.concat((F.col("calories") + F.col("partkey") % 4 * 0.25).cast("string"), F.lit(" "))
    rows = v.official_food.select("food_code", numeric.to_int(shown).alias("n"))
    return rows.unionByName(v.official_food.select(F.concat("food_code", F.lit("x")).alias("food_code"), numeric.to_int(F.lit("-")).alias("n")))


@query("fn_to_decimal", "SELECT food_code, CASE WHEN partkey % 3 <> 0 THEN CAST(sodium AS DOUBLE) END AS d FROM official_food")
def fn_to_decimal(v: Views) -> DataFrame:
    shown = F.when(F.col("partkey") % 3 == 0, "tr").otherwise(F.col("sodium").cast("string"))
    return v.official_food.select("food_code", numeric.to_decimal(shown).cast("double").alias("d"))


@query("fn_confidence", "SELECT id, CASE matched_by " + " ".join(f"WHEN '{m}' THEN {c}e0" for m, c in METHOD_CONFIDENCE.items()) + " END AS confidence FROM menu")
def fn_confidence(v: Views) -> DataFrame:
    return v.menu.select("id", numeric.confidence(F.col("matched_by")).cast("double").alias("confidence"))


@query("fn_rate_pct", "SELECT restaurant_id, coalesce(round(count(official_food_code) * 100.0e0 / nullif(count(price), 0), 6), 0) AS pct FROM menu GROUP BY 1")
def fn_rate_pct(v: Views) -> DataFrame:
    return v.menu.groupBy("restaurant_id").agg(F.round(numeric.percent(F.count("official_food_code"), F.count("price")), 6).alias("pct"))


def _filter_query(name: str, tests: tuple) -> None:
    where = " AND ".join(f"{n} {op} {x}" for n, op, x in tests)

    @query(f"flt_nutrition_{name.lower()}", f"SELECT id FROM menu WHERE {where}")
    def flt_nutrition(v: Views) -> DataFrame:
        return v.menu.filter(rules.nutrition_filter(name)).select("id")


for _name, _tests in NUTRITION_FILTERS.items():
    _filter_query(_name, _tests)


@query("prj_reliable", "SELECT id, coalesce(source = 'OFFICIAL' AND id % 2 = 0, false) OR coalesce(confidence >= 0.9, false) AS reliable FROM menu")
def prj_reliable(v: Views) -> DataFrame:
    source = F.when(F.col("id") % 2 == 0, F.col("source")).otherwise("ESTIMATED")
    return v.menu.select("id", rules.reliable(source, F.col("confidence"), 0.9).alias("reliable"))


@query("prj_stale", "SELECT id, measured_at + 14 < DATE '1997-06-15' AS stale FROM inbody")
def prj_stale(v: Views) -> DataFrame:
    return v.inbody.select("id", rules.stale(F.col("measured_at"), F.lit("1997-06-15").cast("date")).alias("stale"))


@query("prj_age", "SELECT id, CAST(2024 - year(birth_date) - 1 AS INT) AS age FROM member")
def prj_age(v: Views) -> DataFrame:
    return v.member.select("id", rules.age(F.col("birth_date"), F.lit("2024-03-14").cast("date")).alias("age"))


@query("fn_date_add", "SELECT id, id % 30 > 14 AS stale FROM inbody")
def fn_date_add(v: Views) -> DataFrame:
    """Every number of days since the measurement, on both sides of the bound."""
    return v.inbody.select("id", rules.stale(F.col("measured_at"), F.date_add("measured_at", (F.col("id") % 30).cast("int"))).alias("stale"))


@query("fn_period_years", "SELECT id, CAST(2024 - year(birth_date) - CASE id % 3 WHEN 0 THEN 1 ELSE 0 END AS INT) AS age FROM member")
def fn_period_years(v: Views) -> DataFrame:
    """The day before a birthday, the day itself, and the day after."""
    return v.member.select("id", rules.age(F.col("birth_date"), F.date_add(F.lit("2024-03-14").cast("date"), (F.col("id") % 3).cast("int"))).alias("age"))


@query("set_issue_union", "WITH i AS (SELECT * FROM (VALUES " + ", ".join(f"('{d}', '{i}')" for d, issues in DISEASE_ISSUES.items() for i in issues) + ") t(disease, issue)) SELECT member_id, string_agg(DISTINCT issue, ',' ORDER BY issue) AS issues FROM member_disease JOIN i USING (disease) GROUP BY 1")
def set_issue_union(v: Views) -> DataFrame:
    return v.members.select(F.col("id").alias("member_id"), F.array_join(rules.issue_union(F.col("diseases")), ",").alias("issues")).filter("issues <> ''")


@query("fn_warnings", """
    SELECT id, concat_ws('|', CASE WHEN sodium > 600 THEN '나트륨 함량이 높은 메뉴예요' END, CASE WHEN fat > 15 THEN '지방 함량이 높은 메뉴예요' END, CASE WHEN carbohydrate > 40 THEN '탄수화물 함량이 높은 메뉴예요' END) AS warnings FROM menu
""")
def fn_warnings(v: Views) -> DataFrame:
    asked = rules.issue_union(F.array(*map(F.lit, ("HYPERTENSION", "DIABETES", "HYPERLIPIDEMIA"))))
    return v.menu.select("id", F.array_join(rules.warnings(asked), "|").alias("warnings"))


@query("fn_fallback_summary", "SELECT r_regionkey, '" + ", ".join([ISSUE_LABELS["PROTEIN"], ISSUE_LABELS["FAT"]]) + "에 신경 쓰며 균형 잡힌 식단을 유지해보세요.' AS summary FROM region")
def fn_fallback_summary(v: Views) -> DataFrame:
    labels = F.array(*[rules.issue_label(F.lit(i)) for i in ("PROTEIN", "FAT")])
    return v.region.select("r_regionkey", rules.fallback_summary(labels).alias("summary"))


@query("fn_json_regex_extract", "SELECT event_id, concat('k\n\"', event_type, '\"') AS summary, concat(event_type, '|b') AS cards FROM events")
def fn_json_regex_extract(v: Views) -> DataFrame:
    reply = F.concat(F.lit('```json {"summary" : "k\\n\\"'), "event_type", F.lit('\\"", "cardDescriptions": ["'), "event_type", F.lit('",\n "b"] } ```'))
    return v.events.select("event_id", answers.json_text(reply, "summary").alias("summary"), F.array_join(answers.json_texts(reply, "cardDescriptions"), "|").alias("cards"))


@query("fn_json_path", "SELECT event_id, event_type AS first_text, concat(event_type, 'x', event_type) AS all_text FROM events")
def fn_json_path(v: Views) -> DataFrame:
    reply = F.concat(F.lit('{"candidates":[{"content":{"parts":[{"text":"'), "event_type", F.lit('"},{"other":1},{"text":"x'), "event_type", F.lit('"}]}}]}'))
    return v.events.select("event_id", answers.model_text(reply).alias("first_text"), answers.model_texts(reply).alias("all_text"))


def nearest_sql(label: str, where: str, order: str) -> str:
    return f"""
    WITH f AS (SELECT *, TRY_CAST(nullif(regexp_extract(replace(text, ' ', ''), '^\\d+(\\.\\d+)?'), '') AS DOUBLE) AS value FROM ocr_field),
    l AS (SELECT doc, arg_min(cx, pos) AS lx, arg_min(cy, pos) AS ly FROM f WHERE replace(text, ' ', '') = '{label}' GROUP BY doc),
    c AS (SELECT f.doc, value, pos, cx - lx AS dx, cy - ly AS dy FROM f JOIN l USING (doc) WHERE value IS NOT NULL)
    SELECT doc, value FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY {order}) AS n FROM c WHERE {where}) WHERE n = 1"""


@query("jn_ocr_nearest", nearest_sql("골격근량", "dx BETWEEN -200 AND 300 AND dy BETWEEN 0 AND 150 AND value BETWEEN 10 AND 60", "abs(dy), abs(dx), pos"))
def jn_ocr_nearest(v: Views) -> DataFrame:
    found = scans.nearest_number(v.ocr_field, "doc", ("골격근량",), (-200, 300), (0, 150), (10, 60))
    return found.select("doc", F.col("value").cast("double"))


@query("fn_match_reason", """
    SELECT m.id, CASE WHEN contains(replace(m.normalized_name, ' ', ''), 'ring') OR contains(lower(replace(m.name, ' ', '')), 'ring') THEN 0 WHEN contains(lower(r.name), 'ring') THEN 1
        WHEN confidence >= 0.85 AND contains(representative_name, 'ring') THEN 2 ELSE 3 END AS reason
    FROM menu m JOIN restaurant r ON r.id = restaurant_id LEFT JOIN official_food f ON f.food_code = m.official_food_code
""")
def fn_match_reason(v: Views) -> DataFrame:
    r = v.restaurant.select(F.col("id").alias("restaurant_id"), F.col("name").alias("place"))
    f = v.official_food.select(F.col("food_code").alias("official_food_code"), "representative_name")
    rows = v.menu.join(r, "restaurant_id").join(f, "official_food_code", "left")
    reason = rules.match_reason(*map(F.col, ("normalized_name", "name", "place", "representative_name", "confidence")), F.array(F.lit("ring")))
    return rows.select("id", reason.alias("reason"))
