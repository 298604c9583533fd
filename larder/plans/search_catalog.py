"""Queries on joins, filters, search, cards and paging."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from larder.operators import evaluation, search, tagging
from larder.operators.ordered import Ordered
from larder.operators.trigrams import Trigrams
from larder.plans.catalog import query
from larder.plans.functions_catalog import CATEGORY_MAP, KEYWORD_SQL, KEYWORDS, RATE_SQL
from larder.plans.views import Views

COND = search.Condition(keyword="hot ring", derived_type="SOUP")
MEMBER = search.Member(carbohydrate=135.0, protein=81.0, fat=24.0, diseases=("HYPERTENSION", "DIABETES"))
_HIT = """(contains(replace(normalized_name, ' ', ''), 'hot') AND contains(replace(normalized_name, ' ', ''), 'ring'))
    OR (contains(lower(replace(m.name, ' ', '')), 'hot') AND contains(lower(replace(m.name, ' ', '')), 'ring'))
    OR (contains(lower(replace(r.name, ' ', '')), 'hot') AND contains(lower(replace(r.name, ' ', '')), 'ring'))"""
_BASE = "FROM menu m JOIN restaurant r ON r.id = m.restaurant_id"


def recommended(v: Views, cond: search.Condition | None = None, member: search.Member | None = None) -> DataFrame:
    return search.recommend(v.menu, v.restaurant, v.official_food, v.menu_food_type, cond, member)


@query("flt_max_price", "SELECT id, price FROM menu WHERE price <= 9000")
def flt_max_price(v: Views) -> DataFrame:
    return v.menu.filter(F.col("price") <= 9000).select("id", "price")


@query("flt_optional", f"SELECT m.id, r.name AS restaurant_name {_BASE} WHERE cuisine = 'KOREAN'")
def flt_optional(v: Views) -> DataFrame:
    return search.search_menus(v.menu, v.restaurant, v.menu_food_type, cuisine="KOREAN").select("id", "restaurant_name")


@query("flt_token_all", f"SELECT m.id {_BASE} WHERE cuisine <> 'CAFE_DESSERT' AND ({_HIT} OR m.id IN (SELECT menu_id FROM menu_food_type WHERE food_type = 'SOUP'))")
def flt_token_all(v: Views) -> DataFrame:
    return search.find_for_recommendation(v.menu, v.restaurant, v.official_food, v.menu_food_type, COND).select("id")


@query("flt_member_of", "SELECT id, name FROM menu WHERE id IN (SELECT menu_id FROM menu_food_type WHERE food_type = 'NOODLE')")
def flt_member_of(v: Views) -> DataFrame:
    return v.menu.join(search.has_tag(v.menu_food_type, "NOODLE"), "id", "left_semi").select("id", "name")


@query("flt_exclude_cafe", f"SELECT m.id {_BASE} WHERE cuisine <> 'CAFE_DESSERT'")
def flt_exclude_cafe(v: Views) -> DataFrame:
    return search.find_for_recommendation(v.menu, v.restaurant, v.official_food, v.menu_food_type, search.Condition()).select("id")


@query("flt_has_nutrition", f"SELECT m.id, calories {_BASE} WHERE calories IS NOT NULL AND cuisine = 'KOREAN' AND m.id IN (SELECT menu_id FROM menu_food_type WHERE food_type = 'RICE') ORDER BY m.id LIMIT 50")
def flt_has_nutrition(v: Views) -> DataFrame:
    return search.with_nutrition(v.menu, v.restaurant, v.menu_food_type, "KOREAN", "RICE", 50).select("id", "calories")


@query("flt_find_food", "SELECT food_code, food_name FROM official_food WHERE contains(normalized_name, 'ring') ORDER BY normalized_name, food_code LIMIT 30")
def flt_find_food(v: Views) -> DataFrame:
    return search.find_foods(v.official_food, "Ring", 30).select("food_code", "food_name")


@query("flt_find_food_indexed", "SELECT food_code, food_name FROM official_food WHERE contains(normalized_name, 'hot ring') ORDER BY normalized_name, food_code LIMIT 30")
def flt_find_food_indexed(v: Views) -> DataFrame:
    index = Trigrams.write(v.official_food, "food_code", ["lower(normalized_name)", "lower(food_name)"], v.scratch("food-runs"))
    return search.find_foods(index.candidates(["hot ring"]), "Hot ring", 30).select("food_code", "food_name")


@query("flt_words_indexed", "SELECT id, name FROM menu WHERE contains(lower(name), 'plate') AND contains(lower(name), 'big')")
def flt_words_indexed(v: Views) -> DataFrame:
    index = Trigrams.write(v.menu.select("id", "name"), "id", ["lower(name)"], v.scratch("menu-runs"))
    return index.search(["big", "plate"])


@query("prj_dto", f"SELECT m.id, m.name, price, r.id AS restaurant_id, r.name AS restaurant_name, cuisine {_BASE}")
@query("jn_menu_restaurant", f"SELECT m.id, m.name, price, r.id AS restaurant_id, r.name AS restaurant_name, cuisine {_BASE}")
def jn_menu_restaurant(v: Views) -> DataFrame:
    return search.with_restaurant(v.menu, v.restaurant).select("id", "name", "price", "restaurant_id", "restaurant_name", "cuisine")


@query("jn_menu_food_left", "SELECT m.id, major_category FROM menu m LEFT JOIN official_food f ON f.food_code = m.official_food_code")
def jn_menu_food_left(v: Views) -> DataFrame:
    return tagging.tag_menus(v.menu, v.official_food, v.restaurant, CATEGORY_MAP, KEYWORDS).select("id", "major_category")


@query("jn_menu_tags_left", "SELECT id, string_agg(food_type, ',' ORDER BY food_type) AS food_types FROM menu LEFT JOIN menu_food_type ON menu_id = id GROUP BY id")
def jn_menu_tags_left(v: Views) -> DataFrame:
    return search.tags_by_id(v.menu, v.menu_food_type).select("id", F.when(F.col("food_types").isNotNull(), F.array_join("food_types", ",")).alias("food_types"))


@query("jn_exists_semi", """
    SELECT id, name FROM restaurant r WHERE contains(lower(name), 'brand#1') OR EXISTS (SELECT 1 FROM menu m WHERE m.restaurant_id = r.id AND contains(lower(m.name), 'red'))
""")
def jn_exists_semi(v: Views) -> DataFrame:
    menus = v.menu.withColumns({c: F.replace(F.lower(c), F.lit("red"), F.lit("brand#1")) for c in ("name", "normalized_name")})
    return search.search_restaurants(v.restaurant, menus, "Brand#1").select("id", "name")


_COUNTS = "SELECT r.id, r.name, cuisine, count(m.id) AS menu_count FROM restaurant r LEFT JOIN menu m ON m.restaurant_id = r.id GROUP BY ALL"


@query("jn_rest_menu_count", _COUNTS)
@query("agg_menu_count", _COUNTS)
def jn_rest_menu_count(v: Views) -> DataFrame:
    return evaluation.menu_counts(v.restaurant, v.menu)


@query("jn_synonym", """
    WITH s AS (SELECT * FROM (VALUES ('hotring', 'NOODLE'), ('bluerod', 'MEAT')) t(term, derived_type))
    SELECT p_partkey, derived_type FROM part LEFT JOIN s ON s.term = replace(p_name, ' ', '')
""")
def jn_synonym(v: Views) -> DataFrame:
    table = v.spark.createDataFrame([("hotring", "NOODLE"), ("bluerod", "MEAT")], "term string, food_type string")
    return tagging.resolve_synonym(v.part.select("p_partkey", F.upper("p_name").alias("keyword")), table).select("p_partkey", "derived_type")


_SCORED = f"""
    WITH m AS (SELECT m.id, m.name, m.restaurant_id, r.name AS restaurant_name, distance_to_main_gate AS d, {RATE_SQL} AS rate, CASE WHEN {_HIT} THEN 0 ELSE 3 END AS reason, price
      {_BASE} WHERE cuisine <> 'CAFE_DESSERT' AND ({_HIT} OR m.id IN (SELECT menu_id FROM menu_food_type WHERE food_type = 'SOUP')) AND price <= 15000 AND sodium <= 120),
    o AS (SELECT *, row_number() OVER (PARTITION BY restaurant_id ORDER BY reason, rate DESC NULLS LAST, name, id) AS n FROM m)
"""
_CARD = """c AS (SELECT restaurant_id, restaurant_name, count(*) AS matched_menus, min(reason) AS reason, max(CASE WHEN n = 1 THEN rate END) AS top_match_rate, max(CASE WHEN n = 1 THEN id END) AS first_menu, d AS distance_m,
    CAST(greatest(1, floor(d / 75.0 + 0.5)) AS INT) AS walk_minutes FROM o GROUP BY restaurant_id, restaurant_name, d)"""
FILTERED = search.Condition(keyword="hot ring", derived_type="SOUP", nutrition="LOW_SODIUM", max_price=15000)
_CARD_COLUMNS = "restaurant_id, restaurant_name, matched_menus, reason, top_match_rate, first_menu, distance_m, CASE WHEN distance_m IS NOT NULL THEN walk_minutes END AS walk_minutes"


def card_rows(cards: DataFrame) -> DataFrame:
    return cards.select("restaurant_id", "restaurant_name", "matched_menus", "reason", "top_match_rate", F.get("menus", F.lit(0))["id"].alias("first_menu"), "distance_m", "walk_minutes")


@query("agg_group_restaurant", f"{_SCORED}, {_CARD} SELECT {_CARD_COLUMNS} FROM c")
def agg_group_restaurant(v: Views) -> DataFrame:
    return card_rows(recommended(v, FILTERED, MEMBER))


@query("win_menu_order", _SCORED + "SELECT restaurant_id, CAST(n AS INT) AS nth, id, rate AS match_rate FROM o")
def win_menu_order(v: Views) -> DataFrame:
    menus = recommended(v, FILTERED, MEMBER).select("restaurant_id", F.posexplode("menus").alias("p", "m"))
    return menus.select("restaurant_id", (F.col("p") + 1).alias("nth"), "m.id", "m.match_rate")


_ORDERED = f"{_SCORED}, {_CARD} SELECT {_CARD_COLUMNS} FROM c ORDER BY reason, top_match_rate DESC NULLS LAST, restaurant_name, restaurant_id"


@query("srt_cards", f"{_ORDERED} LIMIT 40")
def srt_cards(v: Views) -> DataFrame:
    return search.page(card_rows(recommended(v, FILTERED, MEMBER)), search.card_order(), 0, 40)[0]


@query("lim_page", f"{_ORDERED} LIMIT 20 OFFSET 40")
def lim_page(v: Views) -> DataFrame:
    return search.page(card_rows(recommended(v, FILTERED, MEMBER)), search.card_order(), 2, 20)[0]


@query("lim_page_total", f"{_SCORED}, {_CARD} SELECT count(*) AS total FROM c")
def lim_page_total(v: Views) -> DataFrame:
    return search.page(recommended(v, FILTERED, MEMBER), search.card_order(), 2, 20)[1]


@query("recommend_home", f"""
    WITH m AS (SELECT m.id, m.name, m.restaurant_id, r.name AS restaurant_name, {RATE_SQL} AS rate {_BASE} WHERE cuisine <> 'CAFE_DESSERT')
    SELECT restaurant_id, restaurant_name, count(*) AS matched_menus, max(rate) AS top_match_rate FROM m GROUP BY ALL ORDER BY top_match_rate DESC NULLS LAST, restaurant_name, restaurant_id LIMIT 20
""")
def recommend_home(v: Views) -> DataFrame:
    cards = recommended(v, None, MEMBER).select("restaurant_id", "restaurant_name", "matched_menus", "top_match_rate", "reason")
    return search.page(cards, search.card_order(), 0, 20)[0].drop("reason")


@query("lim_db_page", f"SELECT m.id, m.name {_BASE} WHERE contains(lower(m.name), 'plate') ORDER BY m.name, m.id LIMIT 25 OFFSET 50")
def lim_db_page(v: Views) -> DataFrame:
    found = search.search_menus(v.menu, v.restaurant, v.menu_food_type, keyword="plate").select("id", "name")
    return search.page(found, [F.asc("name"), F.asc("id")], 2, 25)[0]


_MENU_ORDER = ["name", "-price", "id"]
_MENU_PAGE = "SELECT name, price, id FROM menu {where} ORDER BY name, price DESC NULLS LAST, id LIMIT 25"


def ordered_menus(v: Views) -> Ordered:
    return Ordered.write(v.menu.select("name", "price", "id"), _MENU_ORDER, v.scratch("menus-in-order"))


@query("lim_page_in_order", _MENU_PAGE.format(where="") + " OFFSET 375")
def lim_page_in_order(v: Views) -> DataFrame:
    return ordered_menus(v).page(15, 25)


@query("lim_seek_page", _MENU_PAGE.format(where="") + " OFFSET 50")
def lim_seek_page(v: Views) -> DataFrame:
    """The third page, asked for by the last row of the second."""
    menus = ordered_menus(v)
    seen = menus.page(1, 25, placed=True).collect()
    return menus.after(menus.place_of(seen[-1]), 25) if seen else menus.page(2, 25)


@query("lim_seek_filtered", _MENU_PAGE.format(where="WHERE contains(lower(name), 'plate')") + " OFFSET 25")
def lim_seek_filtered(v: Views) -> DataFrame:
    """The second page of a search, asked for by the last row of the first."""
    menus, plates = ordered_menus(v), F.contains(F.lower("name"), F.lit("plate"))
    first = menus.after(None, 25, plates, placed=True).collect()
    return menus.after(menus.place_of(first[-1]), 25, plates) if first else menus.page(0, 0)


_TAGGED = f"""
    WITH k AS ({KEYWORD_SQL}), t AS (SELECT m.id, cuisine = 'CAFE_DESSERT' AS cafe, k.tags AS kt, CASE major_category WHEN 'ECONOMY' THEN 'RICE' WHEN 'LARGE' THEN 'MEAT,SOUP' WHEN 'PROMO' THEN 'DESSERT' ELSE '' END AS ct
      {_BASE} JOIN k ON k.normalized_name = m.normalized_name LEFT JOIN official_food f ON f.food_code = m.official_food_code)"""


def tagged(v: Views) -> DataFrame:
    return tagging.tag_menus(v.menu, v.official_food, v.restaurant, CATEGORY_MAP, KEYWORDS)


@query("set_union_tags", _TAGGED + " SELECT id, array_to_string(list_sort(list_distinct(list_filter(string_split(kt || ',' || ct, ','), lambda x : x <> ''))), ',') AS tags FROM t WHERE NOT cafe")
def set_union_tags(v: Views) -> DataFrame:
    return tagged(v).filter("not cafe").select("id", F.array_join("tags", ",").alias("tags"))


@query("agg_tag_report", _TAGGED + """ SELECT count(*) FILTER (cafe) AS skipped_cafe, count(*) FILTER (NOT cafe) AS total_menus, count(*) FILTER (NOT cafe AND (kt <> '' OR ct <> '')) AS tagged_menus,
    count(*) FILTER (NOT cafe AND kt = '' AND ct = '') AS untagged_menus, count(*) FILTER (NOT cafe AND ct <> '') AS from_category, count(*) FILTER (NOT cafe AND kt <> '') AS from_keyword FROM t""")
def agg_tag_report(v: Views) -> DataFrame:
    return tagging.tag_report(tagged(v))


@query("agg_tag_types", _TAGGED + " SELECT food_type, count(*) AS menus FROM (SELECT unnest(list_distinct(list_filter(string_split(kt || ',' || ct, ','), lambda x : x <> ''))) AS food_type FROM t WHERE NOT cafe) GROUP BY 1")
def agg_tag_types(v: Views) -> DataFrame:
    return tagging.type_counts(tagged(v))


@query("agg_category_count", "SELECT major_category, count(*) AS foods FROM official_food WHERE major_category <> '' GROUP BY 1")
def agg_category_count(v: Views) -> DataFrame:
    return tagging.categories(v.official_food).select("major_category", "foods")
