"""Queries on sources and sinks."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, functions as F

from larder import jobs, schemas
from larder.operators import evaluation, ingest, scans, tagging, upsert
from larder.operators.snapshots import Snapshots
from larder.plans.catalog import query
from larder.plans.views import Views
from larder.runtime import materialise
from larder.sources import crawler, readers

CUISINE_MAP = {c.lower(): c for c in ("KOREAN", "CHINESE", "JAPANESE", "WESTERN", "ASIAN", "SNACK", "CAFE_DESSERT")}
MENU_KEY = "restaurant_id, normalized_name"


def crawled(v: Views) -> DataFrame:
    """Restaurants as a crawl gives them: nested menus, a category in words, some values missing."""
    # Dealt out before they are gathered: a task's own menus are of so many restaurants that gathering there saves nothing.
    parts = max(min(v.tasks, v.spark.sparkContext.defaultParallelism), -(-v.tasks // 8))
    menu = v.menu.select("restaurant_id", "id", "name", "price").repartition(parts, "restaurant_id").groupBy("restaurant_id").agg(F.sort_array(F.collect_list(F.struct("id", "name", "price"))).alias("m"))
    plain = F.transform("m", lambda x: F.struct(x["name"].alias("name"), x["price"].alias("price")))
    name = F.when(F.col("id") % 13 != 5, F.col("name")).otherwise(" ")
    joined = v.restaurant.join(menu, F.col("id") == F.col("restaurant_id"), "left")
    return joined.select(
        name.alias("name"), "address", F.concat(F.lower("cuisine"), F.lit(" ")).alias("raw_category"), F.concat("source_url", F.lit("/?c=126.9,37.5#top")).alias("source_url"),
        "latitude", "longitude", plain.alias("menus"), F.col("id").alias("ordinal"),
    )


@query("src_json_nested", """
    SELECT concat(source_url, '/?c=126.9,37.5#top') AS source_url, count(m.id) AS menus, CAST(coalesce(sum(m.price), 0) AS BIGINT) AS price_sum
    FROM restaurant r LEFT JOIN menu m ON m.restaurant_id = r.id GROUP BY source_url
""")
def src_json_nested(v: Views) -> DataFrame:
    path = v.scratch("crawl")
    upsert.write_json(crawled(v).drop("ordinal"), path)
    menus = F.col("menus")
    total = F.aggregate(menus, F.lit(0).cast("long"), lambda s, m: s + F.coalesce(m["price"], F.lit(0)))
    return readers.read_crawl(v.spark, path).select("source_url", F.size(menus).cast("long").alias("menus"), total.alias("price_sum"))


def food_source(v: Views) -> DataFrame:
    """The food table as text, with rows to skip among it."""
    texts = [F.col(c).cast("string").alias(c) for c in ("calories", "carbohydrate", "protein", "fat", "sodium")]
    code = F.when(F.col("partkey") % 31 != 4, F.col("food_code"))
    basis = F.when(F.col("partkey") % 29 == 3, "1회").otherwise(F.concat(F.lit(" "), "serving_basis"))
    none = F.lit(None).cast("string")
    return v.official_food.select(code.alias("food_code"), F.upper("food_name").alias("food_name"), "origin", "major_category", basis.alias("serving_basis"), *texts, none.alias("serving_weight_raw"), "company_name", none.alias("representative_code"), "representative_name", "partkey")


_FOOD_STATUS = """CASE WHEN partkey % 31 = 4 THEN 'skipped_missing' WHEN partkey % 29 = 3 THEN 'skipped_basis' WHEN serving_basis = '100g' THEN 'loaded_100g'
    WHEN coalesce(major_category, '') = 'PROMO' THEN 'skipped_drinks' ELSE 'loaded_100ml' END"""


@query("src_official_food", f"""
    SELECT food_code, normalized_name, calories, CAST(carbohydrate AS DOUBLE) AS carbohydrate, CAST(sodium AS DOUBLE) AS sodium, company_name FROM official_food
    WHERE {_FOOD_STATUS} LIKE 'loaded%'
""")
def src_official_food(v: Views) -> DataFrame:
    foods = readers.official_foods(food_source(v), drinks="PROMO").filter(F.col("status").startswith("loaded"))
    return foods.select("food_code", "normalized_name", "calories", F.col("carbohydrate").cast("double"), F.col("sodium").cast("double"), "company_name")


@query("flt_official_basis", f"SELECT {_FOOD_STATUS} AS status, count(*) AS foods FROM official_food GROUP BY 1")
def flt_official_basis(v: Views) -> DataFrame:
    return readers.official_foods(food_source(v), drinks="PROMO").groupBy("status").agg(F.count("*").alias("foods"))


@query("agg_load_report", f"""
    WITH s AS (SELECT {_FOOD_STATUS} AS status FROM official_food),
    n AS (SELECT count(*) AS total_rows, {", ".join(f"count(*) FILTER (status = '{x}') AS {x}" for x in readers.FOOD_STATUSES)} FROM s)
    SELECT *, loaded_100g + loaded_100ml AS loaded FROM n
""")
def agg_load_report(v: Views) -> DataFrame:
    return readers.load_report(readers.official_foods(food_source(v), drinks="PROMO"))


_WORD_TYPE = "CASE length(p_type) % 3 WHEN 0 THEN 'RICE' WHEN 1 THEN 'NOODLE' ELSE '-' END"


@query("src_dict_csv", f"SELECT DISTINCT lower(p_type) AS keyword, {_WORD_TYPE} AS food_type FROM part")
def src_dict_csv(v: Views) -> DataFrame:
    """The parts' types as a dictionary: padded, in odd case, with a byte order mark, another column and comments."""
    path = v.scratch("dictionary")
    kind = F.expr(f"lower({_WORD_TYPE})")
    words = v.part.select(F.concat(F.lit(" "), F.upper("p_type"), F.lit(" ")).alias("\ufeffkeyword"), F.concat(F.lit(" "), kind).alias("food_type"), F.lit("x").alias("note")).distinct()
    comments = words.select(F.concat(F.lit("# "), F.col("\ufeffkeyword")), F.lit(" "), F.lit(""))
    upsert.write_csv(words.unionAll(comments), path)
    return readers.keywords(v.spark, path)


@query("src_table_scan", "SELECT food_code, food_name, normalized_name, company_name, serving_basis, major_category, origin FROM official_food")
def src_table_scan(v: Views) -> DataFrame:
    return v.official_food.select("food_code", "food_name", "normalized_name", "company_name", "serving_basis", "major_category", "origin")


@query("src_web_crawl", r"""
    WITH item AS (SELECT page_id, url, html, list_transform(regexp_extract_all(html, '<li[^>]*>(.*?)</li>', 1, 's'), lambda x : trim(regexp_replace(x, '<[^>]*>', '', 'g'))) AS i FROM pages),
    kept AS (SELECT page_id, url, html, len(list_filter(i, lambda x : x <> '')) AS menus FROM item),
    one AS (SELECT *, row_number() OVER (PARTITION BY coalesce(nullif(regexp_extract(url, '/place/(\d+)', 1), ''), url) ORDER BY page_id) AS n FROM kept WHERE menus > 0)
    SELECT page_id, regexp_extract(url, '://[^/]*/([^/?#]*)', 1) AS raw_category, url AS source_url, CAST(menus AS BIGINT) AS menus FROM one WHERE n = 1
""")
def src_web_crawl(v: Views) -> DataFrame:
    found = crawler.create("stored_pages", v.pages).crawl(crawler.CrawlTarget("anywhere", max_count=None))
    return found.select("page_id", "raw_category", "source_url", F.size("menus").cast("long").alias("menus"))


def scan_responses(v: Views, corners: tuple[tuple[int, int], ...] = ((-30, -10), (30, -10), (30, 10), (-30, 10)), images: int = 1) -> DataFrame:
    """Scans as a recognition service returns them: JSON of images, fields and corners by their distance from the centres;
    with two images the second half of the fields is in the second, and an image without fields stands between."""
    x, y = F.col("cx"), F.col("cy")
    corner = lambda dx, dy: F.struct((x + dx).alias("x"), (y + dy).alias("y"))
    box = F.struct(F.array(*[corner(*c) for c in corners]).alias("vertices"))
    field = F.struct(F.col("text").alias("inferText"), F.lit(0.9).alias("inferConfidence"), box.alias("boundingPoly"))
    by = v.ocr_field.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", field.alias("f")))), lambda r: r["f"]).alias("fields"))
    if images == 1:
        parts = [F.col("fields")]
    else:
        half = F.ceil(F.size("fields") / 2).cast("int")
        parts = [F.slice("fields", F.lit(1), half), F.lit(None).cast(by.schema["fields"].dataType), F.slice("fields", half + 1, F.size("fields"))]
    return by.select("doc", F.to_json(F.struct(F.array(*[F.struct(p.alias("fields")) for p in parts]).alias("images"))).alias("response"))


def parsed_scans(v: Views, **shape) -> DataFrame:
    return readers.parse_scans(scan_responses(v, **shape)).select("doc", "response.images")


@query("src_ocr", "SELECT doc, pos, text, cx, cy FROM ocr_field")
def src_ocr(v: Views) -> DataFrame:
    return scans.flatten_fields(parsed_scans(v))


@query("fn_flatten_fields", "SELECT doc, pos, text FROM ocr_field")
def fn_flatten_fields(v: Views) -> DataFrame:
    return scans.flatten_fields(parsed_scans(v, images=2)).select("doc", "pos", "text")


@query("agg_centroid", "SELECT doc, pos, cx + 7.5e0 AS cx, cy + 7e0 AS cy FROM ocr_field")
def agg_centroid(v: Views) -> DataFrame:
    return scans.flatten_fields(parsed_scans(v, corners=((-30, -10), (60, 0), (0, 40), (0, -2)))).select("doc", "pos", "cx", "cy")


def locations(v: Views) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Incoming restaurants, some without coordinates; what is stored; what a geocoder knows."""
    r = v.restaurant
    fresh = F.col("id") % 3 == 0
    incoming = r.select("source_url", "address", F.when(fresh, F.col("latitude")).alias("latitude"), F.when(fresh, F.col("longitude")).alias("longitude"))
    stored = r.filter("id % 3 = 1").select("source_url", F.when(F.col("id") % 2 == 0, F.col("address")).otherwise("elsewhere").alias("address"), "latitude", "longitude")
    geocoded = r.groupBy("address").agg(F.min_by("latitude", "id").alias("latitude"), F.min_by("longitude", "id").alias("longitude")).filter("latitude is not null and address < 'road 3'")
    return incoming, stored, geocoded


_LOCATED = """
    WITH geo AS (SELECT address, arg_min(latitude, id) FILTER (latitude IS NOT NULL) AS lat, arg_min(id, id) AS g FROM restaurant GROUP BY address),
    geo2 AS (SELECT geo.address, r.latitude AS lat FROM geo JOIN restaurant r ON r.id = geo.g WHERE r.latitude IS NOT NULL AND geo.address < 'road 3'),
    picked AS (SELECT r.source_url,
        CASE WHEN r.id % 3 = 0 AND r.latitude IS NOT NULL THEN 'crawled' WHEN r.id % 3 = 1 AND r.id % 2 = 0 AND r.latitude IS NOT NULL THEN 'cached' WHEN geo2.lat IS NOT NULL THEN 'geocoded' ELSE 'none' END AS location_from,
        CASE WHEN r.id % 3 = 0 AND r.latitude IS NOT NULL THEN r.latitude WHEN r.id % 3 = 1 AND r.id % 2 = 0 AND r.latitude IS NOT NULL THEN r.latitude ELSE geo2.lat END AS latitude
      FROM restaurant r LEFT JOIN geo2 ON geo2.address = r.address)"""


@query("src_geocode", _LOCATED + " SELECT source_url, latitude FROM picked WHERE location_from = 'geocoded'")
def src_geocode(v: Views) -> DataFrame:
    return ingest.resolve_location(*locations(v)).filter("location_from = 'geocoded'").select("source_url", "latitude")


@query("fn_resolve_location", _LOCATED + " SELECT source_url, location_from, latitude FROM picked")
def fn_resolve_location(v: Views) -> DataFrame:
    return ingest.resolve_location(*locations(v)).select("source_url", "location_from", "latitude")


@query("agg_write_report", _LOCATED + " SELECT location_from, count(*) AS restaurants FROM picked GROUP BY location_from")
def agg_write_report(v: Views) -> DataFrame:
    return ingest.resolve_location(*locations(v)).groupBy("location_from").agg(F.count("*").alias("restaurants"))


@query("src_point_lookup", "SELECT id, name, cuisine FROM restaurant WHERE source_url = 'https://map.test/place/7'")
def src_point_lookup(v: Views) -> DataFrame:
    return readers.lookup(v.restaurant, "source_url", "https://map.test/place/7").select("id", "name", "cuisine")


ALL_CUISINES = CUISINE_MAP | {"etc": "ETC"}
SOUP = unicodedata.normalize("NFD", "갈비")


def restaurant_states(v: Views) -> tuple[DataFrame, DataFrame]:
    """Stored restaurants, and crawled ones: each under two urls that are one without what is cut off, the later one with a
    name in single jamo."""
    old = v.restaurant.filter("id % 3 <> 0").select("id", F.concat(F.lit("old "), "name").alias("name"), "cuisine", "source_url", F.lit("2024").alias("created_at"))
    seen = lambda n, name, tail: F.struct(F.lit(n).alias("n"), name.alias("name"), F.concat("source_url", F.lit(tail)).alias("source_url"))
    twice = F.explode(F.array(seen(1, F.concat(F.lit("early "), "name"), "?c=1"), seen(2, F.concat("name", F.lit(f" {SOUP} ")), "/#c")))
    rows = v.restaurant.filter("id % 2 = 0 or id % 3 = 0").select("address", F.lower("cuisine").alias("raw_category"), "latitude", "longitude", (F.col("id") * 2).alias("at"), twice.alias("r"))
    empty = F.array().cast(f"array<{schemas.MENU}>")
    crawl = rows.select("r.name", "address", "raw_category", "r.source_url", "latitude", "longitude", empty.alias("menus"), (F.col("at") + F.col("r.n")).alias("ordinal"))
    return old, ingest.last_places(ingest.restaurants(ingest.composed(ingest.first_by_url(crawl)), ALL_CUISINES)).select("name", "cuisine", "source_url", F.lit("2025").alias("created_at"))


def stored(v: Views, name: str, old: DataFrame, keys: list[str]) -> Snapshots:
    """A store whose first snapshot is ``old``."""
    store = Snapshots(v.spark, v.scratch("snapshots"))
    change = store.change()
    change.replace(name, old, keys, buckets=8)
    change.commit()
    return store


@query("snk_upsert_restaurant", """
    WITH top AS (SELECT max(id) AS m FROM restaurant WHERE id % 3 <> 0), fresh AS (SELECT id, row_number() OVER (ORDER BY source_url) AS n FROM restaurant WHERE id % 3 = 0)
    SELECT CASE WHEN r.id % 3 <> 0 THEN r.id ELSE m + n END AS id, CASE WHEN r.id % 2 = 0 OR r.id % 3 = 0 THEN concat(name, ' 갈비') ELSE concat('old ', name) END AS name, cuisine, source_url, CASE WHEN r.id % 3 <> 0 THEN '2024' ELSE '2025' END AS created_at
    FROM restaurant r LEFT JOIN fresh ON fresh.id = r.id, top
""")
def snk_upsert_restaurant(v: Views) -> DataFrame:
    old, new = restaurant_states(v)
    store = stored(v, "restaurant", old, ["source_url"])
    change = store.change()
    change.upsert("restaurant", upsert.next_ids(change.read("restaurant"), materialise(new, "crawled"), ["source_url"]), ["name", "cuisine"])
    change.commit()
    return store.read("restaurant")


@query("snk_bucket_upsert", """
    SELECT id, CASE WHEN id % 50 = 7 THEN 'new' ELSE name END AS name, id % 50 = 7 AS rewritten_only FROM restaurant WHERE id % 50 = 7
    UNION ALL SELECT id, name, false FROM restaurant WHERE id % 50 <> 7
""")
def snk_bucket_upsert(v: Views) -> DataFrame:
    """An upsert of few keys: rows in folders of the second version that no touched bucket explains would show as true."""
    store = stored(v, "restaurant", v.restaurant.select("id", "name"), ["id"])
    change = store.change()
    few = v.restaurant.filter("id % 50 = 7").select("id", F.lit("new").alias("name"))
    touched = change.upsert("restaurant", few, ["name"])
    change.commit()
    entry = store.manifest()["tables"]["restaurant"]
    fresh = [int(b) for b, folder in entry["folders"].items() if folder.startswith("2-")]
    astray = store.frame(entry, "restaurant", sorted(set(fresh) ^ set(touched))).select("id")
    rows = store.read("restaurant")
    return rows.join(astray.withColumn("astray", F.lit(True)), "id", "left").select("id", "name", (F.coalesce("astray", F.lit(False)) | (F.col("name") == "new")).alias("rewritten_only"))


def menu_states(v: Views) -> tuple[DataFrame, DataFrame]:
    """Stored menus, and crawled ones of two rows of one restaurant, the later of which counts."""
    rows = v.menu.withColumn("pos", F.col("id"))
    one = ingest.first_by_normalized(rows, "restaurant_id").select("id", "restaurant_id", "normalized_name", "name", "price")
    # Not looked up by id: two restaurants' menus may have one.
    seen = lambda n, name, price: F.struct(F.lit(n).alias("ordinal"), name.alias("name"), price.alias("price"))
    twice = F.explode(F.array(seen(1, F.lit("early"), F.lit(-1)), seen(2, F.col("name"), F.col("price"))))
    crawl = one.filter("id % 2 = 0 or id % 3 = 0").select("id", "restaurant_id", "normalized_name", F.col("id").alias("pos"), twice.alias("r"))
    new = ingest.last_menus(crawl.select("id", "restaurant_id", "normalized_name", "pos", "r.*"), "restaurant_id").select("id", "restaurant_id", "normalized_name", "name", "price")
    return one.filter("id % 3 <> 0").withColumn("price", F.lit(1)), new


_ONE_MENU = f"WITH one AS (SELECT *, row_number() OVER (PARTITION BY {MENU_KEY} ORDER BY id) AS n, count(*) OVER (PARTITION BY {MENU_KEY}) AS copies FROM menu) "


@query("snk_upsert_menu", _ONE_MENU + """
    SELECT id, restaurant_id, normalized_name, name, CASE WHEN id % 2 = 0 OR id % 3 = 0 THEN price ELSE 1 END AS price FROM one WHERE n = 1
""")
def snk_upsert_menu(v: Views) -> DataFrame:
    old, new = menu_states(v)
    store = stored(v, "menu", old, ["restaurant_id", "normalized_name"])
    change = store.change()
    change.upsert("menu", new, ["name", "price"])
    change.commit()
    return store.read("menu")


@query("snk_load", """
    WITH good AS (SELECT m.*, row_number() OVER (PARTITION BY restaurant_id, normalized_name ORDER BY id) AS n FROM menu m WHERE partkey % 8 NOT IN (1, 5))
    SELECT r.source_url, r.name AS restaurant, r.cuisine, g.name, g.normalized_name, g.price FROM good g JOIN restaurant r ON r.id = g.restaurant_id
    WHERE g.n = 1 AND r.id % 13 <> 5 AND r.cuisine <> 'ETC'
""")
def snk_load(v: Views) -> DataFrame:
    """The whole job, twice into one store: a crawl with an early row of each restaurant under another url, then once more."""
    late = v.once("crawled", lambda: crawled(v)).withColumn("ordinal", F.col("ordinal") * 2 + 1)
    one = F.transform(F.slice("menus", 1, 1), lambda m: m.withField("price", F.lit(1)))
    name = F.when(F.trim("name") != "", "early").otherwise(F.col("name"))
    early = late.withColumns({"name": name, "menus": one, "source_url": F.concat("source_url", F.lit("?early")), "ordinal": F.col("ordinal") - 1})
    store = jobs.Store(v.spark, v.scratch("store"), buckets=8)
    for crawl in (early.unionByName(late), late):
        jobs.load(store, crawl, CUISINE_MAP, store)
    places = store.read("restaurant").select(F.col("id").alias("restaurant_id"), F.col("name").alias("restaurant"), "cuisine", "source_url")
    return store.read("menu").join(places, "restaurant_id").select("source_url", "restaurant", "cuisine", "name", "normalized_name", "price")


@query("agg_dedup_menu_norm", _ONE_MENU + "SELECT restaurant_id, normalized_name, id, name, price, copies FROM one WHERE n = 1")
def agg_dedup_menu_norm(v: Views) -> DataFrame:
    return ingest.first_by_normalized(v.menu.withColumn("pos", F.col("id")), "restaurant_id").select("restaurant_id", "normalized_name", "id", "name", "price", "copies")


@query("snk_upsert_food", """
    SELECT p_name AS food_name, CASE WHEN max(p_partkey) % 2 = 0 THEN arg_max(p_type, p_partkey) ELSE 'kept' END AS major_category, CASE WHEN max(p_partkey) % 2 = 0 THEN max(p_partkey) ELSE -1 END AS partkey
    FROM part GROUP BY p_name
""")
def snk_upsert_food(v: Views) -> DataFrame:
    rows = v.part.select(F.col("p_name").alias("food_name"), F.col("p_type").alias("major_category"), F.col("p_partkey").alias("partkey"), F.col("p_partkey").alias("ordinal"))
    last = upsert.last_wins(rows, ["food_name"], "ordinal")
    old = last.select("food_name", F.lit("kept").alias("major_category"), F.lit(-1).cast("long").alias("partkey"))
    return upsert.upsert(old, last.filter("partkey % 2 = 0"), ["food_name"], ["major_category", "partkey"])


_MATCHES = "SELECT id AS menu_id, CASE WHEN id % 3 = 0 THEN 'gone' ELSE official_food_code END AS food_code, 'STRUCT' AS matched_by, CAST(0.85 AS DECIMAL(4,3)) AS confidence FROM menu WHERE id % 2 = 0 AND official_food_code IS NOT NULL"
_UPDATED = f"""
    WITH m AS ({_MATCHES}), hit AS (SELECT m.*, f.calories AS c FROM m JOIN official_food f USING (food_code))
    SELECT menu.id, coalesce(hit.food_code, official_food_code) AS official_food_code, coalesce(hit.matched_by, menu.matched_by) AS matched_by, CAST(coalesce(hit.confidence, menu.confidence) AS DOUBLE) AS confidence, coalesce(hit.c, calories) AS calories
    FROM menu LEFT JOIN hit ON hit.menu_id = menu.id
"""


def updated_menus(v: Views) -> DataFrame:
    code = F.when(F.col("id") % 3 == 0, "gone").otherwise(F.col("official_food_code"))
    matches = v.menu.filter("id % 2 = 0 and official_food_code is not null").select(F.col("id").alias("menu_id"), code.alias("food_code"), F.lit("STRUCT").alias("matched_by"), F.lit(0.85).cast("decimal(4,3)").alias("confidence"))
    return upsert.apply_matches(v.menu, matches, v.official_food)


@query("snk_update_match", _UPDATED)
def snk_update_match(v: Views) -> DataFrame:
    return updated_menus(v).select("id", "official_food_code", "matched_by", F.col("confidence").cast("double"), "calories")


@query("jn_update", f"""
    WITH m AS ({_MATCHES}), hit AS (SELECT m.menu_id, f.* FROM m JOIN official_food f USING (food_code))
    SELECT menu.id, CAST(coalesce(hit.carbohydrate, menu.carbohydrate) AS DOUBLE) AS carbohydrate, CAST(coalesce(hit.protein, menu.protein) AS DOUBLE) AS protein, CAST(coalesce(hit.fat, menu.fat) AS DOUBLE) AS fat,
        CAST(coalesce(hit.sodium, menu.sodium) AS DOUBLE) AS sodium, CASE WHEN hit.menu_id IS NOT NULL THEN 'OFFICIAL' ELSE source END AS source FROM menu LEFT JOIN hit ON hit.menu_id = menu.id
""")
def jn_update(v: Views) -> DataFrame:
    return updated_menus(v).select("id", *[F.col(c).cast("double").alias(c) for c in ("carbohydrate", "protein", "fat", "sodium")], "source")


@query("snk_replace_tags", """
    SELECT menu_id, food_type FROM menu_food_type WHERE menu_id NOT IN (SELECT id FROM menu WHERE id % 4 = 0) UNION SELECT id, 'PIZZA' FROM menu WHERE id % 4 = 0
""")
def snk_replace_tags(v: Views) -> DataFrame:
    new = v.menu.filter("id % 4 = 0").select(F.col("id").alias("menu_id"), F.lit("PIZZA").alias("food_type"))
    return upsert.replace_tags(v.menu_food_type, new)


@query("snk_delete_orphans", "SELECT menu_id, food_type FROM menu_food_type WHERE menu_id IN (SELECT id FROM menu WHERE price IS NOT NULL)")
def snk_delete_orphans(v: Views) -> DataFrame:
    return upsert.without_orphans(v.menu_food_type, v.menu.filter("price is not null"))


@query("jn_anti_orphan", "SELECT menu_id, food_type FROM menu_food_type WHERE menu_id NOT IN (SELECT id FROM menu WHERE price IS NOT NULL)")
def jn_anti_orphan(v: Views) -> DataFrame:
    return upsert.orphans(v.menu_food_type, v.menu.filter("price is not null"))


@query("snk_upsert_synonym", """
    SELECT lower(replace(p_name, ' ', '')) AS term, arg_max(p_type, p_partkey) AS food_type FROM part GROUP BY 1
""")
def snk_upsert_synonym(v: Views) -> DataFrame:
    return tagging.synonyms(v.part.select(F.col("p_partkey").alias("ordinal"), F.upper("p_name").alias("term"), F.col("p_type").alias("food_type")))


@query("snk_csv_branch", """
    SELECT r.name, cuisine, count(m.id) AS menu_count, regexp_replace(name_, '\\s+\\S+$', '') AS brand_guess FROM (SELECT *, name AS name_ FROM restaurant) r LEFT JOIN menu m ON m.restaurant_id = r.id
    WHERE r.name LIKE '%점' GROUP BY r.id, r.name, cuisine, name_
""")
def snk_csv_branch(v: Views) -> DataFrame:
    path = v.scratch("branches")
    upsert.write_csv(evaluation.branch_sheet(v.restaurant, v.menu), path)
    return v.spark.read.schema("name string, cuisine string, menu_count long, brand_guess string, franchise string").csv(path, header=True).drop("franchise")


@query("snk_csv_map", "SELECT major_category, count(*) AS foods FROM official_food WHERE major_category <> '' GROUP BY 1")
def snk_csv_map(v: Views) -> DataFrame:
    path = v.scratch("categories")
    upsert.write_csv(tagging.categories(v.official_food), path)
    return v.spark.read.schema("major_category string, foods long, suggested string").csv(path, header=True).select("major_category", "foods")


@query("snk_json", "SELECT id, name, cuisine, latitude FROM restaurant")
def snk_json(v: Views) -> DataFrame:
    path = v.scratch("json")
    upsert.write_json(v.restaurant.select("id", "name", "cuisine", "latitude"), path)
    return v.spark.read.schema("id long, name string, cuisine string, latitude double").json(path)


@query("snk_inbody", "SELECT id, member_id, CAST(measured_at AS STRING) AS measured_at, bmr FROM inbody")
def snk_inbody(v: Views) -> DataFrame:
    path = v.scratch("inbody")
    for part in (0, 1):  # one append after another
        v.inbody.filter(F.col("id") % 2 == part).write.mode("append").parquet(path)
    return v.spark.read.schema(v.inbody.schema).parquet(path).select("id", "member_id", F.col("measured_at").cast("string").alias("measured_at"), "bmr")


@query("prj_tri_state_update", """
    SELECT id, CASE WHEN id % 2 = 0 AND id % 4 <> 0 THEN 'GAIN' ELSE goal END AS goal, CASE WHEN id % 2 = 0 THEN 'NONE' ELSE exercise_count END AS exercise_count FROM member
""")
def prj_tri_state_update(v: Views) -> DataFrame:
    changes = v.member.filter("id % 2 = 0").select("id", F.when(F.col("id") % 4 != 0, "GAIN").alias("goal"), F.lit("NONE").alias("exercise_count"))
    return upsert.patch(v.member.select("id", "goal", "exercise_count"), changes, "id")


_SKIPPED = """CASE WHEN id % 13 = 5 THEN 'missing_required' WHEN cuisine = 'ETC' THEN 'unmapped_category' END"""


@query("flt_required", f"SELECT concat(source_url, '/?c=126.9,37.5#top') AS source_url, {_SKIPPED} AS skip_reason FROM restaurant WHERE id % 13 = 5")
def flt_required(v: Views) -> DataFrame:
    return ingest.skip_reasons(crawled(v), CUISINE_MAP).filter("skip_reason = 'missing_required'").select("source_url", "skip_reason")


@query("map_cuisine", f"SELECT source_url, cuisine FROM restaurant WHERE {_SKIPPED} IS NULL")
def map_cuisine(v: Views) -> DataFrame:
    return ingest.restaurants(crawled(v), CUISINE_MAP).select("source_url", "cuisine")


@query("fn_source_url", "SELECT id, source_url FROM restaurant")
def fn_source_url(v: Views) -> DataFrame:
    from larder.functions.text import source_url

    return v.restaurant.select("id", source_url(F.concat("source_url", F.lit("//?a=1#f"))).alias("source_url"))


@query("agg_dedup_url", "SELECT address AS source_url, arg_min(name, id) AS name, min(id) AS ordinal FROM restaurant GROUP BY address")
def agg_dedup_url(v: Views) -> DataFrame:
    rows = v.restaurant.select(F.col("address").alias("source_url"), "name", F.col("id").alias("ordinal"))
    return ingest.first_by_url(rows).select("source_url", "name", "ordinal")


@query("agg_dedup_menu_pair", "SELECT restaurant_id, normalized_name AS name, price, min(id) AS pos FROM menu GROUP BY ALL")
def agg_dedup_menu_pair(v: Views) -> DataFrame:
    return ingest.distinct_pairs(v.menu.select("restaurant_id", F.col("normalized_name").alias("name"), "price", F.col("id").alias("pos")), "restaurant_id")


@query("flt_menu_valid", """
    SELECT coalesce(CASE WHEN partkey % 8 = 1 THEN 'beverage' WHEN partkey % 8 = 5 THEN 'set_or_course' WHEN normalized_name LIKE '%anvil%' THEN 'excluded_term' END, 'valid') AS status, count(*) AS menus FROM menu GROUP BY 1
""")
def flt_menu_valid(v: Views) -> DataFrame:
    rows = ingest.menu_status(v.menu.select("id", "name"), terms=["anvil"])
    return rows.groupBy(F.coalesce("drop_reason", F.lit("valid")).alias("status")).agg(F.count("*").alias("menus"))
