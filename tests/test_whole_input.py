"""Queries over tables on which a cut of the input would show."""

from larder.plans import catalog

QUERIES = catalog.queries()

def test_tokens_of_whole_pages(spark, tmp_path):
    pages = [(1, "u", "a" + " " * 600 + "B c d e f"), (2, "u", "x" * 498 + " yyyyyy z"), (3, "u", None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.tokens for r in QUERIES["lim_tokens"](spark, str(tmp_path)).collect()}
    assert got == {1: "a|b|c|d|e", 2: "x" * 498 + "|yyyyyy|z", 3: None}


def test_terms_of_whole_pages(spark, tmp_path):
    spark.createDataFrame([(1, "u", "A b " * 400 + "Z")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert [r.term for r in QUERIES["fn_normalize_term"](spark, str(tmp_path)).collect()] == ["ab" * 400 + "z"]


def test_views_hold_every_part_and_every_menu(spark):
    sf = "/root/testdata/sf0.001"
    parts = spark.read.parquet(f"{sf}/part.parquet").count()
    menus = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_suppkey", "l_partkey").distinct().count()
    assert QUERIES["src_table_scan"](spark, sf).count() == parts
    counts = QUERIES["agg_menu_count"](spark, sf).collect()
    assert sum(r.menu_count for r in counts) == menus
    assert QUERIES["snk_upsert_restaurant"](spark, sf).count() == len(counts) == spark.read.parquet(f"{sf}/supplier.parquet").count()


def test_a_single_menu_is_found_and_places_without_menus_count_none(spark):
    from larder.operators import evaluation, search

    places = spark.createDataFrame([(i, f"place {i}", "KOREAN", "a") for i in range(20)], "id long, name string, cuisine string, address string")
    menus = spark.createDataFrame([(i, 3, "soup" if i != 77 else "Rare Dish", "soup" if i != 77 else "rare dish") for i in range(100)], "id long, restaurant_id long, name string, normalized_name string")
    assert {r.id for r in search.search_restaurants(places, menus, "rare").collect()} == {3}
    assert {r.id: r.menu_count for r in evaluation.menu_counts(places, menus).collect()} == {i: 100 if i == 3 else 0 for i in range(20)}
