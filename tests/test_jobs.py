"""The batch jobs from an empty store to scored labels, each on what the one before wrote."""

import csv
import json

from larder import jobs, schemas
from larder.__main__ import parser, run
from larder.operators.aliasing import FakeClient
from larder.schemas import FOOD_SOURCE


class Stored(FakeClient):
    name, persists = "stored", True


def test_a_store_from_crawl_to_labels(spark, tmp_path):
    dishes = ["갈비탕", "왕갈비탕", "비빔냉면", "콜라 355ml", "zzz qqq", "물냉면 xx"]
    crawl = [{"name": f"place {i}{'점' if i == 2 else ''}", "address": "a", "raw_category": ["한식", "카페", "?"][i % 3], "source_url": f"u/{i}", "menus": [{"name": d, "price": 100 * i} for d in dishes]} for i in range(4)]
    (tmp_path / "crawl.json").write_text(json.dumps(crawl, ensure_ascii=False))
    with open(tmp_path / "foods.csv", "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f)
        out.writerow([c.split()[0] for c in FOOD_SOURCE.split(", ")])
        for i, (name, basis) in enumerate([("갈비탕", "100g"), ("냉면_물냉면", "100g"), ("냉면_비빔냉면", "100g"), ("콜라", "100ml"), ("", "100g"), ("qqq 볶음", "100g")]):
            out.writerow([f"D{i}-1", name, "외식(분석함량)", "음료 및 차류" if basis == "100ml" else "국", basis, "10", "1", "1", "1", "1", "", "", "", ""])
    cuisines = {"한식": "KOREAN", "카페": "CAFE_DESSERT"}
    at = lambda n: jobs.Store(spark, f"file://{tmp_path}/s{n}", buckets=4)
    report = {(r.kind, r.outcome): r.rows for r in jobs.load(at(0), f"{tmp_path}/crawl.json", cuisines, at(1)).collect()}
    assert report == {("restaurant", "loaded"): 3, ("restaurant", "unmapped_category"): 1, ("menu", "valid"): 15, ("menu", "beverage"): 3}
    foods = jobs.load_foods(at(0), f"file://{tmp_path}/foods.csv", at(1)).first()
    assert (foods.total_rows, foods.loaded, foods.skipped_drinks, foods.skipped_missing) == (6, 4, 1, 1)
    again = jobs.load(at(1), f"{tmp_path}/crawl.json", cuisines, at(9)).count()
    assert again == 4 and at(9).read("menu").count() == 15 and {r.id for r in at(9).read("menu").collect()} == {r.id for r in at(1).read("menu").collect()}

    scope = jobs.Scope(cafe=True)
    first = jobs.match(at(1), scope, at(2)).first()
    assert first.excluded_cafe == 5 and first.total_menus == 10 and 0 < first.matched < 10
    kept = {r.name: r.matched_by for r in at(2).read("menu").collect() if r.matched_by}
    assert kept["갈비탕"] == "EXACT" and "zzz qqq" not in kept
    at(2).write("restaurant", at(1).read("restaurant"))
    at(2).write("official_food", at(1).read("official_food"))
    tags = jobs.tag(at(2), {"국": ["SOUP"]}, [("냉면", "NOODLE")], at(3)).first()
    assert tags.skipped_cafe == 5 and tags.tagged_menus > 0 and {r.food_type for r in at(3).read("menu_food_type").collect()} == {"SOUP", "NOODLE"}

    asked = jobs.llm_match(at(2), Stored(), scope, at(4)).first()
    assert asked.names > 0 and asked.asked > 0 and asked.matched_names + asked.abstained_names == asked.asked
    at(4).write("restaurant", at(1).read("restaurant"))
    at(4).write("official_food", at(1).read("official_food"))
    known = jobs.llm_match(at(4), Stored(), scope).first()
    assert known.cached == asked.asked and known.asked == 0

    sheet = jobs.export_labels(at(2), f"file://{tmp_path}/sheet", scope=scope).collect()
    assert sheet and all(r.answer == "" for r in sheet)
    read = jobs.read_sheet(spark, f"file://{tmp_path}/sheet")
    answered = read.drop("answer").selectExpr("*", "cast(case when row_no % 2 = 1 then '1' else '0' end as string) answer")
    score = jobs.score_labels(answered).first()
    assert score.rank1 + score.no_match == len(sheet)
    checked = jobs.llm_validate(answered, FakeClient()).first()
    assert checked.inside_total + checked.none_total + checked.failed == len(sheet)
    carried = jobs.export_labels(at(2), f"file://{tmp_path}/next", answered, scope).collect()
    assert {r.answer for r in carried} <= {"0", "1"} and len(carried) == len(sheet)
    assert [r.name for r in jobs.export_branches(at(1), f"file://{tmp_path}/branches").collect()] == []
    assert jobs.find_food(at(1), "갈비").count() == 1 and jobs.category_types(at(1)).first().foods == 4


def test_jobs_from_a_shell(spark, tmp_path):
    spark.createDataFrame([("D1-1", "갈비탕", "갈비탕")], "food_code string, food_name string, normalized_name string").write.parquet(f"{tmp_path}/official_food")
    found = run(spark, parser().parse_args(["find-food", f"file://{tmp_path}", "--keyword", "갈비"]))
    assert [r.food_code for r in found.collect()] == ["D1-1"]


def shell(spark, *words):
    return run(spark, parser().parse_args(list(words))).collect()


def test_from_stored_pages_to_recommendations(spark, tmp_path):
    at = lambda n: f"file://{tmp_path}/{n}"
    pages = [(i, f"http://m/한식/place/{i}", f"<title>place {i}</title><li>갈비탕\n9,000원</li><li>물냉면\n{i}000원</li><li>맥주\n5,000원</li>") for i in range(1, 4)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(at("pages"))
    for name, text in {"cuisines": "raw_category,cuisine\n한식,KOREAN", "terms": "term\n맥주", "places": "address,latitude,longitude\n거리,37.5,126.9", "synonyms": "term,food_type\n냉 면,NOODLE\n탕,SOUP"}.items():
        (tmp_path / f"{name}.csv").write_text(text)
    assert tuple(shell(spark, "crawl", at("s"), "--input", at("pages"), "--to", at("crawl"), "--area", "거리")[0]) == (3, 9)
    store = jobs.Store(spark, at("s"), buckets=4)
    store.write("restaurant", spark.createDataFrame([], schemas.RESTAURANT))
    loaded = shell(spark, "load", at("s"), "--input", at("crawl"), "--cuisines", at("cuisines.csv"), "--terms", at("terms.csv"), "--places", at("places.csv"), "--to", at("s"))
    assert {(r.kind, r.outcome): r.rows for r in loaded} == {("restaurant", "loaded"): 3, ("menu", "valid"): 6, ("menu", "excluded_term"): 3, ("location", "geocoded"): 3}
    assert {(r.latitude, r.longitude) for r in store.read("restaurant").collect()} == {(37.5, 126.9)}
    assert [tuple(r) for r in shell(spark, "seed-synonyms", at("s"), "--synonyms", at("synonyms.csv"), "--to", at("s"))] == [("냉면", "NOODLE"), ("탕", "SOUP")]
    assert store.read("food_type_synonym").count() == 2
    assert [tuple(r) for r in shell(spark, "llm-models", at("s"), "--client", "larder.operators.aliasing:FakeClient")] == [("fake", "fake")]
    menus = store.read("menu").filter("normalized_name = '물냉면'").selectExpr("id menu_id", "'NOODLE' food_type")
    spark.createDataFrame([(1, "LOSS", "NONE", "LOW", None)], schemas.MEMBER).write.parquet(at("s/member"))
    spark.createDataFrame([(1, "DIABETES")], schemas.MEMBER_DISEASE).write.parquet(at("s/member_disease"))
    spark.createDataFrame([(7, 1, 1500, 70, 80.0)], "id long, member_id long, bmr int, inbody_score int, protein_target double").selectExpr("*", "date'2024-01-01' measured_at").write.parquet(at("s/inbody"))
    menus.write.parquet(at("s/menu_food_type"))
    cards = shell(spark, "recommend", at("s"), "--keyword", "냉면", "--member", "1")
    assert sorted((r.restaurant_name, r.matched_menus) for r in cards) == [("place 1", 1), ("place 2", 1), ("place 3", 1)]
    assert [r.member_id for r in shell(spark, "report", at("s"))] == [1] and shell(spark, "report", at("s"), "--member", "2") == []
    assert [r.id for r in shell(spark, "targets", at("s"))] == [1]
