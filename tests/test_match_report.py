"""The match report holds the menus by method and all that stays without a match, not only totals."""

from larder.operators import evaluation
from larder.plans import catalog
from larder.plans.views import BRANDS, Views

SF = "/root/testdata/sf0.001"
MATCHED = "scope string, pool string, restaurant_name string, normalized_name string, matched_by string"
FOODS = "food_code string, normalized_name string, company_name string"


def test_a_report_has_all_its_parts(spark):
    kept = [("kept", "", "a", "soup", "EXACT"), ("kept", "", "b", "soup", "EXACT"), ("kept", "", "a", "stew", "NGRAM"), ("kept", "ab", "AB", "pie", "BRAND_EXACT")]
    missing = [("kept", "", "a", "x", None), ("kept", "", "b", "x", None), ("kept", "", "b", None, None), ("kept", "", "c", "", None), ("kept", "ab", "AB", "x", None)]
    left_out = [("excluded_branch", p, n, m, by) for p, n, m, by in (("", "k점", "soup", "EXACT"), ("", "k점", "x", None), ("ab", "AB점", "pie", "BRAND_EXACT"))] + [("excluded_cafe", "", "c", "x", None)]
    foods = [("1", "soup", None), ("2", "noodle_cold", "other"), ("3", "pie", "AB and CD"), ("4", "", "AB")]
    got = evaluation.match_report(spark.createDataFrame(kept + missing + left_out, MATCHED), spark.createDataFrame(foods, FOODS), ["ab", "cd"])
    totals, *parts = got.collect()
    assert totals.part == "totals" and (totals.total_menus, totals.matched, totals.unmatched, totals.brand_menus, totals.brand_matched) == (9, 4, 5, 2, 1)
    assert (totals.excluded_branch, totals.excluded_branch_restaurants, totals.excluded_cafe, totals.excluded_franchise) == (3, 2, 1, 0)
    assert (totals.rate, totals.general_rate, totals.brand_rate, totals.total_candidates, totals.excluded_rows) == (44.4, 42.9, 50.0, 4, 1)
    assert sorted((r.part, r.item, r.menus, r.confidence) for r in parts) == [
        ("brand_unmatched", "x", 1, None), ("excluded_branch", "AB점", 1, None), ("excluded_branch", "k점", 2, None),
        ("method", "BRAND_EXACT", 1, 1.0), ("method", "EXACT", 2, 1.0), ("method", "NGRAM", 1, 0.7),
        ("unmatched", "", 2, None), ("unmatched", "x", 2, None),
    ]


def test_a_report_without_menus_has_totals_of_none(spark):
    got = evaluation.match_report(spark.createDataFrame([], MATCHED), spark.createDataFrame([], FOODS), []).collect()
    assert [(r.part, r.total_menus, r.matched, r.rate, r.excluded_branch, r.excluded_branch_restaurants, r.total_candidates, r.excluded_rows) for r in got] == [("totals", 0, 0, 0.0, 0, 0, 0, 0)]


def test_the_parts_of_the_query_add_up(spark):
    totals, *parts = catalog.queries()["agg_match_report"](spark, SF).collect()
    menus = lambda *of: sum(r.menus for r in parts if r.part in of)
    assert menus("method") == totals.matched > 0 and menus("unmatched", "brand_unmatched") == totals.unmatched > 0
    assert menus("brand_unmatched") == totals.brand_menus - totals.brand_matched and menus("excluded_branch") == totals.excluded_branch > 0
    methods = {r.matched_by: r.menus for r in catalog.queries()["agg_match_methods"](spark, SF).collect()}
    assert {r.item: r.menus for r in parts if r.part == "method"} == methods
    owned = [f for f in Views(spark, SF).official_food.collect() if any(b in (f.company_name or "").lower() for b in BRANDS)]
    assert totals.excluded_rows == len(owned) > 0
