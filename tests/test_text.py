import unicodedata

import pytest
from pyspark.sql import functions as F

from larder.functions import text


def one(spark, value, column, type_="string"):
    return spark.createDataFrame([(value,)], f"x {type_}").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("shown", "price"), [
    ("9,000원", 9000), ("9000 원", 9000), ("₩9,000", 9000), ("10,000원~15,000원", 10000), (None, None), ("", None), ("가격문의", None), ("0원", None), ("-", None), ("9000", 9000), ("99999999999", None),
])
def test_parse_price(spark, shown, price):
    assert one(spark, shown, text.parse_price) == price


@pytest.mark.parametrize(("name", "price", "want"), [
    ("  참치김밥\n", "4,500원", ("참치김밥", 4500)), ("김밥", None, ("김밥", None)), ("김밥", "시가", ("김밥", None)), (None, "1원", None), ("", "1원", None), ("  \n", "1원", None),
])
def test_menu_block(spark, name, price, want):
    row = spark.createDataFrame([(name, price)], "n string, p string").select(text.menu_block(F.col("n"), F.col("p")).alias("m")).first().m
    assert (row and tuple(row)) == want


@pytest.mark.parametrize(("shown", "want"), [
    ("런치\nA세트\n12,000원", ("런치 A세트", 12000)), ("광어회\n시가", ("광어회", None)), ("오늘의 특선", ("오늘의 특선", None)), ("12,000원", ("12,000원", None)), (None, None), ("", None), (" \n\n ", None),
    ("2인분 세트\n₩9,000", ("2인분 세트", 9000)), ("a\n\n b \n9000 원", ("a b", 9000)), ("a\n9000원 부터", ("a 9000원 부터", None)),
])
def test_menu_row(spark, shown, want):
    row = one(spark, shown, text.menu_row)
    assert (row and tuple(row)) == want


@pytest.mark.parametrize(("name", "want"), [
    ("🐂한우모듬", "한우모듬"), ("마라麻辣짜장", "마라 짜장"), ("알/곤이찜", "알곤이찜"), ("탕수육 (소) 500g", "탕수육"), ("양갈비살꼬치 1인분 180g", "양갈비살꼬치"), ("[[신메뉴]] 갈비탕", "갈비탕"),
    ("++ 환타 오렌지 추가 (355ml) ++", "환타 오렌지 추가"), ("대게살유산슬", "대게살유산슬"), ("순대", "순"), ("황소", "황"), ("특", ""), ("a)b", "ab"), ("Big  MAC\t세트", "big mac"), ("곱빼기 특대 2인", ""),
    ("((a)b", "b"), ("《신》(a(b)c)면", "면"), ("", ""), ("１２인분 국", "１２인분 국"), ("국 １２인분", "국"),
])
def test_normalize_menu_name(spark, name, want):
    assert one(spark, unicodedata.normalize("NFC", name), text.normalize_menu_name) == want


def test_normalizing_again_changes_nothing_more_for_plain_names(spark):
    rows = spark.createDataFrame([(n,) for n in ("탕수육 (소) 500g", "++ x ++", "a/b [c]", "면 곱빼기")], "x string")
    once = rows.select(text.normalize_menu_name(F.col("x")).alias("x"))
    assert once.collect() == once.select(text.normalize_menu_name(F.col("x")).alias("x")).collect()


def test_variants_are_replaced_in_order(spark):
    assert one(spark, "차돌백이", lambda c: text.normalize_menu_name(c, [("백", "박"), ("박이", "박")])) == "차돌박"


def test_nfc_once_per_distinct_value(spark):
    parts = unicodedata.normalize("NFD", "갈비탕")
    df = spark.createDataFrame([(1, parts), (2, parts), (3, "abc"), (4, None)], "id int, name string")
    got = {r.id: r.name for r in text.with_nfc(df, "name").collect()}
    assert got == {1: "갈비탕", 2: "갈비탕", 3: "abc", 4: None}


@pytest.mark.parametrize(("shown", "notice", "course", "drink"), [
    ("상차림비 받지않습니다", True, False, False), ("주문해 주세요.", True, False, False), ("평일점심특선 a", False, True, False), ("냉면사리추가", False, True, False), ("스페셜코스1", False, True, False),
    ("콜라 500 ML", False, False, True), ("생수 1.5리터", False, False, True), ("갈비탕", False, False, False),
])
def test_kinds_of_menu(spark, shown, notice, course, drink):
    assert [one(spark, shown, f) for f in (text.is_notice, text.is_set_or_course, text.is_beverage)] == [notice, course, drink]


def test_bigrams(spark):
    assert [sorted(one(spark, s, text.bigrams)) for s in ("", "가", "가 나", "가나가나")] == [[], ["가"], ["가나"], ["가나", "나가"]]


@pytest.mark.parametrize(("name", "want"), [
    ("김밥", [("김밥", True)]), ("볶음밥_새우", [("볶음밥_새우", True), ("새우볶음밥", True), ("새우", False)]), ("냉면_물냉면", [("냉면_물냉면", True), ("물냉면냉면", True), ("물냉면", True)]), ("_", [("_", True)]),
])
def test_candidate_keys(spark, name, want):
    assert [(k.key, k.allow_contain) for k in one(spark, name, text.candidate_keys)] == want


def test_keyword_tags(spark):
    words = [("탕", "SOUP"), ("탕수육", "FRIED"), ("새우", "SEAFOOD"), ("튀김", "FRIED"), ("국", "SOUP"), ("중국", "-")]
    tags = lambda s: one(spark, s, lambda c: text.keyword_tags(c, words))
    assert [tags(s) for s in ("탕수육", "새우튀김", "중국식냉면", "갈비탕", None, "빵")] == [["FRIED"], ["FRIED", "SEAFOOD"], [], ["SOUP"], [], []]


def test_urls(spark):
    assert one(spark, "https://a.b/place/12//?x=1#y", text.source_url) == "https://a.b/place/12"
    assert one(spark, "https://a.b/place/12/home", text.place_id) == "12"
    assert one(spark, "https://a.b/x", text.place_id) is None
    assert tuple(one(spark, "https://a.b/?c=126.5,37.25,15z", text.coords_of_url)) == (37.25, 126.5)
    assert one(spark, "https://a.b/?c=126,37", text.coords_of_url) is None


def test_search_words(spark):
    assert one(spark, "  A b\tC d e F ", lambda c: text.keyword_tokens(c, 5)) == ["a", "b", "c", "d", "e"]
    assert one(spark, None, lambda c: text.contains_all(c, F.array(F.lit("a")))) is False
    assert one(spark, "Hot RING", lambda c: text.contains_all(c, F.array(F.lit("tri"), F.lit("ho")))) is True
    assert one(spark, "돼지 고기 ", text.normalize_term) == "돼지고기"
