import json
import random
from collections import Counter
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from larder.enums import EDIT_LEAST, NGRAM_LEAST, SHORTLIST
from larder.operators import aliasing, evaluation, health, ingest, matching, scans, upsert
from larder.sources import crawler, readers
from larder.streaming.incremental import MENU_STREAM, match_stream, read_matches, read_names

FOOD = "food_code string, food_name string, normalized_name string, origin string, major_category string, serving_basis string, company_name string"


# --- matching against a plain loop ------------------------------------------------------------------------------------
def grams(s):
    t = s.replace(" ", "")
    return {t[i : i + 2] for i in range(len(t) - 1)} if len(t) > 1 else {t} - {""}


def keys_of(name):
    parts = [p.strip() for p in name.split("_") if p.strip()]
    if "_" not in name or len(parts) < 2:
        return [(name, True)]
    return [(name, True), (parts[-1] + parts[0], True), (parts[-1], parts[0] in parts[-1])]


def order_of(food):
    origin = food[3] or ""
    rank = 0 if "외식" in origin and "분석" in origin else 1 if "외식" in origin else 2 if "분석" in origin else 3
    return (0 if food[5] == "100g" else 1, rank, food[0])


def brute_match(name, foods, ngram=True):
    cands = [(order_of(f), i, k, allow, f) for f in foods for i, (k, allow) in enumerate(keys_of(f[2]))]
    same = sorted(c for c in cands if c[2] == name)
    if same:
        return same[0][4][0], "EXACT"
    g = grams(name)
    score = lambda c: len(g & grams(c[2])) / len(g | grams(c[2]))
    listed = sorted((c for c in cands if g & grams(c[2])), key=lambda c: (-score(c), c[0], c[1]))[:SHORTLIST]
    flat = name.replace(" ", "")
    close = [(r, c) for c in listed if (r := SequenceMatcher(None, flat, c[2].replace(" ", "")).ratio()) >= EDIT_LEAST]
    if close:
        return max(close, key=lambda x: x[0])[1][4][0], "EDIT"
    words = set(name.split())
    holds = [c for c in listed if c[3] and ((len(c[2]) >= 2 and c[2] in name and len(c[2]) / len(name) >= 0.5) or set(c[2].split()) < words)]
    if holds:
        return min(holds, key=lambda c: (len(c[2]), c[0], c[1]))[4][0], "STRUCT"
    if ngram:
        for c in listed:
            if score(c) < NGRAM_LEAST:
                break
            if c[3]:
                return c[4][0], "NGRAM"
    return None


def some_foods(n, seed):
    rng = random.Random(seed)
    words = ["갈비", "탕", "볶음", "밥", "새우", "냉면", "물냉면", "김치", "찌개", "왕"]
    out = []
    for i in range(n):
        name = "".join(rng.choices(words, k=rng.randint(1, 3)))
        if rng.random() < 0.5:
            name += "_" + rng.choice(words) + rng.choice(["", rng.choice(words)])
        out.append((f"D{i:03d}", name, name, rng.choice(["외식(분석함량)", "외식", "가정식(분석함량)", None]), None, rng.choice(["100g", "100ml"]), rng.choice([None, "Brand#1 Ltd", "BRAND#11"])))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_cascade_against_plain_loops(spark, seed):
    rng = random.Random(seed)
    foods = some_foods(70, seed)
    brands = ["brand#1", "brand#11", "nobody"]
    pools = {"": [f for f in foods if not any(b in (f[6] or "").lower() for b in brands)], **{b: [f for f in foods if b in (f[6] or "").lower()] for b in brands}}
    words = ["갈비", "탕", "볶음밥", "새우", "물냉면", "김치", "찌개", "왕", " ", "x"]
    rows = [(i, "m", "".join(rng.choices(words, k=rng.randint(1, 4))).strip(), rng.choice(["plain", "Brand#1 A", "a brand#11", "Nobody"])) for i in range(250)]
    got = {r.menu_id: (r.food_code, r.matched_by) for r in matching.match_menus(spark.createDataFrame(rows, MENU_STREAM), spark.createDataFrame(foods, FOOD), brands).collect()}
    for i, _, name, place in rows:
        held = [b for b in brands if b in place.lower()]
        pool = max(held, key=len) if held else ""
        want = brute_match(name, pools[pool], ngram=not pool) if name else None
        assert got[i] == ((want[0], ("BRAND_" if pool else "") + want[1]) if want else (None, None)), (name, pool)


def test_partitioning_does_not_change_matches(spark):
    foods = spark.createDataFrame(some_foods(40, 5), FOOD)
    rows = spark.createDataFrame([(i, "m", f[1][:3], "plain") for i, f in enumerate(some_foods(60, 6))], MENU_STREAM)
    a, b = (sorted(matching.match_menus(r, foods).select("menu_id", "food_code", "matched_by").collect()) for r in (rows.coalesce(1), rows.repartition(7)))
    assert a == b


def test_stream_of_menus(spark, tmp_path):
    foods = spark.createDataFrame([("D1", "갈비탕", "갈비탕", None, None, "100g", None)], FOOD)
    for batch in (1, 2):
        spark.createDataFrame([(batch, "m", "갈비탕" if batch == 1 else "왕갈비탕", "r")], MENU_STREAM).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        query = match_stream(spark, f"{tmp_path}/in", foods, f"{tmp_path}/out", f"{tmp_path}/state")
        query.awaitTermination()
    assert sorted((r.menu_id, r.matched_by) for r in read_matches(spark, f"{tmp_path}/out").collect()) == [(1, "EXACT"), (2, "STRUCT")]


def test_a_decided_name_is_not_matched_again(spark, tmp_path, monkeypatch):
    foods = spark.createDataFrame([("D1", "갈비탕", "갈비탕", None, None, "100g", None)], FOOD)
    asked, cascade = [], matching.cascade
    monkeypatch.setattr(matching, "cascade", lambda names, *a: (asked.extend(r.name for r in names.collect()), cascade(names, *a))[1])
    stream = lambda at: match_stream(spark, f"{tmp_path}/in", foods, f"{tmp_path}/out", f"{tmp_path}/{at}").awaitTermination()
    for batch, names in enumerate([["갈비탕", "xx", ""], ["갈비탕", "xx", "왕갈비탕"], ["xx"]]):
        spark.createDataFrame([(10 * batch + i, "m", n, "r") for i, n in enumerate(names)], MENU_STREAM).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream("state")
    want = [(0, "EXACT"), (1, None), (2, None), (10, "EXACT"), (11, None), (12, "STRUCT"), (20, None)]
    got = lambda: sorted((r.menu_id, r.matched_by) for r in read_matches(spark, f"{tmp_path}/out").collect())
    assert got() == want and sorted(asked) == sorted(["갈비탕", "xx", "왕갈비탕"])
    for commit in (tmp_path / "state" / "commits").glob("*2*"):  # the last batch was not marked as done: it is run again
        commit.unlink()
    stream("state")
    assert got() == want and read_names(spark, f"{tmp_path}/out").count() == 3 and len(asked) == 3


# --- upserts ----------------------------------------------------------------------------------------------------------
def test_upsert_keeps_ids_and_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", "x", 10), (2, "b", "y", 20)], "id long, key string, name string, created int")
    new = spark.createDataFrame([("b", "z"), ("c", "w")], "key string, name string")
    state = lambda t: upsert.upsert(t, upsert.next_ids(t, new, ["key"]), ["key"], ["name"], {"created": F.lit(30)})
    first = state(old)
    rows = {r.key: (r.id, r.name, r.created) for r in first.collect()}
    assert rows["a"] == (1, "x", 10) and rows["b"] == (2, "z", 20) and rows["c"][1:] == ("w", 30) and rows["c"][0] > 2
    again = {r.key: (r.id, r.name, r.created) for r in state(spark.createDataFrame(first.collect(), first.schema)).collect()}
    assert again == rows


def test_tags_stay_where_nothing_new_is_found_unless_evaluated(spark):
    old = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "menu_id long, food_type string")
    new = spark.createDataFrame([(1, "X"), (1, "Y")], "menu_id long, food_type string")
    assert sorted(map(tuple, upsert.replace_tags(old, new).collect())) == [(1, "X"), (1, "Y"), (2, "B"), (3, "C")]
    seen = spark.createDataFrame([(1,), (2,)], "menu_id long")
    assert sorted(map(tuple, upsert.replace_tags(old, new, seen).collect())) == [(1, "X"), (1, "Y"), (3, "C")]


# --- ingest -----------------------------------------------------------------------------------------------------------
def test_crawl_file_to_menus(spark, tmp_path):
    menus = [{"name": "갈비탕 (특)", "price": 9000}, {"name": " ", "price": 1}, {"name": "콜라 355ml", "price": 2000}, {"name": "주문해주세요"}, {"name": "점심특선", "price": 1}, {"name": "갈비탕", "price": 8000}]
    rows = [
        {"name": "가", "address": "x", "raw_category": " 한식 ", "source_url": "u/1/?q", "menus": menus},
        {"name": "가 again", "address": "x", "raw_category": "한식", "source_url": "u/1/?q", "latitude": 1.5, "longitude": 2.5},
        {"name": "나", "address": "", "raw_category": "한식", "source_url": "u/2"},
        {"name": "다", "address": "y", "raw_category": "모름", "source_url": "u/3"},
    ]
    path = tmp_path / "crawl.json"
    path.write_text(json.dumps(rows, ensure_ascii=False))
    crawled = readers.read_crawl(spark, str(path))
    once = ingest.first_by_url(crawled)
    assert sorted((r.source_url, r.skip_reason) for r in ingest.skip_reasons(once, {"한식": "KOREAN"}).collect()) == [("u/1/?q", None), ("u/2", "missing_required"), ("u/3", "unmapped_category")]
    assert [(r.source_url, r.cuisine, r.name) for r in ingest.restaurants(once, {"한식": "KOREAN"}).collect()] == [("u/1", "KOREAN", "가")]
    status = ingest.menu_status(readers.explode_menus(once)).orderBy("pos").collect()
    assert [r.drop_reason for r in status] == [None, "blank", "beverage", "notice", "set_or_course", None]
    one = ingest.first_by_normalized(ingest.menu_status(readers.explode_menus(once)).filter("drop_reason is null"), "source_url").collect()
    assert [(r.normalized_name, r.price, r.copies) for r in one] == [("갈비탕", 9000, 2)]


def test_pairs_keep_other_prices_and_equal_nulls(spark):
    rows = spark.createDataFrame([(1, 0, "a", 9), (1, 1, "a", 9), (1, 2, "a", 12), (1, 3, "b", None), (1, 4, "b", None)], "r long, pos int, name string, price int")
    assert sorted(map(tuple, ingest.distinct_pairs(rows, "r").collect()), key=lambda t: t[3]) == [(1, "a", 9, 0), (1, "a", 12, 2), (1, "b", None, 3)]


def test_dictionaries(spark, tmp_path):
    path = tmp_path / "d.csv"
    path.write_text("﻿keyword,food_type,note\n# c,,\n 탕 , soup ,\n중국,-,\n", encoding="utf-8")
    assert readers.read_keywords(spark, str(path)) == [("탕", "SOUP"), ("중국", "-")]
    path.write_text("keyword,food_type\n탕,WHAT\n", encoding="utf-8")
    with pytest.raises(ValueError, match="unknown type"):
        readers.read_keywords(spark, str(path))
    path.write_text("major_category,food_types\n면 및 만두류,NOODLE;snack\n음료,\n", encoding="utf-8")
    assert readers.read_type_map(spark, str(path)) == {"면 및 만두류": ["NOODLE", "SNACK"]}


def test_crawlers_are_registered():
    with pytest.raises(ValueError, match="unknown crawler"):
        crawler.create("none")
    with pytest.raises(ValueError):
        crawler.CrawlTarget(" ")


# --- scans ------------------------------------------------------------------------------------------------------------
GOOD = [("체중", 100, 1000), ("68.5kg", 500, 1020), ("골격근량", 100, 1100), ("34.2", 500, 1120), ("체지방률", 100, 1200), ("19.8", 650, 1220), ("기초대사량", 100, 1300), ("1620 kcal", 340, 1305),
        ("내장지방레벨", 100, 1400), ("8", 120, 1450), ("인바디 점수", 100, 1500), ("80점", 250, 1580), ("2026.07.25", 700, 200)]


def scan(spark, fields):
    box = lambda x, y: [{"x": x + dx, "y": y + dy} for dx in (-30.0, 30.0) for dy in (-10.0, 10.0)]
    one = {"images": [{"fields": [{"inferText": t, "inferConfidence": 0.9, "boundingPoly": {"vertices": box(x, y)}} for t, x, y in fields]}, {"fields": None}]}
    rows = readers.parse_scans(spark.createDataFrame([("d", json.dumps(one))], "doc string, response string"))
    return scans.extract(rows.select("doc", "response.images")).first()


def test_scan_with_all_values(spark):
    r = scan(spark, GOOD)
    assert (float(r.weight), float(r.muscle_mass), float(r.body_fat_percentage), r.bmr, r.visceral_fat_level, r.inbody_score, str(r.measured_at), r.status) == (68.5, 34.2, 19.8, 1620, 8, 80, "2026-07-25", "ok")


@pytest.mark.parametrize(("change", "status"), [
    ({"8": ("1", 120, 1450)}, "ok"), ({"8": ("20", 120, 1450)}, "ok"), ({"8": ("21", 120, 1450)}, "failed(visceral_fat_level)"), ({"8": ("0", 120, 1450)}, "failed(visceral_fat_level)"),
    ({"68.5kg": ("68.5", 700, 1020)}, "failed(weight)"), ({"68.5kg": ("68.5", 350, 1050)}, "failed(weight)"), ({"체중": ("체중", 100, 1300)}, "failed(weight)"), ({"체중": ("체 중", 100, 1000)}, "ok"),
    ({"체지방률": ("체지방를", 100, 1200)}, "ok"), ({"2026.07.25": ("2026.13.45", 700, 200)}, "ok"), ({"34.2": ("61", 500, 1120)}, "failed(muscle_mass)"),
])
def test_scan_borders(spark, change, status):
    assert scan(spark, [change.get(t, (t, x, y)) for t, x, y in GOOD]).status == status


# --- the fallback and evaluation --------------------------------------------------------------------------------------
class Broken:
    name, persists = "broken", True

    def ask(self, prompt, items):
        raise RuntimeError("no answer")


def test_decisions_and_failures(spark):
    unmatched = spark.createDataFrame([(i, f"m{i}", f"name {i % 5}", "r") for i in range(10)], "menu_id long, menu_name string, normalized_name string, restaurant_name string")
    none = spark.createDataFrame([("name 4", None)], "normalized_name string, food_code string")
    groups = aliasing.with_alias(aliasing.name_groups(unmatched), none)
    top = spark.createDataFrame([("", f"name {i}", 1, f"C{i}", "food", "cat", None) for i in range(5)], "pool string, name string, nth int, food_code string, food_name string, major_category string, origin string")
    asked = aliasing.to_ask(groups, top)
    assert asked.count() == 4
    decided = aliasing.decisions(aliasing.ask(aliasing.prompts(asked, size=3), aliasing.FakeClient()))
    rows = {r.normalized_name: (r.decision, r.food_code) for r in decided.collect()}
    assert set(rows) == {f"name {i}" for i in range(4)} and all(d in (("matched", f"C{n[-1]}"), ("abstained", None)) for n, d in rows.items())
    failed = aliasing.decisions(aliasing.ask(aliasing.prompts(asked, size=3), Broken()))
    assert {r.decision for r in failed.collect()} == {"failed"}
    alias = spark.createDataFrame([], "normalized_name string, food_code string, matched_by string, confidence decimal(3,2), model string, raw_answer string")
    assert aliasing.store(alias, failed, "m").count() == 0 and aliasing.store(alias, decided, "m").count() == 4


def test_the_first_line_that_can_be_read_decides(spark):
    batch = [("b", "1: 7\n1: 2\n1: 1\n2) maybe\n3: 없음\n3: 1\n9: 1", [(1, "one", ["A", "B"]), (2, "two", ["C"]), (3, "three", ["D"]), (4, "four", ["E"])])]
    answered = spark.createDataFrame(batch, "batch string, raw string, items array<struct<index int, normalized_name string, codes array<string>>>")
    got = {r.normalized_name: (r.decision, r.food_code, r.raw_answer) for r in aliasing.decisions(answered).collect()}
    assert got == {"one": ("matched", "B", "2"), "two": ("failed", None, None), "three": ("abstained", None, "없음"), "four": ("failed", None, None)}


class Script:
    """A client that does what it is told, call by call."""

    name, persists = "script", False

    def __init__(self, *acts):
        self.acts = list(acts)

    def ask(self, prompt, items):
        act = self.acts.pop(0)
        if isinstance(act, Exception):
            raise act
        return act


def test_calls_are_spaced_and_repeated_while_the_client_is_busy():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    call = aliasing.Caller(Script("a", aliasing.Busy(), aliasing.Busy(wait=27.0), "b", *[aliasing.Busy()] * 4, aliasing.Refused(), ValueError()), a_minute=30, sleep=sleep, clock=lambda: now[0])
    assert call("x", 1) == "a" and slept == []
    assert call("x", 1) == "b" and slept == [2.0, 2.0, 27.0]  # two seconds between calls, two before the first repetition
    with pytest.raises(aliasing.Busy):
        call("x", 1)
    for error in (aliasing.Refused, ValueError):
        before = len(call.client.acts)
        with pytest.raises(error):
            call("x", 1)
        assert len(call.client.acts) == before - 1  # not repeated


class Refusing(Broken):
    def ask(self, prompt, items):
        raise aliasing.Refused("wrong key")


class Counting(aliasing.FakeClient):
    def __init__(self, path):
        super().__init__()
        self.path = path

    def ask(self, prompt, items):
        with open(self.path, "a") as f:
            f.write("x")
        return super().ask(prompt, items)


def test_every_batch_is_asked_once_and_refusal_ends_the_run(spark, tmp_path):
    rows = [(f"n{i:02d}", f"m{i}", "r", 1, i, ["a [x]"], [f"C{i}"]) for i in range(45)]
    asked = spark.createDataFrame(rows, "normalized_name string, menu_name string, restaurant_name string, menus long, first_id long, labels array<string>, codes array<string>").repartition(5)
    batches = aliasing.prompts(asked)
    assert sorted(r.n for r in batches.collect()) == [5, 20, 20]
    answered = aliasing.ask(batches, Counting(str(tmp_path / "calls")))
    assert aliasing.decisions(answered).count() == 45 and aliasing.decisions(answered).filter("decision = 'matched'").count() == 23
    assert (tmp_path / "calls").read_text() == "xxx"
    with pytest.raises(Exception, match="wrong key"):
        aliasing.ask(batches, Refusing())


def test_label_sheet_carries_answers_by_code(spark):
    names = ["moved", "gone", "none", "out", "code", "blank", "beyond", "twice", "new"]
    rows = spark.createDataFrame([(i, n, n, "r") for i, n in enumerate(names)], "menu_id long, menu_name string, normalized_name string, restaurant_name string")
    top = spark.createDataFrame([("", n, k, f"D{k}-1", f"food {k}") for n in names for k in (1, 2, 3)], "pool string, name string, nth int, food_code string, label string")
    old = [(1, "moved", " 1 ", "D3-1", "D1-1"), (2, "gone", "2", "D1-1", "D9-1"), (3, "none", "0", "D1-1", ""), (4, "out", "X", "", ""), (5, "code", "D2-1", "", ""), (6, "blank", "2", "D1-1", " "), (7, "beyond", "12", "D1-1", "D2-1"),
           (8, "twice", "1", "D1-1", "D2-1"), (9, "twice", "2", "D1-1", "D2-1"), (10, "twice", "hm", "D1-1", "D2-1")]
    earlier = spark.createDataFrame([(*r, *[None] * 8) for r in old], "row_no int, normalized_name string, answer string, " + ", ".join(f"code_{i} string" for i in range(1, 11)))
    got = {r.normalized_name: r.answer for r in evaluation.label_sheet(rows, top, earlier).collect()}
    assert got == {"moved": "3", "gone": "D9-1", "none": "0", "out": "제외", "code": "2", "blank": "", "beyond": "", "twice": "2", "new": ""}


class Writer:
    def generate(self, score, cards):
        if score == 1:
            raise RuntimeError("no answer")
        return (" " if score == 2 else f"score {score}"), [f"{issue} {len(related)}" for issue, related in cards][: 0 if score == 3 else None]


def test_texts_of_a_model_or_of_the_template(spark):
    cards = spark.createDataFrame([(m, p, i, ["X"] * p) for m in (1, 2, 3, 4, 5) for p, i in ((1, "PROTEIN"), (2, "SODIUM"))], "member_id long, priority int, issue string, related array<string>")
    scores = spark.createDataFrame([(m, m) for m in (1, 2, 3, 4)], "member_id long, inbody_score int")
    got = {r.member_id: r for r in health.written_summaries(cards, scores, Writer()).collect()}
    assert {m: r.by for m, r in got.items()} == {1: "template", 2: "template", 3: "template", 4: "model", 5: "template"}
    assert (got[4].summary, got[4].descriptions) == ("score 4", ["PROTEIN 1", "SODIUM 2"]) and got[1].summary == got[5].summary != ""


def test_label_score(spark):
    sheet = spark.createDataFrame([(i, a) for i, a in enumerate(["1", "3", "10", "11", "0", "D101-018430000-0001", "제외", "x", "", None, "hm"])], "row_no int, answer string")
    r = evaluation.label_score(sheet).first()
    assert (r.total_rows, r.unlabeled, r.invalid, r.excluded, r.recall_miss, r.no_match, r.rank1, r.rank_le3, r.rank_le_n, r.labeled, r.exists_in_table, r.recall_at_n) == (11, 2, 2, 2, 1, 1, 1, 2, 3, 5, 4, 75.0)


def test_letters_bound_the_edit_ratio(spark):
    rng = random.Random(4)
    texts = ["", "가", "가나", "나가", "aab", "aba", "bb", "갈비탕", "왕갈비탕", "김치찌개", "치즈김개"] + ["".join(rng.choices("가나다a", k=rng.randint(0, 9))) for _ in range(60)]
    pairs = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    rows = pairs.select("a", "b", matching.most_ratio(F.col("a"), F.col("b")).alias("most"), matching.seq_ratio(F.col("a"), F.col("b")).alias("ratio")).collect()
    for r in rows:
        shared = sum((Counter(r.a) & Counter(r.b)).values())
        assert abs(r.most - (2 * shared / (len(r.a) + len(r.b)) if r.a or r.b else 1.0)) < 1e-12 and r.ratio <= r.most + 1e-12
