"""Loading a crawl against a plain loop that loads its rows one after another; decisions that outlive a run."""

import json
import unicodedata

import pytest
from pyspark.sql import functions as F

from larder import jobs
from larder.functions.numeric import gate_distance
from larder.operators import aliasing, ingest
from larder.sources.geocoder import KnownPlaces

CUISINES = {"한식": "KOREAN", "카페": "CAFE_DESSERT"}
NFD = lambda s: unicodedata.normalize("NFD", s)
NFC = lambda s: unicodedata.normalize("NFC", s)


def row(name, url, address="길 1", category="한식", at=(None, None), **menus):
    return {"name": name, "address": address, "raw_category": category, "source_url": url, "latitude": at[0], "longitude": at[1], "menus": [{"name": m, "price": p} for m, p in menus.items()]}


CRAWL = [
    row("가", "http://m/place/1?c=1", at=(37.5, 126.9), 김치찌개=1000, 갈비탕=1),
    row(NFD("나"), "http://m/place/1?c=2", **{NFD("김치찌개"): 2000, " 물냉면 ": 5}),
    row("나", "http://m/place/1?c=2", 국밥=9),  # the same url: left out
    row(NFD("다") + " ", "http://m/place/2/", NFD("길 2"), " " + NFD("한식") + " ", 국밥=1),
    row("라", "http://m/place/3#x", "길 3", at=(1.5, 2.5), 국밥=1),
    row("라", "http://m/place/3#y", "길 4", 국밥=2),
    row("라", "http://m/place/3?z", "길 3", 탕=3),  # its address came before, but another one between
    row("마", "http://m/place/4", "길 없음", 국밥=1),
    row(" ", "http://m/place/5", 국밥=1),
    row("바", "http://m/place/6", category="모름", 국밥=1),
]
PLACES = {"길 2": (10.0, 20.0), "길 3": (30.0, 40.0), "길 4": (50.0, 60.0)}


def one_by_one(crawl, state, places):
    """{url: [name, address, cuisine, latitude, longitude, {normalized: (name, price)}]} after every row in turn."""
    seen = set()
    for r in crawl:
        if r["source_url"] in seen:
            continue
        seen.add(r["source_url"])
        name, address, category = (NFC(r[k]).strip() for k in ("name", "address", "raw_category"))
        if not name or not address or category not in CUISINES:
            continue
        url = r["source_url"].split("?")[0].split("#")[0].rstrip("/")
        old = state.get(url)
        at = (r["latitude"], r["longitude"])
        if at[0] is None:
            at = old[3:5] if old and old[1] == address and old[3] is not None else places.get(address, (None, None))
        menus = dict(old[5]) if old else {}
        own = {}
        for m in r["menus"]:
            own.setdefault(NFC(m["name"]).strip(), (NFC(m["name"]).strip(), m["price"]))
        state[url] = [name, address, CUISINES[category], *at, menus | own]
    return state


def stored(store):
    places = {r.id: r for r in store.read("restaurant").collect()}
    menus = store.read("menu").collect()
    assert len({r.source_url for r in places.values()}) == len(places) and len({(m.restaurant_id, m.normalized_name) for m in menus}) == len(menus) == len({m.id for m in menus})
    out = {r.source_url: [r.name, r.address, r.cuisine, r.latitude, r.longitude, {}] for r in places.values()}
    for m in menus:
        out[places[m.restaurant_id].source_url][5][m.normalized_name] = (m.name, m.price)
    return out


def write(path, rows):
    path.write_text(json.dumps(rows, ensure_ascii=False))
    return str(path)


def test_a_crawl_is_loaded_as_if_row_by_row(spark, tmp_path):
    store = jobs.Store(spark, f"file://{tmp_path}/store", buckets=8)
    report = jobs.load(store, write(tmp_path / "1.json", CRAWL), CUISINES, store, places_of=KnownPlaces(PLACES)).collect()
    want = one_by_one(CRAWL, {}, PLACES)
    assert stored(store) == want and len(want) == 4 and want["http://m/place/1"][5]["김치찌개"] == ("김치찌개", 2000)
    assert {(r.kind, r.outcome): r.rows for r in report} == {
        ("restaurant", "loaded"): 7, ("restaurant", "missing_required"): 1, ("restaurant", "unmapped_category"): 1, ("menu", "valid"): 9,
        ("location", "crawled"): 1, ("location", "geocoded"): 2, ("location", "none"): 1,
    }
    ids = {r.source_url: (r.id, r.created_at) for r in store.read("restaurant").collect()}
    assert sorted(i for i, _ in ids.values()) == [1, 2, 3, 4]
    first = store.snapshots.manifest()["tables"]
    more = [row("가2", "http://m/place/1", "길 1", 냉면=7), row("새", "http://m/place/9", "길 2", at=(1.0, 1.0), 탕=1), row("라", "http://m/place/3", "길 9", 국밥=4)]
    jobs.load(store, write(tmp_path / "2.json", more), CUISINES, store, places_of=KnownPlaces(PLACES))
    assert stored(store) == one_by_one(more, want, PLACES)
    again = {r.source_url: r for r in store.read("restaurant").collect()}
    assert all((again[u].id, again[u].created_at) == x for u, x in ids.items()) and again["http://m/place/9"].id == 5
    assert again["http://m/place/1"].updated_at > ids["http://m/place/1"][1]
    second = store.snapshots.manifest()["tables"]["restaurant"]["folders"]
    assert sum(second[b] == f for b, f in first["restaurant"]["folders"].items()) >= 1  # buckets that no key touched
    gates = store.read("restaurant").filter(~F.col("distance_to_main_gate").eqNullSafe(gate_distance(F.col("latitude"), F.col("longitude"), "MAIN_GATE")))
    assert gates.count() == 0
    jobs.load(store, write(tmp_path / "2.json", more), CUISINES)  # without a target nothing is written
    assert store.snapshots.versions() == [1, 2]


def test_repeated_keys_are_refused(spark):
    from larder.operators import upsert

    old, twice = spark.createDataFrame([(1, "a")], "id long, key string"), spark.createDataFrame([("b",), ("b",)], "key string")
    with pytest.raises(Exception, match="not unique: b"):
        upsert.upsert(old, twice, ["key"], []).collect()
    with pytest.raises(Exception, match="not unique: b"):
        upsert.upsert(spark.createDataFrame([(1, "b"), (2, "b")], old.schema), twice.limit(1), ["key"], []).collect()
    nulls = spark.createDataFrame([(None,), (None,), ("c",)], "key string")
    got = upsert.next_ids(old, nulls.unionByName(twice.limit(1)), ["key"]).collect()
    assert sorted(r.id for r in got if r.key) == [x for x in sorted(r.id for r in got if r.key)] and all(r.id > 1 for r in got if r.key)


class Failing(aliasing.FakeClient):
    """Answers until a file holds ``most`` lines, then refuses."""

    name, persists = "paid", True

    def __init__(self, path, most):
        super().__init__()
        self.path, self.most = path, most

    def ask(self, prompt, items):
        with open(self.path, "a+") as f:
            f.seek(0)
            if len(f.read()) >= self.most:
                raise aliasing.Refused("no credit")
            f.write("x")
        return super().ask(prompt, items)


def asked_names(spark, n):
    rows = [(f"n{i:02d}", f"m{i}", "r", 1, i, ["a [x]"], [f"C{i}"]) for i in range(n)]
    return spark.createDataFrame(rows, "normalized_name string, menu_name string, restaurant_name string, menus long, first_id long, labels array<string>, codes array<string>")


def test_a_run_that_breaks_off_costs_no_answer_twice(spark, tmp_path):
    log, calls = aliasing.DecisionLog(spark, f"file://{tmp_path}/log"), tmp_path / "calls"
    assert log.read().collect() == [] and log.rounds() == []
    asked = asked_names(spark, 50)
    with pytest.raises(aliasing.Refused, match="no credit"):
        aliasing.ask_logged(aliasing.prompts(asked, 5), Failing(str(calls), 6), log, a_minute=100_000, round_size=4)
    kept = log.read()
    assert calls.read_text() == "x" * 6 and kept.count() == 30 and log.rounds() == [1, 2]
    (tmp_path / "log" / "draft-lost").mkdir()  # what a lost driver leaves is not read
    rest = asked.join(kept.select("normalized_name"), "normalized_name", "left_anti")
    decided = aliasing.ask_logged(aliasing.prompts(rest, 5), Failing(str(calls), 99), log, round_size=3)
    assert calls.read_text() == "x" * 10 and decided.count() == 20 and log.read().count() == 50
    known = log.known(spark.createDataFrame([("n00", "OLD"), ("zz", "Z")], "normalized_name string, food_code string"))
    assert known.count() == 51 and {r.food_code for r in known.filter("normalized_name in ('n00', 'zz')").collect()} == {"C0", "Z"}
    log.append(decided.limit(1).withColumn("food_code", F.lit("LATER")), "other")  # a name once more: the first decision counts
    assert log.read().count() == 50 and log.read().filter("food_code = 'LATER'").count() == 0


class Broken(aliasing.FakeClient):
    def ask(self, prompt, items):
        raise ValueError("no")


def test_a_round_in_which_all_fails_is_the_last(spark, tmp_path):
    log = aliasing.DecisionLog(spark, f"file://{tmp_path}/log")
    decided = aliasing.ask_logged(aliasing.prompts(asked_names(spark, 12), 2), Broken(), log, round_size=2)
    assert [r.decision for r in decided.collect()] == ["failed"] * 4 and log.rounds() == [1] and log.read().collect() == []


def test_a_name_is_cleaned_once_however_many_sell_it(spark, tmp_path, monkeypatch):
    cleaned, status = [], ingest.menu_status
    monkeypatch.setattr(ingest, "menu_status", lambda menus, *a: cleaned.append(menus.count()) or status(menus, *a))
    crawl = [row(f"가{i}", f"http://m/place/{i}", **{"국밥 (대)": i, "국밥": 7, NFD("갈비탕"): None, " ": 1, "콜라 355ml": 2}) for i in range(20)]
    crawl[3]["menus"].append({"name": None, "price": 1})
    store = jobs.Store(spark, f"file://{tmp_path}/store", buckets=2)
    report = {(r.kind, r.outcome): r.rows for r in jobs.load(store, write(tmp_path / "1.json", crawl), CUISINES, store).collect()}
    assert cleaned == [6] and report == {("restaurant", "loaded"): 20, ("menu", "valid"): 60, ("menu", "blank"): 21, ("menu", "beverage"): 20}
    got = sorted((m.restaurant_id, m.normalized_name, m.name, m.price) for m in store.read("menu").collect())
    number = {r.id: int(r.name[1:]) for r in store.read("restaurant").collect()}
    assert got == sorted(x for i, n in number.items() for x in ((i, "국밥", "국밥 (대)", n), (i, "갈비탕", "갈비탕", None)))


def test_known_keys_are_not_broadcast(spark, monkeypatch):
    """Few bytes in a file may be millions of keys."""
    from larder.operators import upsert

    plans, in_order = [], upsert.in_order
    shown = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(upsert, "in_order", lambda df, *a: plans.append(shown(df)) or in_order(df, *a))
    old, new = spark.createDataFrame([(1, "a")], "id long, key string"), spark.createDataFrame([("a",), ("b",)], "key string")
    got = upsert.next_ids(old, new, ["key"])
    assert {r.key: r.id for r in got.collect()} == {"a": None, "b": 2}
    assert all("Broadcast" not in p for p in (*plans, shown(got))) and len(plans) == 1


def test_the_crawl_of_snk_load_is_made_once(spark, monkeypatch):
    from larder.plans import tables_catalog
    from larder.plans.views import Views

    read, load = [], jobs.load
    monkeypatch.setattr(jobs, "load", lambda store, crawl, *a: read.extend(crawl.inputFiles()) or load(store, crawl, *a))
    assert tables_catalog.snk_load(Views(spark, "/root/testdata/sf0.001")).count() > 0
    assert read and not [f for f in read if "lineitem" in f]
