"""Searches by lists of runs equal whole scans, and read only rows that may hold the words."""

import random

import pytest
from pyspark.sql import functions as F

from larder.operators.trigrams import Trigrams

FIELDS = ["lower(name)", "lower(other)"]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rnd = random.Random(3)
    text = lambda n: "".join(rnd.choice("abC 김치😀") for _ in range(rnd.randrange(n)))
    rows = [(i, text(30), rnd.choice([None, "", text(12)])) for i in range(800)]
    rows += [(1000, None, None), (1001, "", ""), (1002, "needle in hay", None), (1003, None, "NEEDLE"), (None, "needles", "x"), (1004, "needle", "a"), (1004, "other", "b"), (1005, "nee dle" * 500, None)]
    df = spark.createDataFrame(rows, "id long, name string, other string")
    return Trigrams.write(df, "id", FIELDS, f"file://{tmp_path_factory.mktemp('runs')}/t"), rows


def plain(rows, tokens):
    return sorted((r for r in rows if any(f is not None and all(t in f.lower() for t in tokens) for f in r[1:])) if tokens else rows, key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("tokens", [["needle"], ["nee", "dle"], ["ab"], ["abc", "a"], [" c"], [], [""], ["김치"], ["김치😀"], ["a김", "치😀b"], ["zzz"], ["needlez"], ["aaaa"], ["%"]])
def test_searches(made, tokens):
    index, rows = made
    assert got(index.search(tokens)) == plain(rows, tokens)


def test_only_candidates_are_read(made):
    index, _ = made
    read = index.candidates(["needle"])
    assert sorted(r.name or r.other for r in read.collect()) == ["NEEDLE", "needle", "needle in hay", "needles", "other"]  # one key, two rows
    assert index.rarest(["needle"])[0][2] == 4 and index.rarest(["zzz"]) is None and index.rarest(["ab"]) == []
    scan = read._jdf.queryExecution().executedPlan().toString()
    assert "part" in scan.split("PartitionFilters: [")[1].split("]")[0]


def test_edges(spark, tmp_path):
    empty = Trigrams.write(spark.createDataFrame([], "id long, name string"), "id", ["name"], f"file://{tmp_path}/e")
    assert empty.search(["abc"]).collect() == [] and empty.search([]).collect() == [] and empty.search(["a"]).columns == ["id", "name"]
    short = Trigrams.write(spark.createDataFrame([(1, "ab")], "id long, name string"), "id", ["name"], f"file://{tmp_path}/s")
    assert short.search(["abc"]).collect() == [] and short.search(["ab"]).count() == 1
    with pytest.raises(ValueError, match="part"):
        Trigrams.write(spark.createDataFrame([(1, "ab")], "part long, name string"), "part", ["name"], f"file://{tmp_path}/p")


def test_lists_are_written_once(spark, tmp_path, monkeypatch):
    from larder.operators import trigrams

    def copy(df, name):
        raise AssertionError(f"{name} is written beside the index")

    monkeypatch.setattr(trigrams, "materialise", copy)
    index = Trigrams.write(spark.createDataFrame([(1, "big plate"), (2, "plate")], "id long, name string"), "id", ["name"], f"file://{tmp_path}/o")
    assert {r["run"]: r["rows"] for r in index._read("runs").collect()}["pla"] == 2 and index._read("lists").count() == 10
