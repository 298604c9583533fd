import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.llm import negatives, queries
from tests.llm.helpers import DATA

ROWS = "vec_id long, label int, vector array<double>, rank string"  # `rank` clashes with a result's name


def brute(rows, every=10, k=5, m=5):
    ok = lambda r: r[0] is not None and r[1] is not None and r[2] and all(x is not None and math.isfinite(x) for x in r[2])
    held = {}
    for r in filter(ok, rows):
        row = (r[1], [math.floor(256 * x) for x in r[2]])
        held[r[0]] = min(held.get(r[0], row), row)
    out = []
    for a, (label, v) in held.items():
        if a % every:
            continue
        score = {i: sum(x * y for x, y in zip(v, w)) for i, (_, w) in held.items() if i != a and len(w) == len(v)}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if held[i][0] == label][:k]:
            near = [i for i in order if held[i][0] != label and 80 * score[p] <= 100 * score[i] <= 100 * score[p]][:m]
            out += [(a, p, n + 1, i, score[p], score[i]) for n, i in enumerate(near)]
    return sorted(out)


def check(spark, rows, **sizes):
    table = spark.createDataFrame([(*r, "x") for r in rows], ROWS)
    want = brute(rows, **sizes)
    got = negatives.hard_negatives(table, F.col("vec_id") % sizes.get("every", 10) == 0, sizes.get("k", 5), sizes.get("m", 5))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == want
    return want


def some(n, dim, seed, labels=3, scale=1.0):
    rng = np.random.default_rng(seed)
    return [(int(i), int(rng.integers(labels)), [float(x) * scale for x in rng.normal(size=dim) + 0.7]) for i in range(n)]


def test_embeddings_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{DATA.replace('0.001', '0.1')}/embeddings.parquet')")
    want = con.execute(queries.ORACLE_SQL["op11_hard_negatives"]).fetchall()
    got = queries.op11_hard_negatives(spark, DATA.replace("0.001", "0.1"))
    assert len(want) > 300 and sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("dim, scale", [(1, 1.0), (4, 1.0), (4, 0.004), (8, 3e5), (2, 1e6)])
def test_random_rows(spark, dim, scale):
    assert check(spark, some(150, dim, dim, scale=scale))


def test_many_ties_and_hot_vectors(spark):
    rows = [(i, i % 3, [1.0, 1.0]) for i in range(80)] + [(100 + i, i % 3, [1.0, 0.95]) for i in range(40)]
    assert check(spark, rows)


def test_blocks_of_anchors_and_small_slices(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK_ANCHORS", 3)
    assert check(spark, some(120, 5, 7), every=9, k=3, m=4)


def test_one_digit_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(negatives, "DIGIT", 1)
    assert check(spark, some(60, 3, 2), every=20)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = some(40, 3, 5) + [(100, None, [1.0] * 3), (None, 1, [1.0] * 3), (110, 1, None), (120, 1, []), (130, 1, [1.0, None, 1.0]), (140, 1, [nan, 1.0, 1.0]), (150, 1, [inf, 1.0, 1.0])]
    rows += [(160, 0, [1.0, 2.0]), (161, 0, [2.0, 2.0]), (162, 1, [1.9, 2.0]), (0, 2, [9.0] * 3), (10, 1, [0.0] * 3), (20, 0, [-1.0, -1.0, -1.0]), (170, -4, [1.0, 1.0, 1.0])]
    rows += [rows[3], rows[3], (5, 0, [1.0, 1.0, 1.0]), (5, 0, [0.5, 1.0, 1.0])]
    assert check(spark, rows)
    table = spark.createDataFrame([(*r, "x") for r in rows], ROWS)
    assert negatives.hard_negatives(table.limit(0), F.col("vec_id") % 10 == 0).collect() == []
    assert negatives.hard_negatives(table, F.col("vec_id") < 0).collect() == []


def test_components_that_leave_64_bits_take_no_part(spark):
    rows = some(40, 2, 6)
    table = spark.createDataFrame([(*r, "x") for r in [*rows, (41, 0, [1e300, 1.0]), (50, 0, [1e18, 1.0]), (60, 1, [-1e9, 1e12])]], ROWS)
    assert sorted(map(tuple, negatives.hard_negatives(table, F.col("vec_id") % 10 == 0).collect())) == brute(rows)
