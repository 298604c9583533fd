import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larder.llm import ann
from larder.llm.ann import Bands, Graph, search
from tests.llm.helpers import DATA


def brute(rows, queries, k):
    ok = lambda v: v is not None and all(c is not None and np.isfinite(c) for c in v) and any(v)
    rows = {(i, tuple(v)) for i, v in rows if ok(v)}
    return {q: sorted(((i, float(np.dot(v, w))) for i, w in rows if i != q and len(w) == len(v)), key=lambda x: (-x[1], x[0]))[:k] for q, v in queries if ok(v)}


def recall(got, want, k):
    by = {}
    for r in got:
        by.setdefault(r.query_id, {})[r.vec_id] = r
    hit = n = 0
    for q, near in want.items():
        have = by.get(q, {})
        assert q not in have and sorted(r["rank"] for r in have.values()) == list(range(1, len(near) + 1))
        order = sorted(have.values(), key=lambda r: r["rank"])
        assert all((-a.score, a.vec_id) < (-b.score, b.vec_id) for a, b in zip(order, order[1:]))
        hit, n = hit + len(have.keys() & {i for i, _ in near}), n + len(near)
    assert set(by) == {q for q, near in want.items() if near}
    return hit / n


def test_recall_on_embeddings(spark):
    rows = spark.read.parquet(f"{DATA.replace('sf0.001', 'sf0.1')}/embeddings.parquet")
    asked = rows.filter(F.col("vec_id") % 20 == 0)
    want = brute([(r.vec_id, r.embedding) for r in rows.collect()], [(r.vec_id, r.embedding) for r in asked.collect()], 20)
    got = search(rows, asked, 20).collect()
    assert recall(got, want, 20) >= 0.9
    exact = {(q, i): s for q, near in want.items() for i, s in near}
    assert all(abs(exact[r.query_id, r.vec_id] - r.score) < 1e-12 for r in got if (r.query_id, r.vec_id) in exact)


def test_awkward_vectors(spark):
    rng = np.random.default_rng(1)
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(60)]
    rows += [(100 + i, [5.0, 5.0, 5.0, 5.0]) for i in range(60)]  # one vector, many copies: ties to the smaller id
    rows += [(200, None), (201, []), (202, [0.0] * 4), (203, [1.0, None, 1.0, 1.0]), (204, [nan, 1.0, 1.0, 1.0]), (205, [inf, 1.0, 1.0, 1.0]), (220, [1.0, 2.0]), (221, [3.0, 1.0])]
    rows += [rows[0], rows[20], (100, rows[70][1])]
    table = spark.createDataFrame([(i, v, "clash") for i, v in rows], "vec_id long, embedding array<double>, dim string")
    asked = [(i, v) for i, v in rows if i % 20 == 0]
    got = search(table, table.filter(F.col("vec_id") % 20 == 0).dropDuplicates(["vec_id"]), 20).collect()
    assert recall(got, brute(rows, asked, 20), 20) >= 0.98
    assert search(table.limit(0), table.limit(0)).collect() == []


def test_an_id_with_several_vectors_is_one_candidate(spark):
    rng = np.random.default_rng(5)
    rows = [(i % 50, [float(x) for x in rng.normal(size=3)]) for i in range(400)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = [rows[0], rows[20], rows[40]]
    got = search(table, spark.createDataFrame(asked, "vec_id long, embedding array<double>"), 20).collect()
    for q, v in asked:
        best = {}
        for i, w in rows:
            if i != q:
                best[i] = max(best.get(i, -9e9), float(np.dot(v, w)))
        want = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:20]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert len(mine) == 20 and len({r.vec_id for r in mine}) == 20
        assert len({r.vec_id for r in mine} & {i for i, _ in want}) >= 18


def test_graph_recall_and_layers():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 16)) + 4 * rng.integers(0, 5, (3000, 1))
    graph = Graph.build(x)
    assert len(graph.layers) > 1 and graph.layers[0].shape[0] == 3000
    found = graph.search(x[::30], 128)
    exact = np.argsort(-(x[::30] @ x.T), axis=1)[:, :20]
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(exact, found)]) >= 0.9


def magnitudes(kind, n=2500, d=32):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "lognormal":
        return x * rng.lognormal(0, 0.5, size=(n, 1))
    if kind == "integers":
        return rng.integers(-3, 4, size=(n, 8)) + 0.0
    if kind == "clusters":
        return rng.normal(size=(30, d))[rng.integers(30, size=n)] + 0.1 * x
    x[5] *= {"one long": 1e4, "one far longer": 1e40}.get(kind, 1)
    return x * {"large": 1e20, "small": 1e-25, "largest": 1e150}.get(kind, 1)


@pytest.mark.parametrize("kind", ["unit", "one long", "large", "largest", "one far longer", "small", "lognormal", "integers", "clusters"])
def test_recall_at_any_magnitude(kind):
    x = magnitudes(kind)
    x = x[np.any(x != 0, axis=1)]
    q = x[::25]
    score = q @ x.T
    last = np.sort(score, axis=1)[:, -20]
    near = Bands.of(Bands.build(x).arrays()).search(q, 128, 42)
    hits = [min(20, (s[n[n >= 0]] >= least).sum()) for s, n, least in zip(score, near, last)]
    assert sum(hits) >= 0.95 * 20 * len(q) and min((n >= 0).sum() for n in near) >= 20


@pytest.mark.parametrize("scale", [1e20, 1e-25, 1e160])
def test_no_query_is_left_without_neighbours(spark, scale):
    rng = np.random.default_rng(9)
    rows = [(i, [float(c) * scale for c in rng.normal(size=6)]) for i in range(400)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = search(table, table.filter("vec_id % 20 = 0")).groupBy("query_id").count().collect()
    assert len(got) == 20 and all(r["count"] == 20 for r in got)


def test_a_layer_above_with_more_nodes_than_the_first_step():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(9500, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = Graph.build(x)
    assert len(graph.layers) > 1 and len(graph.layers[1]) > 512
    q = x[::100]
    best = np.argsort(-(q @ x.T), axis=1)[:, :20]
    got = graph.search(q, 128)
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(best, got)]) >= 0.95


@pytest.mark.parametrize("size", [1, 2, 3, 7, 100])
def test_a_graph_is_taken_in_once_and_queries_stream_past_it(monkeypatch, size):
    asked = []

    def nearest(graph, queries, k, width):
        got = [b.column("qid").to_pylist() for b in queries]
        assert all(got)
        asked.append((graph, sum(got, [])))
        yield from ()

    monkeypatch.setattr(ann, "_nearest", nearest)
    rows = [(b"a", None), (None, 1), (None, 2), (None, 3), (b"b", None), (b"c", None), (None, 4), (None, 5)]
    batch = pa.record_batch({"graph": pa.array([g for g, _ in rows], pa.binary()), "qid": pa.array([q for _, q in rows], pa.int64())})
    cut = [batch.slice(at, size) for at in range(0, len(rows), size)] + [batch.slice(0, 0)]
    assert list(ann._stream(20, 128)(iter(cut))) == []
    assert asked == [(b"a", [1, 2, 3]), (b"b", []), (b"c", [4, 5])]
    assert list(ann._stream(20, 128)(iter([]))) == []
