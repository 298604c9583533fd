import pyarrow as pa
from pyspark import cloudpickle

from larder.llm import bpe, common, near_dedup, packing
from larder.llm.queries import BPE_TOKENIZER, PACK_TOKENIZER, tokenizer_path


def test_a_worker_lets_go_of_other_operators_caches():
    gone = []
    common._OWNER.clear()
    common.own_worker("a", lambda: gone.append("a"))
    common.own_worker("a", lambda: gone.append("a"))
    assert gone == []
    common.own_worker("b")
    assert gone == ["a"]
    common.own_worker("a", lambda: gone.append("a"))
    assert gone == ["a"]
    common._OWNER.clear()


def test_a_full_generation_gives_way_and_what_is_used_comes_back():
    cache = common.Generations(common.Generations.ENTRY + 10)
    cache.add(["x", "y"], [b"1", b"2"])
    cache.make_room()
    assert dict(cache) == {} and cache.missing({"x", "z"}) == {"z"} and dict(cache) == {"x": b"1"}
    cache.add(["z"], [b"3"])
    cache.make_room()
    assert cache.old == {"x": b"1", "z": b"3"} and cache.missing({"y"}) == {"y"}


def test_slices_are_bounded_by_bytes_and_whole():
    texts = ["ab" * 40, None, "", "c" * 500, "d", "é" * 30] * 20
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    parts = list(common.parts_of(batch, most=600))
    assert pa.Table.from_batches(parts).to_pylist() == batch.to_pylist()
    assert all(sum(len((t or "").encode()) for t in p.column("text").to_pylist()) <= 1200 for p in parts) and len(parts) > 5
    assert list(common.parts_of(batch.slice(0, 0))) == []


def test_tasks_carry_no_caches():
    words, automaton = tokenizer_path(PACK_TOKENIZER), tokenizer_path(BPE_TOKENIZER)
    packing.encoder(words)
    bpe.model(automaton)
    near_dedup.shingle_sets(pa.array(["some words " * 50]), 3)
    for task in (packing._tokenise(words, 1), bpe._round_trip(automaton), near_dedup._sign(3, 4, 4), near_dedup._sets(3)):
        assert len(cloudpickle.dumps(task)) < 20_000


def test_ranks_are_gapless_over_partitions(spark):
    rows = spark.range(1000).selectExpr("id % 97 as k", "id").repartition(7)
    ranked, n = common.with_rank(common.in_order(rows, ["k", "id"], "ranks"))
    got = sorted((r["rank"], r["k"], r["id"]) for r in ranked.collect())
    assert n == 1000 and [g[0] for g in got] == list(range(1000)) and [g[1:] for g in got] == sorted(g[1:] for g in got)
    empty, n = common.with_rank(common.in_order(rows.limit(0), ["k"], "ranks"))
    assert n == 0 and empty.collect() == []


def test_only_the_bytes_of_a_batch_are_bounded(spark):
    rows = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    common.prepare(spark)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == rows
    spark.conf.set(common.BATCH_BYTES, "1000")
    common.prepare(spark)
    assert spark.conf.get(common.BATCH_BYTES) == "1000"
    spark.conf.unset(common.BATCH_BYTES)
    common.prepare(spark)
    seen = spark.range(0, 400, 1, 1).selectExpr("id", "repeat('x', 20000) t").mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in bs), "n long").collect()
    assert len(seen) > 2 and max(r.n for r in seen) < 2 * common.PART_BYTES
