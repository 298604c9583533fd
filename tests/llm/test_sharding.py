import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from larder.llm.sharding import curve_table, hilbert_index, hilbert_shards, string_key
from tests.llm.helpers import DOCS, awkward, documents


def test_curve_visits_every_cell_by_unit_steps(spark):
    for dims, bits in ((2, 3), (3, 2), (4, 1)):
        side = 1 << bits
        grid = spark.range(side**dims).select(*[((F.col("id") / side**k).cast("int") % side).alias(f"c{k}") for k in range(dims)])
        rows = grid.select("*", hilbert_index([F.col(f"c{k}") for k in range(dims)], bits).alias("h")).collect()
        at = {r.h: [r[f"c{k}"] for k in range(dims)] for r in rows}
        assert sorted(at) == list(range(side**dims))
        assert all(sum(abs(a - b) for a, b in zip(at[h], at[h + 1])) == 1 for h in range(side**dims - 1))
    assert len(curve_table(4)) == 4 * 16 * 16


def check(docs, shards):
    want = Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    got = hilbert_shards(docs, shards).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        assert r.law == "rows" and r.grown_shard is None
        slots[r.shard].append(r.slot)
    counts = [len(slots[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1 and set(slots) <= set(range(shards))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    return got


def test_documents_keep_copies_together_but_at_cuts(spark):
    got = check(documents(spark), 24)
    groups = defaultdict(set)
    for r in got:
        groups[r.text_crc32, r["size"]].add(r.shard)
    assert sum(max(s) - min(s) > 1 for s in groups.values()) == 0
    assert sum(len(s) > 1 for s in groups.values()) < 24


def test_curve_prunes_sources(spark):
    got = hilbert_shards(documents(spark), 24).join(documents(spark).select("doc_id", "lang"), "doc_id")
    langs = got.groupBy("shard").agg(F.countDistinct("lang").alias("n")).agg(F.avg("n")).first()[0]
    assert langs < 3


def test_awkward_and_empty(spark):
    check(awkward(spark), 24)
    check(awkward(spark), 2)
    assert hilbert_shards(spark.createDataFrame([], DOCS)).collect() == []


def test_string_key_keeps_order(spark):
    words = ["", "a", "ab", "b", "é", "zzzzzzzz", None]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", string_key(F.col("w")).alias("k")).collect()
    assert [r.w for r in sorted(rows, key=lambda r: r.k)] == [None, *words[:-1][:4], "zzzzzzzz", "é"]
