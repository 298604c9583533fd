"""MinHash near-duplicates with min-max hashing.

Each hash function gives two signature values, its minimum and its maximum over a text's shingles, so half the hash
evaluations fill a signature. Bands of the signature are keys; texts that share a key are candidates.

Texts with equal shingle sets are one class. In each bucket every class is compared with one centre, drawn by hash so
that buckets of one family have different centres; the links found are joined to components. What is left are pairs of one
bucket that no comparison has covered and that lie in different components: these, too, are compared, block by block,
so the components are those of all candidate pairs while no bucket is expanded into its pairs. All comparisons are on
full shingle sets.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from larder.llm.common import discard, give_back, materialise, own_worker, parts_of, prepare, sized
from larder.llm.components import components

#: The chance to miss a pair exactly at the threshold; sets the number of bands.
MISS = 1e-8
#: Rows, and shingles of all its rows, on one side of a block of comparisons.
BLOCK, BLOCK_SHINGLES = 256, 1 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)
SIG_SCHEMA = "doc_id long, n long, set_key binary, bands array<long>"
SET_SCHEMA = "rep long, set_key binary, shingles array<long>"


def plan_bands(percent: int) -> tuple[int, int]:
    """(bands, rows in each) for a threshold in percent: rows so that dissimilar texts rarely meet, bands for ``MISS``."""
    t = percent / 100
    rows = max(1, min(8, int(math.log(0.43) / math.log(t)))) if t < 1 else 8
    return (2 * math.ceil(math.log(MISS) / math.log(1 - t**rows) / 2) if t < 1 else 2), rows


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX
    return h ^ (h >> np.uint64(29))


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's k-word shingles, A-Z lower-cased, words split at ASCII white space.

    A text of fewer than k words has one shingle, the whole sequence; one without words has none.
    """
    if not len(texts):
        return []
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    coded = lists.flatten().cast(pa.binary()).dictionary_encode()
    codes, words = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False)
    there = np.fromiter(map(len, words), np.int64, len(words))[codes] > 0  # empty strings stand for white space at either end
    ends = np.concatenate([[0], np.cumsum(there)])[lists.offsets.to_numpy()]
    codes = codes[there]
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))[codes]
    n = max(0, len(h) - k + 1)
    acc = h[:n].copy()
    for i in range(1, k):
        acc = _mixed(acc) + h[i : i + n]
    acc = _mixed(acc)
    out = []
    for a, b in zip(ends.tolist(), ends[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(acc[a : b - k + 1]))
        else:
            out.append(np.array([xxhash.xxh64_intdigest(b" ".join(words[codes[a:b]]), seed=k)] if b > a else [], dtype=np.uint64))
    return out


class MinMax:
    """Signatures of ``bands * rows`` values from half as many hash functions, folded to one key per band."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows = bands, rows
        rng = np.random.default_rng(20_240_229)
        n = -(-bands * rows // 2)
        self.a = rng.integers(0, 1 << 32, (n, 1), dtype=np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, (n, 1), dtype=np.uint32)
        self.fold = rng.integers(0, 1 << 63, (1, rows), dtype=np.uint64) | np.uint64(1)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        low = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        high = np.zeros(len(self.a), np.uint32)
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(x), 2048):
            y = x[None, at : at + 2048] * self.a + self.b
            np.minimum(low, y.min(axis=1), out=low)
            np.maximum(high, y.max(axis=1), out=high)
        return np.stack([low, high], axis=1).ravel()[: self.bands * self.rows]

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        s = self.signature(shingles).reshape(self.bands, self.rows).astype(np.uint64)
        acc = (s * self.fold).sum(axis=1, dtype=np.uint64) + np.arange(self.bands, dtype=np.uint64) * MIX
        return _mixed(_mixed(acc)).view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    flat = np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _sign(k: int, bands: int, rows: int):
    def run(batches):
        own_worker("near_dedup")
        hashing = MinMax(bands, rows)
        for whole in batches:
            for b in parts_of(whole):
                sets = shingle_sets(b.column("text").cast(pa.string()), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                        _lists([hashing.keys(s) if len(s) else np.zeros(0, np.int64) for s in sets]),
                    ],
                    names=["doc_id", "n", "set_key", "bands"],
                )
        give_back()

    return run


def _sets(k: int):
    def run(batches):
        own_worker("near_dedup")
        for whole in batches:
            for b in parts_of(whole):
                sets = shingle_sets(b.column("text").cast(pa.string()), k)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), _lists(sets)], names=["rep", "set_key", "shingles"])
        give_back()

    return run


def _compare_blocks(percent: int):
    """Links between a bucket's residual members and its other members, for one block of each."""

    def run(table: pa.Table) -> pa.Table:
        rep, label, residual = (table.column(c).to_numpy() for c in ("rep", "label", "residual"))
        lists = table.column("shingles").combine_chunks()
        ends, flat = lists.offsets.to_numpy(), lists.flatten().to_numpy().view(np.uint64)
        flat, ends = flat[: ends[-1] - ends[0]], ends - ends[0]
        size = np.diff(ends)
        left, right = np.flatnonzero(residual), np.flatnonzero(~residual.astype(bool))
        out: list[tuple[int, int]] = []
        if len(left) and len(right):
            owner = np.repeat(np.arange(len(rep)), size)
            for i in left:
                mine = flat[ends[i] : ends[i + 1]]
                fits = (label != label[i]) & (100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i]))
                fits[left] = False
                some = np.flatnonzero(fits)
                if not len(some):
                    continue
                where = np.concatenate([np.arange(ends[j], ends[j + 1]) for j in some])
                at = np.searchsorted(mine, flat[where])
                hit = mine[np.minimum(at, len(mine) - 1)] == flat[where]
                both = np.bincount(owner[where], weights=hit, minlength=len(rep)).astype(np.int64)
                done = set()
                for j in some[100 * both[some] >= percent * (size[some] + size[i] - both[some])]:
                    if label[j] not in done:
                        done.add(label[j])
                        out.append((int(rep[i]), int(rep[j])))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return run


def _rest(occupied: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links among bucket members other than the centre that lie in different components so far.

    Of such a bucket the members outside its largest component are compared with all others, in blocks of at most about
    ``BLOCK`` rows and ``BLOCK_SHINGLES`` shingles on either side.
    """
    named = labels.select(F.col("id").alias("rep"), F.col("component").alias("label"))
    members = materialise(occupied.filter("rep <> centre").join(named, "rep", "left").select("key", "rep", F.coalesce("label", "rep").alias("label"), F.col("n").alias("weight")), "bucket-members")
    sizes = members.groupBy("key", "label").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))
    buckets = sizes.groupBy("key").agg(F.max(F.struct("n", "label", "weight")).alias("top"), F.sum("n").alias("all"), F.sum("weight").alias("weight"), F.count("*").alias("labels")).filter("labels > 1")
    blocks = lambda rows, shingles: F.ceil(F.greatest(rows / BLOCK, shingles / BLOCK_SHINGLES))
    rest_of = blocks(F.col("all") - F.col("top.n"), F.col("weight") - F.col("top.weight"))
    buckets = materialise(buckets.select("key", F.col("top.label").alias("main"), blocks(F.col("all"), F.col("weight")).alias("blocks"), rest_of.alias("rest_blocks")), "open-buckets")
    open_ = members.drop("weight").join(buckets, "key").withColumn("residual", F.col("label") != F.col("main"))
    own = F.xxhash64("rep")
    every = open_.select("key", "rep", "label", F.lit(False).alias("residual"), F.pmod(own, "blocks").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("rest_blocks") - 1)).alias("rest"))
    rest = open_.filter("residual").select("key", "rep", "label", "residual", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.pmod(own, "rest_blocks").alias("rest"))
    both = every.unionByName(rest.select(*every.columns)).join(sets, "rep")
    return both.groupBy("key", "block", "rest").applyInArrow(_compare_blocks(percent), "a long, b long").distinct()


def near_dedup(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * intersection >= percent * union of their k-word shingle sets; component_id is the
    smallest doc_id that links reach. A null or empty text, or one without words, has no shingles and no links. Repeated
    rows share their doc_id's component, and rows of one doc_id with different texts are one document that links what any
    of its texts links; n_shingles is each row's own. A null doc_id links with nothing and is kept. An empty table gives
    an empty result. Only doc_id and text are read.
    """
    prepare(docs.sparkSession)
    bands, rows = plan_bands(percent)
    slim = docs.select(F.col("doc_id").cast("long"), "text")
    signed = materialise(slim.mapInArrow(_sign(k, bands, rows), SIG_SCHEMA), "signatures")
    named = signed.filter("n > 0 and doc_id is not null")
    classes = materialise(
        named.groupBy("set_key", "n").agg(F.min(F.struct("doc_id", "bands")).alias("first"))
        .select("set_key", "n", F.col("first.doc_id").alias("rep"), F.col("first.bands").alias("bands")),
        "classes",
    )
    members = classes.select("rep", "n", F.explode("bands").alias("key"))
    centres = members.groupBy("key").agg(F.min(F.struct(F.xxhash64("key", "rep"), F.col("rep").alias("rep"), F.col("n").alias("n"))).alias("c"), F.count("*").alias("size")).filter("size > 1")
    # Written first: a join of two plain exchanges is one whose large partitions Spark can split.
    centres = materialise(centres.select("key", F.col("c.rep").alias("centre"), F.col("c.n").alias("centre_n")), "centres")
    occupied = materialise(members.join(centres, "key"), "buckets")
    near = occupied.filter("rep <> centre").filter(100 * F.least("n", "centre_n") >= percent * F.greatest("n", "centre_n"))
    pairs = near.select(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b")).distinct()
    wanted = materialise(occupied.select(F.col("rep").alias("doc_id")).distinct(), "occupants")
    sets = materialise(slim.join(sized(wanted), "doc_id", "left_semi").mapInArrow(_sets(k), SET_SCHEMA).dropDuplicates(["rep", "set_key"]).drop("set_key"), "shingle-sets")
    of = [sets.select(F.col("rep").alias(c), F.col("shingles").alias(f"s{c}")) for c in ("a", "b")]
    common = F.size(F.array_intersect("sa", "sb"))
    links = pairs.join(of[0], "a").join(of[1], "b").filter(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select("a", "b")
    links = materialise(links.unionByName(_own_links(named, classes)), "near-links")
    labels = components(links)
    more = materialise(_rest(occupied, labels, sets, percent), "more-links")
    if not more.isEmpty():
        labels = components(links.unionByName(more))
    for written in (centres, occupied, wanted, sets):
        discard(written)
    of_class = classes.select("set_key", "n", "rep").join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("set_key", "n", F.coalesce("component", "rep").alias("component"))
    out = signed.select("doc_id", "set_key", "n").join(of_class, ["set_key", "n"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _own_links(named: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of doc_ids that have several texts, by their representatives."""
    text = F.struct("set_key", "n")
    several = named.groupBy("doc_id").agg(F.min(text).alias("x"), F.max(text).alias("y")).filter("x <> y").select("doc_id")
    held = named.join(several, "doc_id", "left_semi").select("doc_id", "set_key", "n").join(classes.select("set_key", "n", "rep"), ["set_key", "n"])
    return held.filter("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
