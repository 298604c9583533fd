"""Exact deduplication by a tree-merge of sorted digest runs.

Every input partition writes sorted runs: of each text that occurs in it one entry, made of SHA-256 digest, byte length
and an independent 64-bit hash, with the best identifier and the number of its rows. Partitions then exchange runs in
binomial rounds: in round r the runs whose numbers agree but for the last ``BITS * (r + 1)`` bits meet, each cut at the
digests' first ``BITS * (r + 1)`` bits, so that every round has as many merges as there are runs and each merge is as long
as a run. A merge reads its runs in sorted order, keeps the best identifier of equal entries and sums their counts;
entries are equal only if digest, length and hash all agree, so that an identifier is verified at every level. A digest
held by a third of all rows is one entry of each run.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from larder.llm.common import discard, give_back, materialise, own_worker, prepare

#: Rows after which a run is written; a partition with more rows writes several runs.
RUN_ROWS = 100_000
#: Bits of run number and digest that one round settles: 2 ** BITS runs meet in a merge.
BITS = 3
KEY_BYTES = 48  # digest, length and hash, all in an order that sorts as bytes
ENTRY = np.dtype([("keep", "<i8"), ("named", "?"), ("run", "<i8"), ("n", "<i8")])
#: A member row holds one entry's identifiers, a segment row a sorted stretch of a run.
RUN_SCHEMA = "part int, seq int, key binary, ids array<long>, prefix int, keys binary, entries binary"
ROOT_SCHEMA = "key binary, keep_id long, win_run long, group_size long"


def key_of(text: bytes) -> bytes:
    return hashlib.sha256(text).digest() + len(text).to_bytes(8, "big") + xxhash.xxh64_digest(text)


def _best(keys: np.ndarray, entries: np.ndarray, largest: bool) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys (rows of bytes) with entries, each key once with its best entry and all its rows' number. A named row is
    better than one without an identifier, of equal identifiers the first run's counts."""
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]).any(axis=1)
    group = np.cumsum(new) - 1
    worth = entries["keep"] if largest else -entries["keep"]
    order = np.lexsort((-entries["run"], np.where(entries["named"], worth, 0), entries["named"], group))
    last = order[np.append(np.flatnonzero(np.diff(group)), len(group) - 1)] if len(group) else order
    out = entries[last]
    out["n"] = np.add.reduceat(entries["n"], np.flatnonzero(new)) if len(group) else 0
    return keys[new], out


def _cut(keys: np.ndarray, entries: np.ndarray, bits: int) -> list[tuple[int, bytes, bytes]]:
    """A sorted run cut where the digest's first ``bits`` bits change: (those bits, keys, entries)."""
    first = (keys[:, :4].copy().view(">u4")[:, 0] >> np.uint32(32 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(first)) + 1).tolist(), len(keys)]
    return [(int(first[a]), keys[a:b].tobytes(), entries[a:b].tobytes()) for a, b in zip(cuts, cuts[1:]) if b > a]


def _rows(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, KEY_BYTES)


def merge(runs: list[tuple[bytes, bytes]], largest: bool) -> tuple[np.ndarray, np.ndarray]:
    """Sorted runs (keys, entries) merged to one. The stable sort finds the runs in the row of keys and merges them."""
    keys, entries = _rows([k for k, _ in runs]), np.frombuffer(b"".join(e for _, e in runs), ENTRY)
    order = np.argsort(np.ascontiguousarray(keys).view(f"S{KEY_BYTES}")[:, 0], kind="stable")
    return _best(keys[order], entries[order], largest)


def _make_runs(largest: bool, run_rows: int):
    def run(batches):
        from pyspark import TaskContext

        own_worker("exact_dedup")
        part, seq, held = TaskContext.get().partitionId(), 0, 0
        found: dict[bytes, list] = {}

        def written():
            keys = sorted(found)
            ids = [found[k] for k in keys]
            entries = np.zeros(len(keys), ENTRY)
            named = [[i for i in x if i is not None] for x in ids]
            entries["named"] = [bool(x) for x in named]
            entries["keep"] = [(max(x) if largest else min(x)) if x else 0 for x in named]
            entries["n"] = [len(x) for x in ids]
            for at in range(0, len(keys), 20_000):
                some = keys[at : at + 20_000]
                yield _run_batch(part, seq, some, ids[at : at + 20_000], [])
            yield _run_batch(part, seq, [], [], _cut(_rows(keys), entries, BITS))
            found.clear()

        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for i, text in zip(batch.column("doc_id").to_pylist(), texts):
                found.setdefault(key_of(text.as_py() or b""), []).append(i)
            held += batch.num_rows
            if held >= run_rows:
                yield from written()
                seq, held = seq + 1, 0
        if found:
            yield from written()
        give_back()

    return run


def _run_batch(part: int, seq: int, keys: list[bytes], ids: list[list], segments: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
    n, none = len(keys) + len(segments), [None]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int32()), pa.array(keys + none * len(segments), pa.binary()), pa.array(ids + none * len(segments), pa.list_(pa.int64())),
            pa.array(none * len(keys) + [s[0] for s in segments], pa.int32()), pa.array(none * len(keys) + [s[1] for s in segments], pa.binary()), pa.array(none * len(keys) + [s[2] for s in segments], pa.binary()),
        ],
        names=["part", "seq", "key", "ids", "prefix", "keys", "entries"],
    )


def _merge_round(largest: bool, bits: int):
    """One merge: all segments of one group of runs and one prefix, cut for the next round at ``bits`` bits."""

    def run(table: pa.Table) -> pa.Table:
        cut = _cut(*merge(list(zip(table.column("keys").to_pylist(), table.column("entries").to_pylist())), largest), bits)
        return pa.table({"run": pa.array([table.column("run")[0].as_py() >> BITS] * len(cut), pa.int64()), "prefix": pa.array([c[0] for c in cut], pa.int32()), "keys": pa.array([c[1] for c in cut], pa.binary()), "entries": pa.array([c[2] for c in cut], pa.binary())})

    return run


def _number(batches):
    """Writes every run's own number into its entries."""
    for b in batches:
        filled = []
        for number, entries in zip(b.column("run").to_pylist(), b.column("entries").to_pylist()):
            e = np.frombuffer(entries, ENTRY).copy()
            e["run"] = number
            filled.append(e.tobytes())
        yield pa.RecordBatch.from_arrays([b.column("run"), b.column("prefix"), b.column("keys"), pa.array(filled, pa.binary())], names=["run", "prefix", "keys", "entries"])


def _entries(batches):
    for b in batches:
        for keys, entries in zip(b.column("keys").to_pylist(), b.column("entries").to_pylist()):
            e = np.frombuffer(entries, ENTRY)
            yield pa.RecordBatch.from_arrays(
                [pa.array([keys[i : i + KEY_BYTES] for i in range(0, len(keys), KEY_BYTES)], pa.binary()), pa.array(e["keep"], mask=~e["named"]), pa.array(e["run"]), pa.array(e["n"])],
                names=["key", "keep_id", "win_run", "group_size"],
            )


def merge_rounds(segments: DataFrame, runs: int, largest: bool) -> DataFrame:
    """(key, keep_id, win_run, group_size) of all texts, from segments (run, prefix, keys, entries) of ``runs`` runs, cut at
    ``BITS`` bits."""
    schema = "run long, prefix int, keys binary, entries binary"
    level, left, bits = segments.mapInArrow(_number, schema), runs, BITS
    while left > 1:
        left = -(-left // (1 << BITS))
        bits = min(bits + BITS, 30) if left > 1 else bits
        met = level.groupBy(F.shiftright("run", BITS).alias("meets"), F.col("prefix").alias("of"))
        before, level = level, materialise(met.applyInArrow(_merge_round(largest, bits), schema), "merged-runs")
        discard(before)
    return level.mapInArrow(_entries, ROOT_SCHEMA)


def exact_dedup(docs: DataFrame, keep: str = "largest", run_rows: int = RUN_ROWS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their UTF-8 bytes are; a null text counts as empty. Of equal texts the row with the largest (or
    smallest) doc_id stays; a null doc_id stays only if no other has one; of repeated rows with that doc_id exactly one
    stays. An empty table gives an empty result. Only doc_id and text are read, so other columns may have any name.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError("keep: largest or smallest")
    prepare(docs.sparkSession)
    largest = keep == "largest"
    runs = materialise(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_make_runs(largest, run_rows), RUN_SCHEMA), "digest-runs")
    parts, seqs = runs.agg(F.max("part"), F.max("seq")).first()
    parts, seqs = (parts or 0) + 1, (seqs or 0) + 1
    number = (F.col("seq").cast("long") * parts + F.col("part")).alias("run")
    root = merge_rounds(runs.filter("key is null").select(number, "prefix", "keys", "entries"), parts * seqs, largest)
    joined = runs.filter("key is not null").select("key", number, "ids").join(root, "key")
    first = F.when(F.col("keep_id").isNull(), F.lit(0)).otherwise(F.array_position("ids", F.col("keep_id")).cast("int") - 1)
    return joined.select("*", first.alias("first")).select(
        F.posexplode("ids").alias("pos", "doc_id"), "keep_id", "group_size", "run", "win_run", "first", F.lower(F.hex(F.substring("key", 1, 32))).alias("text_sha256")
    ).select("doc_id", "keep_id", "group_size", ((F.col("run") == F.col("win_run")) & (F.col("pos") == F.col("first"))).alias("kept"), "text_sha256")
