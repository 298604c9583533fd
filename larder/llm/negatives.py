"""Hard negatives by distributed radix selection.

An anchor's positives are its nearest rows of the same label; a positive's negatives are the best rows of other labels whose
score lies in a window below the positive's. Scores are integers, so the k-th of a window is found without sorting or moving
it: every task counts its rows by one digit of their distance from the window's top, the counts are added, the digit in
which the k-th row lies is fixed, and the next digit is counted among the rows that share those found. At last only the rows
above the k-th score are gathered, and of those with that score the ones of the smallest ids.

All rows are read by every block of anchors, where they lie and without a shuffle; anchors go to the tasks in blocks of a
bounded size, and counts of a bounded number of windows come back.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from larder.llm.common import materialise, prepare
from larder.runtime import scratch_path

#: Anchors of a block, and bytes of their vectors; rows that are scored at once.
BLOCK_ANCHORS, BLOCK_BYTES, ROWS = 4096, 8 << 20, 512
#: Bits of a digit.
DIGIT = 7
NONE = np.int64(1) << 62


@dataclass(frozen=True)
class Block:
    """Anchors, and for each and each of its positives (a window): the score at the top, the greatest distance from it (-1:
    empty), the digits found so far as one number, and how many rows are still to be found."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    exact: bool  # whether scores are exact as doubles
    top: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.int64))
    width: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.int64))
    found: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.int64))
    need: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.int64))


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, label, vec, dim) of the rows (vec_id, label, vector) that take part; ``vec`` holds whole numbers.

    Rows with a null vec_id, label or vector, or any null or non-finite component, take no part, nor do those of a component
    so large that a score could leave 64 bits. Of rows with one vec_id the first by label and vector stays.
    """
    whole = F.transform("vector", lambda x: F.floor(F.lit(256) * x.cast("double")))
    fine = F.forall("vector", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    kept = rows.filter("vec_id is not null and label is not null and vector is not null").filter(fine & (F.size("vector") > 0))
    kept = kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), whole.alias("vec"), F.size("vector").alias("dim"))
    most = F.floor(F.sqrt(F.lit(float(NONE)) / F.col("dim")))
    kept = kept.filter(F.forall("vec", lambda x: F.abs(x.cast("double")) <= most))
    twice = materialise(kept.groupBy("vec_id").agg(F.count("*").alias("n")).filter("n > 1").select("vec_id"), "repeated-ids")
    first = kept.join(twice, "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct("label", "vec", "dim")).alias("r")).select("vec_id", "r.*")
    return materialise(kept.join(twice, "vec_id", "left_anti").unionByName(first), "negative-rows")


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    lists = batch.column("vec")
    return lists.flatten().to_numpy().reshape(len(lists), -1)


def _scores(block: Block, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, scores by row and anchor) of some rows at a time."""
    kind = np.float64 if block.exact else np.int64
    right = np.ascontiguousarray(block.vectors.T.astype(kind))
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            batch = whole.slice(at, ROWS)
            yield batch.column("vec_id").to_numpy(), batch.column("label").to_numpy(), (_vectors(batch).astype(kind) @ right).astype(np.int64)


def _first(group: np.ndarray, worse: np.ndarray, ids: np.ndarray, most: int | np.ndarray) -> np.ndarray:
    """Places of the first ``most`` of each group by ``worse``, then id."""
    order = np.lexsort((ids, worse, group))
    group = group[order]
    new = np.r_[True, group[1:] != group[:-1]] if len(group) else np.zeros(0, bool)
    place = np.arange(len(group)) - np.maximum.accumulate(np.where(new, np.arange(len(group)), 0))
    return order[place < (most[group] if isinstance(most, np.ndarray) else most)]


def _batch(names: str, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=names.split())


def _positives(block, most: int):
    def run(batches):
        b = block.value
        held = [np.zeros(0, np.int64)] * 3  # anchor's place, -score, vec_id
        for ids, labels, score in _scores(b, batches):
            # A row that is not among an anchor's first in its slice is not among them at all.
            row, anchor = np.nonzero((labels[:, None] == b.labels) & (ids[:, None] != b.ids))
            less = -score[row, anchor]
            mine = _first(anchor, less, ids[row], most)
            held = [np.concatenate(x) for x in zip(held, (anchor[mine], less[mine], ids[row[mine]]))]
            best = _first(*held, most)
            held = [x[best] for x in held]
        yield _batch("anchor score vec_id", held[0], -held[1], held[2])

    return run


def _in_windows(b: Block, batches, shift: int):
    """(window, distance, vec_id) of the rows of other labels in a window whose distance begins with the digits found."""
    valid = b.width >= 0
    low, high = np.where(valid, b.top - b.width, NONE).min(axis=1), np.where(valid, b.top, -NONE).max(axis=1)
    for ids, labels, score in _scores(b, batches):
        row, anchor = np.nonzero((score >= low) & (score <= high) & (labels[:, None] != b.labels))
        value = score[row, anchor]
        for j in range(b.top.shape[1]):
            away = b.top[anchor, j] - value
            hit = np.flatnonzero((away >= 0) & (away <= b.width[anchor, j]) & (away >> shift == b.found[anchor, j]) if shift >= 0 else (away >= 0) & (away <= b.found[anchor, j]))
            yield anchor[hit] * b.top.shape[1] + j, away[hit], ids[row[hit]]


def _count(block, shift: int):
    def run(batches):
        b = block.value
        counts = np.zeros(b.top.size << DIGIT, np.int64)
        for window, away, _ in _in_windows(b, batches, shift + DIGIT):
            np.add.at(counts, (window << DIGIT) + ((away >> shift) & ((1 << DIGIT) - 1)), 1)
        some = np.flatnonzero(counts)
        yield _batch("window digit n", some >> DIGIT, some & ((1 << DIGIT) - 1), counts[some])

    return run


def _gather(block, most: int):
    def run(batches):
        b = block.value
        held = [np.zeros(0, np.int64)] * 3
        for found in _in_windows(b, batches, -1):
            held = [np.concatenate(x) for x in zip(held, found)]
            best = _first(*held, most)  # only rows of the k-th score can be more than that
            held = [x[best] for x in held]
        yield _batch("window away vec_id", *held)

    return run


def _selected(rows: DataFrame, block: Block, most: int, send) -> Block:
    """The block with ``found``, each window's distance of its row number ``most``, or its width where it has fewer rows."""
    width = int(block.width.max(initial=0))
    digits = max(1, -(-width.bit_length() // DIGIT))
    block = replace(block, found=np.zeros_like(block.top), need=np.where(block.width >= 0, most, 0))
    for d in reversed(range(digits)):
        counts = rows.mapInArrow(_count(send(block), d * DIGIT), "window long, digit long, n long").groupBy("window", "digit").agg(F.sum("n").alias("n"))
        need = rows.sparkSession.createDataFrame(_table(window=np.arange(block.top.size), need=block.need.ravel()))
        run = F.sum("n").over(Window.partitionBy("window").orderBy("digit"))
        reached = counts.withColumn("run", run).join(need, "window").filter("run >= need and run - n < need")
        at = reached.select("window", "digit", (F.col("need") - F.col("run") + F.col("n")).alias("need")).toArrow()
        window, digit, left = (at.column(c).to_numpy() for c in ("window", "digit", "need"))
        found, rest = np.full(block.top.size, -1, np.int64), np.zeros(block.top.size, np.int64)
        found[window], rest[window] = (block.found.ravel()[window] << DIGIT) + digit, left
        # Windows of too few rows are wholly taken; they count no more digits.
        block = replace(block, found=found.reshape(block.top.shape), need=rest.reshape(block.top.shape))
    return replace(block, found=np.where(block.found >= 0, block.found, block.width))


def _table(**columns: np.ndarray) -> pa.Table:
    return pa.table({k: pa.array(v.astype(np.int64)) for k, v in columns.items()})


def _mine_block(rows: DataFrame, block: Block, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    spark, sent = rows.sparkSession, []

    def send(b: Block):
        sent.append(spark.sparkContext.broadcast(b))
        return sent[-1]

    by = Window.partitionBy("anchor").orderBy(F.desc("score"), "vec_id")
    near = rows.mapInArrow(_positives(send(block), positives), "anchor long, score long, vec_id long").withColumn("place", F.row_number().over(by)).filter(F.col("place") <= positives)
    near = near.toArrow()  # at most so many for each anchor of the block
    anchor, place, score, ids = (near.column(c).to_numpy() for c in ("anchor", "place", "score", "vec_id"))
    top, width = np.zeros((len(block.ids), positives), np.int64), np.full((len(block.ids), positives), -1, np.int64)
    bounds = [(int(s) * low, int(s) * high) for s in score]
    top[anchor, place - 1] = [b // 100 for _, b in bounds]
    width[anchor, place - 1] = [max(b // 100 - -(-a // 100), -1) for a, b in bounds]
    block = _selected(rows, replace(block, top=top, width=width), negatives, send)
    got = rows.mapInArrow(_gather(send(block), negatives), "window long, away long, vec_id long")
    got = got.withColumn("rank", F.row_number().over(Window.partitionBy("window").orderBy("away", "vec_id"))).filter(F.col("rank") <= negatives)
    known = spark.createDataFrame(_table(window=anchor * positives + place - 1, anchor_id=block.ids[anchor], positive_id=ids, positive_score=score, top=top[anchor, place - 1]))
    return got.join(F.broadcast(known), "window").select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", (F.col("top") - F.col("away")).alias("negative_score"))


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """For each anchor and each of its first ``positives`` other rows of its label, the first ``negatives`` rows of other
    labels whose score is from ``low`` to ``high`` hundredths of the positive's: anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score.

    ``rows`` has vec_id, label and vector; ``anchor`` is a condition on vec_id. A score is the inner product of the
    components' floor(256 * x). Higher scores come first, ties by smaller vec_id; vectors meet only others of their length.
    What takes no part is told by ``usable``. Empty tables, and windows without rows, give no rows.
    """
    spark = rows.sparkSession
    prepare(spark)
    base = usable(rows)
    path = scratch_path(spark, "hard-negatives")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], schema).write.parquet(f"{path}/block=none")
    asked = base.filter(anchor)
    number = 0
    for dim, n in asked.groupBy("dim").agg(F.count("*")).collect():  # one row for each length of vectors
        own = base.filter(F.col("dim") == dim)
        largest = own.agg(F.max(F.array_max(F.transform("vec", F.abs)))).first()[0]
        blocks = -(-n // min(BLOCK_ANCHORS, max(1, BLOCK_BYTES // (8 * dim))))
        for i in range(blocks):
            mine = asked.filter((F.col("dim") == dim) & (F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i)).select("vec_id", "label", "vec").toArrow().combine_chunks()
            if not mine.num_rows:
                continue
            order = np.argsort(mine.column("vec_id").to_numpy())
            batch = mine.to_batches()[0]
            block = Block(batch.column("vec_id").to_numpy()[order], batch.column("label").to_numpy()[order], _vectors(batch)[order], dim * largest**2 < 1 << 53)
            _mine_block(own, block, positives, negatives, low, high).write.parquet(f"{path}/block={number}")
            number += 1
    return spark.read.schema(schema).parquet(path).select(*[c.split()[0] for c in schema.split(", ")])
