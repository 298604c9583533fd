"""Shared helpers of the operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from larder.runtime import discard, in_order, materialise, prefix_sums, ship, with_rank  # noqa: F401  the operators take them from here

#: Bytes of text that an operator works on at once in a Python worker, and of an Arrow batch sent to it.
PART_BYTES = 2 << 20
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

#: Rows of a table of narrow keys that may be broadcast; some tens of MB at most.
BROADCAST_ROWS = 400_000

_OWNER: dict[str, Callable[[], None]] = {}


def own_worker(name: str, clear: Callable[[], None] | None = None) -> None:
    """To be called where an operator's task starts in a Python worker: workers serve one operator after another, so what
    another one keeps there is let go and its memory given back. ``clear`` lets go of this operator's own caches."""
    others = [o for o in _OWNER if o != name]
    for other in others:
        _OWNER.pop(other)()
    _OWNER[name] = clear or (lambda: None)
    if others:
        gc.collect()
        give_back()


def give_back() -> None:
    """Return a worker's freed memory to the system: where its task ends, so that an idle worker holds its caches alone."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def prepare(spark: SparkSession) -> None:
    """Send the package to the workers, and lower the session's bound on the bytes of an Arrow batch to ``PART_BYTES``:
    several copies of a batch are held at once on either side. The bound is by bytes, so it costs other work little."""
    ship(spark)
    now = spark.conf.get(BATCH_BYTES).lower().removesuffix("b")
    if not now.isdigit() or int(now) > PART_BYTES:
        spark.conf.set(BATCH_BYTES, str(PART_BYTES))


def sized(keys: DataFrame) -> DataFrame:
    """A materialised table of narrow keys, one side of a join with whole texts: sent to every task where it has at most
    ``BROADCAST_ROWS`` rows, so that no text is shuffled, else hashed within a join of two exchanges."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys.hint("shuffle_hash")


def parts_of(batch: pa.RecordBatch, column: str | int = "text", most: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of a column, one row at least, so that what is made of a slice is
    bounded however long the texts of a batch are."""
    size = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size, dtype=np.int64) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(size)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


class Generations(dict):
    """A cache in two generations of at most ``most`` bytes each: a full young one becomes the old one, and what is found
    there moves back. Keys and values are bytes or strings."""

    #: Bytes that an entry takes besides what its key and value hold.
    ENTRY = 200

    def __init__(self, most: int):
        super().__init__()
        self.most, self.held, self.old = most, 0, {}

    def add(self, keys, values) -> None:
        self.update(zip(keys, values))
        self.held += sum(map(len, keys)) + sum(map(len, values)) + self.ENTRY * len(keys)

    def missing(self, keys: set) -> set:
        """The keys that neither generation holds; those of the old one move to the young one."""
        new = keys.difference(self)
        back = [k for k in new if k in self.old] if self.old else []
        if back:
            self.add(back, [self.old[k] for k in back])
            new.difference_update(back)
        return new

    def make_room(self) -> None:
        """To be called before keys are asked for and added."""
        if self.held > self.most:
            self.old = dict(self)
            self.clear()
            self.held = 0
