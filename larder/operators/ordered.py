"""Tables written in an order, read page by page: a page costs the same however far in it lies.

Rows lie in parts by ranges of the order, each part's rows sorted and numbered, and a directory has one row for each part: its
first key and its number of rows. A page by number is found by the prefix sums of those numbers, a page after a row by the
first keys or by that row's place, so that only the parts a page lies in are read, and of these the rows by their place. Only
a place tells rows apart that are equal in every column.

    <path>/rows/part=<n>/part-...
    <path>/directory/part-...
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

from larder.runtime import in_order, discard, prefix_sums


def _name(key: str) -> str:
    return key.removeprefix("-")


def _sort(key: str) -> Column:
    return F.desc(_name(key)) if key.startswith("-") else F.asc(key)


class Place(NamedTuple):
    """Where a row lies: in the order of places, rows are in the table's order."""

    part: int
    place: int


class Ordered:
    """``keys``: column names, a minus before those in descending order. Nulls count as smallest. Rows with the same keys must be
    equal in every column."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str]):
        self.path, self.keys = path.rstrip("/"), keys
        self.directory = spark.read.parquet(f"{self.path}/directory")
        self.schema = spark.read.parquet(f"{self.path}/rows").schema
        self.spark = spark
        #: One (part, rows) for each part.
        self.counts = sorted((r["part"], r["rows"]) for r in self.directory.select("part", "rows").collect())

    @classmethod
    def write(cls, rows: DataFrame, keys: list[str], path: str) -> Ordered:
        """``rows`` in order at a new path. ValueError where two different rows have one key, so that their order is open, or a
        column is named part, place or mid."""
        names, spark = [_name(k) for k in keys], rows.sparkSession
        if clash := {"part", "place", "mid"} & set(rows.columns):
            raise ValueError(f"no column may be named {', '.join(sorted(clash))}")
        placed = in_order(rows, [_sort(k) for k in keys], "ordered")
        if rest := [c for c in rows.columns if c not in names]:
            other = F.struct(*rest)
            if not placed.groupBy(*names).agg(F.min(other).alias("a"), F.max(other).alias("b")).filter(~F.col("a").eqNullSafe(F.col("b"))).isEmpty():
                raise ValueError(f"not unique: {', '.join(names)}")
        numbered = placed.withColumns({"part": F.shiftright("mid", 33).cast("int"), "place": F.col("mid").bitwiseAND(F.lit((1 << 33) - 1))}).drop("mid")
        # The parts stay as they were written: each is read and written by tasks of its own, without another shuffle.
        numbered.sortWithinPartitions("part", "place").write.option("compression", "zstd").partitionBy("part").parquet(f"{path}/rows")
        first = F.min_by(F.struct(*names), "place").alias("first")
        numbered.groupBy("part").agg(first, F.count("*").alias("rows")).coalesce(1).write.parquet(f"{path}/directory")
        if numbered.isEmpty():  # an empty table has no folder of a part
            numbered.drop("part").write.mode("overwrite").parquet(f"{path}/rows")
        discard(placed)
        return cls(spark, path, keys)

    def _parts(self, parts: list[int]) -> DataFrame:
        """The rows of some parts, with part and place."""
        if not parts:
            return self.spark.createDataFrame([], self.schema).withColumn("part", F.lit(0))
        return self.spark.read.schema(self.schema).option("basePath", f"{self.path}/rows").parquet(*[f"{self.path}/rows/part={p}" for p in parts])

    @property
    def total(self) -> int:
        return sum(n for _, n in self.counts)

    @staticmethod
    def place_of(row: Row) -> Place:
        """The place of a row that was read with ``placed``."""
        return Place(row["part"], row["place"])

    def page(self, number: int, size: int, placed: bool = False) -> DataFrame:
        """Page ``number``, from 0, in order; empty beyond the end. Rows of other places are not read from the files. With
        ``placed`` the rows keep part and place."""
        begin, end, base = number * size, (number + 1) * size, prefix_sums(self.counts)
        touched = [p for p, n in self.counts if base[p] < end and base[p] + n > begin]
        inside = [(F.col("part") == p) & (F.col("place") >= begin - base[p]) & (F.col("place") < end - base[p]) for p in touched]
        rows = self._parts(touched).filter(reduce(lambda a, b: a | b, inside, F.lit(False)))
        top = rows.orderBy("part", "place").limit(size)
        return top if placed else top.drop("part", "place")

    def _beyond(self, last: tuple, column) -> Column:
        """Whether a row comes after the one with the keys ``last``; ``column`` gives a key's column by its name."""
        out, same = F.lit(False), F.lit(True)
        for key, value in zip(self.keys, last, strict=True):
            c = column(_name(key))
            v = F.lit(value)
            if key.startswith("-"):
                after = F.lit(False) if value is None else c.isNull() | (c < v)
            else:
                after = c.isNotNull() if value is None else F.coalesce(c > v, F.lit(False))
            out, same = out | (same & after), same & c.eqNullSafe(v)
        return out

    def after(self, last: Place | tuple | None, size: int, where: Column | None = None, placed: bool = False) -> DataFrame:
        """The first ``size`` rows after the one at the place ``last``, or after all with the keys ``last`` (None: from the start),
        of those that meet ``where``. With ``placed`` the rows keep part and place.

        Parts are read from the one in which that row lies, or would lie: without ``where`` as many as hold ``size`` rows more,
        with it one, then two, four and so on until enough rows are found.
        """
        first = self.counts[0][0] if self.counts else 0
        if isinstance(last, Place):
            first = last.part
        elif last is not None:
            found = self.directory.filter(~self._beyond(last, lambda k: F.col("first")[k])).agg(F.max("part")).first()[0]
            first = first if found is None else found
        rest = [(p, n) for p, n in self.counts if p >= first]
        step, at = 1, 0
        while True:
            if where is None:
                held = 0
                for at, (_, n) in enumerate(rest, 1):
                    held += n if at > 1 or last is None else 0  # of that row's own part any number may lie before it
                    if held >= size:
                        break
            else:
                at = min(len(rest), at + step)
                step *= 2
            rows = self._parts([p for p, _ in rest[:at]])
            if isinstance(last, Place):
                rows = rows.filter((F.col("part") > last.part) | (F.col("place") > last.place))
            elif last is not None:
                rows = rows.filter(self._beyond(last, F.col))
            if where is not None:
                rows = rows.filter(where)
            top = rows.orderBy("part", "place").limit(size)
            if where is None or at >= len(rest) or top.count() >= size:
                return top if placed else top.drop("part", "place")
