"""Substring search by lists of three-letter runs, written beside a table.

Each run of three letters of a row's fields is listed with the row's key and the part its row is stored in. A search reads
the lists of its rarest runs, keeps the keys that are in all of them, reads only those rows' parts, and then tests the rows
themselves. Lists lie in folders by a hash of the run and are sorted by it; a run that many rows hold is dealt over several
files by the rows' keys, so that no task holds it whole.

    <path>/rows/part=<n>/, <path>/lists/bucket=<n>/, <path>/runs/bucket=<n>/ (rows of each run)
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from larder.runtime import materialise

#: Letters of a run, folders of lists, files over which a run's list is dealt, runs that a search looks up.
RUN, BUCKETS, DEALT, LOOKED_UP = 3, 64, 8, 8


def runs(text: Column) -> Column:
    """The distinct runs of a text; none for null and texts that are too short."""
    starts = F.sequence(F.lit(1), F.length(text) - RUN + 1)
    cut = F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(RUN))))
    return F.when(F.length(text) >= RUN, cut).otherwise(F.array().cast("array<string>"))


class Trigrams:
    """``key``: a column that names a row. ``fields``: SQL expressions of the texts looked into, such as ``lower(name)``."""

    def __init__(self, spark: SparkSession, path: str, key: str, fields: list[str]):
        self.spark, self.path, self.key, self.fields = spark, path.rstrip("/"), key, fields

    @classmethod
    def write(cls, rows: DataFrame, key: str, fields: list[str], path: str, parts: int = BUCKETS) -> Trigrams:
        """Rows and lists of a table at a new path. Rows without a key can be found, too; no column may be named part."""
        if "part" in rows.columns:
            raise ValueError("no column may be named part")
        index = cls(rows.sparkSession, path, key, fields)
        dealt = rows.withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))

        def written(table: DataFrame, by: str, name: str) -> DataFrame:
            """What lies in the table's folders, read back, so that nothing is worked out or written twice."""
            table.write.option("compression", "zstd").partitionBy(by).parquet(f"{path}/{name}")
            out = rows.sparkSession.read.schema(table.schema).parquet(f"{path}/{name}")
            if out.isEmpty():  # its folders are missing, and with them its columns
                table.limit(0).write.mode("overwrite").parquet(f"{path}/{name}")
            return out

        placed = written(dealt.repartition(parts, "part").sortWithinPartitions("part", key), "part", "rows")
        held = reduce(F.array_union, [runs(F.expr(f)) for f in fields])
        lists = placed.select(F.explode(held).alias("run"), F.col(key).alias("key"), "part").withColumn("bucket", cls._bucket(F.col("run")))
        spread = lists.repartition("bucket", F.pmod(F.xxhash64("key"), F.lit(DEALT))).sortWithinPartitions("bucket", "run", "key")
        counts = written(spread, "bucket", "lists").groupBy("bucket", "run").agg(F.count("*").alias("rows"))
        written(counts.repartition("bucket").sortWithinPartitions("bucket", "run"), "bucket", "runs")
        return index

    @staticmethod
    def _bucket(run: Column) -> Column:
        return F.pmod(F.xxhash64(run), F.lit(BUCKETS)).cast("int")

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def rarest(self, tokens: list[str]) -> list[tuple[int, str, int]] | None:
        """(bucket, run, rows) of the rarest runs of the tokens, at most ``LOOKED_UP``; None where some run is in no row."""
        wanted = sorted({t[i : i + RUN] for t in tokens for i in range(len(t) - RUN + 1)})
        if not wanted:
            return []
        places = [r[0] for r in self.spark.createDataFrame([(w,) for w in wanted], "run string").select(self._bucket(F.col("run"))).collect()]
        found = self._read("runs").filter(F.col("bucket").isin(places) & F.col("run").isin(wanted)).collect()  # one row a run
        if len(found) < len(wanted):
            return None
        return sorted(((r["bucket"], r["run"], r["rows"]) for r in found), key=lambda r: (r[2], r[1]))[:LOOKED_UP]

    def candidates(self, tokens: list[str]) -> DataFrame:
        """The rows that hold the rarest runs of the tokens: all that hold the tokens, and maybe more. Tokens shorter than a
        run have no say; where none is longer these are all rows."""
        rows = self._read("rows")
        looked = self.rarest(tokens)
        if looked is None:
            return rows.limit(0).drop("part")
        if not looked:
            return rows.drop("part")
        lists = self._read("lists").filter(F.col("bucket").isin(sorted({b for b, _, _ in looked})) & F.col("run").isin([r for _, r, _ in looked]))
        # A key that several rows have may be listed for a run more than once.
        keys = lists.groupBy("key", "part").agg(F.count_distinct("run").alias("n")).filter(F.col("n") == len(looked)).select("key", "part")
        keys = materialise(keys, "trigram-keys")
        parts = [r[0] for r in keys.select("part").distinct().collect()]  # at most as many as the table has parts
        inside = rows.filter(F.col("part").isin(parts))
        same = inside[self.key].eqNullSafe(keys["key"]) & (inside["part"] == keys["part"])
        return inside.join(keys, same, "left_semi").drop("part")

    def search(self, tokens: list[str]) -> DataFrame:
        """The rows of which some field holds all the tokens. No token: all rows; an empty token is held by every text."""
        if not tokens:
            return self._read("rows").drop("part")
        holds = [F.coalesce(reduce(lambda a, b: a & b, [F.contains(F.expr(f), F.lit(t)) for t in tokens]), F.lit(False)) for f in self.fields]
        return self.candidates(tokens).filter(reduce(lambda a, b: a | b, holds))
