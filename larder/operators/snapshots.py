"""Tables as snapshots: rows dealt into buckets by their keys, and one manifest that names each bucket's folder.

A change writes new folders beside the old ones, only for the buckets that its keys touch, and publishes all its tables by one
manifest that appears at once under the next number. Until then, and if anything fails before, readers see the snapshot they
had; of two changes made from one snapshot the second is refused. A manifest has one entry for each bucket, not for each file.

    <root>/_manifests/000000000007.json
    <root>/_data/<table>/<version>-<id>/bucket=<n>/part-...
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from larder.operators.upsert import unique, upsert
from larder.runtime import discard, materialise

#: Buckets of a new table; a bucket is rewritten as a whole, so that it should hold some hundred MB at most.
BUCKETS = 64


class Conflict(RuntimeError):
    """Another change was published since this one began."""


class Snapshots:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def names_in(self, path: str) -> list[str]:
        fs, at = self._fs(), self._path(path)
        return [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.names_in(f"{self.root}/_manifests") if re.fullmatch(r"\d{12}\.json", n))

    def manifest(self, version: int | None = None) -> dict:
        """{version, tables: {name: {schema, keys, buckets, folders: {bucket: folder}}}}, the newest unless told otherwise."""
        version = max(self.versions(), default=0) if version is None else version
        if not version:
            return {"version": 0, "tables": {}}
        file = self._fs().open(self._path(f"{self.root}/_manifests/{version:012d}.json"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8"))
        finally:
            file.close()

    def read(self, name: str, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """A table as of a version; with ``buckets`` only those. KeyError where there is none."""
        return self.frame(self.manifest(version)["tables"][name], name, buckets)

    def frame(self, table: dict, name: str, buckets: list[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(table["schema"])
        wanted = table["folders"] if buckets is None else {str(b): table["folders"][str(b)] for b in buckets if str(b) in table["folders"]}
        paths = [f"{self.root}/_data/{name}/{folder}/bucket={b}" for b, folder in wanted.items()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def change(self) -> Change:
        return Change(self)

    def expire(self, keep: int = 1) -> int:
        """Delete all manifests but the last ``keep``, and buckets' folders that none of those names; returns how many of the
        latter. Not to be called while a change is being made: its folders are not named yet."""
        fs, last, data = self._fs(), self.versions()[-max(1, keep) :], f"{self.root}/_data"
        used = {f"{n}/{folder}/bucket={b}" for v in last for n, t in self.manifest(v)["tables"].items() for b, folder in t["folders"].items()}
        for v in self.versions()[: -len(last) or None]:
            fs.delete(self._path(f"{self.root}/_manifests/{v:012d}.json"), False)
        gone = 0
        for folder in [f"{n}/{x}" for n in self.names_in(data) for x in self.names_in(f"{data}/{n}")]:
            there = [f"{folder}/{x}" for x in self.names_in(f"{data}/{folder}") if x.startswith("bucket=")]
            free = [x for x in there if x not in used]
            for x in [folder] if len(free) == len(there) else free:
                fs.delete(self._path(f"{data}/{x}"), True)
            gone += len(free)
        return gone


class Change:
    """New states of tables, seen by nobody until ``commit``."""

    def __init__(self, store: Snapshots):
        self.store, base = store, store.manifest()
        self.base, self.tables = base["version"], dict(base["tables"])

    def read(self, name: str) -> DataFrame:
        """A table as this change leaves it."""
        return self.store.frame(self.tables[name], name)

    @staticmethod
    def _bucket(table: dict) -> Column:
        types = StructType.fromJson(table["schema"])
        return F.pmod(F.xxhash64(*[F.col(k).cast(types[k].dataType) for k in table["keys"]]), F.lit(table["buckets"])).cast("int")

    def _write(self, name: str, table: dict, rows: DataFrame, rewritten: list[int] | None) -> None:
        """Rows of the buckets ``rewritten`` (None: of all) into a folder of their own."""
        folder = f"{self.base + 1}-{uuid.uuid4().hex[:12]}"
        path = f"{self.store.root}/_data/{name}/{folder}"
        dealt = rows.withColumn("bucket", self._bucket(table)).hint("rebalance", "bucket").sortWithinPartitions("bucket", *table["keys"])
        dealt.write.option("compression", "zstd").partitionBy("bucket").parquet(path)
        there = [n.removeprefix("bucket=") for n in self.store.names_in(path) if n.startswith("bucket=")]
        kept = {} if rewritten is None else {b: f for b, f in table["folders"].items() if int(b) not in set(rewritten)}
        self.tables[name] = table | {"folders": kept | dict.fromkeys(there, folder)}

    def replace(self, name: str, rows: DataFrame, keys: list[str], buckets: int = BUCKETS) -> None:
        """``rows`` as the whole table; each key is there once, else the write fails."""
        if "bucket" in rows.columns:
            raise ValueError(f"{name}: no column may be named bucket")
        table = {"schema": rows.schema.jsonValue(), "keys": keys, "buckets": buckets, "folders": {}}
        self._write(name, table, unique(rows, keys), None)

    def touched(self, name: str, keys: DataFrame) -> list[int]:
        """The buckets of a table in which the keys lie."""
        return sorted(r[0] for r in keys.select(self._bucket(self.tables[name]).alias("bucket")).distinct().collect())

    def upsert(self, name: str, new: DataFrame, update: list[str], insert: dict[str, Column] | None = None) -> list[int]:
        """``upsert.upsert`` of ``new`` into a table by its keys; reads and rewrites the buckets its keys lie in, and returns
        them."""
        table = self.tables[name]
        new = materialise(new, f"upsert-{name}")
        buckets = self.touched(name, new)
        if buckets:
            self._write(name, table, upsert(self.store.frame(table, name, buckets), new, table["keys"], update, insert), buckets)
        discard(new)
        return buckets

    def commit(self) -> int:
        """Publish all tables at once; returns the version. Raises ``Conflict`` where another change came first."""
        store, jvm, version = self.store, self.store.spark.sparkContext._jvm, self.base + 1
        final, draft = (store._path(f"{store.root}/_manifests/{n}") for n in (f"{version:012d}.json", f"draft-{uuid.uuid4().hex}"))
        fs = store._fs()
        fs.mkdirs(final.getParent())
        out = fs.create(draft, False)
        out.write(json.dumps({"version": version, "tables": self.tables}).encode())
        out.close()
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri() if final.toUri().getScheme() else fs.getUri(), store.spark.sparkContext._jsc.hadoopConfiguration())
        option = jvm.org.apache.hadoop.fs.Options.Rename
        try:
            files.rename(draft, final, store.spark.sparkContext._gateway.new_array(option, 0))  # never over a file that is there
        except Exception as e:
            fs.delete(draft, False)
            if version in store.versions():
                raise Conflict(f"{store.root}: version {version} was published by another change") from e
            raise
        return version
