"""Incremental matching: new menus arrive as files and are matched batch by batch.

What was found for a name, or that nothing was, is kept beside the results as state, keyed by pool and name: a batch matches
only names that no earlier batch decided. State and results of a batch have folders of their own and a batch reads the state
of other batches only, so that one that is run again after a failure decides the same and replaces what it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from larder.operators import matching
from larder.runtime import materialise

MENU_STREAM = "menu_id long, menu_name string, normalized_name string, restaurant_name string"
NAMES = "pool string, name string, food_code string, food_name string, method string"


def read_names(spark: SparkSession, target: str, without: int | None = None) -> DataFrame:
    """Decided names, those of one batch left out; a null food is a decision for none."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{target}/_names")
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    batches = [f.getPath().getName() for f in fs.listStatus(root)] if fs.exists(root) else []
    paths = [f"{target}/_names/{b}" for b in batches if b != f"batch={without}" and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{target}/_names/{b}/_SUCCESS"))]
    return spark.read.schema(NAMES).parquet(*paths) if paths else spark.createDataFrame([], NAMES)


def match_stream(spark: SparkSession, source: str, foods: DataFrame, target: str, checkpoint: str, brands: list[str] | None = None, schema: str = MENU_STREAM) -> StreamingQuery:
    """Match every file of menus that ``source`` holds or gets and write the results under ``target``; ends when caught up. The
    foods' keys are written once for the whole stream; after a change of foods ``target`` has to be a new one."""
    arriving = spark.readStream.schema(schema).parquet(source)
    brands = brands or []
    cands = materialise(matching.candidates(matching.pools(foods, brands)), "stream-candidates")

    def write(batch: DataFrame, number: int) -> None:
        rows = materialise(matching.routed(batch, brands), "stream-menus")
        known = read_names(spark, target, number)
        fresh = materialise(matching.names_of(rows).join(known.select("pool", "name"), ["pool", "name"], "left_anti"), "stream-names")
        found = spark.createDataFrame([], NAMES) if fresh.isEmpty() else matching.cascade(fresh, cands)
        path = f"{target}/_names/batch={number}"
        fresh.join(found, ["pool", "name"], "left").write.mode("overwrite").parquet(path)
        decided = known.unionByName(spark.read.schema(NAMES).parquet(path))
        matching.with_hits(rows, decided.filter("food_code is not null")).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return arriving.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_matches(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(target)
