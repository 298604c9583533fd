"""Bucketed snapshots: only touched buckets are rewritten, all tables of a change appear at once, or none."""

import os

import pytest
from pyspark.sql import functions as F

from larder.operators.snapshots import Conflict, Snapshots


def files(root, name):
    return {os.path.join(d, f) for d, _, fs in os.walk(f"{root}/_data/{name}") for f in fs if f.endswith(".parquet")}


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_an_upsert_rewrites_its_buckets_alone(spark, tmp_path):
    store = Snapshots(spark, f"file://{tmp_path}")
    table = spark.range(2000).select(F.col("id").alias("key"), F.concat(F.lit("v"), "id").alias("name"), F.lit(1).alias("made"))
    change = store.change()
    change.replace("t", table, ["key"], buckets=16)
    assert store.versions() == [] and change.commit() == 1
    before = files(tmp_path, "t")
    new = spark.createDataFrame([(i, "new") for i in (3, 4, 5000)], "key int, name string")  # an int key meets a long one
    change = store.change()
    touched = change.upsert("t", new, ["name"], {"made": F.lit(2)})
    assert change.commit() == 2 and 1 <= len(touched) <= 3
    fresh = files(tmp_path, "t") - before
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in fresh} == set(touched)
    assert before <= files(tmp_path, "t")  # nothing that others read is touched
    got = {r.key: (r.name, r.made) for r in store.read("t").collect()}
    assert len(got) == 2001 and got[3] == ("new", 1) and got[5000] == ("new", 2) and got[7] == ("v7", 1)
    assert store.read("t", version=1).filter("name = 'new'").count() == 0
    plan = store.frame(store.manifest()["tables"]["t"], "t", touched)
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in plan.inputFiles()} == set(touched)
    assert store.expire() > 0 and store.versions() == [2] and store.read("t").count() == 2001
    assert store.expire() == 0


def test_tables_appear_together_or_not_at_all(spark, tmp_path):
    store = Snapshots(spark, f"file://{tmp_path}")
    one = spark.createDataFrame([(1, "a")], "id long, name string")
    change = store.change()
    change.replace("x", one, ["id"], 2)
    change.replace("y", one, ["id"], 2)
    change.commit()
    change = store.change()
    change.upsert("x", spark.createDataFrame([(1, "b"), (2, "c")], one.schema), ["name"])
    with pytest.raises(Exception, match="not unique"):
        change.upsert("y", spark.createDataFrame([(7, "b"), (7, "c")], one.schema), ["name"])
    assert rows(store.read("x")) == rows(store.read("y")) == [(1, "a")] and rows(change.read("x")) == [(1, "b"), (2, "c")]
    late, early = store.change(), store.change()
    early.upsert("x", spark.createDataFrame([(3, "d")], one.schema), ["name"])
    late.upsert("x", spark.createDataFrame([(4, "e")], one.schema), ["name"])
    assert early.commit() == 2
    with pytest.raises(Conflict):
        late.commit()
    assert rows(store.read("x")) == [(1, "a"), (3, "d")] and store.versions() == [1, 2]
    assert not [n for n in os.listdir(tmp_path / "_manifests") if "draft" in n]


def test_empty_tables_nulls_and_clashes(spark, tmp_path):
    store = Snapshots(spark, f"file://{tmp_path}")
    change = store.change()
    change.replace("t", spark.createDataFrame([], "id long, name string"), ["id"], 4)
    change.commit()
    assert store.read("t").collect() == [] and store.read("t").columns == ["id", "name"]
    change = store.change()
    assert change.upsert("t", spark.createDataFrame([], "id long, name string"), ["name"]) == []
    change.upsert("t", spark.createDataFrame([(None, "n"), (1, None)], "id long, name string"), ["name"])
    change.commit()
    assert sorted(store.read("t").collect(), key=str) == [(1, None), (None, "n")]
    with pytest.raises(ValueError):
        store.change().replace("u", spark.createDataFrame([(1,)], "bucket int"), ["bucket"])
    with pytest.raises(KeyError):
        store.read("none")


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path):
    conf = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "16KB", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, value in conf.items():
        spark.conf.set(k, value)
    try:
        store = Snapshots(spark, f"file://{tmp_path}")
        change = store.change()
        change.replace("t", spark.range(20_000).repartition(8).select(F.col("id").alias("key"), F.concat(F.lit("v"), "id").alias("name")), ["key"], buckets=1)
        change.commit()
    finally:
        for k in conf:
            spark.conf.unset(k)
    assert len(files(tmp_path, "t")) > 1
    assert rows(store.read("t")) == [(i, f"v{i}") for i in range(20_000)]
    change = store.change()
    assert change.upsert("t", spark.createDataFrame([(7, "new")], "key long, name string"), ["name"]) == [0]
    change.commit()
    assert store.read("t").count() == 20_000 and store.read("t").filter("name = 'new'").count() == 1
