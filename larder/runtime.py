"""Session helpers: the package in Python workers, the folder that driver and executors share, ranks over a whole table."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

_SHIPPED: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that Python workers can import it anywhere."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="larder-")), f"{root.name}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(path)
    _SHIPPED[app] = path


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a temporary one with a local
    master, whose threads share the machine; with any other master an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="larder-")
        spark.sparkContext.setCheckpointDir(base)
    return base


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{scratch_dir(spark)}/larder/{name}-{uuid.uuid4().hex}"
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: a cut in the lineage that survives lost executors.

    The folder is deleted when the driver's JVM ends.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def is_materialised(df: DataFrame) -> bool:
    return "_scratch" in vars(df)


def discard(df: DataFrame) -> None:
    """Delete what ``materialise`` wrote for ``df``, where it did. To be called once nothing reads it any more: everything
    made of it has been written in turn."""
    path = vars(df).get("_scratch")
    if path:
        jvm_path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(jvm_path, True)


def prefix_sums(totals: list[tuple[int, int]]) -> dict[int, int]:
    """Exclusive prefix sums of (partition, total) in partition order; one pair per partition, never per row."""
    out, run = {}, 0
    for part, total in sorted(totals):
        out[part] = run
        run += total
    return out


def in_order(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``df`` range-sorted by ``keys`` and materialised, with ``mid``: partition number in the high bits, place in the low 33.

    Written once, so every later read sees one order; range bounds alone may differ between two runs of one plan.
    """
    return materialise(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("mid", F.monotonically_increasing_id()), name)


def with_rank(placed: DataFrame) -> tuple[DataFrame, int]:
    """Adds ``rank`` (gapless from 0 over the whole table) to what ``in_order`` made, and the number of rows.

    Two passes: the partitions' counts, one row each, give the offsets; then rank is offset plus place.
    """
    part = F.shiftright("mid", 33)
    counts = [(r["part"], r["n"]) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()]
    offsets = placed.sparkSession.createDataFrame(list(prefix_sums(counts).items()) or [(0, 0)], "part long, base long")
    ranked = placed.withColumn("part", part).join(F.broadcast(offsets), "part")
    place = F.col("mid").bitwiseAND(F.lit((1 << 33) - 1))
    return ranked.withColumn("rank", F.col("base") + place).drop("part", "base", "mid"), sum(n for _, n in counts)
