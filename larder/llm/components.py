"""Connected components of an undirected link table, by contraction: hook to the smallest neighbour, flatten, relabel."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from larder.llm.common import discard, materialise


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in links (a, b); component is the smallest id that can be reached.

    Every round each root hooks to its smallest neighbour, the forest is flattened by pointer jumping, and links are
    carried over to the roots, where most vanish. Each step is a join on a key with one row on one side.
    """
    edges = materialise(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels = None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("id"), F.col("b").alias("to")).unionByName(edges.select(F.col("b").alias("id"), F.col("a").alias("to")))
        parent = forest = materialise(both.groupBy("id").agg(F.min("to").alias("to")).select("id", F.least("id", "to").alias("parent")), "hooks")
        while True:
            up = parent.select(F.col("id").alias("parent"), F.col("parent").alias("above"))
            jumped = materialise(parent.join(up, "parent").select("id", F.col("above").alias("parent"), (F.col("above") != F.col("parent")).alias("moved")), "jumps")
            discard(forest)
            forest, parent = jumped, jumped.drop("moved")
            if jumped.filter("moved").isEmpty():
                break
        to = [parent.select(F.col("id").alias(c), F.col("parent").alias(f"{c}_root")) for c in ("a", "b")]
        rooted = edges.join(to[0], "a").join(to[1], "b").filter("a_root <> b_root")
        before, edges = edges, materialise(rooted.select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).distinct(), "links")
        discard(before)
        if labels is None:
            labels = parent.withColumnRenamed("parent", "component")
        else:
            up = parent.select(F.col("id").alias("component"), "parent")
            labels = materialise(labels.join(up, "component", "left").select("id", F.coalesce("parent", "component").alias("component")), "labels")
            discard(held)
            discard(forest)
            forest = labels
        held = forest
    return labels if labels is not None else links.select(F.col("a").alias("id"), F.col("b").alias("component")).limit(0)
