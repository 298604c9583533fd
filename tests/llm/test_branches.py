"""Keys beyond the bound of a broadcast are joined by two exchanges, with the same rows; stages' results go when the next is there."""

import os

import corpus_pipeline
from larder.llm import common
from larder.llm.near_dedup import near_dedup
from tests.llm.helpers import DATA, awkward, documents


def rows(df):
    return sorted(map(str, df.collect()))


def results(spark):
    docs = documents(spark).unionByName(awkward(spark).select(*documents(spark).columns))
    return [rows(near_dedup(docs, k=3, percent=85)), rows(corpus_pipeline.exact(spark, docs, DATA)), rows(corpus_pipeline.near(spark, docs, DATA))]


def test_both_branches_give_the_same_rows(spark, monkeypatch):
    few = results(spark)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    joined = common.sized(spark.range(3))
    assert "Broadcast" not in spark.range(9).join(joined, "id", "left_anti")._jdf.queryExecution().sparkPlan().toString()
    assert results(spark) == few


def test_a_stage_goes_when_the_next_is_written(spark, monkeypatch):
    written = []
    keep = corpus_pipeline.materialise

    def noted(df, name):
        out = keep(df, name)
        if name.startswith("stage-"):
            written.append(out._scratch.removeprefix("file://"))
        return out

    monkeypatch.setattr(corpus_pipeline, "materialise", noted)
    pieces = corpus_pipeline.run(spark, DATA)
    assert [os.path.exists(p) for p in written] == [False, False, False, True]
    assert pieces.count() > 0
