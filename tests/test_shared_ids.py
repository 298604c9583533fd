"""Queries on tables so large that two menus have one id (a part's number of a million and more), against DuckDB."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from larder.plans import catalog

SF = "/root/testdata/sf0.001"
FIRST, SECOND = ("lim_page_in_order", "lim_seek_filtered", "lim_seek_page"), ("jn_menu_tags_left", "snk_upsert_menu")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The smallest tables with each part once more, a million on, sold by the supplier before: the ids of those menus are there."""
    path = str(tmp_path_factory.mktemp("shared"))
    read = lambda t: spark.read.parquet(f"{SF}/{t}.parquet")
    sold, part = read("lineitem"), read("part")
    again = sold.filter("l_suppkey > 0").withColumns({"l_partkey": F.col("l_partkey") + 1_000_000, "l_suppkey": F.col("l_suppkey") - 1})
    sold.unionByName(again).write.parquet(f"{path}/lineitem.parquet")
    part.unionByName(part.withColumn("p_partkey", F.col("p_partkey") + 1_000_000)).write.parquet(f"{path}/part.parquet")
    for t in os.listdir(SF):
        if not os.path.exists(f"{path}/{t}"):
            os.symlink(f"{SF}/{t}", f"{path}/{t}")
    return path


@pytest.fixture(scope="module")
def duck(tables):
    con = duckdb.connect()
    for t in os.listdir(tables):
        at = f"{tables}/{t}"
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{at}{'/*.parquet' if os.path.isdir(at) else ''}'")
    return con


@pytest.mark.parametrize("name", FIRST + SECOND)
def test_query(spark, tables, duck, name):
    df, want = catalog.queries()[name](spark, tables), duck.sql(catalog.oracle_sql()[name])
    rows = [tuple(r[c] for c in want.columns) for r in df.collect()]
    assert sorted(rows, key=str) == sorted(map(tuple, want.fetchall()), key=str)
