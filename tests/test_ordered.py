"""Pages of a written order equal those of a sort, and read only the parts they lie in."""

import pytest
from pyspark.sql import functions as F

from larder.operators.ordered import Ordered

KEYS = ["name", "-price", "id"]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    df = spark.range(3000).select(
        "id", F.when(F.col("id") % 11 > 0, F.concat(F.lit("n"), F.col("id") % 7)).alias("name"), F.when(F.col("id") % 5 > 0, F.col("id") % 13).cast("decimal(8,2)").alias("price")
    )
    rows = [tuple(r) for r in df.orderBy(F.asc("name"), F.desc("price"), F.asc("id")).select("name", "price", "id").collect()]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    table = Ordered.write(df, KEYS, f"file://{tmp_path_factory.mktemp('ordered')}/t")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    return table, rows


def got(df):
    return [tuple(r) for r in df.select("name", "price", "id").collect()]


def parts(df):
    return {f.split("part=")[1].split("/")[0] for f in df.inputFiles()}


def test_pages_by_number(made):
    table, rows = made
    assert table.total == 3000 and len(table.counts) > 1
    for number, size in ((0, 10), (7, 100), (299, 10), (3, 900), (300, 10), (0, 5000)):
        assert got(table.page(number, size)) == rows[number * size : (number + 1) * size]
    assert all(len(parts(table.page(n, 10))) <= 2 for n in (0, 150, 299))  # page 299 reads no more than the first


def test_pages_after_a_row(made):
    table, rows = made
    assert got(table.after(None, 25)) == rows[:25]
    for at in (0, 1, 400, 1499, 1500, 2990, 2999):
        assert got(table.after(rows[at], 25)) == rows[at + 1 : at + 26]
    assert got(table.after(("n2", None, 10**9), 5)) == [r for r in rows if (r[0] or "") > "n2"][:5]  # no such row
    assert got(table.after(("a", 1, 1), 5)) == [r for r in rows if r[0] is not None][:5]
    assert got(table.after(("z", 1, 1), 5)) == []
    assert max(len(parts(table.after(rows[at], 25))) for at in (5, 1300, 2900)) <= 3


def test_pages_of_rows_that_meet_a_condition(made):
    table, rows = made
    rare = F.col("id") % 601 == 0
    want = [r for r in rows if r[2] % 601 == 0]
    assert got(table.after(None, 3, rare)) == want[:3] and got(table.after(want[1], 2, rare)) == want[2:4]
    assert got(table.after(want[2], 100, rare)) == want[3:] and got(table.after(None, 4, F.lit(False))) == []


def test_edges(spark, tmp_path):
    empty = Ordered.write(spark.createDataFrame([], "id long, name string"), ["id"], f"file://{tmp_path}/e")
    assert empty.total == 0 and empty.page(0, 5).collect() == [] and empty.after((1,), 5).collect() == [] and empty.after(None, 5, F.lit(True)).columns == ["id", "name"]
    twice = spark.createDataFrame([(1, "a"), (1, "b")], "id long, name string")
    with pytest.raises(ValueError, match="not unique: id"):
        Ordered.write(twice, ["id"], f"file://{tmp_path}/d")
    with pytest.raises(ValueError, match="place"):
        Ordered.write(twice.withColumn("place", F.lit(1)), ["name"], f"file://{tmp_path}/c")


def test_rows_that_are_equal_in_every_column(spark, tmp_path):
    df = spark.range(60).select(F.when(F.col("id") < 40, F.lit("a")).otherwise(F.lit("b")).alias("name"), F.lit(None).cast("int").alias("price"), (F.col("id") % 2).alias("id"))
    rows = [tuple(r) for r in df.orderBy("name", "id").collect()]
    table = Ordered.write(df, KEYS, f"file://{tmp_path}/t")
    assert got(table.page(1, 7)) == rows[7:14]
    seen, last = [], None
    while page := table.after(last, 7, placed=True).collect():  # no row is lost or comes twice, though pages end within equal rows
        seen, last = seen + [(r["name"], r["price"], r["id"]) for r in page], table.place_of(page[-1])
    assert seen == rows
    odd = F.col("id") == 1
    first = table.after(None, 7, odd, placed=True).collect()
    assert got(table.after(table.place_of(first[-1]), 30, odd)) == [r for r in rows if r[2] == 1][7:37]
    assert got(table.after(("a", None, 0), 100)) == rows[20:]  # by keys: after all rows that have them
