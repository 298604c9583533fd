"""The tasks that join what is sold grow with the rows."""

from pyspark.sql import functions as F

from larder.plans import views

SF = "/root/testdata/sf0.001"


def tasks(df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_menus_are_dealt_out_by_their_number(spark, monkeypatch):
    few = views.Views(spark, SF)
    rows = few.lineitem.count()
    assert few.tasks == 1 == tasks(few.menu) and tasks(few.sold) == 1
    monkeypatch.setattr(views, "SOLD_ROWS", rows // 9)
    many = views.Views(spark, SF)
    assert many.tasks >= 9 and tasks(many.sold) == tasks(many.menu) == many.tasks
    assert sorted(map(tuple, many.menu.select("id", "name").collect())) == sorted(map(tuple, few.menu.select("id", "name").collect()))


def test_tags_are_dealt_out_by_their_number(spark, monkeypatch):
    few = views.Views(spark, SF)
    monkeypatch.setattr(views, "SOLD_ROWS", few.lineitem.count() // 9)
    many = views.Views(spark, SF)
    assert tasks(many.menu_food_type) == many.tasks
    tags = sorted(map(tuple, many.menu_food_type.collect()))
    assert tags == sorted(map(tuple, few.menu_food_type.collect())) and len(set(tags)) == len(tags)


def test_no_task_has_all_keys_of_a_pool(spark):
    from larder.operators import matching

    v = views.Views(spark, SF)
    pooled = matching.pools(v.official_food, views.BRANDS)
    one = pooled.repartition("pool")  # as a join by pool leaves it
    keyed = matching.candidates(one).filter(F.col("pool") == matching.GENERAL).groupBy(F.spark_partition_id()).count().collect()
    assert len(keyed) == int(spark.conf.get("spark.sql.shuffle.partitions"))
