"""Domain views over the star schema's tables, one SQL text for Spark and for the oracle.

Restaurants come from suppliers, menus from the parts a supplier sold, foods from parts, members from customers,
measurements from orders, scan fields from events.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from larder.runtime import materialise, scratch_path

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels", "conversations")

VIEWS = {
    "restaurant": """
        SELECT s_suppkey AS id,
               CASE WHEN s_suppkey % 10 = 0 THEN concat('Brand#', CAST(s_suppkey % 25 + 1 AS STRING), ' Store')
                    WHEN s_suppkey % 10 = 3 THEN concat(s_name, ' 시청점') ELSE s_name END AS name,
               concat('road ', CAST(s_suppkey % 40 AS STRING)) AS address,
               CASE s_nationkey % 8 WHEN 0 THEN 'KOREAN' WHEN 1 THEN 'CHINESE' WHEN 2 THEN 'JAPANESE' WHEN 3 THEN 'WESTERN'
                    WHEN 4 THEN 'ASIAN' WHEN 5 THEN 'SNACK' WHEN 6 THEN 'CAFE_DESSERT' ELSE 'ETC' END AS cuisine,
               concat('https://map.test/place/', CAST(s_suppkey AS STRING)) AS source_url,
               CASE WHEN s_suppkey % 20 <> 7 THEN 37.579132e0 + CAST(s_suppkey % 101 - 50 AS DOUBLE) / 10000e0 END AS latitude,
               CASE WHEN s_suppkey % 20 <> 7 THEN 126.923488e0 + CAST(s_suppkey % 83 - 41 AS DOUBLE) / 10000e0 END AS longitude,
               CASE WHEN s_suppkey % 20 <> 7 THEN CAST(s_suppkey * 37 % 1500 AS INT) END AS distance_to_main_gate,
               CASE WHEN s_suppkey % 20 <> 7 THEN CAST(s_suppkey * 53 % 1500 AS INT) END AS distance_to_back_gate
        FROM supplier""",
    "official_food": """
        SELECT concat('D101-', lpad(CAST(p_partkey AS STRING), 9, '0'), '-0001') AS food_code, named AS food_name, named AS normalized_name,
               CASE p_partkey % 4 WHEN 0 THEN '외식(분석함량)' WHEN 1 THEN '외식(재료량 기반 산출함량)' WHEN 2 THEN '가정식(분석함량)' ELSE '가정식' END AS origin,
               CASE WHEN p_partkey % 9 <> 8 THEN p_type END AS major_category,
               CAST(p_size * 8 AS INT) AS calories, CAST(p_partkey % 60 AS DECIMAL(8,2)) AS carbohydrate, CAST(p_partkey % 30 AS DECIMAL(8,2)) AS protein,
               CAST(p_partkey % 20 AS DECIMAL(8,2)) AS fat, CAST(p_partkey % 900 AS DECIMAL(8,2)) AS sodium,
               CASE WHEN p_partkey % 4 = 0 THEN p_brand END AS company_name,
               CASE WHEN p_partkey % 10 = 0 THEN '100ml' ELSE '100g' END AS serving_basis,
               split_part(p_name, ' ', 2) AS representative_name, p_partkey AS partkey
        FROM (SELECT *, CASE p_partkey % 3 WHEN 0 THEN base WHEN 1 THEN concat(lower(p_type), '_', base) ELSE concat(split_part(base, ' ', 2), '_', base) END AS named
              FROM (SELECT *, CASE WHEN length(p_name) % 3 = 0 THEN concat('mixed ', split_part(p_name, ' ', 2), ' ', lower(p_type)) ELSE p_name END AS base FROM part) b) n""",
    "menu": """
        SELECT l_suppkey * 1000000 + l_partkey AS id, l_suppkey AS restaurant_id, l_partkey AS partkey,
               CASE l_partkey % 8 WHEN 0 THEN p_name WHEN 1 THEN concat(upper(p_name), ' (355ml)') WHEN 2 THEN concat('++ ', p_name, ' ++') WHEN 3 THEN concat(p_name, ' 2인분')
                    WHEN 4 THEN concat(p_name, ' [new]') WHEN 5 THEN concat(p_name, ' 특선') WHEN 6 THEN concat('big ', p_name) ELSE replace(p_name, 'i', 'y') END AS name,
               CASE l_partkey % 8 WHEN 5 THEN concat(p_name, ' 특선') WHEN 6 THEN concat('big ', p_name) WHEN 7 THEN replace(p_name, 'i', 'y') ELSE p_name END AS normalized_name,
               CASE WHEN l_partkey % 17 <> 0 THEN CAST(5000 + l_partkey % 40 * 500 AS INT) END AS price,
               food_code AS official_food_code, calories, carbohydrate, protein, fat, sodium,
               CASE WHEN food_code IS NOT NULL THEN 'OFFICIAL' END AS source,
               CASE WHEN food_code IS NOT NULL THEN CASE l_partkey % 4 WHEN 0 THEN 'EXACT' WHEN 1 THEN 'EDIT' WHEN 2 THEN 'STRUCT' ELSE 'NGRAM' END END AS matched_by,
               CAST(CASE WHEN food_code IS NOT NULL THEN CASE l_partkey % 4 WHEN 0 THEN 1.00 WHEN 1 THEN 0.95 WHEN 2 THEN 0.85 ELSE 0.70 END END AS DECIMAL(4,3)) AS confidence
        FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) sold JOIN part ON l_partkey = p_partkey LEFT JOIN official_food ON partkey = p_partkey AND p_partkey % 5 <> 0""",
    "menu_food_type": """
        SELECT id AS menu_id, CASE split_part(p_name, ' ', 2) WHEN 'plate' THEN 'RICE' WHEN 'ring' THEN 'NOODLE' WHEN 'rod' THEN 'MEAT' WHEN 'bolt' THEN 'SOUP' ELSE 'SNACK' END AS food_type
        FROM menu JOIN part ON partkey = p_partkey WHERE split_part(p_name, ' ', 2) IN ('plate', 'ring', 'rod', 'bolt', 'gear')
        UNION SELECT id, 'SOUP' FROM menu JOIN part ON partkey = p_partkey WHERE split_part(p_name, ' ', 1) = 'hot'""",
    "member": """
        SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'LOSS' WHEN 1 THEN 'MAINTAIN' ELSE 'GAIN' END AS goal,
               CASE c_custkey % 5 WHEN 0 THEN 'NONE' WHEN 1 THEN 'ONE_TO_TWO' WHEN 2 THEN 'THREE_TO_FOUR' WHEN 3 THEN 'FIVE_TO_SIX' END AS exercise_count,
               CASE c_custkey % 4 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'HIGH' END AS exercise_intensity,
               CAST(c_custkey % 16 AS INT) AS disease_bits, CAST(concat(CAST(1960 + c_custkey % 40 AS STRING), '-03-15') AS DATE) AS birth_date
        FROM customer""",
    "member_disease": """
        SELECT id AS member_id, 'GASTROESOPHAGEAL_REFLUX' AS disease FROM member WHERE disease_bits % 2 = 1
        UNION ALL SELECT id, 'HYPERTENSION' FROM member WHERE disease_bits % 4 >= 2
        UNION ALL SELECT id, 'DIABETES' FROM member WHERE disease_bits % 8 >= 4
        UNION ALL SELECT id, 'HYPERLIPIDEMIA' FROM member WHERE disease_bits >= 8""",
    "inbody": """
        SELECT o_orderkey AS id, o_custkey AS member_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS measured_at, CAST(900 + o_orderkey % 1500 AS INT) AS bmr,
               CAST(o_orderkey % 101 AS INT) AS inbody_score, CAST(o_orderkey % 150 AS DECIMAL(8,2)) AS protein_target
        FROM orders""",
    "ocr_field": """
        SELECT CAST(floor(event_id / 8e0) AS BIGINT) AS doc, CAST(event_id % 8 AS INT) AS pos,
               CASE event_id % 8 WHEN 0 THEN '골격 근량' WHEN 2 THEN '체중' WHEN 5 THEN '2024.01.0x' ELSE concat(CAST(CAST(floor(value) AS BIGINT) % 70 AS STRING), '.5kg') END AS text,
               CAST(100 + event_id * 37 % 600 AS DOUBLE) AS cx, CAST(1000 + event_id % 8 * 20 + user_id % 15 AS DOUBLE) AS cy
        FROM events""",
    "label_row": """
        SELECT CAST(doc_id AS INT) AS row_no,
               CASE doc_id % 7 WHEN 0 THEN '' WHEN 1 THEN CAST(doc_id % 11 AS STRING) WHEN 2 THEN '0' WHEN 3 THEN 'D101-018430000-0001' WHEN 4 THEN '제외' WHEN 5 THEN 'maybe' ELSE ' 1 ' END AS answer,
               CASE WHEN doc_id % 9 <> 0 THEN CASE quality WHEN 1 THEN CAST(doc_id % 4 AS STRING) ELSE '없음' END END AS raw_choice
        FROM labels""",
}
NEEDS = {name: [v for v in VIEWS if v != name and re.search(rf"\b{v}\b", sql)] for name, sql in VIEWS.items()}
#: Sold parts that one task joins to parts and foods, and the least for which another task is made.
SOLD_ROWS, LEAST_SOLD_ROWS = 100_000, 20_000
_SOLD = "(SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) sold"
BRANDS = [f"brand#{i}" for i in (1, 11, 3, 6, 16, 21)]


def with_views(sql: str) -> str:
    """The statement with a WITH clause for every view it names, directly or through others."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for v in NEEDS[name]:
            add(v)
        if name not in wanted:
            wanted.append(name)

    for v in VIEWS:
        if re.search(rf"\b{v}\b", sql):
            add(v)
    ctes = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in wanted)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE ") and ctes:
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH ") and ctes:
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}" if ctes else body


class Views:
    """Tables and views of one data folder as DataFrames, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self._made.setdefault(name, self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet"))
        if name not in VIEWS:
            raise AttributeError(name)
        if name not in self._made:
            used = [t for t in (*TABLES, *VIEWS) if t != name and re.search(rf"\b(FROM|JOIN) {t}\b", VIEWS[name])]
            frames = {t: getattr(self, t) for t in used}
            text = VIEWS[name]
            if _SOLD in text:
                text, frames = text.replace(_SOLD, "{sold} sold"), {t: f for t, f in frames.items() if t != "lineitem"} | {"sold": self.sold}
            text = re.sub(r"\b(FROM|JOIN) (\w+)\b", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in frames else m[0], text)
            if name == "menu_food_type":  # the same union, made distinct where the rows are dealt out by menu
                rows = self.spark.sql(text.replace("UNION SELECT", "UNION ALL SELECT"), **frames)
                self._made[name] = rows.repartition(self.tasks, "menu_id").distinct()
            else:
                self._made[name] = self.spark.sql(text, **frames)
        return self._made[name]

    @cached_property
    def tasks(self) -> int:
        """Tasks over which sold parts, and what there is of each, are dealt out. Their number grows with the rows: keys are
        narrow, and parts that Spark makes by their bytes hold so many that what is joined to them fills a task's memory."""
        rows = self.lineitem.count()  # of the files' footers
        return max(1, -(-rows // SOLD_ROWS), min(self.spark.sparkContext.defaultParallelism, -(-rows // LEAST_SOLD_ROWS)))

    @cached_property
    def sold(self) -> DataFrame:
        """(l_suppkey, l_partkey), each pair once."""
        return self.lineitem.select("l_suppkey", "l_partkey").repartition(self.tasks, "l_partkey").distinct()

    @cached_property
    def members(self) -> DataFrame:
        """Members with their diseases as an array, empty without any."""
        from pyspark.sql import functions as F

        by = self.member_disease.groupBy(F.col("member_id").alias("id")).agg(F.collect_set("disease").alias("diseases"))
        return self.member.join(by, "id", "left").withColumn("diseases", F.coalesce("diseases", F.array().cast("array<string>")))

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """What ``make`` gives, written, so that a query that uses it several times works it out once."""
        if name not in self._made:
            self._made[name] = materialise(make(), name)
        return self._made[name]

    def scratch(self, name: str) -> str:
        return scratch_path(self.spark, name)
