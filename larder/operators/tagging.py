"""Food types of menus by category and by keyword, and the synonyms that turn a search word into a type."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from larder.enums import CAFE
from larder.functions.text import category_tags, keyword_tags, normalize_term, suggest_type
from larder.operators.upsert import last_wins


def tag_menus(menus: DataFrame, foods: DataFrame, restaurants: DataFrame, category_map: dict[str, list[str]], keywords: list[tuple[str, str]], include_cafe: bool = False) -> DataFrame:
    """Every menu with ``cafe`` (left out of tagging), category_tags, keyword_tags and their union ``tags``.

    Menus without a food survive the join.
    """
    f = foods.select(F.col("food_code").alias("official_food_code"), "major_category")
    r = restaurants.select(F.col("id").alias("restaurant_id"), "cuisine")
    joined = menus.join(r, "restaurant_id").join(f, "official_food_code", "left")
    by_category = category_tags(F.col("major_category"), category_map)
    by_keyword = keyword_tags(F.col("normalized_name"), keywords)
    return joined.withColumns({"cafe": F.lit(not include_cafe) & (F.col("cuisine") == CAFE), "category_tags": by_category, "keyword_tags": by_keyword}).withColumn(
        "tags", F.array_sort(F.array_union("category_tags", "keyword_tags"))
    )


def tag_rows(tagged: DataFrame) -> DataFrame:
    """(menu_id, food_type) of the menus that are not left out."""
    return tagged.filter(~F.col("cafe")).select(F.col("id").alias("menu_id"), F.explode("tags").alias("food_type"))


def tag_report(tagged: DataFrame) -> DataFrame:
    """One row of counts over all menus."""
    live, n = ~F.col("cafe"), lambda c: F.coalesce(F.sum((c).cast("long")), F.lit(0))
    return tagged.agg(
        n(F.col("cafe")).alias("skipped_cafe"), n(live).alias("total_menus"), n(live & (F.size("tags") > 0)).alias("tagged_menus"), n(live & (F.size("tags") == 0)).alias("untagged_menus"),
        n(live & (F.size("category_tags") > 0)).alias("from_category"), n(live & (F.size("keyword_tags") > 0)).alias("from_keyword"),
    )


def type_counts(tagged: DataFrame) -> DataFrame:
    return tag_rows(tagged).groupBy("food_type").agg(F.count("*").alias("menus"))


def categories(foods: DataFrame) -> DataFrame:
    """Non-empty categories with their number of foods, most first, and a suggested type."""
    counted = foods.filter("major_category is not null and major_category <> ''").groupBy("major_category").agg(F.count("*").alias("foods"))
    return counted.withColumn("suggested", suggest_type(F.col("major_category"))).orderBy(F.desc("foods"), "major_category")


def synonyms(rows: DataFrame) -> DataFrame:
    """(term, food_type) from (ordinal, term, food_type): normalised terms, blanks left out, the last of a term wins."""
    named = rows.select("ordinal", normalize_term(F.col("term")).alias("term"), F.trim("food_type").alias("food_type"))
    return last_wins(named.filter("term <> '' and food_type <> ''"), ["term"], "ordinal").select("term", "food_type")


def resolve_synonym(words: DataFrame, table: DataFrame, column: str = "keyword") -> DataFrame:
    """``words`` with ``derived_type``, null where the word is no synonym."""
    t = table.select("term", F.col("food_type").alias("derived_type"))
    return words.withColumn("term", F.regexp_replace(F.lower(column), r"\s+", "")).join(t, "term", "left").drop("term")
