"""Linking menu names to foods: an n-gram-blocked fuzzy join in four stages, within pools by brand.

Every distinct name of a pool is matched once and its result joined back. The first stage that finds something wins:
equal keys; edit ratio; containment; bigram similarity.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType

from larder.enums import CAFE, CONTAIN_LEAST_LENGTH, CONTAIN_LEAST_RATIO, EDIT_LEAST, NGRAM_LEAST, SHORTLIST
from larder.functions.numeric import confidence
from larder.functions.patterns import words_in
from larder.functions.text import basis_key, bigrams, candidate_keys, flat, has_term, is_branch, strict_subset, tokens
from larder.runtime import is_materialised, materialise, ship

GENERAL = ""
#: Rows (key, bigram) that may be broadcast, some hundred bytes each; the whole food table has about 300,000.
BROADCAST_GRAMS = 500_000


@F.pandas_udf(DoubleType())
def seq_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff/Obershelp similarity; the order of the arguments matters."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def brand_of(name: Column, brands: list[str]) -> Column:
    """The longest brand that the name holds, else null."""
    if not brands:
        return F.lit(None).cast("string")
    return F.get(words_in(F.lower(name), sorted(brands, key=len, reverse=True)), 0)


def scope_label(restaurant: Column, cuisine: Column, brands: list[str], franchise: bool, branch: bool, cafe: bool) -> Column:
    """Which exclusion takes a menu out, in this order, or ``kept``."""
    hit = F.when(F.lit(franchise) & has_term(F.lower(restaurant), brands), "excluded_franchise")
    return hit.when(F.lit(branch) & is_branch(restaurant), "excluded_branch").when(F.lit(cafe) & (cuisine == CAFE), "excluded_cafe").otherwise("kept")


def pools(foods: DataFrame, brands: list[str]) -> DataFrame:
    """Foods with their pool: the general one without rows of any brand's company, and one for each brand that a company's
    name holds; a row may be in several brands' pools."""
    company = F.lower(F.coalesce("company_name", F.lit("")))
    hits = words_in(company, brands)
    return foods.filter("normalized_name <> ''").withColumn("pool", F.explode(F.when(F.size(hits) > 0, hits).otherwise(F.array(F.lit(GENERAL)))))


def pool_counts(foods: DataFrame, brands: list[str]) -> DataFrame:
    """One row: the comparison keys of the general pool, and the foods that are not in it for their company's brand."""
    owned = F.size(words_in(F.lower(F.coalesce("company_name", F.lit(""))), brands)) > 0
    keys = F.when(~owned, F.size(candidate_keys(F.col("normalized_name"))))
    rows = foods.filter("normalized_name <> ''")
    return rows.agg(F.coalesce(F.sum(keys), F.lit(0)).alias("total_candidates"), F.count(F.when(owned, 1)).alias("excluded_rows"))


def candidates(pooled: DataFrame) -> DataFrame:
    """One row per comparison key of a food in a pool."""
    # Foods are few bytes beside the work on their keys: parts by bytes, or by pool, would leave it to one task.
    parts = int(pooled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = pooled.repartition(parts, "food_code").withColumn("k", F.explode(candidate_keys(F.col("normalized_name"))))
    key = F.col("k.key")
    return keyed.select(
        "pool", "food_code", "food_name", key.alias("key"), flat(key).alias("key_flat"), F.col("k.allow_contain").alias("allow_contain"), F.col("k.ordinal").alias("ordinal"),
        tokens(key).alias("key_tokens"), bigrams(key).alias("key_grams"), basis_key(F.col("serving_basis"), F.col("origin"), F.col("food_code")).alias("basis"), "major_category", "origin",
    )


def exact(names: DataFrame, cands: DataFrame) -> DataFrame:
    """(pool, name, food_code, food_name) of names that equal a key; of several foods the first by basis."""
    best = cands.groupBy("pool", F.col("key").alias("name")).agg(F.min(F.struct("basis", "ordinal", "food_code", "food_name")).alias("b"))
    return names.select("pool", "name").join(best, ["pool", "name"]).select("pool", "name", "b.food_code", "b.food_name")


def shortlist(names: DataFrame, cands: DataFrame, most: int = SHORTLIST) -> DataFrame:
    """For each (pool, name) the candidates that share a bigram, the best ``most`` by Jaccard, then basis and key.

    Names meet distinct keys in a join on (pool, bigram); the count of joined rows is the intersection's size, so no set
    travels. Where the keys' bigrams are few enough to be sent to every task, names are dealt out once, and the pairs are
    joined, counted and pruned where their name is: no pair is shuffled and no common bigram meets in one task. Beyond
    that both sides are dealt out by bigram. A key stays only while the keys nearer to the name hold fewer than ``most``
    candidates, and of each key's candidates only its first ``most`` can be listed, so foods of one name do not multiply
    the pairs.
    """
    keys = cands.groupBy("pool", "key").agg(F.least(F.count("*"), F.lit(most)).alias("n"))
    # A number of its own, else Spark would size the parts by the names, which are small beside their pairs.
    parts = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = names.repartition(parts, "name").select("pool", "name", bigrams(F.col("name")).alias("g")).select("pool", "name", F.size("g").alias("n_name"), F.explode("g").alias("gram"))
    right = keys.select("pool", "key", "n", bigrams(F.col("key")).alias("g")).select("pool", "key", "n", F.size("g").alias("n_key"), F.explode("g").alias("gram"))
    right = materialise(right, "key-bigrams")
    right = F.broadcast(right) if right.count() <= BROADCAST_GRAMS else right
    shared = left.join(right, ["pool", "gram"]).groupBy("pool", "name", "key", "n", "n_name", "n_key").agg(F.count("*").alias("both"))
    scored = shared.select("pool", "name", "key", "n", (F.col("both") / (F.col("n_name") + F.col("n_key") - F.col("both"))).alias("jaccard"))
    nearer = Window.partitionBy("pool", "name").orderBy(F.desc("jaccard")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.sum("n").over(nearer) - F.sum("n").over(Window.partitionBy("pool", "name", "jaccard"))
    near = scored.withColumn("before", before).filter(F.col("before") < most).select("pool", "name", "key", "jaccard")
    by_key = Window.partitionBy("pool", "key").orderBy("basis", "ordinal")
    first = cands.withColumn("nth", F.row_number().over(by_key)).filter(F.col("nth") <= most).drop("nth", "key_grams")
    order = Window.partitionBy("pool", "name").orderBy(F.desc("jaccard"), "basis", "ordinal")
    return near.join(first, ["pool", "key"]).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)


def top_candidates(listed: DataFrame, most: int = 10) -> DataFrame:
    """The first ``most`` foods of each shortlist, one row per food."""
    one = listed.groupBy("pool", "name", "food_code").agg(F.min("place").alias("place"), F.min_by(F.struct("food_name", "major_category", "origin"), "place").alias("f"))
    order = Window.partitionBy("pool", "name").orderBy("place")
    return one.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= most).select("pool", "name", "nth", "food_code", "f.*")


def is_structural() -> Column:
    """Whether the name holds the key, long enough and at least half of it, or all of the key's words and more."""
    name, key = F.col("name"), F.col("key")
    holds = (F.length(key) >= CONTAIN_LEAST_LENGTH) & F.contains(name, key) & (F.length(key) / F.length(name) >= CONTAIN_LEAST_RATIO)
    return F.col("allow_contain") & (holds | ((F.size("key_tokens") > 0) & strict_subset(F.col("key_tokens"), tokens(name))))


def most_ratio(a: Column, b: Column) -> Column:
    """An upper bound of ``seq_ratio``, to be computed cheaply: twice the letters that two texts share, each as often as in
    both, of all their letters. Blocks that match are made of such letters."""
    chars, all_ = F.filter(F.split(a, ""), lambda c: c != ""), F.length(a) + F.length(b)
    # What is left of b when each letter of a has taken away one like it.
    left = F.aggregate(chars, b, lambda rest, c: F.when(F.contains(rest, c), F.concat(F.substr(rest, F.lit(1), F.instr(rest, c) - 1), F.substr(rest, F.instr(rest, c) + 1))).otherwise(rest))
    return F.when(all_ > 0, 2 * (F.length(b) - F.length(left)) / all_).otherwise(1.0)


def with_ratio(listed: DataFrame, least: float = EDIT_LEAST) -> DataFrame:
    """The shortlist with ``ratio``; Python sees only pairs whose lengths and letters can reach the threshold."""
    ship(listed.sparkSession)
    a, b = flat(F.col("name")), F.col("key_flat")
    by_length = 2 * F.least(F.length(a), F.length(b)) >= least * (F.length(a) + F.length(b))
    possible = F.when(by_length, most_ratio(a, b) >= least - 1e-9).otherwise(False)
    return listed.withColumn("possible", possible).withColumn("ratio", seq_ratio(F.when(F.col("possible"), a), F.when(F.col("possible"), b))).drop("possible")


def cascade(names: DataFrame, cands: DataFrame, edit_least: float | None = EDIT_LEAST) -> DataFrame:
    """(pool, name, food_code, food_name, method) of each distinct name that some stage matches; brands' pools have no
    bigram stage. Without ``edit_least`` the edit stage is left out, and with it all Python."""
    # Both are used several times; written once, the menus and foods behind them are read once.
    names = names if is_materialised(names) else materialise(names.select("pool", "name"), "match-names")
    cands = cands if is_materialised(cands) else materialise(cands, "match-candidates")
    found = exact(names, cands)
    rest = names.select("pool", "name").join(found, ["pool", "name"], "left_anti")
    food = ("food_code", "food_name")
    listed = shortlist(rest, cands)
    listed = listed.withColumn("ratio", F.lit(None).cast("double")) if edit_least is None else with_ratio(listed, edit_least)
    edit = F.min(F.when(F.col("ratio") >= F.lit(edit_least).cast("double"), F.struct((-F.col("ratio")).alias("r"), "place", *food)))
    struct = F.min(F.when(is_structural(), F.struct(F.length("key").alias("n"), "basis", "ordinal", *food)))
    ngram = F.min(F.when((F.col("jaccard") >= NGRAM_LEAST) & F.col("allow_contain") & (F.col("pool") == GENERAL), F.struct("place", *food)))
    one = listed.groupBy("pool", "name").agg(edit.alias("EDIT"), struct.alias("STRUCT"), ngram.alias("NGRAM"))
    pick = F.coalesce(*[F.when(F.col(s).isNotNull(), F.struct(F.col(f"{s}.food_code"), F.col(f"{s}.food_name"), F.lit(s).alias("method"))) for s in ("EDIT", "STRUCT", "NGRAM")])
    fuzzy = one.select("pool", "name", pick.alias("p")).filter("p is not null").select("pool", "name", "p.*")
    both = found.withColumn("method", F.lit("EXACT")).unionByName(fuzzy)
    return both.withColumn("method", F.when(F.col("pool") == GENERAL, F.col("method")).otherwise(F.concat(F.lit("BRAND_"), "method")))


def routed(menus: DataFrame, brands: list[str]) -> DataFrame:
    """Menus with the pool they are matched in: that of the brand of their restaurant, also where it is empty, else the general
    one."""
    return menus.withColumn("pool", F.coalesce(brand_of(F.col("restaurant_name"), brands), F.lit(GENERAL)))


def names_of(menus: DataFrame) -> DataFrame:
    return menus.filter("normalized_name <> ''").select("pool", F.col("normalized_name").alias("name")).distinct()


def with_hits(menus: DataFrame, hits: DataFrame) -> DataFrame:
    """Routed menus with food_code, food_name, matched_by and confidence from (pool, name, food_code, food_name, method)."""
    h = hits.withColumnRenamed("name", "normalized_name").withColumnRenamed("method", "matched_by")
    return menus.join(h, ["pool", "normalized_name"], "left").withColumn("confidence", confidence(F.col("matched_by")))


def match_menus(menus: DataFrame, foods: DataFrame, brands: list[str] | None = None) -> DataFrame:
    """Every menu (menu_id, normalized_name, restaurant_name) with pool, food_code, food_name, matched_by, confidence."""
    brands = brands or []
    rows = routed(menus, brands)
    names = materialise(names_of(rows), "match-names")
    used = names.select("pool").distinct()  # at most one for each brand; a join by pool would meet in a task for each
    pooled = pools(foods, brands).join(F.broadcast(used), "pool", "left_semi")
    return with_hits(rows, cascade(names, candidates(pooled)))
