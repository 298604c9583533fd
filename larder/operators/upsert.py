"""Sinks: upserts, guarded updates, tag replacement. Each returns the table's new state, to be written to a new path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from larder.runtime import discard, in_order, materialise, with_rank


def last_wins(rows: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """The last row of each key by ``ordinal``."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), ordinal).alias("r")).select(*keys, "r.*")


def unique(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows``, to fail when they are read if a key without null is there twice. Counted where a join on the keys needs the
    rows anyway."""
    twice = F.count("*").over(Window.partitionBy(*keys)) > 1
    for k in keys:
        twice = twice & F.col(k).isNotNull()
    shown = F.concat_ws(", ", *[F.col(k).cast("string") for k in keys])
    error = F.raise_error(F.concat(F.lit(f"({', '.join(keys)}) is not unique: "), shown)).cast("boolean")
    return rows.withColumn("is_unique", F.when(twice, error).otherwise(F.lit(True))).filter("is_unique").drop("is_unique")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], update: list[str], insert: dict[str, Column] | None = None) -> DataFrame:
    """``old`` with the rows of ``new``: known keys get the columns of ``update``, unknown keys are added.

    Other columns of known keys stay as they are; those of added rows come from ``new``, else from ``insert``, else null.
    Rows that ``new`` lacks stay. A key that is twice on one side fails the job.
    """
    insert = insert or {}
    old, new = unique(old, keys), unique(new, keys)
    o = old.select(*[F.col(c).alias(f"o_{c}") for c in old.columns], F.lit(True).alias("o_there"))
    n = new.select(*[F.col(c).alias(f"n_{c}") for c in new.columns], F.lit(True).alias("n_there"))
    on = [o[f"o_{k}"] == n[f"n_{k}"] for k in keys]
    joined = o.join(n, on, "full_outer")
    known, both = F.col("o_there").isNotNull(), F.col("o_there").isNotNull() & F.col("n_there").isNotNull()

    def value(c: str) -> Column:
        fresh = F.col(f"n_{c}") if c in new.columns else insert.get(c, F.lit(None))
        if c in keys:
            return F.coalesce(F.col(f"o_{c}"), fresh)
        if c in update:
            return F.when(both | ~known, fresh).otherwise(F.col(f"o_{c}"))
        return F.when(known, F.col(f"o_{c}")).otherwise(fresh)

    return joined.select(*[value(c).cast(old.schema[c].dataType).alias(c) for c in old.columns])


def next_ids(old: DataFrame, new: DataFrame, keys: list[str], id_column: str = "id", top: int | None = None) -> DataFrame:
    """``new`` with ids for keys that ``old`` lacks, gapless above all that there are (``top``: the largest one, where ``old``
    is only a part) in the order of the keys. Known keys get null."""
    top = (old.agg(F.max(id_column)).first()[0] if top is None else top) or 0
    # Sorted keys take few bytes in files: judged by those, millions of them would be collected and broadcast.
    placed = in_order(new.select(*keys).join(old.select(*keys).hint("merge"), keys, "left_anti").distinct(), keys, "new-keys")
    fresh = materialise(with_rank(placed)[0].select(*keys, (F.col("rank") + top + 1).alias(id_column)), "new-ids")
    discard(placed)
    return new.join(fresh.hint("merge"), keys, "left")


def apply_matches(menus: DataFrame, matches: DataFrame, foods: DataFrame) -> DataFrame:
    """Menus with a matched food's values, code, method and confidence; unmatched menus, and codes that no food has, keep theirs."""
    values = ("calories", "carbohydrate", "protein", "fat", "sodium")
    f = foods.select("food_code", *[F.col(v).alias(f"f_{v}") for v in values])
    m = matches.select(F.col("menu_id").alias("id"), "food_code", F.col("matched_by").alias("m_by"), F.col("confidence").alias("m_confidence")).join(f, "food_code")
    joined = menus.join(m, "id", "left")
    hit = F.col("food_code").isNotNull()
    new = {**{v: F.col(f"f_{v}") for v in values}, "official_food_code": F.col("food_code"), "matched_by": F.col("m_by"), "confidence": F.col("m_confidence"), "source": F.lit("OFFICIAL")}
    return joined.select(*[F.when(hit, new[c]).otherwise(F.col(c)).cast(menus.schema[c].dataType).alias(c) if c in new else F.col(c) for c in menus.columns])


def replace_tags(old: DataFrame, new: DataFrame, evaluated: DataFrame | None = None) -> DataFrame:
    """(menu_id, food_type) with the tags of every menu in ``new`` replaced. A menu without new tags keeps its old ones,
    unless ``evaluated`` (menu_id) names it: then they go."""
    gone = new.select("menu_id") if evaluated is None else new.select("menu_id").unionByName(evaluated.select("menu_id"))
    return old.join(gone.distinct(), "menu_id", "left_anti").unionByName(new.select(*old.columns).distinct())


def orphans(tags: DataFrame, menus: DataFrame) -> DataFrame:
    return tags.join(menus.select(F.col("id").alias("menu_id")), "menu_id", "left_anti")


def without_orphans(tags: DataFrame, menus: DataFrame) -> DataFrame:
    return tags.join(menus.select(F.col("id").alias("menu_id")), "menu_id", "left_semi")


def patch(old: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``old`` with the non-null values of ``changes``."""
    fields = [c for c in changes.columns if c != key]
    n = changes.select(key, *[F.col(c).alias(f"n_{c}") for c in fields])
    return old.join(n, key, "left").select(*[F.coalesce(f"n_{c}", c).alias(c) if c in fields else F.col(c) for c in old.columns])


def write_table(df: DataFrame, path: str, fmt: str = "parquet", **options) -> None:
    """Write a new snapshot; the path must not be one that ``df`` reads."""
    df.write.mode("overwrite").format(fmt).options(**options).save(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path, ignoreNullFields=False)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, escape='"')
