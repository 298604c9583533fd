"""Sources: nested crawl records, the food table, dictionaries, scan responses, lookups."""

from __future__ import annotations

import csv
import io
import unicodedata
from pathlib import PurePath

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from larder import schemas
from larder.enums import BLOCKER, CUISINES, FOOD_TYPES
from larder.functions.numeric import to_decimal, to_int
from larder.functions.text import nfc, normalize_menu_name, with_nfc
from larder.runtime import ship


def read_crawl(spark: SparkSession, path: str) -> DataFrame:
    """Crawled restaurants with nested menus, in file order (``ordinal``). The file is one JSON array or one object a line."""
    first = spark.read.text(path, wholetext=False).filter(F.trim("value") != "").limit(1).collect()
    multi = bool(first) and first[0][0].lstrip("﻿ \t").startswith("[")
    rows = spark.read.schema(schemas.CRAWLED).json(path, multiLine=multi)
    empty = F.array().cast(f"array<{schemas.MENU}>")
    return rows.withColumn("menus", F.coalesce("menus", empty)).withColumn("ordinal", F.monotonically_increasing_id())


def explode_menus(crawled: DataFrame) -> DataFrame:
    """One row per menu of a restaurant, with its place; a restaurant without menus gives none."""
    return crawled.select("source_url", "ordinal", F.posexplode("menus").alias("pos", "menu")).select("source_url", "ordinal", "pos", "menu.name", "menu.price")


def basis_status(code: Column, name: Column, basis: Column, category: Column, drinks: str = "음료 및 차류") -> Column:
    """What becomes of a source row: loaded_100g, loaded_100ml, or why it is skipped."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return (
        F.when(blank(code) | blank(name), "skipped_missing")
        .when(F.trim(basis) == "100g", "loaded_100g")
        .when((F.trim(basis) == "100ml") & (F.coalesce(F.trim(category), F.lit("")) == drinks), "skipped_drinks")
        .when(F.trim(basis) == "100ml", "loaded_100ml")
        .otherwise("skipped_basis")
    )


def official_foods(source: DataFrame, variants: list[tuple[str, str]] | None = None, drinks: str = "음료 및 차류") -> DataFrame:
    """The food table of text columns with typed values, normalised names and ``status``; keep ``loaded_*`` rows to load."""
    ship(source.sparkSession)
    numbers = {"calories": to_int(F.col("calories")), **{c: to_decimal(F.col(c)) for c in ("carbohydrate", "protein", "fat", "sodium")}}
    status = basis_status(F.col("food_code"), F.col("food_name"), F.col("serving_basis"), F.col("major_category"), drinks)
    return source.withColumns({**numbers, "status": status, "normalized_name": normalize_menu_name(nfc(F.col("food_name")), variants)})


def read_official_foods(spark: SparkSession, path: str, **options) -> DataFrame:
    """The food table from CSV by position, its header skipped. Spreadsheets go through pandas before."""
    if PurePath(path).suffix in (".xlsx", ".xls"):
        import pandas as pd

        table = pd.read_excel(path, dtype=str).iloc[:, : len(schemas.FOOD_SOURCE.split(","))]
        rows = spark.createDataFrame(table.where(table.notna(), None).values.tolist(), schemas.FOOD_SOURCE)
    else:
        rows = spark.read.schema(schemas.FOOD_SOURCE).csv(path, header=True, enforceSchema=True)
    return official_foods(rows, **options)


FOOD_STATUSES = ("loaded_100g", "loaded_100ml", "skipped_missing", "skipped_drinks", "skipped_basis")


def load_report(foods: DataFrame) -> DataFrame:
    """One row from ``official_foods``: all rows, what was loaded by basis and together, and what was skipped by reason."""
    counts = foods.agg(F.count("*").alias("total_rows"), *[F.count(F.when(F.col("status") == s, 1)).alias(s) for s in FOOD_STATUSES])
    return counts.withColumn("loaded", F.col("loaded_100g") + F.col("loaded_100ml"))


def dictionary(spark: SparkSession, path: str, columns: tuple[str, ...], required: int = 2) -> DataFrame:
    """Composed and trimmed rows of a headed CSV, a byte order mark aside; columns that it lacks are empty, and rows with a
    blank required column (as comments) go."""
    table = spark.read.csv(path, header=True, escape='"')
    names = {c.lstrip("\ufeff").strip(): c for c in table.columns}
    value = lambda c: F.trim(F.coalesce(F.col(f"`{names[c]}`"), F.lit(""))) if c in names else F.lit("")
    rows = with_nfc(table.select(*[value(c).alias(c) for c in columns]), *columns)
    return rows.filter(" and ".join(f"{c} <> ''" for c in columns[:required]))


def read_dictionary(spark: SparkSession, path: str, columns: tuple[str, ...], required: int = 2) -> list[tuple[str, ...]]:
    """The rows of a dictionary that is configuration of a few hundred rows, used as literals, in their order."""
    text = unicodedata.normalize("NFC", "\n".join(r[0] for r in spark.read.text(path).collect()).lstrip("\ufeff"))
    rows = [tuple((row.get(c) or "").strip() for c in columns) for row in csv.DictReader(io.StringIO(text))]
    return [r for r in rows if all(r[:required])]


def keywords(spark: SparkSession, path: str) -> DataFrame:
    """(keyword, food_type) of a keyword table of any size, as ``read_keywords`` gives them; a type that is not allowed fails
    the job."""
    rows = dictionary(spark, path, ("keyword", "food_type"))
    kind = F.upper("food_type")
    wrong = F.raise_error(F.concat("keyword", F.lit(": unknown type "), "food_type")).cast("string")
    return rows.select(F.lower("keyword").alias("keyword"), F.when(kind.isin(*FOOD_TYPES, BLOCKER), kind).otherwise(wrong).alias("food_type"))


def validate_types(pairs: list[tuple[str, str]], allowed: tuple[str, ...] = FOOD_TYPES, blocker: bool = False) -> list[tuple[str, str]]:
    """(key, upper-cased type) pairs; raises ValueError on a type that is not allowed."""
    out = []
    for key, value in pairs:
        kind = value.strip().upper()
        if kind not in allowed and not (blocker and kind == BLOCKER):
            raise ValueError(f"{key}: unknown type {value!r}")
        out.append((key, kind))
    return out


def read_cuisine_map(spark: SparkSession, path: str) -> dict[str, str]:
    """Later rows win."""
    return dict(validate_types(read_dictionary(spark, path, ("raw_category", "cuisine")), CUISINES))


def read_keywords(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    return [(k.lower(), t) for k, t in validate_types(read_dictionary(spark, path, ("keyword", "food_type")), blocker=True)]


def read_type_map(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Category to its food types, separated by semicolons."""
    rows = read_dictionary(spark, path, ("major_category", "food_types"))
    return {c: [t for _, t in validate_types([(c, t) for t in types.split(";") if t.strip()])] for c, types in rows}


def read_words(spark: SparkSession, path: str, column: str) -> list[str]:
    """Lower-cased brands or terms."""
    return [w.lower() for (w,) in read_dictionary(spark, path, (column,), required=1)]


def read_variants(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """Later rows win, first place kept."""
    return list({v.lower(): c.lower() for v, c in read_dictionary(spark, path, ("variant", "canonical"))}.items())


def read_scans(spark: SparkSession, path: str) -> DataFrame:
    """Stored responses of a text-recognition service, one a file, with their place as ``doc``."""
    return spark.read.schema(schemas.OCR_RESPONSE).json(path, multiLine=True).withColumn("doc", F.input_file_name())


def parse_scans(text: DataFrame, column: str = "response") -> DataFrame:
    return text.withColumn(column, F.from_json(column, schemas.OCR_RESPONSE))


def lookup(table: DataFrame, column: str, value) -> DataFrame:
    """The row of a unique key; the filter reaches the scan."""
    return table.filter(F.col(column) == F.lit(value)).limit(1)
