"""Normalising crawled restaurants: required values, cuisine, valid menus, duplicates, location."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from larder.functions.numeric import gate_distance
from larder.functions.text import has_term, is_beverage, is_notice, is_set_or_course, normalize_menu_name, source_url, strip, with_nfc
from larder.runtime import discard, materialise


def composed(crawled: DataFrame) -> DataFrame:
    """Crawled rows with every text of their own composed, before anything else is done to them; ``menu_names`` composes menus'."""
    return with_nfc(crawled, "name", "address", "raw_category", "source_url")


def skip_reasons(crawled: DataFrame, cuisine_map: dict[str, str]) -> DataFrame:
    """``crawled`` with ``cuisine`` and ``skip_reason`` (missing_required, unmapped_category, or null for rows to load).

    An unmapped category is skipped, never made ETC.
    """
    spark = crawled.sparkSession
    known = spark.createDataFrame(list(cuisine_map.items()), "raw_key string, cuisine string")  # a dictionary of some hundred rows
    blank = lambda c: strip(F.coalesce(F.col(c), F.lit(""))) == ""
    joined = crawled.withColumn("raw_key", strip(F.coalesce("raw_category", F.lit("")))).join(F.broadcast(known), "raw_key", "left").drop("raw_key")
    reason = F.when(blank("name") | blank("address") | blank("source_url"), "missing_required").when(F.col("cuisine").isNull(), "unmapped_category")
    return joined.withColumn("skip_reason", reason)


def first_by_url(crawled: DataFrame) -> DataFrame:
    """The first row of each url in input order (``ordinal``)."""
    columns = crawled.columns
    return crawled.groupBy("source_url").agg(F.min_by(F.struct(*columns), "ordinal").alias("r")).select("r.*")


def restaurants(crawled: DataFrame, cuisine_map: dict[str, str]) -> DataFrame:
    kept = skip_reasons(crawled, cuisine_map).filter("skip_reason is null")
    return kept.select(strip(F.col("name")).alias("name"), strip(F.col("address")).alias("address"), "cuisine", source_url(strip(F.col("source_url"))).alias("source_url"), "latitude", "longitude", "menus", "ordinal")


def last_places(places: DataFrame) -> DataFrame:
    """One row for each normalised url, with what loading its rows one after another leaves: the last row's values, and its
    coordinates or else those of the nearest row before it at the same address with no other address between. ``stored_fits``
    is false where another address came between the stored row and the last one."""
    own = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    point = F.max(F.when(own, F.struct("ordinal", "latitude", "longitude")))
    homes = places.groupBy("source_url", "address").agg(F.max("ordinal").alias("last"), F.max_by(F.struct("name", "cuisine"), "ordinal").alias("r"), point.alias("p"))
    by_last = Window.partitionBy("source_url").orderBy(F.desc("last"))
    two = homes.withColumn("nth", F.row_number().over(by_last)).filter("nth <= 2")
    home = F.max_by(F.struct("address", "r", "p"), "last").alias("h")
    one = two.groupBy("source_url").agg(home, F.max("last").alias("ordinal"), F.min(F.when(F.col("nth") == 2, F.col("last"))).alias("before"))
    near = F.col("before").isNull() | (F.col("h.p.ordinal") > F.col("before"))
    at = [F.when(near, F.col(f"h.p.{c}")).alias(c) for c in ("latitude", "longitude")]
    return one.select("h.r.name", "h.address", "h.r.cuisine", "source_url", *at, "ordinal", F.col("before").isNull().alias("stored_fits"))


def menu_status(menus: DataFrame, variants: list[tuple[str, str]] | None = None, terms: list[str] | None = None) -> DataFrame:
    """``menus`` with names stripped, ``normalized_name`` and ``drop_reason``, null for valid menus. Volume is looked for in
    the original name."""
    named = menus.withColumn("name", strip(F.col("name"))).withColumn("normalized_name", normalize_menu_name(F.col("name"), variants))
    n = F.col("normalized_name")
    reason = (
        F.when(F.coalesce("name", F.lit("")) == "", "blank")
        .when(n == "", "empty")
        .when(is_beverage(F.col("name")), "beverage")
        .when(is_notice(n), "notice")
        .when(is_set_or_course(n), "set_or_course")
        .when(has_term(n, terms or []), "excluded_term")
    )
    return named.withColumn("drop_reason", reason)


def menu_names(menus: DataFrame, variants: list[tuple[str, str]] | None = None, terms: list[str] | None = None) -> DataFrame:
    """Each name of ``menus`` once, as crawled (``crawled_name``), with how many menus have it (``menus``) and, composed, its
    ``menu_status``: many restaurants sell what one name says, and cleaning it is the dearest part of loading a menu."""
    each = materialise(menus.groupBy(F.col("name").alias("crawled_name")).agg(F.count("*").alias("menus")), "menu-names")
    # Names are few bytes beside the work on them: parts by bytes would leave it to one task.
    parts = int(each.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = each.repartition(parts, "crawled_name").withColumn("name", F.col("crawled_name"))
    named = materialise(menu_status(with_nfc(dealt, "name"), variants, terms), "menu-status")
    discard(each)
    return named


def with_names(menus: DataFrame, names: DataFrame) -> DataFrame:
    """Valid menus with their names as ``menu_names`` gives them."""
    valid = names.filter("drop_reason is null").select(F.col("crawled_name").alias("name"), F.col("name").alias("clean_name"), "normalized_name")
    return menus.join(valid, "name").drop("name").withColumnRenamed("clean_name", "name")


def distinct_pairs(menus: DataFrame, owner: str) -> DataFrame:
    """One row per name and price of an owner, nulls equal, at its first place."""
    return menus.groupBy(owner, "name", "price").agg(F.min("pos").alias("pos"))


def first_by_normalized(menus: DataFrame, owner: str) -> DataFrame:
    """The first menu of each normalised name of an owner, and ``copies``, how many there were."""
    columns = [c for c in menus.columns if c not in (owner, "normalized_name")]
    return menus.groupBy(owner, "normalized_name").agg(F.min_by(F.struct(*columns), "pos").alias("r"), F.count("*").alias("copies")).select(owner, "normalized_name", "r.*", "copies")


def last_menus(menus: DataFrame, owner: str) -> DataFrame:
    """Of each normalised name of an owner the menu that loading its rows one after another leaves: a later row replaces an
    earlier one's (``ordinal``), within a row the first stays (``pos``)."""
    columns = [c for c in menus.columns if c not in (owner, "normalized_name")]
    first = F.min_by(F.struct(*columns), F.struct(-F.col("ordinal"), "pos"))
    return menus.groupBy(owner, "normalized_name").agg(first.alias("r")).select(owner, "normalized_name", "r.*")


def resolve_location(incoming: DataFrame, stored: DataFrame, geocoded: DataFrame) -> DataFrame:
    """Coordinates from the crawl, else from the stored row of the url if its address is the same, else from the geocoder.

    ``geocoded`` (address, latitude, longitude) is what a geocoder returned. Rows may say with ``stored_fits`` that the stored
    row is not to be used. Adds latitude, longitude, location_from and
    the distances to both gates, null without coordinates.
    """
    old = stored.select("source_url", F.col("address").alias("old_address"), F.col("latitude").alias("old_lat"), F.col("longitude").alias("old_lng"))
    geo = geocoded.select("address", F.col("latitude").alias("geo_lat"), F.col("longitude").alias("geo_lng"))
    joined = incoming.join(old, "source_url", "left").join(geo, "address", "left")
    crawled = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    fits = F.col("stored_fits") if "stored_fits" in incoming.columns else F.lit(True)
    cached = (F.col("old_address") == F.col("address")) & F.col("old_lat").isNotNull() & fits
    found = F.col("geo_lat").isNotNull()

    def pick(own: str, stored_: str, geo_: str):
        return F.when(crawled, F.col(own)).when(cached, F.col(stored_)).when(found, F.col(geo_))

    origin = F.when(crawled, "crawled").when(cached, "cached").when(found, "geocoded").otherwise("none")
    located = joined.select(*[c for c in incoming.columns if c not in ("latitude", "longitude")], pick("latitude", "old_lat", "geo_lat").alias("latitude"), pick("longitude", "old_lng", "geo_lng").alias("longitude"), origin.alias("location_from"))
    return located.withColumns({f"distance_to_{g.lower()}": gate_distance(F.col("latitude"), F.col("longitude"), g) for g in ("MAIN_GATE", "BACK_GATE")})


def to_geocode(places: DataFrame, stored: DataFrame) -> DataFrame:
    """The addresses that neither the crawl nor the stored row has coordinates for, each once."""
    none = places.sparkSession.createDataFrame([], "address string, latitude double, longitude double")
    return resolve_location(places, stored, none).filter("location_from = 'none'").select("address").distinct()


def in_file_order(df: DataFrame, key: str, ordinal: str = "ordinal") -> DataFrame:
    """Adds ``nth``, the place of a row among those of its key, from 1."""
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(ordinal)))
