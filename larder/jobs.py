"""Batch jobs over a store of tables: crawl, load, match, tag, ask a model, label, score, recommend.

A store is a folder with snapshots of tables (``larder.operators.snapshots``); a table that is not among them may lie there as
plain Parquet under its name. A job returns its report and, where ``target`` is given, publishes the new state of all tables it
changes there at once; without one it only reports. Where the target is the store itself, only the buckets that the job's keys
touch are rewritten.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from larder import schemas
from larder.enums import EXCLUDE_ANSWERS
from larder.functions.text import food_label, normalize_term
from larder.operators import aliasing, evaluation, health, ingest, matching, search, tagging, upsert
from larder.operators.snapshots import BUCKETS, Change, Snapshots
from larder.runtime import discard, materialise
from larder.sources import crawler, geocoder, readers

SCHEMAS = {"restaurant": schemas.RESTAURANT, "menu": schemas.MENUS, "official_food": schemas.FOOD, "menu_food_type": schemas.MENU_FOOD_TYPE, "menu_alias": schemas.ALIAS, "food_type_synonym": schemas.SYNONYM, "member": schemas.MEMBER, "member_disease": schemas.MEMBER_DISEASE, "inbody": schemas.INBODY}
KEYS = {"restaurant": ["source_url"], "menu": ["restaurant_id", "normalized_name"], "official_food": ["food_code"], "menu_food_type": ["menu_id", "food_type"], "menu_alias": ["normalized_name"], "food_type_synonym": ["term"], "member": ["id"], "member_disease": ["member_id", "disease"], "inbody": ["id"]}


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    path: str
    #: Buckets of tables that are new here.
    buckets: int = BUCKETS

    @property
    def snapshots(self) -> Snapshots:
        return Snapshots(self.spark, self.path)

    def read(self, name: str) -> DataFrame:
        """A table, empty where the store has none yet."""
        if name in self.snapshots.manifest()["tables"]:
            return self.snapshots.read(name)
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.parquet(f"{self.path}/{name}")

    def write(self, name: str, table: DataFrame) -> None:
        """``table`` as the whole new state of one table."""
        change = self.snapshots.change()
        change.replace(name, table, KEYS[name], self.buckets)
        change.commit()


@dataclass(frozen=True)
class Update:
    """A change of ``target`` from the tables of ``store``."""

    store: Store
    target: Store
    change: Change

    @classmethod
    def begin(cls, store: Store, target: Store) -> Update:
        return cls(store, target, target.snapshots.change())

    def in_place(self, name: str) -> bool:
        return self.target.path == self.store.path and name in self.change.tables

    def part(self, name: str, keys: DataFrame) -> DataFrame:
        """Of the store's table at least the rows of these keys: the buckets they lie in, or all of it."""
        if not self.in_place(name):
            return self.store.read(name)
        return self.target.snapshots.frame(self.change.tables[name], name, self.change.touched(name, keys))

    def upsert(self, name: str, new: DataFrame, update: list[str], insert: dict[str, Column] | None = None) -> None:
        if self.in_place(name):
            self.change.upsert(name, new, update, insert)
        else:
            self.change.replace(name, upsert.upsert(self.store.read(name), new, KEYS[name], update, insert), KEYS[name], self.target.buckets)

    def matches(self, hits: DataFrame) -> None:
        """Matched foods' values into the table of menus."""
        menus, foods = self.store.read("menu"), self.store.read("official_food")
        if self.in_place("menu"):
            hit = menus.join(hits.select(F.col("menu_id").alias("id")).distinct(), "id", "left_semi")
            self.change.upsert("menu", upsert.apply_matches(hit, hits, foods), [c for c in menus.columns if c not in KEYS["menu"]])
        else:
            self.change.replace("menu", upsert.apply_matches(menus, hits, foods), KEYS["menu"], self.target.buckets)


@dataclass(frozen=True)
class Scope:
    """Which menus a job leaves out, and the brands whose restaurants are matched in their own pools."""

    brands: tuple[str, ...] = ()
    franchise: bool = False
    branch: bool = False
    cafe: bool = False


def crawl(pages: DataFrame, target: str, area: str, keyword: str | None = None, max_count: int | None = 50, source: str = "stored_pages") -> DataFrame:
    """Restaurants with their menus from a registered crawler's pages, written as JSON lines to a new path that ``load`` reads;
    reports how many there are and how many menus they have."""
    found = crawler.create(source, pages).crawl(crawler.CrawlTarget(area, keyword, max_count))
    point = F.lit(None).cast("double")
    upsert.write_json(found.select("name", "address", "raw_category", "source_url", point.alias("latitude"), point.alias("longitude"), "menus"), target)
    written = readers.read_crawl(pages.sparkSession, target)
    return written.agg(F.count("*").alias("restaurants"), F.coalesce(F.sum(F.size("menus")), F.lit(0)).cast("long").alias("menus"))


def load(
    store: Store, crawl: str | DataFrame, cuisines: dict[str, str], target: Store | None = None, variants: list[tuple[str, str]] | None = None, terms: list[str] | None = None, places_of: geocoder.Geocoder | None = None
) -> DataFrame:
    """Restaurants and menus of a crawl (its JSON, or rows with their ``ordinal``) into both tables, as if its rows were loaded
    one after another; reports (kind, outcome, rows). Of rows with one url the first counts; rows whose urls are one without query and fragment are one
    restaurant with the last one's values and the menus of all. With a geocoder, addresses without coordinates are asked for
    and what was found is reported, too."""
    crawled = readers.read_crawl(store.spark, crawl) if isinstance(crawl, str) else crawl
    first = materialise(ingest.first_by_url(crawled), "load-first")
    once = ingest.composed(first)
    reasons = ingest.skip_reasons(once, cuisines).groupBy(F.coalesce("skip_reason", F.lit("loaded")).alias("outcome")).agg(F.count("*").alias("rows"))
    rows = ingest.restaurants(once, cuisines)
    dishes = readers.explode_menus(rows)
    names = ingest.menu_names(dishes, variants, terms)
    drops = names.groupBy(F.coalesce("drop_reason", F.lit("valid")).alias("outcome")).agg(F.sum("menus").alias("rows"))
    report = reasons.select(F.lit("restaurant").alias("kind"), "*").unionByName(drops.select(F.lit("menu").alias("kind"), "*"))
    if target is None and places_of is None:
        return report
    places = materialise(ingest.last_places(rows), "load-places")
    update = Update.begin(store, target or store)
    old = update.part("restaurant", places.select("source_url"))
    known = store.spark.createDataFrame([], geocoder.PLACES) if places_of is None else geocoder.geocode(ingest.to_geocode(places, old), places_of)
    found = materialise(ingest.resolve_location(places, old, known).drop("ordinal", "stored_fits"), "load-located")
    if places_of is not None:
        report = report.unionByName(found.groupBy(F.lit("location").alias("kind"), F.col("location_from").alias("outcome")).agg(F.count("*").alias("rows")))
    if target is None:
        return report
    report = materialise(report, "load-report")  # it reads nothing that the change writes
    top = lambda name: store.read(name).agg(F.max("id")).first()[0] or 0
    new = materialise(upsert.next_ids(old, found.drop("location_from"), KEYS["restaurant"], top=top("restaurant")), "load-new-restaurants")
    now = F.current_timestamp()
    stamped = new.withColumns({"crawled_at": now, "updated_at": now})
    update.upsert("restaurant", stamped, [c for c in stamped.columns if c not in ("id", "source_url")], {"created_at": now})
    ids = new.join(old.select("source_url", F.col("id").alias("old_id")), "source_url", "left").select("source_url", F.coalesce("old_id", "id").alias("restaurant_id"))
    menus = ingest.last_menus(ingest.with_names(dishes, names), "source_url").join(ids, "source_url").select("restaurant_id", "normalized_name", "name", "price")
    menus = materialise(menus, "load-menus")
    discard(first)
    fresh = upsert.next_ids(update.part("menu", menus), menus, KEYS["menu"], top=top("menu"))
    update.upsert("menu", fresh, ["name", "price"])
    update.change.commit()
    return report


def load_foods(store: Store, source: str, target: Store | None = None, variants: list[tuple[str, str]] | None = None) -> DataFrame:
    """The food table's source into ``official_food``, the last row of a code winning; reports the counts."""
    rows = materialise(readers.read_official_foods(store.spark, source, variants=variants).withColumn("nth", F.monotonically_increasing_id()), "load-foods")
    if target is not None:
        columns = [x.split()[0] for x in schemas.FOOD.split(", ")]
        last = upsert.last_wins(rows.filter(F.col("status").startswith("loaded")), ["food_code"], "nth")
        basis = last.withColumn("serving_basis", F.trim("serving_basis")).select(*columns)
        update = Update.begin(store, target)
        update.upsert("official_food", basis, columns[1:])
        update.change.commit()
    return readers.load_report(rows)


def matched(store: Store, scope: Scope) -> DataFrame:
    """Every menu with scope, pool and match, written once for the job."""
    places = store.read("restaurant").select(F.col("id").alias("restaurant_id"), F.col("name").alias("restaurant_name"), "cuisine")
    menus = store.read("menu").select(F.col("id").alias("menu_id"), "restaurant_id", F.col("name").alias("menu_name"), "normalized_name").join(places, "restaurant_id")
    label = matching.scope_label(F.col("restaurant_name"), F.col("cuisine"), list(scope.brands), scope.franchise, scope.branch, scope.cafe)
    return materialise(matching.match_menus(menus.withColumn("scope", label), store.read("official_food"), list(scope.brands)), "job-matches")


def match(store: Store, scope: Scope = Scope(), target: Store | None = None) -> DataFrame:
    """Matches of all menus in scope; reports totals and rates, menus by method, and what stays without a match."""
    rows = matched(store, scope)
    if target is not None:
        hits = rows.filter("scope = 'kept' and matched_by is not null").select("menu_id", "food_code", "matched_by", "confidence")
        update = Update.begin(store, target)
        update.matches(hits)
        update.change.commit()
    return evaluation.match_report(rows, store.read("official_food"), list(scope.brands))


def tag(store: Store, categories: dict[str, list[str]], keywords: list[tuple[str, str]], target: Store | None = None, include_cafe: bool = False) -> DataFrame:
    """Food types of all menus; reports the counts. Tags of menus that are gone are deleted."""
    menus = store.read("menu")
    tagged = tagging.tag_menus(menus, store.read("official_food"), store.read("restaurant"), categories, keywords, include_cafe)
    if target is not None:
        state = upsert.replace_tags(store.read("menu_food_type"), tagging.tag_rows(tagged))
        target.write("menu_food_type", upsert.without_orphans(state, menus))
    return tagging.tag_report(tagged)


def _unmatched(store: Store, scope: Scope) -> DataFrame:
    rows = matched(store, scope).filter((F.col("scope") == "kept") & F.col("matched_by").isNull() & (F.col("pool") == matching.GENERAL) & (F.col("normalized_name") != ""))
    return rows.select("menu_id", "menu_name", "normalized_name", "restaurant_name")


def _top(store: Store, names: DataFrame, scope: Scope, count: int) -> DataFrame:
    pool = matching.pools(store.read("official_food"), list(scope.brands)).filter(F.col("pool") == matching.GENERAL)
    wanted = names.select(F.lit(matching.GENERAL).alias("pool"), F.col("normalized_name").alias("name")).distinct()
    return matching.top_candidates(matching.shortlist(wanted, matching.candidates(pool)), count)


def seed_synonyms(store: Store, rows: list[tuple[str, str]], target: Store | None = None) -> DataFrame:
    """Search words and the food types they stand for, later rows winning, into ``food_type_synonym``; returns them."""
    seeds = store.spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ordinal int, term string, food_type string")
    seeds = tagging.synonyms(seeds)
    if target is not None:
        update = Update.begin(store, target)
        update.upsert("food_type_synonym", seeds, ["food_type"])
        update.change.commit()
    return seeds.orderBy("term")


def llm_match(
    store: Store, client: aliasing.LlmClient, scope: Scope = Scope(), target: Store | None = None, count: int = 10, size: int = aliasing.BATCH_CLOUD, limit: int | None = None, a_minute: int = 0, again: bool = False,
    round_size: int = aliasing.ROUND,
) -> DataFrame:
    """Asks a model about unmatched names that no stored or logged decision knows (with ``again`` about all); reports the
    outcome. Decisions of a client that persists are logged in the target round by round, so that a run that breaks off costs
    no answer twice, and stored when all are made."""
    rows = materialise(_unmatched(store, scope), "job-unmatched")
    alias = store.read("menu_alias")
    log = aliasing.DecisionLog(store.spark, f"{target.path}/_decisions") if target is not None and client.persists else None
    begun = max(log.rounds(), default=0) if log and again else 0
    stored = alias.limit(0) if again else log.known(alias) if log else alias
    groups = materialise(aliasing.with_alias(aliasing.name_groups(rows), stored), "job-groups")
    asked = aliasing.to_ask(groups, _top(store, groups.filter("not known"), scope, count), limit)
    batches = aliasing.prompts(asked, size)
    if log:
        decided = materialise(aliasing.ask_logged(batches, client, log, a_minute, round_size), "job-decisions")
    else:
        decided = materialise(aliasing.decisions(aliasing.ask(batches, client, a_minute)), "job-decisions")
    report = materialise(aliasing.report(groups, decided), "job-report")
    if target is not None:
        update = Update.begin(store, target)
        known = groups.filter("known").select("normalized_name", "food_code").unionByName(decided.select("normalized_name", "food_code"))
        update.matches(aliasing.matches_of(rows, known))
        if log:
            logged = materialise(log.read(begun), "job-logged")
            update.upsert("menu_alias", aliasing.alias_rows(logged), [c.split()[0] for c in schemas.ALIAS.split(", ")][1:])
        update.change.commit()
    return report


def export_labels(store: Store, target: str, earlier: DataFrame | None = None, scope: Scope = Scope(), sample: int = 50, count: int = 10) -> DataFrame:
    """The label sheet of a sample of unmatched menus, written as CSV to a new path; ``earlier`` is the sheet whose answers
    are carried over."""
    rows = materialise(_unmatched(store, scope), "job-unmatched")
    top = _top(store, evaluation.sample_rows(rows, "menu_id", sample), scope, count)
    shown = top.withColumn("label", food_label(F.col("food_name"), F.col("origin"), F.col("major_category")))
    codes = ", ".join(f"code_{i} string" for i in range(1, count + 1))
    old = store.spark.createDataFrame([], f"row_no int, normalized_name string, answer string, {codes}") if earlier is None else earlier
    sheet = evaluation.label_sheet(rows, shown, old, sample, count)
    upsert.write_csv(sheet.select("row_no", "menu_name", "normalized_name", "restaurant_name", "answer", *[f"{k}_{i}" for k in ("candidate", "code") for i in range(1, count + 1)]).coalesce(1), target)
    return sheet


def read_sheet(spark: SparkSession, path: str, count: int = 10) -> DataFrame:
    more = ", ".join(f"{k}_{i} string" for k in ("candidate", "code") for i in range(1, count + 1))
    return spark.read.schema(f"{schemas.LABELS}, {more}").csv(path, header=True, escape='"')


def score_labels(sheet: DataFrame, count: int = 10) -> DataFrame:
    return evaluation.label_score(sheet, count)


def llm_validate(sheet: DataFrame, client: aliasing.LlmClient, count: int = 10, size: int = aliasing.BATCH_CLOUD, a_minute: int = 0) -> DataFrame:
    """A model's choices on a labelled sheet against its answers. Rows without an answer, or left out by it, are not asked."""
    answer = F.trim(F.coalesce("answer", F.lit("")))
    rows = sheet.filter((answer != "") & ~answer.isin(*EXCLUDE_ANSWERS))
    listed = [F.filter(F.array(*[F.col(f"{k}_{i}") for i in range(1, count + 1)]), lambda c: F.coalesce(c, F.lit("")) != "") for k in ("candidate", "code")]
    asked = rows.select(F.col("row_no").cast("string").alias("normalized_name"), "menu_name", "restaurant_name", listed[0].alias("labels"), listed[1].alias("codes")).filter(F.size("codes") > 0)
    decided = aliasing.decisions(aliasing.ask(aliasing.prompts(asked, size), client, a_minute))
    choices = decided.select(F.col("normalized_name").cast("int").alias("row_no"), (F.col("decision") != "failed").alias("ok"), F.col("raw_answer").try_cast("int").alias("choice"))
    return evaluation.confusion(sheet, choices, count)


def export_branches(store: Store, target: str) -> DataFrame:
    sheet = evaluation.branch_sheet(store.read("restaurant"), store.read("menu"))
    upsert.write_csv(sheet, target)
    return sheet


def find_food(store: Store, keyword: str, limit: int = 30) -> DataFrame:
    return search.find_foods(store.read("official_food"), keyword, limit)


def category_types(store: Store) -> DataFrame:
    """A draft of the table from categories to food types."""
    return tagging.categories(store.read("official_food"))


def members(store: Store) -> DataFrame:
    """Members with the array of their ``diseases``, empty without any."""
    by = store.read("member_disease").groupBy(F.col("member_id").alias("id")).agg(F.array_sort(F.collect_set("disease")).alias("diseases"))
    return store.read("member").join(by, "id", "left").withColumn("diseases", F.coalesce("diseases", F.array().cast("array<string>")))


def targets(store: Store) -> DataFrame:
    """Daily targets of all members that have a measurement."""
    return health.member_targets(store.read("member"), store.read("inbody"))


def report(store: Store, member: int | None = None) -> DataFrame:
    """The reports of all members that have a measurement, or of one."""
    own = members(store) if member is None else members(store).filter(F.col("id") == member)
    return health.report(own, store.read("inbody"))


def recommend(store: Store, cond: search.Condition | None = None, member: int | None = None, number: int = 0, size: int = 20) -> DataFrame:
    """A page of restaurants' cards for a search, for a member's target and diseases where one is named. A keyword that is a
    stored synonym stands for its food type, too."""
    cond, who = cond or search.Condition(), search.Member()
    if cond.keyword and cond.food_type is None:
        term = store.spark.range(1).select(normalize_term(F.lit(cond.keyword))).first()[0]
        known = readers.lookup(store.read("food_type_synonym"), "term", term).first()
        cond = replace(cond, derived_type=known.food_type if known else None)
    if member is not None:
        own = members(store).filter(F.col("id") == member)
        row, daily = own.first(), health.member_targets(own, store.read("inbody")).first()
        grams = [None if daily is None or daily[c] is None else float(daily[c]) for c in ("carbohydrate", "protein", "fat")]
        who = search.Member(*grams, diseases=tuple(row.diseases) if row else ())
    cards = search.recommend(store.read("menu"), store.read("restaurant"), store.read("official_food"), store.read("menu_food_type"), cond, who)
    return search.page(cards, search.card_order(), number, size)[0]
