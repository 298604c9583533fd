"""``python -m larder JOB STORE ...``: the jobs of ``larder.jobs`` from a shell; prints the report as JSON lines."""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import SparkSession

from larder import jobs
from larder.operators import search
from larder.operators.aliasing import FakeClient, LlmClient
from larder.sources import readers
from larder.sources.geocoder import read_places

JOBS = ["crawl", "load", "load-foods", "match", "tag", "seed-synonyms", "llm-match", "llm-validate", "llm-models", "export-labels", "score-labels", "export-branches", "find-food", "category-types", "recommend", "report", "targets"]


def client_named(name: str) -> LlmClient:
    """The client that ``module:maker`` makes, or the deterministic stand-in for ``fake``."""
    if name == "fake":
        return FakeClient()
    module, _, maker = name.partition(":")
    if not maker:
        raise ValueError(f"{name!r} is neither fake nor module:maker")
    return getattr(importlib.import_module(module), maker)()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="larder", description="Jobs over a folder of tables; without --to they only report.")
    p.add_argument("job", choices=JOBS)
    p.add_argument("store", help="folder of Parquet tables")
    p.add_argument("--to", help="folder for the new state of tables, or path of a sheet")
    p.add_argument("--input", help="crawl, food table or label sheet to read")
    p.add_argument("--cuisines", help="CSV of raw categories and cuisines")
    p.add_argument("--categories", help="CSV of food categories and types")
    p.add_argument("--keywords", help="CSV of keywords and types")
    p.add_argument("--brands", help="CSV of brands")
    p.add_argument("--variants", help="CSV of spellings")
    p.add_argument("--terms", help="CSV of terms of menus to leave out")
    p.add_argument("--places", help="CSV of addresses with coordinates")
    p.add_argument("--synonyms", help="CSV of search words and types")
    p.add_argument("--area", help="area of a crawl; its restaurants' address")
    p.add_argument("--max-count", type=int, default=50)
    p.add_argument("--client", default="fake", help="module:maker of a client, or fake")
    p.add_argument("--member", type=int, help="member of a report or recommendation")
    p.add_argument("--keyword", default="")
    for name in ("exclude-franchise", "exclude-branch", "exclude-cafe", "include-cafe", "again"):
        p.add_argument(f"--{name}", action="store_true")
    p.add_argument("--sample", type=int, default=50)
    p.add_argument("--candidates", type=int, default=10)
    p.add_argument("--batch", type=int, default=20)
    p.add_argument("--limit", type=int)
    p.add_argument("--rpm", type=int, default=0)
    return p


def run(spark: SparkSession, a: argparse.Namespace):
    store, target = jobs.Store(spark, a.store), jobs.Store(spark, a.to) if a.to else None
    brands = readers.read_words(spark, a.brands, "brand") if a.brands else []
    variants = readers.read_variants(spark, a.variants) if a.variants else None
    scope = jobs.Scope(tuple(brands), a.exclude_franchise, a.exclude_branch, a.exclude_cafe)
    sheet = lambda: jobs.read_sheet(spark, a.input, a.candidates) if a.input else None
    client = client_named(a.client)
    words = lambda path, column: readers.read_words(spark, path, column) if path else None
    return {
        "crawl": lambda: jobs.crawl(spark.read.parquet(a.input), a.to, a.area, a.keyword or None, a.max_count),
        "load": lambda: jobs.load(store, a.input, readers.read_cuisine_map(spark, a.cuisines), target, variants, words(a.terms, "term"), read_places(spark, a.places) if a.places else None),
        "load-foods": lambda: jobs.load_foods(store, a.input, target, variants),
        "match": lambda: jobs.match(store, scope, target),
        "tag": lambda: jobs.tag(store, readers.read_type_map(spark, a.categories), readers.read_keywords(spark, a.keywords), target, a.include_cafe),
        "seed-synonyms": lambda: jobs.seed_synonyms(store, readers.read_dictionary(spark, a.synonyms, ("term", "food_type")), target),
        "llm-models": lambda: spark.createDataFrame([(client.name, m) for m in getattr(client, "models", lambda: [client.name])()], "client string, model string"),
        "llm-match": lambda: jobs.llm_match(store, client, scope, target, a.candidates, a.batch, a.limit, a.rpm, a.again),
        "llm-validate": lambda: jobs.llm_validate(sheet(), client, a.candidates, a.batch, a.rpm),
        "export-labels": lambda: jobs.export_labels(store, a.to, sheet(), scope, a.sample, a.candidates),
        "score-labels": lambda: jobs.score_labels(sheet(), a.candidates),
        "export-branches": lambda: jobs.export_branches(store, a.to),
        "find-food": lambda: jobs.find_food(store, a.keyword, a.limit or 30),
        "category-types": lambda: jobs.category_types(store),
        "recommend": lambda: jobs.recommend(store, search.Condition(keyword=a.keyword or None), a.member, size=a.limit or 20),
        "report": lambda: jobs.report(store, a.member),
        "targets": lambda: jobs.targets(store),
    }[a.job]()


def main() -> None:
    args = parser().parse_args()
    spark = SparkSession.builder.appName(f"larder-{args.job}").getOrCreate()
    for line in run(spark, args).toJSON().toLocalIterator():
        print(line)
    spark.stop()


if __name__ == "__main__":
    main()
