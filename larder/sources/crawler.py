"""Crawlers behind one interface, and one that reads stored pages. Nothing here uses the network."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, functions as F

from larder.functions.text import menu_row, place_id


@dataclass(frozen=True)
class CrawlTarget:
    area: str
    keyword: str | None = None
    max_count: int | None = 50

    def __post_init__(self):
        if not self.area.strip() or (self.max_count is not None and self.max_count < 1):
            raise ValueError("a crawl needs an area and a positive count")


class Crawler(Protocol):
    def crawl(self, target: CrawlTarget) -> DataFrame: ...


_CRAWLERS: dict[str, Callable[..., Crawler]] = {}


def register(name: str, make: Callable[..., Crawler]) -> None:
    _CRAWLERS[name] = make


def create(name: str, *args, **kwargs) -> Crawler:
    if name not in _CRAWLERS:
        raise ValueError(f"unknown crawler {name!r}; there are {', '.join(sorted(_CRAWLERS))}")
    return _CRAWLERS[name](*args, **kwargs)


class StoredPages:
    """Restaurants from stored HTML pages (page_id, url, html): the title is the name, list items are menu rows.

    One restaurant per place; those without menus are dropped; at most ``max_count`` of the target's area come back, the
    first by page; all of them where it is None.
    """

    def __init__(self, pages: DataFrame):
        self.pages = pages

    def crawl(self, target: CrawlTarget) -> DataFrame:
        html = F.coalesce("html", F.lit(""))
        items = F.transform(F.regexp_extract_all(html, F.lit(r"(?s)<li[^>]*>(.*?)</li>"), 1), lambda x: menu_row(F.regexp_replace(x, "<[^>]*>", "")))
        rows = self.pages.select(
            "page_id",
            F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1).alias("name"),
            F.lit(target.area).alias("address"),
            F.regexp_extract("url", r"://[^/]*/([^/?#]*)", 1).alias("raw_category"),
            F.col("url").alias("source_url"),
            F.coalesce(place_id(F.col("url")), "url").alias("place"),
            F.filter(items, lambda m: m.isNotNull()).alias("menus"),
        ).filter(F.size("menus") > 0)
        if target.keyword:
            rows = rows.filter(F.contains("name", F.lit(target.keyword)))
        one = rows.groupBy("place").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "place"]), "page_id").alias("r")).select("r.*")
        return one if target.max_count is None else one.orderBy("page_id").limit(target.max_count)


register("stored_pages", StoredPages)
