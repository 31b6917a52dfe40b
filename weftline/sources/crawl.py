"""Discovery of articles: sitemaps as a table, a frontier of nested ones, and what to fetch of what is found."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from .tables import new_only, settled


def discover(sitemaps: DataFrame, root: str) -> DataFrame:
    """Distinct page URLs in order, of the sitemap root and all below it; sitemaps(url, xml) holds the documents.

    Each round joins the frontier with the table; a sitemap that has been seen is not read again, and one that is no XML
    has no pages (malformed shows them).
    """
    spark = sitemaps.sparkSession
    read = sitemaps.select("url", urls.sitemap("xml").alias("found"))
    seen = frontier = spark.createDataFrame([(root,)], "url string")
    pages = None
    while True:
        got = read.join(frontier, "url").select("found.sitemaps", "found.pages").cache()
        here = got.select(F.explode("pages").alias("url"))
        pages = here if pages is None else pages.unionByName(here)
        frontier = got.select(F.explode("sitemaps").alias("url")).distinct().join(seen, "url", "left_anti")
        frontier = settled(frontier)
        if frontier.isEmpty():
            return pages.distinct().orderBy("url")
        seen = seen.unionByName(frontier)


def malformed(sitemaps: DataFrame) -> DataFrame:
    """url and error of the documents that are no XML."""
    return sitemaps.select("url", urls.sitemap("xml")["error"].alias("error")).where("error IS NOT NULL")


def to_fetch(found: DataFrame, existing: DataFrame, host: str, limit: int | None = None, overwrite: bool = False) -> DataFrame:
    """Article URLs, normalized: the first limit of all in order, then less those that are known."""
    own = found.where(urls.is_article_url("url", host)).select(urls.normalize_url("url").alias("source_url")).distinct().orderBy("source_url")
    own = own if limit is None else own.limit(limit)
    return new_only(own, existing, "source_url", overwrite)


class Fetcher(Protocol):
    """Returns a page's HTML; one is made for each task."""

    def get(self, url: str) -> str: ...


def fetch(wanted: DataFrame, make: Callable[[], Fetcher]) -> DataFrame:
    """source_url with html, or the error that its fetch raised."""

    def run(frames) -> Iterator:
        fetcher = make()
        for frame in frames:
            pages, errors = [], []
            for url in frame["source_url"]:
                try:
                    pages.append(fetcher.get(url)), errors.append(None)
                except Exception as raised:  # whatever a fetch raises belongs to its row
                    pages.append(None), errors.append(f"{type(raised).__name__}: {raised}")
            yield frame.assign(html=pages, error=errors)

    return wanted.select("source_url").mapInPandas(run, "source_url string, html string, error string")


def manifest(fetched: DataFrame, metadata: DataFrame, source_type: str = "help_center") -> tuple[DataFrame, DataFrame]:
    """Rows of the raw manifest, and the pages left out of scope with the phrase; metadata(source_url, title, breadcrumbs)."""
    own = fetched.where("html IS NOT NULL").select("source_url").join(metadata, "source_url").withColumn("excluded", urls.excluded_phrase("source_url", "title", "breadcrumbs"))
    rows = own.where("excluded IS NULL").select(
        urls.document_id("source_url", "title").alias("document_id"), "title", "source_url", F.lit(source_type).alias("source_type"),
        urls.product_area("breadcrumbs", "title").alias("product_area"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("fetch_timestamp"),
    )
    return rows, own.where("excluded IS NOT NULL").select("source_url", "excluded")
