"""URLs and sitemaps as column expressions."""

from __future__ import annotations

from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, slugify

#: Where articles lie, phrases of sections left out, and how ids begin.
ARTICLE_PATH = "/hc/en-us/articles/"
EXCLUDED_PHRASES = ["dev mode", "work together in files"]
ID_PREFIX = "help-center-"


def normalize_url(u: Column | str) -> Column:
    """Without white space around it, query, fragment, and slashes at the path's end."""
    bare = F.regexp_replace(F.btrim(col(u), F.lit(" \t\n\r\x0b\x0c")), "[?#][\\s\\S]*$", "")
    return F.regexp_replace(bare, "/+$", "")


def part(u: Column | str, name: str) -> Column:
    return F.try_parse_url(col(u), F.lit(name))


def is_article_url(u: Column | str, host: str, path: str = ARTICLE_PATH) -> Column:
    """http or https, this very host, and a path below path."""
    ok = part(u, "PROTOCOL").isin("http", "https") & (part(u, "AUTHORITY") == host) & F.startswith(part(u, "PATH"), F.lit(path))
    return F.coalesce(ok, F.lit(False))


def excluded_phrase(u: Column | str, title: Column | str, breadcrumbs: Column | str, phrases: list[str] = EXCLUDED_PHRASES) -> Column:
    """The first phrase, or its slug, in the URL, the title or the breadcrumbs; null if the article is in scope."""
    text = F.lower(F.concat_ws(" ", col(u), col(title), F.concat_ws(" ", col(breadcrumbs))))
    return F.coalesce(*(F.when(F.contains(text, F.lit(p)) | F.contains(text, F.lit(p.replace(" ", "-"))), F.lit(p)) for p in phrases))


def document_id(u: Column | str, title: Column | str | None = None, prefix: str = ID_PREFIX) -> Column:
    """The prefix and the slug of the path's last part, or of the title where there is none."""
    last = slugify(F.element_at(F.split(F.regexp_replace(F.coalesce(part(u, "PATH"), F.lit("")), "/+$", ""), "/"), -1))
    other = slugify(title) if title is not None else F.lit("")
    return F.concat(F.lit(prefix), F.coalesce(F.nullif(last, F.lit("")), other))


def product_area(breadcrumbs: Column | str, title: Column | str) -> Column:
    """Slug of the first breadcrumb, else of the title, else unknown."""
    return F.when(F.size(col(breadcrumbs)) > 0, slugify(F.get(col(breadcrumbs), F.lit(0)))).otherwise(F.coalesce(F.nullif(slugify(title), F.lit("")), F.lit("unknown")))


def topic(breadcrumbs: Column | str) -> Column:
    return F.coalesce(F.get(col(breadcrumbs), F.lit(1)), F.lit(""))


def sitemap(xml: Column | str) -> Column:
    """sitemaps: places of nested sitemaps, pages: those of pages, both empty for any other document; error: why it is not XML.

    Sitemaps are few beside pages; they are read in Python, where a malformed one is a row like any other.
    """
    return F.pandas_udf(_read_sitemaps, "sitemaps array<string>, pages array<string>, error string")(col(xml))


def _read_sitemaps(documents: pd.Series) -> pd.DataFrame:
    bare = lambda element: element.tag.rpartition("}")[2] if isinstance(element.tag, str) else ""
    rows = []
    for document in documents:
        found: dict[str, list[str]] = {"sitemapindex": [], "urlset": []}
        error = None
        try:
            root = ElementTree.fromstring((document or "").strip())
            places = [(place.text or "").strip() for entry in root if bare(entry) in ("sitemap", "url") for place in entry if bare(place) == "loc"]
            found[bare(root)] = [p for p in places if p]
        except (ElementTree.ParseError, ValueError) as raised:
            error = f"{type(raised).__name__}: {raised}"
        rows.append((found["sitemapindex"], found["urlset"], error))
    return pd.DataFrame(rows, columns=["sitemaps", "pages", "error"])
