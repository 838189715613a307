"""Web pages as documents, and crawling over a table of pages."""

from __future__ import annotations

from urllib.parse import urldefrag, urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarnwell.durable import checkpointed
from skarnwell.functions import text as T


def page_documents(pages: DataFrame, url: str, html: str, strip_scripts: bool = False) -> DataFrame:
    """(path, title, text, metadata) of pages; the path leaves the query string out."""
    title, body = T.page_title(F.col(html)), T.html_to_text(F.col(html), strip_scripts)
    text = F.concat(F.lit("# "), title, F.lit("\n\nURL: "), F.col(url), F.lit("\n\n"), body)
    return pages.select(T.web_path(F.col(url)).alias("path"), title.alias("title"), text.alias("text"), F.create_map(F.lit("url"), F.col(url)).alias("metadata"))


def _absolute(urls: pd.Series, links: pd.Series) -> pd.Series:
    out = []
    for u, found in zip(urls, links, strict=True):
        host = urlsplit(u).netloc
        full = (urldefrag(urljoin(u, x))[0] for x in found)
        out.append(sorted({x for x in full if urlsplit(x).netloc == host and urlsplit(x).scheme in ("http", "https")}))
    return pd.Series(out)


def link_table(pages: DataFrame, url: str, html: str) -> DataFrame:
    """(url, link): links of pages to pages of the same host, absolute and without fragments."""
    return pages.select(F.col(url).alias("url"), F.explode(F.pandas_udf(_absolute, "array<string>")(F.col(url), T.page_links(F.col(html)))).alias("link")).distinct()


def crawl(links: DataFrame, start: DataFrame, depth: int = 2, max_pages: int = 50) -> DataFrame:
    """(url, depth): pages within `depth` links of the start pages, breadth first; max_pages is how many a crawl takes at most.

    Each level is one join of the frontier with the link table and one anti-join with what was seen.
    """
    seen = start.select("url", F.lit(0).alias("depth")).distinct()
    frontier = seen
    for d in range(1, depth + 1):
        nxt = links.join(frontier.select("url"), "url").select(F.col("link").alias("url")).distinct()
        frontier = checkpointed(nxt.join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(d)))
        seen = seen.unionByName(frontier)
    return seen.orderBy("depth", "url").limit(max_pages)


def path_collisions(pages: DataFrame, url: str) -> DataFrame:
    """(path, urls): paths that more than one address has, since the query string is left out."""
    return pages.groupBy(T.web_path(F.col(url)).alias("path")).agg(F.countDistinct(url).alias("urls")).filter("urls > 1")
