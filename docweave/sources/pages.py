"""Web pages from a table of fetched pages.

Fetching itself (a GET that follows redirects, 30 seconds, three tries) is given as a function; the table is what it returns.
"""

from __future__ import annotations

import urllib.request
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.embed import with_retries
from .files import raw_rows

FETCHED = "url string, html string, content_type string, content_length string, last_modified string, error string"


def http_get(url: str, timeout: float = 30.0) -> dict:
    """One page by the standard library; the URL is the one after redirects."""
    with urllib.request.urlopen(url, timeout=timeout) as r:
        charset = r.headers.get_content_charset() or "utf-8"
        return {"url": r.geturl(), "html": r.read().decode(charset, "replace"), "content_type": r.headers.get("Content-Type"), "content_length": r.headers.get("Content-Length"), "last_modified": r.headers.get("Last-Modified")}


def fetch_pages(urls: DataFrame, get: Callable[[str], dict] = http_get, first_wait: float = 1.0) -> DataFrame:
    """Rows of FETCHED for a table of urls; a page that can't be fetched in three tries has its error."""

    def run(parts):
        for p in parts:
            rows = []
            for url in p["url"]:
                try:
                    rows.append(with_retries(lambda url=url: get(url), first_wait=first_wait) | {"error": None})
                except Exception as e:
                    rows.append({"url": url, "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(rows, columns=["url", "html", "content_type", "content_length", "last_modified", "error"])

    return urls.select("url").mapInPandas(run, FETCHED)


def load_pages(pages: DataFrame, kb: str) -> DataFrame:
    """Raw documents of pages (url, html and, if there, content_type, content_length, last_modified)."""
    col = lambda name: F.col(name) if name in pages.columns else F.lit(None).cast("string")
    size = T.length_of_header(col("content_length"), F.col("html"))
    return raw_rows(pages, F.col("html"), F.col("url"), F.lit("website"), kb, mime=T.mime_of_header(col("content_type")), size=size, modified=T.http_date(col("last_modified")))
