"""Cleaners for text and the choice among them."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .html import clean_html
from .text import drop_controls


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def clean_text(text: Column) -> Column:
    """NFKC, then no control characters.  Spark has no NFKC, hence the Arrow batches."""
    return drop_controls(_nfkc(text))


def clean(content: Column, source_type: Column) -> Column:
    """HTML and web pages by their text nodes, all else as text."""
    page = source_type.isin("html", "website")
    return F.when(page, clean_html(F.when(page, content))).otherwise(clean_text(F.when(~page, content)))
