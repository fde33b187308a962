"""Embedding of chunks with a cache keyed by content hash and model."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_hash, tokenize
from ..functions.vectors import hashed_embedding
from ..schema import EMBED_BATCH

#: A model: texts and their kind ("passage" or "query") to (index, vector) pairs, in any order.
Model = Callable[[list[str], str], list[tuple[int, list[float]]]]


def with_retries(call: Callable, tries: int = 3, first_wait: float = 1.0, longest_wait: float = 8.0):
    """The result of call(); after a failure it is tried again, waiting twice as long each time."""
    for n in range(tries):
        try:
            return call()
        except Exception:
            if n == tries - 1:
                raise
            time.sleep(min(longest_wait, first_wait * 2**n))


def model_udf(model: Model, kind: str = "passage", batch: int = EMBED_BATCH, first_wait: float = 1.0):
    """A column function that calls the model for each ``batch`` texts, a failed call again after a wait, and restores their order by index."""

    @F.pandas_udf("array<double>")
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            out: list[list[float]] = []
            for at in range(0, len(texts), batch):
                some = texts.iloc[at : at + batch].tolist()
                found = with_retries(lambda some=some: model(some, kind), first_wait=first_wait)
                out += [[float(x) for x in v] for _, v in sorted(found, key=lambda p: p[0])]
            yield pd.Series(out, index=texts.index, dtype=object)

    return embed


def hashing_model(dims: int = 64) -> Callable[[Column], Column]:
    """The offline stand-in."""
    return lambda text: hashed_embedding(tokenize(text), dims)


def split_by_cache(chunks: DataFrame, cache: DataFrame, model_id: str, key: Column) -> tuple[DataFrame, DataFrame]:
    """(hits with their vector, misses), by ``key`` and model."""
    known = cache.where(F.col("model_id") == model_id).select(F.col("content_hash").alias("__h"), "vector").dropDuplicates(["__h"])
    keyed = chunks.withColumn("__k", key)
    hits = keyed.join(known, F.col("__k") == F.col("__h")).drop("__h")
    misses = keyed.join(known, F.col("__k") == F.col("__h"), "left_anti")
    return hits, misses


def embed_cached(chunks: DataFrame, cache: DataFrame, model_id: str, embed: Callable[[Column], Column], per: str = "chunk") -> tuple[DataFrame, DataFrame]:
    """(chunks with vector and model_id, new cache rows).  Only texts that the cache lacks are embedded.

    per="chunk" keys the cache by each chunk's own text; per="document" by its document's hash, so that all
    chunks of a cached document get one vector (the last chunk's).  Each distinct text is embedded once.
    """
    key = content_hash(F.col("content")) if per == "chunk" else F.col("content_hash")
    hits, misses = split_by_cache(chunks, cache, model_id, key)
    if per == "chunk":
        fresh = misses.groupBy("__k").agg(F.first("content").alias("__c")).select(F.col("__k").alias("__h"), embed(F.col("__c")).alias("vector"))
        done = misses.join(fresh, F.col("__k") == F.col("__h")).drop("__h")
        new = fresh.select(F.col("__h").alias("content_hash"), F.lit(model_id).alias("model_id"), "vector", F.current_timestamp().alias("created_at"))
    else:
        done = misses.withColumn("vector", embed(F.col("content")))
        last = done.groupBy("__k").agg(F.max_by("vector", "chunk_index").alias("vector"))
        new = last.select(F.col("__k").alias("content_hash"), F.lit(model_id).alias("model_id"), "vector", F.current_timestamp().alias("created_at"))
    out = hits.unionByName(done).drop("__k").withColumn("model_id", F.lit(model_id))
    return out, new
