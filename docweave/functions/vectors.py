"""Vector functions as native column expressions."""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """The inner product over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a vector has no length."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


@functools.cache
def _previous():
    def one(v: list) -> list:
        pairs = ((np.array(a[: len(b)], float), np.array(b[: len(a)], float), a, b) for a, b in zip(v, v[1:], strict=False))
        return [None, *(float(x @ y / n) if (n := np.linalg.norm(a) * np.linalg.norm(b)) else 0.0 for x, y, a, b in pairs)][: len(v)]

    @F.arrow_udf("array<double>")
    def cosines(lists: pa.Array) -> pa.Array:
        inner = lists.flatten()
        sizes = pc.list_value_length(inner)
        if not len(inner) or inner.null_count or pc.min(sizes).as_py() != pc.max(sizes).as_py() or inner.flatten().null_count:
            return pa.array([v and one(v) for v in lists.to_pylist()], pa.list_(pa.float64()))
        x = inner.flatten().to_numpy(zero_copy_only=False).reshape(len(inner), -1)
        norms = np.sqrt((x * x).sum(1))
        size = norms[1:] * norms[:-1]
        dots = (x[1:] * x[:-1]).sum(1)
        found = np.concatenate(([0.0], np.divide(dots, size, out=np.zeros_like(dots), where=size > 0)))
        ends = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))))
        first = np.zeros(len(found), bool)
        first[ends[:-1][ends[:-1] < len(found)]] = True
        return pa.ListArray.from_arrays(ends.astype(np.int32), pa.array(found, mask=first))

    return cosines


def previous_cosines(vectors: Column) -> Column:
    """The cosine of each vector of an array and the one before it; null for the first."""
    return _previous()(vectors)


def min_max(score: Column, over: WindowSpec) -> Column:
    """Scores stretched to 0..1 within a window; equal scores become 1."""
    lo, hi = F.min(score).over(over), F.max(score).over(over)
    return F.when(hi == lo, F.lit(1.0)).otherwise((score - lo) / (hi - lo))


def to_json(vector: Column) -> Column:
    return F.to_json(vector)


def from_json(text: Column) -> Column:
    return F.from_json(text, "array<double>")


@functools.cache
def _hashed(dims: int):
    buckets: dict[str, int] = {}

    def bucket(token: str) -> int:
        found = buckets.get(token)
        if found is None:
            if len(buckets) > 200_000:
                buckets.clear()
            found = buckets[token] = int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % dims
        return found

    @F.arrow_udf("array<array<double>>")
    def embed(lists: pa.Array) -> pa.Array:
        """Lists of lists of tokens, by their flat parts: one matrix for all sentences of a batch."""
        inner = lists.flatten()
        sizes = pc.fill_null(pc.list_value_length(inner), 0).to_numpy(zero_copy_only=False)
        tokens = inner.flatten().dictionary_encode()  # each different token meets Python once a batch
        at = np.fromiter(map(bucket, tokens.dictionary.to_pylist()), np.int64)[tokens.indices.to_numpy(zero_copy_only=False)]
        cells = np.repeat(np.arange(len(sizes)), sizes) * dims + at
        counts = np.bincount(cells, minlength=len(sizes) * dims).reshape(len(sizes), dims).astype(float)
        norms = np.sqrt((counts * counts).sum(1, keepdims=True))
        rows = np.divide(counts, norms, out=counts, where=norms > 0)
        ends = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))))
        vectors = pa.ListArray.from_arrays(np.arange(0, rows.size + 1, dims, dtype=np.int32), rows.ravel())
        return pa.ListArray.from_arrays(ends.astype(np.int32), vectors)

    return embed


def hashed_embeddings(token_lists: Column, dims: int) -> Column:
    """A deterministic stand-in for an embedding model, for array<array<string>>: tokens hashed to ``dims`` buckets, counts scaled to length 1.  A null list has no vectors."""
    return _hashed(dims)(token_lists)


def hashed_embedding(tokens: Column, dims: int) -> Column:
    """The same for one list of tokens."""
    return F.get(hashed_embeddings(F.array(F.coalesce(tokens, F.array().cast("array<string>"))), dims), F.lit(0))
