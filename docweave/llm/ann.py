"""Nearest neighbours by cross-polytope hashing.

A vector is turned by a pseudo-random rotation (three rounds of random signs and a fast Hadamard transform) and
assigned to the signed axis that it is nearest to.  Each of several tables has its own rotation.  A query probes, in each
table, the axes that it is nearest to, best first.  Vectors and probes meet by table and span of ``SPAN`` axes in groups of bounded
size: a query that probes several axes of a span is sent there once, with the list of these axes.  A group computes inner products as
one matrix product, looks at those of probed axes only, and passes on the nearest of each query.  The nearest of
all groups, by double-precision inner products of the original vectors, are the result.

Equal vectors are one class, so a vector that very many rows share costs one entry; a class brings its smallest ids.
Vectors of unlike norms get one more component that makes norms equal, which turns the largest inner product into the smallest angle.

The number of probes is fitted on a bounded sample (``SAMPLE`` vectors, ``TRIALS`` of these as queries) to the recall asked for;
neighbours in a sample are farther than in all rows and so harder to find, which keeps the number on the safe side.  All rows are indexed.

Defined results: vectors null, empty, of another length than most, zero or with null or non-finite components take no part, as row or query; fewer
candidates than k give as many ranks; ties (of scores rounded to twelve decimals) go to the smaller id; rows with a null id take no part; repeated ids are
rows of their own (a query's own id is never its result); an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import keep

#: Tables; axes of a span; entries of a span's block; queries of a block; queries scored at once.
TABLES, SPAN, BLOCK, QUERIES, ROWS = 4, 16, 8192, 4096, 256
#: Sample and trials for fitting; probes tried.
SAMPLE, TRIALS, STEPS = 20_000, 200, (2, 4, 8, 12, 16, 20, 24, 28, 32, 40, 48, 64, 96, 128, 1 << 20)


def hadamard(x: np.ndarray) -> np.ndarray:
    """Rows times the normalised Hadamard matrix; the number of columns is a power of two."""
    n, half = x.shape[1], 1
    while half < n:
        y = x.reshape(len(x), -1, 2, half)
        x = np.concatenate((y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]), axis=2).reshape(len(x), n)
        half *= 2
    return x / np.sqrt(n)


def rotated(x: np.ndarray, table: int, seed: int) -> np.ndarray:
    """Rows under the pseudo-rotation of a table; columns are padded to a power of two."""
    size = 1 << max(1, (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, size - x.shape[1])))
    rng = np.random.default_rng([seed, table])
    for _ in range(3):
        x = hadamard(x * rng.choice((-1.0, 1.0), size))
    return x


def axes(x: np.ndarray) -> np.ndarray:
    """The nearest signed axis of each row: 2 * axis, plus 1 if negative."""
    a = np.abs(x).argmax(1)
    return 2 * a + (x[np.arange(len(x)), a] < 0)


def probes(x: np.ndarray, n: int) -> np.ndarray:
    """The n nearest signed axes of each row, nearest first."""
    both = np.empty((len(x), 2 * x.shape[1]))
    both[:, 0::2], both[:, 1::2] = x, -x
    return np.argsort(-both, axis=1, kind="stable")[:, :n]


def lifted(x: np.ndarray, norm: float, query: bool) -> np.ndarray:
    """Unit rows: x over the largest norm with what is missing to 1 as one more component (queries: 0).  Equal norms need none."""
    if norm == 0:  # said for equal norms
        return x / np.linalg.norm(x, axis=1, keepdims=True)
    if query:
        return np.pad(x / np.linalg.norm(x, axis=1, keepdims=True), ((0, 0), (0, 1)))
    x = x / norm
    return np.concatenate((x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1)))[:, None]), axis=1)


def _clean(vector: Column) -> Column:
    """True for vectors that take part."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda v: v != 0)


def fit_probes(x: np.ndarray, norm: float, k: int, recall: float, seed: int, sure: int) -> int:
    """The least number of probes of STEPS that finds this share of the k nearest in a sample; all where the sample has ``sure`` rows at most."""
    if len(x) <= max(sure, k + 1):
        return STEPS[-1]
    q = np.random.default_rng(seed).permutation(len(x))[:TRIALS]
    score = x[q] @ x.T
    score[np.arange(len(q)), q] = -np.inf
    near = np.argpartition(-score, k, axis=1)[:, :k]
    data, ask = lifted(x, norm, False), lifted(x[q], norm, True)
    rank = np.full((len(q), len(x)), 1 << 30)  # the probe that first finds a row
    for table in range(TABLES):
        order = probes(rotated(ask, table, seed), 1 << 20)
        place = np.argsort(order, axis=1)
        np.minimum(rank, place[:, axes(rotated(data, table, seed))], out=rank)
    found = np.take_along_axis(rank, near, 1)
    return next(n for n in STEPS if (found < n).mean() >= recall)


def nearest(df: DataFrame, is_query: Column, k: int = 20, recall: float = 0.96, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 7, sure: int = 300) -> DataFrame:
    """(query_id, rank, id, score): the k nearest rows found for each query row, by inner product, the query's own id left out.

    ``sure``: with so many different vectors or fewer all axes are probed, since a fit on so few says little about recall.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("q")).where(F.col("id").isNotNull() & _clean(F.col("v")))
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if size is None:
        return spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")
    rows = rows.where(F.size("v") == size["d"]).withColumn("key", F.sha2(F.array_join(F.transform("v", lambda x: x.cast("string")), " "), 256))
    # Of a class of equal vectors, k + 1 ids are enough: one may be the query's own.
    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("id"))).where(F.col("n") <= k + 1)
    found = ranked.groupBy("key").agg(F.first("v").alias("v"), F.array_sort(F.collect_list("id")).alias("ids"))
    classes = keep(found.select(F.monotonically_increasing_id().alias("cid"), "key", "v", "ids"))
    asked = keep(rows.where(F.coalesce("q", F.lit(False))).select("id", "key").join(classes.select("key", "cid"), "key").select("id", "cid"))
    sample = np.array([r[0] for r in classes.select("v", "key").orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select("v").collect()])
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    low, high = classes.agg(F.min(length), F.max(length)).first()
    norm = 0.0 if high - low <= 1e-6 * high else float(high)
    n_probes = fit_probes(sample, norm, k, recall, seed, sure)
    entries = keep(classes.select("cid", "v").mapInPandas(_hashed(norm, seed, 0), "tab int, span int, cells array<int>, cid long"))
    total = rows.count()
    wanted = asked.select("cid").distinct().join(classes.select("cid", "v"), "cid")
    best = keep(_search(entries, classes, wanted, norm, seed, n_probes, k))
    # A query whose buckets hold too few rows (a small cluster far from all else) probes all axes.
    short = wanted.join(best.where(F.size("near") >= min(k + 1, total)), F.col("cid") == F.col("asker"), "left_anti")
    if not short.isEmpty():
        best = best.join(short, F.col("cid") == F.col("asker"), "left_anti").unionByName(_search(entries, classes, short, norm, seed, STEPS[-1], k))
    own = asked.join(best, F.col("cid") == F.col("asker"))
    flat = own.select(F.col("id").alias("query_id"), F.posexplode(F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k)).alias("p", "x"))
    return flat.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.id").alias(id_col), F.col("x.s").alias("score"))


def _hashed(norm: float, seed: int, n_probes: int):
    """Rows (tab, span, cells, cid): the axes of each vector (n_probes 0) or of each query's probes, in each table and span."""

    def run(batches):
        for p in batches:
            if not len(p):
                continue
            x, cids = lifted(np.array(p["v"].tolist()), norm, n_probes > 0), p["cid"].to_numpy()
            for table in range(TABLES):
                y = rotated(x, table, seed)
                cells = probes(y, n_probes) if n_probes else axes(y)[:, None]
                cells = np.sort(cells, axis=1)
                who = np.repeat(np.arange(len(p)), cells.shape[1])
                spans, flat = cells.ravel() // SPAN, cells.ravel()
                first = np.flatnonzero(np.concatenate(([True], (spans[1:] != spans[:-1]) | (who[1:] != who[:-1]))))
                yield pd.DataFrame({"tab": np.int32(table), "span": spans[first].astype(np.int32), "cells": [c.astype(np.int32) for c in np.split(flat, first[1:])], "cid": cids[who[first]]})

    return run


def best_of(score: np.ndarray, first: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the m best finite scores of each row; equal ones (to twelve decimals) by ``first``."""
    shown = np.round(score, 12)
    m = min(m, shown.shape[1])
    least = np.partition(shown, shown.shape[1] - m, axis=1)[:, shown.shape[1] - m]
    row, column = np.nonzero((shown >= least[:, None]) & (shown > -np.inf))
    order = np.lexsort((first[column], -shown[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < m], column[place < m]


def _search(entries: DataFrame, classes: DataFrame, wanted: DataFrame, norm: float, seed: int, n_probes: int, k: int) -> DataFrame:
    """(asker, near): for each wanted class the k + 1 nearest rows found, as array<struct<r: minus the rounded score, id, s: score>>."""
    asks = keep(wanted.mapInPandas(_hashed(norm, seed, n_probes), "tab int, span int, cells array<int>, cid long"))
    # Blocks of spans: their number follows the counts, so a full span becomes several groups.
    sizes = entries.groupBy("tab", "span").agg(F.count("*").alias("a")).join(asks.groupBy("tab", "span").agg(F.count("*").alias("b")), ["tab", "span"])
    parts = F.broadcast(sizes.select("tab", "span", F.ceil(F.col("a") / BLOCK).cast("int").alias("na"), F.ceil(F.col("b") / QUERIES).cast("int").alias("nb")))  # a row for each table and span of axes
    group = ["tab", "span", "i", "j"]
    left = entries.join(parts, ["tab", "span"]).select("tab", "span", F.get("cells", F.lit(0)).alias("cell"), "cid", F.pmod(F.xxhash64("cid"), F.col("na")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("j"))
    left = left.join(classes.select("cid", "v", F.get("ids", F.lit(0)).alias("first")), "cid")
    right = asks.join(parts, ["tab", "span"]).select("tab", "span", "cells", F.col("cid").alias("asker"), F.explode(F.sequence(F.lit(0), F.col("na") - 1)).alias("i"), F.pmod(F.xxhash64("cid", F.lit(1)), F.col("nb")).cast("int").alias("j"))
    right = right.join(classes.select(F.col("cid").alias("asker"), F.col("v").alias("qv")), "asker")

    def meet(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        """Of each query in this group, its k + 1 best classes (ties by smallest id): these hold its k nearest rows here."""
        out = []
        if len(rows) and len(asks):
            x, first, cids = np.array(rows["v"].tolist()), rows["first"].to_numpy(), rows["cid"].to_numpy()
            base = int(rows["span"].iloc[0]) * SPAN
            cell = rows["cell"].to_numpy() - base
            for at in range(0, len(asks), ROWS):
                part = asks.iloc[at : at + ROWS]
                probed = np.zeros((len(part), SPAN), bool)
                for flags, cells in zip(probed, part["cells"], strict=True):
                    flags[np.asarray(cells) - base] = True
                score = np.where(probed[:, cell], np.array(part["qv"].tolist()) @ x.T, -np.inf)
                row, column = best_of(score, first, k + 1)
                out.append(pd.DataFrame({"asker": part["asker"].to_numpy()[row], "cid": cids[column], "near": score[row, column], "first": first[column]}))
        return pd.concat(out) if out else pd.DataFrame({"asker": [], "cid": [], "near": [], "first": []})

    found = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInPandas(meet, "asker long, cid long, near double, first long")
    top = Window.partitionBy("asker").orderBy(F.desc(F.round("near", 12)), "first")
    # A few more than needed, since scores are made exact only below; of classes that tie, those with the smallest ids hold all that can be wanted.
    some = found.groupBy("asker", "cid").agg(F.max("near").alias("near"), F.min("first").alias("first")).withColumn("n", F.row_number().over(top)).where(F.col("n") <= 2 * k + 2).select("asker", "cid")
    exact = F.aggregate(F.zip_with("qv", "v", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    scored = some.join(classes.select("cid", "v", "ids"), "cid").join(classes.select(F.col("cid").alias("asker"), F.col("v").alias("qv")), "asker").select("asker", exact.alias("score"), "ids")
    lists = scored.select("asker", F.explode(F.transform("ids", lambda i: F.struct((-F.round("score", 12)).alias("r"), i.alias("id"), F.col("score").alias("s")))).alias("x"))
    best = lists.withColumn("n", F.row_number().over(Window.partitionBy("asker").orderBy("x.r", "x.id"))).where(F.col("n") <= k + 1)
    return best.groupBy("asker").agg(F.array_sort(F.collect_list("x")).alias("near"))
