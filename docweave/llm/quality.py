"""A quality score from compression.

Two zstandard dictionaries are built, from blocks of good and of bad labelled text.  A text is cut
into blocks, each is compressed with either dictionary, and the normalised difference of the summed
sizes says which kind of text it is more like.  Logistic regression on labelled rows turns
the difference (and its share of each text's plain compressed size) into a score.

Labelled rows are used up to a bound: ``BLOCKS`` blocks a class for the dictionaries and ``ROWS``
rows for the calibration, from ``SAMPLE`` rows of each class and half, chosen by hash.  The dictionaries are built from one half of the
labelled rows, the calibration is fitted on the other.  Scoring reads whole texts.

Defined results: a null or empty text has both features 0 and so one fixed score; equal texts have equal
scores; rows with a null or other label than 0 and 1 teach nothing; with rows of one class only (or
none) each score is 0.5; repeated rows give repeated rows; an empty table gives an empty table.
Columns named like the operator's own are kept, since the score goes to a column that the caller names.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, hold, utf8

#: Bytes of a block, compression level, dictionary bytes; bounds of the labelled sample.
BLOCK, LEVEL, DICTIONARY, BLOCKS, ROWS, SAMPLE = 1024, 3, 32_768, 3000, 6000, 3000


@functools.lru_cache(maxsize=8)
def _compressors(good: bytes, bad: bytes):
    kinds = [zstandard.ZstdCompressionDict(x, dict_type=zstandard.DICT_TYPE_AUTO) for x in (good, bad)]
    for k in kinds:
        k.precompute_compress(level=LEVEL)
    plain = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
    return [zstandard.ZstdCompressor(dict_data=k, **plain) for k in kinds]


def features(data: bytes, good: bytes, bad: bytes) -> tuple[float, float]:
    """The normalised difference of compressed sizes (positive: more like good text), and how well the better dictionary compresses."""
    if not data:
        return 0.0, 0.0
    with_good, with_bad = _compressors(good, bad)
    a = b = 0
    for at in range(0, len(data), BLOCK):
        block = data[at : at + BLOCK]
        a += len(with_good.compress(block))
        b += len(with_bad.compress(block))
    return (b - a) / (a + b), min(a, b) / len(data)


class CompressionQuality:
    """A fitted classifier: two dictionaries and three coefficients."""

    def __init__(self, good: bytes, bad: bytes, weights: tuple[float, float, float]):
        self.good, self.bad, self.weights = good, bad, weights

    @property
    def fitted(self) -> bool:
        """False where the labelled rows gave no model, so that each score is 0.5."""
        return any(self.weights)

    @classmethod
    def fit(cls, labelled: DataFrame, text_col: str, label_col: str, key_col: str) -> CompressionQuality:
        """labelled: rows to learn from.  key_col only decides, by its hash, which rows are in the bounded sample and its halves."""
        rows = labelled.where(F.col(label_col).isin(0, 1) & F.col(text_col).isNotNull()).select(
            F.col(text_col).alias("t"), F.col(label_col).cast("int").alias("y"), F.md5(F.col(key_col).cast("string")).alias("h")
        )
        rows = rows.persist()
        try:
            return cls._fit(rows)
        finally:
            rows.unpersist()

    @classmethod
    def _fit(cls, rows: DataFrame) -> CompressionQuality:
        half = _half(F.col("h"))
        size = 1000  # characters, about a block
        blocks = rows.where(half == 0).select("y", "h", F.posexplode(F.expr(f"transform(sequence(0, greatest(length(t) - 1, 0) div {size}), i -> substring(t, cast(i * {size} + 1 as int), {size}))")))
        kinds = []
        for y in (1, 0):
            some = blocks.where(F.col("y") == y).select(F.md5(F.concat_ws("/", "h", "pos")).alias("o"), "col").orderBy("o", "col").limit(BLOCKS)
            kinds.append([utf8(r[1]) for r in some.collect()])
        if not all(kinds):
            return cls(b" ", b" ", (0.0, 0.0, 0.0))
        good, bad = map(_dictionary, kinds)
        model = cls(good, bad, (0.0, 0.0, 0.0))
        both = rows.where(half == 1)
        some = both.where("y = 1").orderBy("h").limit(ROWS // 2).unionAll(both.where("y = 0").orderBy("h").limit(ROWS // 2))
        found = some.select("y", model._features(F.col("t")).alias("f")).select("y", "f.*").collect()
        if {r[0] for r in found} != {0, 1}:
            return model
        x = np.array([[1.0, r[1], r[2]] for r in found])
        model.weights = tuple(_logistic(x, np.array([float(r[0]) for r in found])))
        return model

    def _features(self, text: Column) -> Column:
        good, bad = self.good, self.bad

        @F.pandas_udf("difference double, ratio double")
        def measure(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            hold("quality", _compressors.cache_clear)
            for part in texts:
                yield pd.DataFrame([features(utf8(t), good, bad) for t in part], columns=["difference", "ratio"])
            give_back()

        return measure(text)

    def score(self, text: Column) -> Column:
        """A double from 0 to 1, higher where label 1 is likelier; the same for the same text."""
        good, bad, (w0, w1, w2) = self.good, self.bad, self.weights

        @F.pandas_udf("double")
        def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            hold("quality", _compressors.cache_clear)
            for part in texts:
                out = []
                for t in part:
                    d, r = features(utf8(t), good, bad)
                    z = max(-60.0, min(60.0, w0 + w1 * d + w2 * r))
                    out.append(round(1 / (1 + math.exp(-z)), 9))
                yield pd.Series(out, dtype="float64")
            give_back()

        return scored(text)


def _dictionary(blocks: list[bytes]) -> bytes:
    """Content of a dictionary: what zstandard's trainer picks from the blocks, or the blocks where they are too few for it."""
    blocks = sorted(blocks, key=lambda b: hashlib.md5(b).digest())
    try:
        return zstandard.train_dictionary(DICTIONARY, blocks).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[-DICTIONARY:] or b" "


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Logistic regression by Newton's method on scaled columns; both classes weigh the same."""
    scale = np.maximum(np.abs(x).max(0), 1e-12)
    x, w = x / scale, np.zeros(x.shape[1])
    each = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -60, 60)))
        step = np.linalg.solve((x * (each * p * (1 - p))[:, None]).T @ x + ridge / len(y) * np.eye(len(w)), x.T @ (each * (p - y)) + ridge / len(y) * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w / scale


def _half(h: Column) -> Column:
    """0 or 1 from a hash in hex: rows for the dictionaries, rows for the calibration."""
    return F.conv(F.substring(h, 32, 1), 16, 10).cast("int") % 2


def holdout(doc_id: Column) -> Column:
    """True for rows that no model may learn from: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def fit_on(docs: DataFrame, labels: DataFrame) -> CompressionQuality:
    """A classifier from documents and labels, without held-out rows and rows with a null id.

    The sample is drawn from the labels, so only its texts are read out of docs: its ids, at most ``SAMPLE`` for each class and
    half, are sent to all tasks, and no text is shuffled.
    """
    known = labels.select(F.col("doc_id").alias("l_id"), F.col("quality").cast("int").alias("l_quality")).where(F.col("l_quality").isin(0, 1))
    known = known.where(~F.coalesce(holdout(F.col("l_id")), F.lit(True))).distinct().withColumn("h", F.md5(F.col("l_id").cast("string")))
    parts = [known.where((F.col("l_quality") == y) & (_half(F.col("h")) == half)).orderBy("h").limit(SAMPLE) for y in (0, 1) for half in (0, 1)]
    sample = functools.reduce(DataFrame.unionByName, parts)
    rows = docs.select(F.col("doc_id").alias("d_id"), F.col("text").alias("d_text"))
    return CompressionQuality.fit(rows.join(F.broadcast(sample), F.col("d_id") == F.col("l_id")), "d_text", "l_quality", "d_id")
