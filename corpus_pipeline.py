"""A corpus pipeline of five stages; each keeps the columns of documents, the last encodes.

Stages: reject low quality, keep one document of each group of near duplicates, cut repeated passages, mix
sources to target weights, encode to token ids.  Each stage is written as Parquet and read by the next.

Defined results: null texts count as empty ones, which the first stage rejects or keeps by the score of an empty text;
an empty table gives an empty table; columns beyond those of documents are carried along up to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm import byte_bpe, near_dedup, quality, queries, repeats
from docweave.llm.common import discard, load, step


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on labelled rows, scores 0.7 or more; all of them where the labels give no model."""
    model = quality.fit_on(docs, load(spark, sf_dir, "labels"))
    return docs.where(model.score(F.col("text")) >= 0.7) if model.fitted else docs


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8): that with the smallest id.

    Of rows with the same id and text one stays; rows with a null id all stay.
    """
    kept = near_dedup.near_duplicates(docs).where("kept").select(F.col("doc_id").alias("__kept_id")).distinct()
    # The row travels as one column, whatever its columns are called.
    rows = docs.select(F.struct("*").alias("__row"), F.col("doc_id").cast("long").alias("__id"), repeats.text_key(F.col("text")).alias("__key"))
    rows = rows.join(kept, F.col("__id").eqNullSafe(F.col("__kept_id"))).withColumn("__lone", F.when(F.col("__id").isNull(), F.monotonically_increasing_id()))
    return rows.dropDuplicates(["__id", "__key", "__lone"]).select("__row.*")


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 400 bytes or more, or of over 50 words, that occur again; documents of which nothing is left go."""
    return repeats.without_repeats(docs, 400, words=51).where(F.length(F.trim(F.coalesce("text", F.lit("")))) > 0)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mixture takes them."""
    rows = queries.mixture(docs.select(F.struct("*").alias("__row"), "doc_id", "text", "lang", "source"))
    return rows.where("mix_copies > 0").select("__row", F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int")))).select("__row.*")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids): the token ids of each row."""
    return byte_bpe.encode_checked(docs, public_tokenizers.path(queries.RANKS), public_tokenizers.PATTERN, public_tokenizers.path(queries.JSON))


STAGES = [
    ("quality classifier", good_quality),
    ("near duplicates", without_near_duplicates),
    ("repeated passages", without_repeats),
    ("mixing", mixed),
    ("byte-level BPE", encoded),
]

#: Models, similarity joins and tokenizers are beyond SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; each table, and what its stage has kept on the way, goes as soon as the next one is written."""
    docs, before = load(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = step(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
