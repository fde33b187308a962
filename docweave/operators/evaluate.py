"""Deterministic measures of retrieval and citations, for tables of cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import TOP_K


def normalize_ids(ids: Column) -> Column:
    """Distinct ids without empty ones."""
    return F.array_distinct(F.filter(ids, lambda x: x.isNotNull() & (x != "")))


def evaluate_retrieval(cases: DataFrame, results: DataFrame, relevant: DataFrame, k: int = TOP_K) -> DataFrame:
    """(query_id, recall, precision, reciprocal_rank) for each case.

    cases (query_id); results (query_id, rank, document_id); relevant (query_id, document_id).  Recall counts distinct relevant
    documents in the first k; precision relevant rows among the rows there are; the reciprocal rank looks at all rows.
    """
    rel = relevant.where(F.col("document_id").isNotNull() & (F.col("document_id") != "")).distinct()
    n_rel = rel.groupBy("query_id").agg(F.count("*").alias("n"))
    marked = results.join(rel.withColumn("hit", F.lit(True)), ["query_id", "document_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    top = F.col("rank") <= k
    found = marked.groupBy("query_id").agg(
        F.count_distinct(F.when(top & F.col("hit"), F.col("document_id"))).alias("found"),
        F.avg(F.when(top, F.col("hit").cast("double"))).alias("p"),
        F.min(F.when(F.col("hit"), F.col("rank"))).alias("first"),
    )
    joined = cases.select("query_id").join(n_rel, "query_id", "left").join(found, "query_id", "left")
    return joined.select(
        "query_id",
        F.coalesce(F.col("found") / F.col("n"), F.lit(0.0)).alias("recall"),
        F.coalesce("p", F.lit(0.0)).alias("precision"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"),
    )


def evaluate_dataset(evaluated: DataFrame) -> DataFrame:
    """One row: the number of cases and the mean of each measure; zeros without cases."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return evaluated.agg(F.count("*").alias("case_count"), mean("recall").alias("mean_recall"), mean("precision").alias("mean_precision"), mean("reciprocal_rank").alias("mean_reciprocal_rank"))


def evaluate_citations(cases: DataFrame, cited: DataFrame, relevant: DataFrame) -> DataFrame:
    """(query_id, citation_precision, citation_recall): repeated citations count for precision, distinct ones for recall."""
    rel = relevant.where(F.col("document_id").isNotNull() & (F.col("document_id") != "")).distinct()
    n_rel = rel.groupBy("query_id").agg(F.count("*").alias("n"))
    marked = cited.join(rel.withColumn("hit", F.lit(True)), ["query_id", "document_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    found = marked.groupBy("query_id").agg(F.avg(F.col("hit").cast("double")).alias("p"), F.count_distinct(F.when(F.col("hit"), F.col("document_id"))).alias("found"))
    joined = cases.select("query_id").join(n_rel, "query_id", "left").join(found, "query_id", "left")
    return joined.select("query_id", F.coalesce("p", F.lit(0.0)).alias("citation_precision"), F.coalesce(F.col("found") / F.col("n"), F.lit(0.0)).alias("citation_recall"))
