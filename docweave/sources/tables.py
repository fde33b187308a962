"""Tables of Parquet files as input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Input in fewer splits than there are cores (a file of one row group can't be split) is dealt out by its rows' keys; other input stays as it is.

    For scans only: the number of splits is known without running anything.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df if splits >= cores else df.repartition(cores, *by)


def table(spark: SparkSession, folder: str, name: str, *by: str) -> DataFrame:
    """A table of a folder; with ``by``, columns whose values differ from row to row, spread over all cores."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(df, *by) if by else df
