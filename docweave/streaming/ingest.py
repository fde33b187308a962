"""Streaming ingestion: each micro-batch goes through the same indexer as a batch does.

A batch that runs again after a failure finds its sources unchanged and skips them, so replays do no harm.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.ingest import Indexer
from ..sources.files import raw_rows

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def document_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of Parquet files of documents."""
    return spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def as_raw(docs: DataFrame, kb: str) -> DataFrame:
    return raw_rows(docs, F.col("text"), F.concat(F.lit("doc://"), F.col("doc_id").cast("string")), F.lit("txt"), kb)


def index_stream(stream: DataFrame, indexer: Indexer, kb: str, checkpoint: str, report: Callable[[DataFrame, int], None] | None = None, once: bool = True) -> StreamingQuery:
    """Index a stream of raw documents.  once: all there is now, then stop."""

    def each(batch: DataFrame, number: int) -> None:
        out = indexer.index(batch, kb)
        if report:
            report(out, number)

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def event_rates(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """(window_start, event_type, n, total) of an event stream with a watermark; also for batches."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    out = marked.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")
