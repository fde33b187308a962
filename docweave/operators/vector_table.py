"""The chunk table: one collection for each knowledge base, with vectors and payload.

A collection is a partition of a keyed table; its dimensions are a fact of the partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CHUNK_TABLE, METADATA
from .retrieval import payload_filter, search_dense, search_one
from .tables import KeyedTable

PAYLOAD = ("source_uri", "source_type", "title", "author", "mime_type", "file_size_bytes", "created_at", "modified_at", "page_count", "language", "content_hash", "extra")


def to_payload(df: DataFrame) -> DataFrame:
    """Flatten the metadata struct to columns."""
    rest = [F.col(c) for c in df.columns if c != "metadata"]
    return df.select(*rest, *(F.col(f"metadata.{c}").alias(c) for c in (*PAYLOAD, "knowledge_base_id")))


def from_payload(df: DataFrame) -> DataFrame:
    """The metadata struct from columns."""
    names = (*PAYLOAD, "knowledge_base_id")
    rest = [F.col(c) for c in df.columns if c not in names]
    return df.select(*rest, F.struct(*(F.col(c) for c in names)).alias("metadata"))


def chunk_ids(kb: Column, uri: Column, content_hash: Column, index: Column) -> Column:
    """Ids that are the same for the same content at the same place."""
    return F.sha2(F.concat_ws("|", kb, uri, content_hash, index.cast("string")), 256)


class VectorTable:
    """Collections of chunks by knowledge base id."""

    def __init__(self, spark: SparkSession, path: str):
        self.table = KeyedTable(spark, path, CHUNK_TABLE, ["chunk_id"])
        self.spark = spark

    def ensure_collection(self, kb: str, dims: int) -> None:
        """Create a collection; one that is there must have the same dimensions."""
        found = self.table.add_part(kb, {"dims": dims})["dims"]
        if found != dims:
            raise ValueError(f"collection {kb} has {found} dimensions, not {dims}")

    def has_collection(self, kb: str) -> bool:
        return self.table.facts(kb) is not None

    def drop_collection(self, kb: str) -> bool:
        return self.table.drop_part(kb)

    def _checked(self, kb: str, chunks: DataFrame) -> DataFrame:
        """The chunks; a vector of another length than the collection's is an error."""
        dims = (self.table.facts(kb) or {}).get("dims")
        if dims is None:
            return chunks
        bad = F.raise_error(F.lit(f"vectors of collection {kb} have {dims} dimensions"))
        return chunks.withColumn("vector", F.when(F.size("vector") == dims, F.col("vector")).otherwise(bad.cast("array<double>")))

    def upsert(self, kb: str, chunks: DataFrame) -> None:
        """Rows of the chunk table, in place of those with the same id; of several with one id the last counts."""
        self.table.upsert(self._checked(kb, chunks), kb)

    def stage(self, kb: str, chunks: DataFrame) -> dict:
        """A folder of chunks for ``replace_sources``."""
        return self.table.stage(self._checked(kb, chunks))

    def replace_sources(self, kb: str, sources: DataFrame, chunks: DataFrame | list[dict]) -> None:
        """In one commit, delete all chunks of sources (source_uri) and add others (or staged folders of them), whose ids are unique."""
        self.table.swap(sources.select("source_uri"), self._checked(kb, chunks) if isinstance(chunks, DataFrame) else chunks, kb)

    def read(self, kb: str) -> DataFrame:
        return self.table.read(kb)

    def get_all_chunks(self, kb: str) -> DataFrame:
        """All chunks without vectors, which the scan then doesn't read."""
        return self.read(kb).drop("vector")

    def _one(self, column: str, value: str) -> DataFrame:
        return self.spark.createDataFrame([(value,)], f"{column} string")

    def delete_by_document_id(self, kb: str, document_id: str) -> None:
        if self.has_collection(kb):
            self.table.delete(self._one("document_id", document_id), kb)

    def delete_by_source_uri(self, kb: str, source_uri: str) -> int:
        """Delete a source's chunks; how many there were (0 for an unknown collection)."""
        gone = self.read(kb).where(F.col("source_uri") == source_uri).count()
        if gone:
            self.table.delete(self._one("source_uri", source_uri), kb)
        return gone

    def search(self, kb: str, vector: list[float], k: int, filters: dict | None = None) -> DataFrame:
        return search_one(self.read(kb), vector, k, filters)

    def search_batch(self, kb: str, queries: DataFrame, k: int, filters: dict | None = None) -> DataFrame:
        return search_dense(self.read(kb), queries, k, filters)

    def get_existing_content_hashes(self, kb: str) -> DataFrame:
        return self.read(kb).select("content_hash").distinct()

    def matching(self, kb: str, filters: dict | None) -> DataFrame:
        return self.read(kb).where(payload_filter(filters))


__all__ = ["METADATA", "VectorTable", "chunk_ids", "from_payload", "to_payload"]
