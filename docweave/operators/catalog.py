"""Catalog of knowledge bases, registry of content hashes, cache of vectors and raw files."""

from __future__ import annotations

import datetime
import posixpath
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CACHE, KNOWLEDGE_BASES, REGISTRY
from ..storage import Files
from .tables import KeyedTable, last_rows
from .vector_table import VectorTable


class KnowledgeBaseNotFound(LookupError):
    pass


class KnowledgeBases:
    """Create, read and delete knowledge bases; each has a collection in the vector table."""

    def __init__(self, spark: SparkSession, path: str, vectors: VectorTable):
        self.spark, self.vectors = spark, vectors
        self.table = KeyedTable(spark, path, KNOWLEDGE_BASES, ["id"])

    def create(self, name: str, embedding_model_id: str, embedding_dimensions: int, description: str | None = None, system_prompt: str | None = None) -> dict:
        row = (str(uuid.uuid4()), name, description, embedding_model_id, embedding_dimensions, system_prompt, datetime.datetime.now())
        self.vectors.ensure_collection(row[0], embedding_dimensions)
        self.save(self.spark.createDataFrame([row], KNOWLEDGE_BASES))
        return self.get(row[0])

    def save(self, rows: DataFrame) -> None:
        self.table.upsert(rows)

    def get(self, kb: str) -> dict:
        row = self.table.read().where(F.col("id") == kb).first()
        if row is None:
            raise KnowledgeBaseNotFound(kb)
        return row.asDict()

    def list_all(self) -> DataFrame:
        return self.table.read().orderBy("created_at", "id")

    def delete(self, kb: str) -> None:
        """Drop the collection and the row; hashes and raw files stay."""
        self.get(kb)
        self.vectors.drop_collection(kb)
        self.table.delete(self.spark.createDataFrame([(kb,)], "id string"))


class HashRegistry:
    """The latest content hash of each source in each knowledge base."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.table = KeyedTable(spark, path, REGISTRY, ["knowledge_base_id", "source_uri"])

    def get_hash(self, kb: str, uri: str) -> str | None:
        row = self.table.read().where((F.col("knowledge_base_id") == kb) & (F.col("source_uri") == uri)).first()
        return row and row["content_hash"]

    def set_hashes(self, rows: DataFrame) -> None:
        """rows: knowledge_base_id, source_uri, content_hash."""
        self.table.upsert(rows.select("knowledge_base_id", "source_uri", "content_hash", F.current_timestamp().alias("updated_at")))

    def has_changed(self, kb: str, uri: str, content_hash: str) -> bool:
        return self.get_hash(kb, uri) != content_hash


def changed(docs: DataFrame, registry: DataFrame) -> DataFrame:
    """docs (knowledge_base_id, source_uri, content_hash, ...) with ``changed`` and ``known``; an unknown source has changed."""
    old = registry.select("knowledge_base_id", "source_uri", F.col("content_hash").alias("__old"))
    joined = docs.join(old, ["knowledge_base_id", "source_uri"], "left")
    return joined.withColumn("changed", ~F.col("__old").eqNullSafe(F.col("content_hash"))).withColumn("known", F.col("__old").isNotNull()).drop("__old")


class EmbeddingCache:
    """Vectors by content hash and model."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.table = KeyedTable(spark, path, CACHE, ["content_hash", "model_id"])

    def read(self) -> DataFrame:
        return self.table.read()

    def get(self, content_hash: str, model_id: str) -> list[float] | None:
        row = self.read().where((F.col("content_hash") == content_hash) & (F.col("model_id") == model_id)).first()
        return row and row["vector"]

    def put(self, rows: DataFrame, unique: bool = False) -> None:
        """unique: the caller knows that no key occurs twice."""
        self.table.upsert(rows if unique else last_rows(rows, ["content_hash", "model_id"], "created_at"), unique=True)


@dataclass(frozen=True, order=True)
class StoredFile:
    path: str
    size: int

    @property
    def name(self) -> str:
        return posixpath.basename(self.path)


class RawFiles:
    """Uploaded files, a folder for each knowledge base, in any file system that Spark writes.  Files go through the driver one by one."""

    def __init__(self, base: str, spark: SparkSession | None = None):
        self.base, self.files = base.rstrip("/"), Files(spark or SparkSession.builder.getOrCreate())

    def _folder(self, kb: str) -> str:
        return f"{self.base}/{posixpath.basename(kb)}"

    def _at(self, kb: str, name: str) -> str:
        return f"{self._folder(kb)}/{posixpath.basename(name)}"  # no path of its own

    def save_bytes(self, kb: str, name: str, data: bytes) -> str:
        path = self._at(kb, name)
        self.files.write(path, data)
        return path

    def copy_from_path(self, kb: str, source: str) -> str:
        path = self._at(kb, source)
        self.files.copy(source, path)
        return path

    def delete(self, kb: str, name: str) -> bool:
        return any(f.name == posixpath.basename(name) for f in self.list_files(kb)) and self.files.delete(self._at(kb, name))

    def list_files(self, kb: str) -> list[StoredFile]:
        """Files of a knowledge base, by name."""
        return [StoredFile(self._at(kb, name), size) for name, size, is_file in self.files.listed(self._folder(kb)) if is_file]


def iso(ts: Column) -> Column:
    """A timestamp as ISO 8601 text, and back by ``from_iso``."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")


def from_iso(text: Column) -> Column:
    return F.to_timestamp(text)
