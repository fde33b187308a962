"""One object that wires tables, indexer, retrieval and answers together."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..logs import logger, timed
from ..operators import answers as A
from ..operators import retrieval as R
from ..operators.catalog import EmbeddingCache, HashRegistry, KnowledgeBaseNotFound, KnowledgeBases
from ..operators.embed import hashing_model
from ..operators.vector_table import VectorTable
from ..schema import ALPHA, CHUNK_OVERLAP, CHUNK_TOKENS, TOP_K
from ..sources.files import load_paths
from ..sources.pages import load_pages
from ..storage import Files
from .ingest import Indexer, chunker


@dataclass(frozen=True)
class EngineConfig:
    """Settings, checked when made."""

    base: str
    embedding_model_id: str = "hash-64"
    embedding_dimensions: int = 64
    chunk_strategy: str = "recursive"
    chunk_size: int = CHUNK_TOKENS
    chunk_overlap: int = CHUNK_OVERLAP
    alpha: float = ALPHA
    top_k: int = TOP_K
    rerank: bool = True
    cache_per: str = "chunk"
    store_mode: str = "local"
    store_key: str | None = None

    def __post_init__(self):
        if not self.base or not self.embedding_model_id:
            raise ValueError("a base folder and a model id are needed")
        if not 0 <= self.alpha <= 1:
            raise ValueError("alpha lies between 0 and 1")
        if self.chunk_overlap >= self.chunk_size:
            raise ValueError("the overlap must be smaller than the chunk size")
        if self.embedding_dimensions < 1 or self.top_k < 1:
            raise ValueError("dimensions and top_k are positive")
        if self.cache_per not in ("chunk", "document"):
            raise ValueError("the cache is kept per chunk or per document")
        if self.store_mode not in ("local", "cloud"):
            raise ValueError("the store is local or in the cloud")
        if self.store_mode == "cloud" and not self.store_key:
            raise ValueError("a store in the cloud needs a key; it is not replaced by a local one")
        chunker(self.chunk_strategy)


class Engine:
    """Knowledge bases with ingestion and answers."""

    def __init__(self, spark: SparkSession, config: EngineConfig, embed: Callable[[Column], Column] | None = None, generator: A.Generator | None = None):
        self.spark, self.config, self.generator = spark, config, generator
        self.embed = embed or hashing_model(config.embedding_dimensions)
        self.vectors = VectorTable(spark, f"{config.base}/chunks")
        self.kbs = KnowledgeBases(spark, f"{config.base}/knowledge_bases", self.vectors)
        split = chunker(config.chunk_strategy, config.chunk_size, config.chunk_overlap)
        self.indexer = Indexer(self.vectors, HashRegistry(spark, f"{config.base}/hashes"), EmbeddingCache(spark, f"{config.base}/vectors"), config.embedding_model_id, self.embed, split, config.cache_per, [self._invalidate])
        self._files = Files(spark)

    def _indexes(self, kb: str) -> str:
        return f"{self.config.base}/sparse/{kb}"

    def _invalidate(self, kb: str) -> None:
        self._files.delete(self._indexes(kb))

    def _index(self, kb: str) -> R.StoredIndex:
        """The sparse index of what the collection holds now; one that another session has built is used."""
        found = R.StoredIndex(self.spark, f"{self._indexes(kb)}/{self.vectors.table.state_of(kb)}")
        return found if found.is_built() else found.build(self.vectors.get_all_chunks(kb))

    def create_knowledge_base(self, name: str, **more) -> dict:
        return self.kbs.create(name, self.config.embedding_model_id, self.config.embedding_dimensions, **more)

    def ingest(self, paths: list[str], kb: str) -> DataFrame:
        self.kbs.get(kb)
        with timed("ingest", kb=kb, files=len(paths)):
            return self.indexer.index(load_paths(self.spark, paths, kb), kb)

    def ingest_pages(self, pages: DataFrame, kb: str) -> DataFrame:
        self.kbs.get(kb)
        return self.indexer.index(load_pages(pages, kb), kb)

    def ingest_raw(self, raw: DataFrame, kb: str) -> DataFrame:
        self.kbs.get(kb)
        return self.indexer.index(raw, kb)

    def _queries(self, texts: list[str]) -> DataFrame:
        rows = self.spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")
        return rows.withColumn("vector", self.embed(F.col("text")))

    def retrieve(self, kb: str, queries: DataFrame, k: int | None = None) -> DataFrame:
        """Hybrid results for queries (query_id, text, vector)."""
        self.kbs.get(kb)
        return R.retrieve(self.vectors.read(kb), queries, k or self.config.top_k, alpha=self.config.alpha, rerank=self.config.rerank, index=self._index(kb))

    def query(self, kb: str, text: str, k: int | None = None) -> Iterator[str]:
        """Server-sent events of an answer; without a generator the offline stand-in answers with the first result."""
        base = self.kbs.get(kb)
        results = self.retrieve(kb, self._queries([text]), k).persist()
        try:
            cited = A.citations(results)
            if self.generator is None:
                for row in A.sse(A.events(A.extractive_pieces(results), cited)).orderBy("seq").collect():
                    yield row["event"]
                return
            rows = [r.asDict() for r in cited.drop("query_id").orderBy("rank").drop("rank").collect()]
            prompt = A.prompts(self._queries([text]), results, base["system_prompt"]).first()
        finally:
            results.unpersist()
        for piece in A.stream_generate(self.generator, prompt["system"], prompt["user"], rows):
            yield f"data: {json.dumps(piece)}\n\n"

    def health(self) -> dict:
        return {"status": "ok"}

    def ready(self) -> tuple[bool, dict]:
        """Whether the tables that all else needs can be read."""
        tables = {"knowledge_bases": self.kbs.table, "chunks": self.vectors.table, "hashes": self.indexer.registry.table, "vectors": self.indexer.cache.table}
        found = {}
        for name, table in tables.items():
            try:
                table.parts()
                found[name] = "ok"
            except Exception:
                logger.exception("readiness_dependency_failed", extra={"dependency": name})
                found[name] = "unavailable"
        ok = set(found.values()) == {"ok"}
        return ok, {"status": "ready" if ok else "not_ready", "dependencies": found}

    def respond(self, call: Callable, *args, request_id: str | None = None, **more) -> dict:
        """A method's result as status, body and headers, for whatever serves the engine: 404 for an unknown knowledge base, 422 for
        a source or value that isn't taken, and for all else a 500 that names the request and nothing inside."""
        request_id, began = request_id or uuid.uuid4().hex, time.perf_counter()
        try:
            status, body = 200, call(*args, **more)
        except KnowledgeBaseNotFound as e:
            status, body = 404, {"error": {"code": "not_found", "message": f"no knowledge base {e}", "request_id": request_id}}
        except ValueError as e:
            status, body = 422, {"error": {"code": "invalid", "message": str(e), "request_id": request_id}}
        except Exception:
            logger.exception("request_failed", extra={"request_id": request_id})
            status, body = 500, {"error": {"code": "internal_error", "message": "The request could not be completed.", "request_id": request_id}}
        ms = round((time.perf_counter() - began) * 1000, 2)
        logger.info("request_complete", extra={"request_id": request_id, "status_code": status, "duration_ms": ms})
        return {"status": status, "body": body, "headers": {"X-Request-ID": request_id, "X-Process-Time-Ms": str(ms)}}
