"""Processing of raw documents and incremental indexing as staged tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clean import clean
from ..functions.text import content_hash, normalize_whitespace
from ..operators import chunk as C
from ..operators.catalog import EmbeddingCache, HashRegistry, changed
from ..operators.embed import embed_cached
from ..operators.tables import hashed, marked
from ..operators.vector_table import PAYLOAD, VectorTable, chunk_ids, to_payload
from ..schema import CHUNK_OVERLAP, CHUNK_TOKENS


def process(raw: DataFrame, *more: str) -> DataFrame:
    """Processed documents: cleaned, normalised and hashed content with metadata; author, page count and language are not known.  more: columns to carry along."""
    done = raw.withColumn("content", normalize_whitespace(clean(F.col("content"), F.col("source_type"))))
    none = lambda kind: F.lit(None).cast(kind)
    fields = {
        "author": none("string"),
        "page_count": none("int"),
        "language": none("string"),
        "content_hash": content_hash(F.col("content")),
    }
    metadata = F.struct(*(fields.get(c, F.col(c)).alias(c) for c in (*PAYLOAD, "knowledge_base_id")))
    hashed = F.sha2(F.concat_ws("|", "id", content_hash(F.col("content"))), 256)
    return done.select(hashed.alias("id"), F.col("id").alias("raw_document_id"), "content", metadata.alias("metadata"), F.current_timestamp().alias("processed_at"), *more)


def chunker(strategy: str, size: int = CHUNK_TOKENS, overlap: int = CHUNK_OVERLAP) -> Callable[[DataFrame], DataFrame]:
    """The chunker of a strategy: recursive, structural or semantic."""
    known = {
        "recursive": lambda df: C.chunk_recursive(df, size, overlap),
        "structural": lambda df: C.chunk_structural(df, size, overlap),
        "semantic": lambda df: C.chunk_semantic(df, size=size),
    }
    if strategy not in known:
        raise ValueError(f"no chunk strategy {strategy!r}")
    return known[strategy]


def chunk(processed: DataFrame, split: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows of the chunk table, without vectors."""
    flat = to_payload(processed.drop("raw_document_id", "processed_at").withColumnRenamed("id", "document_id"))
    rows = split(flat)
    return rows.withColumn("chunk_id", chunk_ids(F.col("knowledge_base_id"), F.col("source_uri"), F.col("content_hash"), F.col("chunk_index")))


def last_of_source(raw: DataFrame, content: str = "content") -> DataFrame:
    """Of several rows of one source in a batch the last one."""
    order = Window.partitionBy("knowledge_base_id", "source_uri").orderBy(F.desc_nulls_last("modified_at"), F.desc("loaded_at"), F.desc(content))
    return raw.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


@dataclass
class Indexer:
    """Indexes batches of raw documents: skips unchanged sources, replaces the chunks of changed ones, and commits hashes last."""

    vectors: VectorTable
    registry: HashRegistry
    cache: EmbeddingCache
    model_id: str
    embed: Callable[[Column], Column]
    split: Callable[[DataFrame], DataFrame]
    per: str = "chunk"
    callbacks: list[Callable[[str], None]] | None = None

    def add_invalidate_callback(self, call: Callable[[str], None]) -> None:
        self.callbacks = [*(self.callbacks or []), call]

    def index(self, raw: DataFrame, kb: str) -> DataFrame:
        """(source_uri, skipped, chunk_count, error) for each source of the batch.

        The chunks of changed sources are written first, then take the old ones' place in one commit, so a failure on the way leaves
        the old chunks; hashes come last, so what failed is indexed again.  Only what changed is written.  Rows that could not be
        loaded carry ``error`` in ``extra``; they are reported and change nothing.

        Texts are written to a folder of the batch with a number for each row and are not shuffled: what is compared and
        joined are sources, hashes and these numbers (``marked``).
        """
        stage = f"{self.vectors.table.path}-stage/{uuid.uuid4().hex}"
        try:
            return self._index(raw.where(F.col("knowledge_base_id") == kb), kb, stage)
        finally:
            self.vectors.table.files.delete(stage)

    def _index(self, raw: DataFrame, kb: str, stage: str) -> DataFrame:
        none = F.lit(None).cast("string")
        docs = self._processed(raw, f"{stage}/docs")
        # Of a source with several rows only the last one goes on.
        many = docs.groupBy("source_uri").agg(F.count("*").alias("n")).where("n > 1").select(F.col("source_uri").alias("__many")).persist()
        if not many.isEmpty():
            own = docs.join(many, F.col("source_uri").eqNullSafe(F.col("__many"))).drop("__many")
            kept = last_of_source(own.select("__row", "knowledge_base_id", "source_uri", "modified_at", "loaded_at", F.coalesce("__raw", "content").alias("__text")), "__text").select("__row")
            docs = marked(marked(docs, F.col("__row"), own.select("__row"), "__own"), F.col("__row"), kept, "__last").where("__last OR NOT __own").drop("__own", "__last")
        many.unpersist()
        failed = docs.where("error is not null").select("source_uri", F.lit(False).alias("skipped"), F.lit(0).cast("long").alias("chunk_count"), "error")
        state = self._kept(changed(docs.where("error is null").select("knowledge_base_id", "source_uri", "content_hash", "__row"), self.registry.table.read()), f"{stage}/state")
        fresh = state.where("changed")
        if fresh.isEmpty():
            return self._report(state.select("source_uri", F.lit(True).alias("skipped"), F.lit(0).cast("long").alias("chunk_count"), none.alias("error")).unionByName(failed))
        texts = docs.where("error is null")
        if not state.where("NOT changed").isEmpty():
            texts = marked(texts, F.col("__row"), fresh.select("__row")).where("__marked")
        chunks = self._kept(chunk(texts.select("id", "raw_document_id", "content", "metadata", "processed_at"), self.split).withColumn("__row", F.monotonically_increasing_id()), f"{stage}/chunks")
        counts = chunks.groupBy("source_uri").agg(F.count("*").alias("n"))
        result = state.select("source_uri", "changed").join(counts, "source_uri", "left")
        shown = self._report(result.select("source_uri", (~F.col("changed")).alias("skipped"), F.coalesce("n", F.lit(0)).cast("long").alias("chunk_count"), none.alias("error")).unionByName(failed))
        self.vectors.table.files.delete(f"{stage}/docs")  # not read from here on
        folders, new = self._embedded(chunks, kb)
        self.vectors.replace_sources(kb, fresh, folders)
        self.cache.put(new, unique=True)
        self.registry.set_hashes(fresh.select("knowledge_base_id", "source_uri", "content_hash"))
        for call in self.callbacks or []:
            call(kb)
        return shown

    def _processed(self, raw: DataFrame, path: str) -> DataFrame:
        """Processed documents of a batch, numbered, with what the choice among rows of one source needs: the text as loaded where it is another."""
        error = F.try_element_at("extra", F.lit("error"))
        rows = raw.select("*", error.alias("error"), F.col("content").alias("__raw")).withColumn("content", F.when(F.col("error").isNull(), F.col("content")))
        done = process(rows, "error", "__raw", "loaded_at")
        return self._kept(
            done.select(
                "*", *(F.col(f"metadata.{c}").alias(c) for c in ("knowledge_base_id", "source_uri", "content_hash", "modified_at"))
            ).withColumn("__raw", F.when(~F.col("__raw").eqNullSafe(F.col("content")), F.col("__raw"))).withColumn("__row", F.monotonically_increasing_id()),
            path,
        )

    def _embedded(self, chunks: DataFrame, kb: str) -> tuple[list[dict], DataFrame]:
        """Staged folders of the chunks with vectors, and new rows for the cache.

        The first chunk of each text that the cache lacks is embedded where it stands; only chunks whose text is known or repeated meet its vector in a join.
        """
        named = lambda df: df.withColumn("model_id", F.lit(self.model_id))
        stamp = F.current_timestamp().alias("created_at")
        if self.per != "chunk":
            out, new = embed_cached(chunks, self.cache.read(), self.model_id, self.embed, self.per)
            return [self.vectors.stage(kb, out)], new
        key = content_hash(F.col("content"))
        known = self.cache.read().where(F.col("model_id") == self.model_id).select(F.col("content_hash").alias("__k"), "vector")
        first = chunks.select(key.alias("__k"), "__row").groupBy("__k").agg(F.min("__row").alias("__row"))
        rows = marked(chunks, F.col("__row"), first.join(known.select("__k"), "__k", "left_anti").select("__row"))
        folders = [self.vectors.stage(kb, named(rows.where("__marked").withColumn("vector", self.embed(F.col("content")))))]
        made = self.vectors.table.staged(folders[0]).select(key.alias("__k"), "vector")
        rest = rows.where("NOT __marked").drop("__marked").withColumn("__k", key)
        if not rest.isEmpty():
            vectors = marked(known.unionByName(made), hashed(F.col("__k")), rest.select(hashed(F.col("__k")))).where("__marked").drop("__marked")
            folders.append(self.vectors.stage(kb, named(rest.join(vectors, "__k"))))
        return folders, made.select(F.col("__k").alias("content_hash"), F.lit(self.model_id).alias("model_id"), "vector", stamp)

    @staticmethod
    def _kept(df: DataFrame, path: str) -> DataFrame:
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def vacuum(self, older_ms: int = 0) -> int:
        """Delete what no table needs any more, and reports, where older than this; the number of folders."""
        reports = f"{self.vectors.table.path}-reports"
        files = self.vectors.table.files
        old = [n for n in files.names(reports) if files.age_ms(f"{reports}/{n}") >= older_ms]
        for n in old:
            files.delete(f"{reports}/{n}")
        return len(old) + sum(t.vacuum(older_ms=older_ms) for t in (self.vectors.table, self.registry.table, self.cache.table))

    def _report(self, df: DataFrame) -> DataFrame:
        """A report of a batch, written before the tables that it reads change."""
        return self._kept(df, f"{self.vectors.table.path}-reports/{uuid.uuid4().hex}")


def batch_counts(report: DataFrame) -> DataFrame:
    """(indexed_count, skipped_count, failed_count) of a report."""
    bad = F.col("error").isNotNull()
    return report.agg(F.count_if(~bad & ~F.col("skipped")).alias("indexed_count"), F.count_if(~bad & F.col("skipped")).alias("skipped_count"), F.count_if(bad).alias("failed_count"))
