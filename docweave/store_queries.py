"""Queries that write and read real tables and files: loaders, stores, indexer, engine.  Each works in a folder of its own in the shared one.

A step whose outcome is a value or an error on the driver is a row of the result.
"""

from __future__ import annotations

import io
import json
import logging
import zipfile
import zlib
from collections.abc import Callable
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import catalog_queries as Q
from .catalog_queries import table
from .functions import text as T
from .logs import JsonFormatter
from .operators import answers as A
from .operators import retrieval as R
from .operators.catalog import EmbeddingCache, HashRegistry, KnowledgeBaseNotFound, KnowledgeBases, RawFiles, changed
from .operators.embed import hashing_model, model_udf
from .operators.tables import KeyedTable
from .operators.vector_table import VectorTable
from .plans.engine import Engine, EngineConfig
from .plans.ingest import Indexer, batch_counts, chunker
from .schema import CHUNK_TABLE, KNOWLEDGE_BASES
from .sources import files as L
from .sources.pages import fetch_pages, load_pages
from .storage import scratch
from .streaming import ingest as S

_QUERIES, _SQL = {}, {}


def query(sql: str):
    def add(f):
        _QUERIES[f.__name__] = f
        _SQL[f.__name__] = sql
        return f

    return add


def outcome(call: Callable) -> str:
    """What a call returns as text, or the kind of its error."""
    try:
        return str(call())
    except Exception as e:
        return type(e).__name__


# Loaders.  Files are written by Spark, one for each item.


def _written(spark, d) -> str:
    """A folder of text files, one for each benchmark item, in folders item=<id>."""
    path = scratch(spark)
    table(spark, d, "benchmark").select(F.col("item_id").alias("item"), "text").repartition("item").write.partitionBy("item").text(path)
    return path


def _item(uri="source_uri"):
    return F.regexp_extract(uri, r"/item=(\d+)/", 1).cast("long").alias("item_id")


_FILE = "SELECT item_id, text || chr(10) AS content, '{kind}' AS source_type, {mime} AS mime_type, strlen(text) + 1 AS file_size_bytes FROM benchmark"
_FACTS = ("content", "source_type", "mime_type", "file_size_bytes")


@query(_FILE.format(kind="txt", mime="'text/plain'"))
def load_text_files(spark, d):
    """Found by the registry: Spark's text files end in .txt."""
    paths = [f.path for f in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(_written(spark, d)).select("path").collect()]
    return L.load_paths(spark, paths, "kb").select(_item(), *_FACTS)


@query(_FILE.format(kind="markdown", mime="'text/plain'"))
def load_markdown_files(spark, d):
    return L.load_markdown(spark, _written(spark, d), "kb").select(_item(), *_FACTS)


@query("SELECT '| n_nationkey | n_name | n_regionkey |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ', \"' || chr(10) || 'x | ' || n_regionkey || ' |', chr(10) ORDER BY n_nationkey) AS content, 'csv' AS source_type, 'text/csv' AS mime_type FROM nation")
def load_csv_file(spark, d):
    """A CSV file whose cells hold commas, quotes and line ends."""
    path = scratch(spark)
    rows = table(spark, d, "nation").select("n_nationkey", F.concat("n_name", F.lit(', "\nx')).alias("n_name"), "n_regionkey").coalesce(1).sortWithinPartitions("n_nationkey")
    rows.write.option("header", "true").option("escape", '"').csv(path)
    return L.load_csv(spark, path, "kb").select("content", "source_type", "mime_type")


@query(f"SELECT page_id, md5(html || chr(10)) AS digest, {Q.sql_title('html')} AS title, 'text/html' AS mime_type, strlen(html) + 1 AS file_size_bytes FROM pages")
def load_html_files(spark, d):
    path = scratch(spark)
    pages = table(spark, d, "pages").select(F.col("page_id").alias("item"), "html").repartition(4 * spark.sparkContext.defaultParallelism, "item")
    # Tasks put their files in place themselves: the driver would move them one by one.
    pages.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("item").text(path)
    return L.load_html(spark, path, "kb").select(_item().alias("page_id"), F.md5("content").alias("digest"), "title", "mime_type", "file_size_bytes")


def _made(spark, d, ending: str, make: Callable[[int, str], bytes]) -> DataFrame:
    """Files as the binary reader gives them, made from benchmark items."""

    @F.pandas_udf("binary")
    def content(ids: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([make(int(i), t) for i, t in zip(ids, texts, strict=True)], dtype=object)

    made = table(spark, d, "benchmark").select("item_id", content("item_id", "text").alias("content"))
    return made.select(F.concat(F.lit("/in/item="), F.col("item_id").cast("string"), F.lit(f"/a{ending}")).alias("path"), "content", F.length("content").cast("long").alias("length"), F.lit(None).cast("timestamp").alias("modificationTime"))


def _zip(**parts: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/") + ".xml", text)
    return out.getvalue()


def docx(item: int, text: str) -> bytes:
    body = "".join(f"<w:p><w:r><w:t>{escape(x)}</w:t></w:r></w:p>" for x in text.split("\n"))
    return _zip(word__document=f"<w:document xmlns:w='w'><w:body>{body}</w:body></w:document>")


def pptx(item: int, text: str) -> bytes:
    slides = {f"ppt__slides__slide{n}": f"<p:sld xmlns:p='p' xmlns:a='a'><a:p><a:r><a:t>{escape(x)}</a:t></a:r></a:p></p:sld>" for n, x in enumerate(text.split("\n"), 1)}
    return _zip(**dict(reversed(slides.items())))


def xlsx(item: int, text: str) -> bytes:
    shared = f"<sst><si><t>id</t></si><si><t>text</t></si><si><t>{escape(text.replace(chr(10), ' '))}</t></si></sst>"
    rows = f"<row><c r='A1' t='s'><v>0</v></c><c r='C1' t='s'><v>1</v></c></row><row><c r='A2'><v>{item}</v></c><c r='C2' t='s'><v>2</v></c></row>"
    return _zip(xl__sharedStrings=shared, xl__worksheets__sheet1=f"<worksheet><sheetData>{rows}</sheetData></worksheet>")


def pdf(item: int, text: str) -> bytes:
    """A PDF with one page, packed, a line of text for each line."""
    shown = (x.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") for x in text.split("\n"))
    stream = zlib.compress(b"BT /F1 12 Tf 40 800 Td " + b" ".join(b"(" + x + b") Tj 0 -14 Td" for x in shown) + b" ET")
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R >>",
        b"<< /Type /Pages /Kids [3 0 R] /Count 1 /Resources << /Font << /F1 5 0 R >> >> >>",
        b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Contents 4 0 R >>",
        b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(stream), stream),
        b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>",
    ]
    return b"%PDF-1.4\n" + b"\n".join(b"%d 0 obj\n%s\nendobj" % (n, x) for n, x in enumerate(objects, 1)) + b"\ntrailer << /Root 1 0 R >>\n%%EOF\n"


_LINES = "array_to_string(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), chr(10))"


@query(
    f"""SELECT item_id, 'docx' AS source_type, {_LINES} AS content, NULL::VARCHAR AS error FROM benchmark
UNION ALL SELECT item_id, 'pptx', array_to_string(string_split(text, chr(10)), chr(10) || chr(10)), NULL FROM benchmark
UNION ALL SELECT item_id, 'xlsx', '| id |  | text |' || chr(10) || '| --- | --- | --- |' || chr(10) || '| ' || item_id || ' |  | ' || replace(text, chr(10), ' ') || ' |', NULL FROM benchmark
UNION ALL SELECT item_id, 'docx', NULL, 'BadZipFile: File is not a zip file' FROM benchmark"""
)
def load_office_files(spark, d):
    """Documents, slides, sheets, and files that are none."""
    parts = [_made(spark, d, ".docx", docx), _made(spark, d, ".pptx", pptx), _made(spark, d, ".xlsx", xlsx), _made(spark, d, ".docx", lambda i, t: b"broken")]
    rows = [L.office_rows(p, "kb") for p in parts]
    all_ = rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])
    return all_.select(_item(), "source_type", "content", F.try_element_at("extra", F.lit("error")).alias("error"))


@query(f"SELECT item_id, 'pdf' AS source_type, {_LINES} AS content, 'application/pdf' AS mime_type FROM benchmark")
def load_pdf_files(spark, d):
    return L.pdf_rows(_made(spark, d, ".pdf", pdf), "kb").select(_item(), "source_type", "content", "mime_type")


@query("SELECT item_id, reverse(text) AS content, 'image' AS source_type, 'image/png' AS mime_type, 'mirror' AS ocr_provider FROM benchmark")
def load_images_ocr(spark, d):
    """Image files through an OCR provider that reads backwards."""
    rows = L.image_rows(_made(spark, d, ".png", lambda i, t: t.encode()), "kb", ocr=lambda name, data: data.decode()[::-1], provider="mirror")
    return rows.select(_item(), "content", "source_type", "mime_type", F.try_element_at("extra", F.lit("ocr_provider")).alias("ocr_provider"))


def _get(url: str) -> dict:
    if "page=1" in url:
        raise OSError("gone")
    return {"url": url + "#final", "html": f"<p>{url}</p>", "content_type": "text/html; charset=utf-8", "content_length": "?", "last_modified": "Thu, 01 Jan 2026 00:00:00 GMT"}


@query("""SELECT url || '#final' AS source_uri, 'website' AS source_type, 'text/html' AS mime_type, strlen(url) + 7 AS file_size_bytes, TIMESTAMP '2026-01-01' AS modified_at, NULL::VARCHAR AS error FROM pages WHERE NOT contains(url, 'page=1')
UNION ALL SELECT url, NULL, NULL, NULL, NULL, 'OSError: gone' FROM pages WHERE contains(url, 'page=1')""")
def fetch_and_load_pages(spark, d):
    """Pages through the fetcher, which follows to another address and fails for some after three tries."""
    fetched = fetch_pages(table(spark, d, "pages").select("url"), _get, first_wait=0)
    good = load_pages(fetched.where("error is null"), "kb").select("source_uri", "source_type", "mime_type", "file_size_bytes", F.col("modified_at").cast("timestamp_ntz").alias("modified_at"), F.lit(None).cast("string").alias("error"))
    null = lambda kind: F.lit(None).cast(kind)
    return good.unionByName(fetched.where("error is not null").select(F.col("url").alias("source_uri"), null("string").alias("source_type"), null("string").alias("mime_type"), null("long").alias("file_size_bytes"), null("timestamp_ntz").alias("modified_at"), "error"))


# Chunk tables.


def item_chunks(spark: SparkSession, d: str, model: str = "old") -> DataFrame:
    """Rows of the chunk table: two for each benchmark item; ten sources."""
    rows = table(spark, d, "benchmark").select("item_id", "text", F.explode(F.array(F.lit(0), F.lit(1))).alias("chunk_index"))
    text = F.col("item_id").cast("string")
    known = {
        "chunk_id": F.concat(F.lit("c"), text, F.lit("-"), F.col("chunk_index").cast("string")),
        "document_id": F.concat(F.lit("d"), text),
        "content": F.col("text"),
        "chunk_index": F.col("chunk_index"),
        "source_uri": F.concat(F.lit("item://"), (F.col("item_id") % 10).cast("string")),
        "content_hash": T.content_hash(F.col("text")),
        "vector": F.array(F.col("item_id").cast("double"), F.col("chunk_index").cast("double"), F.lit(1.0)),
        "model_id": F.lit(model),
        "knowledge_base_id": F.lit("kb"),
    }
    return rows.select(*(known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(CHUNK_TABLE)))


def collection(spark: SparkSession, d: str) -> VectorTable:
    """A vector table whose collection kb has the chunks of all items."""
    out = VectorTable(spark, f"{scratch(spark)}/chunks")
    out.ensure_collection("kb", 3)
    out.upsert("kb", item_chunks(spark, d))
    return out


_CHUNKS = "ic AS (SELECT item_id, i, 'c' || item_id || '-' || i AS chunk_id, 'd' || item_id AS document_id, 'item://' || (item_id % 10) AS source_uri, text FROM benchmark, (SELECT unnest([0, 1]) AS i))"


@query(f"WITH {_CHUNKS} SELECT chunk_id, text AS content, CASE WHEN item_id % 4 = 0 THEN 'new' ELSE 'old' END AS model_id, item_id::DOUBLE AS x FROM ic")
def vt_upsert(spark, d):
    """A quarter of the chunks is written again, twice in one batch: the last row of an id counts."""
    t = collection(spark, d)
    fresh = item_chunks(spark, d, "new").where(F.expr("cast(substring(document_id, 2) as long) % 4 = 0"))
    t.upsert("kb", fresh.withColumn("content", F.lit("first")).unionByName(fresh))
    t.upsert("kb", fresh.where("false"))
    return t.read("kb").select("chunk_id", "content", "model_id", F.get("vector", F.lit(0)).alias("x"))


@query(f"WITH {_CHUNKS}, asked AS (SELECT unnest(['item://1', 'item://3', 'item://none']) AS source_uri) SELECT source_uri, count(chunk_id) AS gone, 0 AS again, (SELECT count(*) FROM ic WHERE source_uri NOT IN ('item://1', 'item://3')) AS n_left FROM asked LEFT JOIN ic USING (source_uri) GROUP BY source_uri")
def vt_delete_source(spark, d):
    """Deletes by source say how many chunks went; an unknown source and a second time: none."""
    t = collection(spark, d)
    rows = [(u, t.delete_by_source_uri("kb", u), t.delete_by_source_uri("kb", u)) for u in ("item://1", "item://3", "item://none")]
    left = t.read("kb").agg(F.count("*").alias("n_left"))
    return spark.createDataFrame(rows, "source_uri string, gone long, again int").crossJoin(left)


@query(f"WITH {_CHUNKS} SELECT document_id, count(*) AS n FROM ic WHERE document_id NOT IN ('d5', 'd6') GROUP BY 1")
def vt_delete_document(spark, d):
    t = collection(spark, d)
    for i in ("d5", "d6", "d5", "none"):
        t.delete_by_document_id("kb", i)
    t.delete_by_document_id("no such collection", "d7")
    return t.read("kb").groupBy("document_id").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT sha256(text) AS content_hash FROM benchmark WHERE item_id % 10 <> 2")
def vt_content_hashes(spark, d):
    t = collection(spark, d)
    t.delete_by_source_uri("kb", "item://2")
    return t.get_existing_content_hashes("kb")


@query("SELECT * FROM (VALUES (0, 'None'), (1, 'None'), (2, 'ValueError'), (3, 'None'), (4, '[''a'', ''b'']'), (5, 'True'), (6, 'False'), (7, '[''a'']'), (8, '0')) AS t(step, outcome)")
def vt_collections(spark, d):
    """Creating a collection twice is no error, with other dimensions it is; dropping says whether there was one."""
    t = VectorTable(spark, f"{scratch(spark)}/chunks")
    steps = [
        lambda: t.ensure_collection("a", 3), lambda: t.ensure_collection("a", 3), lambda: t.ensure_collection("a", 4), lambda: t.ensure_collection("b", 4),
        t.table.parts, lambda: t.drop_collection("b"), lambda: t.drop_collection("b"), t.table.parts, lambda: t.read("b").count(),
    ]
    return spark.createDataFrame([(i, outcome(f)) for i, f in enumerate(steps)], "step int, outcome string")


@query("SELECT 'refused' AS outcome, 2 * count(*) AS n FROM benchmark")
def vt_wrong_vectors(spark, d):
    """Vectors of another length than the collection's are refused, and nothing changes."""
    t = collection(spark, d)
    bad = item_chunks(spark, d, "bad").withColumn("vector", F.array(F.lit(1.0)))
    said = outcome(lambda: t.upsert("kb", bad))
    return t.read("kb").where("model_id = 'old'").agg(F.lit("taken" if said == "None" else "refused").alias("outcome"), F.count("*").alias("n"))


@query(f"{Q._CH} SELECT 'doc://' || doc_id AS source_uri, n AS n_chunks FROM ch")
def vt_all_chunks(spark, d):
    """All chunks of all documents, read back without their vectors."""
    t = VectorTable(spark, f"{scratch(spark)}/chunks")
    t.ensure_collection("kb", 2)
    t.upsert("kb", Q.chunk_table_rows(spark, d))
    out = t.get_all_chunks("kb")
    return out.groupBy("source_uri").agg(F.count("*").alias("n_chunks"))


@query(f"WITH {_CHUNKS}, s AS (SELECT chunk_id, source_uri, list_cosine_similarity([item_id, i, 1]::DOUBLE[], [1, 1, 1]::DOUBLE[]) AS score FROM ic WHERE i = 1) SELECT chunk_id, round(score, 6) AS score FROM s ORDER BY round(score, 9) DESC, chunk_id LIMIT 7")
def vt_search_filtered(spark, d):
    return collection(spark, d).search("kb", [1.0, 1.0, 1.0], 7, {"chunk_index": 1}).select("chunk_id", F.round("score", 6).alias("score"))


@query("SELECT n_nationkey AS k, CASE WHEN n_nationkey % 12 = 5 THEN 'late' ELSE 'v' || (n_nationkey % 12) END AS v FROM nation WHERE n_nationkey <> 7")
def keyed_table_versions(spark, d):
    """Many small upserts, a delete, compaction and clean-up leave the last row of each key."""
    t = KeyedTable(spark, scratch(spark), "k long, v string", ["k"], most=4)
    rows = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k")).coalesce(1).persist()
    t.upsert(rows.withColumn("v", F.lit("start")))
    for i in range(12):
        t.upsert(rows.where(F.col("k") % 12 == i).withColumn("v", F.lit(f"v{i}")))
    t.delete(rows.where("k = 7"))
    t.upsert(rows.where("k % 12 = 5").withColumn("v", F.lit("late")))
    rows.unpersist()
    t.vacuum()
    return t.read()


# Cache, registry, catalog, files.


@query("SELECT sha256(text) AS content_hash, max(CASE WHEN doc_id % 3 = 0 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END) AS x FROM documents WHERE doc_id % 3 = 0 OR doc_id % 2 = 0 GROUP BY 1")
def cache_table(spark, d):
    """Vectors put for every other document, then others for every third one, under two models."""
    cache = EmbeddingCache(spark, scratch(spark))
    docs = table(spark, d, "documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))

    def put(some: DataFrame, model: str, x: float) -> None:
        cache.put(some.select("content_hash", F.lit(model).alias("model_id"), F.array(F.lit(x)).alias("vector"), F.current_timestamp().alias("created_at")))

    put(docs.where("doc_id % 2 = 0"), "m", 1.0)
    put(docs.where("doc_id % 3 = 0"), "m", 2.0)
    put(docs, "other", 3.0)
    return cache.read().where("model_id = 'm'").select("content_hash", F.get("vector", F.lit(0)).alias("x"))


@query("SELECT doc_id, NOT (doc_id % 5 <> 0 OR doc_id % 7 = 0) AS changed, doc_id % 5 <> 0 OR doc_id % 7 = 0 AS known FROM documents")
def registry_table(spark, d):
    """Hashes set for most sources, old ones of a seventh set right in a second step."""
    registry = HashRegistry(spark, scratch(spark))
    docs = table(spark, d, "documents").select("doc_id", F.lit("kb").alias("knowledge_base_id"), F.concat(F.lit("doc://"), F.col("doc_id").cast("string")).alias("source_uri"), T.content_hash(F.col("text")).alias("content_hash"))
    registry.set_hashes(docs.where("doc_id % 5 <> 0").withColumn("content_hash", F.when(F.col("doc_id") % 7 == 0, F.lit("old")).otherwise(F.col("content_hash"))))
    registry.set_hashes(docs.where("doc_id % 7 = 0"))
    return changed(docs, registry.table.read()).select("doc_id", "changed", "known")


@query("SELECT source_uri, hash, changed FROM (VALUES ('a', 'h2', false), ('b', 'h1', true), ('c', 'None', true)) AS t(source_uri, hash, changed)")
def registry_lookup(spark, d):
    registry = HashRegistry(spark, scratch(spark))
    for u, h in (("a", "h1"), ("b", "h1"), ("a", "h2")):
        registry.set_hashes(spark.createDataFrame([("kb", u, h), ("other", u, "h9")], "knowledge_base_id string, source_uri string, content_hash string"))
    return spark.createDataFrame([(u, str(registry.get_hash("kb", u)), registry.has_changed("kb", u, "h2")) for u in "abc"], "source_uri string, hash string, changed boolean")


@query("SELECT * FROM (VALUES ('first', NULL, 4, 0), ('second', 'said later', 8, 1), ('get of a deleted one', 'KnowledgeBaseNotFound', NULL, 2), ('delete of an unknown one', 'KnowledgeBaseNotFound', NULL, 3)) AS t(name, description, dims, pos) WHERE name <> 'first'")
def kb_lifecycle(spark, d):
    """Knowledge bases made, listed by age, saved again and deleted, each with its collection."""
    vectors = VectorTable(spark, f"{scratch(spark)}/chunks")
    kbs = KnowledgeBases(spark, scratch(spark), vectors)
    first, second = (kbs.create(name, "m", dims) for name, dims in (("first", 4), ("second", 8)))
    kbs.save(spark.createDataFrame([tuple((second | {"description": "said later"}).values())], KNOWLEDGE_BASES))
    assert [r["name"] for r in kbs.list_all().collect()] == ["first", "second"] and vectors.has_collection(first["id"])
    kbs.delete(first["id"])
    assert not vectors.has_collection(first["id"]) and kbs.get(second["id"])["embedding_dimensions"] == 8
    listed = [(r["name"], r["description"], r["embedding_dimensions"], 1) for r in kbs.list_all().collect()]
    errors = [("get of a deleted one", outcome(lambda: kbs.get(first["id"])), None, 2), ("delete of an unknown one", outcome(lambda: kbs.delete("none")), None, 3)]
    return spark.createDataFrame(listed + errors, "name string, description string, dims int, pos int")


@query("SELECT lower(n_name) || '.txt' AS name, length(n_name) AS size FROM nation WHERE n_nationkey <> 3 UNION ALL SELECT 'copy.txt', 8 UNION ALL SELECT 'deleted twice: True, False', 0")
def raw_files(spark, d):
    """Files saved, copied, deleted and listed; a name cannot lead out of its knowledge base's folder."""
    store = RawFiles(scratch(spark), spark)
    for r in table(spark, d, "nation").collect():  # a small dimension
        store.save_bytes("kb", f"../{r['n_name'].lower()}.txt", r["n_name"].encode())
    source = store.save_bytes("else", "copy.txt", b"8 bytes!")
    store.copy_from_path("kb", source)
    gone = [store.delete("kb", "nation_3.txt") for _ in range(2)]
    rows = [(f.name, f.size) for f in store.list_files("kb")] + [(f"deleted twice: {gone[0]}, {gone[1]}", len(store.list_files("none")))]
    return spark.createDataFrame(rows, "name string, size long")


# Embedding models.


def _shuffled(texts: list[str], kind: str):
    """A model that answers in another order, with the index of each text."""
    return [(i, [float(len(t)), float(len(t.encode())), 2.0 if kind == "query" else 1.0]) for i, t in reversed(list(enumerate(texts)))]


_failed: set = set()


def _failing(texts: list[str], kind: str):
    """Fails the first two times that it sees a batch."""
    for n in (1, 2):
        if (key := (n, *texts)) not in _failed:
            _failed.add(key)
            raise OSError("busy")
    return _shuffled(texts, kind)


def _embedded(spark, d, model, kind="passage", batch=32):
    embed = model_udf(model, kind, batch, first_wait=0)
    rows = Q.items(spark, d).withColumn("v", embed(F.col("text")))
    return rows.select("query_id", *(F.get("v", F.lit(i)).alias(n) for i, n in enumerate(("chars", "bytes", "kind"))))


_VECTORS = "SELECT item_id AS query_id, length(text)::DOUBLE AS chars, strlen(text)::DOUBLE AS bytes, {}::DOUBLE AS kind FROM benchmark"


@query(_VECTORS.format("1"))
def embed_batches(spark, d):
    """Batches of seven to a model whose answers are out of order."""
    return _embedded(spark, d, _shuffled, batch=7)


@query(_VECTORS.format("1"))
def embed_retries(spark, d):
    return _embedded(spark, d, _failing)


@query(_VECTORS.format("2"))
def embed_queries(spark, d):
    return _embedded(spark, d, _shuffled, kind="query")


# Indexing.


def _indexed(spark, d) -> tuple[Indexer, DataFrame, list]:
    """An indexer after two batches, the second one's report, and what was invalidated.

    The first has four fifths of the documents, a seventh with b for each a; the second all, an eleventh of them not readable.
    """
    base, calls = scratch(spark), []
    vectors = VectorTable(spark, f"{base}/chunks")
    vectors.ensure_collection("kb", 64)
    indexer = Indexer(vectors, HashRegistry(spark, f"{base}/hashes"), EmbeddingCache(spark, f"{base}/vectors"), "hash-64", hashing_model(64), chunker("recursive", 128, 16), callbacks=[calls.append])
    docs = table(spark, d, "documents", "doc_id")
    other = docs.where("doc_id % 5 <> 0").withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.translate("text", "a", "b")).otherwise(F.col("text")))
    indexer.index(S.as_raw(other, "kb"), "kb")
    error = F.when(F.regexp_extract("source_uri", r"(\d+)$", 1).cast("long") % 11 == 0, F.create_map(F.lit("error"), F.lit("not readable")))
    second = S.as_raw(docs, "kb").withColumn("extra", F.coalesce(error, F.col("extra")))
    return indexer, indexer.index(second, "kb"), calls


_NEW = "doc_id % 11 <> 0 AND (doc_id % 5 = 0 OR doc_id % 7 = 0 AND contains(text, 'a'))"


@query(f"{Q._CH} SELECT 'doc://' || doc_id AS source_uri, doc_id % 11 <> 0 AND NOT ({_NEW}) AS skipped, CASE WHEN {_NEW} THEN coalesce(n, 0) ELSE 0 END AS chunk_count, CASE WHEN doc_id % 11 = 0 THEN 'not readable' END AS error FROM documents LEFT JOIN ch USING (doc_id)")
def index_report(spark, d):
    return _indexed(spark, d)[1]


@query(f"{Q._CH} SELECT 'doc://' || doc_id AS source_uri, n AS n_chunks FROM ch WHERE doc_id % 11 <> 0 OR doc_id % 5 <> 0")
def index_state(spark, d):
    """The chunk table after both batches: what could not be read keeps its old chunks."""
    return _indexed(spark, d)[0].vectors.get_all_chunks("kb").groupBy("source_uri").agg(F.count("*").alias("n_chunks"))


@query(f"SELECT count(*) FILTER ({_NEW}) AS indexed_count, count(*) FILTER (doc_id % 11 <> 0 AND NOT ({_NEW})) AS skipped_count, count(*) FILTER (doc_id % 11 = 0) AS failed_count, 'kb,kb' AS invalidated FROM documents")
def index_counts(spark, d):
    _, report, calls = _indexed(spark, d)
    return batch_counts(report).withColumn("invalidated", F.lit(",".join(calls)))


# Engine.


def _engine(spark, d) -> Engine:
    """An engine whose knowledge base kb has each document as one chunk."""
    engine = Engine(spark, EngineConfig(scratch(spark), chunk_size=1_000_000))
    engine.vectors.ensure_collection("kb", 64)
    engine.kbs.save(spark.createDataFrame([("kb", "docs", None, "hash-64", 64, None, None)], KNOWLEDGE_BASES))
    engine.ingest_raw(S.as_raw(table(spark, d, "documents", "doc_id"), "kb"), "kb")
    return engine


_STRIPPED = Q.sql_strip("text")
_BY_CHUNK = f"docs0 AS (SELECT doc_id AS old_id, text FROM documents), documents AS (SELECT old_id, sha256('kb|doc://' || old_id || '|' || sha256({_STRIPPED}) || '|0') AS doc_id, text FROM docs0)"


@query(f"WITH {_BY_CHUNK}, {Q._SIDES}, {Q._FUSED}, fs AS (SELECT query_id, doc_id, 0.5 * d + 0.5 * s AS score FROM fu), {Q._top_sql('fs', 20, 'r')}, {Q._RERANK} SELECT query_id, 'doc://' || old_id AS source_uri, rank::INT AS rank, round(rerank_score, 5) AS rerank_score FROM rr JOIN documents USING (doc_id) WHERE rank <= 5")
def engine_retrieve(spark, d):
    """Documents ingested into a knowledge base, then hybrid retrieval through its stored index."""
    engine = _engine(spark, d)
    asks = Q.items(spark, d).withColumn("vector", engine.embed(F.col("text")))
    return engine.retrieve("kb", asks).select("query_id", "source_uri", "rank", F.round("rerank_score", 5).alias("rerank_score"))


@query(f"WITH {Q._POST}, {Q._ASK}, {Q._SPARSE}, {Q._top_sql('sc', 10, 'r')} SELECT query_id, doc_id, round(score, 6) AS score FROM r WHERE score > 0")
def bm25_stored(spark, d):
    """BM25 from stored postings; the index is found again by another object."""
    path = scratch(spark)
    R.StoredIndex(spark, path).build(Q.chunk_rows(spark, d))
    index = R.StoredIndex(spark, path)
    assert index.is_built()
    return index.search(Q.items(spark, d), 10).select("query_id", F.col("chunk_id").cast("long").alias("doc_id"), F.round("score", 6).alias("score"))


@query("SELECT item_id AS query_id, 1 AS n_before, 1 AS n_after, true AS found_new FROM benchmark WHERE item_id < 3")
def bm25_invalidated(spark, d):
    """A changed source is found under its new words once its knowledge base's index is made anew."""
    engine = Engine(spark, EngineConfig(scratch(spark), rerank=False))
    kb = engine.create_knowledge_base("k")["id"]

    def ingest(word: str) -> None:
        rows = [(i, f"{word}{i} common words of all") for i in range(3)]
        engine.ingest_raw(S.as_raw(spark.createDataFrame(rows, "doc_id long, text string"), kb), kb)

    def found(word: str) -> dict:
        asks = spark.createDataFrame([(i, f"{word}{i}") for i in range(3)], "query_id long, text string")
        return {r["query_id"]: r["chunk_id"] for r in engine._index(kb).search(asks, 5).collect()}

    ingest("old")
    before = found("old")
    ingest("new")
    after, stale = found("new"), found("old")
    return spark.createDataFrame([(i, int(i in before), int(i in after), i not in stale) for i in range(3)], "query_id long, n_before int, n_after int, found_new boolean")


@query("""SELECT * FROM (VALUES ('health', 200, 'ok'), ('ready', 200, 'ready'), ('create', 200, 'k'), ('unknown', 404, 'not_found'), ('no loader', 422, 'invalid'), ('broken', 500, 'internal_error')) AS t(call, status, said)""")
def engine_responses(spark, d):
    """Calls as a service would answer them."""
    engine = Engine(spark, EngineConfig(scratch(spark)))
    kb = engine.create_knowledge_base("first")["id"]
    calls = [
        ("health", engine.respond(engine.health)), ("ready", engine.respond(lambda: engine.ready()[1])), ("create", engine.respond(engine.create_knowledge_base, "k")),
        ("unknown", engine.respond(engine.ingest, ["/a.txt"], "none")), ("no loader", engine.respond(engine.ingest, ["/a.xyz"], kb)), ("broken", engine.respond(lambda: 1 / 0)),
    ]
    said = lambda body: body.get("status") or body.get("name") or body["error"]["code"]
    assert all(r["headers"]["X-Request-ID"] for _, r in calls)
    return spark.createDataFrame([(name, r["status"], said(r["body"])) for name, r in calls], "call string, status int, said string")


_SETTINGS = {
    "defaults": ({}, True), "no base": ({"base": ""}, False), "no model": ({"embedding_model_id": ""}, False), "alpha over 1": ({"alpha": 1.1}, False), "alpha 0": ({"alpha": 0.0}, True),
    "overlap of a chunk": ({"chunk_overlap": 512}, False), "smaller overlap": ({"chunk_overlap": 511}, True), "unknown strategy": ({"chunk_strategy": "x"}, False), "semantic": ({"chunk_strategy": "semantic"}, True),
    "no results": ({"top_k": 0}, False), "cloud without key": ({"store_mode": "cloud"}, False), "cloud with key": ({"store_mode": "cloud", "store_key": "k"}, True),
}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', {str(ok).lower()})" for k, (_, ok) in _SETTINGS.items()) + ") AS t(settings, taken)")
def settings_checked(spark, d):
    return spark.createDataFrame([(k, outcome(lambda c=changes: EngineConfig(**({"base": "b"} | c))) != "ValueError") for k, (changes, _) in _SETTINGS.items()], "settings string, taken boolean")


@query("SELECT n_nationkey, 'warning' AS level, 'seen ' || n_name AS event, n_name AS name FROM nation")
def log_lines(spark, d):
    """Log records as JSON lines, read back."""
    rows = []
    for r in table(spark, d, "nation").collect():  # a small dimension
        record = logging.makeLogRecord({"name": "docweave", "levelno": logging.WARNING, "levelname": "WARNING", "msg": "seen %s", "args": (r["n_name"],), "nation": r["n_name"]})
        line = json.loads(JsonFormatter().format(record))
        rows.append((r["n_nationkey"], line["level"], line["event"], line["nation"]))
    return spark.createDataFrame(rows, f"n_nationkey {table(spark, d, 'nation').schema['n_nationkey'].dataType.simpleString()}, level string, event string, name string")


@query(
    rf"""WITH {Q._RES}, nc AS (SELECT query_id, count(*) AS n FROM r GROUP BY 1),
w AS (SELECT item_id AS query_id, regexp_extract_all(text, '\S+')[1:3] AS w FROM benchmark)
SELECT query_id, (unnest(range(len(w))))::INT AS seq, unnest(w) || ' ' AS text, false AS is_final, 0 AS n_citations FROM w
UNION ALL SELECT query_id, len(w)::INT, '', true, coalesce(n, 0)::INT FROM w LEFT JOIN nc USING (query_id)"""
)
def answer_stream(spark, d):
    """Answers of a model, piece by piece: it fails at first, says empty pieces between, and citations come with the last one."""
    found = Q._results(spark, d).persist()  # a few for each query of the batch, read twice
    cited: dict = {}
    for r in A.citations(found).collect():
        cited.setdefault(r["query_id"], []).append(r.asDict())
    rows = []
    for p in A.prompts(Q.items(spark, d), found).collect():
        calls = []

        def generator(system: str, user: str, calls=calls):
            calls.append(1)
            if len(calls) == 1:
                raise OSError("busy")
            words = user.rpartition("\n\nQuestion: ")[2].split()[:3]
            return iter([x for w in words for x in ((w + " ", False), ("", False))] + [("", True)])

        stream = A.stream_generate(generator, p["system"], p["user"], cited.get(p["query_id"], []), first_wait=0)
        rows += [(p["query_id"], i, e["text"], e["is_final"], len(e["citations"])) for i, e in enumerate(stream)]
    found.unpersist()
    return spark.createDataFrame(rows, "query_id long, seq int, text string, is_final boolean, n_citations int")


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


__all__ = ["KnowledgeBaseNotFound", "oracle_sql", "queries"]
