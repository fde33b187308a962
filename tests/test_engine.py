import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from docweave.operators.catalog import KnowledgeBaseNotFound, RawFiles
from docweave.plans.engine import Engine, EngineConfig
from docweave.plans.ingest import batch_counts
from docweave.sources import files as S
from docweave.sources import pages as W
from docweave.streaming import ingest as stream


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, EngineConfig(str(tmp_path / "base"), chunk_size=32, chunk_overlap=4))


def write(folder, **texts):
    folder.mkdir(exist_ok=True)
    out = []
    for name, text in texts.items():
        path = folder / name.replace("_", ".")
        path.write_bytes(text if isinstance(text, bytes) else text.encode())
        out.append(str(path))
    return out


def report(df):
    return {r["source_uri"].rpartition("/")[2]: (r["skipped"], r["chunk_count"], r["error"]) for r in df.collect()}


def test_incremental_indexing(spark, engine, tmp_path):
    kb = engine.create_knowledge_base("first")["id"]
    calls = []
    engine.indexer.add_invalidate_callback(calls.append)
    paths = write(tmp_path / "in", a_txt="ships leave at noon", b_md="# Tides\n\nwater rises", c_csv="name,role\nAlice,Engineer\n", d_html="<title>Page</title><nav>x</nav><p>the real content</p>")
    first = report(engine.ingest(paths, kb))
    assert {k: v[0] for k, v in first.items()} == {"a.txt": False, "b.md": False, "c.csv": False, "d.html": False}
    again = engine.ingest(paths, kb)
    assert all(v[0] for v in report(again).values()) and calls == [kb]
    assert tuple(batch_counts(again).first()) == (0, 4, 0)
    write(tmp_path / "in", a_txt="ships leave at dusk now")
    third = report(engine.ingest(paths, kb))
    assert [k for k, v in third.items() if not v[0]] == ["a.txt"]
    texts = {r["content"] for r in engine.vectors.get_all_chunks(kb).collect()}
    assert "ships leave at dusk now" in texts and "ships leave at noon" not in texts
    assert any(t.startswith("| name | role |\n| --- | --- |") for t in texts)
    assert "Page\nthe real content" in texts


def test_query_streams_events(engine, tmp_path):
    kb = engine.create_knowledge_base("q")["id"]
    engine.ingest(write(tmp_path / "in", a_txt="ships leave at noon", b_txt="water was low in the harbour today"), kb)
    events = [json.loads(e.removeprefix("data: ")) for e in engine.query(kb, "ship", 1)]
    assert "".join(e["text"] for e in events).strip() == "ships leave at noon"
    assert events[-1]["is_final"] and events[-1]["citations"][0]["source_uri"].endswith("a.txt")
    engine.generator = lambda system, user: iter([("Hi ", False), ("there", True)])
    events = [json.loads(e.removeprefix("data: ")) for e in engine.query(kb, "ship", 1)]
    assert [e["text"] for e in events] == ["Hi ", "there"] and events[1]["citations"]
    with pytest.raises(KnowledgeBaseNotFound):
        list(engine.query("none", "x"))


def test_collections(spark, engine):
    kb, other = engine.create_knowledge_base("a")["id"], engine.create_knowledge_base("b", system_prompt="p")["id"]
    row = {c: None for c in engine.vectors.read(kb).columns}
    rows = [row | {"chunk_id": str(i), "document_id": f"d{i // 2}", "source_uri": f"u{i // 2}", "content_hash": f"h{i // 2}", "content": "x", "vector": [float(i)] * 64, "knowledge_base_id": kb, "model_id": "m"} for i in range(4)]
    df = spark.createDataFrame(rows, engine.vectors.read(kb).schema)
    engine.vectors.upsert(kb, df)
    engine.vectors.upsert(kb, df.where("chunk_id = '1'").withColumn("content", F.lit("new")))
    assert engine.vectors.read(kb).count() == 4 and engine.vectors.read(kb).where("content = 'new'").count() == 1
    assert engine.vectors.read(other).count() == 0
    assert engine.vectors.delete_by_source_uri(kb, "u0") == 2 and engine.vectors.delete_by_source_uri("nothing", "u0") == 0
    assert [r[0] for r in engine.vectors.get_existing_content_hashes(kb).collect()] == ["h1"]
    engine.vectors.delete_by_document_id(kb, "d1")
    assert engine.vectors.read(kb).count() == 0
    with pytest.raises(ValueError, match="dimensions"):
        engine.vectors.ensure_collection(kb, 3)
    with pytest.raises(Exception, match="dimensions"):
        engine.vectors.upsert(kb, df.withColumn("vector", F.array(F.lit(1.0))))
    assert [r["name"] for r in engine.kbs.list_all().collect()] == ["a", "b"]
    engine.kbs.delete(kb)
    assert [r["name"] for r in engine.kbs.list_all().collect()] == ["b"]
    with pytest.raises(KnowledgeBaseNotFound):
        engine.kbs.get(kb)


@pytest.mark.parametrize("bad", [{"alpha": 2}, {"chunk_overlap": 512}, {"chunk_strategy": "none"}, {"top_k": 0}, {"embedding_model_id": ""}, {"cache_per": "x"}])
def test_settings_are_checked(bad):
    with pytest.raises(ValueError):
        EngineConfig("base", **bad)


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), text)
    return out.getvalue()


def test_office_files(spark, tmp_path):
    docx = zipped(word__document_xml="<d xmlns:w='w'><w:p><w:r><w:t>Hello</w:t></w:r><w:r><w:t> there</w:t></w:r></w:p><w:p><w:t>Two</w:t></w:p></d>")
    pptx = zipped(ppt__slides__slide2_xml="<s xmlns:a='a'><a:p><a:t>B</a:t></a:p></s>", ppt__slides__slide1_xml="<s xmlns:a='a'><a:p><a:t>A</a:t></a:p></s>")
    xlsx = zipped(xl__sharedStrings_xml="<sst><si><t>name</t></si></sst>", xl__worksheets__sheet1_xml="<w><row><c r='A1' t='s'><v>0</v></c><c r='C1'><v>3</v></c></row><row><c r='A2'><v>4</v></c></row></w>")
    paths = write(tmp_path / "o", a_docx=docx, b_pptx=pptx, c_xlsx=xlsx, d_docx=b"broken")
    got = {r["source_uri"].rpartition("/")[2]: r for r in S.load_paths(spark, paths, "k").collect()}
    assert got["a.docx"]["content"] == "Hello there\nTwo" and got["b.pptx"]["content"] == "A\n\nB"
    assert got["c.xlsx"]["content"] == "| name |  | 3 |\n| --- | --- | --- |\n| 4 |  |  |"
    assert got["d.docx"]["content"] is None and "BadZipFile" in got["d.docx"]["extra"]["error"]


def test_images_and_registry(spark, tmp_path):
    paths = write(tmp_path / "o", a_png=b"\x89PNG")
    got = S.load_images(spark, paths, "k", ocr=lambda name, data: f"{len(data)} bytes", provider="fake").first()
    assert got["content"] == "4 bytes" and got["extra"] == {"ocr_provider": "fake"} and got["source_type"] == "image"
    with pytest.raises(ValueError, match="No registered loader"):
        S.load_paths(spark, ["/x/y.xyz"], "k")
    with pytest.raises(Exception, match="No registered loader"):
        spark.createDataFrame([("/x/y.xyz",)], "u string").select(S.resolved(F.col("u"))).collect()


def test_text_is_decoded(spark, tmp_path):
    got = S.load_text(spark, write(tmp_path / "t", a_txt=b"a\r\nb\rc \xff"), "k").first()
    assert got["content"] == "a\nb\nc �" and got["mime_type"] == "text/plain" and got["file_size_bytes"] == 8


def test_pages(spark, engine):
    def get(url):
        if "bad" in url:
            raise OSError("gone")
        return {"url": url + "/final", "html": "<p>hello</p>", "content_type": "text/html; charset=utf-8", "content_length": "100", "last_modified": "Thu, 01 Jan 2026 00:00:00 GMT"}

    urls = spark.createDataFrame([("http://a.example",)], "url string")
    page = W.load_pages(W.fetch_pages(urls, get), "k").first()
    assert (page["source_uri"], page["mime_type"], page["file_size_bytes"], page["source_type"]) == ("http://a.example/final", "text/html", 100, "website")
    kb = engine.create_knowledge_base("web")["id"]
    assert report(engine.ingest_pages(W.fetch_pages(urls, get).drop("error"), kb))["final"][1] == 1


def test_raw_files(spark, tmp_path):
    store = RawFiles(str(tmp_path), spark)
    store.save_bytes("kb", "../../evil.txt", b"x")
    assert [p.name for p in store.list_files("kb")] == ["evil.txt"] and store.list_files("none") == []
    assert store.delete("kb", "evil.txt") and not store.delete("kb", "evil.txt")


def test_stream(spark, engine, small, tmp_path):
    kb = engine.create_knowledge_base("s")["id"]
    folder = tmp_path / "docs"
    spark.read.parquet(f"{small}/documents.parquet").where("n_chars < 600").write.parquet(str(folder))
    reports = []
    for _ in range(2):
        rows = stream.as_raw(stream.document_stream(spark, str(folder)), kb)
        stream.index_stream(rows, engine.indexer, kb, str(tmp_path / f"check{len(reports)}"), lambda r, n: reports.append(tuple(batch_counts(r).first()))).awaitTermination()
    n = spark.read.parquet(str(folder)).count()
    assert reports == [(n, 0, 0), (0, n, 0)]


def test_a_later_session_finds_the_index(spark, engine, tmp_path):
    kb = engine.create_knowledge_base("i")["id"]
    engine.ingest(write(tmp_path / "in", a_txt="ships leave at noon"), kb)
    assert len(list(engine.query(kb, "ship", 1))) > 1
    index = engine._index(kb)
    other = Engine(spark, engine.config)
    assert other._index(kb).path == index.path and index.is_built()
    engine.ingest(write(tmp_path / "in", a_txt="trains leave at one"), kb)
    assert not index.is_built() and other._index(kb).path != index.path


def test_responses(engine):
    kb = engine.create_knowledge_base("r")["id"]
    done = engine.respond(engine.retrieve, kb, engine._queries(["x"]), request_id="abc")
    assert done["status"] == 200 and done["headers"]["X-Request-ID"] == "abc" and float(done["headers"]["X-Process-Time-Ms"]) >= 0
    failed = engine.respond(lambda: {}["secret"])
    assert failed["status"] == 500 and "secret" not in json.dumps(failed["body"]) and failed["body"]["error"]["request_id"] == failed["headers"]["X-Request-ID"]
    assert engine.respond(engine.kbs.get, "none")["status"] == 404 and engine.health() == {"status": "ok"}
    assert engine.ready() == (True, {"status": "ready", "dependencies": dict.fromkeys(("knowledge_bases", "chunks", "hashes", "vectors"), "ok")})
    engine.kbs.table.files.write(f"{engine.kbs.table.path}/log/{99:020d}.json", b"broken")
    assert engine.ready()[1]["dependencies"]["knowledge_bases"] == "unavailable" and not engine.ready()[0]
