"""What larger tables and odd inputs showed, on small ones."""

import hashlib
import math
import time

import pytest
from pyspark.sql import functions as F

from docweave import catalog_queries as Q
from docweave.functions import html as H
from docweave.functions import text as T
from docweave.operators import chunk as C
from docweave.operators import retrieval as R
from docweave.operators import tables as K
from docweave.plans.engine import Engine, EngineConfig
from docweave.sources import files as L
from docweave.sources.files import raw_rows


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<title>a&&amp</title><p>b&amp;c &copy 1 &copy; &#38 &#38; x?a=1&copy=2</p>", "a&&amp\nb&c &copy 1 © &#38 & x?a=1&copy=2"),
        ("<p>a\x01b &amp;amp &amp</p>", "ab &amp &amp"),
    ],
)
def test_a_reference_ends_with_a_semicolon(html, want):
    assert H.html_text(html) == want


def test_payload_has_the_hash_of_the_text_as_loaded(spark, tmp_path):
    rows = [(1, " blanks at both ends \n", "en", "a", 0), (2, "plain", "en", "b", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["source_uri"]: (r["knowledge_base_id"], r["content_hash"]) for r in Q.payload_round_trip(spark, str(tmp_path)).collect()}
    assert got == {f"doc://{i}": (kb, hashlib.sha256(text.encode()).hexdigest()) for i, text, _, kb, _ in rows}


def test_sparse_search_scores_chunks_in_their_rows(spark, monkeypatch):
    """No join and one exchange, of the best rows; the same results in however many blocks and groups, with ties, repeated ids and nulls."""
    texts = ["red blue", "red blue", "red red green", None, "", "blue green yellow", "grey"] + [f"word{i} common" for i in range(20)]
    chunks = spark.createDataFrame([(f"{i:03}", t) for i, t in enumerate(texts)], "chunk_id string, content string")
    asks = spark.createDataFrame([(0, "red"), (1, "blue green"), (1, "grey"), (2, None), (3, "none of these"), (4, "word3 word4 word4"), (5, "common"), (6, "reds")], "query_id long, text string")
    docs = {f"{i:03}": t.split() for i, t in enumerate(texts) if t}
    df = {t: sum(t in d for d in docs.values()) for d in docs.values() for t in d}
    raw = {t: math.log(len(texts) - n + 0.5) - math.log(n + 0.5) for t, n in df.items()}
    floor, avg = 0.25 * sum(raw.values()) / len(raw), sum(map(len, docs.values())) / len(texts)
    part = lambda d, t: (floor if raw[t] < 0 else raw[t]) * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / avg))
    want = {}
    for q, terms in {0: ["red"], 1: ["blue", "green", "grey"], 4: ["word3", "word4", "word4"], 5: ["common"], 6: ["red"]}.items():
        found = sorted((-round(x, 9), c) for c, d in docs.items() if (x := sum(part(d, t) for t in terms if t in raw)) > 0)[:3]
        want |= {(q, c): (n, -x) for n, (x, c) in enumerate(found, 1)}
    for batch, group in ((2000, 256), (3, 2)):
        monkeypatch.setattr(R, "BATCH", batch)
        monkeypatch.setattr(R, "GROUP", group)
        out = R.BM25Index(chunks).search(asks, 3)
        assert {(r["query_id"], r["chunk_id"]): (r["rank"], round(r["score"], 9)) for r in out.collect()} == {k: (n, pytest.approx(x)) for k, (n, x) in want.items()}
    monkeypatch.setattr(R, "BATCH", 2000)
    plan = R.BM25Index(chunks).search(asks, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
    plan = R.with_chunks(R.BM25Index(chunks).search(asks, 3), chunks, asks)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_stored_postings_name_each_chunk_once(spark, tmp_path):
    """A segment for each batch, written without a shuffle; results like those of the index over texts, in however small parts a segment is scored."""
    rows = [(f"{i:03}", " ".join(f"w{j}" for j in range(40) if (i + 1) % (j + 1) == 0)) for i in range(90)] + [("none", None), ("empty", "")]
    chunks = spark.createDataFrame(rows, "chunk_id string, content string").repartition(3)
    stored = R.StoredIndex(spark, str(tmp_path / "i")).build(chunks)
    ids = [c for r in stored._chunks().collect() for c in r["chunk_ids"]]
    assert sorted(ids) == sorted(r[0] for r in rows) and stored._chunks().count() == 3
    asks = spark.createDataFrame([(i, f"w{i} w{2 * i} w{3 * i} w7 w7") for i in range(12)] + [(99, "nothing"), (98, None)], "query_id long, text string")
    show = lambda index: sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 9)) for r in index.search(asks, 4).collect())
    assert show(stored) == show(R.BM25Index(chunks)) and len(show(stored)) > 30


def shuffled(spark, do) -> int:
    """Bytes that the stages of a call wrote for shuffles."""
    sc = spark.sparkContext._jsc.sc()

    def total() -> int:
        sc.listenerBus().waitUntilEmpty(30_000)
        stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = total()
    do()
    return total() - before


def noise(i: int, n: int = 20_000) -> str:
    """Text that can't be packed to less than half its length."""
    return "".join(hashlib.sha256(f"{i}-{j}".encode()).hexdigest() for j in range(n // 64))


def test_upserts_shuffle_keys_only(spark, tmp_path):
    t = K.KeyedTable(spark, str(tmp_path / "t"), "k long, v string", ["k"])
    rows = spark.createDataFrame([(i, noise(i)) for i in range(100)], "k long, v string")
    assert shuffled(spark, lambda: t.upsert(rows)) < 100_000
    again = spark.createDataFrame([(i % 70, f"{noise(i)} {i}") for i in range(140)] + [(None, "a"), (None, "b")], "k long, v string")
    assert shuffled(spark, lambda: t.upsert(again)) < 100_000
    got = {r["k"]: r["v"] for r in t.read().collect()}
    assert got == {None: "b"} | {i: noise(i) for i in range(70, 100)} | {i: f"{noise(i + 70)} {i + 70}" for i in range(70)} and t.read().count() == 101


def test_marked_numbers(spark):
    wanted = {0, 5, 63, 64, 127, 1 << 33, (1 << 33) + 63, (1 << 40) + 62}
    numbers = sorted(wanted | {1, 62, 65, (1 << 33) + 1, (1 << 40) + 63})
    rows = K.marked(spark.createDataFrame([(n,) for n in numbers], "n long"), F.col("n"), spark.createDataFrame([(n,) for n in wanted], "x long")).collect()
    assert {r["n"]: r["__marked"] for r in rows} == {n: n in wanted for n in numbers}


@pytest.mark.parametrize("per", ["chunk", "document"])
def test_indexing_shuffles_no_texts(spark, tmp_path, per):
    """Repeated sources and texts, texts that the cache knows, errors; each distinct text has its vector, as from the model."""
    engine = Engine(spark, EngineConfig(str(tmp_path / "e"), chunk_size=1_000_000, chunk_overlap=0, cache_per=per))
    kb = engine.create_knowledge_base("k")["id"]

    def ingest(*rows):
        df = spark.createDataFrame([(u, t, e, m) for u, t, e, m in rows], "u string, t string, e string, m long")
        extra = F.when(F.col("e").isNotNull(), F.create_map(F.lit("error"), F.col("e"))).otherwise(F.create_map().cast("map<string,string>"))
        raw = raw_rows(df, F.col("t"), F.col("u"), F.lit("txt"), kb, modified=F.timestamp_seconds("m"), extra=extra)
        return {r["source_uri"]: (r["skipped"], r["chunk_count"], r["error"]) for r in engine.ingest_raw(raw, kb).collect()}

    held = lambda: {r["source_uri"]: (r["content"], r["vector"]) for r in engine.vectors.read(kb).collect()}
    alike = lambda a, b: all(abs(x - y) < 1e-9 for x, y in zip(a, b, strict=True))
    texts = {f"n{i}": noise(i, 4000) for i in range(100)}
    rows = [*((u, t, None, 1) for u, t in texts.items()), ("twice", "old", None, 1), ("twice", "new same", None, 2), ("tie", "b c", None, 1), ("tie", "b a", None, 1), ("tie", "a", None, 1), ("copy", texts["n3"], None, 1), ("bad", None, "broken", 1), ("bad", "read", None, 0), ("none", "", None, 1)]
    found: list = []
    bytes_ = shuffled(spark, lambda: found.append(ingest(*rows)))
    assert per == "document" or bytes_ < 150_000
    assert found[0] == {u: (False, 1, None) for u in (*texts, "twice", "tie", "copy")} | {"bad": (False, 0, "broken"), "none": (False, 0, None)}
    got = held()
    assert {u: t for u, (t, _) in got.items()} == texts | {"twice": "new same", "tie": "b c", "copy": texts["n3"]}
    again = ingest(*((u, t, None, 3) for u, t in texts.items() if u != "n5"), ("n5", texts["n6"], None, 3), ("fresh", "fresh", None, 3), ("other", "fresh", None, 3), ("bad", "read", None, 3))
    assert again == {u: (True, 0, None) for u in texts if u != "n5"} | {u: (False, 1, None) for u in ("n5", "fresh", "other", "bad")}
    got = held()
    assert {u: t for u, (t, _) in got.items()} == texts | {"n5": texts["n6"], "twice": "new same", "tie": "b c", "copy": texts["n3"], "fresh": "fresh", "other": "fresh", "bad": "read"}
    want = {r["c"]: r["v"] for r in spark.createDataFrame([(t,) for t, _ in got.values()], "c string").select("c", engine.embed(F.col("c")).alias("v")).collect()}
    assert all(alike(v, want[t]) for t, v in got.values())
    cached = engine.indexer.cache.read()
    assert cached.count() == cached.select("content_hash").distinct().count() == len({t for t, _ in got.values()} | {texts["n5"]})


@pytest.mark.parametrize("split", [lambda df: C.chunk_semantic(df, 0.9, 96), lambda df: C.chunk_recursive(df, 64, 8)])
def test_chunking_a_long_text_takes_time_in_proportion(spark, split):
    """A chunk for each of many sentences; none carries the others along."""
    n = 40_000
    df = spark.createDataFrame([("a", " ".join(f"Word{i} stands {i} alone." for i in range(n)))], "id string, content string")
    began = time.time()
    rows = split(df).select("chunk_index", "content").orderBy("chunk_index").collect()
    assert time.time() - began < 15
    assert " ".join(r["content"] for r in rows) == " ".join(f"Word{i} stands {i} alone." for i in range(n))
    assert [r["chunk_index"] for r in rows] == list(range(len(rows))) and len(rows) > n * 0.9


def test_strip_takes_all_white_space(spark):
    blanks = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
    rows = spark.createDataFrame([(f"{blanks}a{blanks}b{blanks}",), (blanks,), ("",), (None,), ("​x​",)], "t string")
    got = [tuple(r) for r in rows.select(T.strip(F.col("t")), T.rstrip(F.col("t")), T.is_blank(F.col("t"))).collect()]
    assert got == [(t and t.strip(), t and t.rstrip(), None if t is None else not t.strip()) for t in (f"{blanks}a{blanks}b{blanks}", blanks, "", None, "​x​")]


def test_many_small_files_are_read_by_few_tasks(spark, tmp_path):
    for i in range(400):
        (tmp_path / f"{i}.html").write_text(f"<title>t{i}</title>")
    rows = L.load_html(spark, str(tmp_path), "kb")
    assert rows.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert {r["title"] for r in rows.select("title").collect()} == {f"t{i}" for i in range(400)}
