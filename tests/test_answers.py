import json

import pytest

from docweave.operators import answers as A
from docweave.operators import evaluate as E
from docweave.operators.embed import embed_cached, model_udf, with_retries
from docweave.schema import SYSTEM_PROMPT

RESULT = "query_id long, rank int, chunk_id string, document_id string, source_uri string, title string, content string, score double, rerank_score double"


def results(spark):
    return spark.createDataFrame([(0, 1, "c1", "d1", "u1", None, " first text ", 0.5, None), (0, 2, "c2", "d2", "u2", "T", "word " * 100, 0.4, 0.9)], RESULT)


def test_citations(spark):
    got = A.citations(results(spark)).orderBy("rank").collect()
    assert [r["score"] for r in got] == [0.5, 0.9]
    assert got[0]["excerpt"] == "first text" and got[1]["excerpt"].endswith("...")


def test_prompt(spark):
    queries = spark.createDataFrame([(0, "why?"), (1, "none")], "query_id long, text string")
    got = {r["query_id"]: r for r in A.prompts(queries, results(spark)).collect()}
    assert got[0]["system"] == SYSTEM_PROMPT
    assert got[0]["user"] == f"Context:\n[Source 1: u1]\n first text \n\n[Source 2: u2]\n{'word ' * 100}\n\nQuestion: why?"
    assert got[1]["user"] == "Context:\n\n\nQuestion: none"
    assert A.prompts(queries, results(spark), "own").first()["system"] == "own"


def test_events(spark):
    found = results(spark)
    rows = A.sse(A.events(A.extractive_pieces(found), A.citations(found))).orderBy("seq").collect()
    texts = [json.loads(r["event"].removeprefix("data: ")) for r in rows]
    assert all(r["event"].endswith("\n\n") for r in rows)
    assert "".join(t["text"] for t in texts).strip() == "first text"
    assert [bool(t["citations"]) for t in texts] == [False] * (len(texts) - 1) + [True]
    assert texts[-1]["is_final"] and len(texts[-1]["citations"]) == 2


def test_stream_generate():
    pieces = list(A.stream_generate(lambda s, u: iter([("Hello ", False), ("", False), ("world.", True)]), "s", "u", [{"x": 1}]))
    assert [(p["text"], p["is_final"], len(p["citations"])) for p in pieces] == [("Hello ", False, 0), ("world.", True, 1)]


def test_retries():
    calls = []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("no")
        return 7

    assert with_retries(call, first_wait=0) == 7
    with pytest.raises(OSError, match="always"):
        with_retries(lambda: (_ for _ in ()).throw(OSError("always")), first_wait=0)


def test_model_order_and_cache(spark):
    def model(texts, kind):
        return [(i, [float(len(t))]) for i, t in reversed(list(enumerate(texts)))]

    embed = model_udf(model, batch=2)
    chunks = spark.createDataFrame([("h1", 0, "a"), ("h1", 1, "bbb"), ("h2", 0, "cc"), ("h2", 1, "a")], "content_hash string, chunk_index int, content string")
    none = spark.createDataFrame([], "content_hash string, model_id string, vector array<double>, created_at timestamp")
    out, new = embed_cached(chunks, none, "m", embed)
    assert {(r["content"], r["vector"][0]) for r in out.collect()} == {("a", 1.0), ("bbb", 3.0), ("cc", 2.0)}
    assert new.count() == 3 and out.count() == 4
    cache = new.persist()
    again, rest = embed_cached(chunks, cache, "m", embed)
    assert again.count() == 4 and rest.count() == 0
    assert embed_cached(chunks, cache, "other", embed)[1].count() == 3
    _, per_doc = embed_cached(chunks, none, "m", embed, per="document")
    assert {r["content_hash"]: r["vector"][0] for r in per_doc.collect()} == {"h1": 3.0, "h2": 1.0}


def test_evaluation(spark):
    cases = spark.createDataFrame([(0,), (1,)], "query_id long")
    res = spark.createDataFrame([(0, 1, "a"), (0, 2, "x"), (0, 3, "b")], "query_id long, rank int, document_id string")
    rel = spark.createDataFrame([(0, "a"), (0, "b"), (0, ""), (1, "q")], "query_id long, document_id string")
    got = E.evaluate_retrieval(cases, res, rel, 3).orderBy("query_id").collect()
    assert got[0][1:] == pytest.approx((1.0, 2 / 3, 1.0)) and got[1][1:] == (0.0, 0.0, 0.0)
    mean = E.evaluate_dataset(E.evaluate_retrieval(cases, res, rel, 3)).first()
    assert tuple(mean) == pytest.approx((2, 0.5, 1 / 3, 0.5))
    assert tuple(E.evaluate_dataset(E.evaluate_retrieval(cases.where("false"), res, rel, 3)).first()) == (0, 0.0, 0.0, 0.0)
    assert E.evaluate_retrieval(cases, res, rel, 0).where("query_id = 0").first()[1:3] == (0.0, 0.0)
    cited = spark.createDataFrame([(0, "a"), (0, "x")], "query_id long, document_id string")
    assert tuple(E.evaluate_citations(cases, cited, rel).where("query_id = 0").first())[1:] == (0.5, 0.5)
