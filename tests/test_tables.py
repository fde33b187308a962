"""Keyed tables: crashes between steps, other writers, compaction, clean-up."""

import json

import pytest
from pyspark.sql import functions as F

from docweave.operators import tables as K
from docweave.operators.vector_table import VectorTable
from docweave.storage import FileExists, Files


@pytest.fixture
def table(spark, tmp_path):
    return K.KeyedTable(spark, str(tmp_path / "t"), "k long, v string", ["k"])


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "k long, v string").coalesce(1)


def content(t, part=None):
    return sorted(map(tuple, t.read(part).collect()))


def test_upsert_and_delete(spark, table):
    assert content(table) == [] and table.version() == 0 and table.parts() == []
    table.upsert(rows(spark, (1, "a"), (2, "b"), (1, "last of its key")))
    table.upsert(rows(spark, (2, "B"), (3, "c"), (None, "no key")))
    got = {r["k"]: r["v"] for r in table.read().collect()}
    assert got == {1: "last of its key", 2: "B", 3: "c", None: "no key"}
    table.delete(rows(spark, (2, "any")).select("k"))
    table.delete(spark.createDataFrame([("c",), ("nothing",)], "v string"))
    assert {r["k"] for r in table.read().collect()} == {1, None}
    table.swap(rows(spark, (1, "x")).select("k"), rows(spark, (7, "new")))
    assert {r["k"]: r["v"] for r in table.read().collect()} == {None: "no key", 7: "new"}


def test_partitions_are_apart(spark, table):
    table.upsert(rows(spark, (1, "a")), "p")
    table.upsert(rows(spark, (1, "b")), "q")
    assert content(table, "p") == [(1, "a")] and content(table) == [(1, "a"), (1, "b")]
    before = table.state_of("p")
    table.delete(rows(spark, (1, "")).select("k"), "q")
    assert content(table, "q") == [] and table.state_of("p") == before and table.parts() == ["p", "q"]
    assert table.drop_part("q") and not table.drop_part("q") and table.parts() == ["p"]
    assert table.add_part("p", {"x": 1}) == {} and table.add_part("r", {"x": 1}) == {"x": 1} == table.add_part("r", {"x": 2})


class Died(Exception):
    pass


@pytest.mark.parametrize("step", ["_write", "write_new"])
def test_a_writer_that_dies_leaves_the_old_state(spark, table, monkeypatch, step):
    """Killed while it writes rows, after that and before its commit: readers and later writers see what was there."""
    table.upsert(rows(spark, (1, "a"), (2, "b")))

    def die(*args, **more):
        raise Died

    with monkeypatch.context() as m:
        m.setattr(*((table, step) if step == "_write" else (table.files, step)), die)
        with pytest.raises(Died):
            table.upsert(rows(spark, (1, "lost"), (3, "lost")))
        with pytest.raises(Died):
            table.replace(rows(spark, (4, "lost")))
    assert content(table) == [(1, "a"), (2, "b")]
    again = K.KeyedTable(spark, table.path, "k long, v string", ["k"])
    again.upsert(rows(spark, (3, "c")))
    assert content(table) == [(1, "a"), (2, "b"), (3, "c")]
    assert table.vacuum() == (2 if step == "write_new" else 0)  # rows that were never committed
    assert content(table) == [(1, "a"), (2, "b"), (3, "c")]


def test_a_half_written_commit_is_not_seen(spark, table, monkeypatch):
    """The commit is written under another name first; what is left of it changes nothing."""
    table.upsert(rows(spark, (1, "a")))
    table.files.write(f"{table.path}/log/.0123", b'{"": {"folders')
    assert content(table) == [(1, "a")] and table.version() == 1


def test_two_writers_lose_nothing(spark, table):
    """Another writer's commit comes between this one's reading and its commit."""
    table.upsert(rows(spark, (1, "a")))
    other = K.KeyedTable(spark, table.path, "k long, v string", ["k"])
    taken, state = [], table._state

    def read_then_lose():
        found = state()
        if not taken:
            taken.append(1)
            other.upsert(rows(spark, (1, "other"), (2, "other")))
        return found

    table._state = read_then_lose
    table.upsert(rows(spark, (3, "mine"), (2, "mine")))
    table._state = state
    assert content(table) == [(1, "other"), (2, "mine"), (3, "mine")] and table.version() == 3


def test_compaction_beside_other_writers(spark, table):
    for i in range(3):
        table.upsert(rows(spark, (i, "a"), (9, f"v{i}")))
    other = K.KeyedTable(spark, table.path, "k long, v string", ["k"])
    write = table._write

    def slowly(*args, **more):
        other.upsert(rows(spark, (0, "meanwhile")))
        return write(*args, **more)

    table._write = slowly
    table.compact()
    assert content(table) == [(0, "meanwhile"), (1, "a"), (2, "a"), (9, "v2")] and len(table._state()[1][""]["folders"]) == 2

    def replaced(*args, **more):
        other.replace(rows(spark, (5, "all new")))
        return write(*args, **more)

    table._write = replaced
    with pytest.raises(K.ConcurrentWrite):
        table.compact()
    assert content(table) == [(5, "all new")]


def test_compacts_by_itself_and_cleans_up(spark, tmp_path):
    t = K.KeyedTable(spark, str(tmp_path / "t"), "k long, v string", ["k"], most=3)
    for i in range(9):
        t.upsert(rows(spark, (i % 2, f"v{i}")))
    assert content(t) == [(0, "v8"), (1, "v7")] and len(t._state()[1][""]["folders"]) <= 4
    used = {f["name"] for f in t._state()[1][""]["folders"]}
    assert t.vacuum(older_ms=3_600_000) == 0 and t.vacuum() > 0
    assert {n for n in t.files.names(t.path) if n.startswith("v-")} == used and t._numbers() == [t.version()]
    t.delete(t.read().select("k"))
    t.compact()
    assert content(t) == [] and t.vacuum() > 0
    assert json.loads(t.files.read(t._at(t.version())))[""]["facts"] == {}


def test_new_files_never_replace(spark, tmp_path):
    files = Files(spark)
    files.write_new(str(tmp_path / "a"), b"1")
    with pytest.raises(FileExists):
        files.write_new(str(tmp_path / "a"), b"2")
    assert files.read(str(tmp_path / "a")) == b"1" and files.names(str(tmp_path)) == ["a"] and files.names(str(tmp_path / "none")) == []


def test_indexing_refuses_wrong_vectors(spark, tmp_path):
    """A model that gives vectors of another length than its collection fails before anything has changed."""
    from docweave.plans.engine import Engine, EngineConfig
    from docweave.streaming.ingest import as_raw

    engine = Engine(spark, EngineConfig(str(tmp_path / "b"), embedding_dimensions=3), embed=lambda t: F.array(F.lit(1.0), F.lit(2.0)))
    kb = engine.create_knowledge_base("k")["id"]
    docs = as_raw(spark.createDataFrame([(1, "some text")], "doc_id long, text string"), kb)
    with pytest.raises(Exception, match="have 3 dimensions"):
        engine.ingest_raw(docs, kb)
    assert engine.vectors.read(kb).count() == 0 and engine.indexer.registry.get_hash(kb, "doc://1") is None
    engine.indexer.embed = lambda t: F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))
    engine.indexer.cache.table.replace(engine.indexer.cache.read().where("false"))
    assert engine.ingest_raw(docs, kb).first()["chunk_count"] == 1
    assert engine.ingest_raw(docs.withColumn("content", F.lit("other text")), kb).first()["chunk_count"] == 1
    assert [r["content"] for r in engine.vectors.read(kb).collect()] == ["other text"]
    assert engine.indexer.vacuum() > 0 and engine.vectors.read(kb).count() == 1


def test_a_failure_between_chunks_and_hashes_is_made_good(spark, tmp_path, monkeypatch):
    """The next batch finds the source unchanged in no registry and indexes it again, to the same chunks."""
    from docweave.plans.engine import Engine, EngineConfig
    from docweave.streaming.ingest import as_raw

    engine = Engine(spark, EngineConfig(str(tmp_path / "b")))
    kb = engine.create_knowledge_base("k")["id"]
    docs = as_raw(spark.createDataFrame([(i, f"text of {i}") for i in range(3)], "doc_id long, text string"), kb)

    def die(*args):
        raise Died

    with monkeypatch.context() as m:
        m.setattr(engine.indexer.registry, "set_hashes", die)
        with pytest.raises(Died):
            engine.ingest_raw(docs, kb)
    assert engine.vectors.read(kb).count() == 3
    assert {r["skipped"] for r in engine.ingest_raw(docs, kb).collect()} == {False}
    assert engine.vectors.read(kb).count() == 3 and {r["skipped"] for r in engine.ingest_raw(docs, kb).collect()} == {True}


def test_collections(spark, tmp_path):
    t = VectorTable(spark, str(tmp_path / "c"))
    t.ensure_collection("a", 2)
    with pytest.raises(ValueError, match="has 2 dimensions"):
        t.ensure_collection("a", 3)
    assert t.has_collection("a") and t.read("a").count() == 0 and t.delete_by_source_uri("none", "u") == 0
