"""Kept tables, worker caches and batch bounds."""

import os

from docweave.llm import common, near_dedup, repeats


def test_memo_is_bounded():
    memo = common.Memo(10)
    for i in range(100):
        memo.put(i, -i)
        assert memo.get(0) in (0, None)
    assert len(memo.new) + len(memo.old) <= 10 and memo.get(99) == -99 and memo.get(1) is None
    memo.clear()
    assert memo.get(99) is None


def test_one_operator_holds_caches():
    dropped = []
    common.hold("a", lambda: dropped.append("a"))
    common.hold("a", lambda: dropped.append("a"))
    common.hold("b", lambda: dropped.append("b"))
    common.hold("c", lambda: None)
    assert dropped == ["a", "b"]


def test_kept_tables(spark):
    df = spark.range(5).selectExpr("id", "array(id) as v")
    kept = common.keep(df)
    path = kept._kept_at.removeprefix("file:")
    path = "/" + path.lstrip("/")
    assert sorted(r.id for r in kept.collect()) == list(range(5)) and os.path.isdir(path)
    common.discard(kept, shuffles=True)
    assert not os.path.isdir(path)
    other = common.keep(df)
    common.forget(spark)
    assert not os.path.isdir("/" + other._kept_at.removeprefix("file:").lstrip("/"))


def test_batches_are_bounded(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    common.small_batches(spark)
    assert int(spark.conf.get(name).rstrip("b")) <= common.BATCH_BYTES
    spark.conf.set(name, "1000")
    common.small_batches(spark)
    assert spark.conf.get(name).rstrip("b") == "1000"
    spark.conf.unset(name)


def test_map_rows(spark):
    """Fewer and more rows than came in, last rows at the end, and no rows at all."""

    def make():
        seen = []

        def f(ids):
            seen.extend(ids)
            return ([i for i in ids for _ in range(i % 3)],)

        f.finish = lambda: ([-len(seen)],)
        return f

    got = [r[0] for r in common.map_rows(spark.range(0, 300, 1, 1), ["id"], "x long", make).collect()]
    assert got == [i for i in range(300) for _ in range(i % 3)] + [-300]


def test_sought_drops_only_rows_without_partner(spark, monkeypatch):
    """With a large bitmap nearly all others go, with a full one they may stay; null keys and no keys at all."""
    rows = spark.range(0, 5000, 1, 3).selectExpr("if(id % 500 = 1, null, id) as a", "cast(id as string) as b", "id as __map")
    keys = rows.where("__map % 7 = 0 or a is null").select("a", "b")
    wanted = {r["__map"] for r in rows.where("__map % 7 = 0 or a is null").collect()}
    for bits, most in ((common.BITS, 5), (1 << 20, 20), (64, 5000)):
        monkeypatch.setattr(common, "BITS", bits)
        got = common.sought(rows, keys, "a", "b")
        found = [r["__map"] for r in got.collect()]
        assert got.columns == rows.columns and len(found) == len(set(found)) and wanted <= set(found) and len(set(found) - wanted) <= most
    assert common.sought(rows, keys.limit(0), "a", "b").isEmpty()


def test_small_table(spark):
    rows, schema = [("a", 1, None), (None, -(1 << 40), 0.5)], "k string, n long, x double"
    got = common.small_table(spark, rows, schema)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(rows, key=str) and got.schema == spark.createDataFrame(rows, schema).schema
    assert common.small_table(spark, [], schema).collect() == []


def test_repeats_drop_the_caches_of_other_operators(monkeypatch):
    monkeypatch.setattr(repeats, "map_rows", lambda df, columns, schema, make: make)
    common.hold("near_dedup", near_dedup._words.clear)
    near_dedup._words.put(b"word", 1)
    repeats.parse(None, 400, "text")()
    assert near_dedup._words.get(b"word") is None
