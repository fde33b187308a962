"""Chunkers: tables of chunks from tables of documents.

Each folds an array of text units with ``aggregate`` and explodes the result, so a chunker is a
projection: no shuffle, no Python, and a document never leaves its row.
"""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vectors import hashed_embeddings, previous_cosines
from ..schema import CHUNK_OVERLAP, CHUNK_TOKENS, SEMANTIC_THRESHOLD

_UNIT = "array<struct<t:string,solo:boolean,n:int>>"
_TEXTS = "array<string>"


def _unit(text: Column, n: Column | None = None) -> Column:
    """A unit of so many tokens; without n one that is a chunk of its own, whose size doesn't matter."""
    return F.struct(text.alias("t"), F.lit(n is None).alias("solo"), (F.lit(0) if n is None else n).alias("n"))


def _hard(text: Column, size: int) -> Column:
    return F.transform(T.hard_pieces(text, 3 * size), lambda piece: _unit(piece))


def _units(text: Column, size: int) -> Column:
    """Paragraphs; one over the budget becomes its sentences (each a chunk of its own), a sentence over it fixed pieces."""

    def of_sentence(s: Column) -> Column:
        return F.when(T.token_estimate(s) > size, _hard(s, size)).otherwise(F.array(_unit(s)))

    def of_parts(p: Column, parts: Column) -> Column:
        return F.when(F.size(parts) > 1, F.flatten(F.transform(parts, of_sentence))).otherwise(_hard(p, size))

    def of_paragraph(p: Column) -> Column:
        return T.let(T.token_estimate(p), lambda n: F.when(n > size, T.let(T.sentences(p), lambda parts: of_parts(p, parts))).otherwise(F.array(_unit(p, n))))

    return F.flatten(F.transform(T.paragraphs(text), of_paragraph)).cast(_UNIT)


def packed(text: Column, size: int = CHUNK_TOKENS, overlap: int = CHUNK_OVERLAP) -> Column:
    """Chunk texts of the recursive chunker, in order, blank ones included (they count in the numbering).

    Units are joined while their token estimates fit; the next chunk then begins with the last ``overlap`` words of
    the one before, whatever that adds.  The fold joins the units of a chunk once, where it ends; units that are chunks of their own, and a
    single one, need none.
    """
    none = F.array().cast(_TEXTS)
    start = F.struct(none.alias("out"), none.alias("cur"), F.lit(0).alias("n"))

    def state(out: Column, cur: Column, n: Column) -> Column:
        return F.struct(out.alias("out"), cur.alias("cur"), n.cast("int").alias("n"))

    def flushed(s: Column) -> Column:
        return F.when(F.size(s["cur"]) > 0, F.array_append(s["out"], F.array_join(s["cur"], " "))).otherwise(s["out"])

    def tail_of(text: Column) -> Column:
        """The last words; fewer than ``overlap`` are the whole text's."""
        if overlap <= 0:
            return none
        return T.let(T.words(text), lambda w: F.slice(w, F.greatest(F.size(w) - overlap, F.lit(0)) + 1, F.lit(overlap)))

    def turned(s: Column, u: Column) -> Column:
        def begun(joined: Column, tail: Column) -> Column:
            carried = F.when(F.size(tail) > 0, F.array(F.array_join(tail, " "), u["t"])).otherwise(F.array(u["t"]))
            return state(F.array_append(s["out"], joined), carried, F.round(F.size(tail) / F.lit(0.75)) + u["n"])

        return T.let(F.array_join(s["cur"], " "), lambda joined: T.let(tail_of(joined), lambda tail: begun(joined, tail)))

    def step(s: Column, u: Column) -> Column:
        alone = state(F.array_append(flushed(s), u["t"]), none, F.lit(0))
        added = state(s["out"], F.array_append(s["cur"], u["t"]), s["n"] + u["n"])
        return F.when(u["solo"], alone).when((s["n"] + u["n"] > size) & (F.size(s["cur"]) > 0), turned(s, u)).otherwise(added)

    apart = lambda units: (F.size(units) <= 1) | F.forall(units, lambda u: u["solo"])
    return T.let(_units(text, size), lambda units: F.when(apart(units), F.transform(units, lambda u: u["t"])).otherwise(F.aggregate(units, start, step, flushed)))


def _exploded(df: DataFrame, chunks: Column, content: str) -> DataFrame:
    """One row for each chunk that isn't blank; indexes count blank ones too."""
    # The outer form: for the plain one Spark would add a filter that computes all chunks a second time.
    rows = df.select("*", F.posexplode_outer(chunks).alias("chunk_index", "__chunk"))
    return rows.where(~T.is_blank(F.col("__chunk"))).drop(content).withColumnRenamed("__chunk", "content").withColumn("token_count", T.token_estimate(F.col("content")))


def chunk_recursive(df: DataFrame, size: int = CHUNK_TOKENS, overlap: int = CHUNK_OVERLAP, content: str = "content") -> DataFrame:
    """df with a row for each chunk: chunk_index, content, token_count instead of the document's content."""
    return _exploded(df, packed(F.col(content), size, overlap), content)


def sections(text: Column) -> Column:
    """Texts of the parts between Markdown headings, each with its heading as first line; the whole text if there is none."""
    cut = "\x01"
    marked = F.regexp_replace(text, rf"(?md)^(#{{1,6}})[{T.WS}]+(.*)$", f"{cut}$2{cut}")
    found = F.split(marked, cut, -1)
    # found is preamble, heading, body, heading, body, ...
    pairs = F.transform(
        F.sequence(F.lit(1), F.size(found) - 2, F.lit(2)),
        lambda i: F.when(T.strip(F.get(found, i)) != "", F.concat(T.strip(F.get(found, i)), F.lit("\n"), T.strip(F.get(found, i + 1)))).otherwise(T.strip(F.get(found, i + 1))),
    )
    all_ = F.concat(F.array(T.strip(F.get(found, F.lit(0)))), pairs)
    return F.when(F.size(found) < 3, F.array(text)).otherwise(F.filter(all_, lambda s: T.strip(s) != ""))


def chunk_structural(df: DataFrame, size: int = CHUNK_TOKENS, overlap: int = CHUNK_OVERLAP, content: str = "content") -> DataFrame:
    """Sections that fit are chunks; others go through the recursive chunker.  Indexes run through the document without gaps."""
    whole = lambda s: F.when(T.token_estimate(s) <= size, F.array(s)).otherwise(F.filter(packed(s, size, overlap), lambda c: T.strip(c) != ""))
    return _exploded(df, F.filter(F.flatten(F.transform(sections(F.col(content)), whole)), lambda c: T.strip(c) != ""), content)


@functools.cache
def _ends(threshold: float, size: int):
    def one(cosines: list, counts: list) -> list:
        out: list[dict] = []
        for at, (cosine, n) in enumerate(zip(cosines, counts, strict=True)):
            if out and cosine is not None and round(cosine, 9) >= threshold and out[-1]["n"] + n <= size:
                out[-1]["last"], out[-1]["n"] = at + 1, out[-1]["n"] + n
            else:
                out.append({"first": at, "last": at + 1, "n": n})
        return out

    kind = "array<struct<first:int,last:int,n:int>>"

    @F.arrow_udf(kind)
    def ends(cosines: pa.Array, counts: pa.Array) -> pa.Array:
        """Runs of sentences: each joins the run before it while it is near and the run fits."""
        rows = [v and one(v, n) if v is None or n is not None else None for v, n in zip(cosines.to_pylist(), counts.to_pylist(), strict=True)]
        return pa.array(rows, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("n", pa.int32())])))

    return ends


def chunk_semantic(df: DataFrame, threshold: float = SEMANTIC_THRESHOLD, size: int = CHUNK_TOKENS, content: str = "content", embed=None) -> DataFrame:
    """Sentences join the chunk of the one before while their vectors are alike and the estimates fit.

    embed: a function from a column of array<string> (sentences) to one of array<array<double>>; the stand-in hashes tokens.
    """
    embed = embed or (lambda s: hashed_embeddings(F.transform(s, T.tokenize), 64))
    rows = df.withColumn("__s", T.sentences(F.col(content)))
    rows = rows.withColumn("__v", previous_cosines(embed(F.col("__s"))))
    s = F.col("__s")
    # Where chunks end; their texts are joined afterwards, each once.
    rows = rows.withColumn("__c", _ends(float(threshold), size)("__v", F.transform(s, T.token_estimate))).drop("__v")
    # Texts are joined in the document's row, so that no chunk carries all its sentences along.
    text = lambda c: F.array_join(F.slice(s, c["first"] + 1, c["last"] - c["first"]), " ")
    chunks = F.transform("__c", lambda c: F.struct(text(c).alias("t"), c["n"].alias("n")))
    rows = rows.withColumn("__x", chunks).drop(content, "__s", "__c")
    rows = rows.select(*(c for c in rows.columns if c != "__x"), F.posexplode_outer("__x").alias("chunk_index", "__x")).where(F.col("__x").isNotNull())
    return rows.withColumn("content", F.col("__x.t")).withColumn("token_count", F.col("__x.n")).drop("__x")
