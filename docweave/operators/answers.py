"""Citations, prompts, generation and server-sent events."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import excerpt
from ..schema import EXCERPT, SYSTEM_PROMPT
from .embed import with_retries

#: A generator: system prompt and user message to (text, is_final) pieces.
Generator = Callable[[str, str], Iterator[tuple[str, bool]]]


def citations(results: DataFrame, limit: int = EXCERPT) -> DataFrame:
    """(query_id, rank, chunk_id, document_id, source_uri, title, excerpt, score): one citation for each result; the rerank score counts where there is one."""
    score = F.coalesce("rerank_score", "score") if "rerank_score" in results.columns else F.col("score")
    return results.select("query_id", "rank", "chunk_id", "document_id", "source_uri", "title", excerpt(F.col("content"), limit).alias("excerpt"), score.alias("score"))


def context_blocks(results: DataFrame) -> DataFrame:
    """(query_id, context): numbered sources with their texts.  A query has at most the k results it asked for."""
    parts = F.array_sort(F.collect_list(F.struct("rank", "source_uri", "content")))
    text = F.transform("__p", lambda r, i: F.concat(F.lit("[Source "), (i + 1).cast("string"), F.lit(": "), r["source_uri"], F.lit("]\n"), r["content"]))
    return results.groupBy("query_id").agg(parts.alias("__p")).select("query_id", F.array_join(text, "\n\n").alias("context"))


def system_message(prompt: Column) -> Column:
    return F.coalesce(F.nullif(prompt, F.lit("")), F.lit(SYSTEM_PROMPT))


def user_message(context: Column, question: Column) -> Column:
    return F.concat(F.lit("Context:\n"), F.coalesce(context, F.lit("")), F.lit("\n\nQuestion: "), question)


def prompts(queries: DataFrame, results: DataFrame, system_prompt: str | None = None) -> DataFrame:
    """(query_id, system, user) for each query, those without results too."""
    joined = queries.join(context_blocks(results), "query_id", "left")
    return joined.select("query_id", system_message(F.lit(system_prompt).cast("string")).alias("system"), user_message(F.col("context"), F.col("text")).alias("user"))


def events(pieces: DataFrame, cited: DataFrame) -> DataFrame:
    """(query_id, seq, text, is_final, citations) from pieces (query_id, seq, text, is_final): pieces with text or the final one; citations come with the final one only."""
    fields = F.struct("rank", "chunk_id", "document_id", "source_uri", "title", "excerpt", "score")
    lists = cited.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(fields)), lambda c: c.dropFields("rank")).alias("__c"))
    joined = pieces.where((F.col("text") != "") | F.col("is_final")).join(lists, "query_id", "left")
    none = F.slice("__c", 1, 0)
    return joined.select("query_id", "seq", "text", "is_final", F.when(F.col("is_final"), F.col("__c")).otherwise(none).alias("citations"))


def sse(event_rows: DataFrame) -> DataFrame:
    """(query_id, seq, event): each event as server-sent text."""
    body = F.to_json(F.struct("text", "is_final", F.coalesce("citations", F.array().cast(event_rows.schema["citations"].dataType)).alias("citations")), {"ignoreNullFields": "false"})
    return event_rows.select("query_id", "seq", F.concat(F.lit("data: "), body, F.lit("\n\n")).alias("event"))


def extractive_pieces(results: DataFrame) -> DataFrame:
    """An offline stand-in for a language model: the first result's excerpt, word by word, then an empty final piece."""
    first = results.where("rank = 1").select("query_id", F.split(excerpt(F.col("content")), " ").alias("w"))
    all_ = F.concat(F.transform("w", lambda x: F.struct(F.concat(x, F.lit(" ")).alias("text"), F.lit(False).alias("is_final"))), F.array(F.struct(F.lit("").alias("text"), F.lit(True).alias("is_final"))))
    return first.select("query_id", F.posexplode(all_).alias("seq", "p")).select("query_id", "seq", "p.text", "p.is_final")


def stream_generate(generator: Generator, system: str, user: str, cited: list[dict], first_wait: float = 1.0) -> Iterator[dict]:
    """Answer pieces from a model on the driver, one query at a time; starting it is tried three times."""
    for text, final in with_retries(lambda: generator(system, user), first_wait=first_wait):
        if text or final:
            yield {"text": text, "is_final": final, "citations": cited if final else []}


def json_rows(df: DataFrame) -> DataFrame:
    """(body): each row as a JSON object, null fields included."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("body"))
