"""Token counts by a two-tier lookup on the map side.

Tier one is a broadcast hash table of the corpus's frequent pre-tokens and their lengths in tokens.
It is found from all texts: each task keeps a bounded heavy-hitter summary, and summaries (not
pre-tokens) are merged in a tree, so no shuffle carries pre-tokens.  Tier two is a cache in each
Python worker: what is in neither is encoded by the tokenizer library once and remembered.  The
table and the caches only save time; every length comes from the library.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows give repeated rows;
an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import functools
import pickle
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Memo, give_back, hold, map_rows, utf8
from .pretokens import Splitter, library

#: Entries of the broadcast table (a few hundred kB), of a task's summary while it counts, and of a worker's cache.
TABLE, SUMMARY, CACHE = 16_384, 65_536, 250_000
#: Longer pre-tokens aren't worth a place in a table or cache.
LONGEST = 64

_cache: dict[tuple[str, str], Memo] = {}


def _cut(counts: Counter, size: int) -> Counter:
    """The heavy hitters: the largest ``size`` counts, less the largest one dropped (as Misra and Gries subtract)."""
    if len(counts) <= size:
        return Counter({k: v for k, v in counts.items() if len(k) <= LONGEST})
    top = counts.most_common(size + 1)
    base = top[-1][1]
    return Counter({k: v - base for k, v in top[:-1] if v > base and len(k) <= LONGEST})


def _merged(a: Counter, b: Counter) -> Counter:
    return _cut(a + b, TABLE)


def frequent_pretokens(df: DataFrame, text: str, pattern: str, tokenizer_json: str) -> list[str]:
    """Up to TABLE pre-tokens that are frequent in all of df, by bounded summaries merged in a tree."""

    def make():
        split, seen = Splitter(pattern, tokenizer_json), Counter()

        def f(texts):
            nonlocal seen
            for t in texts:
                if t:
                    seen.update(split(t))
            if len(seen) > 2 * SUMMARY:
                seen = _cut(seen, SUMMARY)
            return ([],)

        f.finish = lambda: ([pickle.dumps(_cut(seen, TABLE))],)
        return f

    parts = map_rows(df, [text], "summary binary", make).rdd.map(lambda r: pickle.loads(r[0]))
    found = parts.treeAggregate(Counter(), _merged, _merged, depth=3)
    return [k for k, _ in found.most_common()]


def count_tokens(df: DataFrame, tokenizer_json: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row of df, as the library's encode(text, add_special_tokens=False) counts.

    Special strings inside a text are one token each, the library's default.
    """
    spark = df.sparkSession
    common = frequent_pretokens(df, text_col, pattern, tokenizer_json)
    lengths = [len(e.ids) for e in library(tokenizer_json).encode_batch(common, add_special_tokens=False)] if common else []
    table = spark.sparkContext.broadcast(dict(zip(common, lengths, strict=True)))

    def make():
        hold("token_counts", _cache.clear)
        tok = library(tokenizer_json)
        split, known = Splitter(pattern, tokenizer_json), table.value
        special = [x.content for x in tok.get_added_tokens_decoder().values()]
        cache = _cache.setdefault((tokenizer_json, pattern), Memo(CACHE))

        def pieces_of(text: str) -> tuple[int, list[str]]:
            """Special tokens in a text, and its pre-tokens."""
            found = [x for x in special if x in text]
            if not found:
                return 0, split(text)
            if len(found) > 1:  # which one wins is the library's affair
                return len(tok.encode(text, add_special_tokens=False)), []
            parts = text.split(found[0])
            return len(parts) - 1, [p for part in parts for p in split(part)]

        def f(ids, texts):
            counts, open_ = [], []
            for text in texts:
                total, rest = pieces_of(text) if text else (0, [])
                for tier in (known.get, cache.new.get, cache.get):
                    sizes = list(map(tier, rest))
                    if None not in sizes:
                        total, rest = total + sum(sizes), []
                        break
                    total += sum(n for n in sizes if n is not None)
                    rest = [p for p, n in zip(rest, sizes, strict=True) if n is None]
                counts.append(total)
                open_.append(rest)
            new = list(dict.fromkeys(p for rest in open_ for p in rest))
            own = dict(zip(new, map(len, tok.encode_batch_fast(new, add_special_tokens=False)), strict=True))
            for k, v in own.items():
                if len(k) <= LONGEST:
                    cache.put(k, v)
            counts = [n + sum(map(own.__getitem__, rest)) for n, rest in zip(counts, open_, strict=True)]
            return ids, [len(utf8(t)) for t in texts], counts, [n > limit for n in counts]

        return f

    kind = df.schema[id_col].dataType.simpleString()
    return map_rows(df, [id_col, text_col], f"{id_col} {kind}, n_bytes long, n_tokens long, over_limit boolean", make)


@functools.cache
def _ranks(path: str, pattern: str):
    """The vocabulary of a rank file, one for each worker."""
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def library_tokens(text: Column, ranks: str, pattern: str) -> Column:
    """The number of tokens of each text by a rank file, special strings as ordinary text; null texts have none.

    A column for operators that weigh rows by their tokens: the compiled library counts them in the pass that needs them.
    """

    @F.pandas_udf("long")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hold("library_tokens", _ranks.cache_clear)
        encode = _ranks(ranks, pattern).encode_ordinary
        for texts in parts:
            yield pd.Series([len(encode(t)) if t else 0 for t in texts], index=texts.index, dtype="int64")
        give_back()

    return count(text)
