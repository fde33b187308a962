"""Removal of long strings that occur more than once in a corpus, by a prefix-free parse.

The question is which positions start a string of ``length`` bytes that also starts elsewhere.  A rolling hash of
``WINDOW`` bytes sets triggers: position t is the trigger of all starts i for which the hash at t is the smallest
(the leftmost of equal ones) among those at i .. i + reach - 1.  So a trigger depends on the string at i
alone, each string holds one (a hash modulus could not promise that), and a text is parsed into
phrases, one for each trigger, at about 2 / reach of its length.

A string is then (the end of a phrase, up to its trigger) + (what the parse has from the trigger on), and the order of all strings follows from
two smaller ones, that of phrase ends and that of parse suffixes:

* the dictionary: the string right of a trigger that all its starts share gives a phrase its name.  A phrase whose name
  occurs once is done, no start of it repeats; nearly all of a clean text ends here.  The others are entries of the
  dictionary, each with its context (from the first start to the end of the last one's string); entries with equal contexts are one,
  and all starts of an entry that occurs more than once repeat.
* suffix arrays: the entries of one name are sorted by what they have left of the trigger, read backwards (phrase ends), and by what they
  have from the trigger on (parse suffixes); neighbours give the lengths of common parts.
* corpus order: entries that share the last d bytes before the trigger are an interval of the first array; put in the order of the second,
  they are the strings that begin d bytes before the trigger in the order of a suffix array of the corpus, and such a string
  occurs again if and only if it shares its other ``length`` - d bytes with a neighbour.  All intervals are visited once, from the
  tree that the common lengths span.

The entries of a name are sorted in one task only where they are ``GROUP`` at most.  A name with more (the edge of a passage that very many
texts share) is first split: starts are cut into blocks of 32, then 4, whose names are longer strings, and entries of a block's name are
sorted in turn; a block of one start is a string by itself, and only its number of occurrences is left to count.

A name is a hash of 64 bits where a clash only costs work, and of 128 bits where it decides.

Passages of a number of words are found by the same parse: each word is put as a code of ``CODE`` bytes, so ``words`` words are a string of fixed
length however short they are.  Only starts at a word count.

Defined results: null and empty texts have no bytes; texts shorter than ``length`` keep all; each row is a document, so
repeated rows remove each other's repeats; matches never cross documents; an empty table gives an empty table; other columns stay.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, give_back, hold, keep, map_rows, utf8

#: Bytes of the rolling hash, starts parsed at once, entries of a name that are sorted in one task, block sizes where a name has more.
WINDOW, CHUNK, GROUP, BLOCKS = 8, 1 << 22, 512, (32, 4, 1)
#: Bytes that stand for a word: a sign of its own, so that codes match at words only, and 42 bits of a hash.
CODE = 8
#: A word: what is between ASCII white space, without ASCII signs at its ends.
_WORD = re.compile(rb"[^\s!-/:-@\[-`{-~](?:\S*[^\s!-/:-@\[-`{-~])?")
_U = np.uint64


def reach(length: int) -> int:
    """Starts that compete for a trigger: a power of two, so far that a name of a third of the string remains."""
    if length < 24:
        raise ValueError("strings of 24 bytes or more")
    return 1 << ((length * 2 // 3).bit_length() - 1)


def text_key(text: Column) -> Column:
    """16 bytes that name a text; a null text is an empty one."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def phrases(data: bytes, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Triggers t with the first and last start that each has, as arrays, chunk by chunk."""
    starts, far = len(data) - length + 1, reach(length)
    for base in range(0, max(starts, 0), CHUNK):
        n = min(CHUNK, starts - base)
        raw = np.frombuffer(data, np.uint8, min(n + length - 1, n + far + WINDOW), base).astype(np.uint64)
        m = len(raw) - WINDOW + 1
        h = np.zeros(m, np.uint64)
        for k in range(WINDOW):
            h |= raw[k : k + m] << _U(8 * k)
        h *= _U(0x9E3779B97F4A7C15)
        h ^= h >> _U(32)
        h *= _U(0xD6E8FEB86659FD93)
        low = (h & _U(0xFFFFFFFF00000000)) | np.arange(m, dtype=np.uint64)
        span = 1
        while span < far:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        at = (low[:n] & _U(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        last = np.concatenate((first[1:] - 1, [n - 1]))
        yield at[first] + base, first + base, last + base


def _pair(digest: bytes) -> tuple[int, int]:
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _name(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data) - 2**63


def parse(df: DataFrame, length: int, text_col: str) -> DataFrame:
    """(key, t, lo, hi, core, h1, h2) of each phrase: its text, trigger, first and last start, name and context."""

    def make():
        hold("repeats")

        def f(texts):
            out: tuple[list, ...] = ([], [], [], [], [], [], [])
            for text in texts:
                data = utf8(text)
                if len(data) < length:
                    continue
                key = hashlib.md5(data).digest()
                for t, lo, hi in phrases(data, length):
                    t, lo, hi = t.tolist(), lo.tolist(), hi.tolist()
                    right = length - reach(length) + 1
                    hulls = [_pair(xxhash.xxh3_128_digest(data[a : b + length])) for a, b in zip(lo, hi, strict=True)]
                    for col, values in zip(out, ([key] * len(t), t, lo, hi, [_name(data[x : x + right]) for x in t], [h[0] for h in hulls], [h[1] for h in hulls]), strict=True):
                        col.extend(values)
            return out

        return f

    return map_rows(df, [text_col], "key binary, t long, lo long, hi long, core long, h1 long, h2 long", make)


_ENTRY = "key binary, t long, lo long, hi long, done boolean, core long, kinds long"


def _contexts(open_: DataFrame, df: DataFrame, length: int, text_col: str) -> DataFrame:
    """The entries open_ with ctx, the bytes from the first start to the end of the last one's string."""
    names = ["t", "lo", "hi", "done", "core", "kinds"]
    lists = open_.groupBy("key").agg(F.collect_list(F.struct(*names)).alias("p"))
    # One row for each text, joined by the key that it is already dealt by.
    texts = df.select(text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text")).groupBy("key").agg(F.first("text").alias("text"))

    def make():
        def f(keys, texts, many):
            out = []
            for key, text, items in zip(keys, texts, many, strict=True):
                data = utf8(text)
                out += [(key, *(p[n] for n in names), data[p["lo"] : p["hi"] + length]) for p in items]
            return list(zip(*out, strict=True)) if out else [[]] * 8

        return f

    return map_rows(texts.join(lists, "key"), ["key", "text", "p"], f"{_ENTRY}, ctx binary", make)


def common(a: bytes, b: bytes) -> int:
    """Bytes that two strings begin with alike."""
    n = min(len(a), len(b))
    odd = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (odd.bit_length() + 7) // 8


def _array(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """The order of strings, and how many bytes each has in common with the one before it in that order."""
    order = sorted(range(len(strings)), key=strings.__getitem__)
    return order, [0, *(common(strings[a], strings[b]) for a, b in zip(order, order[1:], strict=False))]


def intervals(shared: list[int]) -> Iterator[tuple[int, int, int, int]]:
    """(first, last, least, most) for each interval of two or more neighbours that share ``most`` bytes and with no other more than ``least`` - 1."""
    stack = [(0, -1)]  # first entry, bytes shared
    for at in range(1, len(shared) + 1):
        now = shared[at] if at < len(shared) else -1
        first = at - 1
        while stack[-1][1] > now:
            first, most = stack.pop()
            yield first, at - 1, max(stack[-1][1], now) + 1, most
        if stack[-1][1] < now:
            stack.append((first, now))


def sorted_starts(entries: list[tuple[int, int, int, bool, bytes]], length: int) -> list[tuple[int, int, int]]:
    """(entry, first start, last start) of strings that another entry holds too.

    entries: (t, lo, hi, done, ctx) of one name, with unlike contexts.  done: its starts are known to repeat, it only serves others.
    """
    lefts = [ctx[: t - lo][::-1] for t, lo, _, _, ctx in entries]
    rights = [ctx[t - lo :] for t, lo, _, _, ctx in entries]
    ends, shared = _array(lefts)
    suffixes, overlap = _array(rights)
    rank = [0] * len(entries)
    for place, x in enumerate(suffixes):
        rank[x] = place
    out = []
    for first, last, least, most in intervals(shared):
        members = sorted(ends[first : last + 1], key=rank.__getitem__)
        places = [rank[x] for x in members]
        near = [min(overlap[a + 1 : b + 1]) for a, b in zip(places, places[1:], strict=False)]
        for x, before, after in zip(members, [0, *near], [*near, 0], strict=True):
            t, lo, hi, done, _ = entries[x]
            # depths: bytes before the trigger
            a, b = max(least, length - max(before, after), t - hi), min(most, t - lo)
            if a <= b and not done:
                out.append((x, t - b, t - a))
    return out


def _sorted(entries: DataFrame, length: int) -> DataFrame:
    """(key, lo, hi) of starts that repeat among entries of names with at most ``GROUP`` entries each."""
    groups = entries.groupBy("core").agg(F.collect_list(F.struct("key", "t", "lo", "hi", "done", "ctx")).alias("m"))

    def make():
        def f(many):
            out = []
            for m in many:
                out += [(m[x]["key"], lo, hi) for x, lo, hi in sorted_starts([(e["t"], e["lo"], e["hi"], e["done"], e["ctx"]) for e in m], length)]
            return list(zip(*out, strict=True)) if out else [[]] * 3

        return f

    return map_rows(groups, ["m"], "key binary, lo long, hi long", make)


def _blocks(contexts: DataFrame, length: int, block: int) -> DataFrame:
    """Cut the starts of each entry into blocks, at multiples of ``block`` counted from the trigger; a block's trigger is its start next to that."""

    def make():
        def f(keys, ts, los, his, dones, ctxs):
            out = []
            for key, t, lo, hi, done, ctx in zip(keys, ts, los, his, dones, ctxs, strict=True):
                for j in range((t - hi) // block, (t - lo) // block + 1):
                    a, b = max(lo, t - block * j - block + 1), min(hi, t - block * j)
                    near = t - block * j
                    core = _name(ctx[near - lo : near - lo + length - block + 1])
                    sub = ctx[a - lo : b - lo + length]
                    out.append((key, near, a, b, done, core, *_pair(xxhash.xxh3_128_digest(sub)), sub))
            return list(zip(*out, strict=True)) if out else [[]] * 9

        return f

    return map_rows(contexts, ["key", "t", "lo", "hi", "done", "ctx"], "key binary, t long, lo long, hi long, done boolean, core long, h1 long, h2 long, ctx binary", make)


def repeated_starts(df: DataFrame, length: int, text_col: str = "text") -> list[DataFrame]:
    """Tables (key, lo, hi), kept: starts lo .. hi of the text with this key begin strings that also begin elsewhere.  Ranges may come twice."""
    every = parse(df, length, text_col)
    # Names are kept as a table of their own, so that in the join Spark can split one that very many phrases share.
    names = keep(every.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core"))
    live = keep(every.join(names, "core"))
    contexts = keep(live.groupBy("core", "h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("key", "t", "lo", "hi")).alias("p")))
    twice = keep(contexts.where("n > 1").select("h1", "h2").distinct())
    found = [keep(live.join(twice, ["h1", "h2"], "left_semi").select("key", "lo", "hi").distinct())]
    discard(live, names, twice, shuffles=True)
    mixed = keep(contexts.groupBy("core").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds > 1 and least = 1").select("core", "kinds"))
    open_ = keep(contexts.join(mixed, "core").select("p.*", (F.col("n") > 1).alias("done"), "core", "kinds"))
    discard(contexts, mixed, shuffles=True)
    entries = keep(_contexts(open_, df, length, text_col))
    discard(open_, shuffles=True)
    found.append(keep(_sorted(entries.where(F.col("kinds") <= GROUP), length)))
    for block in (b for b in BLOCKS if 2 * b <= length):
        many = entries.where(F.col("kinds") > GROUP)
        if many.isEmpty():
            break
        cut = keep(_blocks(many, length, block))
        discard(entries, shuffles=True)
        slim = cut.drop("ctx")
        names = keep(slim.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core"))
        some = keep(slim.join(names, "core"))
        kinds = keep(some.groupBy("core", "h1", "h2").agg(F.count("*").alias("n"), F.max("done").alias("any"), F.min(F.struct("key", "t", "lo", "hi")).alias("p")))
        twice = keep(kinds.where("n > 1").select("h1", "h2").distinct())
        found.append(keep(some.where("not done").join(twice, ["h1", "h2"], "left_semi").select("key", "lo", "hi")))
        discard(some, names, twice)
        settled = F.col("any") | (F.col("n") > 1)
        mixed = keep(kinds.groupBy("core").agg(F.count("*").alias("kinds"), F.min(settled).alias("all")).where("kinds > 1 and not all").select("core", "kinds"))
        rest = kinds.join(mixed, "core").select("p.key", "p.t", "p.lo", "p.hi", settled.alias("settled"), "kinds")
        # A block of one start has one kind, so after the last size nothing is left.
        entries = keep(cut.drop("done").join(rest, ["key", "t", "lo", "hi"]).select("key", "t", "lo", "hi", F.col("settled").alias("done"), "core", "kinds", "ctx"))
        discard(cut, kinds, mixed, shuffles=True)
        found.append(keep(_sorted(entries.where(F.col("kinds") <= GROUP), length)))
    discard(entries)
    return found


#: A range of starts as one long.
_SHIFT = 32


def spans(ranges, length: int) -> list[tuple[int, int]]:
    """Maximal runs [a, b) of bytes that are covered by strings starting in the given ranges (each first << 32 | last)."""
    out: list[list[int]] = []
    for r in sorted(ranges):
        lo, end = r >> _SHIFT, (r & 0xFFFFFFFF) + length
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([lo, end])
    return [(a, b) for a, b in out]


def coded(data: bytes) -> str:
    """The words of a text as codes of ``CODE`` characters, one after the other."""
    return "".join("." + base64.b64encode(xxhash.xxh3_64_digest(w)[:6])[: CODE - 1].decode() for w in _WORD.findall(data))


def word_spans(data: bytes, ranges, words: int) -> list[tuple[int, int]]:
    """Runs [a, b) of bytes from the first to the last word of passages whose codes start in the given ranges."""
    at = [m.span() for m in _WORD.finditer(data)]
    found = ((-(-(r >> _SHIFT) // CODE), (r & 0xFFFFFFFF) // CODE) for r in ranges)
    return [(at[lo][0], at[hi + words - 1][1]) for lo, hi in found if lo <= hi]


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of bytes that some of the given runs cover."""
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def kept_bytes(data: bytes, removed: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for a, b in removed:
        parts.append(data[at:a])
        at = b
    parts.append(data[at:])
    return b"".join(parts)


def _ranges(df: DataFrame, length: int, text_col: str, key: str, out: str) -> DataFrame:
    """(key, out) of texts with repeats: the start ranges, each first << 32 | last."""
    first, *rest = repeated_starts(df, length, text_col)
    for x in rest:
        first = first.unionByName(x)
    packed = first.select(F.col("key").alias(key), F.shiftleft("lo", _SHIFT).bitwiseOR(F.col("hi")).alias("r"))
    return packed.groupBy(key).agg(F.collect_set("r").alias(out))


def with_repeats(df: DataFrame, length: int = 400, text_col: str = "text", out_col: str = "__repeats", words: int | None = None) -> DataFrame:
    """df with a column of start ranges (array<long>, each first << 32 | last; null where nothing repeats).

    With ``words`` also ``out_col``_words, ranges of the coded text for passages of so many words.
    """
    key = f"{out_col}_key"
    ranges = _ranges(df, length, text_col, key, out_col)
    if words:
        ranges = ranges.join(_word_ranges(df, words, text_col, key, f"{out_col}_words"), key, "full")
    # Kept, so that in the join Spark can split a text that very many rows share.
    ranges = keep(ranges)
    keyed = df.withColumn(f"{out_col}_own", text_key(F.col(text_col)))
    return keyed.join(ranges, F.col(f"{out_col}_own") == F.col(key), "left").drop(f"{out_col}_own", key)


def _word_ranges(df: DataFrame, words: int, text_col: str, key: str, out: str) -> DataFrame:
    """(key, out) of texts with passages of so many words that occur again: the start ranges in the coded text."""

    def make():
        hold("repeats")

        def f(texts):
            rows = [(hashlib.md5(data).digest(), code) for data in map(utf8, texts) if len(code := coded(data)) >= words * CODE]
            return list(zip(*rows, strict=True)) if rows else [[]] * 2

        return f

    codes = keep(map_rows(df, [text_col], "own binary, code string", make))
    ranges = _ranges(codes, words * CODE, "code", "code_key", out)
    owners = codes.select(F.col("own").alias(key), text_key(F.col("code")).alias("code_key")).distinct()
    found = keep(owners.join(ranges, "code_key").select(key, out))
    discard(codes, shuffles=True)
    return found


def digest(df: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of each row."""

    def make():
        def f(ids, texts, ranges):
            sizes, removed, runs, digests = [], [], [], []
            for text, r in zip(texts, ranges, strict=True):
                data, out = utf8(text), spans(r or (), length)
                sizes.append(len(data))
                removed.append(sum(b - a for a, b in out))
                runs.append(len(out))
                digests.append(hashlib.sha256(kept_bytes(data, out)).hexdigest())
            return ids, sizes, removed, runs, digests

        return f

    kind = df.schema[id_col].dataType.simpleString()
    slim = df.select(F.col(id_col), F.col(text_col))
    return map_rows(with_repeats(slim, length, text_col), [id_col, text_col, "__repeats"], f"{id_col} {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string", make)


def without_repeats(df: DataFrame, length: int = 400, text_col: str = "text", words: int | None = None) -> DataFrame:
    """df with repeats cut out of its text; characters that a cut has split are dropped.

    With ``words``, passages of so many words or more that occur again go as well, however few bytes they have.
    """

    def cut_one(text: str | None, r: np.ndarray | None, w: np.ndarray | None) -> str | None:
        if text is None or (r is None and w is None):
            return text
        data = utf8(text)
        runs = spans(r.tolist(), length) if r is not None else []
        if w is not None:
            runs = merged(runs + word_spans(data, w.tolist(), words))
        return kept_bytes(data, runs).decode("utf-8", "ignore")

    @F.pandas_udf("string")
    def cut(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        hold("repeats")
        for texts, ranges, word_ranges in parts:
            yield pd.Series([cut_one(*x) for x in zip(texts, ranges, word_ranges, strict=True)], dtype=object)
        give_back()

    # A filter on the text that is pushed below would cut each text twice, in two workers for each task.
    cut = cut.asNondeterministic()
    # The row travels as one column, whatever its columns are called.
    rows = df.select(F.struct("*").alias("__row"), F.col(text_col).alias("__text"))
    marked = with_repeats(rows, length, "__text", words=words)
    by_words = F.col("__repeats_words") if words else F.lit(None).cast("array<long>")
    left = cut(F.col("__text"), F.col("__repeats"), by_words)
    return marked.select(*(left.alias(c) if c == text_col else F.col("__row").getField(c).alias(c) for c in df.columns))
