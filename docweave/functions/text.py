"""Text functions as native column expressions.

White space means what Python calls white space, spelled out, since Java's ``\\s`` and ``\\w`` are ASCII.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Classes of characters.  Single Latin signs come first in one, plain letters in the other, since Java tries the parts of a class in turn.
WS = r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0  -     　"
NOT_WS = r"!-~\xa1-ᙿᚁ-῿​-‧‪-‮‰-⁞⁠-⿿、-\x{10ffff}\x00-\x08\x0e-\x1b\x7f-\x84\x86-\x9f"
WORD = r"[\p{L}\p{N}_]+"
#: The characters of WS.
_BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def let(value: Column, body) -> Column:
    """body(value), where value is computed once however often body uses it: inside lambdas Spark does not see common parts."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANKS))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(_BLANKS))


def is_blank(text: Column) -> Column:
    """No character but white space; the first other one ends the search."""
    return ~F.rlike(text, F.lit(f"[{NOT_WS}]"))


def drop_controls(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")


def universal_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def normalize_whitespace(text: Column) -> Column:
    """Blanks before a line end go, runs of blanks become one, more than one empty line becomes one, ends are stripped."""
    text = F.regexp_replace(text, r"[ \t]+\n", "\n")
    text = F.regexp_replace(text, r"[ \t]{2,}", " ")
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def content_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"([{NOT_WS}]++)"), 1)


def word_count(text: Column) -> Column:
    """The number of words, in one pass: each word is cut down to its first letter."""
    return F.length(F.regexp_replace(text, rf"[{WS}]*+([{NOT_WS}])[{NOT_WS}]*+|[{WS}]++", "$1"))


def token_estimate(text: Column) -> Column:
    """Words over 0.75, rounded; so at least 1 where there is a word."""
    return F.round(word_count(text) / F.lit(0.75)).cast("int")


def _parts(text: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(text, pattern, -1), strip), lambda x: x != "")


def paragraphs(text: Column) -> Column:
    return _parts(text, rf"\n[{WS}]*\n")


def sentences(text: Column) -> Column:
    return _parts(text, rf"(?<=[.!?])[{WS}]+")


def light_stem(word: Column) -> Column:
    """Plural endings off English words."""
    n = F.length(word)
    return (
        F.when(~F.endswith(word, F.lit("s")), word)  # most words, before any pattern is tried
        .when((n > 4) & F.endswith(word, F.lit("ies")), F.concat(F.substring(word, F.lit(1), n - 3), F.lit("y")))
        .when((n > 4) & F.rlike(word, F.lit(r"(xes|ches|shes|ses)\z")), F.substring(word, F.lit(1), n - 2))
        .when((n > 3) & F.endswith(word, F.lit("s")) & ~F.endswith(word, F.lit("ss")), F.substring(word, F.lit(1), n - 1))
        .otherwise(word)
    )


def tokenize(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), 1), light_stem)


def excerpt(text: Column, limit: int = 240) -> Column:
    text = strip(text)
    return F.when(F.length(text) > limit, F.concat(rstrip(F.substring(text, 1, limit)), F.lit("..."))).otherwise(text)


def hard_pieces(text: Column, size: int) -> Column:
    """Pieces of ``size`` characters, as they stand."""
    count = F.ceil(F.length(text) / size).cast("int")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(text, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def markdown_table(rows: Column) -> Column:
    """A Markdown table from array<array<string>>, the header first; rows are padded or cut to its width.  No rows: an empty text."""
    width = F.size(F.get(rows, F.lit(0)))

    def line(cells: Column) -> Column:
        return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

    body = F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: line(F.slice(F.concat(r, F.array_repeat(F.lit(""), width)), F.lit(1), width)))
    lines = F.concat(F.array(line(F.get(rows, F.lit(0))), line(F.array_repeat(F.lit("---"), width))), body)
    return F.when(F.size(rows) > 0, F.array_join(lines, "\n")).otherwise(F.lit(""))


def extension(uri: Column) -> Column:
    return F.lower(F.regexp_extract(uri, r"[^/\\](\.[^./\\]+)\z", 1))


def is_url(uri: Column) -> Column:
    return F.rlike(uri, F.lit(r"\A(?i:https?)://"))


def mime_of_header(header: Column) -> Column:
    """The MIME type of a Content-Type header."""
    return F.nullif(strip(F.split_part(header, F.lit(";"), F.lit(1))), F.lit(""))


def length_of_header(header: Column, body: Column) -> Column:
    """A Content-Length header if it is all digits, else the body's bytes."""
    return F.when(F.rlike(header, F.lit(r"\A[0-9]+\z")), header.cast("long")).otherwise(F.octet_length(body).cast("long"))


def http_date(header: Column) -> Column:
    """A Last-Modified header as a timestamp; null if it is none."""
    bare = F.regexp_replace(header, r"\A[A-Za-z]{3}, ", "")
    return F.try_to_timestamp(F.regexp_replace(bare, r" (GMT|UTC|\+0000)\z", ""), F.lit("d MMM yyyy HH:mm:ss"))
