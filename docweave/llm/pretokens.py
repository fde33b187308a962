"""Splitting text into pre-tokens exactly as the tokenizer libraries do."""

from __future__ import annotations

import functools
import os
import sys
import unicodedata

import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


@functools.cache
def library(path: str):
    """The tokenizer of a .json file, one for each worker."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def _too_new(path: str) -> tuple[regex.Pattern | None, dict[int, str]]:
    """Characters that the regex module takes for letters or digits and the tokenizer library does not.

    The regex module knows a later Unicode version.  Only characters that are new can differ:
    those that Python's own (older) tables leave unassigned.  The library itself is asked about each.
    """
    letter, digit = regex.compile(r"\p{L}"), regex.compile(r"\p{N}")
    split = library(path).pre_tokenizer.pre_tokenize_str
    new = {}
    for code in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= code < 0xE000 or unicodedata.category(c := chr(code)) != "Cn":
            continue
        before = "a" if letter.match(c) else "1" if digit.match(c) else ""
        if before and len(split(before + c)) > 1:
            new[code] = "￿"  # unassigned for good: neither letter, digit nor space
    return (regex.compile("[" + "".join(map(chr, new)) + "]") if new else None), new


class Splitter:
    """Splits by ``pattern``; equal to the library's own split for each code point."""

    def __init__(self, pattern: str, tokenizer_json: str):
        self.find = regex.compile(pattern)
        self.path = tokenizer_json
        #: Scripts in wide use have had no letter since Unicode 15 below this; a text within needs no further look.
        self.rare = regex.compile(r"[԰-￿\U00010000-\U0010ffff]")

    def __call__(self, text: str) -> list[str]:
        if not text.isascii() and self.rare.search(text):
            odd, stand_in = _too_new(self.path)
            if odd is not None and odd.search(text):
                like = text.translate(stand_in)
                return [text[m.start() : m.end()] for m in self.find.finditer(like)]
        return self.find.findall(text)
