"""Byte-level BPE by backtracking over longest matches, in time linear in the text.

Bytes are mapped to Latin-1 characters, so that an Aho-Corasick automaton over the vocabulary can
scan them.  For each position the automaton gives the longest token that starts there.  A left to
right walk takes the longest one; a token may follow another only if BPE, given the two tokens'
bytes, would keep the boundary between them.  That test needs only the two tokens, so its answers
are remembered.  Where no token fits, the walk drops the last token, marks the position as a dead
end (each position at most once, hence linear time) and tries the next shorter one.

Defined results: a null or empty text has no tokens; repeated rows give repeated rows; an empty
table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import struct

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame

from .common import Memo, hold, map_rows, utf8
from .pretokens import Splitter

#: Pre-tokens that a worker remembers, pairs of tokens whose fit it remembers, and the longest remembered pre-token.
CACHE, PAIRS, LONGEST = 250_000, 200_000, 64
#: No token.
_none = -1


class ByteBPE:
    """Encoder and decoder for a rank file: id = rank, and a token of two parts ranks after both."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.ranks = ranks
        self.ids = len(ranks)
        self.bytes = [b for b, _ in sorted(ranks.items(), key=lambda x: x[1])]
        if sorted(ranks.values()) != list(range(self.ids)):
            raise ValueError("ranks run from 0 without gaps")
        self.size = [len(b) for b in self.bytes]
        self.scan = ahocorasick.Automaton()
        for b, i in ranks.items():
            self.scan.add_word(b.decode("latin-1"), i)
        self.scan.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.memo = Memo(CACHE)
        #: The longest token that is a proper prefix of a token; -1: none.
        self.shorter = [_none] * self.ids
        for i, b in enumerate(self.bytes):
            cut = len(b) - 1
            while cut > 0 and b[:cut] not in ranks:
                cut -= 1
            self.shorter[i] = ranks[b[:cut]] if cut > 0 else _none
        #: The two tokens whose merge makes a token, and the merge made by two tokens.  A single byte is its own parts.
        self.parts: dict[int, tuple[int, int]] = {}
        self.merge: dict[tuple[int, int], int] = {}
        for i, b in enumerate(self.bytes):  # by rank: parts come before what they make
            self.parts[i] = (i, i)
            left = self.shorter[i]
            while left != _none:
                right = ranks.get(b[self.size[left] :])
                if right is not None and left < i and right < i and self._keeps(left, right):
                    self.parts[i] = (left, right)
                    self.merge[left, right] = i
                    break
                left = self.shorter[left]
            if len(b) > 1 and self.parts[i] == (i, i):
                raise ValueError(f"no merges of lower rank make token {i}")

    def _keeps(self, a: int, b: int) -> bool:
        """True if BPE leaves the boundary between adjacent tokens a and b alone.

        Merges are undone from the last: the larger of the two ids was made later.  At each moment the
        tokens that touch the boundary are (a, b); a merge of both is wrong only if its rank comes before
        the merge which took one of them away.
        """
        before = 1 << 40
        while True:
            made = self.merge.get((a, b))
            if made is not None and made < before:
                return False
            # Undo the later merge (of equal ones the right); a single byte has none left.
            left, right = self.parts[a][1], self.parts[b][0]
            if left != a and (a > b or right == b):
                before, a = a, left
            elif right != b:
                before, b = b + 1, right
            else:
                return True

    def _fits(self, pair: int) -> bool:
        """``_keeps`` for a pair that isn't remembered, packed as a * ids + b."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        found = self.pairs[pair] = self._keeps(*divmod(pair, self.ids))
        return found

    def encode_piece(self, data: bytes) -> list[int]:
        """Ids of one pre-token's bytes."""
        whole = self.ranks.get(data)
        if whole is not None or not data:
            return [whole] if data else []
        n, size, ids, pairs, shorter = len(data), self.size, self.ids, self.pairs, self.shorter
        longest = [_none] * n
        for end, i in self.scan.iter(data.decode("latin-1")):
            longest[end + 1 - size[i]] = i  # ends come in order, so the last one from a start is the longest
        out: list[int] = []
        dead = bytearray(n + 1)
        at, now, base = 0, longest[0], _none
        while at < n:
            while now != _none:
                if not dead[at + size[now]]:
                    if base < 0:
                        break
                    ok = pairs.get(base + now)
                    if self._fits(base + now) if ok is None else ok:
                        break
                now = shorter[now]
            if now != _none:
                out.append(now)
                at += size[now]
                base = now * ids
                now = longest[at] if at < n else _none
            else:
                dead[at] = 1
                last = out.pop()
                at -= size[last]
                base = out[-1] * ids if out else _none
                now = shorter[last]
        return out

    def encode_bytes(self, pieces: list[str]) -> bytes:
        """Ids of pre-tokens, as little-endian unsigned 32-bit integers."""
        memo = self.memo
        out = list(map(memo.new.get, pieces))
        if None in out:
            for k, ids in enumerate(out):
                if ids is None and (ids := memo.get(pieces[k])) is None:
                    found = self.encode_piece(utf8(pieces[k]))
                    ids = struct.pack(f"<{len(found)}I", *found)
                    if len(pieces[k]) <= LONGEST:
                        memo.put(pieces[k], ids)
                out[k] = ids
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, struct.unpack(f"<{len(ids) // 4}I", ids)))


@functools.cache
def coder(path: str) -> ByteBPE:
    return ByteBPE(path)


def encode(df: DataFrame, ranks_path: str, pattern: str, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids binary): each text's ids as little-endian unsigned 32-bit integers."""

    def make():
        hold("byte_bpe", coder.cache_clear)
        bpe, split = coder(ranks_path), Splitter(pattern, tokenizer_json)
        return lambda ids, texts: (ids, [bpe.encode_bytes(split(t)) if t else b"" for t in texts])

    return map_rows(df, [id_col, text_col], f"{id_col} {df.schema[id_col].dataType.simpleString()}, ids binary", make)


def decode(df: DataFrame, ranks_path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, text binary): the bytes that the ids stand for."""

    def make():
        hold("byte_bpe", coder.cache_clear)
        bpe = coder(ranks_path)
        return lambda ids, coded: (ids, [bpe.decode(x or b"") for x in coded])

    return map_rows(df, [id_col, "ids"], f"{id_col} {df.schema[id_col].dataType.simpleString()}, text binary", make)


def round_trip(df: DataFrame, ranks_path: str, pattern: str, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encode, then decode the ids, in one pass."""

    def make():
        hold("byte_bpe", coder.cache_clear)
        bpe, split = coder(ranks_path), Splitter(pattern, tokenizer_json)

        def f(ids, texts):
            coded = [bpe.encode_bytes(split(t)) if t else b"" for t in texts]
            return (
                ids,
                [len(x) // 4 for x in coded],
                [hashlib.sha256(x).hexdigest() for x in coded],
                [hashlib.sha256(bpe.decode(x)).hexdigest() for x in coded],
            )

        return f

    kind = df.schema[id_col].dataType.simpleString()
    return map_rows(df, [id_col, text_col], f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", make)


def encode_checked(df: DataFrame, ranks_path: str, pattern: str, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256, ids) of each row; ids as array<int>.  The digest of the decoded ids is that of the text."""

    def make():
        hold("byte_bpe", coder.cache_clear)
        bpe, split = coder(ranks_path), Splitter(pattern, tokenizer_json)

        def f(ids, texts):
            coded = [bpe.encode_bytes(split(t)) if t else b"" for t in texts]
            return (
                ids,
                [len(x) // 4 for x in coded],
                [hashlib.sha256(x).hexdigest() for x in coded],
                [hashlib.sha256(bpe.decode(x)).hexdigest() for x in coded],
                [np.frombuffer(x, "<i4") for x in coded],
            )

        return f

    kind = df.schema[id_col].dataType.simpleString()
    return map_rows(df, [id_col, text_col], f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>", make)
