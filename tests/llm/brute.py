"""Plain restatements of what the operators must return."""

from __future__ import annotations

import hashlib
import re
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import zstandard


def repeats(texts, length):
    """Per text: (bytes, removed, spans, sha256 of the rest)."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((gone[:-1] & ~np.concatenate(([False], gone[:-2]))).sum()) if len(d) else 0
        kept = bytes(b for b, g in zip(d, gone, strict=False) if not g)
        out.append((len(d), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def without_repeats(texts, length, words):
    """Texts without strings of ``length`` bytes and runs of ``words`` words that occur again; a word has no ASCII signs at its ends."""
    data = [(t or "").encode() for t in texts]
    strings = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    signs = string.punctuation.encode()
    spans = []
    for d in data:
        found = []
        for m in re.finditer(rb"[^ \t\n\r\f\v]+", d):
            head, both = m[0].lstrip(signs), m[0].strip(signs)
            if both:
                a = m.end() - len(head)
                found.append((a, a + len(both)))
        spans.append(found)
    runs = Counter(tuple(d[a:b] for a, b in s[i : i + words]) for d, s in zip(data, spans, strict=True) for i in range(len(s) - words + 1))
    out = []
    for d, s in zip(data, spans, strict=True):
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if strings[d[i : i + length]] > 1:
                gone[i : i + length] = True
        for i in range(len(s) - words + 1):
            if runs[tuple(d[a:b] for a, b in s[i : i + words])] > 1:
                gone[s[i][0] : s[i + words - 1][1]] = True
        out.append(bytes(b for b, g in zip(d, gone, strict=True) if not g).decode("utf-8", "ignore"))
    return out


def budgets(weights, room, amount):
    """Budgets of leaves, by bisection.  weights: nested {name: (weight, nested)}, other names weigh 1; room: {path: tokens that a leaf can give}."""
    if () in room:
        return {(): min(amount, room[()])}
    groups = defaultdict(dict)
    for path, r in room.items():
        groups[path[0]][path[1:]] = r
    full = {n: sum(g.values()) for n, g in groups.items()}
    weight = {n: weights.get(n, (1.0, {}))[0] for n in groups}
    level = lambda x: {n: min(full[n], x * weight[n]) for n in groups}
    lo, hi = 0.0, 1.0
    while sum(level(hi).values()) < min(amount, sum(f for n, f in full.items() if weight[n] > 0)) - 1e-9:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if sum(level(mid).values()) >= amount else (mid, hi)
    return {(n, *path): b for n, share in level(hi).items() for path, b in budgets(weights.get(n, (1.0, {}))[1], groups[n], share).items()}


def quality_features(text, good, bad, block=1024):
    """Sizes of a text's blocks under two dictionaries: the normalised difference, and the better size over the text's."""
    data = (text or "").encode()
    if not data:
        return 0.0, 0.0

    def size(dictionary):
        c = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=False, write_checksum=False, write_dict_id=False)
        return sum(len(c.compress(data[i : i + block])) for i in range(0, len(data), block))

    a, b = size(good), size(bad)
    return (b - a) / (a + b), min(a, b) / len(data)


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def near(rows, width, percent):
    """(id, text) rows -> {id: (set size, component, kept)}."""
    sets = [(i, shingles(t, width)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = defaultdict(list)
    for n, (_, s) in enumerate(sets):
        for x in s:
            index[x].append(n)
    both = Counter()
    for many in index.values():
        for a in range(len(many)):
            for b in many[a + 1 :]:
                both[many[a], b] += 1
    for (a, b), n in both.items():
        if 100 * n >= percent * (len(sets[a][1]) + len(sets[b][1]) - n):
            x, y = sorted((root(sets[a][0]), root(sets[b][0])))
            parent[y] = x
    return {i: (len(s), root(i), root(i) == i) for i, s in sets}


def nearest(vectors, queries, k):
    """{query id: [(id, score)]} by exact search; vectors: {id: list}."""
    ok = {i: np.array(v, float) for i, v in vectors.items() if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = np.array(sorted(ok))
    x = np.stack([ok[i] for i in ids])
    out = {}
    for q in queries:
        if q in ok:
            s = x @ ok[q]
            s[ids == q] = -np.inf
            order = np.lexsort((ids, -np.round(s, 12)))[:k]
            out[q] = [(int(ids[j]), float(s[j])) for j in order if ids[j] != q]
    return out


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2
