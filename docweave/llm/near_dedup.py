"""Near duplicates by a chosen-path set similarity join.

A document's set is its distinct word shingles.  Equal sets are one class.  Each class has a MinHash signature.
In each of several independent trees a class starts at the root; at a node it is sent to a few children,
each named by a coordinate, which the tree and the node choose, and by its MinHash there.  Two classes with similarity s
meet in a child with probability s for each chosen coordinate; 1/threshold coordinates are chosen on average, and ``GROW`` times
that below the first levels, so the branching process of a linked pair survives, and unlike classes part at once.
A node of one class ends; a node of up to ``SMALL`` classes compares all of its classes; a larger one branches on.

Every node, small or large, first compares its classes with one of them, the pivot: as many comparisons as
classes.  What this confirms is gathered into components, and links inside one add nothing more.  So a node of one
component is done, and where few classes (``SMALL``) are outside a node's largest component, these are compared with all of it, block by
block.  So is a dense node, a quarter or more of which is one component, since texts so much alike would stay together: as long as the classes outside are
``DENSE`` at most, work for each class that does not grow with the input.  Only other nodes branch on, two levels for each look.  What is still
large after the last look is compared in the same way, so no candidate is dropped.  A group of many near copies costs what it has members.
Every link is confirmed on full sets: |A and B| * 100 >= |A or B| * percent.

Recall (``tests/llm`` measures it): ten trees miss a pair at the threshold with probability below 1e-4 after the two levels that are taken
at once, and about 2e-3 where nodes are so full that all levels are needed; pairs above the threshold are missed far less often.

Defined results: null or empty texts, and such without words, have an empty set and no links; rows with a null doc_id take
no part, and have component_id null and kept true; rows that share a doc_id link their texts, and each is returned;
an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, discard, hold, keep, map_rows, release, sought, utf8
from .components import grown, members
from .repeats import text_key

#: Coordinates of a signature; independent trees; levels taken at once from the root; looks at nodes, ``STEP`` levels apart.
COORDINATES, TREES, START, DEPTH, STEP = 64, 10, 2, 5, 2
#: Classes of a small node, and classes that a dense node compares with the rest; of a block of texts, and of a block of sketches; hashes of a bottom sketch.
SMALL, DENSE, BLOCK, SKETCHES, BOTTOM = 48, 16_384, 96, 1024, 256
#: Factor of the branching below the first levels.
GROW = 1.25
#: Words that a worker remembers the hash of.
WORDS = 200_000
#: The chance that a sketch rules out a pair at the threshold.
RISK = 1e-7
_words = Memo(WORDS)
_U = np.uint64


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text's words (lower-cased in A-Z, cut at ASCII white space)."""
    words = utf8(text).lower().split()
    if not words:
        return np.empty(0, np.uint64)
    own = []
    for w in words:
        h = _words.new.get(w) or _words.get(w)
        if h is None:
            h = xxhash.xxh3_64_intdigest(w)
            if len(w) <= 64:
                _words.put(w, h)
        own.append(h)
    h = np.array(own, np.uint64)
    if len(h) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    n = len(h) - width + 1
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = (out ^ h[k : k + n]) * _U(0x9E3779B97F4A7C15)
        out ^= out >> _U(29)
        out *= _U(0xBF58476D1CE4E5B9)
        out ^= out >> _U(32)
    return np.unique(out)


@functools.cache
def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_24)
    return rng.integers(1, 2**32, COORDINATES, dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, COORDINATES, dtype=np.uint32)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The MinHash of a set at each coordinate, 32 bits each."""
    mul, add = _multipliers()
    best = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    low = (shingles ^ (shingles >> _U(32))).astype(np.uint32)
    for at in range(0, len(low), 2048):
        x = (low[at : at + 2048, None] + add) * mul
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x ^= x >> np.uint32(12)
        np.minimum(best, x.min(0), out=best)
    return best


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads each bit over all."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _roots() -> np.ndarray:
    return _mix(np.arange(1, TREES + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))


def branch(nodes: np.ndarray, who: np.ndarray, sigs: np.ndarray, threshold: float, grow: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Children of nodes for the classes there (rows of sigs).

    A node chooses one coordinate or, so often that the mean is grow/threshold, two; a child is named by node, coordinate and the MinHash there.
    """
    h = _mix(nodes + _U(0x632BE59BD9B4E019))
    first = (h % _U(COORDINATES)).astype(np.int64)
    second = (first + 1 + ((h >> _U(24)) % _U(COORDINATES - 1)).astype(np.int64)) % COORDINATES
    two = ((h >> _U(8)) & _U(0xFFFF)).astype(np.float64) < (grow / threshold - 1) * 65536

    def child(pick: np.ndarray, coordinate: np.ndarray) -> np.ndarray:
        name = (coordinate[pick].astype(np.uint64) << _U(32)) | sigs[who[pick], coordinate[pick]].astype(np.uint64)
        return _mix(nodes[pick] ^ _mix(name + _U(0x9E3779B97F4A7C15)))

    all_, some = np.arange(len(nodes)), np.flatnonzero(two)
    return np.concatenate((child(all_, first), child(some, second))), np.concatenate((who, who[some]))


def _stacked(sigs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), np.uint32).reshape(len(sigs), COORDINATES)


@functools.cache
def least_agreeing(threshold: float) -> int:
    """Coordinates in which two signatures agree at least, but with a chance of ``RISK`` for a pair at the threshold."""
    chance = 0.0
    for n in range(COORDINATES + 1):
        chance += math.comb(COORDINATES, n) * threshold**n * (1 - threshold) ** (COORDINATES - n)
        if chance > RISK:
            return n
    return COORDINATES


def bottom(shingles: np.ndarray) -> bytes:
    """The smallest hashes of a set, 32 bits each: all of a small set, a uniform sample of a large one."""
    return (shingles[:BOTTOM] >> _U(32)).astype(np.uint32).tobytes()


def bottom_alike(own: np.ndarray, own_n: int, others: list[np.ndarray], sizes: np.ndarray, threshold: float) -> np.ndarray:
    """For each other set: False only where the smallest hashes rule a link out (certain for small sets, for samples but with a chance of about ``RISK``)."""
    top = np.uint32(0xFFFFFFFF)
    reach = np.array([x[-1] if n > BOTTOM else top for x, n in zip(others, sizes, strict=True)], np.uint32)
    if own_n > BOTTOM:
        reach = np.minimum(reach, own[-1])
    values, lengths = np.concatenate(others), np.array([len(x) for x in others])
    owner = np.repeat(np.arange(len(others)), lengths)
    inside = values <= reach[owner]
    at = np.minimum(np.searchsorted(own, values), len(own) - 1)
    both = np.bincount(owner[inside & (own[at] == values)], minlength=len(others))
    union = np.bincount(owner[inside], minlength=len(others)) + np.searchsorted(own, reach, side="right") - both
    deviations = 5.4 * math.sqrt(threshold * (1 - threshold) / BOTTOM)
    margin = np.where((sizes > BOTTOM) | (own_n > BOTTOM), deviations, 0.01)
    return both >= (threshold - margin) * union


def signatures(df: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, set_hash, sig, text_key) of each row."""

    def make():
        hold("near_dedup", _words.clear)

        def f(ids, texts):
            sets = [shingle_set(t, width) for t in texts]
            return ids, [len(s) for s in sets], [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], [signature(s).tobytes() if len(s) else None for s in sets], [hashlib.md5(utf8(t)).digest() for t in texts]

        return f

    kind = df.schema[id_col].dataType.simpleString()
    return map_rows(df, [id_col, text_col], f"{id_col} {kind}, n_shingles long, set_hash binary, sig binary, text_key binary", make)


def _descend(level: DataFrame, threshold: float, steps: int, roots: bool = False) -> DataFrame:
    """(node, cid) some levels further down, from rows (node, cid, sig); with ``roots`` from rows (cid, sig) at the root of each tree."""

    def make():
        def f(*columns):
            cids, sigs = np.array(columns[-2]), _stacked(columns[-1])
            who = np.arange(len(cids))
            nodes = np.array(columns[0], np.int64).view(np.uint64)
            if roots:
                nodes, who = np.tile(_roots(), len(cids)), np.repeat(who, TREES)
            for _ in range(steps):
                nodes, who = branch(nodes, who, sigs, threshold, 1.0 if roots else GROW)
            return nodes.view(np.int64), cids[who]

        return f

    return map_rows(level, ["cid", "sig"] if roots else ["node", "cid", "sig"], "node long, cid long", make)


def _sized(members: DataFrame, first: bool = False) -> DataFrame:
    """Members of nodes with two classes or more, with their node's size and its pivot.

    The first pivots are the smallest classes, so that the nodes of one group agree on theirs; later ones are chosen by the node's name,
    since classes outside the pivot's component have been compared with the smallest one.

    Sizes are kept as a table of their own, so that in the join Spark can split a node that very many classes share.
    """
    members = keep(members)
    sizes = keep(members.groupBy("node").agg(F.count("*").alias("size"), F.min(F.struct(F.lit(0) if first else F.xxhash64("node", "cid"), "cid")).alias("p")).where("size > 1").select("node", "size", F.col("p.cid").alias("pivot")))
    return members.join(sizes, "node")


def alike(sig_a: bytes, sig_b: bytes, threshold: float) -> bool:
    """False only where the sketches rule a link out."""
    return int((np.frombuffer(sig_a, np.uint32) == np.frombuffer(sig_b, np.uint32)).sum()) >= least_agreeing(threshold)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """The exact test on full sets."""
    if min(len(a), len(b)) * 100 < max(len(a), len(b)) * percent:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both) and both > 0


def _with_bottoms(texts: DataFrame, width: int) -> DataFrame:
    """(cid, n, sig, text, low): classes with the smallest hashes of their sets."""

    def make():
        hold("near_dedup", _words.clear)
        return lambda cids, ns, sigs, texts: (cids, ns, sigs, texts, [bottom(shingle_set(t, width)) for t in texts])

    return map_rows(texts, ["cid", "n", "sig", "text"], "cid long, n long, sig binary, text string, low binary", make)


def _sketched(pairs: DataFrame, active: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sizes and sketches allow a link; pairs: kept."""
    slim = sought(active.select("cid", "n", "sig"), pairs.select(F.explode(F.array("a", "b")).alias("cid")), "cid")
    both = pairs.join(slim.toDF("a", "n_a", "sig_a"), "a").join(slim.toDF("b", "n_b", "sig_b"), "b")
    sized = both.where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)

    def make():
        def f(a, b, sa, sb):
            ok = [alike(x, y, percent / 100) for x, y in zip(sa, sb, strict=True)]
            return [x for x, k in zip(a, ok, strict=True) if k], [x for x, k in zip(b, ok, strict=True) if k]

        return f

    return keep(map_rows(sized, ["a", "b", "sig_a", "sig_b"], "a long, b long", make))


def _confirm(pairs: DataFrame, active: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b), a < b, that are links by their full sets; pairs: kept.

    Classes that are compared with each other are dealt to blocks of about ``BLOCK``, by their smallest partner.  Pairs are grouped by their two
    blocks, and each class's text is sent once to each group that needs it, not once a pair; a group makes each set once.
    """
    ends = pairs.select(F.col("a").alias("cid"), "b").unionByName(pairs.select(F.col("b").alias("cid"), F.col("a").alias("b")))
    homes = ends.groupBy("cid").agg(F.min("b").alias("least")).select("cid", F.least("cid", "least").alias("home"))
    sizes = homes.groupBy("home").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n"))
    placed = keep(homes.join(sizes, "home").select("cid", F.xxhash64("home", F.pmod(F.xxhash64("cid"), F.col("n"))).alias("block")))
    dealt = keep(pairs.join(placed.toDF("a", "i"), "a").join(placed.toDF("b", "j"), "b"))
    lists = dealt.groupBy("i", "j").agg(F.collect_list(F.struct("a", "b")).alias("p"))
    members = dealt.select("i", "j", F.explode(F.array("a", "b")).alias("cid")).distinct().join(sought(active.select("cid", "text"), placed, "cid"), "cid")
    groups = members.groupBy("i", "j").agg(F.collect_list(F.struct("cid", "text")).alias("t")).join(lists, ["i", "j"])

    def make():
        hold("near_dedup", _words.clear)

        def f(many, texts):
            left, right = [], []
            for group, members in zip(many, texts, strict=True):
                sets = {m["cid"]: shingle_set(m["text"], width) for m in members}
                for p in group:
                    if linked(sets[p["a"]], sets[p["b"]], percent):
                        left.append(p["a"])
                        right.append(p["b"])
            return left, right

        return f

    out = keep(map_rows(groups, ["p", "t"], "a long, b long", make))
    discard(placed, dealt)
    return out


def _mixed(level: DataFrame, comp: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (node, cid, comp) of nodes that hold several components, and those nodes (node, size, major, minor): the largest component, and the classes outside it."""
    named = level.select("node", "cid").join(comp.toDF("cid", "component"), "cid", "left").select("node", "cid", F.coalesce("component", "cid").alias("comp"))
    shares = named.groupBy("node", "comp").agg(F.count("*").alias("c"))
    nodes = shares.groupBy("node").agg(F.sum("c").alias("size"), F.max(F.struct("c", "comp")).alias("top")).where("size > top.c")
    return named, nodes.select("node", "size", F.col("top.comp").alias("major"), (F.col("size") - F.col("top.c")).alias("minor"))


def _across(named: DataFrame, nodes: DataFrame, active: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of classes of a node that are in different components and whose sketches allow a link.

    The classes outside the node's largest component seek partners among all.  Seekers and partners are cut into blocks of about
    ``SKETCHES``; each pair of blocks is a group of its own, so no task holds more than two blocks of sketches at once.  A pair that
    meets in several of these nodes is looked at in the one with the smallest name only.
    """
    cut = nodes.select("node", "major", F.ceil(F.col("size") / SKETCHES).cast("int").alias("bt"), F.ceil(F.col("minor") / SKETCHES).cast("int").alias("bs"))
    rows = named.join(cut, "node")
    partners = rows.select("node", F.pmod(F.xxhash64("cid"), F.col("bt")).cast("int").alias("t"), F.explode(F.expr("sequence(0, bs - 1)")).alias("s"), "cid", "comp", F.lit(False).alias("seeks"))
    seekers = rows.where("comp <> major").select("node", F.explode(F.expr("sequence(0, bt - 1)")).alias("t"), F.pmod(F.xxhash64("cid", F.lit(1)), F.col("bs")).cast("int").alias("s"), "cid", "comp", F.lit(True).alias("seeks"))
    at = rows.groupBy("cid").agg(F.collect_set("node").alias("at"))
    signed = partners.unionByName(seekers).join(sought(active.select("cid", "n", "sig", "low"), rows, "cid"), "cid").join(at, "cid")
    grouped = signed.groupBy("node", "t", "s").agg(F.collect_list(F.struct("cid", "comp", "seeks", "n", "sig", "low", "at")).alias("m"))

    def make():
        def f(names, groups):
            left, right = [], []
            for name, m in zip(names, groups, strict=True):
                ask, have = [x for x in m if x["seeks"]], [x for x in m if not x["seeks"]]
                if not ask or not have:
                    continue
                sigs, asked = _stacked([x["sig"] for x in have]), _stacked([x["sig"] for x in ask])
                before = [[v for v in x["at"] if v < name] for x in have]
                lesser = np.full((len(have), max(map(len, before))), name)
                for row, values in zip(lesser, before, strict=True):
                    row[: len(values)] = values
                comps, sizes, ids = (np.array([x[k] for x in have]) for k in ("comp", "n", "cid"))
                lows = [np.frombuffer(x["low"], np.uint32) for x in have]
                for i, x in enumerate(ask):
                    near = (sigs == asked[i]).sum(1) >= least_agreeing(threshold)
                    near &= (np.minimum(sizes, x["n"]) >= threshold * np.maximum(sizes, x["n"]) - 1e-9) & (comps != x["comp"])
                    some = np.flatnonzero(near)
                    some = some[~np.isin(lesser[some], [v for v in x["at"] if v < name]).any(1)]
                    if len(some):
                        some = some[bottom_alike(np.frombuffer(x["low"], np.uint32), x["n"], [lows[k] for k in some], sizes[some], threshold)]
                        left += np.minimum(ids[some], x["cid"]).tolist()
                        right += np.maximum(ids[some], x["cid"]).tolist()
            return left, right

        return f

    return map_rows(grouped, ["node", "m"], "a long, b long", make).distinct()


def near_duplicates(df: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) of each row; a link is a similarity of ``percent`` / 100 or more.

    width: words of a shingle.  Ids must be integers.
    """
    threshold = percent / 100
    docs = df.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    signed = keep(signatures(docs, width, "doc", "text"))
    some = signed.where("n_shingles > 0 and doc is not null")
    # A class has a number of its own, since an id with several texts may be the smallest of several classes.
    least = some.groupBy("set_hash").agg(F.min(F.struct("doc", "text_key")).alias("least"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"))
    classes = keep(least.select(F.monotonically_increasing_id().alias("cid"), "set_hash", F.col("least.doc").alias("least"), F.col("least.text_key").alias("text_key"), "n", "sig"))
    level = keep(_sized(_descend(classes, threshold, START, roots=True), first=True))
    wanted = keep(level.select("cid").distinct().join(classes.select("cid", F.col("least").alias("doc"), "text_key"), "cid"))
    keyed = sought(docs.where("doc is not null").withColumn("text_key", text_key(F.col("text"))), wanted, "doc", "text_key")
    texts = keyed.join(wanted, ["doc", "text_key"]).groupBy("cid").agg(F.min("text").alias("text"))
    active = keep(_with_bottoms(texts.join(classes.select("cid", "n", "sig"), "cid"), width))
    discard(wanted)
    release(df.sparkSession)
    links, comp = [], None
    for depth in range(DEPTH):
        new = level.where("cid <> pivot").select(F.least("pivot", "cid").alias("a"), F.greatest("pivot", "cid").alias("b")).distinct()
        if comp is not None:
            new = new.join(comp.toDF("a", "of_a"), "a", "left").join(comp.toDF("b", "of_b"), "b", "left").where("coalesce(of_a, a) <> coalesce(of_b, b)").select("a", "b")
        met = keep(new)
        new = _sketched(met, active, percent)
        links.append(_confirm(new, active, width, percent))
        discard(met, new)
        comp = grown(comp, _union(links))
        discard(*links)
        links = []
        named, nodes = _mixed(level, comp)
        nodes = keep(nodes)
        named = keep(named.join(nodes.select("node"), "node", "left_semi"))
        dense = (F.col("minor") <= SMALL) | (F.col("minor") <= F.least(0.75 * F.col("size"), F.lit(float(DENSE))))
        ready = nodes if depth == DEPTH - 1 else nodes.where((F.col("size") <= SMALL) | dense)
        pairs = keep(_across(named, ready, active, threshold))
        if not pairs.isEmpty():
            links.append(_confirm(pairs, active, width, percent))
        large = named.join(nodes.join(ready.select("node"), "node", "left_anti").select("node"), "node", "left_semi")
        discard(level, shuffles=True)
        if depth == DEPTH - 1 or large.isEmpty():
            break
        level = keep(_sized(_descend(large.select("node", "cid").join(active.select("cid", "sig"), "cid"), threshold, STEP)))
    discard(active, shuffles=True)
    # Rows that share an id may be in several classes, which it links.
    own = some.select("doc", "set_hash").join(classes.select("set_hash", "cid"), "set_hash").select("doc", "cid")
    several = keep(own.groupBy("doc").agg(F.min("cid").alias("a"), F.max("cid").alias("z")).where("a <> z").select("doc", "a"))
    if not several.isEmpty():
        links.append(own.join(several, "doc").where("cid <> a").select("a", F.col("cid").alias("b")))
    final = keep(members(grown(comp, _union(links)) if links else comp))
    # Components are named by their smallest id.
    named = final.join(classes.select(F.col("cid").alias("id"), "least"), "id").groupBy("component").agg(F.min("least").alias("first"))
    firsts = keep(final.join(keep(named), "component").select("id", "first"))
    named = signed.select("doc", "n_shingles", "set_hash").join(classes.select("set_hash", "cid", "least"), "set_hash", "left").join(firsts, F.col("cid") == F.col("id"), "left")
    component = F.when(F.col("doc").isNotNull(), F.coalesce("first", "least", "doc"))
    out = named.select("doc", "n_shingles", component.alias("component_id"))
    kept = F.coalesce(F.col("doc") == F.col("component_id"), F.lit(True))
    return out.select(F.col("doc").alias(id_col), "n_shingles", "component_id", kept.alias("kept"))


def _union(tables: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, tables)
