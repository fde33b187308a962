"""Mixing sources to target weights by a budget that flows down a tree of domains, languages and sources.

Each node's budget is shared among its children by their weights.  A child that holds fewer tokens (times
the allowed epochs) than its share takes what it has; its shortage goes to its siblings, by weight, and
only what these can't take is left for the level above.  A leaf with budget b and t tokens gives b // t whole
epochs and, of the next one, the prefix in a seeded order that fits the remainder.

Tokens are those of the column ``tokens``; it is computed once, in a pass that keeps id, path and tokens of each row.

The prefix needs no sort of all rows: tokens are summed by the first hex digits of the order key, which finds
the one bucket where each leaf's prefix ends; this bucket is cut further, two digits at a time, until few rows are left,
so the number of digits follows the number of rows; only these rows are ordered.  The result is
a key for each leaf up to which its rows are taken, so texts are never shuffled.  What goes to the
driver is one row for each leaf, at most ``MAX_LEAVES``.

Defined results: null domain, language or source counts as an empty name; a null text has no tokens; rows
without tokens are taken as long as the prefix has not ended before them; rows with the same order key (equal
ids) are taken or left together; an empty table gives an empty table; other columns stay as they are.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, keep, small_table

#: Leaves of a tree; more is an error, since the tree is a declaration, not data.
MAX_LEAVES = 100_000
#: Hex digits by which a bucket of the order is cut, and rows that a leaf's last bucket has at most, if keys are spread evenly.
DIGITS, FEW = 2, 64


@dataclass
class Node:
    """Weights of children by name; a child that isn't named has ``other``."""

    children: dict[str, tuple[float, Node]] = field(default_factory=dict)
    other: float = 1.0

    def child(self, name: str) -> tuple[float, Node]:
        return self.children.get(name) or (self.other, Node())


def waterfill(amount: float, weights: list[float], room: list[float]) -> list[float]:
    """Shares of amount by weight, none over its room; what one can't take goes to the others by weight."""
    got, open_ = [0.0] * len(room), [i for i in range(len(room)) if weights[i] > 0 and room[i] > 0]
    while open_ and amount > 1e-9:
        unit = amount / sum(weights[i] for i in open_)
        full = [i for i in open_ if room[i] - got[i] <= unit * weights[i]]
        if not full:
            for i in open_:
                got[i] += unit * weights[i]
            break
        for i in full:
            amount -= room[i] - got[i]
            got[i] = room[i]
        open_ = [i for i in open_ if i not in set(full)]
    return got


def allocate(tree: Node, leaves: dict[tuple[str, ...], float], budget: float) -> dict[tuple[str, ...], float]:
    """Budget of each leaf (by path); leaves: what each can give."""
    if not leaves:
        return {}
    if () in leaves:
        return {(): min(budget, leaves[()])}
    groups: dict[str, dict[tuple[str, ...], float]] = {}
    for path, room in sorted(leaves.items()):
        groups.setdefault(path[0], {})[path[1:]] = room
    names = sorted(groups)
    shares = waterfill(budget, [tree.child(n)[0] for n in names], [sum(groups[n].values()) for n in names])
    return {(n, *path): b for n, share in zip(names, shares, strict=True) for path, b in allocate(tree.child(n)[1], groups[n], share).items()}


def _key(seed: int, epoch: Column, id_col: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(id_col.cast("string"), F.lit("null"))))


def _leaves(path: list[Column]) -> tuple[list[str], list[Column]]:
    names = [f"__mix_{i}" for i in range(len(path))]
    return names, [F.coalesce(p.cast("string"), F.lit("")).alias(n) for p, n in zip(path, names, strict=True)]


def cuts(slim: DataFrame, names: list[str], tree: Node, budget: float | None = None, share: float | None = None, max_epochs: int = 4, seed: int = 0) -> DataFrame:
    """(names, __mix_epochs, __mix_cut) of each leaf: whole epochs, and the order key up to which rows are taken once more.

    slim: (names, __mix_id, __mix_tokens) of each row, a table that is cheap to read.
    """
    spark = slim.sparkSession
    found = slim.groupBy(*names).agg(F.sum("__mix_tokens").alias("t"), F.count("*").alias("n")).limit(MAX_LEAVES + 1).collect()
    if len(found) > MAX_LEAVES:
        raise ValueError(f"over {MAX_LEAVES} leaves")
    have = {tuple(r[n] for n in names): int(r["t"] or 0) for r in found}
    budget = sum(have.values()) * (1.0 if share is None else share) if budget is None else budget
    got = allocate(tree, {k: float(v * max_epochs) for k, v in have.items()}, budget)
    plan = [(*k, i, *(divmod(int(got.get(k, 0) + 1e-6), t) if t else (0, 0))) for i, (k, t) in enumerate(have.items())]
    leaf_schema = ", ".join([*(f"{n} string" for n in names), "__mix_leaf int, __mix_epochs long, __mix_rest long"])
    # All tables of leaves have a row for each: bounded by MAX_LEAVES.
    leaf = F.broadcast(small_table(spark, plan, leaf_schema))
    keyed = keep(slim.join(leaf, names).select("__mix_leaf", _key(seed, F.col("__mix_epochs"), F.col("__mix_id")).alias("key"), F.col("__mix_tokens").alias("t")))
    edge_schema = "__mix_leaf int, rest long, prefix string, before long"
    edges = [(p[-3], p[-1], "", 0) for p in plan]
    rows, digits = max((r["n"] for r in found), default=0), 0

    def inside() -> DataFrame:
        """Rows of each leaf's bucket so far."""
        edge = F.broadcast(small_table(spark, edges, edge_schema))
        return keyed.join(edge, "__mix_leaf").where(F.substring("key", 1, digits) == F.col("prefix"))

    def running(bucket: Column) -> DataFrame:
        sums = inside().groupBy("__mix_leaf", "rest", "before", bucket.alias("b")).agg(F.sum("t").alias("t"))
        return sums.withColumn("upto", F.col("before") + F.sum("t").over(Window.partitionBy("__mix_leaf").orderBy("b")))

    while edges and rows > FEW and digits < 32:
        # the first bucket that doesn't fit whole
        first = running(F.substring("key", 1, digits + DIGITS)).where("upto > rest").groupBy("__mix_leaf", "rest").agg(F.min(F.struct("b", F.expr("upto - t").alias("before"))).alias("e"))
        edges = [tuple(r) for r in first.select("__mix_leaf", "rest", "e.b", "e.before").collect()]
        digits, rows = digits + DIGITS, rows / 16**DIGITS
    last = dict(map(tuple, running(F.col("key")).where("upto <= rest").groupBy("__mix_leaf").agg(F.max("b")).collect())) if edges else {}
    # A prefix ends at the last row that fits, or before its bucket; a leaf without an edge fits whole (it has no tokens).
    ends = {e[0]: last.get(e[0], e[2]) for e in edges}
    discard(keyed)
    rows_ = [(*p[: len(names)], p[-2], ends.get(p[-3], "g")) for p in plan]
    return small_table(spark, rows_, ", ".join([*(f"{n} string" for n in names), "__mix_epochs long, __mix_cut string"]))


def mix(
    df: DataFrame, path: list[Column], tree: Node, tokens: Column, budget: float | None = None, share: float | None = None, max_epochs: int = 4, seed: int = 0, id_col: str = "doc_id", copies_col: str = "n_copies"
) -> DataFrame:
    """df with how often each row is taken (``copies_col``).  The budget is in tokens, or ``share`` of all there are."""
    names, leaves = _leaves(path)
    slim = keep(df.select(*leaves, F.col(id_col).alias("__mix_id"), F.coalesce(tokens.cast("long"), F.lit(0)).alias("__mix_tokens")))
    cut = cuts(slim, names, tree, budget, share, max_epochs, seed)
    discard(slim)
    return taken(df, path, cut, seed, id_col, copies_col)


def taken(df: DataFrame, path: list[Column], cut: DataFrame, seed: int, id_col: str, copies_col: str) -> DataFrame:
    """df with how often each row is taken, by what ``cuts`` says of its leaf."""
    names, leaves = _leaves(path)
    # The row travels as one column, whatever its columns are called.
    rows = df.select(F.struct("*").alias("__mix_row"), F.col(id_col).alias("__mix_id"), *leaves).join(F.broadcast(cut), names)
    copies = F.col("__mix_epochs") + (_key(seed, F.col("__mix_epochs"), F.col("__mix_id")) <= F.col("__mix_cut")).cast("long")
    return rows.select("__mix_row.*", copies.alias(copies_col))
