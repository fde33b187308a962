"""Connected components of a link table, without bringing it to one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, keep


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) of each id in links(a, b); component: the smallest id reachable."""
    return members(stars(links, rounds))


def members(found: DataFrame) -> DataFrame:
    """(id, component) of the ids in stars, those that the others lead to included."""
    roots = found.select("v").distinct()
    return found.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots.select(F.col("v").alias("id"), F.col("v").alias("component")))


def stars(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(u, v), kept: each id in links(a, b) that is not the smallest of its component, and that smallest id.

    Alternates two steps until nothing changes: each node's larger neighbours are linked to its smallest
    one, then its smaller ones are.  Each round is two aggregations and joins by node, and is
    written to the shared folder, so plans stay short.  A node with very many links is met by partial
    aggregation (minimum) and by joins whose other side has one row a key, which Spark can split.
    """
    edges = keep(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())

    def step(e: DataFrame, larger: bool) -> DataFrame:
        """e: (u, v).  Links neighbours of u on one side of it (for the larger step all links count, in both directions) to the smallest of all."""
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if larger else e
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = both.join(least, "u")
        if larger:
            return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return out.unionByName(least.select("u", F.col("m").alias("v"))).distinct()

    def settled(e: DataFrame) -> bool:
        """True if all links lead straight to a node that leads nowhere."""
        ends = e.select("u", F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(e.select(F.col("v").alias("u"), F.lit(0).alias("out"), F.lit(1).alias("into")))
        return ends.groupBy("u").agg(F.sum("out").alias("out"), F.sum("into").alias("into")).where("out > 1 or out > 0 and into > 0").isEmpty()

    for _ in range(rounds):
        if settled(edges):
            break
        before, edges = edges, keep(step(step(edges, True), False).where("u <> v"))
        discard(before)
    else:
        raise RuntimeError(f"links did not settle in {rounds} rounds")
    return edges


def grown(found: DataFrame | None, links: DataFrame) -> DataFrame:
    """Stars (u, v), kept, of all links that went into ``found`` (kept stars, which are deleted; None: none yet) and of new ones.

    Only new links are followed: their ends are replaced by the components that they are in, and the stars of these are put before the old ones.
    """
    if found is None:
        return stars(links)
    own, other = found.toDF("a", "of_a"), found.toDF("b", "of_b")
    named = links.join(own, "a", "left").join(other, "b", "left")
    new = stars(named.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")))
    moved = found.join(new.toDF("v", "to"), "v", "left").select("u", F.coalesce("to", "v").alias("v"))
    out = keep(moved.unionByName(new))
    discard(found, new)
    return out
