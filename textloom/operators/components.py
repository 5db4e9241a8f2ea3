"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.scratch import materialize, release


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every endpoint of ``edges``; component is the smallest node reachable.

    Null endpoints, self-loops and repeated edges add nothing, except that a self-loop's node is
    returned as a component of its own. Each round is two aggregations with map-side combine and
    two joins keyed by node; a node with very many neighbours is combined before the shuffle and
    its join side can be split by adaptive execution. Rounds grow with the logarithm of the longest
    path. Every round is written to the shared folder, so lineage stays short.
    """
    raw = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    start = materialize(raw.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    loops = start.where("a = b").select(F.col("a").alias("node"))
    links = start.where("a <> b")
    last, held = _checksum(links), start
    if last[0]:
        for _ in range(max_rounds):
            step = materialize(_round(links), "cc")
            now = _checksum(step)
            if held is not start:
                release(held)
            links, held = step, step
            if now == last:
                break
            last = now
        else:
            raise RuntimeError("connected components did not settle")
    found = links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select("b", "b").distinct())
    alone = loops.join(found, "node", "left_anti").select("node", F.col("node").alias("component"))
    return found.union(alone)


def _round(links: DataFrame) -> DataFrame:
    both = links.select(F.col("a").alias("x"), F.col("b").alias("y")).union(links.select("b", "a"))
    least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
    large = both.where("y > x").join(least, "x").select(F.col("y").alias("a"), F.col("m").alias("b")).distinct()
    root = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(root, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.union(root.select("a", "m")).distinct()
