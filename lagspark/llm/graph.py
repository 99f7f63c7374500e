"""Connected components over an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first())


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) for every node of `edges` (a, b: longs); label is the smallest node of its component.

    Each round links every node's larger neighbours to its smallest one, then
    its smaller neighbours likewise; only minima are aggregated, never lists of
    neighbours, so a hub costs one partial aggregate.  Rounds stop when the
    edges are a forest of stars, after O(log n) of them in practice.  Self
    loops and repeated edges are allowed; no edges give an empty table.
    """
    e = scratch.put("edges", edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = _digest(e)
    while seen[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        e2 = scratch.put("edges", small)
        now = _digest(e2)
        scratch.drop(e)
        e = e2
        if now == seen:
            break
        seen = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
