"""Connected components of an edge table, by alternating stars.

Every round points the larger neighbours of a node, then the smaller ones, at the smallest node that it knows (large star
and small star), until the edges stop changing; then each node has one edge to its component's smallest. A round is two
sums and two joins over tables in the shared folder; nothing is collected, and a node with very many edges is split by
adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Shared


def _smallest(edges: DataFrame) -> DataFrame:
    """(u, m): the smallest of each u and its v."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def components(edges: DataFrame, shared: Shared) -> DataFrame:
    """(node, root) of every node that has an edge; ``edges`` has the columns a and b of one orderable type."""
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = shared.save(now, "edges")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = shared.save(_smallest(both), "low")
        large = both.join(low, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = shared.save(large.filter("u <> v").distinct(), "large")
        low2 = shared.save(large.groupBy("u").agg(F.min("v").alias("m")), "low2")
        moved = large.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = moved.unionByName(low2.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        new = shared.save(new, "edges")
        done = _same(new, now)
        shared.drop(now, low, large, low2)
        now = new
        if done:
            roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _same(new: DataFrame, old: DataFrame) -> bool:
    """Equal tables, told by their sizes and two sums of row hashes."""
    def of(t: DataFrame):
        h = F.xxhash64("u", "v")
        g = F.xxhash64(F.lit(1), "u", "v")
        return t.agg(F.count("*"), F.sum(h.cast("decimal(20,0)")), F.bit_xor(g)).first()

    return of(new) == of(old)
