"""Connected components of an edge table, every step a shuffle with map-side combination."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.session import cut_lineage


def _hang(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Move neighbours of each node ``a`` to the smallest node of its neighbourhood.

    The large step moves the neighbours above ``a``, the small step those below it and ``a`` itself.
    """
    if larger_only:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        moved = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        moved = moved.unionByName(least.select("a", F.col("m").alias("b")))
    return moved.where("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges (a, b)``; root is the smallest node that can be reached.

    Alternating large and small stars: the number of rounds grows with the logarithm of the longest chain.  A hub
    is never gathered: its neighbours meet only its minimum, in a join that adaptive execution may split.  Self
    loops and repeated edges are allowed; no edges give no rows.
    """
    hi, lo = F.greatest("a", "b"), F.least("a", "b")
    now = cut_lineage(edges.select(hi.alias("a"), lo.alias("b")).where("a > b").distinct())
    mark = None
    while True:
        signature = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if signature == mark or not signature[0]:
            break
        mark = signature
        now = cut_lineage(_hang(_hang(now, True), False))
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
