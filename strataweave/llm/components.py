"""Connected components by alternating large-star and small-star rounds.

Each round is a grouped minimum and an equi-join; nothing but two numbers per
round reaches the driver. A hub with very many edges is combined map-side in
the minimum, and its edges meet a single row in the join, which adaptive
execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.llm.common import written


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 31))).first()
    return row[0], row[1]


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); component: its smallest node.

    Self loops and repeated or reversed edges are fine; null ends are ignored.
    No edges give no rows.
    """
    ends = edges.select("a", "b").where("a is not null and b is not null")
    alone = ends.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("component"))
    # every edge points from the larger node to the smaller
    edges = ends.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = written(edges, "edges")
    before = _state(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written, so that both sides of the joins are plain shuffles, which adaptive execution can split
        least = written(both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low")), "least")
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        large = written(large, "large-star")
        low = written(large.groupBy("a").agg(F.min("b").alias("low")), "low")
        small = large.join(low, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        edges = written(small.union(low.select("a", F.col("low").alias("b"))).distinct(), "small-star")
        after = _state(edges)
        if after == before:
            break
        before = after
    found = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return found.union(roots).union(alone).groupBy("node").agg(F.min("component").alias("component"))
