"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rosterline.llm.common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the larger (or the smaller) neighbours of every node on the node's least neighbour."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    back = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    # a > b in every edge. Large star looks at all neighbours, small star at smaller ones only.
    near = both.union(back) if large else both
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = near.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``a, b``): the least node that can be reached.

    Only minima are gathered per node, and joins have a unique right side, so a node may have any
    number of neighbours. Every step is written; the loop ends when the edges are stars.
    """
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct())

    def mark(frame: DataFrame):
        return tuple(frame.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    last = mark(now)
    while True:
        now = written(_star(written(_star(now, True)), False))
        seen = mark(now)
        if seen == last:
            break
        last = seen
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
