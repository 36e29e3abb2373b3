"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): component is the smallest node reachable.

    Large-star and small-star steps in turn: each links the neighbours of a node to the smallest of them, until all
    edges are stars around their component's smallest node.  The links stay in tables; the driver sees a row count and a
    checksum for each round.  The look-up side is a table of its own, so that a hub's rows can be split."""
    state = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                        .distinct(), "links")
    seen = None
    while True:
        now = tuple(state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())
        if now == seen or now[0] == 0:
            return state.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                state.select("v", "v").distinct())
        seen = now
        both = state.union(state.select("v", "u"))
        low = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = materialise(large.distinct(), "large")
        low = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        state = materialise(small.union(low).distinct(), "links")
