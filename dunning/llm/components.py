"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root`` (smallest node reachable) for every node of an
    edge; nodes of one comparable type, nulls and loops ignored.

    Alternating large-star and small-star steps: each step relinks a node's
    neighbours to the smallest of them, with a map-side minimum for each node,
    so no neighbourhood is gathered anywhere; every round is written to the
    shared folder.  Ends when a round leaves the edges as they were.
    """
    both = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct()
    both = stage(both, "edges")
    mark = _signature(both)
    while True:
        # large star: neighbours larger than the node go to the smallest of node and neighbours
        all_ways = both.union(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = all_ways.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = all_ways.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        # small star: the smaller neighbours and the node go to the smallest neighbour
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        moved = large.join(low, "u")
        small = moved.filter("v > low").select(F.col("v").alias("u"), F.col("low").alias("v")).union(low.select("u", F.col("low").alias("v")))
        both = stage(small.distinct(), "edges")
        before, mark = mark, _signature(both)
        if mark == before:
            break
    stars = both.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(both.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root")))


def _signature(edges: DataFrame):
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
