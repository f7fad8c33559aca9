"""Distributed union-find: connected components by alternating large-star and small-star steps.

Every step is a min-aggregation and an equi-join, so no neighbourhood is ever gathered in one task: the aggregation combines
before the shuffle, and the join has one row per key on one side, so that adaptive execution can split a hot key of the other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _mark(df: DataFrame):
    """Row count and an order-free digest: equal marks mean that a step changed nothing."""
    return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(node long, component long) for every node of ``edges``; component is the smallest node reachable.

    Null ends and loops are ignored, repeated edges count once; no edges give an empty table.  The number of rounds grows
    with the logarithm of the longest path; star-shaped input takes two.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    e = scratch.save(e)
    mark = _mark(e)
    while mark[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        # The second row of each node: its link to its own minimum.
        small = joined.select(
            F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")
        ).select("x.u", "x.v").where("u > v").distinct()
        last, e = e, scratch.save(small)
        scratch.drop(last)
        now = _mark(e)
        if now == mark:
            break
        mark = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
