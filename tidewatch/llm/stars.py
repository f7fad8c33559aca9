"""Star-shaped candidate pairs in buckets, one centre after another, without all pairs of a bucket."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import Scratch

def split_buckets(members: DataFrame, linked: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(key, k, label) of the buckets whose members (key, k) lie in different components of ``linked`` (k, c), and the components as stars (k, c).

    The stars connect what ``linked`` connects, so that it need not be looked at again.
    """
    label = connected_components(linked, scratch, "k", "c").select(F.col("node").alias("k"), "component")
    members = members.join(label, "k", "left").select("key", "k", F.coalesce("component", "k").alias("label"))
    members = scratch.save(members)
    split = scratch.save(members.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key"))
    out = scratch.save(members.join(split, "key"))
    scratch.drop(members, split)
    return out, label.where("k != component").withColumnRenamed("component", "c")


def link_buckets(members: DataFrame, linked: DataFrame, confirm: Callable[[DataFrame], DataFrame], scratch: Scratch, rounds: int) -> tuple[DataFrame, DataFrame]:
    """(links (k, c) that connect what ``linked`` does and what ``confirm`` finds among pairs, what is left of ``members`` without the centres).

    In each round a bucket that is still split pairs its members with one centre.  A member's weight is with how many it shares
    buckets: the least changed one of a group has the most, so that one serves many buckets.  Later rounds take members in an
    order of their own, the same in all buckets, so that buckets with the same members test the same pairs.  The caller sees to
    what is left after ``rounds``.
    """
    size = scratch.save(members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    shared = scratch.save(members.join(size, "key"))
    weight = scratch.save(shared.groupBy("k").agg(F.sum("size").alias("weight")))
    rest = shared.select("key", "k")
    for turn in range(rounds):
        still, linked = split_buckets(rest, linked, scratch)
        ranked = scratch.save(still.join(weight, "k"))
        order = F.struct(F.xxhash64("k", F.lit(turn)), "k") if turn else F.struct("weight", "k")
        centre = scratch.save(ranked.groupBy("key").agg(F.max_by(F.struct("k", "label"), order).alias("c")))
        around = scratch.save(ranked.join(centre, "key").where("k != c.k").select("key", "k", "label", "c"))
        scratch.drop(still, ranked, centre, size if turn == 0 else last, *([shared] if turn == 0 else []))
        pairs = scratch.save(around.where("label != c.label").select(F.greatest("k", "c.k").alias("k"), F.least("k", "c.k").alias("c")).distinct())
        more = scratch.save(confirm(pairs))
        linked = scratch.save(linked.unionByName(more))
        scratch.drop(pairs, more)
        rest, last = around.select("key", "k"), around
    return linked, rest


__all__ = ["link_buckets", "split_buckets"]
