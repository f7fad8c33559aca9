"""Exact Jaccard join of sets in different groups, by prefix filtering on rare elements.

The elements of each set are ordered by how many sets hold them, rarest first.  Two sets that are alike enough must then share
an element near both fronts, and the places at which they share it bound what they can have in common; pairs that pass both
filters are confirmed by the caller.  No set is left out and no key is capped: the pairs of a frequent element are dealt out in
blocks.  Where only the groups count, ``star_pairs`` goes first: a few pairs for each set, whose links merge most groups of a
crowd of near copies, so that the pairs inside them are no longer between different groups.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import Scratch

#: An element that more sets hold has its pairs dealt out in blocks of so many sets.
BLOCK = 500
#: Centres of an element in ``star_pairs``.
CENTRES = 8


def fronts(sets: DataFrame, percent: int) -> DataFrame:
    """(id, label, n, short, at, g, blocks): the rare elements g of the rows (id, label, s), by which sets that are alike enough must meet."""
    # An inner explode would have a set that is worked out made twice, for a filter on its size; the null of an empty set goes.
    single = sets.select("id", "label", F.explode_outer("s").alias("g")).where("g is not null")
    common = single.groupBy("g").agg(F.count(F.lit(1)).alias("f"))
    # Merged: what is exploded is sized by the far smaller table that it comes from, by which Spark would broadcast it.
    both = single.join(common.hint("merge"), "g")
    own = Window.partitionBy("id", "label")
    ordered = both.select("id", "label", "g", "f", F.count(F.lit(1)).over(own).cast("int").alias("n"), (F.row_number().over(own.orderBy("f", "g")) - 1).alias("at"))
    # Of a pair, the smaller set shares within its n - ceil(2pn / (100 + p)) + 1 first elements, the larger within n - ceil(pn / 100) + 1.
    p = percent
    ordered = ordered.withColumn("short", F.expr(f"n - cast(ceil({2 * p} * n / {100 + p}D - 1e-9) as int) + 1")).withColumn("long", F.expr(f"n - cast(ceil({p} * n / 100D - 1e-9) as int) + 1"))
    front = ordered.where("at < long and f > 1")
    return front.select("id", "label", "n", "short", "at", "g", F.expr(f"cast(f div {BLOCK} as int) + 1").alias("blocks"))


def star_pairs(front: DataFrame, percent: int) -> DataFrame:
    """(a, b), the smaller id first: each row of ``fronts`` with up to ``CENTRES`` others of its element, in groups that differ.

    The centres are the first in an order that is the same for all elements, so that few sets are centres of many.
    """
    spread = F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(CENTRES)).alias("part")
    centre = front.groupBy("g", spread).agg(F.min(F.struct(F.xxhash64(F.lit(2), "id").alias("h"), F.col("id").alias("x"), F.col("label").alias("lx"), F.col("n").alias("nx"), F.col("at").alias("i"))).alias("c"))
    both = front.join(centre.select("g", "c.*").hint("merge"), "g").where(
        f"label != lx and 100 * least(n, nx) >= {percent} * greatest(n, nx) and {100 + percent} * least(n - at, nx - i) >= {percent} * (n + nx)"
    )
    return both.select(F.least("id", "x").alias("a"), F.greatest("id", "x").alias("b")).distinct()


def front_pairs(front: DataFrame, percent: int) -> DataFrame:
    """(a, b), the smaller id first: of the rows of ``fronts`` all pairs of different groups that may be alike enough, each once."""
    p = percent
    # Each set as the larger one goes to one block, as the smaller one to all blocks of its element.
    larger = front.select(F.col("id").alias("y"), F.col("label").alias("ly"), F.col("n").alias("ny"), F.col("at").alias("j"), "g", F.expr("cast(pmod(xxhash64(id), blocks) as int)").alias("block"))
    smaller = front.where("at < short").select(F.col("id").alias("x"), F.col("label").alias("lx"), F.col("n").alias("nx"), F.col("at").alias("i"), "g", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"))
    both = smaller.join(larger.hint("merge"), ["g", "block"]).where(
        f"lx != ly and (nx < ny or nx = ny and x < y) and 100 * nx >= {p} * ny and {100 + p} * least(nx - i, ny - j) >= {p} * (nx + ny)"
    )
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def candidate_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the rows (id, label, s) whose labels differ; among them every pair with ``100 * intersection >= percent * union``.

    ``s`` holds distinct longs.  A pair comes once, the smaller id first.
    """
    return front_pairs(fronts(sets, percent), percent)


def exact_links(sets: DataFrame, percent: int, confirm: Callable[[DataFrame], DataFrame], scratch: Scratch) -> DataFrame:
    """(k, c) that ``confirm`` finds alike among pairs (k, c) of the rows (id, label, s).

    They connect, with the labels, all that the links of all pairs connect: pairs of groups that the stars have linked are left out.
    """
    front = scratch.save(fronts(sets, percent))
    stars = scratch.save(star_pairs(front, percent).select(F.col("b").alias("k"), F.col("a").alias("c")))
    first = scratch.save(confirm(stars))
    label = scratch.save(front.select("id", "label").distinct())
    ends = first.join(label.toDF("k", "u"), "k").join(label.toDF("c", "v"), "c")
    merged = connected_components(ends, scratch, "u", "v").withColumnRenamed("node", "label")
    relabelled = front.join(merged, "label", "left").withColumn("label", F.coalesce("component", "label")).drop("component")
    pairs = front_pairs(relabelled, percent).select(F.col("b").alias("k"), F.col("a").alias("c"))
    pairs = scratch.save(pairs.join(stars, ["k", "c"], "left_anti"))
    scratch.drop(front, stars, label)
    return first.unionByName(confirm(pairs))


__all__ = ["candidate_pairs", "exact_links", "front_pairs", "fronts", "star_pairs"]
