"""MinHash near-duplicates: one-permutation hashing with optimal densification, banded buckets, star-shaped candidate edges.

Each distinct shingle is hashed once; the hash picks a bin and the smallest value of a bin is one signature component.  An
empty bin takes the value of a filled one chosen by its own fixed random order of bins, so that equal sets densify alike.
Bands of the signature are buckets.  In a bucket only the edges of a star are candidates, so pairs grow with the members and
not with their square; every candidate is confirmed on the full shingle sets.  Where the members of a bucket still lie in
different components afterwards, they get a finer signature: buckets of its pairs of bands separate groups that the first ones mix,
and take a centre each.  Documents of fine buckets that are split even then are compared by
an exact prefix-filter join: no pair in them is given up.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .prefix_join import candidate_pairs
from .scratch import Scratch
from .stars import link_buckets, split_buckets
from .words import as_bytes, mix, shingles, slices, word_hashes

#: 26 bands of 5 rows: a pair at 0.8 shares a bucket with probability 1 - 3e-5, one at 0.5 with 0.56.
BANDS, ROWS = 26, 5
#: The finer signature.  Documents meet if two of its bands agree: of pairs at 0.8 that is 99 in 100; a given two bands agree at 0.6 in 5 of 100.
FINE_BANDS, FINE_ROWS = 10, 3
#: Centres of a fine bucket before its documents go to the exact join.
ROUNDS = 1

_BINS = BANDS * ROWS
_ORDER = np.argsort(np.random.default_rng(77).random((_BINS, _BINS)), axis=1)


def signature(s: np.ndarray, bins: int = _BINS) -> np.ndarray:
    """One-permutation MinHash of a non-empty set of 64-bit hashes, densified."""
    h = mix(s + np.uint64(0x51ED270B0A1B2C3D))
    at = ((h >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.intp)
    sig = np.full(bins, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(sig, at, h)
    filled = np.zeros(bins, bool)
    filled[at] = True
    if not filled.all():
        empty = np.flatnonzero(~filled)
        order = _ORDER[empty] if bins == _BINS else np.argsort(mix(np.arange(bins * bins, dtype=np.uint64)).reshape(bins, bins), axis=1)[empty]
        sig[empty] = sig[order[np.arange(len(empty)), filled[order].argmax(axis=1)]]
    return sig


def bands(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One bucket key per band; the band number is part of the key."""
    s = sig.reshape(-1, rows)
    k = np.arange(1, len(s) + 1, dtype=np.uint64)
    for i in range(rows):
        k = mix(k * np.uint64(0x9FB21C651E98DF25) + s[:, i])
    return k.view(np.int64)


def _signatures(n_words: int):
    def run(batches):
        for pdf in batches:
            texts = [as_bytes(t) for t in pdf["text"]]
            size, one, two, keys = [], [], [], []
            for i, j in slices(texts):
                h, first, *_ = word_hashes(texts[i:j])
                for a, b in zip(first, first[1:], strict=False):
                    s = shingles(h[a:b], n_words)
                    size.append(len(s))
                    # Two sums over the set: together they stand for the exact set.
                    one.append(int(np.add.reduce(s).astype(np.int64)) if len(s) else 0)
                    two.append(int(np.add.reduce(mix(s ^ np.uint64(0xABCDEF12345))).astype(np.int64)) if len(s) else 0)
                    keys.append(bands(signature(s)) if len(s) else [])
            yield pdf[["id"]].assign(n=size, h1=one, h2=two, keys=keys)

    return run


def _sets(n_words: int):
    def run(batches):
        for pdf in batches:
            texts = [as_bytes(t) for t in pdf["text"]]
            out = []
            for i, j in slices(texts):
                h, first, *_ = word_hashes(texts[i:j])
                out += [shingles(h[a:b], n_words).view(np.int64) for a, b in zip(first, first[1:], strict=False)]
            yield pdf[["id"]].assign(s=out)

    return run


def _fine(batches):
    """(k, key): a key for each two bands of a set's finer signature."""
    i, j = np.triu_indices(FINE_BANDS, 1)
    for pdf in batches:
        keys = []
        for s in pdf["s"]:
            b = bands(signature(np.asarray(s, np.int64).view(np.uint64), FINE_BANDS * FINE_ROWS), FINE_ROWS).view(np.uint64)
            keys.append(mix(mix(b[i]) + b[j]).view(np.int64))
        yield pd.DataFrame({"k": np.repeat(pdf["id"].to_numpy(), len(i)), "key": np.concatenate(keys)}) if keys else pd.DataFrame({"k": [], "key": []}, dtype=np.int64)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (k, c) whose full sets (id, n, s) are alike enough; those whose sizes rule it out are dropped before any set moves."""
    size = sets.select("id", "n")
    fit = pairs.join(size.toDF("k", "nk"), "k").join(size.toDF("c", "nc"), "c").where(f"100 * least(nk, nc) >= {percent} * greatest(nk, nc)").select("k", "c")
    left = fit.join(sets.select(F.col("id").alias("k"), F.col("s").alias("sk")), "k")
    both = left.join(sets.select(F.col("id").alias("c"), F.col("s").alias("sc")), "c")
    inter = F.size(F.array_intersect("sk", "sc")).cast("long")
    return both.select("k", "c", inter.alias("i"), (F.size("sk") + F.size("sc")).alias("t")).where(100 * F.col("i") >= percent * (F.col("t") - F.col("i"))).select("k", "c")


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row of ``documents``.

    Documents are linked if ``100 * intersection >= percent * union`` of their word-shingle sets; component_id is the smallest
    id reachable and kept marks it.  Null, empty and blank texts have no shingles and are linked with nothing.  Rows that share
    an id are one document; a row with a null id takes part in no link (component_id null, kept true).  Other columns are not
    read, and an empty table gives an empty one.
    """
    scratch = Scratch(documents.sparkSession, "minhash")
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = scratch.save(docs.mapInPandas(_signatures(n_words), "id long, n int, h1 long, h2 long, keys array<long>"))

    # Copies with the same set are one class, named by its smallest id; only that one goes on.
    linkable = rows.where("id is not null and n > 0")
    classes = scratch.save(linkable.groupBy("h1", "h2").agg(F.min("id").alias("rep")))
    known = scratch.save(linkable.select("id", "h1", "h2").join(classes, ["h1", "h2"]).select("id", "rep").distinct())
    reps = rows.join(known.where("id = rep").select("id").distinct(), "id", "left_semi")
    single = reps.select(F.col("id").alias("k"), F.explode("keys").alias("key"))
    centre = scratch.save(single.groupBy("key").agg(F.min("k").alias("c"), F.max("k").alias("hi")).where("c < hi").select("key", "c"))
    buckets = scratch.save(single.join(centre, "key").select("key", "k", "c"))

    # Sets of the documents that share a bucket with another one, for all that follows.
    texts = docs.join(buckets.select(F.col("k").alias("id")).distinct(), "id", "left_semi")
    sets = scratch.save(texts.mapInPandas(_sets(n_words), "id long, s array<long>").dropDuplicates(["id"]).withColumn("n", F.size("s")))

    def confirm(pairs):
        return _verified(pairs, sets, percent)

    linked = scratch.save(confirm(buckets.where("k != c").select("k", "c").distinct()))
    split, linked = split_buckets(buckets.select("key", "k"), linked, scratch)
    split = split.select(F.col("k").alias("id")).distinct()
    fine = scratch.save(sets.select("id", "s").join(split, "id").mapInPandas(_fine, "k long, key long"))
    linked, rest = link_buckets(fine, linked, confirm, scratch, ROUNDS)
    # What still shares a bucket with documents of other components is resolved exactly.
    left, linked = split_buckets(rest, linked, scratch)
    left = left.select(F.col("k").alias("id"), "label").distinct()
    exact = scratch.save(candidate_pairs(scratch.save(left.join(sets.select("id", "s"), "id")), percent))
    linked = linked.unionByName(confirm(exact.select(F.col("b").alias("k"), F.col("a").alias("c"))))
    links = known.where("id != rep").select(F.col("rep").alias("a"), F.col("id").alias("b")).unionByName(linked.select(F.col("c").alias("a"), F.col("k").alias("b")))
    component = connected_components(links, scratch)
    out = rows.select("id", "n").join(component.withColumnRenamed("node", "id"), "id", "left")
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").cast("long").alias("n_shingles"),
        F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component", "id"), F.lit(True)).alias("kept"),
    )


__all__ = ["bands", "near_duplicates", "signature"]
