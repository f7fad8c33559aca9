"""SimHash near-dedup: documents whose 64-bit fingerprints differ in few bits, compared by bit slices.

A fingerprint's bit is set if it is set in over half of the hashes of the text's word shingles, repeats included.  The fingerprint is
cut into blocks; of two within the radius at least BLOCKS - radius blocks agree, so that buckets for each choice of so many blocks miss
no link.  A bucket holds distinct fingerprints; its pairs are compared in bit planes (``bitslice``) and only a forest of its links
leaves it.  A bucket of more than LIMIT fingerprints is cut into parts, and each two parts of it are a task's work of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitslice import BITS, forest
from .components import connected_components
from .scratch import Scratch
from .words import as_bytes

RADIUS = 4
#: Blocks of a fingerprint; RADIUS differing bits leave BLOCKS - RADIUS of them alike.
BLOCKS = 6
#: A task compares at most so many fingerprints of a bucket with each other.
LIMIT = 4096
#: Rows that a Python worker compares in one go, about.
_ROWS = 1 << 15
SEED = 42


def shingle_hashes(text: bytes, n_words: int = 4) -> np.ndarray:
    """XXH64 of each run of ``n_words`` words, space-joined; a shorter text is one shingle as a whole, a blank one has none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    k = min(n_words, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    cut = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    return np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in cut), np.uint64, len(words) - k + 1)


def fingerprint(text: bytes, n_words: int = 4) -> int:
    """Bit i is set if over half of the shingles' hashes have it; zero without words."""
    h = shingle_hashes(text, n_words)
    votes = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 1 << 14):  # bounds the bit table of a very long text
        votes += np.unpackbits(h[i : i + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(h), bitorder="little").view("<u8")[0]) if len(h) else 0


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = 4) -> DataFrame:
    """(id long, fp long) of each row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            prints = np.fromiter((fingerprint(as_bytes(t.as_py(), lower=False), n_words) for t in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(prints.view(np.int64))], names=["id", "fp"])

    src = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "id long, fp long")


def _masks(blocks: int, alike: int) -> list[int]:
    """The bits of each choice of ``alike`` blocks, as signed longs."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    block = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    return [int(np.uint64(sum(c)).astype(np.int64)) for c in combinations(block, alike)]


def _linked(radius: int):
    def compared(key: np.ndarray, fp: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        pairs = np.array(forest(key, fp.view(np.uint64), radius), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(node[pairs[:, 0]]), pa.array(node[pairs[:, 1]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]):
        """Batches sorted by slot; what belongs to the last slot of one waits for the next."""
        held = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            held = [np.concatenate((x, batch.column(c).to_numpy(zero_copy_only=False))) for x, c in zip(held, ("slot", "fp", "node"), strict=True)]
            if len(held[0]) >= _ROWS:
                cut = int(np.searchsorted(held[0], held[0][-1]))
                if cut:
                    yield compared(*(x[:cut] for x in held))
                    held = [x[cut:] for x in held]
        if len(held[0]):
            yield compared(*held)

    return run


def links(classes: DataFrame, scratch: Scratch, radius: int = RADIUS, blocks: int = BLOCKS, limit: int = LIMIT) -> DataFrame:
    """(a, b): pairs of nodes of ``classes`` (fp long, node long, one row per fingerprint) that connect all within ``radius`` bits.

    Links that connect nothing new within a bucket are left out, so that the pairs grow with the members of the buckets.
    """
    keys = [F.xxhash64(F.lit(n), F.col("fp").bitwiseAND(F.lit(m))) for n, m in enumerate(_masks(blocks, blocks - radius))]
    members = scratch.save(classes.select("fp", "node", F.explode(F.array(*keys)).alias("key")))
    size = members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    half = limit // 2
    # A member goes to the pairs of its own part with every part of its bucket; a bucket up to the limit is one part.
    parts = F.when(F.col("size") <= limit, F.lit(1)).otherwise((F.col("size") / half).cast("int") + 1)
    dealt = members.join(size, "key").withColumn("parts", parts).withColumn("part", F.expr("cast(pmod(xxhash64(fp, 7), parts) as int)"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    slot = F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other"))
    slots = dealt.select(slot.alias("slot"), "fp", "node").repartition("slot").sortWithinPartitions("slot", "fp")
    return slots.mapInArrow(_linked(radius), "a long, b long").distinct()


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = 4, radius: int = RADIUS, limit: int = LIMIT) -> DataFrame:
    """(id, fingerprint, component_id) for each row of ``documents``.

    The fingerprint is 16 hex digits; documents link at ``radius`` differing bits or fewer, and component_id is the smallest id
    reachable.  Null, empty and blank texts have the fingerprint zero and link like any other.  Rows that share an id are one
    document: what either text links is one component.  A row with a null id links nothing (component_id null).  Other columns are
    not read, and an empty table gives an empty one.
    """
    scratch = Scratch(documents.sparkSession, "simhash-dedup")
    rows = scratch.save(fingerprints(documents, id_col, text_col, n_words))
    known = rows.where("id is not null")
    classes = scratch.save(known.groupBy("fp").agg(F.min("id").alias("node")))
    # An id with several fingerprints joins their classes.
    several = known.groupBy("id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo < hi").select("id")
    same = known.join(several, "id").join(classes, "fp").select(F.col("id").alias("a"), F.col("node").alias("b"))
    component = connected_components(links(classes, scratch, radius, limit=limit).unionByName(same), scratch)
    named = classes.join(component.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").select("fp", F.coalesce("component", "node").alias("component"))
    out = rows.join(named, "fp", "left")
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.when(F.col("id").isNotNull(), F.col("component")).alias("component_id"))


__all__ = ["fingerprint", "fingerprints", "links", "near_duplicates", "shingle_hashes"]
