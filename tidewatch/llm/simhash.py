"""Document fingerprints: SimHash over weighted terms, and permuted block tables that find all within a Hamming radius.

Terms are words and pairs of adjacent words, lower-cased in A-Z, each with the weight 1 + ln(its count).  A term's hash votes
for each of 128 bits by its sign; the sum's sign is the fingerprint's bit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import as_bytes, kept, mix, slices, word_hashes

BITS = 128
#: Rows that one range of ids holds, about; the ranges only steer where rows go.
RANGE_ROWS = 2_000
#: A fingerprint's blocks, and the blocks that make a table's key: radius = BLOCKS - KEY.
BLOCKS, KEY = 5, 2


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """(texts, 16) bytes: a fingerprint for each text; one without words is all zero."""
    out = np.zeros((len(texts), BITS // 8), np.uint8)
    for a, b in slices(texts):
        h, first, *_ = word_hashes(texts[a:b])
        for t, (p, q) in enumerate(zip(first, first[1:], strict=False)):
            w = h[p:q]
            if not len(w):
                continue
            terms, count = np.unique(np.concatenate((w, mix(w[:-1] * np.uint64(31) + w[1:]))), return_counts=True)
            weight = (1 + np.log(count)).astype(np.float32)
            votes = np.zeros(BITS, np.float32)
            for i in range(0, len(terms), 1 << 14):  # bounds the bit table of a very long text
                part = terms[i : i + (1 << 14)]
                bits = np.unpackbits(np.stack((mix(part), mix(part ^ np.uint64(0x5DEECE66D))), 1).view(np.uint8), axis=1)
                votes += 2 * (weight[i : i + (1 << 14)] @ bits) - weight[i : i + (1 << 14)].sum()
            out[a + t] = np.packbits(votes > 0)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bits, row by row."""
    return 1 - np.unpackbits(a ^ b, axis=1).sum(axis=1) / BITS


def fingerprint(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, ``keep`` and fingerprint (32 hex digits) of each row; null counts as empty, equal texts have equal fingerprints."""

    def run(batches):
        for pdf in batches:
            yield pdf.drop(columns="__text").assign(fingerprint=[f.tobytes().hex() for f in fingerprints([as_bytes(t) for t in pdf["__text"]])])

    src = documents.select(*[F.col(c) for c in kept(id_col, keep, "fingerprint")], F.col(text_col).alias("__text"))
    return src.mapInPandas(run, src.drop("__text").schema.add("fingerprint", "string"))


def within_radius(queries: DataFrame, prints: DataFrame, id_col: str = "id", fp_col: str = "fingerprint", blocks: int = BLOCKS, key: int = KEY) -> DataFrame:
    """(query, match, distance): for each distinct fingerprint of ``queries`` all fingerprints of ``prints`` within ``blocks - key`` bits.

    The fingerprint is cut into ``blocks`` blocks.  Of two within the radius at least ``key`` blocks agree, so a table for each
    choice of ``key`` blocks, keyed by them, misses none.  Equal fingerprints are one row of the tables, named by the smallest id
    on either side; ids and fingerprints that are null are left out.
    """
    edges = [round(i * 32 / blocks) for i in range(blocks + 1)]

    def tables(df, name):
        one = df.where(F.col(id_col).isNotNull() & F.col(fp_col).isNotNull()).groupBy(F.col(fp_col).alias(f"{name}_fp")).agg(F.min(id_col).alias(name))
        keys = [F.struct(F.lit(n).alias("n"), *[F.substring(f"{name}_fp", edges[b] + 1, edges[b + 1] - edges[b]).alias(f"b{k}") for k, b in enumerate(c)]) for n, c in enumerate(combinations(range(blocks), key))]
        return one.select(name, f"{name}_fp", F.explode(F.array(*keys)).alias("key"))

    pairs = tables(queries, "query").join(tables(prints, "match"), "key")
    apart = [F.bit_count(F.conv(F.substring("query_fp", i, 8), 16, 10).cast("long").bitwiseXOR(F.conv(F.substring("match_fp", i, 8), 16, 10).cast("long"))) for i in (1, 9, 17, 25)]
    found = pairs.withColumn("distance", sum(apart[1:], apart[0])).where(F.col("distance") <= blocks - key)
    return found.select("query", "match", "distance").distinct()


def _edited(text: str, after: str) -> str:
    """The last half replaced by as much of the beginning of the text that follows."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def _range_of(column, bounds: list):
    """Number of a descending id range: how many bounds are larger; a null id is in the last."""

    @F.pandas_udf("long")
    def number(ids: pd.Series) -> pd.Series:
        at = len(bounds) - np.searchsorted(np.array(bounds), ids.fillna(0).to_numpy(np.int64), side="left")
        return pd.Series(np.where(ids.isna(), len(bounds), at))

    return number(column)


def with_next(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_rows: int = RANGE_ROWS) -> DataFrame:
    """Each row with its text's and its edited text's fingerprint and what they have in common with the next row's.

    Rows are in descending id order, null ids last and repeated ids by text; after the last comes the first.  Ids are cut into
    ranges, each a sorted run within a task; the row that heads a range also goes to the range before it, so that a row and
    its successor always meet.  Only range bounds and heads' ids, one for some thousand rows, are gathered.
    """
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    n = docs.count()
    if not n:
        return documents.sparkSession.createDataFrame([], _NEXT)
    parts = max(1, n // range_rows)
    bounds = sorted(set(docs.approxQuantile("id", [i / parts for i in range(1, parts)], 0.1 / parts))) if parts > 1 else []
    at = docs.withColumn("range", _range_of(F.col("id"), [int(b) for b in bounds]))
    heads = {r["range"]: r.head for r in at.groupBy("range").agg(F.max("id").alias("head")).collect()}
    order = sorted(heads)
    before = {r: order[i - 1] for i, r in enumerate(order)}  # the first range's head also ends the last
    to = documents.sparkSession.createDataFrame([(r, heads[r], before[r]) for r in order], "range long, head long, to long")
    ghosts = at.join(F.broadcast(to), "range").where(F.col("id").eqNullSafe(F.col("head"))).select("id", "text", F.col("to").alias("range"), F.lit(True).alias("ghost"))
    both = at.withColumn("ghost", F.lit(False)).unionByName(ghosts)
    # A range of one head alone, or one range, has its ghosts sorted behind its rows.
    dealt = both.repartition(max(1, len(order)), "range").sortWithinPartitions("range", "ghost", F.col("id").desc_nulls_last(), "text")

    def run(batches: Iterator[pd.DataFrame]):
        rest: list[tuple] = []
        for pdf in batches:
            rows = rest + list(zip(pdf["range"], pdf["ghost"], pdf["id"].astype(object).where(pdf["id"].notna(), None), pdf["text"], strict=True))
            yield from _compared(rows)
            rest = rows[-1:]

    return dealt.mapInPandas(run, _NEXT)


_NEXT = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(rows: list[tuple], step: int = 500):
    """Results of all rows but the last, which only follows: a ghost, or the first row of the batch to come."""
    text = [t if isinstance(t, str) else "" for *_, t in rows]
    for a in range(0, len(rows) - 1, step):
        b = min(a + step, len(rows) - 1)
        own = fingerprints([as_bytes(t) for t in text[a : b + 1]])
        edited = [_edited(text[i], text[i + 1]) for i in range(a, b)]
        other = fingerprints([as_bytes(t) for t in edited])
        near, after = likeness(own[:-1], other), likeness(own[:-1], own[1:])
        keep = [i for i in range(a, b) if not rows[i][1]]
        yield pd.DataFrame(
            {
                "id": pd.array([None if rows[i][2] is None else int(rows[i][2]) for i in keep], "Int64"),
                "n_chars": [len(text[i]) for i in keep],
                "edited_sha256": [hashlib.sha256(edited[i - a].encode("utf-8", "surrogatepass")).hexdigest() for i in keep],
                "fingerprint": [own[i - a].tobytes().hex() for i in keep],
                "edited_fingerprint": [other[i - a].tobytes().hex() for i in keep],
                "near_edited": [float(near[i - a]) for i in keep],
                "near_next": [float(after[i - a]) for i in keep],
            }
        )


def digest(documents: DataFrame) -> DataFrame:
    """The registered query's columns."""
    return with_next(documents).withColumnRenamed("id", "doc_id")
