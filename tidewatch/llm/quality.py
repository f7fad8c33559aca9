"""Quality classifier: logistic regression on hashed word n-grams, FTRL updates, scores as sparse dot products.

Features of a text are its word n-grams (n = 1, 2), once over the words as they stand and once over their shapes (runs of
capitals, small letters, digits and each other character), hashed into one space.  A feature's value is its share of the n-grams
of its kind, square-rooted, so that a text's length does not move its score.  A further flag marks a pair of equal words.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linear
from .words import as_bytes, kept, mix, slices, word_hashes

#: Labelled rows that are learned from, at most: those with the smallest hash of their id.
MAX_LABELLED = 20_000
#: Models trained side by side on disjoint shares of the sample, then averaged.
SHARDS = 4
EPOCHS = 4
#: What a feature's value is multiplied by: it sets the pace of learning against the regularisation.
SCALE = 4.0

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91] = 65
_SHAPE[97:123] = 97
_SHAPE[128:] = 97  # letters beyond ASCII count as small ones
_SHAPE[48:58] = 48


def _shape_hashes(starts: np.ndarray, ends: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Hash of each word with its runs of one class cut to one character."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    s = _SHAPE[a]
    keep = np.concatenate(([True], s[1:] != s[:-1]))
    pos = np.concatenate(([0], np.cumsum(keep)))
    v = mix(s[keep].astype(np.uint64))
    first, last = pos[starts], pos[ends]
    k = np.arange(len(v), dtype=np.uint64)
    # Position-dependent sum: multiply by odd powers relative to the word's start.
    own = np.zeros(len(v) + 1, np.int64)
    np.add.at(own, first, 1)
    rel = k - first[np.maximum(np.cumsum(own[:-1]) - 1, 0)].astype(np.uint64)
    c = np.concatenate(([np.uint64(0)], np.cumsum(v * (mix(rel + np.uint64(7)) | np.uint64(1)))))
    return mix(c[last] - c[first])


def features(texts: list[bytes], bits: int = linear.BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature numbers, values, first of each text) of a batch; feature 0 is the constant of every text."""
    h, first, starts, ends, a = word_hashes(texts)
    shape = _shape_hashes(starts, ends, a)
    n = np.diff(first)
    doc = np.repeat(np.arange(len(texts)), n)
    last = np.ones(len(h), bool)
    last[first[1:][n > 0] - 1] = False  # a pair does not cross texts
    last = last & (np.arange(len(h)) < len(h) - 1)
    pair = np.flatnonzero(last)
    kinds = [(h, doc), (shape, doc)]
    for v in (h, shape):
        kinds.append((mix(v[pair] * np.uint64(31) + v[pair + 1]), doc[pair]))
    kinds.append((np.full((same := h[pair] == h[pair + 1]).sum(), 5, np.uint64), doc[pair][same]))
    mask = np.uint64((1 << bits) - 1)
    key = np.concatenate([(d.astype(np.uint64) << np.uint64(bits)) | (mix(v + np.uint64(k)) & mask) for k, (v, d) in enumerate(kinds)] + [np.arange(len(texts), dtype=np.uint64) << np.uint64(bits)])
    key, count = np.unique(key, return_counts=True)
    at = (key >> np.uint64(bits)).astype(np.int64)
    i = (key & mask).astype(np.int64)
    x = SCALE * np.sqrt(count / np.maximum(n[at], 1))
    x[i == 0] = 1.0
    return i, x, np.searchsorted(at, np.arange(len(texts) + 1))


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = MAX_LABELLED, shards: int = SHARDS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights learned from at most ``max_labelled`` rows of ``labels`` (id, 0 or 1).

    Rows without an id or a label are left out and repeated ones count once; of documents that share an id the smallest text counts.  The ids chosen are a set of proven size, so they
    go to every task and only their texts are shuffled; each shard's model is trained in a task of its own and only the
    weight vectors, a fixed size each, reach the driver.  Without labelled texts all weights are zero and every score is 0.5.
    """
    chosen = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
        .where("id is not null and y in (0, 1)")
        .groupBy("id").agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    )
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    rows = rows.groupBy("id", "y").agg(F.min("text").alias("text"))  # of rows that share an id, one

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        texts, y, out = [as_bytes(t, lower=False) for t in pdf["text"]], list(pdf["y"]), []
        for a, b in slices(texts):
            i, x, first = features(texts[a:b])
            out += [(i[p:q], x[p:q], float(v)) for p, q, v in zip(first, first[1:], y[a:b], strict=False)]
        w = linear.train(out, 1 << linear.BITS, epochs, seed=11, alpha=0.3, l1=0.3, l2=0.01)
        return pd.DataFrame({"w": [w.tobytes()], "n": [len(out)]})

    shard = F.pmod(F.xxhash64("id"), F.lit(shards))
    parts = rows.groupBy(shard.alias("shard")).applyInPandas(run, "w binary, n long").collect()
    total = sum(p.n for p in parts)
    w = np.zeros(1 << linear.BITS)
    for p in parts:
        w += np.frombuffer(p.w, np.float32) * (p.n / total)
    return w.astype(np.float32)


def score(documents: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, ``keep`` and score (probability of label 1) of each row.  A null text scores as an empty one: the constant alone."""
    shared = documents.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        for pdf in batches:
            texts, out = [as_bytes(t, lower=False) for t in pdf["__text"]], []
            for a, b in slices(texts):
                out.append(linear.sigmoid(linear.dots(shared.value, *features(texts[a:b]))))
            yield pdf.drop(columns="__text").assign(score=np.concatenate(out) if out else [])

    src = documents.select(*[F.col(c) for c in kept(id_col, keep, "score")], F.col(text_col).alias("__text"))
    return src.mapInPandas(run, src.drop("__text").schema.add("score", "double"))


def held_out(id_col, folds: int, fold: int):
    """Whether crc32 of the id as text leaves ``fold``; a null id is never held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def digest(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The registered query: learn from labels outside the held-out third, score everything."""
    w = fit(documents, labels.where(~held_out("doc_id", 3, 1)))
    return score(documents, w).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
