"""Toxicity by a classifier chain: categories in order, each model also fed the probabilities of the categories before it.

Later models learn from out-of-fold probabilities, so that they see earlier categories as they will at scoring time.  All models
are sparse linear ones over hashed words, word beginnings and byte 5-grams inside words, present or absent.  L1 leaves most
weights at zero, so a long clean text collects no noise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import linear
from .words import as_bytes, kept, mix, slices, word_hashes

#: Labelled rows that are learned from, at most: those with the smallest hash of their id.
MAX_LABELLED = 8_000
#: Folds of the out-of-fold probabilities.
FOLDS = 3
EPOCHS = 2
#: A document is rejected from this probability of the last category.
THRESHOLD = 0.5
GRAM = 5
#: Texts that are scored together.
TOGETHER = 256

_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _letters(text) -> bytes:
    """Lower-cased text with everything but letters and digits made a space."""
    b = np.frombuffer(as_bytes(text), np.uint8)
    return np.where(_LETTER[b], b, 32).astype(np.uint8).tobytes()


def _keys(texts: list[bytes], bits: int) -> np.ndarray:
    """(text number << bits | feature) of every feature occurrence of a batch."""
    h, first, starts, ends, a = word_hashes(texts)
    mask = np.uint64((1 << bits) - 1)
    doc = np.repeat(np.arange(len(texts), dtype=np.uint64), np.diff(first))
    out = [(doc << np.uint64(bits)) | (mix(h) & mask)]
    if len(a) > GRAM:
        wide = np.zeros(len(a) - GRAM + 1, np.uint64)
        for k in range(GRAM):
            wide = (wide << np.uint64(8)) | a[k : len(a) - GRAM + 1 + k]
        inside = np.flatnonzero(ends - starts >= GRAM)
        begin = np.zeros(len(a) + 1, np.int32)
        np.add.at(begin, starts[inside], 1)
        np.add.at(begin, ends[inside] - GRAM + 1, -1)
        at = np.flatnonzero(np.cumsum(begin[: len(wide)]))
        where = np.cumsum([len(t) + 1 for t in texts])
        d = np.searchsorted(where, at, side="right").astype(np.uint64)
        head = np.zeros(len(a), bool)
        head[starts] = True
        g = wide[at]
        out.append((d << np.uint64(bits)) | (mix(g + np.uint64(1 << 60)) & mask))
        lead = head[at]
        out.append((d[lead] << np.uint64(bits)) | (mix(g[lead] + np.uint64(1 << 61)) & mask))
    return np.concatenate(out)


def _present(texts: list[bytes], size: int, wanted: np.ndarray | None = None):
    """(features, first of each text), distinct per text; with ``wanted`` only features where it is true."""
    bits = size.bit_length() - 1
    key = _keys(texts, bits)
    mask = np.uint64(size - 1)
    if wanted is not None:
        key = key[wanted[(key & mask).astype(np.int64)]]
    key = np.unique(key)
    return (key & mask).astype(np.int64), np.searchsorted(key >> np.uint64(bits), np.arange(len(texts) + 1, dtype=np.uint64))


class Chain:
    """Weights of each category: hashed features, then the constant, then the earlier categories' log-odds."""

    def __init__(self, categories: list[str], weights: list[np.ndarray], size: int):
        self.categories, self.weights, self.size = categories, weights, size
        self.wanted = np.zeros(size, bool)
        for w in weights:
            self.wanted |= w[:size] != 0

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.weights)))
        for a, b in slices(texts):
            i, first = _present(texts[a:b], self.size, self.wanted)
            logits: list[np.ndarray] = []
            for k, w in enumerate(self.weights):
                v = linear.dots(w, i, np.ones(len(i)), first) + w[self.size]
                for e, x in enumerate(logits):
                    v = v + w[self.size + 1 + e] * x
                p = linear.sigmoid(v)
                logits.append(_logit(p))
                out[a:b, k] = p
        return out


def _logit(p):
    p = np.clip(p, 0.01, 0.99)
    return np.log(p / (1 - p)) / 5


def _trainer(k: int, known, size: int, n: int, epochs: int):
    """Trains category ``k`` of one model; ``known`` holds the fold models of the categories before it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        m = int(pdf["m"].iloc[0])
        texts, y, fold = [_letters(t) for t in pdf["text"]], list(pdf[f"y{k}"]), list(pdf["fold"])
        out = []
        for a, b in slices(texts):
            i, first = _present(texts[a:b], size)
            for t in range(b - a):
                f = i[first[t] : first[t + 1]]
                earlier: list[float] = []
                for e in range(k):  # the model that has not seen this row
                    w = known.value[e][fold[a + t]]
                    v = w[f].sum() + w[size] + sum(w[size + 1 + q] * x for q, x in enumerate(earlier))
                    earlier.append(float(_logit(linear.sigmoid(v))))
                i32 = np.concatenate((f, np.arange(size, size + 1 + k))).astype(np.int32)
                out.append((i32, np.concatenate((np.ones(len(f) + 1), earlier)).astype(np.float32), float(y[a + t])))
        w = linear.train(out, size + 1 + n, epochs, seed=23, alpha=0.1, l1=0.5, l2=0.1)
        return pd.DataFrame({"m": [m], "w": [w.tobytes()]})

    return run


def fit(documents: DataFrame, labels: DataFrame, categories: dict[str, str], id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED, folds: int = FOLDS, epochs: int = EPOCHS, bits: int = linear.BITS) -> Chain:
    """A chain over ``categories`` (name -> SQL for its 0/1 label over ``labels``), in their order.

    At most ``max_labelled`` labelled rows (smallest hash of the id) are learned from; rows without an id or with a null label
    are left out, repeated ids count once, with the smallest text.  Each fold's model and the full one are trained in tasks of their own, and only weight
    vectors of a fixed size reach the driver.  Without labelled texts every probability is 0.5.
    """
    names, size = list(categories), 1 << bits
    ys = [F.max(F.expr(e).cast("int")).alias(f"y{k}") for k, e in enumerate(categories.values())]
    chosen = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(*ys).dropna().orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    rows = rows.groupBy("id", *[f"y{k}" for k in range(len(names))]).agg(F.min("text").alias("text"))  # of rows that share an id, one
    rows = rows.withColumn("fold", F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(folds)))
    spark = documents.sparkSession
    full: list[np.ndarray] = []
    parts: list[dict[int, np.ndarray]] = []  # per category, per fold
    for k in range(len(names)):
        known = spark.sparkContext.broadcast(list(parts))

        run = _trainer(k, known, size, len(names), epochs)
        models = F.array(*[F.lit(m) for m in range(folds + 1)])
        each = rows.select("*", F.explode(models).alias("m")).where(F.col("m") != F.col("fold"))
        got = {r.m: np.frombuffer(r.w, np.float32) for r in each.groupBy("m").applyInPandas(run, "m int, w binary").collect()}
        empty = np.zeros(size + 1 + len(names), np.float32)
        full.append(got.get(folds, empty))
        parts.append({m: got.get(m, empty) for m in range(folds)})
    return Chain(names, full, size)


def score(documents: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, ``keep`` and one ``p_<category>`` per category for each row; a null text counts as empty.

    Python gets the text alone and gives back the probabilities: kept columns, a text among them, stay where they are.
    """
    shared = documents.sparkSession.sparkContext.broadcast(chain)
    names = [f"p_{c}" for c in chain.categories]
    src = [F.col(c) for c in kept(id_col, keep, *names)]
    if not names:
        return documents.select(*src)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            parts = [shared.value.probabilities([_letters(t) for t in texts.iloc[a : a + TOGETHER]]) for a in range(0, len(texts), TOGETHER)]
            yield pd.DataFrame(np.concatenate(parts) if parts else np.zeros((0, len(names))), columns=names)

    kind = T.StructType([T.StructField(n, T.DoubleType()) for n in names])
    # As one that may differ from call to call, it is run once for a row, and not for a filter again.
    p = F.pandas_udf(run, kind).asNondeterministic()
    return documents.select(*src, p(F.col(text_col)).alias("__p")).select("*", "__p.*").drop("__p")


#: The categories that the given labels hold: writing of low quality first, toxic second.
CATEGORIES = {"low_quality": "1 - quality", "toxic": "toxic"}


def digest(documents: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The registered query: doc_id, both probabilities and ``toxic`` (probability from ``THRESHOLD`` on)."""
    out = score(documents, fit(documents, labels, CATEGORIES), keep=keep)
    return out.withColumn("toxic", F.col("p_toxic") >= THRESHOLD)
