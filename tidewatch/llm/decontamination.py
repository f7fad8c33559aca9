"""Benchmark decontamination: one Aho-Corasick automaton over the normalised benchmark, each text scanned once.

Words are runs of ASCII letters and digits and of all other non-ASCII characters, lower-cased in A-Z.  Normalising maps every
other byte to a space and puts one space around each word, so that a window of words is a byte string with a space at either
end and the automaton finds it at word borders only.  Spaces counted before a match give its first word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import kept

WINDOW = 13
#: Bytes of benchmark text in one automaton.  A larger benchmark is scanned for in several blocks, each with its own automaton.
BLOCK_BYTES = 8 << 20

_SPAN = T.StructType().add("start", T.LongType()).add("end", T.LongType())
_MAP = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def normalise(text) -> list[bytes]:
    """Words of a text; null has none."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(_MAP).split()


def windows(words: list[bytes], n: int = WINDOW) -> set[bytes]:
    """Distinct windows of an item as padded byte strings; a shorter, not empty item is one window."""
    k = min(n, len(words))
    return {b" " + b" ".join(words[i : i + k]) + b" " for i in range(len(words) - k + 1)} if k else set()


def build(items: list[tuple[int, str]], n: int = WINDOW):
    """The automaton of all windows of ``items``: each pattern holds its number of words and the items that have it."""
    import ahocorasick

    owners: dict[bytes, set] = {}
    for item, text in items:
        for w in windows(normalise(text), n):
            owners.setdefault(w, set()).add(item)
    a = ahocorasick.Automaton()
    for w, who in owners.items():
        a.add_word(w.decode("latin-1"), (w.count(b" ") - 1, len(w), tuple(who)))
    if owners:
        a.make_automaton()
    return a


def word_offsets(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word in the original text, in code points."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    word = np.frombuffer(_MAP, np.uint8)[raw] != 32
    edge = np.flatnonzero(np.diff(np.concatenate(([0], word, [0])).astype(np.int8)))
    before = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))  # code points before each byte
    return before[edge[::2]], before[edge[1::2]]


def scan(automaton, text, spans: bool = False):
    """(words, hit words, items, merged spans in code points of the original) of one text."""
    words = normalise(text)
    n = len(words)
    if not n or not len(automaton):
        return n, 0, (), []
    s = (b" " + b" ".join(words) + b" ").decode("latin-1")
    found = [(end + 1 - size, k, who) for end, (k, size, who) in automaton.iter(s)]
    if not found:
        return n, 0, (), []
    space = np.flatnonzero(np.frombuffer(s.encode("latin-1"), np.uint8) == 32)
    depth = np.zeros(n + 1, np.int32)
    items: set = set()
    first = np.searchsorted(space, [x[0] for x in found])
    np.add.at(depth, first, 1)
    np.add.at(depth, first + [x[1] for x in found], -1)
    for _, _, who in found:
        items.update(who)
    hit = np.cumsum(depth[:n]) > 0
    out = []
    if spans:
        start, end = word_offsets(text)
        edge = np.flatnonzero(np.diff(np.concatenate(([0], hit, [0])).astype(np.int8)))
        out = [(int(start[i]), int(end[j - 1])) for i, j in zip(edge[::2], edge[1::2], strict=True)]
    return n, int(hit.sum()), items, out


def benchmark_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> list[list[tuple]]:
    """The items in blocks of at most ``block_bytes`` bytes (a larger single item is a block), gathered block by block."""
    items = benchmark.where(F.col(text_col).isNotNull()).select(F.col(item_col).alias("i"), F.col(text_col).alias("t"))
    blocks, size = [[]], 0
    for row in items.toLocalIterator():
        if size and size + len(row.t) > block_bytes:
            blocks.append([])
            size = 0
        blocks[-1].append((row.i, row.t))
        size += len(row.t)
    return blocks


def contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Each row of ``documents`` with n_words, n_hit, items (sorted item ids as strings), spans and contaminated, plus ``keep``.

    Contaminated: some word is hit and at least a twentieth of the words are.  Null and empty texts have no words and are
    clean; null item texts hold nothing; repeated items and rows count as they stand; an empty benchmark leaves all clean.
    The benchmark is a stated query set held to ``block_bytes`` per automaton: a task holds all blocks in turn, one pass each,
    and merges their hits, so that no window is left out however large the benchmark is.
    """
    blocks = benchmark_blocks(benchmark, item_col, item_text_col, block_bytes)
    shared = documents.sparkSession.sparkContext.broadcast(blocks)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        only = build(shared.value[0], window) if len(shared.value) == 1 else None
        for texts in map(list, batches):
            if only is not None:
                rows = [scan(only, t, True) for t in texts]
            else:
                rows = _merged(shared.value, texts, window)
            spans = [[{"start": a, "end": b} for a, b in r[3]] for r in rows]
            yield pd.DataFrame({"n_words": [r[0] for r in rows], "n_hit": [r[1] for r in rows], "items": [sorted(map(str, r[2])) for r in rows], "spans": spans})

    # Python gets the text alone and gives back what it found; as one that may differ from call to call, it is run once for a row.
    found = F.pandas_udf(run, T.StructType().add("n_words", T.LongType()).add("n_hit", T.LongType()).add("items", T.ArrayType(T.StringType())).add("spans", T.ArrayType(_SPAN))).asNondeterministic()
    src = [F.col(c) for c in kept(id_col, keep, "n_words", "n_hit", "items", "spans", "contaminated")]
    out = documents.select(*src, found(F.col(text_col)).alias("__found")).select("*", "__found.*").drop("__found")
    return out.withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))


def _merged(blocks, texts, window):
    found: list[tuple[int, set, np.ndarray | None]] = [(0, set(), None) for _ in texts]
    for block in blocks:
        automaton = build(block, window)
        for i, t in enumerate(texts):
            n, _, items, spans = scan(automaton, t, True)
            who, hit = found[i][1] | set(items), found[i][2]
            if spans:
                start, _ = word_offsets(t)
                hit = np.zeros(n, bool) if hit is None else hit
                for a, b in spans:
                    hit[(start >= a) & (start < b)] = True
            found[i] = (n, who, hit)
    rows = []
    for (n, who, hit), t in zip(found, texts, strict=True):
        spans = []
        if hit is not None:
            start, end = word_offsets(t)
            edge = np.flatnonzero(np.diff(np.concatenate(([0], hit, [0])).astype(np.int8)))
            spans = [(int(start[i]), int(end[j - 1])) for i, j in zip(edge[::2], edge[1::2], strict=True)]
        rows.append((n, int(hit.sum()) if hit is not None else 0, who, spans))
    return rows


def digest(result: DataFrame) -> DataFrame:
    """The registered query's columns."""
    return result.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


__all__ = ["build", "contamination", "digest", "normalise", "scan", "windows", "word_offsets"]
