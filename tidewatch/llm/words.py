"""Words and their hashes, a whole batch of texts at a time in numpy.

A word is a run of bytes other than space and \\t..\\r, after lower-casing A-Z (``bytes.lower`` touches ASCII only).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

_SEP = np.zeros(256, bool)
_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE = np.random.default_rng(20240917).integers(1, 2**63, 256, dtype=np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(int(_P), -1, 2**64))
_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _tables or len(_tables["p"]) < n:
        size = max(n, 1 << 20)
        for key, base in (("p", _P), ("inv", _PINV)):
            t = np.full(size, base, np.uint64)
            t[0] = 1
            _tables[key] = np.multiply.accumulate(t)
    return _tables["p"][:n], _tables["inv"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def as_bytes(text, lower: bool = True) -> bytes:
    """UTF-8 of a text, null as empty."""
    b = b"" if text is None or text != text else text.encode("utf-8", "surrogatepass")
    return b.lower() if lower else b


def slices(texts: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of documents that hold about ``most`` bytes each, to bound the arrays of one step."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text and the total, starts, ends, the joined bytes)."""
    a = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    sep = _SEP[a]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], sep)).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    p, inv = _powers(len(a))
    pre = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_BYTE[a] * p, out=pre[1:])
    h = mix((pre[ends] - pre[starts]) * inv[starts])
    at = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    return h, np.searchsorted(starts, at), starts, ends, a


_OTHER = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64)


def distinct_words(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct words, the number of each word of the texts among them, first word of each text and the total).

    Words are told apart by their hashes.  Those with a hash in common have the same length and the same sum of other byte
    values, or the words themselves are compared.
    """
    h, first, starts, ends, a = word_hashes(texts)
    which, distinct = pd.factorize(h)  # by a hash table, where numpy's unique sorts
    at = np.empty(len(distinct), np.int64)
    at[which[::-1]] = np.arange(len(h) - 1, -1, -1)
    mark = np.concatenate(([np.uint64(0)], np.cumsum(_OTHER[a])))
    mark = mark[ends] - mark[starts]
    if (mark != mark[at][which]).any() or (ends - starts != (ends - starts)[at][which]).any():
        number: dict[bytes, int] = {}
        which = np.array([number.setdefault(w, len(number)) for t in texts for w in t.split()], np.int64)
        return list(number), which, first
    joined = a.tobytes()
    return [joined[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)], which, first


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Distinct n-word shingles of one text as 64-bit hashes; a shorter, not empty text is one shingle as a whole."""
    if not len(h):
        return h
    k = min(n, len(h))
    s = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        s = mix(s * np.uint64(0xD6E8FEB86659FD93) + h[i : len(h) - k + 1 + i])
    return np.unique(s)


def kept(id_col: str, keep: tuple[str, ...], *outputs: str) -> list[str]:
    """The columns of a row that pass through an operator, each once: one that is named like an output gives way to it."""
    return [c for c in dict.fromkeys((id_col, *keep)) if c == id_col or c not in (*outputs, "__text", "__html")]
