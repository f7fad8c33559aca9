"""Bit-sliced Hamming comparison: 64 pairs in one machine word, a bit plane at a time.

Plane p holds bit p of all fingerprints, 64 of them in a word.  Two shifted copies of the planes, exclusive-ored, are the bits in which
pairs differ; a carry-save adder counts them for all pairs of a word at once, and words of which every pair is beyond the radius leave.
"""

from __future__ import annotations

import numpy as np

BITS = 64
#: The counters of a word hold up to 7; what overflows is beyond any radius that they can tell.
MOST_RADIUS = 6


def planes(prints: np.ndarray) -> np.ndarray:
    """(64, words) of the bit planes of uint64 ``prints``; the rows beyond the last are zero, and one more word follows."""
    bits = np.unpackbits(prints.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    rows = np.zeros(((len(prints) + 63) // 64 + 1) * 64, np.uint8)
    out = np.empty((BITS, len(rows) // 64), np.uint64)
    for p in range(BITS):
        rows[: len(prints)] = bits[:, p]
        out[p] = np.packbits(rows, bitorder="little").view("<u8")
    return out


def _lanes(flags: np.ndarray, words: int) -> np.ndarray:
    out = np.zeros(words * 8, np.uint8)
    packed = np.packbits(flags, bitorder="little")
    out[: len(packed)] = packed
    return out.view("<u8")


def within(table: np.ndarray, lag: int, wanted: np.ndarray, radius: int) -> np.ndarray:
    """The rows i with ``wanted[i]`` whose prints i and i + lag differ in ``radius`` bits at most."""
    words = table.shape[1]
    alive = _lanes(wanted, words)
    at = np.flatnonzero(alive)
    alive = alive[at]
    skip, turn = divmod(lag, 64)
    near, far = np.minimum(at + skip, words - 1), np.minimum(at + skip + 1, words - 1)
    one, two, four, over = (np.zeros(len(at), np.uint64) for _ in range(4))
    for p in range(0, BITS, 2):
        if turn:
            a, b = (table[q][at] ^ (table[q][near] >> np.uint64(turn) | table[q][far] << np.uint64(64 - turn)) for q in (p, p + 1))
        else:
            a, b = (table[q][at] ^ table[q][near] for q in (p, p + 1))
        # A full adder takes two planes into the ones; its carries go on to the twos and fours.
        half = one ^ a
        carry = (one & a) | (half & b)
        one = half ^ b
        carry, two = two & carry, two ^ carry
        carry, four = four & carry, four ^ carry
        over |= carry
        if p % 8 == 6:
            beyond = over
            for r in range(radius + 1, 8):
                beyond = beyond | (four if r & 4 else ~four) & (two if r & 2 else ~two) & (one if r & 1 else ~one)
            over = beyond
            stay = np.flatnonzero(alive & ~over)
            if len(stay) < len(at):
                at, near, far, alive, one, two, four, over = (x[stay] for x in (at, near, far, alive, one, two, four, over))
            if not len(at):
                return at
    hit = np.unpackbits((alive & ~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").reshape(-1, 64)
    word, lane = np.nonzero(hit)
    return at[word] * 64 + lane


def _root(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def forest(keys: np.ndarray, prints: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Row pairs that join, within each run of equal ``keys``, all rows that links of ``radius`` differing bits or fewer connect.

    Runs of about the same length are laid out together, and each lag compares all their pairs at that distance.  Rows that are
    connected already are not compared again, so that a run of copies costs little and gives one pair less than it has rows.
    """
    if radius > MOST_RADIUS:
        raise ValueError(f"radius {radius} is over {MOST_RADIUS}")
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    size = np.diff(np.append(starts, len(keys)))
    out: list[tuple[int, int]] = []
    for power in range(1, int(size.max(initial=1)).bit_length() + 1):
        runs = np.flatnonzero((size >= 1 << (power - 1)) & (size < 1 << power) & (size > 1))
        if not len(runs):
            continue
        rows = np.repeat(starts[runs] - np.concatenate(([0], np.cumsum(size[runs])[:-1])), size[runs]) + np.arange(size[runs].sum())
        run = np.repeat(runs, size[runs])
        table = planes(prints[rows])
        parent = np.arange(len(rows))
        for lag in range(1, int(size[runs].max())):
            wanted = (run[lag:] == run[:-lag]) & (parent[lag:] != parent[:-lag])
            if not wanted.any():
                continue
            found = within(table, lag, wanted, radius)
            for i in found.tolist():
                a, b = _root(parent, i), _root(parent, i + lag)
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    out.append((int(rows[i]), int(rows[i + lag])))
            if len(found):
                while (parent != parent[parent]).any():
                    parent = parent[parent]
    return out


__all__ = ["BITS", "MOST_RADIUS", "forest", "planes", "within"]
