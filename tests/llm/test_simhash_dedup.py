"""SimHash near-dedup and its bit-sliced comparison against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewatch.llm import simhash_dedup
from tidewatch.llm.bitslice import forest, planes, within
from tidewatch.llm.scratch import Scratch

DOCS = "doc_id long, text string, fp string, node long, component_id string, id string"


def frame(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "x", 1, "y", "z") for i, t in zip(ids, texts, strict=True)], DOCS)


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    k = min(4, len(words))
    h = [xxhash.xxh64(" ".join(words[i : i + k]).encode(), seed=42).intdigest() for i in range(len(words) - k + 1)] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return [find(i) for i in range(n)]


def apart(a, b):
    return bin(int(a) ^ int(b)).count("1")


def clusters(seed, groups, most):
    """Fingerprints around common centres, in runs of a key each."""
    rng = random.Random(seed)
    keys, prints = [], []
    for key in range(groups):
        centres = [rng.getrandbits(64) for _ in range(3)]
        for _ in range(rng.randrange(1, most)):
            f = rng.choice(centres)
            for bit in rng.sample(range(64), rng.randrange(7)):
                f ^= 1 << bit
            keys.append(key)
            prints.append(f)
    return np.array(keys), np.array(prints, np.uint64)


@pytest.mark.parametrize("radius", [0, 1, 4, 6])
def test_planes_tell_the_distances(radius):
    _, prints = clusters(radius, 30, 12)
    for lag in (1, 2, 63, 64, 65, 130):
        if lag < len(prints):
            wanted = np.arange(len(prints) - lag) % 5 > 0
            got = within(planes(prints), lag, wanted, radius).tolist()
            assert got == [i for i in range(len(prints) - lag) if wanted[i] and apart(prints[i], prints[i + lag]) <= radius]


@pytest.mark.parametrize("most", [3, 40, 300])
def test_forest_connects_what_links_connect(most):
    keys, prints = clusters(most, 12, most)
    got = forest(keys, prints, 4)
    n = len(keys)
    want = [(i, j) for i in range(n) for j in range(i + 1, n) if keys[i] == keys[j] and apart(prints[i], prints[j]) <= 4]
    assert set(got) <= set(want)
    assert components(n, got) == components(n, want)
    assert len(got) == n - len(set(components(n, want)))
    assert forest(keys[:0], prints[:0], 4) == []


def test_radius_is_bounded():
    with pytest.raises(ValueError, match="radius"):
        forest(np.zeros(2), np.zeros(2, np.uint64), 7)


@pytest.mark.parametrize("limit", [simhash_dedup.LIMIT, 8])
def test_links_lose_none(spark, limit):
    """All pairs within the radius are connected, also where a bucket is cut into parts."""
    _, prints = clusters(5, 6, 120)
    # One dense group of which all share many blocks.
    prints = np.unique(np.concatenate((prints, np.arange(200, dtype=np.uint64) * np.uint64(0x41) + np.uint64(7 << 40))))
    table = spark.createDataFrame([(int(np.int64(np.uint64(p).astype(np.int64))), n) for n, p in enumerate(prints)], "fp long, node long")
    got = [tuple(r) for r in simhash_dedup.links(table, Scratch(spark, "t"), limit=limit).collect()]
    want = [(i, j) for i in range(len(prints)) for j in range(i + 1, len(prints)) if apart(prints[i], prints[j]) <= 4]
    assert components(len(prints), got) == components(len(prints), want)


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(8)
    texts = []
    for _ in range(10):
        base = [rng.choice("alpha beta gamma Delta Ünder stone".split()) + str(rng.randrange(90)) for _ in range(rng.choice((3, 30, 300)))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(5)):
            near = list(base)
            near[rng.randrange(len(near))] = f"edit{rng.randrange(99)}"
            texts.append("  ".join(near))
        texts.append(texts[-1].upper())
    texts += ["", None, " \t\x0b ", "one", "one two three four", " ", " ".join(f"w{rng.randrange(5000)}" for _ in range(40_000))]
    got = {r.doc_id: r for r in simhash_dedup.near_duplicates(frame(spark, texts)).collect()}
    prints = [brute_print(t) for t in texts]
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    want = components(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if apart(prints[i], prints[j]) <= 4])
    assert [got[i].component_id for i in range(len(texts))] == want
    assert {prints[texts.index(t)] for t in ("", None, " \t\x0b ")} == {0}


def test_edges(spark):
    assert simhash_dedup.near_duplicates(frame(spark, [])).count() == 0
    assert simhash_dedup.near_duplicates(frame(spark, ["a b"]).repartition(4)).count() == 1
    # Rows 5 share an id, and so join what each of their texts links; a null id links nothing.
    rows = simhash_dedup.near_duplicates(frame(spark, ["a b c", "d e f", "a b c", "d e f", "d e f"], [5, 5, 7, 3, None])).collect()
    assert sorted(((r.doc_id, r.component_id) for r in rows), key=str) == [(3, 3), (5, 3), (5, 3), (7, 3), (None, None)]
    assert len({r.fingerprint for r in rows}) == 2


def test_spark_and_python_hashes_agree(spark):
    """The shingle hash is what ``xxhash64`` gives for one string column."""
    assert spark.range(1).select(F.xxhash64(F.lit("one two é four"))).first()[0] == int(np.uint64(xxhash.xxh64_intdigest("one two é four".encode(), 42)).astype(np.int64))
