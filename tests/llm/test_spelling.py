"""Spelling variant grouping against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import spelling
from tidewatch.llm.scratch import Scratch

DOCS = "doc_id long, text string, word string, n long, id string, run string, key long"


def frame(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "w", 1, "i", "r", 2) for i, t in zip(ids, texts, strict=True)], DOCS)


def near(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(texts, ids, one_in=199):
    n = Counter()
    for i, t in zip(ids, texts, strict=True):
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            r = "".join(c.lower() if c.isascii() else c for c in r)
            h = zlib.crc32(f"{'' if i is None else i}:{r}".encode())
            if h % one_in == 0:
                r = r[: h % len(r)] + r[h % len(r) + 1 :]
            n[r] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    form, count = {}, {}
    for w in n:
        beside = [v for v in n if near(w, v)]
        best = min(beside, key=lambda v: (-n[v], v), default=None)
        count[w] = len(beside)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], count[w], None if form[w] is None else n[form[w]]))
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    letters = "abcdeéèßÀÿ×"
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(5, 9))) for _ in range(12)]
    # Rare double edits, edits and the words themselves, so that chains of forms arise; ties among them.
    weights = []
    for w in base:
        weights.append((w, 260))
        for _ in range(4):
            v = list(w)
            v[rng.randrange(len(v))] = rng.choice(letters)
            weights.append(("".join(v), 32))
            at = rng.randrange(len(v))
            weights.append(("".join(v[:at] + [rng.choice(letters)] + v[at:]), 6))
            weights.append(("".join(v[:at] + v[at + 1 :]), 6))
    words = [w.upper() if rng.random() < 0.1 and w.isascii() else w for w, c in weights for _ in range(c)]
    rng.shuffle(words)
    return [" ".join(words[i : i + 200]) for i in range(0, len(words), 200)] + ["", None, "123 -- 456", "İstanbul K" * 6, "x" * 30_000 + " " + "longer " * 3000]


@pytest.mark.parametrize("one_in", [199, 7])
def test_groups_match_brute_force(spark, texts, one_in):
    got = {tuple(r) for r in spelling.variant_groups(frame(spark, texts), one_in=one_in).collect()}
    want = brute(texts, range(len(texts)), one_in)
    assert got == want
    assert sum(r[1] is not None for r in want) > 20 and any(r[2] not in (r[0], r[1]) for r in want)


def test_neighbourhoods_find_every_pair(spark):
    """Few symbols and many: the pairs are the same, whatever meets besides."""
    rng = random.Random(5)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(1, 6))) for _ in range(150)}
    vocab = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    want = {(a, b) for a in words for b in words if near(a, b)}
    for symbols in (1, 2, 8):
        assert {(r.word, r.other) for r in spelling.near_words(vocab, Scratch(spark, "t"), symbols).collect()} == want


def test_roots_follow_long_chains(spark):
    forms = spark.createDataFrame([(f"w{i:02}", f"w{i + 1:02}") for i in range(40)], "word string, form string")
    assert {r.root for r in spelling.roots(forms, Scratch(spark, "t")).collect()} == {"w40"}


def test_edges(spark):
    assert spelling.variant_groups(frame(spark, [])).count() == 0
    assert spelling.variant_groups(frame(spark, [None, "", "abcdef"])).count() == 0
    # Repeated rows and null ids count.
    got = spelling.variant_groups(frame(spark, ["abcdef"] * 5 + ["abcdef ABCDEG"] * 30, [1] * 5 + [None] * 30)).collect()
    assert {tuple(r) for r in got} == brute(["abcdef"] * 5 + ["abcdef ABCDEG"] * 30, [1] * 5 + [None] * 30)


def test_only_ascii_letters_are_lowered(spark):
    assert [r.run for r in spelling.runs(frame(spark, ["ÀBC É×z"])).collect()] == ["Àbc", "É×z"]
    assert spark.range(1).select(spelling.reduced(F.lit("aé"))).first()[0].isdigit()
