"""Crowds of near copies, of which not all pairs are compared, and tokens that are remembered."""

import random

from tidewatch.llm import packing, prefix_join
from tidewatch.llm.components import connected_components
from tidewatch.llm.scratch import Scratch


def crowd(n):
    """Sets of 100 numbers, some linked at 80 in 100 and others not, each a group of its own."""
    rng = random.Random(7)
    core = list(range(1, 101))
    rows = []
    for i in range(n):
        out = rng.sample(core, rng.choice([4, 6, 8, 14]))
        own = rng.sample(range(1000, 1400), len(out))
        rows.append((i, i, [x for x in core if x not in out] + own))
    return rows


def test_stars_link_a_crowd_before_all_pairs_of_it(spark):
    rows = crowd(240)
    sets = {i: set(s) for i, _, s in rows}
    df = spark.createDataFrame(rows, "id long, label long, s array<long>").cache()
    alike = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    compared = []

    def confirm(pairs):
        got = [(r.k, r.c) for r in pairs.collect()]
        compared.extend(got)
        return spark.createDataFrame([p for p in got if alike(*p)], "k long, c long")

    scratch = Scratch(spark, "crowd")
    links = prefix_join.exact_links(df, 80, confirm, scratch)
    got = {r.node: r.component for r in connected_components(links, scratch, "k", "c").collect()}
    true = [(a, b) for a in sets for b in sets if a < b and alike(a, b)]
    want = {r.node: r.component for r in connected_components(spark.createDataFrame(true, "k long, c long"), scratch, "k", "c").collect()}
    assert got == want and len(set(want.values())) < len(sets)
    assert len(set(compared)) == len(compared)
    # Before, all pairs of the crowd that pass the filters were compared.
    before = prefix_join.candidate_pairs(df, 80).count()
    assert 2 * len(compared) < before, (len(compared), before)


def test_nothing_left_gives_no_links(spark):
    none = spark.createDataFrame([], "id long, label long, s array<long>")
    assert prefix_join.exact_links(none, 80, lambda pairs: pairs, Scratch(spark, "crowd")).count() == 0


class Memory(dict):
    """A dictionary that is not gone through."""

    def __iter__(self):
        raise AssertionError("gone through")

    keys = __iter__


def test_tokens_are_looked_up_without_going_through_what_is_remembered():
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["one two, three's (four) ünder 12x", "two, five; six ünder", ""]
    want, tokens = packing.Tokens(path)(texts), packing.Tokens(path)
    assert tokens(texts[:1]) == want[:1]
    tokens.known, tokens.before = Memory({b"two,": tokens.known[b"two,"]}), Memory(tokens.known)
    assert tokens(texts) == want
