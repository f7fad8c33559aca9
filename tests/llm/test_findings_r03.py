"""Costs that grew beside the work: windows of few lanes, sets made twice, pairs that sizes and bitmaps rule out."""

import random

import numpy as np
from tidewatch.llm import language_model, line_dedup


def test_one_long_text_does_not_make_a_window_for_each_few_tokens():
    texts = [np.zeros(40, np.int32)] * 256 + [np.zeros(20000, np.int32)]
    dealt = language_model.Lanes(texts, 256)
    windows = list(dealt.windows(16))
    assert len(windows) < 60  # 1,250 at 16 steps each
    assert [t for t, _ in windows] == [0, *np.cumsum([n for _, n in windows])[:-1].tolist()]
    assert sum(int(dealt.window(t, n)[2].sum()) for t, n in windows) == 256 * 40 + 20000
    assert {n for t, n in windows if t < 32} == {16}


def test_shingles_of_a_line_are_made_once_and_pairs_ruled_out_are_not_alike(spark):
    rng = random.Random(5)
    base = "".join(rng.choice("abcdefgh ij") for _ in range(300))
    lines = [base] + [base[: 300 - n] + "".join(rng.choice("klmnop") for _ in range(n)) for n in range(5, 200, 5)] + [base[:n] for n in range(11, 300, 20)]
    norms = spark.createDataFrame(list(enumerate(lines)), "k long, norm string")
    signed = line_dedup.signatures(norms)
    assert signed._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    sets = [{x[i : i + line_dedup.SHINGLE] for i in range(len(x) - line_dedup.SHINGLE + 1)} for x in lines]
    assert {r.k: r.n for r in signed.collect()} == {i: len(s) for i, s in enumerate(sets)}
    pairs = [(i, j) for i in range(len(lines)) for j in range(i)]
    true = {(i, j) for i, j in pairs if 100 * len(sets[i] & sets[j]) >= line_dedup.PERCENT * len(sets[i] | sets[j])}
    df = spark.createDataFrame(pairs, "k long, c long")
    left = {(r.k, r.c) for r in line_dedup.possible(df, signed).collect()}
    assert true <= left and len(left) < len(pairs) / 2 and true
    assert {(r.k, r.c) for r in line_dedup.alike(df, norms, signed).collect()} == true
