"""Exploded sets that looked small enough to be broadcast."""

import random
from collections import Counter

from tidewatch.llm import line_dedup, prefix_join
from tidewatch.llm.scratch import Scratch


def test_exploded_sets_are_not_broadcast(spark):
    rng = random.Random(11)
    base = ["".join(rng.choice("abcdefgh ij") for _ in range(60)) for _ in range(4)]
    lines = [(i, i % 3, base[i % 4][: 60 - i % 7] + "".join(rng.choice("klmn") for _ in range(i % 5))) for i in range(60)]
    scratch = Scratch(spark, "fronts")
    rest = scratch.save(spark.createDataFrame(lines, "id long, label long, norm string"))
    front = prefix_join.fronts(line_dedup.with_set(rest), 80)
    sets = {r.id: set(r.s) for r in line_dedup.with_set(rest).collect()}
    common, want = Counter(g for s in sets.values() for g in s), set()
    for i, label, _ in lines:
        n = len(sets[i])
        short, long = n + (-160 * n // 180) + 1, n + (-80 * n // 100) + 1
        order = sorted((common[g], g) for g in sets[i])
        want |= {(i, label, n, short, at, g, f // prefix_join.BLOCK + 1) for at, (f, g) in enumerate(order[:long]) if f > 1}
    got = [tuple(r) for r in front.collect()]
    assert set(got) == want and len(got) == len(want)
    kept = scratch.save(front)
    for made in (front, prefix_join.star_pairs(kept, 80), prefix_join.front_pairs(kept, 80)):
        plan = made._jdf.queryExecution()
        made.collect()
        assert "Broadcast" not in plan.executedPlan().toString(), plan.executedPlan().toString()
