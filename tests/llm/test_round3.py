"""Spans beside base spans, broken pages, template lines, names of lines, held-out labels and clashing names."""

import random
import time

import pytest
import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tidewatch.llm import decontamination, html_extract, line_dedup, quality, secrets, simhash, toxicity


def test_what_runs_on_past_a_base_span_is_a_span():
    text = "see api_key=abcdef123456~Zq8x4TmK9sWv2LpRb7Yd and more"
    base = secrets.base_spans(text)
    assert [text[a:b] for a, _, b in base] == ["api_key=abcdef123456"]
    assert [text[a:b] for a, _, b in secrets.novel_spans(text, base, secrets.Novelty())] == ["~Zq8x4TmK9sWv2LpRb7Yd"]
    short = "see api_key=abcdef123456~Zq8x4 and more"
    assert secrets.novel_spans(short, secrets.base_spans(short), secrets.Novelty()) == []


@pytest.mark.parametrize("page", ["<div " + "x" * 40_000 + ">a</div>", "<div " + '""' * 20_000 + ">a</div>", "<div>" * 20_000 + "</section>" * 20_000 + "a", "<b>" * 20_000 + "<hr>" * 20_000, "<i><div>" + "<b>" * 20_000 + "</i>" * 20_000, "<script>" + "</script" * 20_000])
def test_broken_markup_takes_linear_time(page):
    began = time.perf_counter()
    html_extract.main_text(page)
    assert time.perf_counter() - began < 2


def brute_tree(page):
    """(tag, depth) of the elements of a page, by walking up at each end tag."""
    import re

    at, out = [("html", 0)], []
    for end, tag in re.findall(r"<(/?)(\w+)>", page):
        if end:
            for i in range(len(at) - 1, 0, -1):
                if at[i][0] == tag:
                    del at[i:]
                    break
                if at[i][0] in html_extract.BLOCKS and tag not in html_extract.BLOCKS:
                    break
        else:
            if tag in html_extract.CLOSES_P:
                for i in range(len(at) - 1, 0, -1):
                    if at[i][0] == "p":
                        del at[i:]
                        break
                    if at[i][0] in html_extract.BLOCKS:
                        break
            if tag in ("li", "td") and at[-1][0] == tag:
                at.pop()
            out.append((tag, len(at)))
            if tag not in html_extract.VOID:
                at.append((tag, len(at)))
    return out


def test_trees_match_brute_force():
    rng = random.Random(5)
    for _ in range(400):
        page = "".join(f"<{rng.choice(['', '/'])}{rng.choice(['div', 'p', 'b', 'i', 'li', 'td', 'section', 'hr'])}>" for _ in range(30))
        got, stack = [], [html_extract.parse(page)]
        while stack:
            x = stack.pop()
            got += [(x.tag, x.depth)] if x.parent else []
            stack += [c for c in reversed(x.items) if not isinstance(c, str)]
        assert got == brute_tree(page.replace("</hr>", ""))


def test_the_threshold_acts_below_the_main_node():
    prose = " ".join(f"Sentence {i} of the story has words enough to count." for i in range(8))
    page = f"<body><div><p>{prose}</p><p>{prose}</p><section><p>{prose}</p><p><a href=x>Other stories that you may read</a> now</p></section></div></body>"
    text = html_extract.main_text(page)
    assert text.count("Sentence 7") == 3 and "Other stories" not in text


def test_template_lines_are_all_paired(spark):
    """Pairs at 0.80 to 0.83 that share a template with all others, which are much less alike."""
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 10))) for _ in range(3000)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    grams = lambda x: {x[i : i + line_dedup.SHINGLE] for i in range(len(x) - line_dedup.SHINGLE + 1)}
    template, lines = some(30), []
    while len(lines) < 400:
        own = some(14)
        a, b = f"{template} {own} {some(4)}", f"{template} {own} {some(4)}"
        if 0.80 <= len(grams(a) & grams(b)) / len(grams(a) | grams(b)) <= 0.83:
            lines += [a, b]
    rng.shuffle(lines)
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(4)
    assert line_dedup.digest(df).agg(F.sum("n_removed")).first()[0] >= 0.99 * 200


def test_second_names_do_not_follow_from_the_first(spark):
    df = spark.createDataFrame([(1, "some line of text")], "doc_id long, text string")
    x = line_dedup.numbered_lines(df, "doc_id", "text").select("k", "k2", F.xxhash64("norm", F.lit(1)).alias("chained")).first()
    assert len({x.k, x.k2, x.chained}) == 3


def auc(pairs):
    good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))


def test_held_out_labels(spark):
    """Both classifiers on labels that they did not learn from; the smallest tables hold too few."""
    data = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    out = F.col("doc_id") % 3 == 0
    chain = toxicity.fit(docs, labels.where(~out), toxicity.CATEGORIES)
    rest = toxicity.score(docs, chain).join(labels.where(out), "doc_id").collect()
    assert auc([(r.p_toxic, r.toxic) for r in rest]) > 0.65
    rest = quality.score(docs, quality.fit(docs, labels.where(~out))).join(labels.where(out), "doc_id").collect()
    assert auc([(r.score, r.quality) for r in rest]) > 0.8


def test_columns_named_like_outputs_give_way(spark):
    clash = "score p_toxic spans n_words n_hit items contaminated fingerprint n_lines n_removed __text".split()
    rows = [(1, "one two three four five", *["x"] * len(clash)), (2, None, *["x"] * len(clash))]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in clash)).repartition(3)
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    keep = tuple(clash)
    outs = {
        "spans": secrets.secret_spans(df, keep=keep), "fingerprint": simhash.fingerprint(df, keep=keep), "n_hit": decontamination.contamination(df, bench, keep=keep),
        "n_removed": line_dedup.dedup_lines(df),
    }
    for name, out in outs.items():
        assert out.columns.count(name) == 1 and out.where(F.col(name).cast("string") == "x").count() == 0 and out.count() == 2


def test_stages_keep_clashing_columns(spark, data):
    """A stage's documents may have columns of any name; they come out as they went in."""
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(40).withColumns({"p_toxic": F.lit("mine"), "contaminated": F.lit("too"), "n_removed": F.lit("three")})
    for name, stage in corpus_pipeline.STAGES[:4]:
        if name != "minhash_near_dedup":
            out = stage(spark, docs, data)
            assert out.columns == docs.columns and out.where("p_toxic != 'mine' or contaminated != 'too' or n_removed != 'three'").count() == 0 and out.count() > 0


def brute_fingerprint(text):
    """Signed votes of weighted words and word pairs, one bit at a time."""
    import math
    from collections import Counter

    import numpy as np

    from tidewatch.llm.words import mix, word_hashes

    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ").split(" ") for w in w.split("\n") if w]
    h = [int(word_hashes([w.encode()])[0][0]) for w in words]
    pair = lambda a, b: int(mix(np.array([a], np.uint64) * np.uint64(31) + np.array([b], np.uint64))[0])
    terms = Counter([*h, *(pair(a, b) for a, b in zip(h, h[1:], strict=False))])
    votes = [0.0] * 128
    for t, n in terms.items():
        halves = [int(mix(np.array([t ^ x], np.uint64))[0]).to_bytes(8, "little") for x in (0, 0x5DEECE66D)]
        for i, byte in enumerate(b"".join(halves)):
            for k in range(8):
                votes[8 * i + k] += (1 + math.log(n)) * (1 if byte >> (7 - k) & 1 else -1)
    return "".join(f"{sum(1 << (7 - k) for k in range(8) if votes[8 * i + k] > 1e-4):02x}" for i in range(16)), min(map(abs, votes), default=0)


def test_fingerprints_match_brute_force(spark):
    rng = random.Random(3)
    texts = [" ".join(f"W{rng.randrange(40)}é" for _ in range(n)) for n in (1, 2, 7, 60, 301)] + ["", None, " \n ", "a a a a b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(12)
    got = {r.doc_id: r.fingerprint for r in simhash.fingerprint(df).collect()}
    for i, t in enumerate(texts):
        want, least = brute_fingerprint(t)
        assert least < 1e-3 or got[i] == want, t  # votes that cancel out may fall either way


def test_long_texts_and_empty_partitions(spark):
    long = " ".join(f"word{i % 7919}" for i in range(400_000))
    df = spark.createDataFrame([(1, long), (2, long + " more"), (3, "short text")], "doc_id long, text string").repartition(24)
    bench = spark.createDataFrame([(9, " ".join(f"word{i}" for i in range(20)))], "item_id long, text string")
    rows = {r.doc_id: r for r in decontamination.contamination(df, bench).collect()}
    assert rows[1].n_words == 400_000 and rows[1].items == ["9"] and rows[3].items == []
    near = {r.id: r for r in simhash.with_next(df).collect()}
    assert near[2].near_next == 1.0 and near[2].n_chars == len(long) + 5 and len(near) == 3
    assert {r.doc_id: r.n_assign for r in secrets.digest(df).collect()} == {1: 0, 2: 0, 3: 0}


def test_only_the_text_goes_through_python(spark):
    """Kept columns, a copy of the text among them, are neither sent to Python nor given back by it."""
    texts = ["one two three four five", "", None, "six one two three"] * 3
    df = spark.createDataFrame([(n, t, t, [n]) for n, t in enumerate(texts)], "doc_id long, text string, __kept0 string, __kept1 array<long>").repartition(2)
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    chain = toxicity.Chain(["a", "toxic"], [np.ones((1 << 18) + 3, np.float32)] * 2, 1 << 18)
    keep = ("__kept0", "__kept1")
    for out in (toxicity.score(df, chain, keep=keep).where("p_toxic < 2"), decontamination.contamination(df, bench, keep=keep).where("not contaminated or contaminated")):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "MapInPandas" not in plan and plan.count("ArrowEvalPython") == 1
        assert {(r.doc_id, r["__kept0"], r["__kept1"][0]) for r in out.collect()} == {(n, t, n) for n, t in enumerate(texts)}


def test_no_table_of_line_dedup_holds_shingles(spark, monkeypatch):
    """A line's shingle set takes several times its room: it is made where it is wanted, and no table between steps keeps it."""
    tables, save = [], line_dedup.Scratch.save
    monkeypatch.setattr(line_dedup.Scratch, "save", lambda self, df: tables.append(set(df.columns)) or save(self, df))
    base = "the quick brown fox jumps over the lazy dog while the small cat looks on from the old wall number "
    df = spark.createDataFrame([(n, base + str(n)) for n in range(6)] + [(9, "a line of its own that nobody else has written")], "doc_id long, text string")
    assert {r.doc_id for r in line_dedup.dedup_lines(df).where("n_removed > 0").collect()} == {1, 2, 3, 4, 5}
    assert {"k", "key"} in tables and not any("s" in columns for columns in tables)
