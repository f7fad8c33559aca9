"""Streams in several batches: eviction, late events, restarts, replays; tailing of growing files; ordered work over many tasks."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatch import scratch
from tidewatch.operators import findings as fd
from tidewatch.operators import ordered, sequences, stats
from tidewatch.sources import tail
from tidewatch.streaming import jobs as st
from tidewatch.streaming import keyed

T0 = datetime(2031, 3, 4)
ROW = "id string, timestamp timestamp, user string, kind string"


def write(spark, folder, rows):
    """One file, as one arrival."""
    spark.createDataFrame([(i, T0 + timedelta(minutes=m), u, k) for i, m, u, k in rows], ROW).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def stream(spark, folder):
    return spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def run(spark, folder, job):
    return st.run_available(job(stream(spark, folder)), f"{folder}/out", f"{folder}/cp")


def steps():
    return [("a", F.col("kind") == "a"), ("b", F.col("kind") == "b")]


def test_sequence_over_batches(spark, tmp_path):
    """A chain spans batches, a late event completes one, and a chain that was quiet for too long leaves the state."""
    f = str(tmp_path)
    write(spark, f, [("1", 0, "kim", "a"), ("2", 5, "lou", "b"), ("3", 6, "moe", "a")])
    write(spark, f, [("4", 20, "kim", "b"), ("5", 3, "lou", "a"), ("6", 25, "lou", "b")])
    write(spark, f, [("7", 200, "moe", "b"), ("8", 201, "kim", "a")])
    write(spark, f, [("9", 300, "nil", "a")])
    job = lambda x: st.stream_sequence(x, "user", steps(), "1h", late="30 minutes")
    got = sorted((r.key, *r.ids) for r in run(spark, f, job).collect())
    # moe's second step comes over an hour after the first; lou's late first step goes with the second one that is there.
    assert got == [("kim", "1", "4"), ("lou", "5", "6")] or got == [("kim", "1", "4"), ("lou", "5", "2")]
    states = {r.key: (r.step, r.event_ids) for r in keyed.sequence_states(spark, f"{f}/cp", "r", "1h").collect()}
    assert states == {"nil": (1, ["9"])}  # kim's chain of 201 ended at 261, moe's at 66
    # The run goes on from its checkpoint: the open chain is completed by what lands later.
    write(spark, f, [("10", 310, "nil", "b")])
    assert ("nil", "9", "10") in {(r.key, *r.ids) for r in run(spark, f, job).collect()}
    assert keyed.sequence_states(spark, f"{f}/cp", "r", "1h").count() == 0


def test_sequence_stream_equals_batch(spark, tmp_path):
    rng = random.Random(4)
    rows = [(str(n), n + n // 20 * 25, rng.choice("xyz"), rng.choice("aabc")) for n in range(120)]
    for n in range(0, 120, 30):  # in any order within a batch
        write(spark, str(tmp_path), rng.sample(rows[n : n + 30], 30))
    df = spark.read.parquet(f"{tmp_path}/in")
    want = sorted((r.key, *r.ids) for r in sequences.sequence_rule(df, "user", steps(), "30m", "9m").collect())
    job = lambda x: st.stream_sequence(x, "user", steps(), "30m", "9m", "1 hour")
    got = sorted((r.key, *r.ids) for r in run(spark, str(tmp_path), job).collect())
    assert got == want and len(want) == 4


def test_correlation_leaves_its_window(spark, tmp_path):
    f = str(tmp_path)
    write(spark, f, [("1", 0, "kim", "a"), ("2", 1, "lou", "a"), ("3", 2, "lou", "a")])
    write(spark, f, [("4", 90, "kim", "a"), ("5", 30, "lou", "b")])
    write(spark, f, [("6", 95, "kim", "b"), ("7", 96, "kim", "a"), ("8", 97, "kim", "b")])
    write(spark, f, [("9", 900, "zoe", "a")])
    tests = {"two": (F.col("kind") == "a", 2), "one": (F.col("kind") == "b", 1)}
    got = run(spark, f, lambda x: st.stream_correlation(x, "user", tests, "1h", late="100 minutes")).collect()
    # kim's first event is out of the window when the second comes; after the result at 96 the key starts over.
    assert sorted((r.key, r.id, r.matched) for r in got) == [("kim", "7", 2), ("lou", "5", 2)]
    left = spark.read.format("statestore").option("stateVarName", "recent").load(f"{f}/cp").select("key.key").distinct().collect()
    assert [r.key for r in left] == ["zoe"]


def test_novelty_forgets(spark, tmp_path):
    f = str(tmp_path)
    for n, m in enumerate((0, 10, 500, 505)):
        write(spark, f, [(str(n), m, "kim", "a"), (f"x{n}", m, None, "a")])
    got = run(spark, f, lambda x: st.stream_novelty(x, "user", "kind", "10 minutes", "2h")).collect()
    assert sorted((r.key, r.id) for r in got) == [("kim>a", "0"), ("kim>a", "2")]


def test_findings_of_batches(spark, tmp_path):
    """Batches, one of them played twice, give what one upsert over all gives; only touched buckets are written anew."""
    path = str(tmp_path / "f")
    kind = "group_key string, n long, first_seen timestamp_ntz, last_seen timestamp_ntz"
    at = lambda m: T0 + timedelta(minutes=m)
    batches = [[("k1", 2, at(0), at(5)), ("k2", 1, at(1), at(1))], [("k1", 3, at(8), at(9)), ("k1", 1, at(6), at(7))], [("k3", 4, at(2), at(3))]]
    frames = [spark.createDataFrame(b, kind) for b in batches]
    for number in (0, 1, 1, 2, 2):
        st.upsert_findings(frames[number], number, path, "r", "Rule", "high")
    got = {r.dedup_key: (r.match_count, r.first_seen, r.last_seen) for r in st.current_findings(spark, path, 2).collect()}
    assert got == {"r|k1": (6, at(0), at(9)), "r|k2": (1, at(1), at(1)), "r|k3": (4, at(2), at(3))}
    once = frames[0].unionByName(frames[1]).unionByName(frames[2])
    assert {r.dedup_key: r.match_count for r in fd.merged_findings(fd.new_findings(once, "r", "Rule", "high")).collect()} == {k: v[0] for k, v in got.items()}
    assert not scratch.exists(spark, f"{path}/manifest/0")


def test_tail_gives_each_line_once(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    seen = []

    def go():
        return tail.tail_run(spark, str(logs), str(tmp_path / "state"), lambda df, n: seen.append((n, sorted(r.message for r in df.select("message").collect()))))

    line = lambda m: json.dumps({"message": m})
    (logs / "a.log").write_text(line("one") + "\n" + line("two") + "\n" + line("three")[:9])
    assert go() == 0
    with (logs / "a.log").open("a") as f:
        f.write(line("three")[9:] + "\né plain\n")
    (logs / "b.log").write_text(line("b1") + "\n")
    assert go() == 1
    assert go() == 2
    (logs / "b.log").write_text("new\n")  # shorter than before: the file was replaced
    assert go() == 3
    assert seen == [(0, ["one", "two"]), (1, ["b1", "three", "é plain"]), (2, []), (3, ["new"])]


def test_a_failed_tail_run_is_done_again(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "a.log").write_text("x\ny\n")
    state = str(tmp_path / "state")

    def fail(df, n):
        raise RuntimeError("sink")

    with pytest.raises(RuntimeError, match="sink"):
        tail.tail_run(spark, str(logs), state, fail)
    seen = []
    assert tail.tail_run(spark, str(logs), state, lambda df, n: seen.append((n, df.count()))) == 0
    assert seen == [(0, 2)]


def fold(rows, n, window, gap):
    """Chains of one key by hand: (done, open)."""
    chain, last, done = [], None, []
    for t, i, step in sorted(rows):
        if last is not None and t - last > window:
            chain = []
        last = t
        if step == len(chain) and (not chain or gap is None or t - chain[-1][0] <= gap):
            chain.append((t, i))
            if len(chain) == n:
                done.append([x for _, x in chain])
                chain = []
    return done, [x for _, x in chain]


@pytest.mark.parametrize(("block", "gap"), [(3, None), (3, 6), (1, 6), (50, 6), (8192, None)])
def test_sequences_cross_blocks(spark, block, gap):
    """One key with most events, cut into small blocks: the same chains as one fold over all of them."""
    rng = random.Random(block)
    rows, t = [], 0
    for n in range(260):
        t += rng.choice((1, 1, 2, 5, 25))
        rows.append((str(n), t, "hot" if n % 9 else rng.choice("pq"), rng.choice("abc")))
    df = spark.createDataFrame([(i, T0 + timedelta(minutes=m), u, k) for i, m, u, k in rows], ROW)
    three = [(k, F.col("kind") == k) for k in "abc"]
    got = sequences.chains(df, "user", three, "20m", gap and f"{gap}m", block).collect()
    for key in ("hot", "p", "q"):
        done, open_ = fold([(m, i, "abc".index(k)) for i, m, u, k in rows if u == key], 3, 20, gap)
        assert sorted([x.id for x in r.chain] for r in got if r.key == key and r.done) == sorted(done)
        assert [[x.id for x in r.chain] for r in got if r.key == key and not r.done] == [open_]


def test_running_and_last_rows(spark):
    rng = random.Random(1)
    rows = [(n, rng.choice([None, 1.5, 2.0, -3.0, 7.25])) for n in range(500)]
    df = spark.createDataFrame(rows, "n long, x double").repartition(7)
    aggs = ["count", ("count", "x"), ("sum", "x"), ("min", "x"), ("max", "x"), ("avg", "x")]
    for window in (0, 1, 6):
        w = Window.orderBy("n").rowsBetween(-(window - 1) if window else Window.unboundedPreceding, 0)
        want = df.select("n", F.count(F.lit(1)).over(w).alias("count"), *[getattr(F, k)("x").over(w).alias(f"{k}_x") for k in ("count", "sum", "min", "max", "avg")])
        out = stats.streamstats(df, aggs, [], ["n"], window)
        assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, out.drop("x").collect())) == sorted(map(tuple, want.collect()))
    placed = ordered.positioned(df, ["n"])
    got = ordered.last_rows(placed, {"s": ("sum", F.col("x"))}, 5, block=16).select("n", "s")
    w = Window.orderBy("n").rowsBetween(-4, 0)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.select("n", F.sum("x").over(w).alias("s")).collect()))
    first = ordered.running(placed, {"f": ("first", F.col("x")), "l": ("last", F.col("x"))}, before=True)
    w = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("n", F.first("x", True).over(w).alias("f"), F.last("x", True).over(w).alias("l"))
    assert sorted(map(tuple, first.select("n", "f", "l").collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_time_windows_with_a_halo(spark):
    """Blocks of time give what one window over a key gives; negative times and equal ones among them."""
    rng = random.Random(6)
    rows = [(n, rng.choice(["k", "k", "k", None]), rng.randrange(-300, 300)) for n in range(400)]
    df = spark.createDataFrame(rows, "n long, k string, t long")
    w = Window.partitionBy("k").orderBy("t").rangeBetween(-17, 0)
    want = df.select("n", F.count(F.lit(1)).over(w).alias("c"), F.sum("n").over(w).alias("s"))
    for blocks in (1, 4):
        got = ordered.time_window(df, ["k"], F.col("t"), 17, {"c": F.count(F.lit(1)), "s": F.sum("n")}, blocks)
        assert sorted(map(tuple, got.select("n", "c", "s").collect())) == sorted(map(tuple, want.collect()))
        before = ordered.previous(got, ["k"], ["t", "n"], "s", "p")
        full = got.withColumn("p", F.lag("s").over(Window.partitionBy("k").orderBy("t", "n")))
        assert sorted(map(tuple, before.select("n", "p").collect()), key=str) == sorted(map(tuple, full.select("n", "p").collect()), key=str)


def test_scratch_needs_a_shared_folder_on_a_cluster(spark):
    assert scratch.shared_folder(spark).startswith("file:")
    path = scratch.new_folder(spark, "x")
    spark.range(3).write.parquet(path)
    assert scratch.exists(spark, path)
    scratch.removed(spark, path)
    assert not scratch.exists(spark, path)
    assert scratch.saved(spark.range(3)).count() == 3
