"""Rows and states that only larger tables show."""

import random
from collections import Counter
from datetime import datetime, timedelta

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from tidewatch.operators import detect as d
from tidewatch.operators import intel, joins, sequences
from tidewatch.plans import streams
from tidewatch.plans.queries import ORACLE
from tidewatch.streaming import jobs as st
from tidewatch.streaming import keyed

T0 = datetime(2031, 3, 4)
ROW = "id string, timestamp timestamp, user string, kind string"


def run(spark, folder, batches, job):
    for rows in batches:
        spark.createDataFrame([(i, T0 + timedelta(minutes=m), u, k) for i, m, u, k in rows], ROW).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    return st.run_available(job(stream), f"{folder}/out", f"{folder}/cp").collect()


def table_rows(spark, folder):
    return spark.read.format("statestore").option("stateVarName", "table").load(f"{folder}/cp").count()


def test_novelty_of_many_pairs(spark, tmp_path):
    """The state is a table for each bucket of pairs, not an entry for each pair; late events and forgotten pairs come out as pair by pair."""
    rng = random.Random(7)
    times = ((0, 50), (40, 90), (300, 350), (330, 420))
    rows = [[(f"{b}-{n}", rng.randint(*times[b]), f"u{rng.randrange(900)}", "x") for n in range(1500)] for b in range(4)]
    last, want = {}, []
    for batch in rows:
        for i, m, u, _ in sorted(batch, key=lambda r: (r[1], r[0])):
            if u not in last or m - last[u] > 120:
                want.append((f"{u}>x", i))
            last[u] = max(m, last.get(u, m))
    got = run(spark, str(tmp_path), rows, lambda x: st.stream_novelty(x, "user", "kind", "2 hours", "2h"))
    assert sorted((r.key, r.id) for r in got) == sorted(want)
    assert len({k for k, _ in want}) > keyed.BUCKETS >= table_rows(spark, str(tmp_path))


def test_scenario_keeps_all_evidence(spark):
    now = datetime(2031, 3, 4, 12)
    rows = [(f"{n:03}", "h1", now - timedelta(minutes=60 - n), "failure", "T1") for n in range(45)]
    mapped = spark.createDataFrame(rows, "id string, host string, timestamp timestamp_ntz, outcome string, technique string")
    runs = d.scenario_runs(mapped, {"id": "s", "trigger": "T1"}, F.lit(now).cast("timestamp_ntz"))
    got = d.scenario_steps(mapped, runs, ["T1"], mapped.select("host", "technique"), F.lit(now).cast("timestamp_ntz")).first()
    assert got.evidence == [r[0] for r in rows] and got.status == "blocked"


def test_context_sql_takes_ten_different_indicators():
    """Ten different indicators, however often the first ones are hit."""
    con = duckdb.connect()
    t = pd.Timestamp("2031-03-04")
    events = pd.DataFrame([(n, t + pd.Timedelta(seconds=n), 8, "error", 1.0, "{}") for n in range(0, 1000, 50)], columns=["event_id", "ts", "user_id", "event_type", "value", "props"])  # noqa: F841
    supplier = pd.DataFrame([(400 * n, n) for n in range(12)], columns=["s_suppkey", "s_nationkey"])  # noqa: F841
    customer = pd.DataFrame({"c_custkey": [1]})  # noqa: F841
    nation = pd.DataFrame({"n_nationkey": [1], "n_name": ["x"]})  # noqa: F841
    got = con.execute(ORACLE["D24_finding_context"]).df()
    assert [x.split(",") for x in got["indicators"]] == [sorted(str(400 * n) for n in range(12))[:10]]


def test_indicators_of_equal_values_are_one_group(spark):
    """Hits, pairs and marks come from groups of indicators, also where an indicator has several values or an event several columns."""
    rng = random.Random(3)
    held = [(n, "ip", f"10.0.0.{n % 3}") for n in range(40)] + [(n, "ip", f"10.0.0.{n % 5}") for n in range(30, 50)] + [(60 + n, "user", f"u{n % 2}") for n in range(6)]
    severity = {n: rng.choice(intel.SEVERITIES) for n, *_ in held}
    ind = spark.createDataFrame([(n, k, v, severity[n], 0.5) for n, k, v in held], "indicator_id long, type string, value string, severity string, confidence double")
    rows = [(str(n), T0 + timedelta(minutes=n), f"10.0.0.{rng.randrange(7)}", f"10.0.0.{rng.randrange(7)}", "h", f"u{rng.randrange(4)}", "{}") for n in range(60)]
    events = spark.createDataFrame(rows, "id string, timestamp timestamp_ntz, source_ip string, destination_ip string, host string, user string, attributes string")
    hit = {r[0]: sorted({n for n, k, v in held if v in ((r[2], r[3]) if k == "ip" else (r[5],))}) for r in rows}
    at = {r[0]: r[1] for r in rows}
    ids = {n for ns in hit.values() for n in ns}
    want = {n: ((e := [i for i, ns in hit.items() if n in ns]) and len(e), max(at[i] for i in e)) for n in ids}
    assert {r.indicator_id: (r.hit_count, r.last_seen) for r in intel.indicator_hits(events, ind).collect()} == want
    pairs = Counter((ns[0], o) for ns in hit.values() for o in ns[1:])
    assert {(r["first"], r.other): r.events for r in intel.indicator_cooccurrence(events, ind).collect()} == pairs
    marks = {r.id: (r.threat_indicators, r.threat_severity) for r in intel.mark_events(events, ind).collect()}
    assert marks == {i: (ns, max((severity[n] for n in ns), key=intel.SEVERITIES.index)) if ns else (None, None) for i, ns in hit.items()}
    _, members = intel.indicator_groups(ind)
    assert members.count() < 15


def test_sequences_of_many_keys(spark, tmp_path):
    """The state of a sequence stream is a table for each bucket of keys; chains are those of the batch form."""
    rng = random.Random(5)
    rows = [[(f"{b}{n:04}", 60 * b + rng.randrange(60), f"u{rng.randrange(700)}", rng.choice("ab")) for n in range(1200)] for b in range(3)]
    steps = [("a", F.col("kind") == "a"), ("b", F.col("kind") == "b")]
    got = sorted((r.key, *r.ids) for r in run(spark, str(tmp_path), rows, lambda x: st.stream_sequence(x, "user", steps, "5h", late="1 hour")))
    want = sorted((r.key, *r.ids) for r in sequences.sequence_rule(spark.read.parquet(f"{tmp_path}/in"), "user", steps, "5h").collect())
    assert got == want and len(want) > 300
    assert 0 < table_rows(spark, str(tmp_path)) <= keyed.BUCKETS
    states = keyed.sequence_states(spark, f"{tmp_path}/cp", "r", "5h")
    assert states.count() > 50 and {r.step for r in states.collect()} == {1}


def test_landed_slices_use_every_core(spark, tmp_path):
    """A slice has a file for each core where it has rows enough, and a batch is still one slice."""
    df = spark.range(0, 400_000).select("id", F.lit("x").alias("v"))
    sdf = streams.landed(spark, df, (F.col("id") % streams.SLICES).cast("int"), str(tmp_path))
    files = list((tmp_path / "in").glob("*.parquet"))
    assert len(files) == streams.SLICES * spark.sparkContext.defaultParallelism > streams.SLICES * streams.FILES
    sizes = []
    sdf.writeStream.foreachBatch(lambda b, n: sizes.append((b.count(), b.select(F.col("id") % streams.SLICES).distinct().count()))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sizes == [(100_000, 1)] * streams.SLICES


def test_finding_events_of_a_busy_entity(spark, monkeypatch):
    """Each finding takes the newest events of its entities by their numbers: what is joined grows with findings, not with an entity's events."""
    rng = random.Random(11)
    rows = [(f"e{n:05}", T0 + timedelta(seconds=rng.randrange(20_000)), f"u{n % 9}", f"h{n % 2}", f"10.0.0.{n % 3}", f"10.0.0.{n % 4}") for n in range(3000)]
    rows += rows[:700] + [("late", None, "u1", "h1", "10.0.0.1", None)]
    events = spark.createDataFrame(rows, "id string, timestamp timestamp_ntz, user string, host string, source_ip string, destination_ip string")
    held = []
    for n in range(60):
        first = T0 + timedelta(seconds=rng.randrange(20_000))
        who = tuple(rng.choice([f"{p}{rng.randrange(3)}", None, ""]) for p in ("u", "h", "10.0.0.", "10.0.0."))
        held.append((f"f{n}", *who, [f"e{rng.randrange(3000):05}" for _ in range(n % 3)], first, first + timedelta(seconds=rng.choice((0, 90, 9000)))))
    found = spark.createDataFrame(held, "id string, user string, host string, source_ip string, destination_ip string, event_ids array<string>, first_seen timestamp_ntz, last_seen timestamp_ntz")
    want, at = set(), {r[0]: r[1] for r in rows}
    for f, *who, ids, first, last in held:
        u, h, *ips = [x or "-" for x in who]
        lo, hi = first - timedelta(minutes=2), last + timedelta(minutes=2)
        near = {r[0] for r in rows if r[1] and lo <= r[1] <= hi and (r[2] == u or r[3] == h or r[4] in ips or r[5] in ips)} | set(ids)
        want |= {(f, i) for i in sorted(near, key=lambda i: (T0 - at[i], i))[:25]}
    seen = []
    real = joins.near_blocks
    monkeypatch.setattr(joins, "near_blocks", lambda *x: seen.append(real(*x)) or seen[-1])
    got = joins.finding_events(found, events.repartition(3), "2m", 25)
    assert Counter((r.finding_id, r.event_id) for r in got.collect()) == Counter(want)
    assert seen[0].count() <= 25 * sum(len({(k[0], x) for k, x in zip(("user", "host", "ip", "ip"), f[1:5], strict=True) if x}) for f in held)
