"""Results and work that grew with the pairs of events and indicators."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F
from tidewatch.operators import findings as fd
from tidewatch.operators import intel, joins
from tidewatch.plans import queries
from tidewatch.streaming import jobs

T0 = datetime(2031, 3, 4)


def test_context_takes_indicators_from_values(spark, data, monkeypatch):
    """The first ten indicators of a finding without a row for each pair of event and indicator."""
    group = spark.createDataFrame([("k", 2, T0, T0, "amy", "h1", "1.2.3.4", None)], "group_key string, n long, first_seen timestamp_ntz, last_seen timestamp_ntz, user string, host string, source_ip string, destination_ip string")
    f = fd.new_findings(group, "r", "Rule", "high", "persistence", "T1")
    fid = f.first().id
    rows = [(f"e{i:02}", T0 + timedelta(minutes=i), f"10.0.0.{i % 3}", "10.0.0.9", "h", "amy", "{}") for i in range(30)]
    events = spark.createDataFrame(rows, "id string, timestamp timestamp_ntz, source_ip string, destination_ip string, host string, user string, attributes string")
    held = [(1000 - n, "ip", f"10.0.0.{n % 5}") for n in range(400)] + [(3, "user", "AMY"), (3, "ip", "10.0.0.1"), (4, "ip", "10.0.0.4")]
    ind = spark.createDataFrame([(n, k, v, "high", 0.5) for n, k, v in held], "indicator_id long, type string, value string, severity string, confidence double")
    links = events.select(F.lit(fid).alias("finding_id"), F.col("id").alias("event_id"))
    seen = spark.createDataFrame([], "id string, technique string, tactic string")
    related = spark.createDataFrame([], "finding_id string, other_id string")
    pairs = fd.finding_context(f, links, events, seen, joins.ti_match(events, ind), related)
    values = intel.first_indicators(ind, fd.CONTEXT_INDICATORS)
    hits = joins.ti_hits(events, ind).drop("column")
    got = fd.finding_context(f, links, events, seen, hits, related, held=values)
    assert got.collect() == pairs.collect()
    assert got.first().indicators == sorted(str(n) for n, _, v in held if v in ("10.0.0.0", "10.0.0.1", "10.0.0.2"))[:10]
    assert hits.count() <= 2 * len(rows) and max(len(r.ids) for r in values.collect()) == 10

    def made(*_):
        raise AssertionError("a row for each pair")

    monkeypatch.setattr(joins, "ti_match", made)
    assert queries.QUERIES["D24_finding_context"](spark, data).columns


def test_stream_writes_values_and_not_pairs(spark, data, tmp_path, monkeypatch):
    """A stream's hits grow with its events; the indicators of each come behind it."""
    for name in ("events", "customer", "nation"):
        spark.read.parquet(f"{data}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    supplier = spark.read.parquet(f"{data}/supplier.parquet")
    many = supplier.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(19)))).withColumn("s_suppkey", F.col("s_suppkey") + 400 * F.col("copy")).drop("copy")
    many.write.parquet(f"{tmp_path}/supplier.parquet")
    written, run = [], jobs.run_available

    def seen(*a):
        written.append(run(*a))
        return written[-1]

    monkeypatch.setattr(jobs, "run_available", seen)
    got = queries.QUERIES["T6_stream_ti_match"](spark, str(tmp_path))
    want = queries.QUERIES["J7_ti_match"](spark, str(tmp_path))
    assert got.columns == want.columns and got.count() == want.count() and got.exceptAll(want).count() == 0
    assert len(written) == 1 and 20 * written[0].count() <= got.count() and got.count()
