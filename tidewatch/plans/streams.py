"""Queries of the streams: the events land in slices of time, and a run takes them up batch by batch while its watermark moves on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detect as d
from ..operators import joins as j
from ..operators import risk as r
from ..scratch import new_folder
from ..sources import parsers as ps
from ..sources import tail
from ..streaming import jobs as st
from ..streaming import keyed
from . import canonical as k
from . import security as sec
from .registry import query

#: Slices that the events land in, one after the other, and the files of each, where they are small: a batch takes up one slice.
SLICES, FILES = 4, 2
#: Rows of a file at least, where a slice has more files.
FILE_ROWS = 25_000


def _slice(e: DataFrame, column: str = "timestamp") -> Column:
    """The number of the slice of time that a row is in; slices are equally long."""
    low, high = e.agg(F.min(F.unix_micros(F.col(column).cast("timestamp"))), F.max(F.unix_micros(F.col(column).cast("timestamp")))).first()
    at = F.unix_micros(F.col(column).cast("timestamp"))
    return F.least(F.lit(SLICES - 1), F.floor((at - F.lit(low)) * SLICES / F.lit(max(1, high - low)))).cast("int")


def landed(spark: SparkSession, df: DataFrame, number: Column, folder: str) -> DataFrame:
    """A stream of ``df``, whose slices land in order; one batch for each."""
    rows = df.withColumn("__slice", number)
    # Every slice has as many files, none of them empty, so that a batch is a slice; a file for each core where there are rows enough.
    counts = {r["__slice"]: r["count"] for r in rows.groupBy("__slice").count().collect()}
    files = max(FILES, min(spark.sparkContext.defaultParallelism, min(counts.get(n, 0) for n in range(SLICES)) // FILE_ROWS))
    for n in range(SLICES):
        rows.where(F.col("__slice") == n).drop("__slice").repartition(files).write.mode("append").parquet(folder + "/in")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(folder + "/in")


def stream(name: str, sql: str | None = None, views: tuple[str, ...] = (k.EV,), dressed: Callable[[DataFrame], DataFrame] = lambda e: e, behind: Callable = lambda out, spark, sf: out):
    """Register a query of (stream of canonical events, session, folder of the data); ``behind`` makes its rows of what the stream has written."""

    def add(f):
        def run(spark, sf):
            folder = new_folder(spark, "stream")
            e = dressed(k.events(spark, sf)).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
            return behind(st.run_available(f(landed(spark, e, _slice(e), folder), spark, sf), folder + "/out", folder + "/checkpoint"), spark, sf)

        query(name, sql, views)(run)
        return f

    return add


def _ntz(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


# The watermark behind the last batch, in milliseconds as the engine keeps it.
_MARK = "(SELECT epoch_ms(max(timestamp)) FROM ev) - 86400000"
# Windows and sessions that the watermark, ten minutes behind the newest event, has closed.
_TEN = "(SELECT max(timestamp) - INTERVAL 10 MINUTE FROM ev)"
_LATE = "1 day"

stream("T1_stream_sequence", sec._SEQ)(lambda x, spark, sf: _ntz(st.stream_sequence(x, "user", sec._STEPS(), "2d", late=_LATE).withColumn("ids", F.array_join("ids", ",")), "start", "end"))

# The correlation as a fold: a key's rows in order, each with its counts since the window's begin or the last result, whichever is later.
_FOLD = f"""WITH RECURSIVE {k.EV}, b AS (SELECT "user" AS key, timestamp AS t, id, (source = 'error')::INT AS x, (source = 'purchase')::INT AS y FROM ev WHERE source IN ('error', 'purchase')),
 o AS (SELECT *, row_number() OVER w AS rn, sum(x) OVER w AS cx, sum(y) OVER w AS cy, count(*) OVER (PARTITION BY key ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL '86400000001 microseconds' PRECEDING) AS gone
       FROM b WINDOW w AS (PARTITION BY key ORDER BY t, id ROWS UNBOUNDED PRECEDING)),
 f AS (SELECT key, 0::BIGINT AS rn, 0::BIGINT AS reset, NULL::TIMESTAMP AS t, NULL::VARCHAR AS id, 0 AS matched FROM (SELECT DISTINCT key FROM o) UNION ALL
  SELECT key, rn, CASE WHEN m >= 2 THEN rn ELSE reset END, t, id, m FROM (
   SELECT o.key, o.rn, f.reset, o.t, o.id, (o.cx - coalesce(p.cx, 0) >= 2)::INT + (o.cy - coalesce(p.cy, 0) >= 1)::INT AS m
   FROM f JOIN o ON o.key = f.key AND o.rn = f.rn + 1 LEFT JOIN o p ON p.key = o.key AND p.rn = greatest(o.gone, f.reset)))
 SELECT key, t AS timestamp, id, matched FROM f WHERE matched >= 2"""
stream("T2_stream_correlation", _FOLD)(lambda x, spark, sf: _ntz(st.stream_correlation(x, "user", sec._TESTS(), "24h", late=_LATE), "timestamp"))

_F = sec._F
stream("T3_stream_threshold", f"""SELECT * FROM (SELECT time_bucket(INTERVAL 1 DAY, timestamp, TIMESTAMP '1970-01-01') AS window_start, time_bucket(INTERVAL 1 DAY, timestamp, TIMESTAMP '1970-01-01') + INTERVAL 1 DAY AS window_end, host, count(*) AS n
 FROM ev WHERE {_F} GROUP BY ALL HAVING count(*) >= 3) WHERE window_end <= {_TEN.replace("FROM ev", f"FROM ev WHERE {_F}")}""")(
    lambda x, spark, sf: _ntz(st.stream_threshold(x, sec._failed(), 3, "1d", ["host"]), "window_start", "window_end"))
stream("T4_stream_sessions", f""", g AS (SELECT "user", timestamp, (timestamp > lag(timestamp) OVER w + INTERVAL 6 HOUR)::INT AS new FROM ev WINDOW w AS (PARTITION BY "user" ORDER BY timestamp)),
 s AS (SELECT "user", timestamp, sum(coalesce(new, 0)) OVER (PARTITION BY "user" ORDER BY timestamp) AS session FROM g)
 SELECT "user", min(timestamp) AS start, max(timestamp) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM s GROUP BY "user", session HAVING max(timestamp) + INTERVAL 6 HOUR <= {_TEN}""")(
    lambda x, spark, sf: _ntz(st.stream_sessions(x, "user", "6h"), "start", "end"))
stream("T5_stream_timechart", f"SELECT time_bucket(INTERVAL 6 HOUR, timestamp, TIMESTAMP '1970-01-01') AS _time, source, count(*) AS count FROM ev GROUP BY 1, 2 HAVING time_bucket(INTERVAL 6 HOUR, timestamp, TIMESTAMP '1970-01-01') + INTERVAL 6 HOUR <= {_TEN}")(
    lambda x, spark, sf: _ntz(st.stream_timechart(x, "6h", ["source"]), "_time"))

# Stateless steps: the batch functions on a stream, with tables beside it.
stream("T6_stream_attack_map", f"WITH {sec._MAP} SELECT id, technique, rule FROM mp")(lambda x, spark, sf: st.stream_enrich(x, lambda v: d.attack_map(v, sec.MAPPING)).select("id", "technique", "rule"))
# The stream writes the values that an event holds; only then come the indicators of each, so that its pairs are made and written once.
stream("T6_stream_ti_match", f"WITH {sec._MATCH} SELECT id, indicator_id, value, severity, confidence, \"column\" FROM mt", sec._ALL, behind=lambda hits, spark, sf: j.hit_pairs(hits, k.indicators(spark, sf)).drop("type"))(
    lambda x, spark, sf: st.stream_enrich(x, lambda v: j.ti_hits(v, k.indicators(spark, sf))))
stream("T6_stream_score_events", f"WITH {sec._LED} SELECT entity_type, entity_value, source_id, description, points FROM led", sec._ALL)(
    lambda x, spark, sf: st.stream_enrich(x, lambda v: r.score_events(v, k.assets(spark, sf), k.entity_meta(spark, sf))).select("entity_type", "entity_value", "source_id", "description", "points"))


@stream("T6_stream_parse", "SELECT source_ip, \"user\", message, CASE severity WHEN 'err' THEN 'err' ELSE 'notice' END AS severity FROM ev")
def _parse(x, spark, sf):
    line = F.concat(F.lit("CEF:0|V|P|1.0|7|"), "message", F.lit("|"), F.when(F.col("severity") == "err", 6).otherwise(2), F.lit("|src="), "source_ip", F.lit(" suser="), "user")
    return st.stream_enrich(x.select(line.alias("value")), lambda v: ps.parse(v, "cef")).select("source_ip", "user", "message", "severity")


# Every third event comes twice, the copy six hours later at most.
_TWICE = lambda e: e.withColumn("timestamp", F.explode(F.when(F.col("event_id") % 3 == 0, F.array("timestamp", F.col("timestamp") + F.make_dt_interval(hours=(F.col("event_id") % 6).cast("int")))).otherwise(F.array("timestamp"))))
stream("T8_stream_dedup", "SELECT id FROM ev", dressed=_TWICE)(lambda x, spark, sf: st.stream_dedup(x.select("id", "timestamp"), _LATE).select("id"))
stream("T10_stream_novelty", "SELECT \"user\" || '>' || destination_ip AS key, min(timestamp)::TIMESTAMP AS first_seen FROM ev GROUP BY 1")(
    lambda x, spark, sf: _ntz(st.stream_novelty(x, "user", "destination_ip", _LATE).select("key", "first_seen"), "first_seen"))


# A group of failures for each host and slice: a host's finding grows batch by batch, and the last batch is played twice.
@query("T7_stream_findings", f"""SELECT 'hostfail|' || host AS dedup_key, count(*) AS match_count, min(timestamp) AS first_seen, max(timestamp) AS last_seen, 'medium' AS severity, 20.0::DOUBLE AS risk_score FROM ev WHERE {_F} GROUP BY host""")
def _stream_findings(spark, sf):
    folder = new_folder(spark, "stream")
    e = k.events(spark, sf).where(sec._failed())
    groups = e.withColumn("slice", _slice(e)).groupBy("slice", F.col("host").alias("group_key")).agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"))
    sdf = landed(spark, groups, F.col("slice"), folder)
    rule = ("hostfail", "Failures", "medium")
    st.stream_findings(sdf, folder + "/findings", *rule, folder + "/checkpoint").awaitTermination()
    st.upsert_findings(groups.where(F.col("slice") == SLICES - 1), SLICES - 1, folder + "/findings", *rule)
    return st.current_findings(spark, folder + "/findings", SLICES - 1).select("dedup_key", "match_count", "first_seen", "last_seen", "severity", "risk_score")


query("T9_late_events", "WITH r AS (SELECT *, timestamp + INTERVAL 1 HOUR * (event_id % 3) AS received_at FROM ev), b AS (SELECT received_at, max(timestamp) AS m FROM r GROUP BY 1), w AS (SELECT received_at, max(m) OVER (ORDER BY received_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM b) SELECT id FROM r JOIN w USING (received_at) WHERE timestamp < mark - INTERVAL 30 MINUTE")(
    lambda spark, sf: st.late_events(k.events(spark, sf).withColumn("received_at", F.col("timestamp") + F.make_dt_interval(hours=(F.col("event_id") % 3).cast("int"))), "30 minutes").select("id"))

# The open chain behind a key's last step event, if the key has not been quiet for too long since.
_PENDING = f"""SELECT key, 1 AS step, t0 AS first_event, t AS last_event, id0 AS event_ids, t + INTERVAL 2 DAY AS expires_at FROM f WHERE nxt = 1"""


def _pending_sql(now: str) -> str:
    return f"{sec._SEQ[: sec._SEQ.rindex('SELECT key, s AS start')]}{_PENDING} AND rn = (SELECT max(rn) FROM o WHERE o.key = f.key) AND epoch_ms(t) + 172800000 + 1 >= {now}"


_STATE_COLUMNS = ("key", "step", "first_event", "last_event", "event_ids", "expires_at")


@query("T9_sequence_states", _pending_sql(_MARK))
def _sequence_states(spark, sf):
    """The state of a sequence stream that has stopped: what it still waits for."""
    folder = new_folder(spark, "stream")
    e = k.events(spark, sf).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    st.run_available(st.stream_sequence(landed(spark, e, _slice(e), folder), "user", sec._STEPS(), "2d", late=_LATE), folder + "/out", folder + "/checkpoint")
    return keyed.sequence_states(spark, folder + "/checkpoint", "failed-bought", "2d").withColumn("event_ids", F.array_join("event_ids", ",")).select(*_STATE_COLUMNS)


@query("T9_pending_sequences", _pending_sql("(SELECT epoch_ms(max(timestamp)) FROM ev)"))
def _pending(spark, sf):
    e = k.events(spark, sf)
    return d.pending_sequences(e, "user", sec._STEPS(), "2d", k.latest(e)).withColumn("event_ids", F.array_join("event_ids", ",")).select(*_STATE_COLUMNS)


@query("S15_tail_events", "SELECT id, host, message FROM ev")
def _tail(spark, sf):
    """Log files that grow: after each slice of events a run picks up the lines that have come."""
    folder = new_folder(spark, "tail")
    e = k.events(spark, sf)
    lines = e.select(F.to_json(F.struct("id", "host", "message")).alias("value"), _slice(e).alias("slice"))
    for n in range(SLICES):
        lines.where(F.col("slice") == n).select("value").write.mode("append").text(folder + "/logs")
        tail.tail_run(spark, folder + "/logs", folder + "/offsets", lambda found, number: found.select("id", "host", "message").write.mode("overwrite").parquet(f"{folder}/events/run={number}"))
    return spark.read.parquet(folder + "/events").select("id", "host", "message")
