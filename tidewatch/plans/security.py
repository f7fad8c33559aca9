"""Queries of joins, detections, findings, risk, intelligence, graph, assets, sources and streams."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import assets as a
from ..operators import detect as d
from ..operators import findings as fd
from ..operators import graph as g
from ..operators import intel as i
from ..operators import joins as j
from ..operators import risk as r
from ..operators import stats as s
from ..scratch import new_folder
from ..sources import events as src
from ..sources import parsers as ps
from . import canonical as k
from .registry import events_query as q
from .registry import query

_N = "(SELECT max(timestamp) FROM ev)"
_ALL = (k.EV, k.ASSETS, k.META, k.INDICATORS, k.GEO)


def _now(e: DataFrame):
    return F.lit(k.latest(e)).cast("timestamp_ntz")


def _failed():
    return (F.col("event_type") == "authentication") & (F.col("outcome") == "failure")


def full(name: str, sql: str | None = None, views=_ALL):
    """A query of events, assets, metadata, indicators and ranges."""

    def add(f):
        query(name, sql, views)(lambda spark, sf: f(k.events(spark, sf), k.assets(spark, sf), k.entity_meta(spark, sf), k.indicators(spark, sf), k.geo_ranges(spark, sf)))
        return f

    return add


# --- joins -----------------------------------------------------------------------------------------------------------------
full("J1_lookup", "SELECT id, criticality, environment FROM ev LEFT JOIN assets ON host = name")(lambda e, a_, m, n, x: j.lookup(e.select("id", "host"), a_, {"host": "name"}, ["criticality", "environment"]).select("id", "criticality", "environment"))
_EDGES = """edges AS (SELECT from_type, from_value, to_type, to_value, relation, count(*) AS weight, min(timestamp) AS created_at FROM (
  SELECT 'ip' AS from_type, source_ip AS from_value, 'ip' AS to_type, destination_ip AS to_value, 'connected_to' AS relation, timestamp FROM ev UNION ALL
  SELECT 'user', "user", 'host', host, 'auth_from', timestamp FROM ev UNION ALL SELECT 'host', host, 'process', process, 'executed', timestamp FROM ev) GROUP BY ALL)"""
_ENT = """ent AS (SELECT type, value, min(timestamp) AS first_seen, max(timestamp) AS last_seen, count(*) AS count FROM (
  SELECT 'ip' AS type, source_ip AS value, timestamp FROM ev UNION ALL SELECT 'ip', destination_ip, timestamp FROM ev UNION ALL SELECT 'user', "user", timestamp FROM ev UNION ALL
  SELECT 'host', host, timestamp FROM ev UNION ALL SELECT 'process', process, timestamp FROM ev) GROUP BY ALL)"""
_STATE = """state AS (SELECT from_type, from_value, to_type, to_value, relation, arg_min(s, (timestamp, id)) AS status FROM (
  SELECT 'ip' AS from_type, source_ip AS from_value, 'ip' AS to_type, destination_ip AS to_value, 'connected_to' AS relation, timestamp, id, CASE outcome WHEN 'failure' THEN 'blocked' ELSE 'observed' END AS s FROM ev UNION ALL
  SELECT 'user', "user", 'host', host, 'auth_from', timestamp, id, CASE outcome WHEN 'failure' THEN 'blocked' ELSE 'observed' END FROM ev UNION ALL SELECT 'host', host, 'process', process, 'executed', timestamp, id, 'observed' FROM ev) GROUP BY ALL)"""
_GV = (k.EV, k.ASSETS, _EDGES, _ENT, _STATE)


def graph(name: str, sql: str | None = None):
    """A query of (edges with states, entities, assets) of the events."""

    def add(f):
        def run(spark, sf):
            e = k.events(spark, sf)
            return f(j.edges_with_state(g.relationships_from_events(e), g.edge_states(e)), g.entities_from_events(e), k.assets(spark, sf))

        query(name, sql, _GV)(run)
        return f

    return add


graph("J2_edges_with_state", "SELECT e.*, coalesce(s.status, 'observed') AS status FROM edges e LEFT JOIN state s USING (from_type, from_value, to_type, to_value, relation)")(lambda e, n, a_: e)
graph("J3_neighbors", "SELECT x.*, ent.count FROM (SELECT to_type AS type, to_value AS value, relation, 'out' AS direction FROM edges WHERE from_type = 'host' AND from_value = 'h3' UNION SELECT from_type, from_value, relation, 'in' FROM edges WHERE to_type = 'host' AND to_value = 'h3') x LEFT JOIN ent USING (type, value)")(lambda e, n, a_: j.neighbors(e, n, "host", "h3"))
q("J4_related_events", "SELECT id FROM ev WHERE source_ip = '10.0.1.1' OR destination_ip = '10.0.1.1' ORDER BY timestamp DESC, id LIMIT 50")(lambda e: j.related_events(e, "ip", "10.0.1.1", 50).select("id"))
full("J5_local_ip_enrich", "SELECT id, a.d AS source_description, b.d AS destination_description FROM ev LEFT JOIN (SELECT value, min(feed) AS d FROM ind GROUP BY 1) a ON a.value = source_ip LEFT JOIN (SELECT value, min(feed) AS d FROM ind GROUP BY 1) b ON b.value = destination_ip")(
    lambda e, a_, m, n, x: j.local_ip_enrich(e, n.select(F.col("value").alias("ip"), F.col("feed").alias("description"))).select("id", "source_description", "destination_description"))
full("J6_geo_enrich", "WITH ip AS (SELECT DISTINCT source_ip, 167772160 + split_part(source_ip, '.', 3)::INT * 256 + split_part(source_ip, '.', 4)::INT AS n FROM ev) SELECT ev.id, g.country AS geoip_country, g.lat AS geoip_lat FROM ev JOIN ip USING (source_ip) LEFT JOIN geo g ON n BETWEEN lo AND hi")(
    lambda e, a_, m, n, x: j.geo_enrich(e.select("id", "source_ip"), x).select("id", "geoip_country", "geoip_lat"))
_MATCH = "mt AS (SELECT DISTINCT id, indicator_id, value, severity, confidence, column_ AS \"column\" FROM (SELECT id, source_ip AS v, 'source_ip' AS column_, timestamp FROM ev UNION ALL SELECT id, destination_ip, 'destination_ip', timestamp FROM ev) JOIN ind ON v = value)"
full("J7_ti_match", f"WITH {_MATCH} SELECT id, indicator_id, value, severity, confidence, \"column\" FROM mt")(lambda e, a_, m, n, x: j.ti_match(e, n).drop("type"))
full("J8_asset_enrich", "SELECT id, criticality, internet_exposed FROM ev LEFT JOIN assets ON entity_ref = 'host:' || host")(lambda e, a_, m, n, x: j.asset_enrich(e, a_).select("id", "criticality", "internet_exposed"))
full("J9_identity_enrich", 'SELECT id, privilege FROM ev LEFT JOIN meta USING ("user")')(lambda e, a_, m, n, x: j.identity_enrich(e, m).select("id", "privilege"))


@query("J10_actors_of", "SELECT s_suppkey AS indicator_id, n_name AS actor FROM supplier JOIN nation n ON n.n_regionkey = s_nationkey % 5 QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY n_name) <= 3", views=("x AS (SELECT 1)",))
def _actors(spark, sf):
    n = k.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("indicator_id"), (F.col("s_nationkey") % 5).alias("group"))
    return j.linked(n.select("indicator_id"), n, k.read(spark, sf, "nation").select(F.col("n_regionkey").alias("group"), F.col("n_name").alias("actor")), "group", "actor", 3)


q("J13_active_entities", f"SELECT id FROM ev WHERE \"user\" IN (SELECT \"user\" FROM ev WHERE timestamp > {_N} - INTERVAL 1 DAY)")(lambda e: j.active_entities(e, _now(e), 1).select("id"))
q("J14_exclude_known", "SELECT DISTINCT \"user\", destination_ip FROM ev WHERE source = 'error' AND (\"user\", destination_ip) NOT IN (SELECT (\"user\", destination_ip) FROM ev WHERE source = 'signup')")(
    lambda e: j.exclude_known(e.where("source = 'error'").select("user", "destination_ip").distinct(), e.where("source = 'signup'").select("user", "destination_ip").distinct(), ["user", "destination_ip"]))
q("J15_prev_event", 'SELECT id, lag(id) OVER (PARTITION BY "user" ORDER BY timestamp, id) AS prev_id FROM ev')(lambda e: j.prev_event(e, "user", ["id"]).select("id", "prev_id"))

# --- detections ------------------------------------------------------------------------------------------------------------
_F = "event_type = 'authentication' AND outcome = 'failure'"
q("D1_threshold_rule", f"SELECT \"user\" AS group_key, count(*) AS n, min(timestamp) AS first_seen, max(timestamp) AS last_seen FROM ev WHERE {_F} AND timestamp >= {_N} - INTERVAL 5 DAY GROUP BY 1 HAVING count(*) >= 3")(lambda e: d.threshold_rule(e, _failed(), 3, "5d", ["user"], _now(e)).select("group_key", "n", "first_seen", "last_seen"))
q("D2_threshold_windowed", f"SELECT time_bucket(INTERVAL 1 DAY, timestamp, TIMESTAMP '1970-01-01') AS window_start, time_bucket(INTERVAL 1 DAY, timestamp, TIMESTAMP '1970-01-01') + INTERVAL 1 DAY AS window_end, host, count(*) AS n FROM ev WHERE {_F} GROUP BY ALL HAVING count(*) >= 3")(lambda e: d.threshold_rule_windowed(e, _failed(), 3, "1d", ["host"]))
q("D3_row_rule", "SELECT 'host=' || host || ',user=' || \"user\" AS group_key, count(*) AS count FROM ev GROUP BY host, \"user\" HAVING count(*) >= 60")(lambda e: d.row_rule(s.stats(e, ["count"], ["host", "user"]), 60, "count").select("group_key", "count"))
_SEQ = """WITH RECURSIVE """ + k.EV + """, st AS (SELECT "user" AS key, timestamp AS t, id, CASE WHEN source = 'error' THEN 0 WHEN source = 'purchase' THEN 1 END AS step FROM ev WHERE source IN ('error', 'purchase')),
 o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t, id) AS rn, CASE WHEN t - lag(t) OVER (PARTITION BY key ORDER BY t, id) > INTERVAL 2 DAY THEN 1 ELSE 0 END AS brk FROM st),
 f AS (SELECT key, rn, t, id, CASE WHEN step = 0 THEN 1 ELSE 0 END AS nxt, CASE WHEN step = 0 THEN t END AS t0, CASE WHEN step = 0 THEN id END AS id0, false AS fire, NULL::TIMESTAMP AS s, NULL::VARCHAR AS sid FROM o WHERE rn = 1 UNION ALL
  SELECT o.key, o.rn, o.t, o.id, CASE WHEN o.brk = 1 OR f.nxt = 0 THEN CASE WHEN step = 0 THEN 1 ELSE 0 END WHEN step = 1 THEN 0 ELSE 1 END,
   CASE WHEN o.brk = 1 OR f.nxt = 0 THEN CASE WHEN step = 0 THEN o.t END WHEN step = 1 THEN NULL ELSE f.t0 END, CASE WHEN o.brk = 1 OR f.nxt = 0 THEN CASE WHEN step = 0 THEN o.id END WHEN step = 1 THEN NULL ELSE f.id0 END,
   o.brk = 0 AND f.nxt = 1 AND step = 1, CASE WHEN o.brk = 0 AND f.nxt = 1 AND step = 1 THEN f.t0 END, CASE WHEN o.brk = 0 AND f.nxt = 1 AND step = 1 THEN f.id0 END
  FROM f JOIN o ON o.key = f.key AND o.rn = f.rn + 1)
 SELECT key, s AS start, t AS "end", sid || ',' || id AS ids FROM f WHERE fire"""
_STEPS = lambda: [("failed", F.col("source") == "error"), ("bought", F.col("source") == "purchase")]
q("D5_sequence_rule", _SEQ)(lambda e: d.sequence_rule(e, "user", _STEPS(), "2d").withColumn("ids", F.array_join("ids", ",")))
_TESTS = lambda: {"fail": (F.col("source") == "error", 2), "buy": (F.col("source") == "purchase", 1)}
q("D6_correlation_rule", """, c AS (SELECT "user" AS key, timestamp, id, ((count(*) FILTER (source = 'error') OVER w) >= 2)::INT + ((count(*) FILTER (source = 'purchase') OVER w) >= 1)::INT AS matched FROM ev WINDOW w AS (PARTITION BY "user" ORDER BY timestamp RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW)),
 b AS (SELECT *, coalesce(lag(matched >= 2) OVER (PARTITION BY key ORDER BY timestamp, id), false) AS before FROM c) SELECT key, timestamp, id, matched, 0.7::DOUBLE AS confidence FROM b WHERE matched >= 2 AND NOT before""".lstrip(", ").replace("c AS", "WITH c AS", 1))(
    lambda e: d.correlation_rule(e, "user", _TESTS(), "24h"))
q("D7_login_baselines", f"""WITH act AS (SELECT DISTINCT "user" FROM ev WHERE timestamp > {_N} - INTERVAL 7 DAY), h AS (SELECT "user" AS entity_value, date_trunc('hour', timestamp) AS hour, count(*)::DOUBLE AS x FROM ev WHERE event_type = 'authentication' AND timestamp >= {_N} - INTERVAL 30 DAY AND timestamp < {_N} AND "user" IN (SELECT "user" FROM act) GROUP BY 1, 2)
 SELECT 'user' AS entity_type, entity_value, 'logins_per_hour' AS feature, 30 AS window_days, round(avg(x), 6) AS mean, round(coalesce(stddev_samp(x), 0), 6) AS stddev, quantile_disc(x, 0.95) AS p95, count(*) AS sample_count FROM h GROUP BY 2""")(
    lambda e: d.login_baselines(e, _now(e)).withColumn("mean", F.round("mean", 6)).withColumn("stddev", F.round("stddev", 6)))
_BYTES = f"h AS (SELECT host AS entity_value, date_trunc('hour', timestamp) AS hour, sum(bytes)::DOUBLE AS x FROM ev WHERE timestamp >= {_N} - INTERVAL 30 DAY AND timestamp < {_N} GROUP BY 1, 2), bl AS (SELECT 'host' AS entity_type, entity_value, 'bytes_per_hour' AS feature, 30 AS window_days, avg(x) AS mean, coalesce(stddev_samp(x), 0) AS stddev, quantile_disc(x, 0.95) AS p95, count(*) AS sample_count FROM h GROUP BY 2)"
q("D8_bytes_baselines", f"WITH {_BYTES} SELECT entity_type, entity_value, feature, window_days, round(mean, 4) AS mean, round(stddev, 4) AS stddev, p95, sample_count FROM bl")(lambda e: d.bytes_baselines(e, _now(e)).withColumn("mean", F.round("mean", 4)).withColumn("stddev", F.round("stddev", 4)))


def _latest_hour(e):
    """Each host's newest hour beside its baseline."""
    past = e.where((F.col("timestamp") < _now(e)) & (F.col("timestamp") >= _now(e) - F.expr("interval 30 days")))
    newest = d.hourly(past, "host", F.sum("bytes")).groupBy("entity_value").agg(F.max_by("x", "hour").alias("observed"))
    observed = newest.select(F.lit("host").alias("entity_type"), "entity_value", F.lit("bytes_per_hour").alias("feature"), "observed")
    return j.baseline_lookup(observed, d.bytes_baselines(e, _now(e))).select("entity_value", "observed", F.round("mean", 4).alias("mean"), "p95", "sample_count")


q("J16_baseline_lookup", f"WITH {_BYTES}, o AS (SELECT entity_value, arg_max(x, hour) AS observed FROM h GROUP BY 1) SELECT entity_value, observed, round(mean, 4) AS mean, p95, sample_count FROM o JOIN bl USING (entity_value)")(_latest_hour)
_Z = f"ob AS (SELECT entity_value, hour, x AS observed FROM h), zz AS (SELECT bl.entity_value, ob.hour, round((observed - mean) / stddev, 6) AS z FROM ob JOIN bl USING (entity_value) WHERE sample_count >= 20 AND (observed - mean) / stddev >= 2)"


@q("D9_z_anomalies", f"WITH {_BYTES}, {_Z} SELECT entity_value, z, CASE WHEN z >= 4 THEN 15 WHEN z >= 3 THEN 10 ELSE 5 END AS points FROM zz")
def _z(e):
    hours = d.hourly(e.where(F.col("timestamp") < _now(e)).where(F.col("timestamp") >= _now(e) - F.expr("interval 30 days")), "host", F.sum("bytes"))
    obs = hours.select(F.lit("host").alias("entity_type"), "entity_value", F.lit("bytes_per_hour").alias("feature"), F.col("x").alias("observed"))
    return d.z_anomalies(obs, d.bytes_baselines(e, _now(e))).select("entity_value", F.round("z", 6).alias("z"), "points")


q("D10_novelty", f"WITH f AS (SELECT \"user\", destination_ip, min(timestamp) AS first_seen FROM ev GROUP BY 1, 2) SELECT 'user' AS entity_type, \"user\" AS entity_value, 'first_seen_destination' AS feature, arg_max(destination_ip, (first_seen, destination_ip)) AS value, max(first_seen) AS first_seen, 5 AS points FROM f WHERE first_seen >= {_N} - INTERVAL 240 HOUR GROUP BY 2")(
    lambda e: d.novelty(e, "user", "destination_ip", "first_seen_destination", _now(e), hours=240))
_HAV = "2 * 6371.0 * asin(sqrt(least(power(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin((radians(b.lon) - radians(a.lon)) / 2), 2), 1.0)))"


@full("D11_impossible_travel", f"""WITH l AS (SELECT "user", id, timestamp, k, lat, lon, lag(id) OVER (PARTITION BY "user" ORDER BY timestamp, id) AS p_id FROM (SELECT ev.*, geo.k, geo.lat, geo.lon FROM ev JOIN geo ON geo.k = event_id % 25 WHERE event_type = 'authentication'))
 SELECT b."user", b.id, a.id AS p_id, round({_HAV}, 3) AS km, CASE WHEN a.k % 5 = 0 OR b.k % 5 = 0 THEN 0 ELSE 15 END AS points FROM l a JOIN l b ON b.p_id = a.id WHERE {_HAV} > 900 * (epoch_us(b.timestamp) - epoch_us(a.timestamp)) / 3600000000.0""")
def _travel(e, a_, m, n, x):
    at = e.where("event_type = 'authentication'").join(x, F.col("event_id") % 25 == F.col("k")).select("user", "id", "timestamp", F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), (F.col("k") % 5 == 0).alias("vpn"))
    return d.impossible_travel(at).select("user", "id", "p_id", F.round("km", 3).alias("km"), "points")


RULES = [
    {"id": "r1", "level": "high", "tags": ["attack.credential_access", "attack.t1110"], "detection": {"sel": {"outcome": "failure", "message|contains": ["user=u1", "user=u2"]}, "condition": "sel"}},
    {"id": "r2", "level": "low", "tags": ["attack.discovery"], "detection": {"a": {"source|startswith": "pur"}, "b": {"host|endswith": "7"}, "c": {"severity": ["notice", "err"]}, "condition": "2 of them and not (b)"}},
]
q("D12_sigma_rules", "SELECT id, 'r1' AS rule_id, 'high' AS severity, 'credential_access' AS tactic, 'T1110' AS technique FROM ev WHERE outcome = 'failure' AND (message LIKE '%user=u1%' OR message LIKE '%user=u2%') UNION ALL SELECT id, 'r2', 'low', 'discovery', NULL FROM ev WHERE (source LIKE 'pur%')::INT + (host LIKE '%7')::INT + (severity IN ('notice', 'err'))::INT >= 2 AND NOT host LIKE '%7'")(lambda e: d.sigma_rules(e, RULES))
# Events dressed as the sources that the hunts read, by expressions that Spark and DuckDB share; all of a month fall into one window.
_DRESS = {
    "timestamp": "CAST(date_trunc('month', timestamp) AS {ntz})",
    "source_type": "CASE event_id % 9 WHEN 0 THEN 'os.linux.auditd' WHEN 1 THEN 'os.linux.sshd' WHEN 2 THEN 'os.darwin.unified' WHEN 3 THEN 'net.firewall.generic' WHEN 4 THEN 'web.nginx.access' "
    "WHEN 5 THEN 'os.windows.sysmon' WHEN 6 THEN 'os.windows.security' WHEN 7 THEN 'os.windows.powershell' ELSE 'app' END",
    "event_type": "CASE event_id % 7 WHEN 0 THEN 'authentication' WHEN 1 THEN 'authentication' WHEN 2 THEN 'admin' WHEN 3 THEN 'intrusion_attempt' ELSE 'network' END",
    "user": "concat('u', event_id % 5)",
    "source_ip": "CASE event_id % 11 WHEN 0 THEN '10.0.0.1' ELSE '10.0.0.2' END",
    "destination_ip": "CASE event_id % 23 WHEN 0 THEN '10.9.0.1' ELSE '10.9.0.2' END",
    "host": "CASE event_id % 13 WHEN 0 THEN 'h1' ELSE 'h2' END",
    "process": "CASE event_id % 17 WHEN 0 THEN 'cmd.exe' ELSE 'powershell.exe' END",
    "file_path": "CASE event_id % 4 WHEN 0 THEN '/etc/cron.d/job' WHEN 1 THEN '/home/a/Library/LaunchAgents/a.plist' ELSE '/var/etc/cron.d' END",
    "action": "CASE event_id % 5 WHEN 0 THEN 'create' WHEN 1 THEN 'modify' ELSE 'read' END",
    "status_code": "CASE event_id % 8 WHEN 0 THEN '200' WHEN 1 THEN '403' WHEN 2 THEN 'none' ELSE '404' END",
    "message": "CASE event_id % 10 WHEN 0 THEN 'GET /../x' WHEN 1 THEN 'LSASS.exe 0x1010' WHEN 2 THEN 'comsvcs.dll 0x1410' WHEN 3 THEN 'logon 4624 type 10' WHEN 4 THEN 'SCHTASKS created' WHEN 5 THEN 'run -enc AA' "
    "WHEN 6 THEN CASE event_id % 4 WHEN 0 THEN 'GET /a%00b' ELSE 'GET /index 200' END WHEN 7 THEN 'IEX x' WHEN 8 THEN 'GET <script src>' ELSE 'UNION+select' END",
}
_dressed = lambda e: e.withColumns({c: F.expr(x.format(ntz="timestamp_ntz")) for c, x in _DRESS.items()})
_HUNTS = (
    ("brute_force_login", "high", "'T1110'", "event_type = 'authentication' AND outcome = 'failure'", "source_ip || '|' || \"user\"", 5, "5 minutes"),
    ("intrusion_attempt", "critical", "NULL", "event_type = 'intrusion_attempt'", "'global'", 1, "1 hour"),
    ("linux_cron_persistence", "high", "'T1053.003'", "source_type = 'os.linux.auditd' AND file_path LIKE '/etc/cron%' AND action IN ('create', 'modify')", "host || '|' || \"user\"", 1, "15 minutes"),
    ("linux_ssh_brute_force", "medium", "'T1110.001,T1021.004'", "source_type = 'os.linux.sshd' AND outcome = 'failure'", "source_ip || '|' || \"user\"", 10, "10 minutes"),
    ("macos_launchagent_persistence", "high", "'T1543.001'", "source_type = 'os.darwin.unified' AND file_path LIKE '%/Library/LaunchAgents%' AND action IN ('create', 'modify')", "host || '|' || \"user\"", 1, "15 minutes"),
    ("net_beaconing", "high", "'T1071'", "source_type = 'net.firewall.generic' AND outcome = 'success'", "host || '|' || destination_ip", 60, "1 hour"),
    ("net_port_scanning", "medium", "'T1595.001'", "source_type = 'net.firewall.generic' AND outcome = 'failure'", "source_ip", 100, "10 minutes"),
    ("web_exploitation", "high", "'T1190'", "source_type = 'web.nginx.access' AND (contains(message, '../') OR message ILIKE '%union+select%' OR contains(message, '%00') OR message LIKE '%<script%>')", "source_ip || '|' || host", 1, "15 minutes"),
    ("web_scanning", "medium", "'T1595'", "source_type = 'web.nginx.access' AND TRY_CAST(status_code AS DOUBLE) >= 404", "source_ip", 50, "10 minutes"),
    ("win_lsass_access", "critical", "'T1003.001'", "source_type = 'os.windows.sysmon' AND message ILIKE '%lsass.exe%' AND contains(message, '0x1010')", "host || '|' || process", 1, "15 minutes"),
    ("win_rdp_lateral_movement", "high", "'T1021.001'", "source_type = 'os.windows.security' AND event_type = 'authentication' AND contains(message, '4624') AND contains(message, '10')", "\"user\" || '|' || source_ip", 3, "1 hour"),
    ("win_scheduled_task_persistence", "high", "'T1053.005'", "source_type = 'os.windows.security' AND event_type = 'admin' AND message ILIKE '%schtasks%'", "host || '|' || \"user\"", 1, "15 minutes"),
    ("win_suspicious_powershell", "high", "'T1059.001,T1105'", "source_type = 'os.windows.powershell' AND process = 'powershell.exe' AND (contains(message, '-enc') OR contains(message, 'IEX'))", "host || '|' || \"user\"", 1, "15 minutes"),
)
_HUNT_SQL = " UNION ALL ".join(
    f"SELECT '{r}' AS rule, '{sev}' AS severity, {t} AS technique, time_bucket(INTERVAL '{w}', timestamp, TIMESTAMP '1970-01-01') AS window_start, {key} AS group_key, count(*) AS n FROM hv WHERE {test} GROUP BY ALL HAVING count(*) >= {least}"
    for r, sev, t, test, key, least, w in _HUNTS
)
_DRESS_SQL = ", ".join(f"{x.format(ntz='TIMESTAMP')} AS \"{c}\"" for c, x in _DRESS.items())
q("D13_hunting_catalog", f", hv AS (SELECT {_DRESS_SQL}, outcome FROM ev) {_HUNT_SQL}")(lambda e: d.hunting_catalog(_dressed(e)))
MAPPING = [
    {"id": "m1", "technique": "T1110", "tactic": "credential_access", "confidence": 0.8, "when": {"event_type": "authentication", "outcome": "failure"}},
    {"id": "m2", "technique": "T1110", "tactic": "credential_access", "confidence": 0.5, "when": {"contains": "error"}},
    {"id": "m3", "technique": "T1078", "tactic": "initial_access", "confidence": 0.6, "when": {"regex": "signup value=[0-9]+"}},
    {"id": "m4", "technique": "T1041", "tactic": "exfiltration", "confidence": 0.4, "when": {"source_type": "app", "attribute": {"k": "^9"}}},
]
_MAP = "mp AS (SELECT id, host, \"user\", timestamp, outcome, 'T1110' AS technique, 'credential_access' AS tactic, 0.8::DOUBLE AS confidence, 'm1' AS rule FROM ev WHERE source = 'error' UNION ALL SELECT id, host, \"user\", timestamp, outcome, 'T1078', 'initial_access', 0.6, 'm3' FROM ev WHERE source = 'signup' UNION ALL SELECT id, host, \"user\", timestamp, outcome, 'T1041', 'exfiltration', 0.4, 'm4' FROM ev WHERE json_extract_string(attributes, '$.k') LIKE '9%')"
q("D14_attack_map", f"WITH {_MAP} SELECT * FROM mp")(lambda e: d.attack_map(e, MAPPING))
q("D15_technique_events", f"WITH {_MAP} SELECT id FROM mp WHERE technique = 'T1110' ORDER BY timestamp DESC, id LIMIT 40")(lambda e: d.technique_events(d.attack_map(e, MAPPING), "T1110", 40).select("id"))
q("X37_technique_names", f"WITH {_MAP} SELECT id, technique || '.001' AS technique, technique AS parent, CASE technique WHEN 'T1110' THEN 'Brute Force' WHEN 'T1078' THEN 'Valid Accounts' END AS technique_name FROM mp")(
    lambda e: d.technique_names(d.attack_map(e, MAPPING).select("id", F.concat("technique", F.lit(".001")).alias("technique")), e.sparkSession.createDataFrame([("T1110", "Brute Force", "Credential Access"), ("t1078", "Valid Accounts", "Initial Access")], "technique string, name string, tactic_name string"))
    .select("id", "technique", d.technique_parent("technique").alias("parent"), "technique_name"))
SCENARIO = {"id": "web_compromise", "trigger": "T1110", "techniques": ["T1110", "T1078", "T1041", "T1059"]}
_RUNS = f"{_MAP}, rn AS (SELECT 'web_compromise:' || host AS run_id, 'web_compromise' AS scenario, host, min(timestamp) AS started_at FROM mp WHERE technique = 'T1110' AND timestamp >= {_N} - INTERVAL 6 HOUR GROUP BY host)"
q("D16_scenario_runs", f"WITH {_RUNS} SELECT * FROM rn")(lambda e: d.scenario_runs(d.attack_map(e, MAPPING), SCENARIO, _now(e)))
_ST = _RUNS + f""", sx AS (SELECT rn.run_id, rn.host, rn.started_at, t.technique, count(mp.id) AS n, count(mp.id) FILTER (mp.outcome <> 'failure') AS ok, string_agg(mp.id, ',' ORDER BY mp.id) AS evidence FROM rn CROSS JOIN (SELECT unnest(['T1110', 'T1078', 'T1041', 'T1059']) AS technique) t
  LEFT JOIN mp ON mp.host = rn.host AND mp.technique = t.technique AND mp.timestamp >= rn.started_at GROUP BY 1, 2, 3, 4),
 ss AS (SELECT *, CASE WHEN ok > 0 THEN 'observed' WHEN n > 0 THEN 'blocked' WHEN technique = 'T1059' THEN 'unknown' WHEN started_at > {_N} - INTERVAL 2 HOUR THEN 'expected' ELSE 'missing' END AS status FROM sx)"""


def _steps(e):
    mapped = d.attack_map(e, MAPPING)
    cover = e.select("host", F.explode(F.array(*map(F.lit, ("T1110", "T1078", "T1041")))).alias("technique")).distinct()
    return d.scenario_steps(mapped, d.scenario_runs(mapped, SCENARIO, _now(e)), SCENARIO["techniques"], cover, _now(e))


q("D17_scenario_steps", f"WITH {_ST} SELECT run_id, technique, status, coalesce(evidence, '') AS evidence, round(CASE WHEN n > 0 THEN least(0.95, 0.6 + 0.1 * (n - 1)) WHEN status = 'missing' THEN 0.6 ELSE 0 END, 4)::DOUBLE AS confidence FROM ss")(lambda e: _steps(e).select("run_id", "technique", "status", F.array_join("evidence", ",").alias("evidence"), "confidence"))
q("D18_scenario_scores", f"WITH {_ST}, fr AS (SELECT run_id, started_at, avg((status = 'observed')::INT) AS f FROM ss GROUP BY 1, 2) SELECT run_id, CASE WHEN f >= 1 THEN 'completed' WHEN started_at < {_N} - INTERVAL 48 HOUR THEN 'stale' ELSE 'active' END AS state, round(40.0 * f * 0.75, 4)::DOUBLE AS risk, round(0.5 * f, 4)::DOUBLE AS confidence FROM fr")(lambda e: d.scenario_scores(_steps(e), F.lit(0.75), _now(e)))
q("D19_what_next", f"WITH {_ST} SELECT run_id, coalesce(string_agg(technique, ',' ORDER BY technique) FILTER (status = 'expected'), '') AS expected, coalesce(string_agg(technique, ',' ORDER BY technique) FILTER (status = 'unknown'), '') AS unknown FROM ss GROUP BY 1")(lambda e: d.what_next(_steps(e)).select("run_id", F.array_join("expected", ",").alias("expected"), F.array_join("unknown", ",").alias("unknown")))

# --- findings --------------------------------------------------------------------------------------------------------------
_FI = f"""fi AS (SELECT 'f-' || left(sha256('brute|' || "user"), 12) AS id, 'brute|' || "user" AS dedup_key, 'Brute force — ' || "user" AS title, 'high' AS severity, 'new' AS status, 70.0::DOUBLE AS risk_score, 'brute' AS detection_id, "user", arg_min(host, (timestamp, id)) AS host, arg_min(source_ip, (timestamp, id)) AS source_ip, arg_min(destination_ip, (timestamp, id)) AS destination_ip,
  count(*) AS match_count, min(timestamp) AS first_seen, max(timestamp) AS last_seen FROM ev WHERE {_F} GROUP BY "user" HAVING count(*) >= 8)"""


def _findings(e):
    groups = d.threshold_rule(e, _failed(), 8, "3650d", ["user"], _now(e))
    return fd.new_findings(groups, "brute", "Brute force", "high", "credential_access", "T1110")


def _part(e, rest: int, name: str, severity: str):
    """Findings of a third of the failures, two of a user at least."""
    groups = d.threshold_rule(e.where(F.col("event_id") % 3 == rest), _failed(), 2, "3650d", ["user"], _now(e))
    return fd.new_findings(groups, "brute", name, severity, "credential_access", "T1110")


_PART = "SELECT \"user\" AS u, count(*) AS n, min(timestamp) AS f, max(timestamp) AS l FROM ev WHERE event_type = 'authentication' AND outcome = 'failure' AND event_id % 3 = {} GROUP BY 1 HAVING count(*) >= 2"
# Known findings and new ones: some on one side only, some on both with another severity.
q("D20_findings_upsert", f"""WITH a AS ({_PART.format(0)}), b AS ({_PART.format(1)}) SELECT 'f-' || left(sha256('brute|' || coalesce(a.u, b.u)), 12) AS id, 'brute|' || coalesce(a.u, b.u) AS dedup_key, coalesce(a.n, 0) + coalesce(b.n, 0) AS match_count,
 least(a.f, b.f) AS first_seen, greatest(a.l, b.l) AS last_seen, CASE WHEN b.u IS NULL THEN 35.0 ELSE 50.0 END::DOUBLE AS risk_score, CASE WHEN a.u IS NULL THEN 'critical' ELSE 'high' END AS severity FROM a FULL JOIN b ON a.u = b.u""")(
    lambda e: fd.findings_upsert(_part(e, 0, "Brute force", "high"), _part(e, 1, "Brute force again", "critical")).select("id", "dedup_key", "match_count", "first_seen", "last_seen", "risk_score", "severity"))
q("D21_query_table", f"WITH {_FI} SELECT id, title, match_count FROM fi WHERE severity = 'high' AND (title ILIKE '%U1%' OR host ILIKE '%u1%') AND risk_score >= 30 ORDER BY match_count DESC, id LIMIT 20")(lambda e: fd.query_table(_findings(e), {"severity": "high"}, {"title,host": "U1"}, {"risk_score": (30, None)}, sort="-match_count", limit=20).select("id", "title", "match_count"))
q("D22_primary_entities", 'SELECT host, arg_min("user", (timestamp, id)) AS "user", arg_min(source_ip, (timestamp, id)) AS source_ip, arg_min(destination_ip, (timestamp, id)) AS destination_ip FROM ev GROUP BY host')(lambda e: fd.primary_entities(e, ["host"], ["timestamp", "id"]))
q("D23_apply_suppression", f"WITH {_FI} SELECT id, detection_id FROM fi")(
    lambda e: fd.apply_suppression(_findings(e).unionByName(_findings(e).withColumns({"id": F.concat("id", F.lit("-2")), "detection_id": F.lit("noisy")})), e.select(F.lit("noisy").alias("detection_id"))).select("id", "detection_id"))
_REL = "rl AS (SELECT DISTINCT f.id AS finding_id, o.id AS other_id, o.last_seen FROM fi f JOIN fi o ON f.id <> o.id AND (f.host = o.host OR f.\"user\" = o.\"user\" OR f.source_ip IN (o.source_ip, o.destination_ip) OR f.destination_ip IN (o.source_ip, o.destination_ip)) QUALIFY row_number() OVER (PARTITION BY f.id ORDER BY o.last_seen DESC, o.id) <= 5)"
q("J12_related_findings", f"WITH {_FI}, r0 AS (SELECT DISTINCT f.id AS finding_id, o.id AS other_id, o.last_seen FROM fi f JOIN fi o ON f.id <> o.id AND (f.host = o.host OR f.\"user\" = o.\"user\" OR f.source_ip IN (o.source_ip, o.destination_ip) OR f.destination_ip IN (o.source_ip, o.destination_ip))) SELECT finding_id, other_id FROM r0 QUALIFY row_number() OVER (PARTITION BY finding_id ORDER BY last_seen DESC, other_id) <= 5")(lambda e: j.related_findings(_findings(e)))
_FEV = f"""{_FI}, ne AS (SELECT DISTINCT fi.id AS finding_id, ev.id AS event_id, ev.timestamp AS t FROM fi JOIN ev ON ev.timestamp BETWEEN fi.last_seen - INTERVAL 1 HOUR AND fi.last_seen + INTERVAL 1 HOUR AND (ev."user" = fi."user" OR ev.host = fi.host OR ev.source_ip IN (fi.source_ip, fi.destination_ip) OR ev.destination_ip IN (fi.source_ip, fi.destination_ip))),
 lk AS (SELECT finding_id, event_id FROM ne QUALIFY row_number() OVER (PARTITION BY finding_id ORDER BY t DESC, event_id) <= 200)"""


def _finding_events(e):
    return j.finding_events(_findings(e).withColumn("first_seen", F.col("last_seen")), e)


q("J11_finding_events", f"WITH {_FEV} SELECT * FROM lk")(_finding_events)
q("A17_finding_posture", f"WITH {_FI} SELECT 'severity' AS kind, severity AS name, count(*) AS count FROM fi GROUP BY 2 UNION ALL SELECT 'status', status, count(*) FROM fi GROUP BY 2 UNION ALL SELECT 'open', '', count(*) FROM fi WHERE status = 'new' HAVING count(*) > 0")(lambda e: fd.finding_posture(_findings(e)))


def _three_rules(e):
    """Findings of users, hosts and addresses, each rule with a severity of its own."""
    rules = (("user", "high", 3), ("host", "medium", 5), ("source_ip", "critical", 2))
    groups = [fd.new_findings(d.threshold_rule(e, _failed(), least, "3650d", [key], _now(e)), key, key, severity) for key, severity, least in rules]
    return groups[0].unionByName(groups[1]).unionByName(groups[2])


_RULE = "SELECT date_trunc('day', min(timestamp)) AS bucket, '{}' AS severity FROM ev WHERE event_type = 'authentication' AND outcome = 'failure' GROUP BY {} HAVING count(*) >= {}"
q("A18_finding_timeline", f"WITH f AS ({_RULE.format('high', '"user"', 3)} UNION ALL {_RULE.format('medium', 'host', 5)} UNION ALL {_RULE.format('critical', 'source_ip', 2)}) SELECT bucket, count(*) AS total, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, 0 AS low FROM f GROUP BY 1")(
    lambda e: fd.finding_timeline(_three_rules(e), 86400).withColumn("bucket", F.col("bucket").cast("timestamp_ntz")))
q("A19_active_techniques", f"WITH {_FI} SELECT 'credential_access' AS mitre_tactic, 'T1110' AS mitre_technique, count(*) AS count FROM fi HAVING count(*) > 0")(lambda e: fd.active_techniques(_findings(e)))


@q("A20_feedback_stats", f"""WITH {_FI}, fb AS (SELECT id AS finding_id, CASE WHEN match_count % 3 = 0 THEN 'false_positive' ELSE 'true_positive' END AS label FROM fi) SELECT 'brute' AS detection_id, count(*) AS total, count(*) FILTER (label = 'true_positive') AS true_positive, count(*) FILTER (label = 'false_positive') AS false_positive, 0 AS benign, round(count(*) FILTER (label = 'false_positive') / count(*), 4) AS fp_rate FROM fb HAVING count(*) > 0""")
def _feedback(e):
    f = _findings(e)
    label = F.when(F.col("match_count") % 3 == 0, "false_positive").otherwise("true_positive")
    late = f.select(F.col("id").alias("finding_id"), label.alias("label"), F.lit("ana").alias("analyst"), F.lit(2).alias("created_at"))
    return fd.feedback_stats(late.unionByName(late.withColumn("label", F.lit("benign")).withColumn("created_at", F.lit(1))), f)


# Hosts without telemetry of some classes, as A21 finds them.
_MISSING = "CASE {h} WHEN 'h1' THEN 'net.dns,net.flow,os.linux.journal,os.linux.sudo' WHEN 'h2' THEN 'net.flow,os.windows.defender,os.windows.dns,os.windows.powershell,os.windows.security,os.windows.sysmon' WHEN 'h3' THEN 'net.dns,net.firewall,net.flow,net.ids' ELSE 'net.dns,net.flow,os.linux.sudo' END"
_CONTEXT = f"""WITH {_FEV}, {_MAP}, {_MATCH},
 ce AS (SELECT lk.finding_id, ev.* FROM lk JOIN ev ON ev.id = lk.event_id QUALIFY row_number() OVER (PARTITION BY lk.finding_id ORDER BY timestamp DESC, ev.id) <= 100),
 rf AS (SELECT finding_id, 'ip' AS kind, source_ip AS v FROM ce UNION SELECT finding_id, 'ip', destination_ip FROM ce UNION SELECT finding_id, 'host', host FROM ce UNION SELECT finding_id, 'user', "user" FROM ce UNION SELECT finding_id, 'process', process FROM ce
  UNION SELECT finding_id, 'source', source FROM ce UNION SELECT id, 'ip', source_ip FROM fi UNION SELECT id, 'ip', destination_ip FROM fi UNION SELECT id, 'host', host FROM fi UNION SELECT id, 'user', "user" FROM fi),
 bu AS (SELECT finding_id, string_agg(v, ',' ORDER BY v) FILTER (kind = 'ip') AS ips, string_agg(v, ',' ORDER BY v) FILTER (kind = 'user') AS users, string_agg(v, ',' ORDER BY v) FILTER (kind = 'host') AS hosts,
   string_agg(v, ',' ORDER BY v) FILTER (kind = 'process') AS processes, string_agg(v, ',' ORDER BY v) FILTER (kind = 'source') AS sources FROM rf GROUP BY 1),
 te AS (SELECT ce.finding_id, technique, tactic, count(*) AS c FROM ce JOIN mp ON mp.id = ce.id GROUP BY ALL),
 ta AS (SELECT finding_id, tactic, sum(c) AS c FROM te GROUP BY ALL UNION ALL SELECT id, 'credential_access', 0 FROM fi),
 kc AS (SELECT finding_id, arg_max(tactic, {{'c': c, 'own': (tactic = 'credential_access')::INT, 'n': r}}) AS tactic FROM (SELECT finding_id, tactic, sum(c) AS c, -row_number() OVER (ORDER BY tactic) AS r FROM ta GROUP BY 1, 2) GROUP BY 1),
 hh AS (SELECT finding_id, v AS host FROM rf WHERE kind = 'host' QUALIFY row_number() OVER (PARTITION BY finding_id ORDER BY v) <= 3),
 ga AS (SELECT finding_id, string_agg(c || ' on ' || host, ',' ORDER BY c || ' on ' || host) AS gaps FROM (SELECT finding_id, host, unnest(string_split({_MISSING.format(h="host")}, ',')) AS c FROM hh) GROUP BY 1),
 hi AS (SELECT finding_id, string_agg(i, ',' ORDER BY i) AS indicators FROM (SELECT finding_id, i FROM (SELECT DISTINCT ce.finding_id, indicator_id::VARCHAR AS i FROM ce JOIN mt ON mt.id = ce.id) QUALIFY row_number() OVER (PARTITION BY finding_id ORDER BY i) <= 10) GROUP BY 1),
 re AS (SELECT finding_id, string_agg(other_id, ',' ORDER BY other_id) AS related FROM (SELECT finding_id, other_id FROM (SELECT DISTINCT f.id AS finding_id, o.id AS other_id, o.last_seen FROM fi f JOIN fi o ON f.id <> o.id AND (f.host = o.host OR f."user" = o."user" OR f.source_ip IN (o.source_ip, o.destination_ip) OR f.destination_ip IN (o.source_ip, o.destination_ip))) QUALIFY row_number() OVER (PARTITION BY finding_id ORDER BY last_seen DESC, other_id) <= 5) GROUP BY 1)
 SELECT fi.id AS finding_id, title, severity, coalesce((SELECT string_agg(ce.id, ',' ORDER BY ce.id) FROM ce WHERE ce.finding_id = fi.id), '') AS event_ids, ips, users, hosts, coalesce(sources, '') AS sources, coalesce(processes, '') AS processes, '' AS domains, '' AS files, '' AS hashes,
  coalesce((SELECT string_agg(DISTINCT technique, ',' ORDER BY technique) FROM te WHERE te.finding_id = fi.id), '') AS techniques, kc.tactic AS dominant_tactic, coalesce(indicators, '') AS indicators, coalesce(related, '') AS related, coalesce(gaps, '') AS gaps
 FROM fi LEFT JOIN bu ON bu.finding_id = fi.id LEFT JOIN kc ON kc.finding_id = fi.id LEFT JOIN hi ON hi.finding_id = fi.id LEFT JOIN re ON re.finding_id = fi.id LEFT JOIN ga ON ga.finding_id = fi.id"""


@full("D24_finding_context", _CONTEXT)
def _context(e, a_, m, n, x):
    cover = e.select("host").distinct().select("host", F.split(F.expr(_MISSING.format(h="host")), ",").alias("missing"))
    held = i.first_indicators(n, fd.CONTEXT_INDICATORS)
    out = fd.finding_context(_findings(e), _finding_events(e), e, d.attack_map(e, MAPPING), j.ti_hits(e, n).drop("column"), j.related_findings(_findings(e)), cover, held=held)
    return out.select(*[F.array_join(c, ",").alias(c) if kind.startswith("array") else c for c, kind in out.dtypes])


# --- risk ------------------------------------------------------------------------------------------------------------------
_PTS = "CASE severity WHEN 'err' THEN 35 WHEN 'warning' THEN 20 WHEN 'notice' THEN 10 WHEN 'info' THEN 5 ELSE 0 END"
_LED = f"""led AS (SELECT * FROM (SELECT 'host' AS entity_type, host AS entity_value, id AS source_id, 'severity' AS description, {_PTS}::DOUBLE AS points, timestamp AS created_at FROM ev UNION ALL
  SELECT 'host', host, id, 'asset criticality', CASE criticality WHEN 'critical' THEN 10 WHEN 'high' THEN 6 WHEN 'medium' THEN 3 ELSE 1 END, timestamp FROM ev JOIN assets ON name = host UNION ALL
  SELECT 'user', "user", id, 'privilege', CASE privilege WHEN 'admin' THEN 10 WHEN 'privileged' THEN 5 ELSE 0 END, timestamp FROM ev JOIN meta USING ("user")) WHERE points > 0)"""


def _ledger(e, a_, m):
    return r.score_events(e, a_, m)


full("R1_score_events", f"WITH {_LED} SELECT entity_type, entity_value, source_id, description, points FROM led")(lambda e, a_, m, n, x: _ledger(e, a_, m).select("entity_type", "entity_value", "source_id", "description", "points"))
full("R2_finding_contributions", f"WITH {_FI} SELECT id AS source_id, t AS entity_type, v AS entity_value, 35.0::DOUBLE AS points FROM (SELECT id, 'user' AS t, \"user\" AS v FROM fi UNION SELECT id, 'host', host FROM fi UNION SELECT id, 'ip', source_ip FROM fi UNION SELECT id, 'ip', destination_ip FROM fi)")(lambda e, a_, m, n, x: r.finding_contributions(_findings(e)).select("source_id", "entity_type", "entity_value", "points"))
full("R3_entity_risk", f"WITH {_LED} SELECT entity_type, entity_value, sum(points) AS score, count(*) AS contributions, max(created_at) AS updated_at FROM led GROUP BY 1, 2")(lambda e, a_, m, n, x: r.entity_risk(_ledger(e, a_, m)))
_OPEN = "op AS (SELECT 'host' AS entity_type, host AS entity_value, count(*) AS open_findings FROM fi GROUP BY 2 UNION ALL SELECT 'user', \"user\", count(*) FROM fi GROUP BY 2 UNION ALL SELECT 'ip', source_ip, count(*) FROM fi GROUP BY 2)"
full("R4_top_risk", f"WITH {_LED}, {_FI}, {_OPEN} SELECT entity_type, entity_value, sum(points) AS score, count(*) AS contributions, max(created_at) AS updated_at, coalesce(max(open_findings), 0) AS open_findings FROM led LEFT JOIN op USING (entity_type, entity_value) WHERE entity_type = 'host' GROUP BY 1, 2 ORDER BY score DESC, entity_value LIMIT 10")(lambda e, a_, m, n, x: r.top_risk(_ledger(e, a_, m), _findings(e), "host", 10))
full("R5_at_risk", f"WITH {_LED} SELECT count(DISTINCT entity_value) AS at_risk FROM led WHERE entity_type = 'user'")(lambda e, a_, m, n, x: r.at_risk(_ledger(e, a_, m), "user"))
full("R6_explain", f"WITH {_LED} SELECT entity_value, source_id, description, points FROM led WHERE entity_type = 'host' QUALIFY row_number() OVER (PARTITION BY entity_value ORDER BY created_at DESC, source_id, description) <= 5")(lambda e, a_, m, n, x: r.explain(_ledger(e, a_, m), 5, "host").select("entity_value", "source_id", "description", "points"))
full("R7_reputation", f"WITH {_LED}, {_FI}, {_OPEN}, z AS (SELECT entity_type, entity_value, sum(points) AS score FROM led GROUP BY 1, 2) SELECT entity_type, entity_value, coalesce(score, 0) AS score, coalesce(open_findings, 0) AS open_findings, CASE WHEN coalesce(score, 0) >= 100 OR coalesce(open_findings, 0) >= 3 THEN 'malicious' WHEN coalesce(score, 0) >= 30 OR coalesce(open_findings, 0) >= 1 THEN 'suspicious' WHEN score > 0 THEN 'benign' ELSE 'unknown' END AS reputation FROM z FULL JOIN op USING (entity_type, entity_value)")(lambda e, a_, m, n, x: r.reputation(_ledger(e, a_, m), _findings(e)))
full("R8_finding_risk", f"WITH {_LED}, {_FI}, p AS (SELECT id AS finding_id, 'user' AS entity_type, \"user\" AS entity_value FROM fi UNION SELECT id, 'host', host FROM fi UNION SELECT id, 'ip', source_ip FROM fi UNION SELECT id, 'ip', destination_ip FROM fi) SELECT finding_id, entity_type, entity_value, coalesce(sum(points), 0) AS score, count(points) AS contributions FROM p LEFT JOIN led USING (entity_type, entity_value) GROUP BY 1, 2, 3")(lambda e, a_, m, n, x: r.finding_risk(_findings(e), _ledger(e, a_, m)))
full("R9_ti_contributions", f"WITH {_MATCH} SELECT 'ip' AS entity_type, value AS entity_value, id AS event_id, round(max(CASE severity WHEN 'critical' THEN 25 WHEN 'high' THEN 15 WHEN 'medium' THEN 8 ELSE 4 END * confidence), 6) AS points FROM mt GROUP BY 2, 3")(lambda e, a_, m, n, x: r.ti_contributions(e, n).select("entity_type", "entity_value", "event_id", "points"))


@q("R10_anomaly_contributions", f"WITH {_BYTES}, {_Z} SELECT entity_value, count(*) AS n, sum(CASE WHEN z >= 4 THEN 15 WHEN z >= 3 THEN 10 ELSE 5 END)::DOUBLE AS points FROM zz GROUP BY 1")
def _anomaly(e):
    an = _z(e).select(F.lit("host").alias("entity_type"), "entity_value", F.lit("bytes_per_hour").alias("feature"), "points", F.lit(None).cast("string").alias("suppressed_reason"), _now(e).alias("detected_at"))
    return r.anomaly_contributions(an).groupBy("entity_value").agg(F.count(F.lit(1)).alias("n"), F.sum("points").alias("points"))


full("R11_decayed_risk", f"WITH {_LED} SELECT entity_type, entity_value, round(sum(points * power(0.5, (epoch_us({_N}) - epoch_us(created_at)) / 3.6e9 / 72.0)), 4) AS score FROM led GROUP BY 1, 2")(lambda e, a_, m, n, x: r.decayed_risk(_ledger(e, a_, m), _now(e)).withColumn("score", F.round("score", 4)))

# --- intelligence ----------------------------------------------------------------------------------------------------------
full("I1_indicators", "WITH b AS (SELECT value, max(confidence * reliability) AS b, count(DISTINCT feed) AS n, max(CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) AS s FROM ind JOIN (SELECT value, feed, max(indicator_id) AS indicator_id FROM ind GROUP BY 1, 2) USING (value, feed, indicator_id) GROUP BY 1) SELECT 'ip:' || value AS indicator_id, round(CASE WHEN n = 1 THEN b * 0.8 ELSE b END, 3) AS confidence, n AS n_sources, ['low', 'medium', 'high', 'critical'][s] AS severity FROM b")(
    lambda e, a_, m, n, x: i.indicators(n.select("type", "value", "severity", "confidence", F.col("feed").alias("source"), "reliability", F.col("indicator_id").alias("seen"))).select("indicator_id", "confidence", "n_sources", "severity"))
full("I2_indicator_confidence", "WITH b AS (SELECT value, max(confidence * reliability) AS b, count(DISTINCT feed) AS n FROM ind GROUP BY 1) SELECT value AS indicator_id, round(CASE WHEN n = 1 THEN b * 0.8 ELSE b END, 3) AS confidence FROM b")(lambda e, a_, m, n, x: i.indicator_confidence(n.select(F.col("value").alias("indicator_id"), F.col("feed").alias("source"), "confidence", "reliability")))
full("I3_indicator_hits", f"WITH {_MATCH} SELECT indicator_id, count(DISTINCT mt.id) AS hit_count, max(timestamp) AS last_seen FROM mt JOIN ev USING (id) GROUP BY 1")(lambda e, a_, m, n, x: i.indicator_hits(e, n))
# Indicators of addresses and of users: an event may hold one of each.
_TWO = f"{_MATCH}, m2 AS (SELECT id, indicator_id FROM mt UNION SELECT id, indicator_id + 1000000 FROM ev JOIN ind ON \"user\" = 'u' || indicator_id)"
full("I4_cooccurrence", f"WITH {_TWO}, f AS (SELECT id, min(indicator_id) AS first FROM m2 GROUP BY 1) SELECT first, indicator_id AS other, count(DISTINCT id) AS events FROM m2 JOIN f USING (id) WHERE indicator_id <> first GROUP BY 1, 2")(
    lambda e, a_, m, n, x: i.indicator_cooccurrence(e, n.unionByName(n.withColumns({"value": F.concat(F.lit("u"), "indicator_id"), "type": F.lit("user"), "indicator_id": F.col("indicator_id") + 1000000}))))
full("I5_mark_events", f"WITH {_MATCH}, g AS (SELECT id, string_agg(DISTINCT indicator_id::VARCHAR, ',' ORDER BY indicator_id::VARCHAR) AS t, max(CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) AS s FROM mt GROUP BY 1) SELECT id, t AS threat_indicators, ['low', 'medium', 'high', 'critical'][s] AS threat_severity FROM ev LEFT JOIN g USING (id)")(
    lambda e, a_, m, n, x: i.mark_events(e, n, lambda ids: F.array_join(F.sort_array(F.transform(ids, lambda v: v.cast("string"))), ",")).select("id", "threat_indicators", "threat_severity"))
full("I6_indicator_lookup", "SELECT DISTINCT v.value, indicator_id, confidence FROM (SELECT DISTINCT source_ip AS value FROM ev) v JOIN ind USING (value) QUALIFY row_number() OVER (PARTITION BY v.value ORDER BY confidence DESC, indicator_id) <= 3")(lambda e, a_, m, n, x: i.indicator_lookup(e.select(F.col("source_ip").alias("value")).distinct(), n, 3))


@query("I8_abuse_feed", "SELECT CASE WHEN page_id % 2 = 0 THEN 'url' ELSE 'ip' END AS type, count(*) AS n FROM pages GROUP BY 1", views=("x AS (SELECT 1)",))
def _abuse(spark, sf):
    p = k.read(spark, sf, "pages")
    body = F.when(F.col("page_id") % 2 == 0, F.to_json(F.struct(F.array(F.struct("url", F.lit("2024-01-01").alias("date_added"))).alias("urls")))).otherwise(
        F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("10.9.8."), F.col("page_id") % 255, F.lit(":443")).alias("ioc"), F.lit("ip:port").alias("ioc_type"), F.lit(75).alias("confidence_level"))).alias("data"))))
    return i.abuse_feed(p.select(body.alias("value"))).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


# --- graph -----------------------------------------------------------------------------------------------------------------
graph("G1_entities", "SELECT * FROM ent")(lambda e, n, a_: n)
graph("G2_relationships", "SELECT * FROM edges")(lambda e, n, a_: e.drop("status"))
graph("G3_edge_states", "SELECT * FROM state")(lambda e, n, a_: e.select("from_type", "from_value", "to_type", "to_value", "relation", "status"))
q("G4_extract_entities", "SELECT id, 'user' AS type, \"user\" AS value, \"user\" AS alias FROM ev UNION ALL SELECT id, 'process', process, process FROM ev")(g.extract_entities)
q("G5_aliases", "SELECT upper(host) AS canonical_value, source_ip AS alias_value, 'probable' AS status, 0.8::DOUBLE AS confidence, min(timestamp) AS first_seen, max(timestamp) AS last_seen FROM ev GROUP BY 1, 2")(lambda e: g.aliases(e).select("canonical_value", "alias_value", "status", F.col("confidence").cast("double").alias("confidence"), "first_seen", "last_seen"))
q("G6_merge_identities", "SELECT upper(host) AS canonical_value, source_ip AS alias_value, 'confirmed' AS status, 1.0::DOUBLE AS confidence FROM ev GROUP BY 1, 2")(lambda e: g.merge_identities((x := g.aliases(e)).unionByName(x.withColumn("status", F.lit("confirmed")).withColumn("confidence", F.lit(1.0))).unionByName(x.withColumn("status", F.lit("possible")).withColumn("confidence", F.lit(0.1)))).select("canonical_value", "alias_value", "status", F.col("confidence").cast("double").alias("confidence")))
q("G7_resolve", "SELECT DISTINCT source_ip AS name, 'ip' AS type, source_ip AS value, 1.0::DOUBLE AS confidence FROM ev")(lambda e: g.resolve(e.select(F.col("source_ip").alias("name")).distinct(), g.entities_from_events(e), g.aliases(e)).withColumn("confidence", F.col("confidence").cast("double")))
graph("G8_relationships_of", "SELECT from_value, to_value, relation FROM edges WHERE (from_type = 'host' AND from_value = 'h2') OR (to_type = 'host' AND to_value = 'h2') ORDER BY created_at DESC, from_type, from_value, to_type, to_value, relation LIMIT 10")(lambda e, n, a_: g.relationships_of(e, "host", "h2", 10).select("from_value", "to_value", "relation"))
_LK = "lk AS (SELECT from_type || ':' || from_value AS src, to_type || ':' || to_value AS dst, relation, status FROM state)"
_BFS = "WITH RECURSIVE " + ",\n".join(_GV) + f""", {_LK}, b AS (SELECT src, dst FROM lk UNION SELECT dst, src FROM lk), w(node, depth) AS (SELECT 'host:h3', 0 UNION SELECT b.dst, w.depth + 1 FROM w JOIN b ON b.src = w.node WHERE w.depth < 2) SELECT node, min(depth) AS depth FROM w GROUP BY 1"""


def _root(e: DataFrame, node: str) -> DataFrame:
    return e.sparkSession.createDataFrame([(node,)], "node string")


graph("G9_bfs", _BFS)(lambda e, n, a_: g.bfs(e, _root(e, "host:h3"), 2))
graph("G10_shortest_paths", f"WITH {_LK}, b AS (SELECT DISTINCT src, dst FROM lk UNION SELECT DISTINCT dst, src FROM lk) SELECT x.src AS a, y.dst AS b, 2 AS hops, x.src || ',' || x.dst || ',' || y.dst AS nodes FROM b x JOIN b y ON x.dst = y.src WHERE x.src = 'user:u1' AND y.dst = 'process:p1'")(
    lambda e, n, a_: g.shortest_paths(e, e.sparkSession.createDataFrame([("user:u1", "process:p1")], "a string, b string")).select("a", "b", "hops", F.array_join("nodes", ",").alias("nodes")))
_CB = f"{_LK}, cb AS (SELECT lk.*, coalesce(s.internet_exposed, false) AND coalesce(NOT d.internet_exposed, false) OR coalesce(s.environment <> d.environment, false) OR (s.entity_ref IS NULL AND coalesce(NOT d.internet_exposed, false)) AS crosses FROM lk LEFT JOIN assets s ON s.entity_ref = src LEFT JOIN assets d ON d.entity_ref = dst)"
graph("G11_crosses_boundary", f"WITH {_CB} SELECT src, dst, relation, crosses FROM cb")(lambda e, n, a_: g.crosses_boundary(e, a_).select("src", "dst", "relation", "crosses"))
_CS = f"{_CB}, cs AS (SELECT dst AS node, 'compromised_observed' AS state, min(src) AS via FROM cb WHERE crosses AND status = 'observed' GROUP BY 1)"
graph("G12_compromise_state", f"WITH {_CS} SELECT * FROM cs UNION ALL SELECT DISTINCT lk.dst, 'at_risk_potential', NULL FROM lk JOIN cs ON cs.node = lk.src WHERE lk.status = 'observed' AND lk.dst NOT IN (SELECT node FROM cs)")(g_comp := lambda e, n, a_: g.compromise_state(e, a_))
graph("G13_observed_paths", f"WITH {_CS} SELECT via AS source, node AS target, 1 AS hops FROM cs")(lambda e, n, a_: g.observed_paths(e, g_comp(e, n, a_)).select("source", "target", "hops"))
#: Users, hosts and processes make no path between hosts, so the hosts that share a process are joined for the path queries.
_HH = "hh AS (SELECT DISTINCT 'host:' || a.host AS src, 'host:' || b.host AS dst FROM (SELECT DISTINCT host, \"user\" FROM ev) a JOIN (SELECT DISTINCT host, \"user\" FROM ev) b ON substr(a.host, 2)::INT + 1 = substr(b.host, 2)::INT)"


def _chain(e: DataFrame) -> DataFrame:
    """Host to next host, as inferred trust."""
    h = e.where("from_type = 'host'").select("from_value").distinct()
    nxt = F.concat(F.lit("h"), F.expr("cast(substring(from_value, 2) as int) + 1").cast("string"))
    return h.select(F.lit("host").alias("from_type"), "from_value", F.lit("host").alias("to_type"), nxt.alias("to_value"), F.lit("lateral_movement").alias("relation"), F.lit("inferred").alias("status")).join(h.select(F.col("from_value").alias("to_value")), "to_value", "left_semi").select("from_type", "from_value", "to_type", "to_value", "relation", "status")


_PP = f"{_HH}, cc AS (SELECT DISTINCT hh.dst AS node FROM hh JOIN assets s ON s.entity_ref = hh.src JOIN assets d ON d.entity_ref = hh.dst WHERE (s.internet_exposed AND NOT d.internet_exposed) OR s.environment <> d.environment)"


#: A critical target weighs 1, an inferred step 0.6.
_POTENTIAL = "WITH RECURSIVE " + ",\n".join(_GV) + f""", {_PP}, w(source, at_, nodes, hops) AS (SELECT node, node, node, 0 FROM cc UNION ALL SELECT w.source, hh.dst, w.nodes || ',' || hh.dst, w.hops + 1 FROM w JOIN hh ON hh.src = w.at_ LEFT JOIN assets t ON t.entity_ref = w.at_ WHERE w.hops < 4 AND (w.hops = 0 OR coalesce(t.criticality, '') <> 'critical')),
 h AS (SELECT w.*, row_number() OVER (PARTITION BY at_ ORDER BY hops, source, nodes) AS n FROM w JOIN assets a ON a.entity_ref = w.at_ AND a.criticality = 'critical' WHERE hops > 0), best AS (SELECT source, at_ AS target, hops, nodes FROM h WHERE n = 1)"""


@graph("G14_potential_paths", _POTENTIAL + " SELECT * FROM best")
def _potential(e, n, a_):
    c = _chain(e)
    return g.potential_paths(c, g.compromise_state(c, a_), a_).select("source", "target", "hops", F.array_join("nodes", ",").alias("nodes"))


@graph("G15_path_risk", _POTENTIAL + " SELECT source, target, round(0.6 * hops, 4)::DOUBLE AS risk FROM best")
def _risk(e, n, a_):
    c = _chain(e)
    return g.path_risk(g.potential_paths(c, g.compromise_state(c, a_), a_), a_).select("source", "target", "risk")


_SNAP = _BFS[: _BFS.index("SELECT node, min(depth)")].rstrip() + f""", {_CS.replace(_LK + ", ", "")}, sn AS (SELECT node, min(depth) AS depth FROM w GROUP BY 1 ORDER BY 2, 1 LIMIT {{nodes}}),
 cm AS (SELECT node, state FROM cs UNION ALL SELECT DISTINCT lk.dst, 'at_risk_potential' FROM lk JOIN cs ON cs.node = lk.src WHERE lk.status = 'observed' AND lk.dst NOT IN (SELECT node FROM cs)) """
graph("G16_snapshot", _SNAP.format(nodes=1000) + "SELECT sn.node, depth, cm.state AS compromise, criticality, environment, coalesce(internet_exposed, false) AS internet_exposed, CASE WHEN starts_with(sn.node, 'host:') THEN length(sn.node) * 10.0 END::DOUBLE AS coverage_pct FROM sn LEFT JOIN cm USING (node) LEFT JOIN assets ON entity_ref = sn.node")(
    lambda e, n, a_: g.snapshot(e, _root(e, "host:h3"), g_comp(e, n, a_), a_, coverage=n.where("type = 'host'").select(F.col("value").alias("host"), ((F.length("value") + 5) * 10.0).alias("pct")))[0].fillna(False, ["internet_exposed"]))
graph("G16_snapshot_edges", _SNAP.format(nodes=60) + """SELECT src, dst, relation, status AS state, crosses, cm.state AS compromise FROM (
  SELECT cb.* FROM cb JOIN sn a ON a.node = src JOIN sn b ON b.node = dst ORDER BY greatest(a.depth, b.depth), least(a.depth, b.depth), CASE status WHEN 'observed' THEN 0 WHEN 'inferred' THEN 1 WHEN 'potential' THEN 2 ELSE 3 END, src, dst, relation LIMIT 80)
  LEFT JOIN cm ON cm.node = dst""")(lambda e, n, a_: g.snapshot(e, _root(e, "host:h3"), g_comp(e, n, a_), a_, nodes=60, n_edges=80)[1])
# Each host's processes stand for the techniques of its runs.
graph("G18_node_what_next", f"WITH {_LK} SELECT DISTINCT 'edge' AS kind, dst AS what FROM lk WHERE src = 'host:h2' UNION SELECT 'technique', 'T' || upper(to_value) FROM state WHERE from_type = 'host' AND from_value = 'h2' AND to_type = 'process' AND to_value <> 'p1'")(
    lambda e, n, a_: g.node_what_next(e, e.where("from_type = 'host' and to_type = 'process'").select(F.col("from_value").alias("host"), F.when(F.col("to_value") != "p1", "expected").otherwise("observed").alias("status"), F.concat(F.lit("T"), F.upper("to_value")).alias("technique")), "host:h2"))
graph("G19_graph_brief", f"WITH {_CS} SELECT src, dst, relation FROM lk WHERE 'host:h4' IN (src, dst) ORDER BY src, dst, relation LIMIT 25")(lambda e, n, a_: g.graph_brief(e, g_comp(e, n, a_), ["h4"]).select("src", "dst", "relation"))
graph("G20_entity_neighbors", f"WITH {_LK}, b AS (SELECT src, dst FROM lk UNION ALL SELECT dst, src FROM lk) SELECT y.dst AS node, count(*) AS paths FROM b x JOIN b y ON x.dst = y.src WHERE x.src = 'host:h3' GROUP BY 1")(lambda e, n, a_: g.entity_neighbors(e, "host:h3"))


@query("R12_entity_detail", "WITH RECURSIVE " + ",\n".join((*_GV, k.META)) + f""", {_LK}, {_LED}, {_FI}, {_OPEN}, b AS (SELECT src, dst FROM lk UNION SELECT dst, src FROM lk), w(node, depth) AS (SELECT 'host:h3', 0 UNION SELECT b.dst, w.depth + 1 FROM w JOIN b ON b.src = w.node WHERE w.depth < 2),
 n AS (SELECT node, min(depth) AS depth FROM w GROUP BY 1) SELECT ent.value, ent.count, (SELECT sum(points) FROM led WHERE entity_type = 'host' AND entity_value = 'h3') AS score, coalesce((SELECT open_findings FROM op WHERE entity_type = 'host' AND entity_value = 'h3'), 0) AS open_findings,
 (SELECT count(*) FROM n WHERE depth = 1) AS neighbors, (SELECT count(*) FROM n WHERE depth > 0) AS within_two FROM ent WHERE type = 'host' AND value = 'h3'""")
def _detail(spark, sf):
    e = k.events(spark, sf)
    ledger = _ledger(e, k.assets(spark, sf), k.entity_meta(spark, sf))
    out = r.entity_detail(g.entities_from_events(e), g.relationships_from_events(e), ledger, _findings(e), "host", "h3")
    return out.select("value", "count", "score", "open_findings", "neighbors", "within_two")


graph("L5_union_edges", "SELECT to_value AS value, relation FROM edges WHERE from_value = 'h1' UNION SELECT from_value, relation FROM edges WHERE to_value = 'h1'")(lambda e, n, a_: s.union_edges(e.where("from_value = 'h1'").select(F.col("to_value").alias("value"), "relation"), e.where("to_value = 'h1'").select(F.col("from_value").alias("value"), "relation")))
graph("L6_degree", "SELECT type, value, count(*) AS degree FROM (SELECT from_type AS type, from_value AS value FROM edges UNION ALL SELECT to_type, to_value FROM edges) GROUP BY 1, 2")(lambda e, n, a_: s.union_all_degree(e))

# --- assets and threat models ----------------------------------------------------------------------------------------------
q("M1_observe_assets", "SELECT host, coalesce(min(timestamp) FILTER (source = 'view'), min(timestamp)) AS first_seen, max(timestamp) AS last_seen, 'draft' AS status FROM ev GROUP BY 1")(lambda e: a.observe_assets(e.where("source != 'view'"), a.observe_assets(e.where("source = 'view'"))))
_NAMES = ("-payment", "-db-1", "-gateway", "-staging", "-web", "-sqltest", "-x")
_NAMED = f"(SELECT name || {list(_NAMES)}[k % {len(_NAMES)} + 1] AS name, CASE k % 3 WHEN 0 THEN 'server' WHEN 1 THEN 'host' ELSE 'identity_provider' END AS kind FROM assets)"
full("M2_suggest_criticality", f"SELECT name, kind, CASE WHEN kind = 'identity_provider' OR contains(name, 'payment') THEN 'critical' WHEN contains(name, 'db-') OR contains(name, 'sql') OR contains(name, 'gateway') OR kind = 'server' THEN 'high' WHEN contains(name, 'staging') THEN 'low' ELSE 'medium' END AS criticality FROM {_NAMED}")(
    lambda e, a_, m, n, x: a_.select(
        F.concat("name", F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("k") % len(_NAMES) + 1).cast("int"))).alias("name"), F.when(F.col("k") % 3 == 0, "server").when(F.col("k") % 3 == 1, "host").otherwise("identity_provider").alias("kind")
    ).select("name", "kind", a.suggest_criticality(F.col("name"), F.col("kind")).alias("criticality")))
full("M4_merge_inventory", "SELECT entity_ref, CASE WHEN k % 2 = 0 THEN 'patched' ELSE criticality END AS version FROM assets")(lambda e, a_, m, n, x: a.merge_inventory(a_.select("entity_ref", F.col("criticality").alias("version")), a_.select("entity_ref", F.when(F.col("k") % 2 == 0, "patched").alias("version")), ["entity_ref"]))


def _classes(e):
    c = F.when(F.col("source") == "view", "os.linux.auditd").when(F.col("source") == "click", "os.linux.sshd").when(F.col("source") == "error", "web.access").otherwise("os.linux.journal")
    return e.withColumn("source_class", c).where(~((F.col("host") == "h1") & (F.col("source_class") == "os.linux.journal")))


q("A22_coverage_rows", f"WITH c AS (SELECT host, CASE source WHEN 'view' THEN 'os.linux.auditd' WHEN 'click' THEN 'os.linux.sshd' WHEN 'error' THEN 'web.access' ELSE 'os.linux.journal' END AS source_class, timestamp FROM ev) SELECT host, source_class, max(timestamp) AS last_event, count(*) AS event_count_30d FROM c WHERE timestamp >= {_N} - INTERVAL 30 DAY AND NOT (host = 'h1' AND source_class = 'os.linux.journal') GROUP BY 1, 2")(lambda e: a.coverage_rows(_classes(e), _now(e)))
q("A21_coverage_pct", "SELECT DISTINCT host, CASE host WHEN 'h1' THEN 45.0 WHEN 'h2' THEN 0 WHEN 'h3' THEN 0 ELSE 60.0 END::DOUBLE AS pct, CASE host WHEN 'h1' THEN 'net.dns,net.flow,os.linux.journal,os.linux.sudo' WHEN 'h2' THEN 'net.flow,os.windows.defender,os.windows.dns,os.windows.powershell,os.windows.security,os.windows.sysmon' WHEN 'h3' THEN 'net.dns,net.firewall,net.flow,net.ids' ELSE 'net.dns,net.flow,os.linux.sudo' END AS missing, CASE WHEN host IN ('h2', 'h3') THEN 'os.linux.auditd,os.linux.journal,os.linux.sshd,web.access' ELSE 'web.access' END AS unexpected FROM ev")(
    lambda e: a.coverage_pct(a.coverage_rows(_classes(e), _now(e)), e.select("host", a.platform(F.when(F.col("host") == "h3", "network").otherwise("host"), F.when(F.col("host") == "h2", "Windows Server").otherwise("")).alias("kind")).distinct(), _now(e)).select("host", F.col("pct").cast("double").alias("pct"), F.array_join("missing", ",").alias("missing"), F.array_join("unexpected", ",").alias("unexpected")))
full("U1_enrich_chain", 'SELECT id, criticality, privilege FROM ev LEFT JOIN assets ON name = host LEFT JOIN meta USING ("user")')(lambda e, a_, m, n, x: a.enrich_chain(e, [lambda v: j.asset_enrich(v, a_), lambda v: j.identity_enrich(v, m)]).select("id", "criticality", "privilege"))

# --- sources: lines made of the events, read back ---------------------------------------------------------------------------
q("S1_events_json", "SELECT id, host, severity, message, json_extract_string(attributes, '$.k') AS k FROM ev")(lambda e: src.events_of_lines(e.select(F.to_json(F.struct("id", F.col("host").alias("hostname"), F.col("severity").alias("level"), F.col("message").alias("msg"), F.get_json_object("attributes", "$.k").alias("k"))).alias("value"))).select("id", "host", "severity", "message", F.get_json_object("attributes", "$.k").alias("k")))
q("S2_events_api", "SELECT id, host FROM ev")(lambda e: src.read_events_api(e.groupBy("user").agg(F.to_json(F.struct(F.collect_list(F.struct("id", "host")).alias("events"))).alias("value"))).select("id", "host"))
q("S3_hec", "SELECT id, host, source AS source_type, message FROM ev")(lambda e: src.read_hec(e.select(F.to_json(F.struct((F.unix_micros(F.col("timestamp").cast("timestamp")) / 1e6).alias("time"), "host", F.col("source").alias("sourcetype"), F.struct("id", "message").alias("event"))).alias("value"))).select("id", "host", "source_type", "message"))


@q("S4_otlp_logs", "SELECT message, 'svc' AS service, host, CASE severity WHEN 'err' THEN 'err' ELSE 'info' END AS severity, source AS kind FROM ev")
def _otlp(e):
    val = lambda x: F.struct(x.alias("stringValue"))
    rec = F.struct((F.unix_micros(F.col("timestamp").cast("timestamp")) * 1000).cast("string").alias("timeUnixNano"), F.when(F.col("severity") == "err", 17).otherwise(9).alias("severityNumber"), val(F.col("message")).alias("body"), F.array(F.struct(F.lit("kind").alias("key"), val(F.col("source")).alias("value"))).alias("attributes"))
    res = F.struct(F.array(F.struct(F.lit("service.name").alias("key"), val(F.lit("svc")).alias("value")), F.struct(F.lit("host.name").alias("key"), val(F.col("host")).alias("value"))).alias("attributes"))
    body = e.select(F.to_json(F.struct(F.array(F.struct(res.alias("resource"), F.array(F.struct(F.array(rec).alias("logRecords"))).alias("scopeLogs"))).alias("resourceLogs"))).alias("value"))
    return src.read_otlp_logs(body).select("message", "service", "host", "severity", F.get_json_object("attributes", "$.kind").alias("kind"))


_S3164 = lambda: F.concat(F.lit("<"), F.when(F.col("severity") == "err", 11).otherwise(14), F.lit(">"), F.date_format("timestamp", "MMM d HH:mm:ss"), F.lit(" "), F.col("host"), F.lit(" app["), F.col("event_id"), F.lit("]: "), F.col("message"))
q("S5_syslog3164", "SELECT host, 'app' AS process, CASE severity WHEN 'err' THEN 'err' ELSE 'info' END AS severity, message, date_trunc('second', timestamp) AS timestamp, id AS pid FROM ev")(lambda e: ps.parse(e.select(_S3164().alias("value")), "syslog3164", year=2024).select("host", "process", "severity", "message", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), F.col("attributes")["pid"].alias("pid")))
q("S6_syslog5424", "SELECT host, id AS pid, 'notice' AS severity, message, source AS kind FROM ev")(lambda e: ps.parse(e.select(F.concat(F.lit("<165>1 2024-01-01T00:00:00Z "), "host", F.lit(" app "), "id", F.lit(' ID47 [ex@1 kind="'), "source", F.lit('" q="a]b"] '), "message").alias("value")), "syslog5424").select("host", F.col("attributes")["pid"].alias("pid"), "severity", "message", F.col("attributes")["sd.ex@1.kind"].alias("kind")))
q("S7_cef", "SELECT source_ip, destination_ip, \"user\", message, CASE WHEN event_id % 11 >= 8 THEN 'critical' WHEN event_id % 11 >= 6 THEN 'err' WHEN event_id % 11 >= 4 THEN 'warning' WHEN event_id % 11 >= 1 THEN 'notice' ELSE 'debug' END AS severity, source || ' | x' AS note FROM ev")(lambda e: ps.parse(e.select(F.concat(F.lit("CEF:0|V|P|1.0|100|"), "message", F.lit("|"), F.col("id").cast("long") % 11, F.lit("|src="), "source_ip", F.lit(" dst="), "destination_ip", F.lit(" suser="), "user", F.lit(" note="), "source", F.lit(r" \| x")).alias("value")), "cef").select("source_ip", "destination_ip", "user", "message", "severity", F.col("attributes")["note"].alias("note")))
q("S8_leef", "SELECT host, \"user\", 'critical' AS severity, source || '!' AS note FROM ev")(lambda e: ps.parse(e.select(F.concat(F.lit("LEEF:2.0 eventid=1!hostname="), "host", F.lit("!username="), "user", F.lit("!severity=critical!note="), "source", F.lit(r"\!")).alias("value")), "leef").select("host", "user", "severity", F.col("attributes")["note"].alias("note")))
q("S9_gelf", "SELECT host, message, source AS kind FROM ev")(lambda e: ps.parse(e.select(F.to_json(F.struct(F.lit("1.1").alias("version"), "host", F.col("message").alias("short_message"), F.col("source").alias("_kind"))).alias("value")), "gelf").select("host", "message", F.col("attributes")["kind"].alias("kind")))
q("S10_auto", "SELECT CASE event_id % 3 WHEN 0 THEN 'syslog3164' WHEN 1 THEN 'cef' ELSE 'plain' END AS format, count(*) AS n FROM ev GROUP BY 1")(lambda e: ps.parse(e.select(F.when(F.col("event_id") % 3 == 0, _S3164()).when(F.col("event_id") % 3 == 1, F.concat(F.lit("CEF:0|V|P|1.0|100|x|7|src="), "source_ip")).otherwise(F.col("message")).alias("value")), "auto", year=2024).groupBy("format").agg(F.count(F.lit(1)).alias("n")))
q("S11_regex", r"SELECT message, source AS verb, \"user\" AS who FROM ev".replace('\\"', '"'))(lambda e: ps.parse(e.select(F.col("message").alias("value")), "regex", pattern=r"^(?P<verb>\w+) .*user=(?P<who>\w+)$").select("message", F.col("attributes")["verb"].alias("verb"), F.col("attributes")["who"].alias("who")))
q("S14_provenance", "SELECT id, 'p' AS parser, json_extract_string(attributes, '$.k') AS k FROM ev")(lambda e: src.stamp_provenance(e, "p", "1", "c").select("id", F.get_json_object("attributes", "$.parser").alias("parser"), F.get_json_object("attributes", "$.k").alias("k")))
q("S17_canonical", 'SELECT id, timestamp AS received_at, "user", host FROM ev')(lambda e: src.canonical_events(e.select("id", "timestamp", F.col("user").alias("username"), F.col("host").alias("hostname")), {"timestamp": "cast(timestamp as timestamp)"}).select("id", F.col("received_at").cast("timestamp_ntz").alias("received_at"), "user", "host"))
q("S18_event_to_map", "SELECT id, host, json_extract_string(attributes, '$.k') AS k FROM ev")(lambda e: src.event_to_map(e).select("id", F.col("fields")["host"].alias("host"), F.col("fields")["attr.k"].alias("k")))
_CLASS = "CASE event_id % 5 WHEN 0 THEN 'os.linux.sshd' WHEN 1 THEN 'NET.FLOW' WHEN 2 THEN 'no.such.class' WHEN 3 THEN 'os.windows.sysmon' END"
q("S19_source_class", f"SELECT id, CASE WHEN event_id % 5 IN (1, 2) THEN 'generic' ELSE coalesce({_CLASS}, 'generic') END AS source_class FROM ev")(
    lambda e: (x := e.withColumn("attributes", F.to_json(F.struct(F.expr(_CLASS).alias("source_class"))))).select("id", src.source_class(x).alias("source_class")))


@query("S16_write_events", "SELECT id, host FROM ev")
def _write(spark, sf):
    path = new_folder(spark, "events")
    src.write_events(k.events(spark, sf), path)
    return spark.read.parquet(path).select("id", "host")
