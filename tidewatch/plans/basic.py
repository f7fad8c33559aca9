"""Queries of filters, projections, functions, aggregations, windows and sorting."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import filters as f
from ..operators import project as p
from ..operators import stats as s
from . import canonical as k
from .registry import events_query, query

q = events_query
_N = "(SELECT max(timestamp) FROM ev)"


def _ntz(x):
    return F.lit(x).cast("timestamp_ntz")


q("F1_search", "SELECT id, host FROM ev WHERE host = 'h3' AND severity = 'err'")(lambda e: f.search(e, host="h3", sev="err").select("id", "host"))
q("F2_compare", "SELECT id FROM ev WHERE TRY_CAST(json_extract_string(attributes, '$.k') AS DOUBLE) >= 50 AND value < 100")(lambda e: e.where(f.compare(e, "k", ">=", 50) & f.compare(e, "value", "<", 100)).select("id"))
q("F3_boolean", "SELECT id FROM ev WHERE host = 'h1' OR (host = 'h2' AND NOT outcome = 'failure')")(lambda e: e.where(f.any_of(f.compare(e, "host", "=", "h1"), f.all_of(f.compare(e, "host", "=", "h2"), ~f.compare(e, "outcome", "=", "failure")))).select("id"))
q("F4_in_list", "SELECT id FROM ev WHERE host IN ('h1', 'h5') AND source NOT IN ('view')")(lambda e: e.where(f.in_list(e, "host", ["h1", "h5"]) & f.in_list(e, "source", ["view"], negate=True)).select("id"))
q("F5_like", "SELECT id FROM ev WHERE message ILIKE 'PURCHASE%u1%'")(lambda e: e.where(f.like(e, "message", "PURCHASE%u1%")).select("id"))
q("F7_null_tests", "SELECT count(*) FILTER (json_extract_string(attributes, '$.k') IS NOT NULL) AS there, count(*) FILTER (json_extract_string(attributes, '$.zz') IS NULL) AS gone FROM ev")(
    lambda e: e.agg(F.count_if(f.is_not_null(e, "k")).alias("there"), F.count_if(f.is_null(e, "zz")).alias("gone")))
q("F8_index_filter", "SELECT id FROM ev WHERE source_type = 'purchase' OR source = 'purchase' OR json_extract_string(attributes, '$.index') = 'purchase'")(lambda e: f.index_filter(e, "purchase").select("id"))
q("F9_time_range", f"SELECT id FROM ev WHERE timestamp >= {_N} - INTERVAL 36 HOUR AND timestamp <= {_N}")(lambda e: f.time_range(e, "36h", "now", k.latest(e)).select("id"))
q("F11_filter_events", "SELECT id, timestamp FROM ev WHERE severity = 'err' AND lower(message) LIKE 'error %' ORDER BY timestamp DESC, id LIMIT 50 OFFSET 10")(
    lambda e: f.filter_events(e, {"severity": "err"}, text="error", limit=50, offset=10).select("id", "timestamp"))
q("F12_or_values", "SELECT id FROM ev WHERE source IN ('click', 'view') AND host IN ('h7')")(lambda e: f.or_values(e, {"source": ["click", "view"], "host": ["h7"]}).select("id"))
q("F13_where_agg", 'SELECT count(*) AS count, "user" FROM ev GROUP BY "user" HAVING count(*) > 70')(lambda e: f.where_agg(s.stats(e, ["count"], ["user"]), "count > 70"))
q("F14_predicate_match", "SELECT id FROM ev WHERE lower(outcome) = 'failure' AND lower(source_type) = 'app'")(lambda e: f.predicate_match(e, {"outcome": "FAILURE", "source_type": "App"}).select("id"))
q("F15_entity_or_filter", f"SELECT id FROM ev WHERE (\"user\" = 'u5' OR host = 'h9' OR source_ip = '10.0.1.1' OR destination_ip = '10.0.1.1') AND timestamp >= {_N} - INTERVAL 10 DAY AND timestamp <= {_N}")(
    lambda e: f.entity_or_filter(e, ["u5"], ["h9"], ["10.0.1.1"], (n := k.latest(e)) - timedelta(days=10), n).select("id"))


@query("F6_text_search", r"SELECT doc_id FROM documents WHERE contains(' ' || array_to_string(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), ' ') || ' ', ' worthless ')", views=("x AS (SELECT 1)",))
def _text(spark, d):
    return f.text_search(k.read(spark, d, "documents"), "worthless", ("text",)).select("doc_id")


q("P1_table", "SELECT id, host, json_extract_string(attributes, '$.k') AS k, NULL::VARCHAR AS \"a.b\" FROM ev")(lambda e: p.table(e, "id", "host", "k", "a.b"))
q("P2_fields_drop", "SELECT id, timestamp, source, event_type, message FROM ev")(lambda e: p.fields(e, "severity", "host", include=False))
q("P3_rename", "SELECT id AS event, host AS machine FROM ev")(lambda e: p.rename(e.select("id", "host"), {"ID": "event", "Host": "machine"}))
q("P4_eval", "SELECT id, round(value * 2, 6) AS double, round(value * 2 + 1, 6) AS more FROM ev")(lambda e: p.eval_(e, double=F.round(F.col("value") * 2, 6), more=F.round(F.col("double") + 1, 6)).select("id", "double", "more"))
q("P5_rex", r"SELECT id, regexp_extract(message, '^(\w+) value=([0-9.]+) user=(\w+)$', 1) AS verb, regexp_extract(message, '^(\w+) value=([0-9.]+) user=(\w+)$', 2) AS amount_text, regexp_extract(message, '^(\w+) value=([0-9.]+) user=(\w+)$', 3) AS who FROM ev")(
    lambda e: p.rex(e, r"^(?P<verb>\w+) value=(?P<amount_text>[0-9.]+) user=(?P<who>\w+)$", "message").select("id", "verb", "amount_text", "who"))
q("P6_attributes_to_columns", "SELECT id, json_extract_string(attributes, '$.k') AS k FROM ev")(lambda e: p.attributes_to_columns(e, ["k", "host"]).select("id", "k"))
q("P7_default_columns", "SELECT id, timestamp, source, severity, event_type, host, message FROM ev")(p.default_columns)
q("P8_bin", "SELECT id, time_bucket(INTERVAL 1 HOUR, timestamp, TIMESTAMP '1970-01-01') AS hour, (floor(value / 10) * 10)::DOUBLE AS tens FROM ev")(lambda e: p.bin_(p.bin_(e, "timestamp", "1h", "hour"), "value", 10, "tens").select("id", "hour", F.col("tens").cast("double").alias("tens")))
q("P10_truncate_message", "SELECT id, left(message, 12) AS message FROM ev")(lambda e: p.truncate_message(e, 12).select("id", "message"))


#: The kinds and expressions that the operator strikes out, one after another.
_STRIKE = (
    ("password", r"""(?i)\b(password|passwd|pwd|passphrase)\b(\s*[=:]\s*)?[^\s"'',;)]{4,}"""),
    ("token", r"""(?i)\b(api[_-]?key|apikey|secret|access[_-]?token|auth[_-]?token|client[_-]?secret)\b(\s*[=:]\s*)?[^\s"'',;)]{8,}"""),
    ("token", r"(?i)\b(bearer|basic)\s+[a-z0-9+/._=-]{16,}"),
    ("token", r"\b(?:AKIA|ASIA|AGPA|AIDA|AROA|ANPA|ANVA)[0-9A-Z]{16}\b"),
    ("cookie", r"(?i)\b(set-cookie|cookie)\s*:\s*[^\n;,]{4,}"),
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b"),
)
_STRUCK = ", ".join(f"t{i + 1} AS (SELECT doc_id, h || CASE WHEN regexp_matches(text, '{p}') THEN ['{label}'] ELSE [] END AS h, regexp_replace(text, '{p}', '[REDACTED:{label}]', 'g') AS text FROM t{i})" for i, (label, p) in enumerate(_STRIKE))
_KINDS = " || ".join(f"CASE WHEN list_contains(h, '{kind}') THEN ['{kind}'] ELSE [] END" for kind in ("password", "token", "cookie", "ssn"))


@query("P9_redact", f"WITH t0 AS (SELECT doc_id, []::VARCHAR[] AS h, text FROM documents), {_STRUCK} SELECT doc_id, array_to_string({_KINDS}, ',') AS redactions, md5(text) AS text_md5 FROM t{len(_STRIKE)}")
def _redact(spark, d):
    out = p.redact(k.read(spark, d, "documents"), ["text"])
    return out.select("doc_id", F.array_join("redactions", ",").alias("redactions"), F.md5("text").alias("text_md5"))


q("X1_X13_text_functions", """SELECT id, CASE WHEN outcome = 'failure' THEN 'bad' ELSE 'good' END AS if_, CASE WHEN value > 100 THEN 'large' WHEN value > 10 THEN 'medium' END AS case_,
  coalesce(nullif(json_extract_string(attributes, '$.zz'), ''), host, '') AS coalesce_, strlen(message) AS len_, lower(message) AS lower_, upper(host) AS upper_, substr(message, 4, 5) AS substr_,
  replace(message, 'value', 'v') AS replace_, round(value, 1) AS round_, TRY_CAST(trim(host) AS DOUBLE) AS tonumber_, printf('%x', bytes) AS tohex_, false AS isnull_, true AS isnotnull_ FROM ev""")(
    lambda e: e.select("id", X.if_(F.col("outcome") == "failure", "bad", "good").alias("if_"), X.case_(F.col("value") > 100, "large", F.col("value") > 10, "medium").alias("case_"),
                       X.coalesce_(F.get_json_object("attributes", "$.zz"), "host").alias("coalesce_"), X.len_("message").cast("bigint").alias("len_"), F.lower("message").alias("lower_"), F.upper("host").alias("upper_"),
                       X.substr("message", 3, 5).alias("substr_"), X.replace("message", "value", "v").alias("replace_"), F.round("value", 1).alias("round_"), X.tonumber("host").alias("tonumber_"),
                       X.tostring("bytes", "hex").alias("tohex_"), X.blank("id").alias("isnull_"), (~X.blank("id")).alias("isnotnull_")))
q("X14_X22_math", "SELECT id, abs(-value) AS abs_, ceil(value) AS ceil_, floor(value) AS floor_, round(sqrt(value), 6) AS sqrt_, round(ln(value + 1), 6) AS log_, round(exp(value / 1000), 6) AS exp_, greatest(value, event_id % 100) AS max_, least(value, event_id % 100) AS min_ FROM ev")(
    lambda e: e.select("id", F.abs(-F.col("value")).alias("abs_"), F.ceil("value").cast("double").alias("ceil_"), F.floor("value").cast("double").alias("floor_"), F.round(F.sqrt("value"), 6).alias("sqrt_"), F.round(F.ln(F.col("value") + 1), 6).alias("log_"), F.round(F.exp(F.col("value") / 1000), 6).alias("exp_"),
                       X.max_("value", F.col("event_id") % 100).alias("max_"), X.min_("value", F.col("event_id") % 100).alias("min_")))
q("X23_X29_hash_json", "SELECT id, md5(message) AS md5_, sha1(message) AS sha1_, sha256(message) AS sha256_, url_decode('a%20' || id) AS url_, trim('  ' || host || ' ') AS trim_, json_extract_string(attributes, '$.k') AS spath_ FROM ev")(
    lambda e: e.select("id", X.md5("message").alias("md5_"), X.sha1("message").alias("sha1_"), X.sha256("message").alias("sha256_"), X.urldecode(F.concat(F.lit("a%20"), "id")).alias("url_"), F.trim(F.concat(F.lit("  "), "host", F.lit(" "))).alias("trim_"), X.spath("attributes", "k").alias("spath_")))
q("X30_X33_operators", "SELECT id, outcome <> 'no' AS truthy_, CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE round(value / (event_id % 3), 6) END AS div_, CASE WHEN event_id % 4 = 0 THEN 0 ELSE bytes % (event_id % 4) END AS mod_, host || source AS plus_ FROM ev")(
    lambda e: e.select("id", X.truthy("outcome").alias("truthy_"), F.round(X.divide("value", F.col("event_id") % 3), 6).alias("div_"), X.modulo("bytes", F.col("event_id") % 4).alias("mod_"), X.plus("host", "source").alias("plus_")))
q("X34_haversine", "SELECT id, round(2 * 6371.0 * asin(sqrt(power(sin((radians(40.4 + event_id % 10) - radians(35.6)) / 2), 2) + cos(radians(35.6)) * cos(radians(40.4 + event_id % 10)) * power(sin((radians(-3.7) - radians(139.7)) / 2), 2))), 4) AS km FROM ev")(
    lambda e: e.select("id", F.round(X.haversine_km(F.lit(35.6), F.lit(139.7), F.lit(40.4) + F.col("event_id") % 10, F.lit(-3.7)), 4).alias("km")))
q("X35_normal_forms", "SELECT id, \"user\" AS user_, upper(host) AS host_, lower(source) || '.example' AS domain_, process AS process_, md5(id) AS hash_, \"user\" || '@example.com' AS email_ FROM ev")(
    lambda e: e.select("id", X.normalize_user(F.concat(F.lit("CORP\\"), F.upper("user"))).alias("user_"), X.normalize_host("host").alias("host_"), X.normalize_domain(F.concat(F.upper("source"), F.lit(".example.:443"))).alias("domain_"),
                       X.normalize_process(F.concat(F.lit("/usr/bin/"), "process")).alias("process_"), X.normalize_hash(F.upper(F.md5("id"))).alias("hash_"), X.normalize_email(F.concat(F.upper("user"), F.lit("@Example.com"))).alias("email_")))
q("X36_normalize_indicator", "SELECT id, lower(source_ip) AS ip_, lower(source) || '.com' AS domain_, sha256(id) AS hash_ FROM ev")(
    lambda e: e.select("id", X.normalize_indicator(F.lit("ip"), "source_ip").alias("ip_"), X.normalize_indicator(F.lit("domain"), F.concat(F.lit("."), F.upper("source"), F.lit(".com."))).alias("domain_"), X.normalize_indicator(F.lit("hash"), F.concat(F.lit("sha256:"), F.upper(F.sha2("id", 256)))).alias("hash_")))
q("X38_X39_outcome_id", "SELECT id, outcome = 'failure' AS blocked, 'thr-' || left(sha256(id || '|' || host), 8) AS sid FROM ev")(lambda e: e.select("id", X.is_blocked_outcome("outcome").alias("blocked"), X.stable_id("thr-", "id", "host").alias("sid")))
q("X40_extract_ipv4", "SELECT id, source_ip || ',' || destination_ip AS ips FROM ev")(lambda e: e.select("id", F.array_join(X.extract_ipv4(F.concat(F.lit("from "), "source_ip", F.lit(" to "), "destination_ip", F.lit(" not 999.1.1.1 or 1.2.3"))), ",").alias("ips")))

q("A1_stats", "SELECT count(*) AS count, round(sum(value), 4) AS sum_value, source, severity FROM ev GROUP BY source, severity")(lambda e: s.stats(e, ["count", ("sum", "value")], ["source", "severity"]).withColumn("sum_value", F.round("sum_value", 4)))
q("A2_count", "SELECT count(*) AS count, count(json_extract_string(attributes, '$.zz')) AS count_zz FROM ev")(lambda e: s.stats(e, ["count", ("count", "zz")]))
q("A3_A4_sum_avg", "SELECT round(sum(TRY_CAST(json_extract_string(attributes, '$.k') AS DOUBLE)), 4) AS sum_k, round(avg(value), 6) AS avg_value, host FROM ev GROUP BY host")(
    lambda e: s.stats(e, [("sum", "k"), ("avg", "value")], ["host"]).select(F.round("sum_k", 4).alias("sum_k"), F.round("avg_value", 6).alias("avg_value"), "host"))
q("A5_min_max", "SELECT min(value) AS min_value, max(timestamp) AS max_timestamp, host FROM ev GROUP BY host")(lambda e: s.stats(e, [("min", "value"), ("max", "timestamp")], ["host"]))
q("A6_distinct_count", 'SELECT count(DISTINCT "user") AS dc_user, host FROM ev GROUP BY host')(lambda e: s.stats(e, [("dc", "user")], ["host"]))
q("A7_A8_values_list", "SELECT string_agg(DISTINCT source, ',' ORDER BY source) AS v, count(*) AS n, host FROM ev GROUP BY host")(lambda e: s.stats(e, [("values", "source"), ("list", "source")], ["host"]).select(F.array_join("values_source", ",").alias("v"), F.size("list_source").cast("bigint").alias("n"), "host"))
q("A9_timechart", "SELECT time_bucket(INTERVAL 6 HOUR, timestamp, TIMESTAMP '1970-01-01') AS _time, count(*) AS count, source FROM ev GROUP BY ALL")(lambda e: s.timechart(e, ["count"], "6h", ["source"]))
q("A10_eventstats", "SELECT id, host, count(*) OVER (PARTITION BY host) AS count, max(value) OVER (PARTITION BY host) AS max_value FROM ev")(lambda e: s.eventstats(e, ["count", ("max", "value")], ["host"]).select("id", "host", "count", "max_value"))
q("A11_event_timeline", "SELECT time_bucket(INTERVAL 1 HOUR, timestamp, TIMESTAMP '1970-01-01') AS bucket, count(*) AS total, 0 AS critical, count(*) FILTER (severity = 'err') AS high, count(*) FILTER (severity IN ('warning', 'notice')) AS medium, count(*) FILTER (severity NOT IN ('err', 'warning', 'notice')) AS low FROM ev GROUP BY 1")(lambda e: s.event_timeline(e, 3600))
q("A13_source_counts", "SELECT source, count(*) AS count FROM (SELECT source FROM ev ORDER BY timestamp DESC, id LIMIT 1000) GROUP BY 1")(lambda e: s.source_counts(e, 1000))
q("A14_dashboard_summary", "SELECT count(*) AS total, count(DISTINCT source) AS sources, count(DISTINCT host) AS hosts, count(DISTINCT severity) AS severitys FROM ev")(s.dashboard_summary)
q("A15_event_stats", f"SELECT 'total' AS kind, '' AS name, count(*) AS count FROM ev UNION ALL SELECT 'severity', severity, count(*) FROM ev GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM ev GROUP BY 2 UNION ALL SELECT 'last_24h', '', count(*) FROM ev WHERE timestamp >= {_N} - INTERVAL 24 HOUR")(lambda e: s.event_stats(e, _ntz(k.latest(e))))
q("A16_events_per_second", "SELECT floor(count(*) / 3600.0 * 100 + 0.5) / 100 AS eps FROM ev")(lambda e: s.events_per_second(e, 3600.0).select(F.col("eps").cast("double").alias("eps")))
q("A23_top_values", 'SELECT "user" AS value, count(*) AS count FROM ev GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15')(lambda e: s.top_values(e, "user", 15))
q("A24_distinct_values", "SELECT DISTINCT json_extract_string(attributes, '$.k') AS value FROM ev ORDER BY 1 LIMIT 25")(lambda e: s.distinct_values(e, "k", 25))
q("A25_field_catalog", "SELECT unnest(['event_id','id','timestamp','source','source_type','host','user','source_ip','destination_ip','process','event_type','outcome','severity','message','attributes','value','bytes','index']) AS name UNION SELECT DISTINCT unnest(json_keys(attributes)) FROM ev")(s.field_catalog)

q("W1_streamstats", 'SELECT id, count(*) OVER w AS count, max(value) OVER w AS max_value FROM ev WINDOW w AS (PARTITION BY "user" ORDER BY timestamp, id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)')(lambda e: s.streamstats(e, ["count", ("max", "value")], ["user"], ["timestamp", "id"], 5).select("id", "count", "max_value"))
# Over all events, in ranges of their order: the running form, and the last five rows.
q("W1_streamstats_all", "SELECT id, count(*) OVER w AS count, (sum(bytes) OVER w)::BIGINT AS sum_bytes, max(bytes) OVER w AS max_bytes, min(bytes) OVER l AS min_last FROM ev WINDOW w AS (ORDER BY timestamp, id ROWS UNBOUNDED PRECEDING), l AS (ORDER BY timestamp, id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")(
    lambda e: s.streamstats(s.streamstats(e, ["count", ("sum", "bytes"), ("max", "bytes")], [], ["timestamp", "id"]), [("min", "bytes", "min_last")], [], ["timestamp", "id"], 5).select("id", "count", "sum_bytes", "max_bytes", "min_last"))
q("W2_dedup", "SELECT host, source, id FROM ev QUALIFY row_number() OVER (PARTITION BY host, source ORDER BY timestamp, id) = 1")(lambda e: s.dedup(e.select("host", "source", "id", "timestamp"), ["host", "source"], ["timestamp", "id"]).select("host", "source", "id"))
q("W3_top_n_per_key", "SELECT host, id, value FROM ev QUALIFY row_number() OVER (PARTITION BY host ORDER BY value DESC, id) <= 3")(lambda e: s.top_n_per_key(e.select("host", "id", "value"), ["host"], [F.desc("value"), "id"], 3))
q("W4_rolling_counts", """SELECT id, (count(*) FILTER (outcome = 'failure') OVER w)::BIGINT AS failures, (count(*) FILTER (source = 'view') OVER w)::BIGINT AS views FROM ev WINDOW w AS (PARTITION BY "user" ORDER BY timestamp RANGE BETWEEN INTERVAL 12 HOUR PRECEDING AND CURRENT ROW)""")(
    lambda e: s.rolling_condition_counts(e, "user", {"failures": F.col("outcome") == "failure", "views": F.col("source") == "view"}, "12h").select("id", "failures", "views"))

q("L1_sort", "SELECT id, host, value FROM ev ORDER BY host, value DESC, id")(lambda e: s.sort_(e.select("id", "host", "value"), "host", "-value", "id"))
q("L2_head", "SELECT id, timestamp FROM ev ORDER BY timestamp DESC, id LIMIT 20")(lambda e: s.head(e, 20).select("id", "timestamp"))
q("L3_tail", "SELECT id, timestamp FROM ev ORDER BY timestamp DESC, id DESC LIMIT 20")(lambda e: s.tail(e.select("id", "timestamp"), 20, ["timestamp", "id"]))
q("L4_page", "SELECT id FROM ev ORDER BY timestamp DESC, id LIMIT 100 OFFSET 300")(lambda e: s.page(e, 100, 300)[0].select("id"))
q("L7_diff", f"SELECT host, CASE WHEN a THEN 'added' ELSE 'removed' END AS change FROM (SELECT host, bool_or(source = 'error') AS a, bool_or(source = 'signup' AND \"user\" LIKE '%1') AS b FROM ev GROUP BY 1) WHERE a <> b")(
    lambda e: s.diff(e.where((F.col("source") == "signup") & F.col("user").like("%1")).select("host").distinct(), e.where("source = 'error'").select("host").distinct(), ["host"]))
q("L8_merge_capped", "SELECT host, 'h' || ',' || host AS merged FROM (SELECT DISTINCT host FROM ev)")(lambda e: e.select("host").distinct().select("host", F.array_join(s.merge_capped(F.array(F.lit("h"), "host"), F.array("host", F.lit("z")), 2), ",").alias("merged")))
q("S12_severities", "SELECT DISTINCT severity, severity AS folded, CASE severity WHEN 'err' THEN 'high' WHEN 'warning' THEN 'medium' WHEN 'notice' THEN 'medium' ELSE 'low' END AS soc, CASE severity WHEN 'info' THEN 1 WHEN 'notice' THEN 2 WHEN 'warning' THEN 3 ELSE 4 END AS rank FROM ev")(
    lambda e: e.select("severity", X.normalize_severity("severity").alias("folded"), X.soc_severity("severity").alias("soc"), X.severity_rank("severity").alias("rank")).distinct())
q("S13_parse_timestamp", "SELECT id, date_trunc('second', timestamp) AS a FROM ev")(lambda e: e.select("id", X.parse_timestamp(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz").alias("a")))
