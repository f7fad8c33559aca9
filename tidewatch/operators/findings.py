"""Findings: upsert and dedup, queues, context; feedback and posture."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import bucket_start, soc_severity
from .stats import merge_capped

OPEN = ("new", "open", "in_progress")
DEFAULT_RISK = {"critical": 50, "high": 35, "medium": 20, "low": 10}
SCHEMA = (
    "id string, dedup_key string, title string, severity string, status string, risk_score double, detection_id string, user string, host string, source_ip string, destination_ip string, mitre_tactic string, mitre_technique string, "
    "tags array<string>, event_ids array<string>, entities array<string>, match_count long, first_seen timestamp_ntz, last_seen timestamp_ntz"
)
COLUMNS = [x.split()[0] for x in SCHEMA.split(", ")]


def default_risk(severity: Column) -> Column:
    return reduce(lambda w, kv: w.when(severity == kv[0], float(kv[1])), DEFAULT_RISK.items(), F).otherwise(10.0)


def new_findings(groups: DataFrame, rule_id: str, name: str, severity: str, tactic: str | None = None, technique: str | None = None) -> DataFrame:
    """Findings of detection groups (group_key, n, first_seen, last_seen and any of user, host, addresses, event_ids, entities)."""
    have = groups.columns
    get = lambda k, kind="string": (F.col(k) if k in have else F.lit(None)).cast(kind)
    sev = soc_severity(F.lit(severity))
    key = F.concat(F.lit(rule_id + "|"), "group_key")
    empty = F.array().cast("array<string>")
    refs = F.array_compact(F.array(*[F.when(get(x) != "", F.concat(F.lit(k + ":"), get(x))) for k, x in (("user", "user"), ("host", "host"), ("ip", "source_ip"), ("ip", "destination_ip"))]))
    out = {
        "id": F.concat(F.lit("f-"), F.substring(F.sha2(key, 256), 1, 12)), "dedup_key": key, "title": F.concat(F.lit(name + " — "), "group_key"), "severity": sev, "status": F.lit("new"), "risk_score": default_risk(sev), "detection_id": F.lit(rule_id),
        "mitre_tactic": F.lit(tactic), "mitre_technique": F.lit(technique), "tags": empty, "event_ids": F.coalesce(get("event_ids", "array<string>"), empty), "entities": F.coalesce(get("entities", "array<string>"), F.array_distinct(refs)), "match_count": get("n", "long"),
        "first_seen": get("first_seen", "timestamp_ntz"), "last_seen": get("last_seen", "timestamp_ntz"),
    }
    kinds = dict(x.split(None, 1) for x in SCHEMA.split(", "))
    return groups.select(*[out.get(c, get(c)).cast(kinds[c]).alias(c) for c in COLUMNS])


def findings_upsert(prev: DataFrame, new: DataFrame) -> DataFrame:
    """One finding per dedup key: known ones gain counts, ids (200 kept), entities (50 kept), the larger risk and missing names."""
    a = prev.select(F.struct(*COLUMNS).alias("a"), F.col("dedup_key"))
    b = new.select(F.struct(*COLUMNS).alias("b"), F.col("dedup_key"))
    j = a.join(b, "dedup_key", "full_outer")
    out = []
    for c in COLUMNS:
        x, y = F.col(f"a.{c}"), F.col(f"b.{c}")
        if c == "dedup_key":
            v = F.col("dedup_key")
        elif c == "match_count":
            v = F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0))
        elif c in ("event_ids", "entities", "tags"):
            v = merge_capped(x, y, {"event_ids": 200, "entities": 50, "tags": 50}[c])
        elif c in ("risk_score", "last_seen"):
            v = F.greatest(x, y)
        elif c == "first_seen":
            v = F.least(x, y)
        else:
            v = F.coalesce(F.nullif(x, F.lit("")), y)
        out.append(v.alias(c))
    return j.select(*out)


def merged_findings(findings: DataFrame) -> DataFrame:
    """One finding per dedup key of several detections at once, combined as ``findings_upsert`` combines them, the earliest first."""
    order = F.struct("first_seen", "last_seen", "match_count", "id")
    lists = {"event_ids": 200, "entities": 50, "tags": 50}
    out = []
    for c in COLUMNS:
        x = F.col(c)
        if c == "dedup_key":
            continue
        if c in lists:
            v = F.slice(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), x.alias("x")))), lambda p: p["x"]))), 1, lists[c])
        elif c == "match_count":
            v = F.sum(x)
        elif c in ("risk_score", "last_seen"):
            v = F.max(x)
        elif c == "first_seen":
            v = F.min(x)
        else:
            v = F.min_by(x, F.when(F.nullif(x, F.lit("")).isNotNull(), order))
        out.append(v.alias(c))
    return findings.groupBy("dedup_key").agg(*out).select(*COLUMNS)


def primary_entities(events: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first non-empty user, host and addresses of each group, in order."""
    firsts = [F.min_by(x, F.when(F.nullif(F.col(x), F.lit("")).isNotNull(), F.struct(*order))).alias(x) for x in ("user", "host", "source_ip", "destination_ip") if x not in key]
    return events.groupBy(*key).agg(*firsts)


def apply_suppression(findings: DataFrame, suppressed: DataFrame) -> DataFrame:
    return findings.join(suppressed.select("detection_id").distinct(), "detection_id", "left_anti")


def query_table(df: DataFrame, equal: dict | None = None, ilike: dict | None = None, ranges: dict | None = None, contains: dict | None = None, sort: str | None = None, limit: int | None = None, offset: int = 0, tie: str = "id") -> DataFrame:
    """A queue or list: equalities, substrings in any of several columns ('a,b' keys), closed ranges, array members, order, page."""
    tests = [F.col(k) == v for k, v in (equal or {}).items()]
    tests += [reduce(or_, [F.col(c).ilike(f"%{v}%") for c in k.split(",")]) for k, v in (ilike or {}).items()]
    tests += [F.array_contains(k, v) for k, v in (contains or {}).items()]
    for k, (lo, hi) in (ranges or {}).items():
        tests += [F.col(k) >= lo] if lo is not None else []
        tests += [F.col(k) <= hi] if hi is not None else []
    df = df.where(reduce(and_, tests, F.lit(True)))
    if sort:
        x = F.col(sort.lstrip("-"))
        df = df.orderBy(x.desc_nulls_last() if sort.startswith("-") else x.asc_nulls_last(), tie)
    df = df.offset(offset) if offset else df
    return df.limit(limit) if limit is not None else df


def finding_posture(findings: DataFrame) -> DataFrame:
    """(kind, name, count) by severity and status, and the open ones."""
    key = lambda kind, name: F.struct(F.lit(kind).alias("kind"), name.alias("name"))
    keys = F.array(key("severity", F.col("severity")), key("status", F.col("status")), F.when(F.col("status").isin(*OPEN), key("open", F.lit(""))))
    return findings.select(F.explode(F.array_compact(keys)).alias("k")).groupBy("k.kind", "k.name").agg(F.count(F.lit(1)).alias("count"))


def finding_timeline(findings: DataFrame, bucket: int) -> DataFrame:
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high", "medium", "low")]
    return findings.groupBy(bucket_start("first_seen", bucket).alias("bucket")).agg(F.count(F.lit(1)).alias("total"), *counts)


def active_techniques(findings: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    out = findings.where(F.col("status").isin(*OPEN) & F.col("mitre_technique").isNotNull()).groupBy("mitre_tactic", "mitre_technique").agg(F.count(F.lit(1)).alias("count"))
    if catalog is not None:
        out = out.join(catalog.select(F.col("technique").alias("mitre_technique"), F.col("name").alias("technique_name")), "mitre_technique", "left")
    return out


def feedback_stats(feedback: DataFrame, findings: DataFrame) -> DataFrame:
    """Labels per detection, of each analyst's latest word on a finding, and the share of false positives."""
    last = feedback.groupBy("finding_id", "analyst").agg(F.max_by("label", F.struct("created_at", "label")).alias("label"))
    j = last.join(findings.select(F.col("id").alias("finding_id"), "detection_id"), "finding_id")
    out = j.groupBy("detection_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("label") == "true_positive").alias("true_positive"), F.count_if(F.col("label") == "false_positive").alias("false_positive"), F.count_if(F.col("label") == "benign").alias("benign"))
    return out.withColumn("fp_rate", F.round(F.col("false_positive") / F.col("total"), 4))


#: Buckets of a finding's entities, and the attributes of events that fall into them.
BUCKETS = {"ip": "ips", "user": "users", "host": "hosts", "source": "sources", "process": "processes", "domain": "domains", "file": "files", "hash": "hashes"}
_ATTRIBUTES = {"domain": ("domain", "destination_domain", "dns.query", "url"), "hash": ("hash", "sha256", "md5", "sha1")}
_REFS = {"source_ip": "ip", "destination_ip": "ip", "sha256": "hash", "md5": "hash", "sha1": "hash"}
#: Hosts whose gaps are told, and indicators, of a finding.
CONTEXT_HOSTS, CONTEXT_INDICATORS = 3, 10


def _first(df: DataFrame, key: str, column: str, n: int, name: str) -> DataFrame:
    """(key, name): the first ``n`` distinct values of each key in order, ranked before they are gathered."""
    w = Window.partitionBy(key).orderBy(column)
    top = df.select(key, column).distinct().withColumn("n", F.row_number().over(w)).where(F.col("n") <= n)
    return top.groupBy(key).agg(F.sort_array(F.collect_list(column)).alias(name))


def finding_context(findings: DataFrame, links: DataFrame, events: DataFrame, techniques: DataFrame, hits: DataFrame, related: DataFrame, coverage: DataFrame | None = None, n_events: int = 100, held: DataFrame | None = None) -> DataFrame:
    """What an analyst, or a model, is told of each finding; lists are in order, and empty where there is nothing.

    Its newest events; what it and they name, by kind (ips to hashes); the techniques seen in them and the dominant tactic, the finding's
    own unless another is seen more often; indicators hit; related findings; and ``gaps``: "class on host" for the telemetry that
    ``coverage`` (host, missing) lacks on the first few hosts.

    ``hits`` are (id, indicator_id); with ``held`` (type, norm, ids), the first ``CONTEXT_INDICATORS`` indicators of each value at least, they are
    (id, type, norm): a finding's values are made distinct before their indicators are looked at, so that no pairs of events and indicators are made.
    """
    have = [c for c in ("source", "user", "host", "ip", "source_ip", "destination_ip", "process", "file_path", "attributes") if c in events.columns]
    e = links.select("finding_id", "event_id").distinct().join(events.select(F.col("id").alias("event_id"), "timestamp", *have), "event_id")
    w = Window.partitionBy("finding_id").orderBy(F.desc("timestamp"), "event_id")
    e = e.withColumn("n", F.row_number().over(w)).where(F.col("n") <= n_events).drop("n")
    ref = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"))
    own = {"ip": "ip", "source_ip": "ip", "destination_ip": "ip", "host": "host", "user": "user", "process": "process", "file_path": "file", "source": "source"}
    named = [ref(kind, F.col(c)) for c, kind in own.items() if c in have]
    if "attributes" in have:
        named += [ref(kind, F.get_json_object("attributes", f"$['{k}']")) for kind, keys in _ATTRIBUTES.items() for k in keys]
    refs = e.select("finding_id", F.explode(F.array(*named)).alias("r"))
    columns = F.array(*[ref(own[c], F.col(c)) for c in ("user", "host", "source_ip", "destination_ip")])
    kind = F.substring_index("entity", ":", 1)
    listed = findings.select(F.col("id").alias("finding_id"), F.explode("entities").alias("entity")).where("instr(entity, ':') > 0")
    kind = F.coalesce(F.create_map(*[F.lit(x) for kv in _REFS.items() for x in kv])[kind], kind)
    refs = refs.unionByName(findings.select(F.col("id").alias("finding_id"), F.explode(columns).alias("r"))).select("finding_id", "r.kind", "r.value")
    refs = refs.unionByName(listed.select("finding_id", kind.alias("kind"), F.expr("substring(entity, instr(entity, ':') + 1)").alias("value")))
    refs = refs.where("value is not null and value != ''").distinct()
    buckets = refs.groupBy("finding_id").agg(*[F.sort_array(F.collect_set(F.when(F.col("kind") == k, F.col("value")))).alias(n) for k, n in BUCKETS.items()])
    ids = e.groupBy("finding_id").agg(F.sort_array(F.collect_list("event_id")).alias("event_ids"))
    at = e.select("finding_id", "event_id")
    seen = at.join(techniques.select(F.col("id").alias("event_id"), "technique", "tactic"), "event_id").groupBy("finding_id", "technique", "tactic").agg(F.count(F.lit(1)).alias("c"))
    t = seen.groupBy("finding_id").agg(F.sort_array(F.collect_set("technique")).alias("techniques"))
    # The finding's own tactic is one of the tactics, seen or not, and wins where no other is seen more often.
    mine = findings.where("mitre_tactic is not null and mitre_tactic != ''").select(F.col("id").alias("finding_id"), F.col("mitre_tactic").alias("tactic"), F.lit(0).alias("c"), F.lit(1).alias("own"))
    tactics = seen.where("tactic is not null and tactic != ''").select("finding_id", "tactic", "c", F.lit(0).alias("own")).unionByName(mine).groupBy("finding_id", "tactic").agg(F.sum("c").alias("c"), F.max("own").alias("own"))
    k = tactics.groupBy("finding_id").agg(F.min(F.struct((-F.col("c")).alias("c"), (-F.col("own")).alias("own"), "tactic")).alias("k")).select("finding_id", F.col("k.tactic").alias("dominant_tactic"))
    # Merged: hits come out of an explode, by which Spark sizes them far too low.
    found = at.join(hits.withColumnRenamed("id", "event_id").hint("merge"), "event_id")
    if held is not None:
        found = found.select("finding_id", "type", "norm").distinct().join(held, ["type", "norm"]).withColumn("indicator_id", F.explode("ids"))
    h = _first(found.select("finding_id", F.col("indicator_id").cast("string").alias("i")), "finding_id", "i", CONTEXT_INDICATORS, "indicators")
    r = related.groupBy("finding_id").agg(F.sort_array(F.collect_set("other_id")).alias("related"))
    parts = [ids, buckets, t, k, h, r]
    if coverage is not None:
        hosts = refs.where("kind = 'host'").withColumn("n", F.row_number().over(Window.partitionBy("finding_id").orderBy("value"))).where(F.col("n") <= CONTEXT_HOSTS)
        gap = hosts.join(coverage.select(F.col("host").alias("value"), "missing"), "value").select("finding_id", "value", F.explode("missing").alias("m")).select("finding_id", F.concat("m", F.lit(" on "), "value").alias("gap"))
        parts.append(gap.groupBy("finding_id").agg(F.sort_array(F.collect_set("gap")).alias("gaps")))
    out = findings.select(F.col("id").alias("finding_id"), "title", "severity")
    for x in parts:
        out = out.join(x, "finding_id", "left")
    return out.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c, kind in out.dtypes if kind.startswith("array")})
