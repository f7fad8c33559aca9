"""Entity risk: scored events, contributions of findings, anomalies and indicators, sums over the ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import normalize_indicator
from .findings import OPEN
from .joins import asset_enrich, identity_enrich, indicator_refs
from .stats import top_n_per_key

# Fixed points.
SEVERITY_POINTS = {"emergency": 50, "critical": 50, "alert": 45, "err": 35, "warning": 20, "notice": 10, "info": 5}
CRITICALITY_POINTS = {"critical": 10, "high": 6, "medium": 3, "low": 1}
PRIVILEGE_POINTS = {"admin": 10, "privileged": 5}
INDICATOR_POINTS = {"critical": 25, "high": 15, "medium": 8, "low": 4}
HALF_LIFE_HOURS = {"finding": 720, "event": 72, "ti": 2160, "anomaly": 24}
LEDGER = ("entity_type", "entity_value", "source_type", "source_id", "description", "points", "event_id", "created_at")


def points(x: Column, table: dict) -> Column:
    out = F.lit(0.0)
    for k, v in table.items():
        out = F.when(x == k, float(v)).otherwise(out)
    return out


def _entry(kind: str, value, source: str, source_id, what, pts, event_id, at) -> Column:
    return F.struct(F.lit(kind).alias("entity_type"), value.alias("entity_value"), F.lit(source).alias("source_type"), source_id.cast("string").alias("source_id"), F.lit(what).alias("description"), pts.cast("double").alias("points"), event_id.cast("string").alias("event_id"), at.alias("created_at"))


def _ledger(df: DataFrame, entries: list[Column]) -> DataFrame:
    return df.select(F.explode(F.array(*entries)).alias("c")).select("c.*").where("points > 0 and entity_value is not null and entity_value != ''")


def score_events(events: DataFrame, assets: DataFrame, meta: DataFrame) -> DataFrame:
    """Ledger rows: a host for an event's severity and its own criticality, a user for privilege."""
    e = identity_enrich(asset_enrich(events, assets), meta)
    at, i = F.col("timestamp"), F.col("id")
    return _ledger(e, [
        _entry("host", F.col("host"), "event", i, "severity", points(F.col("severity"), SEVERITY_POINTS), i, at),
        _entry("host", F.col("host"), "event", i, "asset criticality", points(F.col("criticality"), CRITICALITY_POINTS), i, at),
        _entry("user", F.col("user"), "event", i, "privilege", points(F.col("privilege"), PRIVILEGE_POINTS), i, at),
    ])


def finding_contributions(findings: DataFrame) -> DataFrame:
    """The risk score of new findings for each entity 'kind:value'; a process gets half."""
    each = findings.where("risk_score > 0").select("id", "risk_score", "title", "first_seen", F.explode("entities").alias("ref")).where("substring_index(ref, ':', 1) != ref and ref not like '%:'")
    kind, value = F.substring_index("ref", ":", 1), F.expr("substring(ref, instr(ref, ':') + 1)")
    p = F.col("risk_score")
    return each.select(kind.alias("entity_type"), value.alias("entity_value"), F.lit("finding").alias("source_type"), F.col("id").alias("source_id"), F.col("title").alias("description"), F.when(kind == "process", p / 2).otherwise(p).alias("points"), F.lit(None).cast("string").alias("event_id"), F.col("first_seen").alias("created_at"))


def ti_contributions(events: DataFrame, indicators: DataFrame) -> DataFrame:
    """For each entity and event the strongest indicator: severity points times confidence."""
    p = points(F.col("severity"), INDICATOR_POINTS) * F.col("confidence")
    own = indicators.select("indicator_id", "type", "value", normalize_indicator(F.col("type"), F.col("value")).alias("norm"), p.alias("p"))
    # The strongest of each value is found before the events come to it.
    best = own.groupBy("type", "value", "norm").agg(F.max("p").alias("points"), F.max_by("indicator_id", F.struct("p", "indicator_id")).alias("indicator_id"))
    j = indicator_refs(events.withColumn("created_at", F.col("timestamp")), "id", "created_at").drop("column").distinct().join(best, ["type", "norm"])
    return j.select(F.col("type").alias("entity_type"), F.col("value").alias("entity_value"), F.lit("ti").alias("source_type"), F.col("indicator_id").cast("string").alias("source_id"), F.lit("indicator").alias("description"), F.round("points", 6).alias("points"), F.col("id").alias("event_id"), "created_at")


def anomaly_contributions(anomalies: DataFrame) -> DataFrame:
    p = F.when(F.col("suppressed_reason").isNotNull(), 0.0).otherwise(F.col("points").cast("double"))
    return anomalies.select("entity_type", "entity_value", F.lit("anomaly").alias("source_type"), F.col("feature").alias("source_id"), F.coalesce("suppressed_reason", "feature").alias("description"), p.alias("points"), F.lit(None).cast("string").alias("event_id"), F.col("detected_at").alias("created_at"))


def entity_risk(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("entity_type", "entity_value").agg(F.sum("points").alias("score"), F.count(F.lit(1)).alias("contributions"), F.max("created_at").alias("updated_at"))


def open_counts(findings: DataFrame) -> DataFrame:
    refs = F.array(*[F.struct(F.lit(k).alias("entity_type"), F.col(x).alias("entity_value")) for k, x in (("user", "user"), ("host", "host"), ("ip", "source_ip"))])
    each = findings.where(F.col("status").isin(*OPEN)).select("id", F.explode(F.array_distinct(refs)).alias("e")).where("e.entity_value is not null")
    return each.groupBy("e.entity_type", "e.entity_value").agg(F.count(F.lit(1)).alias("open_findings"))


def with_open(risk: DataFrame, findings: DataFrame) -> DataFrame:
    return risk.join(open_counts(findings), ["entity_type", "entity_value"], "left").withColumn("open_findings", F.coalesce("open_findings", F.lit(0)))


def top_risk(ledger: DataFrame, findings: DataFrame, kind: str, n: int) -> DataFrame:
    return with_open(entity_risk(ledger.where(F.col("entity_type") == kind)), findings).orderBy(F.desc("score"), "entity_value").limit(n)


def at_risk(ledger: DataFrame, kind: str) -> DataFrame:
    return entity_risk(ledger.where(F.col("entity_type") == kind)).where("score > 0").agg(F.count(F.lit(1)).alias("at_risk"))


def explain(ledger: DataFrame, n: int, kind: str | None = None) -> DataFrame:
    led = ledger.where(F.col("entity_type") == kind) if kind else ledger
    return top_n_per_key(led, ["entity_type", "entity_value"], [F.desc("created_at"), "source_type", "source_id", "description"], n)


def reputation(ledger: DataFrame, findings: DataFrame) -> DataFrame:
    j = entity_risk(ledger).join(open_counts(findings), ["entity_type", "entity_value"], "full_outer").fillna(0, ["score", "open_findings"])
    s, o = F.col("score"), F.col("open_findings")
    label = F.when((s >= 100) | (o >= 3), "malicious").when((s >= 30) | (o >= 1), "suspicious").when(s > 0, "benign").otherwise("unknown")
    return j.select("entity_type", "entity_value", "score", "open_findings", label.alias("reputation"))


def finding_risk(findings: DataFrame, ledger: DataFrame) -> DataFrame:
    """(finding_id, entity_type, entity_value, score, contributions) of a finding's four primary entities."""
    refs = F.array(*[F.struct(F.lit(k).alias("entity_type"), F.col(x).alias("entity_value")) for k, x in (("user", "user"), ("host", "host"), ("ip", "source_ip"), ("ip", "destination_ip"))])
    each = findings.select(F.col("id").alias("finding_id"), F.explode(F.array_distinct(refs)).alias("e")).select("finding_id", "e.*").where("entity_value is not null and entity_value != ''")
    return each.join(entity_risk(ledger), ["entity_type", "entity_value"], "left").select("finding_id", "entity_type", "entity_value", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("contributions", F.lit(0)).alias("contributions"))


def decayed_risk(ledger: DataFrame, now: Column) -> DataFrame:
    hours = F.greatest((F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))) / 3.6e9, F.lit(0.0))
    life = F.lit(72.0)
    for k, v in HALF_LIFE_HOURS.items():
        life = F.when(F.col("source_type") == k, float(v)).otherwise(life)
    return ledger.groupBy("entity_type", "entity_value").agg(F.sum(F.col("points") * F.pow(F.lit(0.5), hours / life)).alias("score"))


def entity_detail(entities: DataFrame, edges: DataFrame, ledger: DataFrame, findings: DataFrame, kind: str, value: str) -> DataFrame:
    """One row for an entity: its counts, score, open findings, and how many neighbours it has within two steps."""
    from .graph import bfs

    node = entities.where((F.col("type") == kind) & (F.col("value") == value))
    root = node.select(F.concat_ws(":", "type", "value").alias("node"))
    near = bfs(edges, root, 2).where("depth > 0").agg(F.count_if(F.col("depth") == 1).alias("neighbors"), F.count(F.lit(1)).alias("within_two"))
    own = with_open(entity_risk(ledger.where((F.col("entity_type") == kind) & (F.col("entity_value") == value))), findings)
    keys = own.select(F.col("entity_type").alias("type"), F.col("entity_value").alias("value"), "score", "contributions", "open_findings")
    return node.join(keys, ["type", "value"], "left").fillna(0, ["score", "contributions", "open_findings"]).crossJoin(F.broadcast(near))  # one row each
