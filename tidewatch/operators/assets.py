"""Assets and telemetry coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Entity types and words in a name that suggest how critical an asset is, first come first.
CRITICALITY_RULES = (
    ("critical", ("identity_provider",), ("domain controller", "domain-controller", "payment", "card-", "core-banking")),
    ("high", ("database",), ("database", "db-", "pg-", "postgres", "mysql", "oracle", "sql")),
    ("high", ("server",), ("firewall", "router", "switch", "gateway", "loadbalancer", "load-balancer", "bastion", "jumpserver")),
    ("low", (), ("ci-", "build", "test", "dev", "sandbox", "staging", "demo", "training")),
)
# Weight in percent of each expected source class on a platform.
EXPECTED = {
    "windows": {"os.windows.security": 28, "os.windows.sysmon": 27, "os.windows.powershell": 17, "os.windows.defender": 11, "os.windows.dns": 5, "net.flow": 12},
    "linux": {"os.linux.auditd": 30, "os.linux.sshd": 15, "os.linux.sudo": 10, "os.linux.journal": 15, "net.flow": 15, "net.dns": 15},
    "network": {"net.firewall": 40, "net.dns": 20, "net.flow": 20, "net.ids": 20},
}

def observe_assets(events: DataFrame, prev: DataFrame | None = None) -> DataFrame:
    """(host, first_seen, last_seen, status): a host's first event makes a draft, later ones move last_seen."""
    now = events.where("host is not null and host != ''").groupBy("host").agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b"))
    if prev is None:
        return now.select("host", F.col("a").alias("first_seen"), F.col("b").alias("last_seen"), F.lit("draft").alias("status"))
    j = now.join(prev, "host", "full_outer")
    return j.select("host", F.coalesce("first_seen", "a").alias("first_seen"), F.greatest("last_seen", "b").alias("last_seen"), F.coalesce("status", F.lit("draft")).alias("status"))


def suggest_criticality(name: Column, entity_type: Column | None = None) -> Column:
    """A level from the entity's type and words in its name; medium if nothing tells."""
    out, low = F, F.lower(name)
    kind = F.lit("") if entity_type is None else F.coalesce(entity_type, F.lit(""))
    for level, kinds, words in CRITICALITY_RULES:
        hit = kind.isin(*kinds) if kinds else F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = out.when(hit, level)
    return out.otherwise("medium")


def platform(entity_type: Column, os: Column) -> Column:
    """windows, linux or network, from the operating system's name and the entity's type; null if neither tells."""
    low = F.lower(F.coalesce(os, F.lit("")))
    linux = entity_type.isin("database", "application", "host", "server", "workstation", "container") | low.contains("linux")
    return F.when(low.contains("windows"), "windows").when(entity_type == "network", "network").when(linux, "linux")


def merge_inventory(prev: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New rows over old ones, column by column where the new one says anything."""
    rest = [c for c in prev.columns if c not in key]
    j = prev.alias("a").join(new.alias("b"), key, "full_outer")
    return j.select(*key, *[F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c) for c in rest])


def coverage_rows(events: DataFrame, now: Column, prev: DataFrame | None = None, days: int = 30) -> DataFrame:
    """(host, source_class, last_event, event_count_30d) from events with a source_class column; the newest time ever stays."""
    seen = events.where(F.col("timestamp") >= now - F.expr(f"interval {days} days")).groupBy("host", "source_class").agg(F.max("timestamp").alias("last_event"), F.count(F.lit(1)).alias("event_count_30d"))
    if prev is None:
        return seen
    p = prev.select("host", "source_class", F.col("last_event").alias("p"))
    return seen.join(p, ["host", "source_class"], "full_outer").select("host", "source_class", F.greatest("last_event", "p").alias("last_event"), F.coalesce("event_count_30d", F.lit(0)).alias("event_count_30d"))


def coverage_pct(rows: DataFrame, kinds: DataFrame, now: Column) -> DataFrame:
    """(host, pct, available, missing, stale, unexpected): weighted share of the classes that a host's platform should send.

    ``rows`` (host, source_class, last_event), ``kinds`` (host, kind: its ``platform``); a class not heard of for a day is stale but counts.
    """
    spark = rows.sparkSession
    want = spark.createDataFrame([(k, c, w) for k, cs in EXPECTED.items() for c, w in cs.items()], "kind string, source_class string, weight int")
    e = kinds.join(want, "kind").select("host", "source_class", "weight")
    j = e.join(rows.select("host", "source_class", "last_event"), ["host", "source_class"], "full_outer")
    there, due = F.col("last_event").isNotNull(), F.col("weight").isNotNull()
    stale = there & (F.col("last_event") < now - F.expr("interval 24 hours"))
    pick = lambda t: F.sort_array(F.collect_set(F.when(t, F.col("source_class"))))
    return j.groupBy("host").agg(
        F.round(100.0 * F.coalesce(F.sum(F.when(there & due, F.col("weight"))), F.lit(0)) / F.nullif(F.sum("weight"), F.lit(0)), 2).alias("pct"), pick(there & due).alias("available"), pick(~there & due).alias("missing"), pick(stale & due).alias("stale"), pick(there & ~due).alias("unexpected")
    )


def enrich_chain(df: DataFrame, steps: list) -> DataFrame:
    """Enrichment steps, functions from DataFrame to DataFrame, in order."""
    for step in steps:
        df = df.transform(step)
    return df
