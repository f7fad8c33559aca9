"""Indicators of compromise: feeds, confidence, hits, co-occurrence, marks on events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import normalize_indicator
from .joins import indicator_refs
from .stats import top_n_per_key

TYPES = ("ip", "domain", "url", "hash", "email", "user", "process")
SEVERITIES = ("low", "medium", "high", "critical")


def severity_order(x: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), x)


def indicators(feed: DataFrame) -> DataFrame:
    """One row per (type, normal form): the worst severity, and the sources with their latest word.

    ``feed``: type, value, severity, confidence, source, reliability, seen.  Rows of another type or severity, without a value or
    with a confidence or reliability outside 0..1 are refused.
    """
    ok = feed.where(F.col("type").isin(*TYPES) & F.col("severity").isin(*SEVERITIES) & (F.trim("value") != "") & F.col("confidence").between(0, 1) & F.col("reliability").between(0, 1))
    ok = ok.withColumn("norm", normalize_indicator(F.col("type"), F.col("value"))).where("norm != ''")
    one = ok.groupBy("type", "norm", "source").agg(F.max_by(F.struct("severity", "confidence", "reliability", "value"), F.struct("seen", "confidence", "severity", "value")).alias("x"), F.min("seen").alias("first"), F.max("seen").alias("last"))
    out = one.groupBy("type", "norm").agg(
        F.max_by("x.severity", severity_order(F.col("x.severity"))).alias("severity"), F.min("x.value").alias("value"), F.count(F.lit(1)).alias("n_sources"), F.max(F.col("x.confidence") * F.col("x.reliability")).alias("best"),
        F.min("first").alias("first_seen"), F.max("last").alias("last_seen"),
    )
    return out.select(F.concat_ws(":", "type", "norm").alias("indicator_id"), "type", "value", F.col("norm").alias("normalized_value"), "severity", confidence(F.col("best"), F.col("n_sources")).alias("confidence"), "n_sources", "first_seen", "last_seen")


def confidence(best: Column, sources: Column) -> Column:
    return F.round(F.when(sources == 1, best * 0.8).otherwise(best), 3)


def indicator_confidence(sources: DataFrame) -> DataFrame:
    """(indicator_id, confidence) of (indicator_id, source, confidence, reliability)."""
    g = sources.groupBy("indicator_id").agg(F.max(F.col("confidence") * F.col("reliability")).alias("b"), F.count_distinct("source").alias("n"))
    return g.select("indicator_id", confidence(F.col("b"), F.col("n")).alias("confidence"))


def indicator_groups(indicators: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((type, norm, groups), (group, ids)): indicators that hold the same values are one group, named after the smallest of its ids.

    Events hit all of a group or none, so what is counted of indicators is counted of groups: the work grows with the events and the
    indicators, and not with their pairs.
    """
    own = indicators.select("indicator_id", F.struct("type", normalize_indicator(F.col("type"), F.col("value")).alias("norm")).alias("v"))
    alike = own.groupBy("indicator_id").agg(F.sort_array(F.collect_set("v")).alias("vs")).groupBy("vs").agg(F.min("indicator_id").alias("group"), F.collect_list("indicator_id").alias("ids"))
    values = alike.select("group", F.explode("vs").alias("v")).groupBy("v").agg(F.collect_list("group").alias("groups"))
    return values.select("v.type", "v.norm", "groups"), alike.select("group", "ids")


def first_indicators(indicators: DataFrame, n: int) -> DataFrame:
    """(type, norm, ids): of the indicators that hold a value the first ``n`` ids, in order as strings; they are ranked before they are gathered."""
    own = indicators.select("type", normalize_indicator(F.col("type"), F.col("value")).alias("norm"), F.col("indicator_id").cast("string").alias("i"))
    top = top_n_per_key(own.distinct(), ["type", "norm"], ["i"], n)
    return top.groupBy("type", "norm").agg(F.sort_array(F.collect_list("i")).alias("ids"))


def indicator_hits(events: DataFrame, indicators: DataFrame) -> DataFrame:
    """(indicator_id, hit_count, last_seen) of the events that hold an indicator."""
    values, members = indicator_groups(indicators)
    hits = indicator_refs(events, "id", "timestamp").join(values, ["type", "norm"]).select("id", "timestamp", F.explode("groups").alias("group"))
    g = hits.groupBy("group").agg(F.count_distinct("id").alias("hit_count"), F.max("timestamp").alias("last_seen"))
    return g.join(members, "group").select(F.explode("ids").alias("indicator_id"), "hit_count", "last_seen")


def indicator_cooccurrence(events: DataFrame, indicators: DataFrame) -> DataFrame:
    """(first, other, events): a star per event from its smallest indicator, so pairs grow with the hits and not their square."""
    values, members = indicator_groups(indicators)
    hits = indicator_refs(events, "id").join(values, ["type", "norm"]).groupBy("id").agg(F.array_distinct(F.flatten(F.collect_set("groups"))).alias("groups"))
    g = hits.select(F.array_min("groups").alias("first"), F.explode("groups").alias("group")).groupBy("first", "group").agg(F.count(F.lit(1)).alias("events"))
    return g.join(members, "group").select("first", F.explode("ids").alias("other"), "events").where("other != first")


def mark_events(events: DataFrame, indicators: DataFrame, form: Callable[[Column], Column] = F.sort_array) -> DataFrame:
    """Events with threat_indicators (sorted ids) and threat_severity (the worst), null where nothing matched.

    ``form`` makes threat_indicators of the array of ids, once for each set of ids that occurs.
    """
    values, members = indicator_groups(indicators)
    worst = F.max(F.struct(severity_order(F.col("severity")).alias("o"), "severity")).alias("worst")
    values = values.join(indicators.groupBy("type", normalize_indicator(F.col("type"), F.col("value")).alias("norm")).agg(worst), ["type", "norm"])
    hits = indicator_refs(events, "id").join(values, ["type", "norm"])
    g = hits.groupBy("id").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_set("groups")))).alias("__set"), F.max("worst")["severity"].alias("threat_severity"))
    # The lists are made for sets and come to the events last: no shuffle carries them.
    lists = g.select("__set").distinct().select("__set", F.explode("__set").alias("group")).join(members, "group").groupBy("__set").agg(form(F.flatten(F.collect_list("ids"))).alias("threat_indicators"))
    return events.join(g, "id", "left").join(lists, "__set", "left").select(*events.columns, "threat_indicators", "threat_severity")


def indicator_lookup(values: DataFrame, dim: DataFrame, n: int = 50) -> DataFrame:
    """(value, indicator_id, confidence): indicators of any type whose normal form the value has, most confident first."""
    own = dim.select("indicator_id", "type", "confidence", normalize_indicator(F.col("type"), F.col("value")).alias("norm"))
    forms = F.array_distinct(F.array(*[normalize_indicator(F.lit(t), F.col("value")) for t in ("ip", "url", "hash", "domain")]))
    each = values.select("value", F.explode(forms).alias("norm")).distinct()
    return top_n_per_key(each.join(own, "norm").select("value", "indicator_id", "confidence").distinct(), ["value"], [F.desc("confidence"), "indicator_id"], n)


def abuse_feed(df: DataFrame, column: str = "value") -> DataFrame:
    """Feed rows of landed JSON: URL lists {"urls": [{url, date_added}]} and IOC lists {"data": [{ioc, ioc_type, confidence_level, first_seen}]}."""
    schema = "struct<urls:array<struct<url:string,date_added:string,url_status:string>>,data:array<struct<ioc:string,ioc_type:string,confidence_level:double,first_seen:string>>>"
    b = df.select(F.from_json(column, schema).alias("b"))
    urls = b.select(F.explode("b.urls").alias("u")).select(F.lit("url").alias("type"), F.col("u.url").alias("value"), F.lit("high").alias("severity"), F.lit(0.7).alias("confidence"), F.lit("urlhaus").alias("source"), F.lit(0.9).alias("reliability"), F.col("u.date_added").alias("seen"))
    kind = F.col("d.ioc_type")
    t = F.when(kind == "ip:port", "ip").when(kind.isin("md5_hash", "sha1_hash", "sha256_hash"), "hash").otherwise(kind)
    value = F.when(kind == "ip:port", F.substring_index("d.ioc", ":", 1)).otherwise(F.col("d.ioc"))
    iocs = b.select(F.explode("b.data").alias("d")).select(t.alias("type"), value.alias("value"), F.lit("high").alias("severity"), (F.col("d.confidence_level") / 100).alias("confidence"), F.lit("threatfox").alias("source"), F.lit(0.9).alias("reliability"), F.col("d.first_seen").alias("seen"))
    return urls.unionByName(iocs)
