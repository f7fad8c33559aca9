"""Enrichment joins: lookups, addresses, assets, indicators, as-of and interval joins.

Small sides are left to adaptive execution, which broadcasts a side whose measured size is under the session's threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import normalize_indicator, span_seconds
from ..scratch import saved
from .ordered import AT, PART, positioned, running

ENTITY_COLUMNS = {"user": ("user",), "host": ("host",), "process": ("process",), "ip": ("source_ip", "destination_ip")}


def lookup(df: DataFrame, table: DataFrame, on: dict[str, str], outputs: list[str]) -> DataFrame:
    """Columns of the first row of ``table`` for each key; rows without one get nulls."""
    keys = {v: f"__{v}" for v in on.values()}
    one = table.groupBy(*[F.col(v).alias(keys[v]) for v in on.values()]).agg(F.min(F.struct(*outputs)).alias("__o"))
    out = df.join(one, [F.col(k) == F.col(keys[v]) for k, v in on.items()], "left")
    return out.select(*df.columns, *[F.col(f"__o.{o}").alias(o) for o in outputs])


_EDGE = ["from_type", "from_value", "to_type", "to_value", "relation"]


def edges_with_state(edges: DataFrame, meta: DataFrame) -> DataFrame:
    state = meta.groupBy(*_EDGE).agg(F.max("status").alias("status"))
    return edges.join(state, _EDGE, "left").withColumn("status", F.coalesce("status", F.lit("observed")))


def neighbors(edges: DataFrame, nodes: DataFrame, kind: str, value: str) -> DataFrame:
    """Both directions, each neighbour and relation once, with the node's counts where it is known."""
    out = edges.where((F.col("from_type") == kind) & (F.col("from_value") == value)).select(F.col("to_type").alias("type"), F.col("to_value").alias("value"), "relation", F.lit("out").alias("direction"))
    into = edges.where((F.col("to_type") == kind) & (F.col("to_value") == value)).select(F.col("from_type").alias("type"), F.col("from_value").alias("value"), "relation", F.lit("in").alias("direction"))
    return out.unionByName(into).distinct().join(nodes.select("type", "value", "count"), ["type", "value"], "left")


def touches(kind: str, value: str) -> Column:
    if kind == "email":
        return F.lower("attributes").contains(value.lower())
    out = F.lit(False)
    for x in ENTITY_COLUMNS[kind]:
        out = out | F.coalesce(F.col(x) == value, F.lit(False))
    return out


def related_events(events: DataFrame, kind: str, value: str, n: int) -> DataFrame:
    return events.where(touches(kind, value)).orderBy(F.desc("timestamp"), "id").limit(n)


def entity_refs(events: DataFrame, *keep: str) -> DataFrame:
    """(keep, type, value): each entity that an event names, once."""
    refs = F.array(*[F.struct(F.lit(k).alias("type"), F.col(x).alias("value")) for k, xs in ENTITY_COLUMNS.items() for x in xs if x in events.columns])
    return events.select(*keep, F.explode(F.array_distinct(refs)).alias("e")).select(*keep, "e.type", "e.value").where("value is not null and value != ''")


def local_ip_enrich(df: DataFrame, ips: DataFrame) -> DataFrame:
    """``ips`` (ip, description) for both ends."""
    one = ips.groupBy("ip").agg(F.min("description").alias("d"))
    for side in ("source", "destination"):
        df = df.join(one.select(F.col("ip").alias(f"{side}_ip"), F.col("d").alias(f"{side}_description")), f"{side}_ip", "left")
    return df


def ipv4_number(ip: Column) -> Column:
    p = F.split(ip, r"\.")
    o = [F.get(p, F.lit(i)).try_cast("bigint") for i in range(4)]
    ok = ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    return F.when(ok, o[0] * 16777216 + o[1] * 65536 + o[2] * 256 + o[3])


def geo_enrich(df: DataFrame, ranges: DataFrame, column: str = "source_ip", bits: int = 16) -> DataFrame:
    """Columns of the range (lo, hi) that holds an address.

    A range is cut into the blocks of 2^``bits`` addresses that it touches, so the join is an equality on the block and
    the bounds only filter inside of it; the narrowest range wins where several hold an address.
    """
    outputs = [x for x in ranges.columns if x not in ("lo", "hi")]
    size = 1 << bits
    cut = ranges.select("*", F.explode(F.sequence(F.floor(F.col("lo") / size), F.floor(F.col("hi") / size))).alias("__block"))
    # Addresses repeat a great deal: the range is found once for each.
    ips = df.select(F.col(column).alias("__ip")).where("__ip is not null").distinct().withColumn("__n", ipv4_number(F.col("__ip"))).withColumn("__block", F.floor(F.col("__n") / size))
    found = ips.join(cut, "__block").where("__n between lo and hi").groupBy("__ip").agg(F.min_by(F.struct(*outputs), F.struct(F.col("hi") - F.col("lo"), "lo")).alias("__g"))
    out = df.join(found, F.col(column) == F.col("__ip"), "left")
    return out.select(*df.columns, *[F.col(f"__g.{o}").alias(f"geoip_{o}") for o in outputs])


def indicator_refs(events: DataFrame, *keep: str) -> DataFrame:
    """(keep, type, norm, column): the normal form of each address, name and attribute of an event that indicators may hold."""
    at = lambda k: F.get_json_object("attributes", f"$['{k}']")
    there = [("ip", x) for x in ("source_ip", "destination_ip", "ip") if x in events.columns] + [("domain", "host"), ("user", "user")]
    refs = [F.struct(F.lit(k).alias("type"), F.col(x).alias("value"), F.lit(x).alias("column")) for k, x in there]
    refs += [F.struct(F.lit(k).alias("type"), at(k).alias("value"), F.lit(f"attr.{k}").alias("column")) for k in ("domain", "url", "hash", "email", "process")]
    each = events.select(*keep, F.explode(F.array(*refs)).alias("r")).where("r.value is not null and r.value != ''")
    return each.select(*keep, F.col("r.type").alias("type"), normalize_indicator(F.col("r.type"), F.col("r.value")).alias("norm"), F.col("r.column").alias("column"))


def ti_hits(events: DataFrame, indicators: DataFrame) -> DataFrame:
    """(id, type, norm, column): the values of an event that indicators hold, however many do; also of a stream of events."""
    held = indicators.select("type", normalize_indicator(F.col("type"), F.col("value")).alias("norm")).distinct()
    return indicator_refs(events, "id").join(held, ["type", "norm"], "left_semi").select("id", "type", "norm", "column")


def hit_pairs(hits: DataFrame, indicators: DataFrame) -> DataFrame:
    """(id, indicator_id, type, value, severity, confidence, column): a row for each pair of a value (id, type, norm, column) and an indicator that holds it."""
    dim = indicators.select("indicator_id", "type", "value", "severity", "confidence", normalize_indicator(F.col("type"), F.col("value")).alias("norm"))
    return hits.join(dim, ["type", "norm"]).select("id", "indicator_id", "type", "value", "severity", "confidence", "column")


def ti_match(events: DataFrame, indicators: DataFrame) -> DataFrame:
    """(id, indicator_id, type, value, severity, confidence, column): indicators that an event's addresses, names or attributes hold.

    A row for each pair of them.  What is counted or gathered of the pairs comes from the values instead (``intel``).
    """
    return hit_pairs(indicator_refs(events, "id"), indicators)


def asset_enrich(df: DataFrame, assets: DataFrame) -> DataFrame:
    dim = assets.select("entity_ref", "criticality", "internet_exposed", "environment").dropDuplicates(["entity_ref"])
    return df.join(dim, F.concat(F.lit("host:"), "host") == F.col("entity_ref"), "left").drop("entity_ref")


def identity_enrich(df: DataFrame, meta: DataFrame) -> DataFrame:
    return df.join(meta.select("user", "privilege").dropDuplicates(["user"]), "user", "left")


def linked(indicators: DataFrame, link: DataFrame, dim: DataFrame, key: str, name: str, n: int) -> DataFrame:
    """The first ``n`` names of a dimension (actors, malware families) for each indicator."""
    w = Window.partitionBy("indicator_id").orderBy(name)
    out = indicators.select("indicator_id").join(link, "indicator_id").join(dim, key).select("indicator_id", name).distinct()
    return out.withColumn("n", F.row_number().over(w)).where(F.col("n") <= n).drop("n")


def near_blocks(numbered: DataFrame, n: int) -> DataFrame:
    """(finding_id, event_id, t) of the ``n`` events behind each finding's end, from its ``lo`` on; rows of both hold the ``number`` of events so far."""
    block = lambda x: F.floor(x / n)
    have = numbered.where("event").select("type", "value", "t", "event_id", (F.col("number") - 1).alias("at")).withColumn("block", block(F.col("at")))
    want = numbered.where("not event").select("finding_id", "lo", "type", "value", F.col("number").alias("from"))
    want = want.withColumn("block", F.explode(F.sequence(block(F.col("from")), block(F.col("from") + (n - 1)))))
    both = have.join(want, ["type", "value", "block"]).where((F.col("at") - F.col("from")).between(0, n - 1) & (F.col("t") >= F.col("lo")))
    return both.select("finding_id", "event_id", "t")


def finding_events(findings: DataFrame, events: DataFrame, slack="1h", n: int = 200) -> DataFrame:
    """(finding_id, event_id): linked events and those that share an entity within ``slack`` of the finding, the newest ``n``.

    The events of each entity are numbered from the newest on, with the ends of the findings among them.  A finding then takes the
    ``n`` numbers behind its end, as far as they lie within its time: a join on blocks of ``n`` numbers, of which it touches two at
    most, however many events share its entity and its time.
    """
    micro = span_seconds(slack) * 1_000_000
    epoch = lambda x: F.unix_micros(F.col(x).cast("timestamp"))
    ids = findings.select(F.col("id").alias("finding_id"), F.explode("event_ids").alias("event_id"))
    ids = ids.join(events.select(F.col("id").alias("event_id"), epoch("timestamp").alias("t")), "event_id")
    refs = F.array_distinct(F.array(*[F.struct(F.lit(k).alias("type"), F.col(x).alias("value")) for k, x in (("user", "user"), ("host", "host"), ("ip", "source_ip"), ("ip", "destination_ip"))]))
    want = findings.select(F.col("id").alias("finding_id"), (epoch("first_seen") - micro).alias("lo"), (epoch("last_seen") + micro).alias("t"), F.explode(refs).alias("e"))
    want = want.select("finding_id", "lo", "t", "e.type", "e.value", F.lit(False).alias("event")).where("value is not null and value != '' and lo is not null")
    have = entity_refs(events.withColumn("t", epoch("timestamp")), "id", "t").where("type != 'process'").withColumnRenamed("id", "event_id").withColumn("event", F.lit(True))
    placed = positioned(have.unionByName(want, allowMissingColumns=True).where("t is not null"), ["type", "value", F.desc("t"), "event", "event_id", "finding_id"])
    # Equal rows of an event lie side by side and count once.
    own = F.struct("type", "value", "t", "event", "event_id")
    again = F.lag(own).over(Window.partitionBy(PART).orderBy(AT)).eqNullSafe(own)
    numbered = running(placed.withColumn("new", F.col("event") & ~again), {"number": ("count", F.when(F.col("new"), 1))})
    numbered = saved(numbered.where("new or not event").drop(PART, AT), "numbered")
    near = near_blocks(numbered, n)
    w = Window.partitionBy("finding_id").orderBy(F.desc("t"), "event_id")
    both = ids.select("finding_id", "event_id", "t").unionByName(near)
    # An event that several entities lead to has one rank, so that what is left of a finding's rows is made distinct where it lies.
    return both.withColumn("n", F.dense_rank().over(w)).where(F.col("n") <= n).select("finding_id", "event_id", "n").distinct().select("finding_id", "event_id")


def related_findings(findings: DataFrame, n: int = 5) -> DataFrame:
    """(finding_id, other_id): open findings that share a user, a host or an address, the newest ``n``."""
    refs = F.array_distinct(F.array(*[F.struct(F.lit(k).alias("type"), F.col(x).alias("value")) for k, x in (("user", "user"), ("host", "host"), ("ip", "source_ip"), ("ip", "destination_ip"))]))
    each = findings.select("id", "status", "last_seen", F.explode(refs).alias("e")).where("e.value is not null and e.value != ''")
    a = each.select(F.col("id").alias("finding_id"), "e")
    b = each.where("status in ('new', 'open', 'in_progress')").select(F.col("id").alias("other_id"), "last_seen", "e")
    # Of each entity the newest ones are enough, one more for the finding itself: a hot host does not pair all its findings.
    newest = Window.partitionBy("e").orderBy(F.desc("last_seen"), "other_id")
    b = b.withColumn("n", F.row_number().over(newest)).where(F.col("n") <= n + 1).drop("n")
    w = Window.partitionBy("finding_id").orderBy(F.desc("last_seen"), "other_id")
    return a.join(b, "e").where("finding_id != other_id").select("finding_id", "other_id", "last_seen").distinct().withColumn("n", F.row_number().over(w)).where(F.col("n") <= n).select("finding_id", "other_id")


def active_entities(events: DataFrame, now, days: int = 7, column: str = "user") -> DataFrame:
    recent = events.where(F.col("timestamp") > now - F.expr(f"interval {days} days")).select(column).distinct()
    return events.join(recent, column, "left_semi")


def exclude_known(new: DataFrame, old: DataFrame, key: list[str]) -> DataFrame:
    return new.join(old, key, "left_anti")


def prev_event(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Columns of the key's event before this one, as prev_<column>."""
    w = Window.partitionBy(key).orderBy("timestamp", "id")
    return df.withColumns({f"prev_{x}": F.lag(x).over(w) for x in columns})


def baseline_lookup(observed: DataFrame, baselines: DataFrame, days: int = 30) -> DataFrame:
    return observed.join(baselines.where(F.col("window_days") == days), ["entity_type", "entity_value", "feature"])
