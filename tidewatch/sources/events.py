"""Reading and writing events: JSON lines, API bodies, HEC and OTLP payloads, canonical columns, sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import normalize_severity, parse_timestamp
from ..operators.filters import ALIASES

#: The canonical event columns and their types.
SCHEMA = (
    "id string, timestamp timestamp, received_at timestamp, source string, source_type string, host string, ip string, service string, application string, severity string, message string, event_type string, "
    "category string, action string, outcome string, user string, user_id string, process string, process_id string, parent_pid string, file_path string, destination_ip string, destination_port int, source_ip string, "
    "source_port int, raw string, raw_format string, trace_id string, span_id string, attributes string"
)
COLUMNS = [x.split()[0] for x in SCHEMA.split(", ")]
KINDS = {x.split()[0]: x.split()[1] for x in SCHEMA.split(", ")}

# Where a JSON line may hold a column, first come first.
_CHAINS = {"message": ("message", "msg", "log"), "host": ("host", "hostname"), "severity": ("severity", "level", "severity_level"), "timestamp": ("timestamp", "@timestamp", "time"), "event_type": ("event_type", "type")}
#: Source classes.
CLASSES = (
    "os.windows.security os.windows.sysmon os.windows.powershell os.windows.defender os.windows.dns os.windows.rdp os.windows.kerberos "
    "os.macos.unified os.macos.launchd os.macos.endpoint os.linux.auditd os.linux.auth os.linux.sshd os.linux.sudo os.linux.journal os.linux.syslog "
    "os.solaris.audit os.generic web.access web.error db.log identity.log application.generic "
    "net.firewall net.ids net.dns net.dhcp net.flow net.vpn net.proxy cloud.audit cloud.flow cloud.iam container.runtime k8s.audit mainframe.smf mainframe.racf generic"
).split()


def _from_map(m: Column) -> dict[str, Column]:
    out = {}
    for name in COLUMNS:
        chain = _CHAINS.get(name, (name, *[k for k, v in ALIASES.items() if v == name]))
        out[name] = F.coalesce(*[F.nullif(F.element_at(m, k), F.lit("")) for k in chain])
    known = {k for c in COLUMNS for k in _CHAINS.get(c, (c, *[a for a, v in ALIASES.items() if v == c]))} - {"attributes"}
    rest = F.map_filter(m, lambda k, v: ~k.isin(*known, "attributes") & v.isNotNull())
    inner = F.from_json(F.element_at(m, "attributes"), "map<string,string>")
    out["attributes"] = F.to_json(F.map_concat(F.map_filter(F.coalesce(inner, F.create_map().cast("map<string,string>")), lambda k, _: ~F.array_contains(F.map_keys(rest), k)), rest))
    return out


def from_map(df: DataFrame, m: Column, raw: Column, kind: str) -> DataFrame:
    """Canonical events of string maps; a null map makes the raw text the message."""
    df = df.select(m.alias("__m"), raw.alias("__raw"))  # the map is parsed once
    m, raw = F.col("__m"), F.col("__raw")
    c = _from_map(m)
    c["message"] = F.coalesce(c["message"], F.when(m.isNull(), raw))
    c["timestamp"], c["received_at"] = parse_timestamp(c["timestamp"]), parse_timestamp(c["received_at"])
    c["severity"] = normalize_severity(c["severity"])
    c["raw"], c["raw_format"] = raw, F.lit(kind)
    c["id"] = F.coalesce(c["id"], F.sha2(raw, 256))
    return df.select(*[c[x].try_cast(KINDS[x]).alias(x) for x in COLUMNS])


def events_of_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Canonical events of JSON lines; a line that is no JSON object is a message."""
    x = F.col(column)
    return from_map(lines, F.from_json(F.when(x.rlike(r"^\s*\{"), x), "map<string,string>"), x, "json")


def read_events_json(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    return events_of_lines((spark.readStream if stream else spark.read).text(path))


def tail_events(spark: SparkSession, path: str) -> DataFrame:
    """New complete lines of a folder as a stream; what has been read is in the query's checkpoint."""
    return read_events_json(spark, path, stream=True)


def read_events_api(df: DataFrame, column: str = "value") -> DataFrame:
    """Bodies {"events": [...]} or one event each."""
    x = F.col(column)
    many = F.from_json(F.get_json_object(x, "$.events"), "array<string>")
    one = df.select(F.explode(F.coalesce(many, F.array(x))).alias("body"))
    return events_of_lines(one, "body")


def read_hec(df: DataFrame, column: str = "value") -> DataFrame:
    """HEC envelopes, several to a body where they follow each other."""
    x = F.col(column)
    b = F.col("body")
    parts = df.select(F.explode(F.split(x, r"(?<=\})\s*(?=\{\s*\")")).alias("body"))
    get = lambda k: F.get_json_object(b, f"$.{k}")
    event = get("event")
    m = F.from_json(F.when(event.startswith("{"), event), "map<string,string>")
    fields = F.from_json(get("fields"), "map<string,string>")
    empty = F.create_map().cast("map<string,string>")
    own = F.map_concat(F.coalesce(m, empty), F.map_filter(F.coalesce(fields, empty), lambda k, _: ~F.array_contains(F.map_keys(F.coalesce(m, empty)), k)))
    out = _from_map(own)
    out |= {
        "timestamp": F.coalesce(F.timestamp_micros((get("time").try_cast("double") * 1_000_000).cast("bigint")), parse_timestamp(get("time")), parse_timestamp(out["timestamp"])),
        "host": F.coalesce(get("host"), out["host"]), "source": F.coalesce(get("source"), out["source"]), "source_type": F.coalesce(get("sourcetype"), out["source_type"]), "service": F.coalesce(get("index"), out["service"]),
        "message": F.coalesce(out["message"], event, get("raw"), F.when(get("event").isNull(), b)), "severity": normalize_severity(out["severity"]), "raw": b, "raw_format": F.lit("hec"), "id": F.coalesce(out["id"], F.sha2(b, 256)),
    }
    return parts.select(*[out[x].try_cast(KINDS[x]).alias(x) for x in COLUMNS])


_ANY = "struct<stringValue:string,boolValue:string,intValue:string,doubleValue:string>"
_KV = f"array<struct<key:string,value:{_ANY}>>"
_OTLP = (
    f"struct<resourceLogs:array<struct<resource:struct<attributes:{_KV}>,scopeLogs:array<struct<scope:struct<name:string,version:string>,logRecords:array<struct<timeUnixNano:string,observedTimeUnixNano:string,"
    f"severityNumber:int,severityText:string,body:{_ANY},attributes:{_KV},traceId:string,spanId:string>>>>>>>"
)


def _any(v: Column) -> Column:
    return F.coalesce(v["stringValue"], v["boolValue"], v["intValue"], v["doubleValue"])


def _kv(a: Column, prefix: str = "") -> Column:
    none = F.array().cast("array<struct<key:string,value:string>>")
    return F.coalesce(F.transform(a, lambda x: F.struct(F.concat(F.lit(prefix), x["key"]).alias("key"), _any(x["value"]).alias("value"))), none)


def read_otlp_logs(df: DataFrame, column: str = "value") -> DataFrame:
    """OTLP JSON bodies: one event for each log record."""
    x = df.select(F.from_json(column, _OTLP).alias("b")).select(F.explode("b.resourceLogs").alias("r")).select("r.resource", F.explode("r.scopeLogs").alias("s")).select("resource", "s.scope", F.explode("s.logRecords").alias("l"))
    res = _kv(F.col("resource.attributes"))
    of = lambda k: F.get(F.filter(res, lambda e: e["key"] == k), F.lit(0))["value"]
    rest = F.filter(res, lambda e: ~e["key"].isin("service.name", "host.name"))
    more = F.transform(rest, lambda e: F.struct(F.concat(F.lit("resource."), e["key"]).alias("key"), e["value"].alias("value")))
    scope = F.filter(F.array(F.struct(F.lit("scope.name").alias("key"), F.col("scope.name").alias("value")), F.struct(F.lit("scope.version").alias("key"), F.col("scope.version").alias("value"))), lambda e: e["value"].isNotNull())
    every = F.concat(_kv(F.col("l.attributes")), more, scope)
    keys = F.array_distinct(F.transform(every, lambda e: e["key"]))
    attributes = F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.get(F.filter(every, lambda e: e["key"] == k), F.lit(0))["value"])))
    n = F.col("l.severityNumber")
    band = F.when(n.between(1, 8), "debug").when(n.between(9, 12), "info").when(n.between(13, 16), "warning").when(n.between(17, 20), "err").when(n >= 21, "critical").otherwise(normalize_severity(F.col("l.severityText")))
    nanos = F.coalesce(F.nullif(F.col("l.timeUnixNano"), F.lit("0")), F.col("l.observedTimeUnixNano")).try_cast("bigint")
    clean = lambda h: F.when(~h.rlike("^0*$"), F.lower(h))
    body = _any(F.col("l.body"))
    out = {
        "timestamp": F.timestamp_micros(F.floor(nanos / 1000).cast("bigint")), "service": of("service.name"), "host": of("host.name"), "severity": band, "message": body, "attributes": F.to_json(attributes),
        "trace_id": clean(F.col("l.traceId")), "span_id": clean(F.col("l.spanId")), "raw": F.to_json("l"), "raw_format": F.lit("otlp"), "id": F.sha2(F.concat(F.to_json("l"), F.coalesce(F.to_json("resource"), F.lit(""))), 256), "source_type": F.lit("otlp"),
    }
    return x.select(*[out.get(c, F.lit(None)).try_cast(KINDS[c]).alias(c) for c in COLUMNS])


def canonical_events(df: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """Canonical columns from ``mapping`` (column -> SQL) or columns of any known name; '' becomes null and received_at defaults to timestamp."""
    mapping = mapping or {}
    named = {ALIASES.get(x, x): x for x in reversed(df.columns)}
    out = []
    for name in COLUMNS:
        x = F.expr(mapping[name]) if name in mapping else F.col(named[name]) if name in named else F.lit(None)
        x = F.nullif(x.cast("string"), F.lit("")) if KINDS[name] == "string" else x
        out.append(x.cast(KINDS[name]).alias(name))
    out = df.select(*out)
    return out.withColumn("received_at", F.coalesce("received_at", "timestamp"))


def event_to_map(df: DataFrame) -> DataFrame:
    """id and a flat string map: the columns, and attributes as attr.<key>."""
    columns = [x for k in df.columns if k != "attributes" for x in (F.lit(k), F.col(k).cast("string"))]
    own = F.transform_keys(F.coalesce(F.from_json("attributes", "map<string,string>"), F.create_map().cast("map<string,string>")), lambda k, _: F.concat(F.lit("attr."), k))
    return df.select("id", F.map_filter(F.map_concat(F.create_map(*columns), own), lambda _, v: v.isNotNull()).alias("fields"))


def source_class(df: DataFrame) -> Column:
    """The event's own source_class where it is a known one, else generic."""
    x = F.get_json_object("attributes", "$['source_class']")
    return F.when(x.isin(*CLASSES), x).otherwise("generic")


def stamp_provenance(df: DataFrame, parser: str, version: str, collector: str, raw_format: str | None = None) -> DataFrame:
    """attributes with parser, parser_version and collector."""
    own = F.coalesce(F.from_json("attributes", "map<string,string>"), F.create_map().cast("map<string,string>"))
    keep = F.map_filter(own, lambda k, _: ~k.isin("parser", "parser_version", "collector"))
    stamp = F.create_map(F.lit("parser"), F.lit(parser), F.lit("parser_version"), F.lit(version), F.lit("collector"), F.lit(collector))
    df = df.withColumn("attributes", F.to_json(F.map_concat(keep, stamp)))
    return df.withColumn("raw_format", F.lit(raw_format)) if raw_format else df


def write_events(df: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet by day; a batch becomes visible as a whole."""
    df.withColumn("date", F.to_date("timestamp")).write.mode(mode).partitionBy("date").parquet(path)
