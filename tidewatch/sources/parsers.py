"""Log formats: each parser adds event columns to rows that hold one raw line in ``value``.

A parser's columns are null where a line is of another format, so parsers combine by ``coalesce``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import SEVERITIES, extract_groups, let, normalize_severity, parse_timestamp

# Severities by syslog code (0 is the worst) and facility names by code.
_CODES = tuple(reversed(SEVERITIES))
_FACILITIES = ("kern", "user", "mail", "daemon", "auth", "syslog", "lpr", "news", "uucp", "cron", "authpriv", "ftp", "ntp", "audit", "alert", "clock", "local0", "local1", "local2", "local3", "local4", "local5", "local6", "local7")

#: Columns of a parsed line; attributes is a map of what has no column.
PARSED = ("format", "timestamp", "host", "source", "process", "severity", "message", "event_type", "user", "source_ip", "source_port", "destination_ip", "destination_port", "attributes")

_R3164 = r"^<(\d{1,3})>([A-Z][a-z]{2}\s+\d{1,2} \d{2}:\d{2}:\d{2}) (\S+) ([^\s:\[]+)(?:\[(\d+)\])?:?\s*(.*)$"


def _group(x: Column, pattern: str, i: int) -> Column:
    """A group where the pattern matches and the group holds more than a dash."""
    return F.when(x.rlike(pattern), F.nullif(F.nullif(F.regexp_extract(x, pattern, i), F.lit("")), F.lit("-")))


def _at(names, code: Column) -> Column:
    return F.get(F.array(*map(F.lit, names)), code)


def pri_severity(pri: Column) -> Column:
    return _at(_CODES, pri.cast("int") % 8)


def pri_facility(pri: Column) -> Column:
    return _at(_FACILITIES, F.floor(pri.cast("int") / 8).cast("int"))


def _strings(**columns: Column) -> Column:
    """A map of the columns that are not null."""
    pairs = [x for k, v in columns.items() for x in (F.lit(k), v.cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def _struct(ok: Column, **columns) -> Column:
    """The parsed columns as a struct, null where ``ok`` does not hold."""
    kinds = {"timestamp": "timestamp", "source_port": "int", "destination_port": "int", "attributes": "map<string,string>"}
    out = [columns.get(k, F.lit(None)).cast(kinds.get(k, "string")).alias(k) for k in PARSED]
    return F.when(F.coalesce(ok, F.lit(False)), F.struct(*out))


def syslog3164(x: Column, year: int) -> Column:
    ok = x.rlike(_R3164)
    pri = _group(x, _R3164, 1)
    stamp = F.regexp_replace(_group(x, _R3164, 2), r"\s+", " ")
    when = F.try_to_timestamp(F.concat(F.lit(f"{year} "), stamp), F.lit("yyyy MMM d HH:mm:ss"))
    attributes = _strings(facility=pri_facility(pri), pid=_group(x, _R3164, 5))
    return _struct(ok, format=F.lit("syslog3164"), timestamp=when, host=_group(x, _R3164, 3), process=_group(x, _R3164, 4), severity=pri_severity(pri), message=_group(x, _R3164, 6), attributes=attributes)


def _unescaped(x: Column, pattern: str = r"\\(.)") -> Column:
    return F.regexp_replace(x, pattern, "$1")


_ELEMENT = r'\[((?:[^\]\\"]|\\.|"(?:[^"\\]|\\.)*")*)\]'


def _sd_pairs(e: Column) -> Column:
    """sd.<id>.<key> and values of one element of structured data."""
    name = F.regexp_extract(e, r"^(\S+)", 1)
    keys = F.regexp_extract_all(e, F.lit(r'([^\s="]+)="(?:[^"\\]|\\.)*"'), 1)
    values = F.regexp_extract_all(e, F.lit(r'[^\s="]+="((?:[^"\\]|\\.)*)"'), 1)
    return let(name, lambda n: F.zip_with(keys, values, lambda k, v: F.struct(F.concat(F.lit("sd."), n, F.lit("."), k).alias("k"), _unescaped(v).alias("v"))))


def syslog5424(x: Column) -> Column:
    """Structured data becomes sd.<id>.<key>, of a repeated key the first value; the first id is sdid."""

    def given(v: Column) -> Column:
        return F.nullif(F.nullif(v, F.lit("")), F.lit("-"))

    def event(part: Column) -> Column:
        rest = F.get(part, F.lit(6))
        return let(F.regexp_extract(rest, "^((?:" + _ELEMENT.replace("(", "(?:", 1) + ")+)", 1), lambda data: described(part, rest, data))

    def described(part: Column, rest: Column, data: Column) -> Column:
        message = F.when(data == "", F.regexp_replace(rest, r"^-\s?", "")).otherwise(F.regexp_replace(rest.substr(F.length(data) + 1, F.length(rest)), r"^\s", ""))
        return let(F.regexp_extract_all(data, F.lit(_ELEMENT), 1), lambda elements: whole(part, message, elements))

    def whole(part: Column, message: Column, elements: Column) -> Column:
        pri = F.regexp_extract(F.get(part, F.lit(0)), r"^<(\d{1,3})>", 1)
        sd = let(F.flatten(F.transform(elements, lambda e: _sd_pairs(e))), lambda z: _pairs(F.transform(z, lambda e: e["k"]), F.transform(z, lambda e: e["v"])))
        extra = _strings(facility=pri_facility(pri), pid=given(F.get(part, F.lit(4))), msgid=given(F.get(part, F.lit(5))), sdid=F.nullif(F.regexp_extract(F.get(elements, F.lit(0)), r"^(\S+)", 1), F.lit("")))
        return _struct(F.lit(True), format=F.lit("syslog5424"), timestamp=parse_timestamp(given(F.get(part, F.lit(1)))), host=given(F.get(part, F.lit(2))), process=given(F.get(part, F.lit(3))), severity=pri_severity(pri), message=given(message), attributes=F.map_concat(extra, sd))

    return F.when(x.rlike(r"^<\d{1,3}>\d{1,2} \S+ \S+ \S+ \S+ \S+ (-|\[)"), let(F.split(x, " ", 7), event))


_CEF = r"CEF:\d+\|"


_PAIR = r"(?:^|\s)([A-Za-z0-9_.\-]+)=((?:\\=|(?!\s+[A-Za-z0-9_.\-]+=).)*)"


def _pairs(keys: Column, values: Column) -> Column:
    """A map of keys and values; of a repeated key the first value."""
    return let(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda z: F.map_from_entries(F.filter(F.transform(z, lambda e: F.struct(e["k"], e["v"])), lambda e, i: F.array_position(F.transform(z, lambda o: o["k"]), e["k"]) == i + 1)))


def _of(m: Column, *keys: str) -> Column:
    """The first of the keys that a map has, without blanks around it; an empty value is none."""
    return F.coalesce(*[F.nullif(F.trim(F.try_element_at(m, F.lit(k))), F.lit("")) for k in keys])


def cef(x: Column) -> Column:
    """Eight header parts at bars that no backslash guards; the extension is key=value with values up to the next key."""
    ok = x.rlike("^" + _CEF)

    def body(part: Column) -> Column:
        ext = F.coalesce(F.get(part, F.lit(7)), F.lit(""))
        # The pairs are found once, and cut at their first equals sign.
        key = lambda p: F.btrim(F.substring_index(p, "=", 1), F.lit(" \t\n\x0b\f\r"))
        value = lambda p: _unescaped(F.substring(p, F.locate("=", p) + 1, F.length(p)))
        m = let(F.regexp_extract_all(ext, F.lit(_PAIR), 0), lambda z: _pairs(F.transform(z, key), F.transform(z, value)))
        return let(m, lambda m: event(part, m))

    def event(part: Column, m: Column) -> Column:
        h = [_unescaped(F.get(part, F.lit(i))) for i in range(7)]
        n = F.trim(h[6]).try_cast("int")
        band = F.when(n.isNull(), normalize_severity(h[6])).when(n < 1, "debug").when(n < 4, "notice").when(n < 6, "warning").when(n < 8, "err").otherwise("critical")
        promoted = ("rt", "src", "dst", "spt", "dpt", "suser", "dvchost", "dhost")
        attributes = F.map_concat(F.map_filter(m, lambda k, _: ~k.isin(*promoted, "device_vendor", "device_product", "device_version", "signature_id")), _strings(device_vendor=h[1], device_product=h[2], device_version=h[3], signature_id=h[4]))
        rt = _of(m, "rt")
        when = F.when(rt.isNotNull(), F.coalesce(F.when(rt.rlike(r"^\d{13}$"), F.timestamp_micros(rt.try_cast("bigint") * 1000)), parse_timestamp(rt)))
        return _struct(F.lit(True), format=F.lit("cef"), timestamp=when, host=_of(m, "dvchost", "dhost"), source=F.concat_ws(" ", h[1], h[2]), severity=band, message=h[5], event_type=h[4], user=_of(m, "suser"),
                       source_ip=_of(m, "src"), source_port=_of(m, "spt").try_cast("int"), destination_ip=_of(m, "dst"), destination_port=_of(m, "dpt").try_cast("int"), attributes=attributes)

    return F.when(ok, let(F.split(x, r"(?<!\\)\|", 8), body))


def leef(x: Column) -> Column:
    r"""Pairs between bare exclamation marks; a backslash guards !, \ and =."""
    body = F.regexp_extract(x, r"^LEEF:\S+\s+(.*)$", 1)
    pairs = F.filter(F.split(body, r"(?<!\\)!"), lambda p: p.rlike(r"^[^=]+="))
    m = let(pairs, lambda z: _pairs(F.transform(z, lambda p: F.trim(F.regexp_extract(p, r"^([^=]+)=", 1))), F.transform(z, lambda p: _unescaped(F.regexp_replace(p, r"^[^=]+=", "")))))
    promoted = ("hostname", "username", "timestamp", "severity", "src", "dst", "srcport", "dstport", "eventid", "message", "msg")

    def event(m: Column) -> Column:
        return _struct(F.lit(True), format=F.lit("leef"), timestamp=parse_timestamp(_of(m, "timestamp", "devtime")), host=_of(m, "hostname", "host"), user=_of(m, "username", "usrname"), severity=normalize_severity(_of(m, "severity", "sev")),
                       message=F.coalesce(_of(m, "message", "msg"), body), event_type=_of(m, "eventid"), source_ip=_of(m, "src"), destination_ip=_of(m, "dst"), source_port=_of(m, "srcport").try_cast("int"), destination_port=_of(m, "dstport").try_cast("int"),
                       attributes=F.map_filter(m, lambda k, _: ~k.isin(*promoted)))

    return F.when(x.rlike(r"^LEEF:"), let(m, event))


def _json_map(x: Column) -> Column:
    return F.from_json(F.when(x.rlike(r"^\s*\{"), x), "map<string,string>")


def gelf(x: Column) -> Column:
    """JSON with version 1.x and a key of the format; _name becomes the attribute name."""

    def event(m: Column) -> Column:
        has = F.exists(F.map_keys(m), lambda k: k.isin("short_message", "full_message", "host", "level", "facility") | k.startswith("_"))
        own = F.transform_keys(F.map_filter(m, lambda k, v: k.startswith("_") & v.isNotNull() & ~k.isin("_source", "_id")), lambda k, _: k.substr(F.lit(2), F.length(k)))
        level = _of(m, "level").try_cast("int")
        return _struct(_of(m, "version").rlike(r"^1\.") & has, format=F.lit("gelf"), timestamp=parse_timestamp(_of(m, "timestamp")), host=_of(m, "host"), source=_of(m, "_source"), severity=F.coalesce(_at(_CODES, level), normalize_severity(_of(m, "level"))),
                       message=F.coalesce(_of(m, "short_message"), _of(m, "full_message")), attributes=own)

    return let(_json_map(x), event)


def regex(x: Column, pattern: str) -> Column:
    """Named groups as attributes; without a match the line is the message alone."""
    java, names = extract_groups(pattern)
    groups = {n: F.when(x.rlike(java), F.regexp_extract(x, java, i)) for i, n in enumerate(names, 1) if n}
    return _struct(F.lit(True), format=F.lit("regex"), message=x, attributes=_strings(**groups))


def plain(x: Column) -> Column:
    return _struct(x.isNotNull(), format=F.lit("plain"), message=x, severity=F.lit("info"))


def auto(x: Column, year: int) -> Column:
    """The first format that fits; CEF inside a syslog message is read for what it is, with the syslog host."""
    inside = F.regexp_extract(x, r"(CEF:\d+\|.*)$", 1)
    nested = F.when(x.rlike("^<") & x.rlike(_CEF), cef(inside))

    def joined(n: Column) -> Column:
        """CEF in syslog: what it leaves open comes from around it."""
        return F.when(n.isNotNull(), let(F.coalesce(syslog5424(x), syslog3164(x, year)), lambda o: n.withField("host", F.coalesce(n["host"], o["host"])).withField("timestamp", F.coalesce(n["timestamp"], o["timestamp"]))))

    return F.coalesce(cef(x), leef(x), let(nested, joined), gelf(x), syslog5424(x), syslog3164(x, year), plain(x))


def parse(df: DataFrame, kind: str, column: str = "value", **how) -> DataFrame:
    """Rows with the columns of format ``kind`` (auto, cef, leef, gelf, syslog3164, syslog5424, regex, plain); other rows get nulls."""
    maker = {"auto": auto, "cef": cef, "leef": leef, "gelf": gelf, "syslog3164": syslog3164, "syslog5424": syslog5424, "regex": regex, "plain": plain}[kind]
    out = df.withColumn("__p", maker(F.col(column), **how))
    return out.select(*df.columns, "__p.*")
