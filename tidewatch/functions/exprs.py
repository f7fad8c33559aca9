"""Scalar functions over columns: conversions, text, arithmetic, severities, normal forms of entities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severity names and what folds into them, most severe last.
SEVERITIES = ("debug", "info", "notice", "warning", "err", "critical", "alert", "emergency")
_SEVERITY = {
    "debug": ("debug", "trace", "0"), "info": ("info", "informational", "information", "1"), "notice": ("notice", "2"),
    "warning": ("warning", "warn", "3"), "err": ("err", "error", "4"), "critical": ("critical", "crit", "5", "fatal"),
    "alert": ("alert", "6"), "emergency": ("emergency", "emerg", "panic", "7"),
}
_SOC = {"critical": ("critical", "emergency", "alert"), "high": ("high", "err", "error"), "low": ("low", "info", "debug", "")}
BLOCKED = ("deny", "denied", "block", "blocked", "failure", "failed", "fail")
TIME_FORMATS = (
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSSSSSXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ssXX",
    "yyyy-MM-dd'T'HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd HH:mm:ssXXX",
    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy/MM/dd HH:mm:ss", "dd/MMM/yyyy:HH:mm:ss XX", "dd MMM yyyy HH:mm:ss XX", "MMM d yyyy HH:mm:ss",
)


def c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once for each row, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blank(x) -> Column:
    """Null or the empty string."""
    x = c(x)
    return x.isNull() | (x.cast("string") == "")


def truthy(x) -> Column:
    """False for null, '', false, 0 and no."""
    return ~(blank(x) | F.lower(c(x).cast("string")).isin("false", "0", "0.0", "no"))


def if_(cond: Column, a, b) -> Column:
    return F.when(cond, a).otherwise(b)


def case_(*pairs) -> Column:
    """case_(cond, value, cond, value, ...): the first that holds, else null."""
    out = F.when(pairs[0], pairs[1])
    for i in range(2, len(pairs), 2):
        out = out.when(pairs[i], pairs[i + 1])
    return out


def coalesce_(*xs) -> Column:
    """The first neither null nor empty, as text; '' if there is none."""
    return F.coalesce(*[F.nullif(c(x).cast("string"), F.lit("")) for x in xs], F.lit(""))


def len_(s) -> Column:
    return F.octet_length(c(s))


def substr(s, start: int, length: int | None = None) -> Column:
    """From 0; beyond the end it is empty."""
    s, at = c(s), max(start, 0) + 1
    return F.substring(s, at, length) if length is not None else s.substr(F.lit(at), F.length(s))


def replace(s, old: str, new: str) -> Column:
    return F.replace(c(s), F.lit(old), F.lit(new))


def tonumber(s) -> Column:
    return F.trim(c(s).cast("string")).try_cast("double")


def tostring(x, kind: str | None = None) -> Column:
    return F.lower(F.hex(c(x).cast("bigint"))) if kind == "hex" else c(x).cast("string")


def max_(*xs) -> Column:
    return F.greatest(*[F.coalesce(tonumber(x), F.lit(0.0)) for x in xs]) if len(xs) > 1 else F.coalesce(tonumber(xs[0]), F.lit(0.0)) if xs else F.lit(None).cast("double")


def min_(*xs) -> Column:
    return F.least(*[F.coalesce(tonumber(x), F.lit(0.0)) for x in xs]) if len(xs) > 1 else F.coalesce(tonumber(xs[0]), F.lit(0.0)) if xs else F.lit(None).cast("double")


def plus(a, b) -> Column:
    """Joins two texts that are both no numbers, else adds."""
    x, y = tonumber(a), tonumber(b)
    return F.when(x.isNull() & y.isNull(), F.concat(c(a).cast("string"), c(b).cast("string"))).otherwise((F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0))).cast("string"))


def divide(a, b) -> Column:
    return F.when(c(b) == 0, F.lit(0.0)).otherwise(F.try_divide(c(a).cast("double"), c(b).cast("double")))


def modulo(a, b) -> Column:
    x, y = c(a).cast("bigint"), c(b).cast("bigint")
    return F.when(y == 0, F.lit(0).cast("bigint")).otherwise(F.try_mod(x, y))


def md5(s) -> Column:
    return F.md5(c(s))


def sha1(s) -> Column:
    return F.sha1(c(s))


def sha256(s) -> Column:
    return F.sha2(c(s), 256)


def sha512(s) -> Column:
    return F.sha2(c(s), 512)


def urldecode(s) -> Column:
    return F.try_url_decode(c(s))


def spath(json, path: str) -> Column:
    return F.get_json_object(c(json), "$." + path)


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    a, b, p, q = (F.radians(c(x)) for x in (lat1, lat2, lon1, lon2))
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((q - p) / 2), 2)
    return 2 * 6371.0 * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def normalize_severity(s) -> Column:
    """One of the eight names; unknown and null are info."""
    s = F.lower(F.trim(c(s)))
    out = reduce(lambda w, kv: w.when(s.isin(*kv[1]), kv[0]), _SEVERITY.items(), F)
    return out.otherwise("info")


def soc_severity(s) -> Column:
    """critical, high, medium or low; null and empty are low, any other name medium."""
    s = F.coalesce(F.lower(F.trim(c(s))), F.lit(""))
    return reduce(lambda w, kv: w.when(s.isin(*kv[1]), kv[0]), _SOC.items(), F).otherwise("medium")


def severity_rank(s) -> Column:
    s = normalize_severity(s)
    return reduce(lambda w, iv: w.when(s == iv[1], iv[0]), enumerate(SEVERITIES), F).otherwise(1)


def parse_timestamp(s) -> Column:
    """The first of the known layouts that fits, then Unix seconds, else null."""
    t = F.regexp_replace(F.trim(c(s).cast("string")), "^[A-Z][a-z]{2}, ", "")  # a weekday says nothing new
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in TIME_FORMATS], F.timestamp_micros((t.try_cast("double") * 1_000_000).cast("bigint")))


def is_blocked_outcome(o) -> Column:
    return F.coalesce(F.lower(F.trim(c(o))).isin(*BLOCKED), F.lit(False))


def normalize_user(u) -> Column:
    """Lower case without a domain before a backslash or after an at sign."""
    return F.lower(F.substring_index(F.substring_index(F.trim(c(u)), "\\", -1), "@", 1))


def normalize_host(h) -> Column:
    return F.upper(F.rtrim(F.trim(c(h))))


def normalize_domain(d) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(c(d)), r":\d+$", ""), r"\.+$", ""))


def normalize_url(u) -> Column:
    """The scheme and host in lower case, the rest as it is."""
    u = F.trim(c(u))
    head = F.regexp_extract(u, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    return F.concat(F.lower(head), u.substr(F.length(head) + 1, F.length(u)))


def normalize_process(p) -> Column:
    """The file name of a path of either kind."""
    return F.regexp_replace(F.trim(c(p)), r"^.*[/\\]", "")


def normalize_hash(h) -> Column:
    """Lower-case hex of 32, 40 or 64 digits, else null."""
    h = F.lower(F.regexp_replace(F.trim(c(h)), r"^(?i)(md5|sha1|sha256):", ""))
    return F.when(h.rlike(r"^([0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$"), h)


def normalize_email(e) -> Column:
    return F.lower(F.trim(c(e)))


def normalize_indicator(kind, value) -> Column:
    k, v = F.lower(c(kind)), F.trim(c(value))
    hashed = F.lower(F.regexp_replace(v, r"^(?i)(md5|sha1|sha256):", ""))
    return F.when(k == "url", normalize_url(v)).when(k.isin("hash", "md5", "sha1", "sha256"), hashed).when(k.isin("domain", "hostname"), F.lower(F.regexp_replace(v, r"^\.+|\.+$", ""))).otherwise(F.lower(v))


def extract_ipv4(text) -> Column:
    """Valid dotted quads in free text, in order of appearance and without repeats."""
    found = F.regexp_extract_all(c(text), F.lit(r"(?<![0-9.])(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})(?![0-9.])"), 1)
    return F.array_distinct(F.filter(found, lambda x: F.forall(F.split(x, "\\."), lambda o: o.cast("int") <= 255)))


def stable_id(prefix: str, *xs) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *[c(x).cast("string") for x in xs]), 256), 1, 8))


def extract_groups(pattern: str) -> tuple[str, list[str]]:
    """A pattern with named groups rewritten for Java (names lost), and the names in group order ('' for unnamed groups)."""
    import re

    names, out, i, depth = [], [], 0, False
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            out.append(pattern[i : i + 2])
            i += 2
            continue
        if ch == "[":
            depth = True
        elif ch == "]":
            depth = False
        if ch == "(" and not depth:
            m = re.match(r"\(\?P?<([A-Za-z_]\w*)>", pattern[i:])
            if m:
                names.append(m[1])
                out.append("(")
                i += m.end()
                continue
            if not pattern.startswith("(?", i):
                names.append("")
        out.append(ch)
        i += 1
    return "".join(out), names


def bucket_start(ts, seconds: int) -> Column:
    """Start of the bucket of ``seconds`` that holds a time, counted from the epoch; keeps timestamp_ntz as it is."""
    s = F.unix_micros(c(ts).cast("timestamp"))
    return F.timestamp_micros(F.floor(s / (seconds * 1_000_000)).cast("bigint") * F.lit(seconds * 1_000_000)).cast("timestamp_ntz")


def span_seconds(span) -> int:
    """Seconds of 5m, 1h30m, 2w, 300."""
    import re

    if isinstance(span, (int, float)):
        return int(span)
    if re.fullmatch(r"\d+", span):
        return int(span)
    units = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}
    parts = re.findall(r"(\d+)([smhdw])", span)
    if not parts or "".join(a + b for a, b in parts) != span:
        raise ValueError(f"not a span: {span!r}")
    return sum(int(a) * units[b] for a, b in parts)
