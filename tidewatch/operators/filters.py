"""Filters: field tests with aliases and JSON attributes, text search, time ranges, entity filters."""

from __future__ import annotations

import re
from datetime import datetime, timedelta
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import blank, span_seconds

# Other names of canonical fields.
ALIASES = {
    "time": "timestamp", "_time": "timestamp", "sourcetype": "source_type", "sev": "severity", "level": "severity", "username": "user", "src_ip": "source_ip",
    "src": "source_ip", "dest_ip": "destination_ip", "dst_ip": "destination_ip", "dst": "destination_ip", "dest_port": "destination_port", "dst_port": "destination_port", "src_port": "source_port", "hostname": "host", "msg": "message",
}


def field(df: DataFrame, name: str) -> Column:
    """A canonical column by any of its names, else the JSON attribute of that name (null where it is absent)."""
    key = ALIASES.get(name, name)
    if key in df.columns:
        return F.col(key)
    if "attributes" in df.columns and re.fullmatch(r"[A-Za-z0-9_\-]+", name):
        return F.get_json_object("attributes", f"$['{name}']")
    return F.lit(None).cast("string")


def is_attribute(df: DataFrame, name: str) -> bool:
    return ALIASES.get(name, name) not in df.columns


def search(df: DataFrame, **equal) -> DataFrame:
    return df.where(reduce(and_, [field(df, k) == F.lit(v) for k, v in equal.items()], F.lit(True)))


def compare(df: DataFrame, name: str, op: str, value) -> Column:
    """A test as a column: equality on the text form of attributes, order on their numbers."""
    x = field(df, name)
    if op in ("=", "!="):
        same = x.cast("string") == F.lit(str(value)) if is_attribute(df, name) else x == F.lit(value)
        return same if op == "=" else ~same
    if is_attribute(df, name):
        x = x.try_cast("double")
    return {"<": x < value, "<=": x <= value, ">": x > value, ">=": x >= value}[op]


def any_of(*tests: Column) -> Column:
    return reduce(or_, tests)


def all_of(*tests: Column) -> Column:
    return reduce(and_, tests)


def in_list(df: DataFrame, name: str, values: list, negate: bool = False) -> Column:
    """An empty list holds nothing."""
    test = field(df, name).isin(*values) if values else F.lit(False)
    return ~test if negate else test


def like(df: DataFrame, name: str, pattern: str) -> Column:
    return field(df, name).ilike(pattern)


def is_null(df: DataFrame, name: str) -> Column:
    return blank(field(df, name))


def is_not_null(df: DataFrame, name: str) -> Column:
    return ~is_null(df, name)


def tokens(*columns: str) -> Column:
    """Folded words of some columns."""
    return F.split(F.lower(F.concat_ws(" ", *columns)), r"[^\p{L}\p{N}]+")


def text_search(df: DataFrame, terms: str, columns: tuple[str, ...] = ("message", "attributes")) -> DataFrame:
    """Rows that hold all terms as whole words; a term of several words holds as a phrase, and '*' alone matches all."""
    low = F.lower(F.concat_ws(" ", *[x for x in columns if x in df.columns]))
    held, whole = [], []
    for term in terms.split():
        words = [w for w in re.split(r"[^\w]|_", term.lower()) if w]
        if words:
            # Plain substrings rule out most rows before a pattern is looked for.
            held += [low.contains(w) for w in words]
            whole.append(low.rlike(rf"(?<![\p{{L}}\p{{N}}]){r'[^\p{L}\p{N}]+'.join(words)}(?![\p{{L}}\p{{N}}])"))
    return df.where(reduce(and_, [*held, *whole], F.lit(True)))


def index_filter(df: DataFrame, value: str, negate: bool = False) -> DataFrame:
    tests = [F.coalesce(field(df, k) == value, F.lit(False)) for k in ("source_type", "source", "index")]
    test = reduce(or_, tests)
    return df.where(~test if negate else test)


def time_bound(value, now: datetime, end: bool = False) -> datetime | None:
    """Absolute times, epoch seconds, now, today, yesterday, and 24h, -7d, 1h30m before ``now``."""
    if value is None or isinstance(value, datetime):
        return value
    s = str(value).strip().lower()
    day = now.replace(hour=0, minute=0, second=0, microsecond=0)
    if s in ("", "now"):
        return now if s else None
    if s in ("today", "yesterday"):
        day -= timedelta(days=s == "yesterday")
        return min(day + timedelta(days=1), now) if end else day
    if re.fullmatch(r"\d{9,}(\.\d+)?", s):
        return datetime(1970, 1, 1) + timedelta(seconds=float(s))
    if re.fullmatch(r"-?(\d+[smhdw])+", s):
        return now - timedelta(seconds=span_seconds(s.lstrip("-")))
    return datetime.fromisoformat(str(value).strip())


def time_range(df: DataFrame, earliest=None, latest=None, now: datetime | None = None, column: str = "timestamp") -> DataFrame:
    """Both ends included; ``earliest`` may hold both, parted by a comma.  Relative bounds need ``now``."""
    if isinstance(earliest, str) and "," in earliest:
        earliest, latest = earliest.split(",", 1)
    lo, hi = time_bound(earliest, now), time_bound(latest, now, end=True)
    if lo is not None:
        df = df.where(F.col(column) >= F.lit(lo).cast("timestamp_ntz"))
    return df if hi is None else df.where(F.col(column) <= F.lit(hi).cast("timestamp_ntz"))


def or_values(df: DataFrame, values: dict[str, list]) -> DataFrame:
    """Each field holds one of its values."""
    return df.where(reduce(and_, [in_list(df, k, v) for k, v in values.items()], F.lit(True)))


def filter_events(df: DataFrame, equal: dict | None = None, text: str = "", start=None, end=None, attributes: dict | None = None, sort: str = "-timestamp", limit: int | None = None, offset: int = 0) -> DataFrame:
    """The structured event filter: equalities, text, time range, attributes, order and page."""
    df = search(df, **(equal or {}))
    if text:
        df = text_search(df, text)
    df = time_range(df, start, end)
    for k, v in (attributes or {}).items():
        df = df.where(F.get_json_object("attributes", f"$['{k}']") == str(v))
    key = F.col(ALIASES.get(sort.lstrip("-"), sort.lstrip("-")))
    df = df.orderBy(key.desc() if sort.startswith("-") else key, F.col("id"))
    df = df.offset(offset) if offset else df
    return df.limit(limit) if limit is not None else df


def where_agg(df: DataFrame, test: Column | str) -> DataFrame:
    return df.where(test)


def predicate(df: DataFrame, wanted: dict[str, str]) -> Column:
    """All pairs equal without regard to case; source_type falls back to source; no pairs match all."""
    tests = []
    for k, v in wanted.items():
        x = F.coalesce(F.nullif(field(df, "source_type"), F.lit("")), field(df, "source")) if k == "source_type" else field(df, k)
        tests.append(F.coalesce(F.lower(x.cast("string")) == str(v).lower(), F.lit(False)))
    return reduce(and_, tests, F.lit(True))


def predicate_match(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    return df.where(predicate(df, wanted))


def entity_or_filter(df: DataFrame, users=(), hosts=(), ips=(), start=None, end=None) -> DataFrame:
    """Events in a window that touch any of the users, hosts or addresses."""
    tests = [F.col("user").isin(*users)] if users else []
    tests += [F.col("host").isin(*hosts)] if hosts else []
    tests += [F.col("source_ip").isin(*ips), F.col("destination_ip").isin(*ips)] if ips else []
    return time_range(df, start, end).where(reduce(or_, [F.coalesce(t, F.lit(False)) for t in tests], F.lit(False)))
