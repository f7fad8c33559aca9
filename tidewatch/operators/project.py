"""Projections and row transforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import bucket_start, extract_groups, span_seconds
from .filters import ALIASES, field

DEFAULT_COLUMNS = ("id", "timestamp", "source", "severity", "event_type", "host", "message")

# Fixed patterns of what is struck out, in order: label and expression.
REDACTIONS = (
    ("password", r"""(?i)\b(password|passwd|pwd|passphrase)\b(\s*[=:]\s*)?[^\s"',;)]{4,}"""),
    ("token", r"""(?i)\b(api[_-]?key|apikey|secret|access[_-]?token|auth[_-]?token|client[_-]?secret)\b(\s*[=:]\s*)?[^\s"',;)]{8,}"""),
    ("token", r"(?i)\b(bearer|basic)\s+[a-z0-9+/._=-]{16,}"),
    ("token", r"\b(?:AKIA|ASIA|AGPA|AIDA|AROA|ANPA|ANVA)[0-9A-Z]{16}\b"),
    ("cookie", r"(?i)\b(set-cookie|cookie)\s*:\s*[^\n;,]{4,}"),
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b"),
)


def table(df: DataFrame, *columns: str) -> DataFrame:
    """The columns in that order; one that is neither a column nor an attribute is null."""
    return df.select(*[field(df, x).alias(x) for x in columns])


def fields(df: DataFrame, *columns: str, include: bool = True) -> DataFrame:
    """Keep some columns, or drop some of the default ones."""
    if include:
        return table(df, *columns)
    gone = {ALIASES.get(x, x) for x in columns}
    return df.select(*[x for x in DEFAULT_COLUMNS if x in df.columns and x not in gone])


def default_columns(df: DataFrame) -> DataFrame:
    return df.select(*DEFAULT_COLUMNS)


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    lower = {x.lower(): x for x in df.columns}
    return df.withColumnsRenamed({lower[k.lower()]: v for k, v in names.items() if k.lower() in lower})


def eval_(df: DataFrame, **columns: Column) -> DataFrame:
    """Computed columns, one after the other."""
    for name, value in columns.items():
        df = df.withColumn(name, value)
    return df


def rex(df: DataFrame, pattern: str, name: str | None = None, rename: str | None = None, mode: str = "single") -> DataFrame:
    """Named groups as columns: null without a match, arrays of all matches with mode 'multimatch'.

    Without a field, raw is read where it holds anything and message otherwise; ``rename`` names the first group.
    """
    java, names = extract_groups(pattern)
    if name is None:
        name = F.coalesce(F.nullif(field(df, "raw"), F.lit("")), F.col("message"))
    x = field(df, name) if isinstance(name, str) else name
    if rename and names:
        names[next(i for i, n in enumerate(names) if n)] = rename
    for i, n in enumerate(names, 1):
        if n:
            got = F.regexp_extract_all(x, F.lit(java), i) if mode == "multimatch" else F.when(x.rlike(java), F.regexp_extract(x, java, i))
            df = df.withColumn(n, got)
    return df


def attributes_to_columns(df: DataFrame, keys: list[str]) -> DataFrame:
    """JSON attributes as columns; real columns of the same name win."""
    return df.withColumns({k: F.get_json_object("attributes", f"$['{k}']") for k in keys if k not in df.columns})


def bin_(df: DataFrame, name: str, span, out: str | None = None) -> DataFrame:
    """Floor of a number or a time to a multiple of ``span``."""
    kind = dict(df.dtypes)[name]
    if kind.startswith("timestamp"):
        return df.withColumn(out or name, bucket_start(name, span_seconds(span)))
    return df.withColumn(out or name, F.floor(F.col(name) / span) * span)


def redact(df: DataFrame, columns: list[str]) -> DataFrame:
    """Secrets struck out of ``columns`` by one pattern after another; ``redactions`` lists the kinds found, in that order."""
    hits = []
    for n, (label, p) in enumerate(REDACTIONS):
        for x in columns:
            hits.append(f"__hit{n}_{x}")
            df = df.withColumn(hits[-1], F.when(F.col(x).rlike(p), F.lit(label)))
            df = df.withColumn(x, F.regexp_replace(x, p, f"[REDACTED:{label}]"))
    return df.withColumn("redactions", F.array_distinct(F.array_compact(F.array(*hits)))).drop(*hits)


def truncate_message(df: DataFrame, n: int, column: str = "message") -> DataFrame:
    return df.withColumn(column, F.substring(column, 1, n))
