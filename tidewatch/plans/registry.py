"""Registration of queries with their SQL."""

from __future__ import annotations

from . import canonical as k

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = (k.EV,)):
    """Register a function (spark, sf_dir) -> DataFrame; ``sql`` is a SELECT over ``views``, or a whole statement with WITH."""

    def add(f):
        assert name not in QUERIES, name
        QUERIES[name] = f
        if sql:
            body = sql.strip()
            ORACLE[name] = body if body.upper().startswith("WITH RECURSIVE") else "WITH " + ",\n".join(views) + (",\n" + body[4:].lstrip() if body.upper().startswith("WITH") else "\n" + body)
        return f

    return add


def events_query(name: str, sql: str | None = None, views: tuple[str, ...] = (k.EV,)):
    """Register a function of the canonical events alone."""

    def add(f):
        query(name, sql, views)(lambda spark, sf_dir: f(k.events(spark, sf_dir)))
        return f

    return add
