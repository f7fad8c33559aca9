"""All registered queries of the event-analytics operators and their SQL, and the flagship query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import filters, stats
from . import basic, canonical, security, streams, threats  # noqa: F401  registers
from .registry import ORACLE, QUERIES, query


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed sign-ins per source address and user, at least two, the ten largest."""
    e = filters.search(canonical.events(spark, sf_dir), event_type="authentication", outcome="failure")
    out = stats.stats(e, ["count"], ["source_ip", "user"])
    return filters.where_agg(out, "count >= 2").orderBy(F.desc("count"), "source_ip", "user").limit(10)


query("entry_failed_logins", "SELECT count(*) AS count, source_ip, \"user\" FROM ev WHERE event_type = 'authentication' AND outcome = 'failure' GROUP BY 2, 3 HAVING count(*) >= 2 ORDER BY 1 DESC, 2, 3 LIMIT 10")(entry)

__all__ = ["ORACLE", "QUERIES", "entry"]
