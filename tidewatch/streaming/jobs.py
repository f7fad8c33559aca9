"""Structured Streaming forms of the detections: event time, watermarks and managed state.

Streams carry ``timestamp`` as a timestamp.  A run with ``run_available`` gives the rows
that the batch operators give, of windows and sessions those that the watermark has closed: later ones are still open when the input ends.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import span_seconds
from ..operators import findings as fd
from ..operators.ordered import positioned, running
from ..scratch import exists, removed
from .keyed import stream_correlation, stream_novelty, stream_sequence, with_timers  # noqa: F401  streams of this module too


def stream_threshold(sdf: DataFrame, test: Column, count: int, window, by: list[str], slide=None, late="10 minutes") -> DataFrame:
    w = F.window("timestamp", f"{span_seconds(window)} seconds", f"{span_seconds(slide)} seconds" if slide else None)
    out = sdf.where(test).withWatermark("timestamp", late).groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= count)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n")


def stream_sessions(sdf: DataFrame, key: str, gap, late="10 minutes") -> DataFrame:
    """Episodes of activity that end after ``gap`` of quiet."""
    out = sdf.withWatermark("timestamp", late).groupBy(F.session_window("timestamp", f"{span_seconds(gap)} seconds").alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def stream_timechart(sdf: DataFrame, span, by: list[str] = (), late="10 minutes") -> DataFrame:
    out = sdf.withWatermark("timestamp", late).groupBy(F.window("timestamp", f"{span_seconds(span)} seconds").alias("w"), *by).agg(F.count(F.lit(1)).alias("count"))
    return out.select(F.col("w.start").alias("_time"), "count", *by)


def stream_dedup(sdf: DataFrame, late="10 minutes") -> DataFrame:
    return sdf.withWatermark("timestamp", late).dropDuplicatesWithinWatermark(["id"])


def stream_enrich(sdf: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Stateless steps (parsers, attack_map, ti_match, score_events) on a stream: the same functions as in batch."""
    for step in steps:
        sdf = step(sdf)
    return sdf


#: Buckets of finding snapshots: a batch rewrites only those that its findings fall into.
FINDING_BUCKETS = 16


def _manifest(spark: SparkSession, path: str, number: int) -> dict[int, int]:
    """bucket -> the batch that wrote its current version, after batch ``number``; nothing before the first."""
    if number < 0:
        return {}
    return {r.bucket: r.version for r in spark.read.schema("bucket int, version long").parquet(f"{path}/manifest/{number}").collect()}


def upsert_findings(batch: DataFrame, number: int, path: str, rule_id: str, name: str, severity: str, buckets: int = FINDING_BUCKETS) -> None:
    """Merges a batch of detection groups into the finding snapshots under ``path``.

    Findings lie in buckets of their dedup key.  A batch reads and rewrites the buckets that it touches, as a version of its own, and then
    writes the manifest that names each bucket's version.  It starts from the manifest of the batch before it, so that a batch that is
    played again gives the same; versions that neither manifest names are deleted.
    """
    spark = batch.sparkSession
    bucket = F.pmod(F.xxhash64("dedup_key"), F.lit(buckets)).cast("int")
    # Several groups of a batch may be one finding: they are merged as findings of batches of their own would be.
    new = fd.merged_findings(fd.new_findings(batch, rule_id, name, severity)).withColumn("bucket", bucket).persist()
    before = _manifest(spark, path, number - 1)
    touched = {r.bucket for r in new.select("bucket").distinct().collect()}
    old = [f"{path}/v{v}/bucket={b}" for b, v in before.items() if b in touched]
    kept = spark.read.schema(fd.SCHEMA).parquet(*old) if old else spark.createDataFrame([], fd.SCHEMA)
    fd.findings_upsert(kept, new).withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/v{number}")
    now = before | dict.fromkeys(touched, number)
    spark.createDataFrame(sorted(now.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/{number}")
    new.unpersist()
    oldest = f"{path}/manifest/{number - 2}"
    if number > 1 and exists(spark, oldest):  # it is gone where this batch is played again
        for v in set(_manifest(spark, path, number - 2).values()) - set(now.values()) - set(before.values()):
            removed(spark, f"{path}/v{v}")
        removed(spark, oldest)


def current_findings(spark: SparkSession, path: str, number: int) -> DataFrame:
    """The findings as batch ``number`` left them."""
    at = _manifest(spark, path, number)
    return spark.read.schema(fd.SCHEMA).parquet(*[f"{path}/v{v}/bucket={b}" for b, v in at.items()]) if at else spark.createDataFrame([], fd.SCHEMA)


def stream_findings(groups: DataFrame, path: str, rule_id: str, name: str, severity: str, checkpoint: str, buckets: int = FINDING_BUCKETS):
    """A query that upserts each batch of detection groups into finding snapshots under ``path`` (``upsert_findings``)."""

    def upsert(batch: DataFrame, number: int) -> None:
        upsert_findings(batch, number, path, rule_id, name, severity, buckets)

    return groups.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_events(df: DataFrame, late="10 minutes", column: str = "timestamp") -> DataFrame:
    """Events older than the newest one received before them by more than ``late``: what a watermark would drop, by arrival."""
    seconds = int(late.split()[0]) * {"second": 1, "minute": 60, "hour": 3600}[late.split()[1].rstrip("s")]
    high = df.groupBy("received_at").agg(F.max(column).alias("m"))
    # One row per arrival time: the running maximum is over batches and not over events, and over ranges of them.
    mark = running(positioned(high, ["received_at"]), {"mark": ("max", F.col("m"))}, before=True).select("received_at", "mark")
    return df.join(mark, "received_at").where(F.col(column) < F.col("mark") - F.expr(f"interval {seconds} seconds")).drop("mark")


def run_available(sdf: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs a stream over all that is there, into Parquet under ``path``, and reads it."""
    with with_timers(sdf.sparkSession):
        sdf.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return sdf.sparkSession.read.schema(sdf.schema).parquet(path)
