"""Tailing of growing text files over restarts: each complete line once, an unfinished last line later.

A run compares the files' sizes with the byte offsets of the run before, reads the files that have grown, and hands the lines behind the
offsets to a sink.  Only then are the new offsets written, under the run's number: a run that fails is done again with the same number and
the same beginning.  A file that has become shorter was cut or replaced, and starts over.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import exists, saved
from .events import events_of_lines

_OFFSETS = "path string, position long"


def _last_run(spark: SparkSession, state: str) -> int:
    """The number of the last finished run; -1 before the first."""
    number = -1
    while exists(spark, f"{state}/{number + 1}/_SUCCESS"):
        number += 1
    return number


def new_lines(spark: SparkSession, path: str, offsets: DataFrame) -> DataFrame:
    """(path, value, end): complete lines behind ``offsets`` (path, position), and the byte after each.

    A line's place is the sum of the lengths before it, first within a split of a file and then over its splits; a file is read in as
    many tasks as it has splits.  Where the lines and their ends add up to more than the file, the last one has no end yet.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"))
    start = F.when(F.coalesce("position", F.lit(0)) <= F.col("size"), F.coalesce("position", F.lit(0))).otherwise(0)
    grown = listed.join(offsets, "path", "left").select("path", "size", start.alias("start")).where("size > start")
    files = [r.path for r in grown.select("path").collect()]  # the names of changed files
    if not files:
        return spark.createDataFrame([], "path string, value string, end long")
    raw = spark.read.option("lineSep", "\n").text(files)
    lines = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("n"), "value")
    lines = lines.withColumn("bytes", F.octet_length("value").cast("long") + 1)
    before = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = lines.groupBy("path", "split").agg(F.sum("bytes").alias("b")).withColumn("offset", F.coalesce(F.sum("b").over(before), F.lit(0))).select("path", "split", "offset")
    inside = Window.partitionBy("path", "split").orderBy("n")
    placed = lines.withColumn("end", F.sum("bytes").over(inside)).join(splits, ["path", "split"]).withColumn("end", F.col("end") + F.col("offset"))
    # The end of an unfinished line would lie behind the file.
    return placed.join(grown, "path").where("end - bytes >= start and end <= size").select("path", "value", "end")


def tail_run(spark: SparkSession, path: str, state: str, sink: Callable[[DataFrame, int], None], parse: Callable[[DataFrame], DataFrame] = events_of_lines) -> int:
    """One run over ``path``: ``sink(events, number)`` gets the events of new complete lines, then the offsets are kept under ``state``.

    Returns the run's number.  ``sink`` may see a number again after a failure, with at least the same lines.
    """
    last = _last_run(spark, state)
    offsets = spark.read.schema(_OFFSETS).parquet(f"{state}/{last}") if last >= 0 else spark.createDataFrame([], _OFFSETS)
    # Files grow on while this runs: written down, the lines that the sink gets are those that the offsets count.
    found = saved(new_lines(spark, path, offsets), "tail")
    sink(parse(found.select("value")), last + 1)
    ends = found.groupBy("path").agg(F.max("end").alias("end"))
    now = offsets.join(ends, "path", "full_outer").select("path", F.coalesce("end", "position").alias("position"))
    now.write.mode("overwrite").parquet(f"{state}/{last + 1}")
    return last + 1


__all__ = ["new_lines", "tail_run"]
