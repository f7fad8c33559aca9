"""Intermediate tables in the folder that the cluster shares.

A table written there cuts lineage and outlives a lost executor, so iterative operators write each step here and read it
back.  The folder is ``spark.checkpoint.dir`` of the session; only where that is unset (tests, a laptop) a local one is made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..scratch import new_folder, removed


class Scratch:
    """A folder of its own for one operator call; ``save`` writes and rereads, ``drop`` removes what is no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = new_folder(spark, name)
        self.n = 0

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        # The schema is passed on, so that no job is needed to infer it.
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables of ``save`` that nothing reads any more."""
        for df in tables:
            removed(self.spark, df._scratch_path)

    def sweep(self, *tables: DataFrame) -> None:
        """``drop``, and the shuffle files of the steps that have ended go as well: Spark deletes them once the driver's garbage is collected."""
        self.drop(*tables)
        self.spark._jvm.System.gc()
