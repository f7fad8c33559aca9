"""The canonical event view over the given tables, and the dimensions derived from them, for Spark and for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical columns of ``events``; times stay timestamp_ntz."""
    e, t, i = read(spark, sf_dir, "events"), F.col("event_type"), F.col("event_id")
    return e.select(
        i, i.cast("string").alias("id"), F.col("ts").cast("timestamp_ntz").alias("timestamp"), t.alias("source"), F.lit("app").alias("source_type"),
        F.concat(F.lit("h"), F.col("user_id") % 20).alias("host"), F.concat(F.lit("u"), F.col("user_id")).alias("user"),
        F.concat(F.lit("10.0."), F.col("user_id") % 8, F.lit("."), i % 50).alias("source_ip"), F.concat(F.lit("192.168.0."), i % 10).alias("destination_ip"),
        F.concat(F.lit("p"), i % 5).alias("process"), F.when(t.isin("signup", "error"), "authentication").otherwise(t).alias("event_type"),
        F.when(t == "error", "failure").otherwise("success").alias("outcome"),
        F.when(t == "error", "err").when(t == "purchase", "notice").when(t == "signup", "warning").otherwise("info").alias("severity"),
        F.concat(t, F.lit(" value="), F.col("value").cast("decimal(20,2)").cast("string"), F.lit(" user=u"), F.col("user_id")).alias("message"),
        F.col("props").alias("attributes"), F.col("value"), (F.col("value") * 100).cast("bigint").alias("bytes"),
    )


#: The same view in DuckDB; every oracle starts with it.
EV = """ev AS (SELECT event_id, event_id::VARCHAR AS id, ts AS timestamp, event_type AS source, 'app' AS source_type, 'h' || (user_id % 20) AS host, 'u' || user_id AS "user",
  '10.0.' || (user_id % 8) || '.' || (event_id % 50) AS source_ip, '192.168.0.' || (event_id % 10) AS destination_ip, 'p' || (event_id % 5) AS process,
  CASE WHEN event_type IN ('signup', 'error') THEN 'authentication' ELSE event_type END AS event_type, CASE event_type WHEN 'error' THEN 'failure' ELSE 'success' END AS outcome,
  CASE event_type WHEN 'error' THEN 'err' WHEN 'purchase' THEN 'notice' WHEN 'signup' THEN 'warning' ELSE 'info' END AS severity,
  event_type || ' value=' || value::DECIMAL(20,2) || ' user=u' || user_id AS message, props AS attributes, value, trunc(value * 100)::BIGINT AS bytes FROM events)"""

#: Assets, entity metadata, indicators and address ranges derived from customer, nation and supplier.
ASSETS = """assets AS (SELECT 'host' AS entity_type, 'host:h' || c_custkey AS entity_ref, 'h' || c_custkey AS name, CASE c_custkey % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS criticality,
  c_custkey % 5 = 0 AS internet_exposed, CASE WHEN c_custkey % 2 = 0 THEN 'dmz' ELSE 'corp' END AS environment, c_custkey AS k FROM customer)"""
META = """meta AS (SELECT 'u' || c_custkey AS "user", CASE WHEN c_custkey % 7 = 0 THEN 'admin' WHEN c_custkey % 3 = 0 THEN 'privileged' ELSE 'standard' END AS privilege FROM customer)"""
INDICATORS = """ind AS (SELECT s_suppkey AS indicator_id, 'ip' AS type, '10.0.' || (s_suppkey % 8) || '.' || (s_suppkey % 50) AS value, CASE s_suppkey % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity,
  (s_suppkey % 10 + 1) / 10.0::DOUBLE AS confidence, 'feed-' || (s_nationkey % 3) AS feed, 0.5 + (s_nationkey % 3) * 0.25::DOUBLE AS reliability FROM supplier)"""
GEO = """geo AS (SELECT n_nationkey AS k, 167772160 + (n_nationkey % 8) * 65536 + (n_nationkey // 8) * 16 AS lo, 167772160 + (n_nationkey % 8) * 65536 + (n_nationkey // 8) * 16 + 15 AS hi, n_name AS country, (n_nationkey * 7 % 120 - 60)::DOUBLE AS lat, (n_nationkey * 31 % 300 - 150)::DOUBLE AS lon FROM nation)"""


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(
        F.lit("host").alias("entity_type"), F.concat(F.lit("host:h"), k).alias("entity_ref"), F.concat(F.lit("h"), k).alias("name"),
        F.element_at(F.array(*map(F.lit, ("critical", "high", "medium", "low"))), (k % 4 + 1).cast("int")).alias("criticality"), (k % 5 == 0).alias("internet_exposed"),
        F.when(k % 2 == 0, "dmz").otherwise("corp").alias("environment"), k.alias("k"),
    )


def entity_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(F.concat(F.lit("u"), k).alias("user"), F.when(k % 7 == 0, "admin").when(k % 3 == 0, "privileged").otherwise("standard").alias("privilege"))


def indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    return read(spark, sf_dir, "supplier").select(
        k.alias("indicator_id"), F.lit("ip").alias("type"), F.concat(F.lit("10.0."), k % 8, F.lit("."), k % 50).alias("value"),
        F.element_at(F.array(*map(F.lit, ("critical", "high", "medium", "low"))), (k % 4 + 1).cast("int")).alias("severity"), ((k % 10 + 1) / 10.0).alias("confidence"),
        F.concat(F.lit("feed-"), n % 3).alias("feed"), (0.5 + (n % 3) * 0.25).alias("reliability"),
    )


def geo_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    lo = F.lit(167772160) + (k % 8) * 65536 + F.floor(k / 8).cast("int") * 16
    return read(spark, sf_dir, "nation").select(
        k.alias("k"), lo.cast("bigint").alias("lo"), (lo + 15).cast("bigint").alias("hi"), F.col("n_name").alias("country"), (k * 7 % 120 - 60).cast("double").alias("lat"), (k * 31 % 300 - 150).cast("double").alias("lon")
    )


def latest(df: DataFrame, column: str = "timestamp"):
    """The newest time of a table, which stands for now."""
    return df.agg(F.max(column)).first()[0]
