"""From raw documents to packed training sequences: five stages, each over all that the one before it kept.

Toxicity rejects documents, line dedup removes repeated lines (and a document of which no line is left), MinHash keeps one
document of each group of near-copies, decontamination drops documents that hold benchmark passages, and best-fit packing
deals the token ids of what is left to sequences.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import decontamination, line_dedup, minhash, packing, toxicity
from tidewatch.llm.scratch import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _aside(docs: DataFrame, *own: str) -> tuple[DataFrame, tuple[str, ...], dict]:
    """``docs`` with its columns but doc_id and ``own`` under names that no operator uses, those names, and each column back."""
    names = {c: f"__kept{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", *own)}
    rows = docs.select("doc_id", "text", *[F.col(c).alias(n) for c, n in names.items()])
    return rows, tuple(names.values()), {c: F.col(names.get(c, c)).alias(c) for c in docs.columns}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, learned from the labelled rows of ``documents``, does not reject."""
    chain = toxicity.fit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), toxicity.CATEGORIES)
    rows, names, back = _aside(docs)
    return toxicity.score(rows, chain, keep=names).where(F.col("p_toxic") < toxicity.THRESHOLD).select(*back.values())


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that stand elsewhere; a document that loses all its text goes, one that had none stays."""
    rows, _, back = _aside(docs, "text")
    left = line_dedup.dedup_lines(rows).where((F.col("n_removed") == 0) | (F.trim("text") != ""))
    length = F.when(F.col("n_removed") == 0, back["n_chars"]).otherwise(F.length("text").cast("long"))
    return left.select(*(back | {"n_chars": length.alias("n_chars")}).values())


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near-duplicates at five words and 0.8."""
    kept = minhash.near_duplicates(docs, n_words=5, percent=80).where("not kept").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_anti").select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by ``benchmark``."""
    rows, names, back = _aside(docs)
    return decontamination.contamination(rows, _table(spark, sf_dir, "benchmark"), keep=names).where("not contaminated").select(*back.values())


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("minhash_near_dedup", dedup_documents),
    ("benchmark_decontamination", decontaminate),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet to the shared folder and read again."""
    scratch = Scratch(spark, f"pipeline-{uuid.uuid4().hex[:8]}")
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return docs


#: The classifier chain and the genetic packing are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None
