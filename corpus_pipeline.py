"""Corpus pipeline: documents to token shards in five stages.

Each stage takes (spark, docs, sf_dir) and returns rows that are written as
Parquet and read again as the next stage's docs.  All but the last return the
columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeguard.llm import decontaminate, mixing, quality, simhash, tokens
from lakeguard.llm.common import scratch, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the quality classifier scores at its threshold or above."""
    return quality.filter_quality(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def row_key(docs: DataFrame, *columns: str) -> Column:
    """Hash of columns (all of them if none is named) that tells a null from a value; equal rows have equal ones."""
    named = [F.col(f"`{c}`") for c in columns or docs.columns]
    return F.xxhash64(*named, *[c.isNull() for c in named])


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: that of the least doc_id, and of its rows the first by a hash of the text.

    Rows are told apart by their doc_id and text, as doc_ids may be null or repeat; a null one comes after all others.
    """
    keyed = docs.withColumn("_t", F.xxhash64("text")).withColumn("_r", row_key(docs))
    kept = simhash.first_rows(keyed, ("_t", "_r")).select(F.col("_t").alias("_kt"), F.col("_r").alias("_kr"))
    # rows that are equal in every column share a key
    return keyed.join(kept, (F.col("_t") == F.col("_kt")) & (F.col("_r") == F.col("_kr")), "left_semi").drop("_t", "_r").distinct()


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a window of a benchmark item; a key of doc_id and text stands for the row."""
    keyed = docs.withColumn("_r", row_key(docs, "doc_id", "text"))
    found = decontaminate.contamination(keyed.select(F.col("_r").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    hit = found.filter("n_hit > 0").select(F.col("doc_id").alias("_hit")).distinct()
    return keyed.join(hit, F.col("_r") == F.col("_hit"), "left_anti").drop("_r")


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.apply_mix(docs, mixing.mix(docs))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes token shards and returns their digests by document."""
    return tokens.tokenise(docs, tokens.vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("mix", mix_stage),
    ("tokens", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL: str | None = None
