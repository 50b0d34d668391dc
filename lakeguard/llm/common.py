"""Helpers of the llm operators: tables, lineage cuts, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark 4 reads this setting itself where it is set; tests get a folder of their own.
_CHECKPOINT = "spark.checkpoint.dir"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; where it names none (tests), a local one."""
    named = spark.conf.get(_CHECKPOINT, "")
    if named:
        return named
    have = spark.sparkContext.getCheckpointDir()
    if have is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
        have = spark.sparkContext.getCheckpointDir()
    return have


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """The same rows, kept in the shared folder, with the lineage cut."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def keep(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written to the shared folder once and read from there."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def only(df: DataFrame, *columns: str) -> DataFrame:
    """Just these columns, so that extra ones with clashing names do no harm."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Components of the undirected graph ``edges(u, v)``: rows ``(node, root)``, root the smallest node.

    Alternates large-star and small-star contraction until nothing changes, which
    takes about log² of the size in rounds.  Minima are aggregated first and
    joined back, so a hub's links are never gathered in one group; each round
    ends in a checkpoint.  A graph without links gives no rows.
    """
    def star(links: DataFrame, large: bool) -> DataFrame:
        both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        if large:
            out = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
            least = down.groupBy("u").agg(F.min("v").alias("m"))
            out = down.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        return out.filter("u <> v").distinct()

    def mark(links: DataFrame) -> tuple:
        # links are distinct, so nothing cancels out; a sum of hashes would leave the range of a long
        row = links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64(F.lit(1), "u", "v"))).first()
        return tuple(row)

    links = materialise(edges.select("u", "v").filter("u <> v").distinct())
    seen = mark(links)
    for _ in range(rounds):
        if not seen[0]:
            break
        links = materialise(star(star(links, True), False))
        now = mark(links)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
