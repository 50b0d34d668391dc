"""Positions, running maxima and moments without one-partition windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeguard.functions.storage import cut


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _placed(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Rows in ranges of the order, each with its range.

    Range bounds are sampled anew wherever a plan repeats them, so the rows are
    kept before two branches read them.
    """
    return cut(df.repartitionByRange(_parts(df), *order).withColumn("_part", F.spark_partition_id()))


def global_rank(df: DataFrame, order: Sequence[Column], keys: Sequence[str] = (), name: str = "pos") -> DataFrame:
    """Adds the exact 0-based position of each row in ``order``, by ``keys`` if there are any.

    Without keys rows are range-partitioned by the order, numbered in each
    partition, and moved by the number of rows in the partitions before, which
    is one number for each partition.  Give an order without ties for a position
    that does not depend on the number of partitions.
    """
    if keys:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long") - 1)
    placed = _placed(df, order)
    inner = placed.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(*order)).cast("long") - 1)
    counts = placed.groupBy("_part").agg(F.count("*").alias("_k"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_k").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    return inner.join(F.broadcast(before), "_part").withColumn(name, F.col("_n") + F.col("_before")).drop("_part", "_n", "_before")


def prefix_max(df: DataFrame, order: Sequence[Column], value: str, name: str) -> DataFrame:
    """Adds the maximum of ``value`` over all rows before a row in ``order``; the first has null."""
    placed = _placed(df, order)
    rows = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    tops = placed.groupBy("_part").agg(F.max(value).alias("_top"))
    before = tops.withColumn("_prior", F.max("_top").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).select("_part", "_prior")
    return placed.withColumn("_own", F.max(value).over(rows)).join(F.broadcast(before), "_part").withColumn(name, F.greatest("_own", "_prior")).drop("_part", "_own", "_prior")


def running_total(df: DataFrame, order: Sequence[Column], value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` over the rows up to and with each in ``order``, which should have no ties."""
    placed = _placed(df, order)
    rows = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = placed.groupBy("_part").agg(F.sum(value).alias("_all"))
    before = sums.withColumn("_prior", F.coalesce(F.sum("_all").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_prior")
    return placed.withColumn("_run", F.sum(value).over(rows)).join(F.broadcast(before), "_part").withColumn(name, F.col("_run") + F.col("_prior")).drop("_part", "_run", "_prior")


def nearest_known(df: DataFrame, order: str, value: str) -> DataFrame:
    """Adds ``value_before`` and ``value_after``: the nearest value that is not null at or before and at or after a row.

    Rows are range-partitioned by ``order``; what a partition hands to the others
    is its first and last known value.
    """
    placed = _placed(df, [F.col(order)])
    rows = Window.partitionBy("_part").orderBy(order)
    back = Window.partitionBy("_part").orderBy(F.desc(order))  # a growing frame; one that shrinks is built anew for every row
    known = F.when(F.col(value).isNotNull(), F.col(order))
    edges = placed.groupBy("_part").agg(F.max_by(value, known).alias("_last"), F.min_by(value, known).alias("_first"))
    parts = Window.orderBy("_part")  # a row for each partition
    edges = edges.select("_part", F.last("_last", True).over(parts.rowsBetween(Window.unboundedPreceding, -1)).alias("_prior"), F.last("_first", True).over(Window.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)).alias("_next"))
    own = placed.withColumn("_b", F.last(value, True).over(rows.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_a", F.last(value, True).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    met = own.join(F.broadcast(edges), "_part")
    return met.withColumn(f"{value}_before", F.coalesce("_b", "_prior")).withColumn(f"{value}_after", F.coalesce("_a", "_next")).drop("_part", "_b", "_a", "_prior", "_next")


def order_statistics(df: DataFrame, value: str, picks: dict[str, Column], weight: str | None = None) -> DataFrame:
    """One row with exact order statistics: ``picks`` maps a name to a 0-based position, an expression over ``n``.

    Equal values are counted before they are put in order, so a frequent one is one row; with
    ``weight`` a row stands for so many.
    """
    many = F.count("*") if weight is None else F.sum(weight).cast("long")
    levels = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(many.alias("_k"))
    run = running_total(levels, [F.col("_v")], "_k", "_up")
    total = run.agg(F.max("_up").alias("n"))

    def hit(p: Column) -> Column:
        return (p < F.col("_up")) & (p >= F.col("_up") - F.col("_k"))

    return run.join(F.broadcast(total)).agg(*[F.max(F.when(hit(p), F.col("_v"))).alias(k) for k, p in picks.items()], F.max("n").alias("n"))


def moments(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """n, sums (s_a) and sums of products (p_a_b) of complete rows in one aggregation; with ``weight`` a row stands for so many."""
    full = df.na.drop(subset=list(columns))
    many = F.count("*") if weight is None else F.coalesce(F.sum(weight), F.lit(0.0))

    def value(c: str) -> Column:
        return F.col(c).cast("double")

    def times(c: str) -> Column:
        return value(c) if weight is None else F.col(weight) * value(c)

    sums = [F.sum(times(c)).alias(f"s_{c}") for c in columns]
    products = [F.sum(times(a) * value(b)).alias(f"p_{a}_{b}") for i, a in enumerate(columns) for b in columns[i:]]
    return full.groupBy(*keys).agg(many.alias("n"), *sums, *products)
