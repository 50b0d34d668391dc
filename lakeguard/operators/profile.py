"""Table profiles, data quality and insight reports."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeguard.functions.ranking import global_rank, order_statistics

#: Columns whose name asks for distinct values.  Fixed values.
UNIQUE_NAMES = re.compile(r"(^|_)(id|key|code|uuid)$|(id|key)$", re.IGNORECASE)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def _long(df: DataFrame, columns: Sequence[str], name: str, value: str, kind: str = "string") -> DataFrame:
    """(name, value) of several columns, nulls kept."""
    pairs = F.array(*[F.struct(F.lit(c).alias(name), F.col(f"`{c}`").cast(kind).alias(value)) for c in columns])
    return df.select(F.explode(pairs).alias("p")).select("p.*")


def profile_table(df: DataFrame, approx: bool = False) -> DataFrame:
    """A row for each column: n, nulls, distinct, min, max, mean and the three most frequent values.

    Scalars come from one aggregation over the table; most frequent values from counts of (column, value).
    """
    distinct = F.approx_count_distinct if approx else F.count_distinct
    numbers = set(numeric_columns(df))
    parts = []
    for c in df.columns:
        k = F.col(f"`{c}`")
        parts.append(
            F.struct(
                F.lit(c).alias("column"),
                F.count(k).alias("non_null"),
                F.count_if(k.isNull()).alias("nulls"),
                distinct(k).alias("distinct"),
                (F.min(k).cast("double") if c in numbers else F.lit(None).cast("double")).alias("min"),
                (F.max(k).cast("double") if c in numbers else F.lit(None).cast("double")).alias("max"),
                (F.avg(k) if c in numbers else F.lit(None).cast("double")).alias("mean"),
            )
        )
    scalars = df.agg(F.array(*parts).alias("p")).select(F.explode("p").alias("p")).select("p.*")
    counts = _long(df, df.columns, "column", "value").filter("value IS NOT NULL").groupBy("column", "value").count()
    top = counts.withColumn("k", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("count"), "value"))).filter("k <= 3")
    listed = top.groupBy("column").agg(F.array_sort(F.collect_list(F.struct("k", "value"))).alias("t")).select("column", F.array_join(F.transform("t", lambda x: x["value"]), "|").alias("top"))
    return scalars.join(listed, "column", "left")


def describe_numeric(df: DataFrame, column: str) -> DataFrame:
    """count, mean, min, max, range, sample deviation, median and quartiles by position in the sorted column."""
    n = F.col("n")
    picks = {"p25": F.greatest(F.lit(0), F.floor(n * 0.25) - 1), "p75": F.least(n - 1, F.floor(n * 0.75)), "_low": F.floor((n - 1) / 2), "_high": F.ceil((n - 1) / 2)}
    # the median by position too: as an aggregate it sends all of a task's values to one task
    middle = (F.col("_low").cast("double") + F.col("_high").cast("double")) / 2
    quarters = order_statistics(df, column, picks).select(middle.alias("median"), "p25", "p75")
    c = F.col(column)
    rest = df.agg(F.count(c).alias("count"), F.avg(c).alias("mean"), F.min(c).alias("min"), F.max(c).alias("max"), (F.max(c) - F.min(c)).alias("range"), F.stddev(c).alias("std"))
    return rest.join(F.broadcast(quarters))


def classify_columns(df: DataFrame) -> DataFrame:
    """Each column as id, numeric, date, categorical or text, by its name, values and number of distinct ones.

    Rows are dealt over all tasks before values are counted, as a task that reads a file would hold
    all the values of its columns.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = _long(df.repartition(tasks), df.columns, "column", "s").groupBy("column", "s").agg(F.count("s").alias("k"))
    number, date = F.col("s").try_cast("double").isNotNull(), F.col("s").rlike(r"^\d{4}-\d{2}-\d{2}|^\d{1,2}/\d{1,2}/\d{2,4}")

    def rows(held: Column) -> Column:
        return F.coalesce(F.sum(F.when(held, F.col("k"))), F.lit(0))

    found = values.groupBy("column").agg(F.sum("k").alias("n"), F.count("s").alias("d"), rows(number).alias("num"), rows(date).alias("dates"))
    columns = df.sparkSession.createDataFrame([(c,) for c in df.columns], "column string")  # a table without rows has them, too
    one = columns.join(F.broadcast(found), "column", "left").na.fill(0, ["n", "d", "num", "dates"])
    name = F.lower("column")
    is_id = name.rlike("(^|_)(id|key|uuid)$|key$") & (F.col("d") >= 0.9 * F.col("n"))
    kind = F.when(is_id, "id").when(F.col("dates") >= 0.8 * F.col("n"), "date").when(F.col("num") >= 0.8 * F.col("n"), "numeric").when((F.col("d") <= 50) | (F.col("d") <= 0.05 * F.col("n")), "categorical").otherwise("text")
    return one.select("column", kind.alias("kind"))


def data_card(df: DataFrame) -> DataFrame:
    """Per column: type, rows, distinct values and the share of nulls."""
    kinds = dict(df.dtypes)
    parts = [F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("type"), F.count(F.lit(1)).alias("rows"), F.count_distinct(F.col(f"`{c}`")).alias("distinct"), F.round(F.count_if(F.col(f"`{c}`").isNull()) / F.count(F.lit(1)), 3).alias("null_share")) for c in df.columns]
    return df.agg(F.array(*parts).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def histogram(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), bins: int = 50) -> DataFrame:
    """(keys…, column, bin, n): equal-width bins between a column's least and greatest value; a constant one has bin 0."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])
    long = df.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.*").filter("v IS NOT NULL")
    ends = long.groupBy("column").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1)))
    return long.join(F.broadcast(ends), "column").groupBy(*keys, "column", at.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def category_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _long(df, columns, "column", "value").groupBy("column", "value").agg(F.count("*").alias("n"))


def batch_stats(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Per key and column: mean, population deviation, share of nulls, distinct values."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])
    long = df.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.*")
    return long.groupBy(*keys, "column").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), (F.count_if(F.col("v").isNull()) / F.count("*")).alias("null_rate"), F.count_distinct("v").alias("distinct"), F.count("*").alias("n"))


def correlations(df: DataFrame, columns: Sequence[str], least: float = 0.6) -> DataFrame:
    """Pairs with |r| of at least ``least``, over the rows that have both."""
    pairs = list(combinations(columns, 2))
    one = df.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(F.when(F.col(b).isNotNull(), F.col(a)).cast("double"), F.when(F.col(a).isNotNull(), F.col(b)).cast("double")).alias("r")) for a, b in pairs]).alias("p"))
    found = one.select(F.explode("p").alias("p")).select("p.*").filter(F.abs("r") >= least)
    return found.withColumn("strength", F.when(F.abs("r") >= 0.8, "strong").otherwise("moderate"))


# ------------------------------------------------------------ windows over a population
def trend_halves(df: DataFrame, value: str, order: Sequence[Column], least: float = 0.1) -> DataFrame:
    """Means of the first and second half in an order, flagged if they differ by at least a tenth of the first."""
    ranked = global_rank(df.filter(F.col(value).isNotNull()), order)
    total = df.agg(F.count(value).alias("n"))
    first = F.col("pos") < F.floor(F.col("n") / 2)
    halves = ranked.join(F.broadcast(total)).agg(F.avg(F.when(first, F.col(value))).alias("first"), F.avg(F.when(~first, F.col(value))).alias("second"), F.max("n").alias("n"))
    change = F.try_divide(F.col("second") - F.col("first"), F.abs("first"))
    return halves.withColumn("change", change).withColumn("flagged", (F.col("n") >= 6) & (F.abs("change") >= least))


def zscore_anomalies(df: DataFrame, value: str, keys: Sequence[str] = (), threshold: float = 2.0) -> DataFrame:
    stats = df.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    joined = df.join(stats, list(keys)) if keys else df.join(F.broadcast(stats))
    return joined.withColumn("z", F.try_divide(F.abs(F.col(value) - F.col("_m")), F.col("_s"))).filter(F.col("z") > threshold).drop("_m", "_s")


def iqr_outliers(df: DataFrame, value: str, reach: float = 1.5) -> DataFrame:
    """Rows outside the fences of the quartiles at positions ⌊n/4⌋ and ⌊3n/4⌋; none of fewer than four rows."""
    n = F.col("n")
    q = order_statistics(df, value, {"q1": F.floor(n * 0.25), "q3": F.floor(n * 0.75)})
    spread = F.col("q3") - F.col("q1")
    out = (F.col(value) < F.col("q1") - reach * spread) | (F.col(value) > F.col("q3") + reach * spread)
    return df.join(F.broadcast(q)).filter((n >= 4) & out).drop("q1", "q3", "n")


# ------------------------------------------------------------ quality checks
def quality_checks(df: DataFrame, null_limit: float = 0.10) -> DataFrame:
    """(check, column, metric, passed): null rates, distinct shares of key columns, and at least one row."""
    n = F.count(F.lit(1))
    rows = [F.struct(F.lit("row_count").alias("check"), F.lit("*").alias("column"), n.cast("double").alias("metric"), (n >= 1).alias("passed"))]
    for c in df.columns:
        k = F.col(f"`{c}`")
        rate = F.coalesce(F.try_divide(F.count_if(k.isNull()).cast("double"), n), F.lit(0.0))
        rows.append(F.struct(F.lit("null_rate").alias("check"), F.lit(c).alias("column"), rate.alias("metric"), (rate <= null_limit).alias("passed")))
        if UNIQUE_NAMES.search(c):
            share = F.coalesce(F.try_divide(F.count_distinct(k).cast("double"), n), F.lit(0.0))
            rows.append(F.struct(F.lit("uniqueness").alias("check"), F.lit(c).alias("column"), share.alias("metric"), (share >= 1.0).alias("passed")))
    return df.agg(F.array(*rows).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def quality_score(checks: DataFrame) -> DataFrame:
    return checks.agg(F.count("*").alias("checks"), F.count_if("passed").alias("passed"), (100 * F.count_if("passed") / F.count("*")).alias("score"))


def null_alerts(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    stats = batch_stats(df, keys, columns).filter("null_rate > 0.3")
    return stats.select(*keys, "column", "null_rate", F.when(F.col("null_rate") > 0.5, "high").otherwise("medium").alias("severity"))


def threshold_alerts(df: DataFrame, rules: Sequence[Mapping]) -> DataFrame:
    tests = []
    for r in rules:
        c, v = F.col(r["column"]), r["value"]
        hit = {">=": c >= v, "<=": c <= v, ">": c > v, "<": c < v, "==": c == v}[r["op"]]
        tests.append(F.when(hit, F.lit(r["label"])))
    return df.withColumn("label", F.explode(F.filter(F.array(*tests), lambda x: x.isNotNull())))


def insight_report(df: DataFrame, columns: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """(type, metric, value): distribution, outliers and trend of the columns, and their correlations."""
    parts = []
    for c in columns:
        parts.append(df.agg(F.avg(c).alias("value")).select(F.lit("distribution").alias("type"), F.lit(c).alias("metric"), F.col("value").cast("double")))
        parts.append(iqr_outliers(df.select(c), c).agg(F.count("*").cast("double").alias("value")).select(F.lit("outlier").alias("type"), F.lit(c).alias("metric"), "value"))
        parts.append(trend_halves(df, c, order).filter("flagged").select(F.lit("trend").alias("type"), F.lit(c).alias("metric"), F.col("change").alias("value")))
    if len(columns) > 1:
        parts.append(correlations(df, list(columns)).select(F.lit("correlation").alias("type"), F.concat_ws("~", "a", "b").alias("metric"), F.col("r").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def stats_summary(df: DataFrame, columns: Sequence[str], samples: int = 5) -> DataFrame:
    """(metric, n, mean, sd, least, most, median, outliers, samples) of each numeric column; a few of the outliers are listed."""
    out = None
    for c in columns:
        clean = df.filter(F.col(c).isNotNull()).select(F.col(c).cast("double").alias(c))
        stats = clean.agg(F.count("*").alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd"), F.min(c).alias("least"), F.max(c).alias("most"))
        half = order_statistics(clean, c, {"_a": F.floor((F.col("n") - 1) / 2), "_b": F.ceil((F.col("n") - 1) / 2)}).select(((F.col("_a") + F.col("_b")) / 2).alias("median"))
        odd = iqr_outliers(clean, c)
        few = odd.agg(F.count("*").alias("outliers")).join(odd.limit(samples).agg(F.collect_list(c).alias("samples")))
        row = stats.join(half).join(few).select(F.lit(c).alias("metric"), "*")
        out = row if out is None else out.unionByName(row)
    return out


# ------------------------------------------------------------ relationships
def may_relate(a: str, b: str) -> bool:
    """Whether two columns may be a key and a reference to it, by their names."""
    x, y = a.lower(), b.lower()
    if x == y and any(w in x for w in ("id", "key", "code")):
        return True
    if {x, y} >= {"id"} and (x.endswith("_id") or y.endswith("_id")):
        return True
    if x.endswith("key") and x.rpartition("_")[2] == y.rpartition("_")[2]:
        return True
    stems = [n.replace("_id", "").replace("id", "") for n in (x, y)]
    return "id" in x and "id" in y and all(stems) and (stems[0] in stems[1] or stems[1] in stems[0])


def relationships(tables: Mapping[str, DataFrame], least: float = 0.5) -> DataFrame:
    """(child, child_column, parent, parent_column, overlap): key columns whose distinct values another table's key has.

    Candidates are told by ``may_relate``, among others those that share the end of their names after the table's prefix; the side with more distinct values is the parent,
    of equal ones that whose values repeat less.
    """
    parts = []
    for (a, da), (b, db) in combinations(sorted(tables.items()), 2):
        for ca in da.columns:
            for cb in db.columns:
                if may_relate(ca, cb):
                    x = da.filter(F.col(ca).isNotNull()).groupBy(F.col(ca).cast("string").alias("k")).agg(F.count("*").alias("l"))
                    y = db.filter(F.col(cb).isNotNull()).groupBy(F.col(cb).cast("string").alias("k")).agg(F.count("*").alias("r"))
                    both = x.join(y, "k", "full").agg(F.max("l").alias("ml"), F.max("r").alias("mr"), F.count("l").alias("na"), F.count("r").alias("nb"), F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("both"))
                    swap = (F.col("na") > F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("ml") < F.col("mr")))
                    parts.append(both.select(F.when(swap, b).otherwise(a).alias("child"), F.when(swap, cb).otherwise(ca).alias("child_column"), F.when(swap, a).otherwise(b).alias("parent"), F.when(swap, ca).otherwise(cb).alias("parent_column"), F.try_divide(F.col("both").cast("double"), F.least("na", "nb")).alias("overlap")))
    if not parts:
        return next(iter(tables.values())).sparkSession.createDataFrame([], "child string, child_column string, parent string, parent_column string, overlap double")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter(F.col("overlap") >= least)
