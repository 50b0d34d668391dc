"""Drift of batches against a baseline, its alarms, and the scores of healing.

Batches come in long form: key columns that name a batch, ``column`` and ``v``.
Baselines are the same without the keys.  All that leaves the first aggregation
is small: bins, moments or distances by batch and column.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeguard.functions.ranking import global_rank
from lakeguard.functions.storage import cut

EPSILON = 1e-10
ZETA = 0.15
#: Batches that the threshold looks back on, and those it needs.
HISTORY, LEAST_HISTORY = 200, 5
#: Batches and columns whose ends are sent to all tasks, at most; beyond that their join is a shuffle.
BROADCAST_ROWS = 100_000


def long_form(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys…, column, v) of numeric columns, nulls left out."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])
    return df.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.*").filter("v IS NOT NULL")


# ------------------------------------------------------------ schema
def schema_drift(batches: DataFrame, baseline: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of ``batches(keys…, name, type)`` against ``baseline(name, type)``: those that differ.

    (keys…, kind, added, removed, changed, severity).  Types count only where no
    column came or went, and an unknown baseline type agrees with any.
    """
    heads = batches.select(*keys).distinct().crossJoin(F.broadcast(baseline.select("name", F.col("type").alias("old"))))  # one schema
    both = batches.withColumnRenamed("type", "new").join(heads, [*keys, "name"], "full_outer")
    n = F.count("old")
    counts = both.groupBy(*keys).agg(
        F.count_if(F.col("old").isNull()).alias("added"),
        F.count_if(F.col("new").isNull()).alias("removed"),
        F.count_if((F.col("old") != F.col("new")) & (F.col("old") != "unknown")).alias("changed"),
        n.alias("_n"),
    )
    moved = (F.col("added") + F.col("removed")) > 0
    severity = F.when(F.col("removed") > F.col("_n") * 0.5, "critical").when(F.col("removed") > 0, "high").otherwise("medium")
    found = counts.filter(moved | (F.col("changed") > 0))
    return found.select(*keys, F.when(moved, "schema_change").otherwise("type_change").alias("kind"), "added", "removed", F.when(moved, 0).otherwise(F.col("changed")).cast("long").alias("changed"), severity.alias("severity"))


# ------------------------------------------------------------ distributions
def histograms(long: DataFrame, keys: Sequence[str] = (), bins: int = 50) -> DataFrame:
    """(keys…, column, bin, n): equal widths between the ends of each batch's own column; a constant has bin 0."""
    by = [*keys, "column"]
    ends = long.groupBy(*by).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    at = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)))
    return long.join(ends, by).groupBy(*by, at.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def kl_divergence(batches: DataFrame, baseline: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys…, column, kl) of ``(…, column, bin, n)`` frames; bins agree by number or category, none is below 0.

    Columns that the baseline lacks have no row.
    """
    by = [*keys, "column"]
    heads = batches.select(*by).distinct()
    base = heads.join(baseline, "column").select(*by, "bin", F.lit(0).cast("long").alias("p"), F.col("n").alias("q"))
    both = batches.select(*by, "bin", F.col("n").alias("p"), F.lit(0).cast("long").alias("q")).unionByName(base)
    group = Window.partitionBy(*by)
    shares = both.groupBy(*by, "bin").agg(F.sum("p").alias("p"), F.sum("q").alias("q")).withColumns({"_p": F.sum("p").over(group), "_q": F.sum("q").over(group)})
    p, q = F.col("p") / F.col("_p") + EPSILON, F.col("q") / F.col("_q") + EPSILON
    return shares.filter("_q > 0").groupBy(*by).agg(F.greatest(F.sum(p * F.ln(p / q)), F.lit(0.0)).alias("kl"))


def location_shift(batches: DataFrame, baseline: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys…, column, shift): distance of the means in deviations of the baseline, or in units if it has none."""
    base = baseline.groupBy("column").agg(F.avg("v").alias("_m"), F.stddev_pop("v").alias("_s"))
    means = batches.groupBy(*keys, "column").agg(F.avg("v").alias("mean"))
    scale = F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0)
    return means.join(F.broadcast(base), "column").select(*keys, "column", (F.abs(F.col("mean") - F.col("_m")) / scale).alias("shift"))


def measures(long: DataFrame, key: str, bins: int = 50) -> DataFrame:
    """(key, column, kl, shift) of the batches in ``long(key, column, v)``, whose rows without a key are the baseline.

    The rows are read twice: once for ends, means and deviations of every batch
    and the baseline, once for their histograms.  Columns that the baseline lacks have
    no row.
    """
    ends = cut(long.groupBy(key, "column").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("spread")))
    at = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)))
    few = F.broadcast(ends) if ends.count() <= BROADCAST_ROWS else ends  # a row for each batch and column
    placed = long.alias("r").join(few.alias("e"), (F.col(f"r.{key}").eqNullSafe(F.col(f"e.{key}"))) & (F.col("r.column") == F.col("e.column")))
    counts = cut(placed.groupBy(F.col(f"r.{key}").alias(key), F.col("r.column").alias("column"), at.cast("long").alias("bin")).agg(F.count("*").alias("n")))
    new, base = F.col(key).isNotNull(), F.col(key).isNull()
    kl = kl_divergence(counts.filter(new), counts.filter(base).drop(key), [key])
    known = ends.filter(base).select("column", F.col("mean").alias("_m"), F.when(F.col("spread") > 0, F.col("spread")).otherwise(1.0).alias("_s"))
    shift = ends.filter(new).join(known, "column").select(key, "column", (F.abs(F.col("mean") - F.col("_m")) / F.col("_s")).alias("shift"))
    return kl.join(shift, [key, "column"])


def statistical_drift(measured: DataFrame, source: str, batch: str, warmup: int = 5, zeta: float = ZETA) -> DataFrame:
    """(source, batch, zeta, max_kl, columns, flagged, severity) of ``measured(source, batch, column, kl, shift)``.

    The threshold follows the averages of earlier batches, into which columns
    that moved by over two deviations enter with a divergence lifted by the
    threshold itself, so the batches of a source are folded in order.  A source
    has one short row for each batch; of those behind it the last HISTORY averages
    are kept.  In the first ``warmup`` batches divergence without such a move is no
    alarm.
    """
    column = F.struct("column", "kl", "shift")
    rows = measured.groupBy(source, F.col(batch).cast("string").alias(batch)).agg(F.array_sort(F.collect_list(column)).alias("cols"))
    kind = measured.schema[source].dataType.simpleString()

    def fold(batches: pd.DataFrame) -> pd.DataFrame:
        history: deque[float] = deque(maxlen=HISTORY)
        out = []
        ordered = batches.sort_values(batch, kind="stable")
        for i, (who, name, cols) in enumerate(zip(ordered[source], ordered[batch], ordered["cols"], strict=True), 1):
            limit = zeta
            if len(history) >= LEAST_HISTORY:
                mean = math.fsum(history) / len(history)
                limit = max(mean + 2 * math.sqrt(math.fsum((v - mean) ** 2 for v in history) / len(history)), zeta * 0.5)
            lifted = [(c["column"], max(c["kl"], c["shift"] * limit) if c["shift"] > 2 else c["kl"]) for c in cols]
            over = [(n, v) for n, v in lifted if v > limit]
            moved = any(c["shift"] > 2 for c in cols)
            out.append((who, name, limit, max((v for _, v in over), default=0.0), [n for n, _ in over], bool(over) and (moved or i > warmup)))
            history.append(sum(math.floor(v * 1e6 + 0.5) / 1e6 for _, v in lifted) / len(lifted))
        return pd.DataFrame(out, columns=[source, batch, "zeta", "max_kl", "columns", "flagged"])

    folded = rows.groupBy(source).applyInPandas(fold, f"`{source}` {kind}, `{batch}` string, zeta double, max_kl double, columns array<string>, flagged boolean")
    ratio = F.col("max_kl") / F.col("zeta")
    severity = F.when(~F.col("flagged"), F.lit(None).cast("string")).when(ratio > 3, "critical").when(ratio > 2, "high").when(ratio > 1.5, "medium").otherwise("low")
    return folded.withColumn("severity", severity)


# ------------------------------------------------------------ batch vectors
def batch_vectors(df: DataFrame, keys: Sequence[str], columns: Sequence[str], size: int = 256) -> DataFrame:
    """(keys…, bucket, w): signed feature hash of ``column:value`` by batch, of length 1; the hash is md5."""
    tokens = F.array(*[F.concat(F.lit(f"{c}:"), F.col(c).cast("string")) for c in columns])
    digest = F.md5(F.col("token").cast("binary"))
    bucket = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % size
    sign = F.when(F.conv(F.substring(digest, 9, 8), 16, 10).cast("long") % 2 == 0, 1).otherwise(-1)
    counted = df.select(*keys, F.explode(tokens).alias("token")).filter("token IS NOT NULL").groupBy(*keys, "token").agg(F.count("*").alias("n"))
    sums = counted.groupBy(*keys, bucket.alias("bucket")).agg(F.sum(F.col("n") * sign).cast("double").alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))))
    return sums.withColumn("_norm", norm).filter("_norm > 0").select(*keys, "bucket", (F.col("w") / F.col("_norm")).alias("w"))


def semantic_drift(vectors: DataFrame, references: DataFrame, keys: Sequence[str], reference: str, limit: float = 0.25) -> DataFrame:
    """(keys…, distance, severity): least cosine distance to a reference vector; severity is null up to the limit."""
    dots = vectors.join(references.withColumnRenamed("w", "_r"), "bucket").groupBy(*keys, reference).agg(F.sum(F.col("w") * F.col("_r")).alias("dot"))
    nearest = vectors.select(*keys).distinct().join(dots.groupBy(*keys).agg(F.max("dot").alias("dot")), list(keys), "left")
    distance = 1 - F.coalesce("dot", F.lit(0.0))
    ratio = F.col("distance") / limit
    severity = F.when(ratio > 3, "critical").when(ratio > 2, "high").when(ratio > 1.5, "medium").when(ratio > 1, "low")
    return nearest.select(*keys, distance.alias("distance")).withColumn("severity", severity)


# ------------------------------------------------------------ distances and alarms
def wasserstein(batches: DataFrame, baseline: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys…, column, w1): mean distance of the sorted samples, the shorter one stretched linearly to the longer.

    Positions are global ranks less those of the group's first row, so no group
    has to be sorted by one task.
    """
    by = [*keys, "column"]

    def placed(df: DataFrame, groups: list[str]) -> tuple[DataFrame, DataFrame]:
        ranked = global_rank(df.select(*groups, "v"), [*[F.col(g) for g in groups], F.col("v")])
        sizes = ranked.groupBy(*groups).agg(F.min("pos").alias("_first"), F.count("*").alias("n"))
        return ranked.join(sizes, groups).select(*groups, "v", (F.col("pos") - F.col("_first")).alias("i")), sizes.drop("_first")

    mine, mine_n = placed(batches, by)
    base, base_n = placed(baseline, ["column"])
    sizes = mine_n.withColumnRenamed("n", "nb").join(base_n.withColumnRenamed("n", "na"), "column")
    theirs = sizes.select(*by).join(base, "column").select(*by, "v", "i")
    longer = mine.join(sizes.filter("nb >= na").select(*by, F.col("nb").alias("n"), F.col("na").alias("m")), by).unionByName(theirs.join(sizes.filter("nb < na").select(*by, F.col("na").alias("n"), F.col("nb").alias("m")), by))
    shorter = theirs.join(sizes.filter("nb >= na").select(*by), by).unionByName(mine.join(sizes.filter("nb < na").select(*by), by)).select(*by, F.col("v").alias("s"), F.col("i").alias("k"))
    place = F.when(F.col("n") == F.col("m"), F.col("i").cast("double")).when(F.col("n") == 1, 0.0).otherwise(F.col("i") * (F.col("m") - 1) / (F.col("n") - 1))
    spots = longer.withColumn("_at", place).withColumn("k", F.floor("_at")).withColumn("_w", F.col("_at") - F.col("k"))
    ends = F.array(F.struct(F.col("k"), (1 - F.col("_w")).alias("share")), F.struct(F.least(F.col("k") + 1, F.col("m") - 1).alias("k"), F.col("_w").alias("share")))
    # each spot asks for its two neighbours
    asked = spots.select(*by, "v", "i", F.explode(ends).alias("e")).select(*by, "v", "i", F.col("e.k").alias("k"), F.col("e.share").alias("share"))
    met = asked.join(shorter, [*by, "k"]).groupBy(*by, "i").agg(F.max("v").alias("v"), F.sum(F.col("s") * F.col("share")).alias("s"))
    return met.groupBy(*by).agg(F.avg(F.abs(F.col("v") - F.col("s"))).alias("w1"))


def azuma_alarms(distances: DataFrame, keys: Sequence[str], order: str, learn: int = 20, alpha: float = 0.01, persist: int = 1, increment: float = 1.0, scale: float = 1.0) -> DataFrame:
    """Adds m, epsilon and alarm to ``distances(keys…, order, w1)``.

    The first ``learn`` distances give the expected one and the bound of the
    increments; from then on m sums the clipped increments, and ``persist``
    crossings of epsilon in a row are an alarm.
    """
    whole = Window.partitionBy(*keys)
    ordered = whole.orderBy(order)
    run = ordered.rowsBetween(Window.unboundedPreceding, 0)
    df = distances.withColumn("_n", F.row_number().over(ordered))
    active = F.col("_n") > learn
    df = df.withColumn("_e", F.avg(F.when(~active, F.col("w1"))).over(whole))
    df = df.withColumn("_c", F.max(F.when(~active, F.abs(F.col("w1") - F.col("_e")))).over(whole) * scale)
    df = df.withColumn("_c", F.when(F.col("_c") > 0, F.col("_c")).otherwise(F.lit(increment)))
    step = F.greatest(F.least(F.col("w1") - F.col("_e"), F.col("_c")), -F.col("_c"))
    df = df.withColumn("m", F.sum(F.when(active, step).otherwise(0.0)).over(run))
    df = df.withColumn("epsilon", F.when(active, F.sqrt(2 * math.log(1 / alpha) * (F.col("_n") - learn)) * F.col("_c")))
    df = df.withColumn("_hit", F.coalesce(F.abs("m") >= F.col("epsilon"), F.lit(False)))
    df = df.withColumn("_miss", F.sum((~F.col("_hit")).cast("int")).over(run))
    streak = F.sum(F.col("_hit").cast("int")).over(Window.partitionBy(*keys, "_miss").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("alarm", F.col("_hit") & (streak >= persist)).drop("_n", "_e", "_c", "_hit", "_miss")


# ------------------------------------------------------------ healing
def healing_scores(events: DataFrame, source: str = "source", sla: float = 60.0) -> DataFrame:
    """Per source of ``events(source, status, latency)``: total, resolved, failed, latency, contribution, quality, speed, composite."""
    status = F.col("status")
    latency = F.coalesce(F.avg(F.when(F.col("latency") > 0, F.col("latency"))), F.lit(1.0))
    df = events.groupBy(source).agg(F.count("*").alias("total"), F.count_if(status == "deployed").alias("resolved"), F.count_if(status == "failed").alias("failed"), latency.alias("latency"))
    df = df.withColumn("quality", F.col("resolved") / F.col("total")).withColumn("speed", F.least(F.lit(1.0), sla / F.greatest("latency", F.lit(1e-3))))
    return df.withColumn("contribution", F.col("quality") * F.ln(1 + 1 / F.greatest("latency", F.lit(0.01)))).withColumn("composite", F.col("quality") * F.col("speed"))


def healing_by_type(events: DataFrame, source: str = "source", kind: str = "drift_type") -> DataFrame:
    """(source, drift_type, total, resolved, quality, latency) of ``events(source, drift_type, status, latency)``; without known latencies it is 0."""
    return events.groupBy(source, kind).agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "deployed").alias("resolved"), F.avg((F.col("status") == "deployed").cast("double")).alias("quality"), F.coalesce(F.avg(F.when(F.col("latency") > 0, F.col("latency"))), F.lit(0.0)).alias("latency")
    )


def healing_summary(scores: DataFrame) -> DataFrame:
    """One row over the sources of ``healing_scores``: their number, all events, and the mean contribution, quality, speed and composite."""
    means = [F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("contribution", "quality", "speed", "composite")]
    return scores.agg(F.count("*").alias("sources"), F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.coalesce(F.sum("resolved"), F.lit(0)).alias("resolved"), *means)


def baseline(df: DataFrame, keys: Sequence[str], columns: Sequence[str], texts: Sequence[str], version: int = 1) -> dict[str, DataFrame]:
    """What later batches of a source are held against, each with its keys and ``version``: schema (name, type), histograms, and the vector of its texts."""
    held = {
        "schema": df.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.lit(df.schema[c].dataType.simpleString()).alias("type"), F.col(c).isNotNull().alias("_known")) for c in (*columns, *texts)])).alias("c")).filter("c._known").select(*keys, "c.name", "c.type").distinct(),
        "histogram": histograms(long_form(df, keys, columns), keys),
        "vector": batch_vectors(df, keys, texts),
    }
    return {k: v.withColumn("version", F.lit(version)) for k, v in held.items()}


def canary_split(batches: DataFrame, ordinal: Column, weights: Mapping[str, float]) -> DataFrame:
    """Adds version: the ordinal's thousandth against the cumulative weights, in the order given."""
    place = (ordinal % 1000) / 1000
    total, done, pick = sum(weights.values()), 0.0, None
    for version, weight in weights.items():
        done += weight / total
        pick = F.when(place < done, version) if pick is None else pick.when(place < done, version)
    return batches.withColumn("version", pick.otherwise(list(weights)[-1]))


def promote_canaries(routes: DataFrame, scores: DataFrame, source: str, at: Sequence[str], step: float = 0.2, least_score: float = 0.6, least_samples: int = 3) -> DataFrame:
    """``routes(source, version, weight, canary, drained)`` with the weights after each source's canary was judged.

    A canary with ``least_samples`` of ``scores(source, version, at…, score)`` or more
    whose last so many average at least ``least_score`` gains ``step``, up to 1, from
    the other routes of its source that are not drained, in proportion to their
    weights.  Adds avg_score and promoted (both null for others).  A source has one
    canary; of several the first by name is judged.
    """
    last = Window.partitionBy(source, "version").orderBy(*[F.desc(c) for c in at])
    recent = scores.withColumn("_i", F.row_number().over(last)).filter(F.col("_i") <= least_samples).groupBy(source, "version").agg(F.avg("score").alias("avg_score"), F.count("*").alias("_n"))
    first = routes.filter("canary").groupBy(source).agg(F.min("version").alias("_canary"))
    judged = routes.join(first, source, "left").join(recent, [source, "version"], "left")
    own = F.coalesce(F.col("version") == F.col("_canary"), F.lit(False))
    judged = judged.withColumn("promoted", F.when(own, F.coalesce((F.col("_n") >= least_samples) & (F.col("avg_score") >= least_score), F.lit(False)))).withColumn("avg_score", F.when(own, F.col("avg_score")))
    gain = F.when(F.col("promoted"), F.least(F.lit(1.0), F.col("weight") + step) - F.col("weight")).otherwise(0.0)
    giving = ~own & ~F.coalesce("drained", F.lit(False))
    # a row for each route
    routes_of = Window.partitionBy(source)
    moved = judged.withColumns({"_gain": F.sum(gain).over(routes_of), "_others": F.sum(F.when(giving, F.col("weight")).otherwise(0.0)).over(routes_of)})
    weight = F.when(F.col("promoted"), F.col("weight") + F.col("_gain")).when(giving & (F.col("_others") > 0), F.greatest(F.lit(0.0), F.col("weight") * (1 - F.col("_gain") / F.col("_others")))).otherwise(F.col("weight"))
    return moved.withColumn("weight", weight).select(*routes.columns, "avg_score", "promoted")


def missing_sources(expected: DataFrame, delivered: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected sources and periods of which nothing came."""
    return expected.select(*keys).join(delivered.select(*keys).distinct(), list(keys), "left_anti")
