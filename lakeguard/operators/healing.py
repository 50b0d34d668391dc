"""Gates on batches, conformal alarms, semantics of numeric columns, repairs and their control.

Numeric columns come in long form: key columns that name a batch, ``column`` and
``v``, with columns that order the rows of a batch.  What leaves the first
aggregation is a row for each batch and column.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Factors that undo errors of unit or scale, in the order in which they are tried.  Fixed values.
TRANSFORMS = (("x1000", 1000.0), ("x100", 100.0), ("x10", 10.0), ("div10", 0.1), ("div100", 0.01), ("div1000", 0.001), ("sec_to_ms", 1000.0), ("ms_to_sec", 0.001))
#: Multiple of the healthy distance that is drift, and share of its distance that a heal may leave.
DRIFT_K, ACCEPT = 3.0, 0.5
#: Rows of a batch whose decimals and last digits are looked at.
SAMPLE = 500
#: Severities from low to high.
SEVERITIES = ("low", "medium", "high", "critical")


# ------------------------------------------------------------ gates and alarms
def similarity_gate(similarities: DataFrame, source: str, order: str, tolerance: float = 0.25) -> DataFrame:
    """Adds threshold and allowed to ``similarities(source, order, similarity)``.

    The first batch of a source is its reference and passes.  The threshold is
    1 - tolerance until five similarities are known, then the mean of the last
    fifty, this one included, less two deviations, within 80 to 100 % of that.
    """
    run = Window.partitionBy(source).orderBy(order)
    last = run.rowsBetween(-49, 0)
    df = similarities.withColumn("_i", F.row_number().over(run)).withColumn("_s", F.when(F.col("_i") > 1, F.col("similarity")))
    base = 1 - tolerance
    adaptive = F.greatest(F.lit(base * 0.8), F.least(F.avg("_s").over(last) - 2 * F.stddev_samp("_s").over(last), F.lit(base)))
    df = df.withColumn("threshold", F.when(F.col("_i") <= 5, F.lit(base)).otherwise(adaptive))
    return df.withColumn("similarity", F.when(F.col("_i") == 1, 1.0).otherwise(F.col("similarity"))).withColumn("allowed", F.col("similarity") >= F.col("threshold")).drop("_i", "_s")


def first_drift(batches: DataFrame, keys: Sequence[str], found: Mapping[str, DataFrame]) -> DataFrame:
    """(keys…, kind, severity) of every batch: the first kind of ``found(keys…, severity)`` that has it, null if none has."""
    rows = None
    for rank, (kind, frame) in enumerate(found.items()):
        part = frame.filter("severity IS NOT NULL").select(*keys, F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), "severity").alias("hit"))
        rows = part if rows is None else rows.unionByName(part)
    first = rows.groupBy(*keys).agg(F.min("hit").alias("hit"))
    return batches.select(*keys).distinct().join(first, list(keys), "left").select(*keys, "hit.kind", "hit.severity")


def conformal_alarms(scores: DataFrame, source: str, order: str, score: str, tie: Column, warmup: int = 10, alpha: float = 0.01, grid: int = 100) -> DataFrame:
    """Adds p, wealth and alarm to ``scores``.

    p is the smoothed share of a source's earlier scores that are above this one,
    ``tie`` (0 to 1) deciding between equal ones; the first ``warmup`` batches have
    none.  A mixture of ``grid`` power bets on p makes the wealth; the batch at which
    it first reaches 1/alpha is the alarm.  A source has one row for each batch: they
    are folded in order, the earlier scores held sorted, so nothing is joined to all
    before it.
    """
    numbered = scores.withColumns({"_i": F.row_number().over(Window.partitionBy(source).orderBy(order)), "_tie": tie.cast("double")})
    stakes = (np.arange(grid) + 0.5) / grid

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        before: list[float] = []
        logs, best, out = np.zeros(grid), 0.0, []
        rows = rows.sort_values("_i")
        for who, i, c, u in zip(rows[source], rows["_i"].tolist(), rows[score].tolist(), rows["_tie"].tolist(), strict=True):
            p, wealth = None, 1.0
            if i > warmup:
                p = (len(before) - bisect_right(before, c) + u * (bisect_right(before, c) - bisect_left(before, c) + 1)) / i
                logs += np.log(stakes) + (stakes - 1) * math.log(min(max(p, 1e-6), 1.0))
                wealth = math.exp(logs.max()) * float(np.exp(logs - logs.max()).mean())
            out.append((who, i, p, wealth, wealth >= 1 / alpha > best))
            best = max(best, wealth)
            insort(before, c)
        return pd.DataFrame(out, columns=[source, "_i", "p", "wealth", "alarm"]).astype({"p": "float64"})

    kind = scores.schema[source].dataType.simpleString()
    small = numbered.select(source, "_i", F.col(score).cast("double").alias(score), "_tie")
    folded = small.groupBy(source).applyInPandas(fold, f"`{source}` {kind}, _i int, p double, wealth double, alarm boolean")
    return numbered.drop("_tie").join(folded.withColumn("p", F.nanvl("p", F.lit(None).cast("double"))), [source, "_i"]).drop("_i")


# ------------------------------------------------------------ numeric semantics
def encode(long: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """(keys…, column, f): sixteen features of each batch's column.

    Mean and deviation of the log scale, shares of whole, distinct, positive and
    negative values, mean and deviation of decimals, digits, share of round
    numbers, of rises, flags of the ranges [0, 1] and [0, 100], and three quantiles
    in interquartile ranges from the median.
    """
    by = [*keys, "column"]
    place = Window.partitionBy(*by).orderBy(*order)
    v = F.col("v")
    rows = long.filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))).withColumns({"_i": F.row_number().over(place), "_b": F.lag("v").over(place)})
    decimals = F.length(F.regexp_extract(F.format_string("%.6f", v), r"\.(\d*?)0*$", 1))
    rows = rows.withColumns({"_log": F.log10(F.abs(v) + 1), "_dec": F.when(F.col("_i") <= SAMPLE, decimals), "_round": F.when(F.col("_i") <= SAMPLE, ((F.pmod(F.rint(v), F.lit(10)) == 0) & (v != 0)).cast("int")), "_whole": (F.abs(v - F.rint(v)) <= 1e-8 + 1e-5 * F.abs(F.rint(v))).cast("int")})
    q = F.percentile("v", F.array(*map(F.lit, (0.05, 0.25, 0.5, 0.75, 0.95))))
    sums = rows.groupBy(*by).agg(
        F.avg("_log").alias("f0"), F.stddev_pop("_log").alias("f1"), F.avg("_whole").alias("f2"), (F.countDistinct("v") / F.count("v")).alias("f3"),
        F.avg((v > 0).cast("int")).alias("f4"), F.avg((v < 0).cast("int")).alias("f5"), F.avg("_dec").alias("f6"), F.stddev_pop("_dec").alias("f7"),
        F.avg(F.floor("_log") + 1).alias("f8"), F.avg("_round").alias("f9"), F.coalesce(F.avg((v > F.col("_b")).cast("int")), F.lit(0.0)).alias("f10"),
        (F.max(F.abs(v)) <= 1).cast("double").alias("f11"), ((F.min(v) >= 0) & (F.max(v) <= 100)).cast("double").alias("f12"), q.alias("q"),
    )
    wide = F.when(F.col("q")[3] > F.col("q")[1], F.col("q")[3] - F.col("q")[1]).otherwise(1.0)
    shape = [(F.col("q")[k] - F.col("q")[2]) / wide for k in (0, 1, 4)]
    return sums.select(*by, F.array(*[F.col(f"f{k}").cast("double") for k in range(13)], *shape).alias("f"))


def _each(features: DataFrame, *by: str) -> DataFrame:
    return features.select(*by, F.posexplode("f").alias("k", "x"))


def fit_baseline(healthy: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(column, k, mu, sigma) and (column, healthy_z) of the features of healthy batches."""
    spread = _each(healthy, *keys, "column").groupBy("column", "k").agg(F.avg("x").alias("mu"), F.greatest(F.stddev_pop("x"), F.lit(1e-9)).alias("sigma"))
    return spread, distances(healthy, spread, keys).groupBy("column").agg(F.avg("z").alias("healthy_z"))


def distances(features: DataFrame, spread: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys…, column, z): distance from the baseline in its deviations."""
    part = _each(features, *keys, "column").join(F.broadcast(spread), ["column", "k"])  # sixteen rows a column
    return part.groupBy(*keys, "column").agg(F.sqrt(F.sum(((F.col("x") - F.col("mu")) / F.col("sigma")) ** 2)).alias("z"))


def nearest_prototype(features: DataFrame, samples: DataFrame, keys: Sequence[str], sample_keys: Sequence[str]) -> DataFrame:
    """(keys…, column, type, distance, drifted) by the centroids of ``samples(sample_keys…, column, f)``, a type for each column."""
    centre = _each(samples, "column").groupBy(F.col("column").alias("type"), "k").agg(F.avg("x").alias("c"))
    around = _each(samples, *sample_keys, "column").join(centre.withColumnRenamed("type", "column"), ["column", "k"]).groupBy(*sample_keys, "column").agg(F.sqrt(F.sum((F.col("x") - F.col("c")) ** 2)).alias("r"))
    spread = around.groupBy(F.col("column").alias("type")).agg(F.avg("r").alias("spread"))
    met = _each(features, *keys, "column").join(F.broadcast(centre), "k").groupBy(*keys, "column", "type").agg(F.sqrt(F.sum((F.col("x") - F.col("c")) ** 2)).alias("distance"))
    best = met.groupBy(*keys, "column").agg(F.min(F.struct("distance", "type")).alias("b")).select(*keys, "column", "b.type", "b.distance")
    return best.join(F.broadcast(spread), "type").select(*keys, "column", "type", "distance", (F.col("distance") > 2 * F.col("spread")).alias("drifted"))


def heal_proposals(long: DataFrame, keys: Sequence[str], order: Sequence[str], baseline: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(keys…, column, drifted, z_before, transform, factor, z_after, healthy_z, accepted, confidence).

    The transform is the one that brings a batch nearest to the baseline, of
    equal ones the first, and "none" if none does; it is accepted if it leaves at
    most half of the distance and the rest is no drift.
    """
    spread, healthy = baseline
    tried = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(name).alias("transform"), F.lit(factor).alias("factor")) for i, (name, factor) in enumerate((("none", 1.0), *TRANSFORMS))])
    many = long.withColumn("t", F.explode(tried)).withColumn("v", F.col("v") * F.col("t.factor")).withColumn("rank", F.col("t.rank"))
    # rounded, as two factors that are equal give sums that differ in their last digits
    z = distances(encode(many, [*keys, "rank"], order), spread, [*keys, "rank"]).withColumn("z", F.round("z", 6))
    best = z.groupBy(*keys, "column").agg(F.max(F.when(F.col("rank") == 0, F.col("z"))).alias("z_before"), F.min(F.struct("z", "rank")).alias("b"))
    df = best.join(F.broadcast(healthy), "column").select(*keys, "column", "z_before", F.get(tried, F.col("b.rank"))["transform"].alias("transform"), F.get(tried, F.col("b.rank"))["factor"].alias("factor"), F.col("b.z").alias("z_after"), "healthy_z")
    limit = DRIFT_K * F.greatest("healthy_z", F.lit(1e-9))
    accepted = (F.col("z_after") <= ACCEPT * F.col("z_before")) & (F.col("z_after") <= limit) & (F.col("transform") != "none")
    confidence = F.when(accepted & (F.col("z_before") > 0), F.greatest(F.lit(0.0), 1 - F.col("z_after") / F.col("z_before"))).otherwise(0.0)
    return df.withColumns({"drifted": F.col("z_before") > limit, "accepted": accepted, "confidence": confidence})


def heal_control(proposals: DataFrame, source: str, order: str, confirm: int = 3, patience: int = 2) -> DataFrame:
    """Adds state, event, applied and applied_factor to a source's ``proposals``, batch after batch.

    A drifting batch that a transform heals opens a canary; ``confirm`` such batches
    in a row with the same transform commit it, anything else aborts.  While it is
    committed it is applied; ``patience`` batches in a row without drift revert it.
    A source and column has one row for each batch, which are folded in order.
    """
    schema = proposals.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ") + ", state string, event string, applied string, applied_factor double"

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        state, name, factor, seen, quiet, out = "observing", "none", 1.0, 0, 0, []
        for r in rows.itertuples():
            limit = DRIFT_K * max(r.healthy_z, 1e-9)
            by_ratio = r.transform != "none" and r.z_after <= ACCEPT * r.z_before
            event, applied = None, ("none", 1.0)
            if state == "observing" and r.drifted and by_ratio and r.z_after <= limit:
                name, factor, seen = r.transform, r.factor, 1
                state, event = "canary", "canary_open"
            elif state == "canary" and r.drifted and by_ratio and (name, factor) == (r.transform, r.factor):
                seen += 1
            elif state == "canary":
                state, event, name, factor, seen = "observing", "abort", "none", 1.0, 0
            elif state == "committed":
                quiet = 0 if r.drifted else quiet + 1
                if quiet >= patience:
                    state, event, name, factor, quiet = "observing", "revert", "none", 1.0, 0
                else:
                    applied = (name, factor)
            if state == "canary" and seen >= confirm:
                state, event, quiet, applied = "committed", "commit", 0, (name, factor)
            out.append((state, event, *applied))
        rows[["state", "event", "applied", "applied_factor"]] = pd.DataFrame(out, index=rows.index, dtype=object)
        rows["applied_factor"] = rows["applied_factor"].astype(float)
        return rows

    return proposals.groupBy(source, "column").applyInPandas(fold, schema)


# ------------------------------------------------------------ repairs
def repair_plan(drifts: DataFrame) -> DataFrame:
    """Adds cause, repair, confidence and hold to ``drifts(kind, added, removed, max_kl, zeta, shift)``.

    A location that moved by over three deviations is held for review.
    """
    kind, added, removed, ratio = F.col("kind"), F.col("added") > 0, F.col("removed") > 0, F.col("max_kl") / F.col("zeta")
    schema = kind == "schema_change"
    ladder = (
        (kind == "type_change", "column types changed", "cast", 0.85),
        (schema & removed & ~added, "columns removed", "fill_missing", 0.9),
        (schema & added & ~removed, "columns added", "drop_extra", 0.85),
        (schema, "columns renamed", "rename", 0.75),
        (ratio > 5, "severe distribution shift", "rescale", 0.7),
        (ratio > 2, "significant distribution drift", "clip", 0.8),
        (kind == "statistical", "mild statistical drift", "monitor", 0.85),
    )

    def pick(k: int) -> Column:
        out = F.lit(None)
        for step in reversed(ladder):
            out = F.when(step[0], F.lit(step[k])).otherwise(out)
        return out

    return drifts.withColumns({"cause": pick(1), "repair": pick(2), "confidence": pick(3), "hold": F.coalesce((kind == "statistical") & (F.col("shift") > 3), F.lit(False))})


def validate_repairs(outcomes: DataFrame, target: float = 0.5) -> DataFrame:
    """Adds passed to ``outcomes(pre_kl, post_kl, limit)``: no drift is left, or less than ``target`` of the divergence."""
    gone = F.col("post_kl") <= F.col("limit")
    return outcomes.withColumn("passed", F.coalesce(gone | ((F.col("pre_kl") > 0) & (F.col("post_kl") < F.col("pre_kl") * target)), F.lit(False)))


def select_repair(outcomes: DataFrame, keys: Sequence[str], candidate: str = "candidate") -> DataFrame:
    """The candidate of ``outcomes(keys…, candidate, before, after)`` that improves most, of equal ones the first by name; failed ones have no ``after``."""
    df = outcomes.filter("after IS NOT NULL").withColumn("improvement", F.col("before") - F.col("after"))
    best = df.groupBy(*keys).agg(F.min(F.struct((-F.col("improvement")).alias("worse"), F.col(candidate).alias("c"), "improvement")).alias("b"))
    half = F.abs("improvement") * 0.2 + 0.05
    return best.select(*keys, F.col("b.c").alias(candidate), F.col("b.improvement").alias("improvement")).withColumns({"ci_lower": F.col("improvement") - half, "ci_upper": F.col("improvement") + half})


def score_candidates(batches: DataFrame, candidates: Mapping[str, Callable[[DataFrame], DataFrame]], keys: Sequence[str], score: Column) -> DataFrame:
    """(keys…, candidate, before, after): any aggregate ``score`` of the batches as they are and after each candidate's repair.

    ``score`` may be built-in aggregates or a grouped-aggregate pandas UDF.  A candidate whose plan Spark
    cannot analyse has no ``after``, so ``select_repair`` never takes it; rows with a null key take no part.
    """
    before = batches.groupBy(*keys).agg(score.cast("double").alias("before"))
    parts = []
    for name, repair in candidates.items():
        try:
            after = repair(batches).groupBy(*keys).agg(score.cast("double").alias("after"))
        except AnalysisException:
            after = before.select(*keys, F.lit(None).cast("double").alias("after"))
        parts.append(after.withColumn("candidate", F.lit(name)))
    return reduce(DataFrame.unionByName, parts).join(before, list(keys)).select(*keys, "candidate", "before", "after")


def deploy_gate(repairs: DataFrame, auto: bool = True, tiered: bool = True, mode: str = "auto") -> DataFrame:
    """Adds deploy to ``repairs(method, severity)``: made by a template, of low or medium severity, in automatic mode."""
    fine = (F.coalesce("method", F.lit("template")) == "template") & F.lower(F.coalesce("severity", F.lit("medium"))).isin("low", "medium")
    return repairs.withColumn("deploy", F.lit(False) if not auto else F.lit(True) if not tiered else F.lit(False) if mode != "auto" else fine)


Repair = Callable[[DataFrame], DataFrame]


def apply_repairs(df: DataFrame, repairs: Sequence[tuple[str, Repair, bool]]) -> tuple[DataFrame, list[str]]:
    """The rows after all active repairs (name, function, active) in order, and the names applied.

    A repair whose plan Spark cannot analyse stops the chain before it.
    """
    done: list[str] = []
    for name, repair, active in repairs:
        if not active:
            continue
        try:
            following = repair(df)
            _ = following.schema
        except AnalysisException:
            break
        df = following
        done.append(name)
    return df, done


def roll_back(repairs: Sequence[tuple[str, Repair, bool]]) -> list[tuple[str, Repair, bool]]:
    """The repairs with the last active one made inactive."""
    last = max((i for i, r in enumerate(repairs) if r[2]), default=-1)
    return [(name, repair, active and i != last) for i, (name, repair, active) in enumerate(repairs)]


def gated(batches: DataFrame, drifts: DataFrame, keys: Sequence[str], repair: Repair, severity: str = "medium") -> tuple[DataFrame, DataFrame]:
    """(rows for the lake, rows held): batches that drift below ``severity`` as they are, others repaired.

    Batches whose repair fails validation, ``drifts(keys…, severity, healed)`` with healed false, are held.
    """
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity")), F.lit(0))
    marked = batches.join(drifts.select(*keys, (rank >= SEVERITIES.index(severity) + 1).alias("_hit"), F.coalesce("healed", F.lit(False)).alias("_healed")), list(keys), "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))
    clean, mended = marked.filter("NOT _hit"), repair(marked.filter("_hit AND _healed"))
    return clean.drop("_hit", "_healed").unionByName(mended.drop("_hit", "_healed")), marked.filter("_hit AND NOT coalesce(_healed, false)").drop("_hit", "_healed")


# ------------------------------------------------------------ versions, status, alerts
def active_versions(activations: DataFrame, source: str, version: str, at: Sequence[str]) -> DataFrame:
    """(source, version): the one activated last; activating an older one again is a rollback."""
    return activations.groupBy(source).agg(F.max_by(version, F.struct(*at)).alias(version))


def source_status(events: DataFrame, baselines: DataFrame, repairs: DataFrame, source: str, at: Sequence[str], last: int = 3) -> DataFrame:
    """Per source that any table knows: its latest events, whether it has a baseline, and its active repairs."""
    ranked = events.withColumn("_i", F.row_number().over(Window.partitionBy(source).orderBy(*[F.desc(c) for c in at])))
    recent = ranked.filter(F.col("_i") <= last).groupBy(source).agg(F.count("*").alias("recent"), F.max(at[0]).alias("latest"))
    known = baselines.select(source).distinct().withColumn("has_baseline", F.lit(True))
    active = repairs.filter("active").groupBy(source).agg(F.count("*").alias("deployed"))
    all_ = recent.join(known, source, "full_outer").join(active, source, "full_outer")
    return all_.select(source, F.coalesce("recent", F.lit(0)).alias("recent"), "latest", F.coalesce("has_baseline", F.lit(False)).alias("has_baseline"), F.coalesce("deployed", F.lit(0)).alias("deployed"))


def healing_alerts(scores: DataFrame, source: str, order: str, floors: Mapping[str, float], least_total: int = 3) -> DataFrame:
    """(source, order, metric, level, value) where a score of ``scores`` is below its floor, or composite fell five times in a row."""
    low = [F.when((F.col("total") >= least_total) & (F.col(m) < floor), F.struct(F.lit(m).alias("metric"), F.lit("critical" if m in ("composite", "quality") else "warning").alias("level"), F.col(m).cast("double").alias("value"))) for m, floor in floors.items()]
    run = Window.partitionBy(source).orderBy(order)
    falls = F.lit(True)
    for k in range(4):
        falls = falls & F.coalesce(F.lag("composite", k + 1).over(run) > (F.lag("composite", k).over(run) if k else F.col("composite")), F.lit(False))
    df = scores.withColumn("_falls", falls)
    trend = F.when(F.col("_falls"), F.struct(F.lit("trend").alias("metric"), F.lit("warning").alias("level"), F.col("composite").cast("double").alias("value")))
    return df.select(source, order, F.explode(F.filter(F.array(*low, trend), lambda x: x.isNotNull())).alias("a")).select(source, order, "a.*")
