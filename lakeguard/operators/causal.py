"""Effect estimates from moments, their checks, and root-cause ranking."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeguard.functions.ranking import global_rank, moments, nearest_known, order_statistics, running_total
from lakeguard.functions.storage import cut

RESULT = "method string, point double, ci_lower double, ci_upper double, n long"


def _matrix(row: dict, columns: Sequence[str]) -> tuple[np.ndarray, int]:
    """Second moments about zero, the constant first, from one row of ``moments``."""
    k = len(columns) + 1
    m = np.zeros((k, k))
    m[0, 0] = row["n"]
    for i, a in enumerate(columns, 1):
        m[0, i] = m[i, 0] = row[f"s_{a}"] or 0.0
        for j, b in enumerate(columns[i - 1 :], i):
            m[i, j] = m[j, i] = row[f"p_{a}_{b}"] or 0.0
    return m, int(row["n"])


def ols_effect(df: DataFrame, treatment: str, outcome: str, confounders: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Back-door linear regression, one job for all segments: the coefficient of the treatment and its interval.

    Only a segment's moments come to the driver, (p + 3)² numbers for each.
    """
    columns = [treatment, *confounders, outcome]
    rows = []
    for r in moments(df, columns, keys).collect():
        m, n = _matrix(r.asDict(), columns)
        xx, xy, yy = m[:-1, :-1], m[:-1, -1], m[-1, -1]
        inverse = np.linalg.pinv(xx)
        beta = inverse @ xy
        free = max(1, n - len(beta))
        error = np.sqrt(max(0.0, (yy - beta @ xy) / free) * max(0.0, inverse[1, 1]))
        rows.append((*[str(r[k]) for k in keys], "ols", float(beta[1]), float(beta[1] - 1.96 * error), float(beta[1] + 1.96 * error), n))
    head = "".join(f"{k} string, " for k in keys)
    return df.sparkSession.createDataFrame(rows, head + RESULT)


def two_stage(df: DataFrame, treatment: str, outcome: str, instruments: Sequence[str], confounders: Sequence[str] = ()) -> DataFrame:
    """Two-stage least squares, both stages from one moment matrix."""
    columns = [treatment, *confounders, *instruments, outcome]
    m, n = _matrix(moments(df, columns).first().asDict(), columns)
    k = len(confounders)
    x = [0, 1, *range(2, 2 + k)]
    z = [0, *range(2, 2 + k + len(instruments))]
    y = len(columns)
    zz = np.linalg.pinv(m[np.ix_(z, z)])
    xz = m[np.ix_(x, z)]
    bread = np.linalg.pinv(xz @ zz @ xz.T)
    beta = bread @ xz @ zz @ m[z, y]
    rest = m[y, y] - 2 * beta @ m[x, y] + beta @ m[np.ix_(x, x)] @ beta
    error = np.sqrt(max(0.0, rest / max(1, n - len(x))) * max(0.0, bread[1, 1]))
    return df.sparkSession.createDataFrame([("iv_2sls", float(beta[1]), float(beta[1] - 1.96 * error), float(beta[1] + 1.96 * error), n)], RESULT)


def stratified_ipw(df: DataFrame, treatment: str, outcome: str, strata: Sequence[str]) -> DataFrame:
    """Hájek weights from the treated share of each stratum; strata without both arms take no part."""
    t, y = F.col(treatment).cast("double"), F.col(outcome).cast("double")
    cells = df.groupBy(*strata).agg(F.count("*").alias("n"), F.sum(t).alias("t"), F.sum(t * y).alias("ty"), F.sum((1 - t) * y).alias("cy")).filter("t > 0 AND t < n")
    return cells.agg((F.sum(F.col("ty") * F.col("n") / F.col("t")) / F.sum("n") - F.sum(F.col("cy") * F.col("n") / (F.col("n") - F.col("t"))) / F.sum("n")).alias("point"), F.sum("n").alias("n")).select(F.lit("ipw").alias("method"), "point", "n")


def logistic_ipw(df: DataFrame, treatment: str, outcome: str, confounders: Sequence[str], clip: float = 0.025) -> DataFrame:
    """Propensity weighting with a logistic model fitted by Spark."""
    scored = propensity(df, treatment, confounders, clip)
    t, y, e = F.col(treatment).cast("double"), F.col(outcome).cast("double"), F.col("propensity")
    point = F.sum(t * y / e) / F.sum(t / e) - F.sum((1 - t) * y / (1 - e)) / F.sum((1 - t) / (1 - e))
    return scored.agg(point.alias("point"), F.count("*").alias("n")).select(F.lit("ipw").alias("method"), "point", "n")


def propensity(df: DataFrame, treatment: str, confounders: Sequence[str], clip: float = 0.025) -> DataFrame:
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    ready = VectorAssembler(inputCols=list(confounders), outputCol="_x", handleInvalid="skip").transform(df.withColumn(treatment, F.col(treatment).cast("double")))
    model = LogisticRegression(featuresCol="_x", labelCol=treatment, probabilityCol="_p").fit(ready)
    e = F.greatest(F.least(vector_to_array("_p")[1], F.lit(1 - clip)), F.lit(clip))
    return model.transform(ready).withColumn("propensity", e).drop("_x", "_p", "rawPrediction", "prediction")


def summed_up(df: DataFrame, treatment: str, outcome: str, confounders: Sequence[str], row_id: Sequence[str], folds: int, parts: int = 1) -> tuple[DataFrame, list[str]]:
    """Cells (_fold, t, confounders, _part) with the number w of their rows, their mean outcome y and its squares _off about that mean; and the confounders' names there.

    Rows are read once, and the cells are kept.  Folds follow a hash of the row's id, another one deals a cell's
    rows into ``parts``.  Rows with a null take no part.
    """
    names = [f"_c{i}" for i in range(len(confounders))] or ["_none"]
    dealt = [F.pmod(F.xxhash64(*row_id), F.lit(folds)).alias("_fold"), F.pmod(F.xxhash64(F.lit("part"), *row_id), F.lit(parts)).alias("_part")]
    values = [F.col(treatment).cast("double").alias("t"), F.col(outcome).cast("double").alias("y"), *[F.col(c).cast("double").alias(f"_c{i}") for i, c in enumerate(confounders)], F.lit(0.0).alias("_none")]
    known = df.na.drop(subset=[treatment, outcome, *confounders]).select(*dealt, *values)
    return cut(known.groupBy("_fold", "t", *names, "_part").agg(F.count("*").cast("double").alias("w"), F.avg("y").alias("y"), (F.var_pop("y") * F.count("*")).alias("_off"))), names


def cross_fitted(df: DataFrame, treatment: str, outcome: str, confounders: Sequence[str], row_id: Sequence[str], folds: int = 2, clip: float = 0.025) -> DataFrame:
    """(t, y, w, _off, e, m0, m1): clipped logistic propensity and linear outcomes by arm of each cell of equal rows, fitted on the other folds.

    A cell stands for ``w`` rows with the mean outcome ``y`` and the squares ``_off`` about it: both models need no
    more of rows with equal confounders.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    cells, names = summed_up(df, treatment, outcome, confounders, row_id, folds)
    ready = VectorAssembler(inputCols=names, outputCol="_x").transform(cells)
    columns = [*names, "y"]
    fitted = []
    for k in range(folds):
        train, test = ready.filter(F.col("_fold") != k), ready.filter(F.col("_fold") == k)
        model = LogisticRegression(featuresCol="_x", labelCol="t", weightCol="w", probabilityCol="_p").fit(train)
        means = {}
        for arm in (0, 1):
            m, _ = _matrix(moments(train.filter(F.col("t") == arm), columns, weight="w").first().asDict(), columns)
            beta = np.linalg.pinv(m[:-1, :-1]) @ m[:-1, -1]
            means[arm] = sum((F.col(c) * float(b) for c, b in zip(names, beta[1:], strict=True)), F.lit(float(beta[0])))
        e = F.greatest(F.least(vector_to_array("_p")[1], F.lit(1 - clip)), F.lit(clip))
        fitted.append(model.transform(test).select("t", "y", "w", "_off", e.alias("e"), means[0].alias("m0"), means[1].alias("m1")))
    return reduce(DataFrame.unionByName, fitted)


def _interval(cells: DataFrame, influence: str, slope: str, method: str) -> DataFrame:
    """The mean of a column over all rows with its normal interval; inside a cell the column is a line over the outcome."""
    mean = cells.agg(F.try_divide(F.sum(F.col("w") * F.col(influence)), F.sum("w")).alias("point"), F.sum("w").cast("long").alias("n"))
    gap = F.col(influence) - F.col("point")
    squares = F.sum(F.col("w") * gap * gap + F.col(slope) * F.col(slope) * F.col("_off"))
    one = cells.join(F.broadcast(mean)).groupBy("point", "n").agg(squares.alias("_squares"))
    half = one.withColumn("h", 1.96 * F.sqrt(F.try_divide("_squares", F.col("n") - 1)) / F.sqrt("n"))
    return half.select(F.lit(method).alias("method"), "point", (F.col("point") - F.col("h")).alias("ci_lower"), (F.col("point") + F.col("h")).alias("ci_upper"), "n")


def doubly_robust(df: DataFrame, treatment: str, outcome: str, confounders: Sequence[str], row_id: Sequence[str], folds: int = 2) -> DataFrame:
    """Cross-fitted AIPW.  Rows with a null take no part."""
    cells = cross_fitted(df, treatment, outcome, confounders, row_id, folds).withColumn("h", F.expr("t / e - (1 - t) / (1 - e)"))
    return _interval(cells.withColumn("psi", F.expr("m1 - m0 + h * (y - if(t = 1, m1, m0))")), "psi", "h", "aipw")


def tmle(df: DataFrame, treatment: str, outcome: str, confounders: Sequence[str], row_id: Sequence[str], folds: int = 2) -> DataFrame:
    """Targeted maximum likelihood: outcomes moved by one step along the clever covariate, interval from the influence curve.

    Rows with a null take no part.
    """
    cells = cross_fitted(df, treatment, outcome, confounders, row_id, folds).withColumn("h", F.expr("t / e - (1 - t) / (1 - e)")).withColumn("r", F.expr("y - if(t = 1, m1, m0)"))
    step = cells.agg(F.coalesce(F.try_divide(F.sum(F.expr("w * h * r")), F.sum(F.expr("w * h * h"))), F.lit(0.0)).alias("eps"))
    moved = cells.join(F.broadcast(step)).withColumn("gap", F.expr("m1 - m0 + eps / e + eps / (1 - e)"))
    # the targeted residuals weigh to zero, so the mean of the influence curve is the estimate
    return _interval(moved.withColumn("ic", F.expr("gap + h * (r - eps * h)")), "ic", "h", "tmle")


#: Parts into which the rows of a cell (fold, treatment, confounders) are dealt; a forest's bags are drawn of these.
CELL_PARTS = 64


def forest_effect(df: DataFrame, treatment: str, outcome: str, confounders: Sequence[str], row_id: Sequence[str], folds: int = 2, rounds: int = 20, trees: int = 48, clip: float = 0.025, seed: int = 1) -> DataFrame:
    """One row (method, point, ci_lower, ci_upper, n, cate): boosted nuisances, cross-fitted, and a forest on the doubly robust scores.

    ``cate`` holds ten quantiles, 0.05 to 0.95, of the effects that the forest gives to the rows; the point
    is their mean and the interval that of the scores.  Rows with a null take no part.  Where an arm has
    fewer than two rows a fold the numbers are null.  Every fit is made of Spark's distributed trees.

    The rows are read once and summed up by cells of equal confounders, as trees that split by sums of
    squares need no more than a cell's rows and mean.  A cell's rows are dealt into CELL_PARTS by a hash; a bag
    draws parts, which are single rows where a cell has few.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    parts, names = summed_up(df, treatment, outcome, confounders, row_id, folds, CELL_PARTS)
    cell = ["_fold", "t", *names]
    n, treated = parts.agg(F.coalesce(F.sum("w"), F.lit(0.0)).cast("long"), F.coalesce(F.sum(F.col("w") * F.col("t")), F.lit(0.0))).first()
    spark, schema = df.sparkSession, f"{RESULT}, cate array<double>"
    if min(treated, n - treated) < 2 * folds:
        return spark.createDataFrame([("forest_dr", None, None, None, n, None)], schema)

    def at(rows: DataFrame, arm: Column, to: str) -> DataFrame:
        return VectorAssembler(inputCols=["_arm", *names], outputCol=to).transform(rows.withColumn("_arm", arm)).drop("_arm")

    cells = parts.groupBy(*cell).agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("y"), F.sum("w").alias("w"))
    cells = VectorAssembler(inputCols=names, outputCol="_x").transform(cells)
    cells = cut(at(at(at(cells, F.col("t"), "_seen"), F.lit(0.0), "_at0"), F.lit(1.0), "_at1"))
    fitted = []
    for k in range(folds):
        train, test = cells.filter(F.col("_fold") != k), cells.filter(F.col("_fold") == k)
        odds = GBTClassifier(featuresCol="_x", labelCol="t", weightCol="w", maxIter=rounds, maxDepth=3, seed=seed).fit(train)
        mean = GBTRegressor(featuresCol="_seen", labelCol="y", weightCol="w", maxIter=rounds, maxDepth=3, seed=seed).fit(train)
        for arm in (0, 1):
            test = mean.setFeaturesCol(f"_at{arm}").setPredictionCol(f"m{arm}").transform(test)
        e = F.greatest(F.least(vector_to_array("probability")[1], F.lit(1 - clip)), F.lit(clip))
        # the score is m1 - m0 + t (y - m1) / e - (1 - t) (y - m0) / (1 - e): in a cell a line over y
        line = [F.expr("m1 - m0 - t * m1 / e + (1 - t) * m0 / (1 - e)").alias("_base"), F.expr("t / e - (1 - t) / (1 - e)").alias("_slope")]
        fitted.append(odds.transform(test).withColumn("e", e).select(*cell, "_x", *line))
    scores = parts.join(reduce(DataFrame.unionByName, fitted), cell).withColumn("psi", F.col("_base") + F.col("_slope") * F.col("y")).withColumn("_off", F.col("_slope") * F.col("_slope") * F.col("_off"))
    # in a fixed order, as bags are drawn row by row
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    scores = cut(scores.repartition(tasks, *cell, "_part").sortWithinPartitions(*cell, "_part"))
    least = min(0.49, max(10, n // 30) / n)
    forest = RandomForestRegressor(featuresCol="_x", labelCol="psi", weightCol="w", predictionCol="effect", numTrees=trees, maxDepth=5, subsamplingRate=0.5, minWeightFractionPerNode=least, seed=seed).fit(scores)
    effects = forest.transform(VectorAssembler(inputCols=names, outputCol="_x").transform(scores.groupBy(*names).agg(F.sum("w").alias("w"))))
    places = {f"q{i}": (F.col("n") - 1) * (0.05 + 0.1 * i) for i in range(10)}
    picks = {f"{k}_{side}": f(v) for k, v in places.items() for side, f in (("low", F.floor), ("high", F.ceil))}
    found = order_statistics(effects, "effect", picks, "w")
    cate = F.array(*[F.col(f"{k}_low") + (F.col(f"{k}_high") - F.col(f"{k}_low")) * (v - F.floor(v)) for k, v in places.items()])
    centre = scores.agg((F.sum(F.col("w") * F.col("psi")) / n).alias("_mean"))
    squares = scores.join(F.broadcast(centre)).agg(F.sum(F.col("w") * F.pow(F.col("psi") - F.col("_mean"), 2) + F.col("_off")).alias("_squares"))
    half = (1.96 * F.sqrt(F.col("_squares") / (n - 1)) / F.sqrt(F.lit(n))).alias("h")
    one = effects.agg((F.sum(F.col("w") * F.col("effect")) / n).alias("point")).crossJoin(squares.select(half))
    return one.crossJoin(found.select("n", cate.alias("cate"))).select(F.lit("forest_dr").alias("method"), "point", (F.col("point") - F.col("h")).alias("ci_lower"), (F.col("point") + F.col("h")).alias("ci_upper"), "n", "cate")


def match_on_score(df: DataFrame, treatment: str, outcome: str, score: str) -> DataFrame:
    """(att, ate, n): each row against the nearest score of the other arm, with replacement.

    Rows of one score and arm are one candidate with their mean outcome, so ties
    need no choice and a frequent score is one row; of two equally near scores
    the lower counts.  Null scores and outcomes take no part.
    """
    rows = df.filter(F.col(score).isNotNull() & F.col(outcome).isNotNull() & F.col(treatment).isNotNull())
    t, y = F.col(treatment).cast("double"), F.col(outcome).cast("double")
    cells = rows.groupBy(F.col(score).cast("double").alias("s")).agg(F.sum(t).alias("n1"), F.sum(1 - t).alias("n0"), F.sum(t * y).alias("y1"), F.sum((1 - t) * y).alias("y0"))
    for arm in "01":
        n, total = F.col(f"n{arm}"), F.col(f"y{arm}")
        cells = nearest_known(cells.withColumn(f"c{arm}", F.when(n > 0, F.struct(F.col("s").alias("at"), (total / n).alias("mean")))), "s", f"c{arm}")

    def other(arm: str) -> Column:
        low, high = F.col(f"c{arm}_before"), F.col(f"c{arm}_after")
        return F.when(low.isNull() | (high["at"] - F.col("s") < F.col("s") - low["at"]), high["mean"]).otherwise(low["mean"])

    treated, control = F.sum(F.col("y1") - F.col("n1") * other("0")), F.sum(F.col("n0") * other("1") - F.col("y0"))
    n1, n0 = F.sum("n1"), F.sum("n0")
    return cells.agg(F.try_divide(treated, n1).alias("att"), F.try_divide(treated + control, n1 + n0).alias("ate"), (n1 + n0).cast("long").alias("n"))


def propensity_matching(df: DataFrame, treatment: str, outcome: str, confounders: Sequence[str]) -> DataFrame:
    """Matching on the logistic propensity."""
    return match_on_score(propensity(df, treatment, confounders), treatment, outcome, "propensity").select(F.lit("psm").alias("method"), F.col("ate").alias("point"), "n")


# ------------------------------------------------------------ checks
def conformal_half_width(scores: DataFrame, score: str, alpha: float = 0.1) -> DataFrame:
    """The ⌈(n + 1)(1 − α)⌉-th smallest score of at least 50."""
    ranked = global_rank(scores.filter(F.col(score).isNotNull()), [F.col(score)])
    total = scores.agg(F.count(score).alias("n"))
    k = F.least(F.ceil((F.col("n") + 1) * (1 - alpha)), F.col("n"))
    return ranked.join(F.broadcast(total)).filter((F.col("n") >= 50) & (F.col("pos") + 1 == k)).select(F.col(score).alias("half_width"), "n")


def weighted_half_width(scores: DataFrame, score: str, weight: str, alpha: float = 0.1) -> DataFrame:
    """(half_width, n): the least score up to which the weights come to 1 − α of all weights and 1, the new row's own.

    Infinite where all weights are too few for that.  Rows with a null score or
    weight take no part; negative weights are an error; scores without any weight
    give no row.  Equal scores are summed before they are put in order.
    """
    clean = scores.filter(F.col(score).isNotNull() & F.col(weight).isNotNull())
    w = F.when(F.col(weight) < 0, F.raise_error(F.lit("weights must not be negative"))).otherwise(F.col(weight).cast("double"))
    levels = clean.groupBy(F.col(score).alias("_s")).agg(F.sum(w).alias("_w"), F.count("*").alias("_n"))
    total = levels.agg(F.sum("_w").alias("_all"), F.sum("_n").alias("n"))
    run = running_total(levels, [F.col("_s")], "_w", "_up").join(F.broadcast(total))
    found = run.agg(F.min(F.when(F.col("_up") / (F.col("_all") + 1) >= 1 - alpha, F.col("_s"))).alias("_q"), F.max("n").alias("n"), F.max("_all").alias("_all"))
    return found.filter("_all > 0").select(F.coalesce("_q", F.lit(float("inf"))).alias("half_width"), "n")


def split_conformal(df: DataFrame, value: str, weight: str, held: Column, alpha: float = 0.1) -> DataFrame:
    """(centre, half_width, n): the mean of the rows that are not held out, and the weighted half width of the others' distances from it."""
    centre = df.filter(~held).agg(F.avg(value).alias("centre"))
    scored = df.filter(held).join(F.broadcast(centre)).select(F.abs(F.col(value) - F.col("centre")).alias("_score"), F.col(weight).alias("_weight"))
    return weighted_half_width(scored, "_score", "_weight", alpha).join(F.broadcast(centre)).select("centre", "half_width", "n")


def propensity_diagnostics(scored: DataFrame, column: str = "propensity") -> DataFrame:
    e = F.col(column)
    out = F.avg((~e.between(0.05, 0.95)).cast("double"))
    return scored.agg(F.min(e).alias("least"), F.max(e).alias("most"), F.avg(e).alias("mean"), *[F.percentile(e, p).alias(f"p{round(100 * p):02d}") for p in (0.05, 0.25, 0.5, 0.75, 0.95)], out.alias("outside")).withColumn("warn", F.col("outside") > 0.10)


def sensitivity(estimates: DataFrame, outcome_sd: float) -> DataFrame:
    """E-value of each estimate, by the approximate risk ratio exp(0.91 · d), and the robustness value of its t."""
    d = F.abs(F.col("point")) / outcome_sd
    rr = F.exp(0.91 * d)
    se = (F.col("ci_upper") - F.col("ci_lower")) / (2 * 1.96)
    f = F.abs(F.col("point")) / se / F.sqrt(F.col("n"))
    robust = 0.5 * (F.sqrt(F.pow(f, 4) + 4 * f * f) - f * f)
    return estimates.withColumn("e_value", rr + F.sqrt(rr * (rr - 1))).withColumn("robustness", robust)


def confidence(estimates: DataFrame, pass_rate: float, severe: bool) -> DataFrame:
    """0.5 · refuters passed + 0.4 · share of overlapping intervals − 0.3 if a challenge is severe."""
    a, b = estimates.alias("a"), estimates.alias("b")
    pairs = a.join(b, F.col("a.method") < F.col("b.method")).agg(F.coalesce(F.avg(((F.col("a.ci_lower") <= F.col("b.ci_upper")) & (F.col("b.ci_lower") <= F.col("a.ci_upper"))).cast("double")), F.lit(1.0)).alias("overlap"))
    score = 0.5 * pass_rate + 0.4 * F.col("overlap") - (0.3 if severe else 0.0)
    return pairs.select("overlap", score.alias("score")).withColumn("level", F.when(F.col("score") > 0.7, "high").when(F.col("score") > 0.4, "medium").otherwise("low"))


def verdict(estimates: DataFrame, material: float = 0.02) -> DataFrame:
    """empty, not_material, not_significant or detected."""
    one = estimates.agg(F.count("*").alias("n"), F.avg("point").alias("point"), F.coalesce(F.bool_and((F.col("ci_lower") <= 0) & (F.col("ci_upper") >= 0)), F.lit(True)).alias("spans"))
    return one.select("point", F.when(F.col("n") == 0, "empty").when(F.abs("point") < material, "not_material").when(F.col("spans"), "not_significant").otherwise("detected").alias("verdict"))


def refute_placebo(df: DataFrame, treatment: str, outcome: str, confounders: Sequence[str], row_id: Sequence[str], seed: int = 1) -> DataFrame:
    """The effect of a permuted treatment, which should be none."""
    a = global_rank(df, [F.xxhash64(F.lit(seed), *row_id), *[F.col(c) for c in row_id]]).withColumnRenamed("pos", "_k").drop(treatment)
    b = global_rank(df.select(treatment, *row_id), [F.xxhash64(F.lit(seed + 1), *row_id), *[F.col(c) for c in row_id]]).select(F.col("pos").alias("_k"), treatment)
    return ols_effect(a.join(b, "_k"), treatment, outcome, confounders).withColumn("method", F.lit("placebo"))


def refuters(df: DataFrame, treatment: str, outcome: str, confounders: Sequence[str], row_id: Sequence[str], share: float = 0.8, seed: int = 1) -> DataFrame:
    """(refuter, baseline, refuted, passed): placebo treatment, a random common cause, a subset of the rows.

    A placebo's effect must be within 20 % of the baseline's size, or 0.1, of none;
    the others' within as much of the baseline.
    """
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *row_id), 11) + 0.5) / float(1 << 53)
    noise = df.withColumn("_noise", uniform)
    found = [
        ("placebo", refute_placebo(df, treatment, outcome, confounders, row_id, seed)),
        ("random_common_cause", ols_effect(noise, treatment, outcome, [*confounders, "_noise"])),
        ("data_subset", ols_effect(noise.filter(F.col("_noise") < share), treatment, outcome, confounders)),
    ]
    base = ols_effect(df, treatment, outcome, confounders).select(F.col("point").alias("baseline"))
    out = None
    for name, frame in found:
        row = frame.select(F.lit(name).alias("refuter"), F.col("point").alias("refuted"))
        out = row if out is None else out.unionByName(row)
    limit = F.greatest(F.abs("baseline") * 0.2, F.lit(0.1))
    centre = F.when(F.col("refuter") == "placebo", 0.0).otherwise(F.col("baseline"))
    return out.join(F.broadcast(base)).select("refuter", "baseline", "refuted", (F.abs(F.col("refuted") - centre) < limit).alias("passed"))


def unobserved_cause(df: DataFrame, treatment: str, outcome: str, confounders: Sequence[str], on_treatment: Sequence[float] = (0.1, 0.25, 0.5), on_outcome: Sequence[float] = (0.1, 0.25, 0.5)) -> DataFrame:
    """(on_treatment, on_outcome, baseline, added, corrected, passed) over a grid of strengths, solved from one moment matrix.

    Strengths are shares of the deviations that treatment and outcome keep when
    the confounders are taken out; the cause has variance 1 and nothing to do with
    the confounders.  ``added`` is the estimate after such a cause has been put into
    the data; ``corrected`` the effect if the data had one already.  A row passes if
    ``added`` stays within 20 % of the baseline's size, or 0.1.
    """
    columns = [treatment, *confounders, outcome]
    m, _ = _matrix(moments(df, columns).first().asDict(), columns)
    n, known = m[0, 0], [0, *range(2, 2 + len(confounders))]
    pair = [1, len(columns)]
    # what the constant and the confounders leave of treatment and outcome
    rest = (m[np.ix_(pair, pair)] - m[np.ix_(pair, known)] @ np.linalg.pinv(m[np.ix_(known, known)]) @ m[np.ix_(known, pair)]) / n
    v, c = rest[0, 0], rest[0, 1]
    base = c / v
    limit = max(abs(base) * 0.2, 0.1)
    rows = []
    for f in on_treatment:
        for g in on_outcome:
            a, b = f * np.sqrt(v), g * np.sqrt(rest[1, 1])
            added = (c + a * b) / (v + a * a)
            rows.append((float(f), float(g), float(base), float(added), float(base - a * b / v), bool(abs(added - base) < limit)))
    return df.sparkSession.createDataFrame(rows, "on_treatment double, on_outcome double, baseline double, added double, corrected double, passed boolean")


# ------------------------------------------------------------ causal graphs
def descendants(edges: DataFrame, start: DataFrame, without: Sequence[str] = (), rounds: int = 1000) -> DataFrame:
    """(origin, node): all that edges(src, dst) lead to from ``start(origin)``, not by way of the nodes ``without``; cycles end."""
    links = edges.select("src", "dst").distinct().filter(~F.col("src").isin(list(without)) & ~F.col("dst").isin(list(without)))
    found = cut(start.select("origin", F.col("origin").alias("node")).distinct())
    fresh = found
    for _ in range(rounds):
        step = fresh.join(links, fresh["node"] == links["src"]).select("origin", F.col("dst").alias("node")).distinct()
        fresh = cut(step.join(found, ["origin", "node"], "left_anti"))
        if fresh.isEmpty():
            return found.filter("origin <> node")
        found = cut(found.unionByName(fresh))
    raise RuntimeError(f"the graph has paths of over {rounds} edges")


def instruments(edges: DataFrame, treatment: str, outcome: str) -> DataFrame:
    """(instrument, other_path): the parents of the treatment that are no parents of the outcome, by name.

    ``other_path`` marks those that lead to the outcome by a way that does not pass
    the treatment, which are no valid instruments.
    """
    into = edges.filter(F.col("dst") == treatment).select(F.col("src").alias("instrument")).distinct()
    direct = edges.filter(F.col("dst") == outcome).select(F.col("src").alias("instrument")).distinct()
    chosen = into.join(direct, "instrument", "left_anti").filter(F.col("instrument") != outcome)
    around = descendants(edges, chosen.select(F.col("instrument").alias("origin")), [treatment]).filter(F.col("node") == outcome).select(F.col("origin").alias("instrument"), F.lit(True).alias("_way")).distinct()
    return chosen.join(around, "instrument", "left").select("instrument", F.coalesce("_way", F.lit(False)).alias("other_path")).orderBy("instrument")


def graph_effect(df: DataFrame, edges: DataFrame, treatment: str, outcome: str) -> DataFrame:
    """Two-stage least squares with the valid instruments that the graph names and the common parents as confounders."""
    named = [r.instrument for r in instruments(edges, treatment, outcome).filter("NOT other_path").collect()]  # columns of df
    if not named:
        raise ValueError(f"the graph has no instrument for {treatment} on {outcome}")
    parents = edges.filter(F.col("dst").isin(treatment, outcome)).groupBy("src").agg(F.countDistinct("dst").alias("k"))
    common = sorted(r.src for r in parents.filter("k = 2").collect())
    return two_stage(df, treatment, outcome, named, common)


def disagreement(estimates: DataFrame, one: str, other: str) -> DataFrame:
    """(gap, limit, challenged): whether two methods differ by more than twice the larger half width of their intervals."""
    half = (F.col("ci_upper") - F.col("ci_lower")) / 2
    pair = estimates.filter(F.col("method").isin(one, other) & (half > 0)).agg(F.countDistinct("method").alias("k"), (F.max("point") - F.min("point")).alias("gap"), (2 * F.max(half)).alias("limit"))
    return pair.filter("k = 2").select("gap", "limit", (F.col("gap") > F.col("limit")).alias("challenged"))


def effect_report(df: DataFrame, treatment: str, outcome: str, confounders: Sequence[str], row_id: Sequence[str]) -> DataFrame:
    """(part, name, value): estimates, refuters, disagreement, confidence and verdict of one question."""
    estimates = cut(ols_effect(df, treatment, outcome, confounders).unionByName(tmle(df, treatment, outcome, confounders, row_id), True))
    tried = cut(refuters(df, treatment, outcome, confounders, row_id))
    rate = tried.agg(F.avg(F.col("passed").cast("double"))).first()[0]
    odd = cut(disagreement(estimates, "ols", "tmle"))
    severe = odd.filter("challenged").count() > 0

    def part(name: str, frame: DataFrame, key: Column, value: Column) -> DataFrame:
        return frame.select(F.lit(name).alias("part"), key.cast("string").alias("name"), value.cast("string").alias("value"))

    return (
        part("estimate", estimates, F.col("method"), F.col("point"))
        .unionByName(part("refuter", tried, F.col("refuter"), F.col("passed")))
        .unionByName(part("challenge", odd, F.lit("disagreement"), F.col("challenged")))
        .unionByName(part("confidence", confidence(estimates, rate, severe), F.col("level"), F.col("score")))
        .unionByName(part("verdict", verdict(estimates), F.col("verdict"), F.col("point")))
    )


def partial_correlation(df: DataFrame, outcome: str, candidates: Sequence[str]) -> DataFrame:
    """|partial r| of each candidate with the outcome given all others, largest first."""
    columns = [outcome, *candidates]
    m, n = _matrix(moments(df, columns).first().asDict(), columns)
    mean = m[0, 1:] / n
    cov = m[1:, 1:] / n - np.outer(mean, mean)
    inverse = np.linalg.pinv(cov / np.sqrt(np.outer(np.diag(cov), np.diag(cov))))
    rows = [(c, float(abs(inverse[0, i] / np.sqrt(inverse[0, 0] * inverse[i, i])))) for i, c in enumerate(candidates, 1)]
    spark: SparkSession = df.sparkSession
    return spark.createDataFrame(rows, "candidate string, partial_r double").orderBy(F.desc("partial_r"))


def root_causes(df: DataFrame, anomalies: DataFrame, outcome: str, candidates: Sequence[str]) -> DataFrame:
    """(candidate, partial_r, shift, score): |partial r| times 1 + min(shift, 3) / 3, the largest first.

    shift is how many deviations a candidate's mean over ``anomalies`` is away from
    that over the rows; 0 where it has no deviation or no value there.
    """
    known = df.agg(*[x for c in candidates for x in (F.avg(c).alias(f"m_{c}"), F.stddev_samp(c).alias(f"s_{c}"))]).first()
    found = anomalies.agg(*[F.avg(c).alias(c) for c in candidates]).first()
    moved = []
    for c in candidates:
        spread = known[f"s_{c}"]
        moved.append((c, abs(found[c] - known[f"m_{c}"]) / spread if spread and spread == spread and found[c] is not None else 0.0))
    shifts = df.sparkSession.createDataFrame(moved, "candidate string, shift double")
    ranked = partial_correlation(df, outcome, candidates).join(F.broadcast(shifts), "candidate")
    return ranked.withColumn("score", F.col("partial_r") * (1 + F.least("shift", F.lit(3.0)) / 3)).orderBy(F.desc("score"), "candidate")


def split_stationarity(df: DataFrame, value: str, order: Sequence, limit: float = 3.0) -> DataFrame:
    """Difference of the halves' means in pooled standard deviations; above the limit the series drifts."""
    ranked = global_rank(df, order)
    total = df.agg(F.count("*").alias("n"))
    first = F.col("pos") < F.floor(F.col("n") / 2)
    v = F.col(value)
    one = ranked.join(F.broadcast(total)).agg(F.avg(F.when(first, v)).alias("a"), F.avg(F.when(~first, v)).alias("b"), F.var_pop(F.when(first, v)).alias("va"), F.var_pop(F.when(~first, v)).alias("vb"))
    return one.select((F.abs(F.col("a") - F.col("b")) / F.sqrt((F.col("va") + F.col("vb")) / 2)).alias("shift")).withColumn("drifts", F.col("shift") > limit)


#: The 5 % point of the Dickey-Fuller distribution with a constant, for long series.  A fixed value.
UNIT_ROOT = -2.86


def unit_root(df: DataFrame, value: str, order: Sequence[Column], lags: int = 4, least: int = 30, block: int = 10_000) -> DataFrame:
    """One row (t, lags, n, stationary): the augmented Dickey-Fuller test with a constant, lags chosen by AIC.

    The series is laid in blocks of positions that overlap by the lags, so no task gets all of it, and all
    candidates are fitted from one matrix of moments on the rows that have every lag.  Nulls are left out
    of the series.  A series of fewer than ``least`` values, or of one value only, is not tested: t is null
    and stationary true.  ``order`` should have no ties.
    """
    spark, schema = df.sparkSession, "t double, lags int, n long, stationary boolean"
    known = df.filter(F.col(value).isNotNull())
    n, middle, spread = known.agg(F.count("*"), F.avg(value), F.stddev_pop(value)).first()
    if n < least or not spread:
        return spark.createDataFrame([(None, None, n, True)], schema)
    block = max(block, 2 * (lags + 2))
    placed = global_rank(known, order, name="_pos").select("_pos", ((F.col(value).cast("double") - float(middle)) / float(spread)).alias("_v"))
    home = F.floor(F.col("_pos") / block)
    next_too = F.col("_pos") % block >= block - lags - 1
    dealt = placed.withColumn("_home", home).withColumn("_block", F.explode(F.when(next_too, F.array("_home", F.col("_home") + 1)).otherwise(F.array("_home"))))
    w = Window.partitionBy("_block").orderBy("_pos")
    back = [F.col("_v"), *[F.lag("_v", i).over(w) for i in range(1, lags + 2)]]
    steps = [(back[i] - back[i + 1]).alias(f"d{i}") for i in range(lags + 1)]
    rows = dealt.select("_home", "_block", "_pos", back[1].alias("level"), *steps).filter((F.col("_home") == F.col("_block")) & (F.col("_pos") > lags))
    m, count = _matrix(moments(rows, ["level", *[f"d{i}" for i in range(1, lags + 1)], "d0"]).first().asDict(), ["level", *[f"d{i}" for i in range(1, lags + 1)], "d0"])
    best = None
    for p in range(lags + 1):
        x = m[: p + 2, : p + 2]
        inverse = np.linalg.pinv(x)
        beta = inverse @ m[: p + 2, -1]
        rest = max(float(m[-1, -1] - beta @ m[: p + 2, -1]), 1e-300)
        aic = count * np.log(rest / count) + 2 * (p + 2)
        if best is None or aic < best[0]:
            best = (aic, float(beta[1] / np.sqrt(rest / (count - p - 2) * inverse[1, 1])), p)
    return spark.createDataFrame([(best[1], best[2], count, best[1] < UNIT_ROOT)], schema)
