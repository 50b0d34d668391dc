"""Queries of effect estimates and root-cause ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeguard.operators import causal as C
from lakeguard.plans.steps import t

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def study(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") > 0.05).cast("int").alias("t"), (F.col("l_extendedprice") / 1000).alias("y"), F.col("l_quantity").alias("x"), F.col("l_tax").alias("z"), "l_returnflag", "l_shipdate")


STUDY = "(SELECT CAST(l_discount > 0.05 AS INTEGER) AS t, l_extendedprice / 1000 AS y, l_quantity AS x, l_tax AS z, l_returnflag, l_shipdate, l_orderkey, l_linenumber FROM lineitem)"


@query("ca1_ols_effect", f"SELECT round((covar_pop(t, y) * var_pop(x) - covar_pop(x, y) * covar_pop(t, x)) / (var_pop(t) * var_pop(x) - covar_pop(t, x) ** 2), 5) AS point, count(*) AS n FROM {STUDY}")
def ols(spark: SparkSession, sf: str) -> DataFrame:
    return C.ols_effect(study(spark, sf), "t", "y", ["x"]).select(F.round("point", 5).alias("point"), "n")


@query("ca2_ipw", f"SELECT round(sum(ty * n / tt) / sum(n) - sum(cy * n / (n - tt)) / sum(n), 5) AS point, CAST(sum(n) AS BIGINT) AS n FROM (SELECT l_returnflag, count(*) AS n, sum(t) AS tt, sum(t * y) AS ty, sum((1 - t) * y) AS cy FROM {STUDY} GROUP BY 1 HAVING sum(t) > 0 AND sum(t) < count(*))")
def ipw(spark: SparkSession, sf: str) -> DataFrame:
    return C.stratified_ipw(study(spark, sf), "t", "y", ["l_returnflag"]).select(F.round("point", 5).alias("point"), "n")


@query("ca3_psm")
def psm(spark: SparkSession, sf: str) -> DataFrame:
    return C.propensity_matching(study(spark, sf), "t", "y", ["x", "z"])


@query("ca6_tmle")
def tmle(spark: SparkSession, sf: str) -> DataFrame:
    return C.tmle(study(spark, sf), "t", "y", ["x", "z"], ["l_orderkey", "l_linenumber"])


def _nearest(arm: str) -> str:
    return f"CASE WHEN b{arm}.spot IS NULL OR a{arm}.spot - s < s - b{arm}.spot THEN a{arm}.m ELSE b{arm}.m END"


@query(
    "jn8_propensity_match",
    f"""WITH cells AS (SELECT y AS s, sum(t) AS n1, sum(1 - t) AS n0, sum(t * x) AS y1, sum((1 - t) * x) AS y0 FROM {STUDY} GROUP BY 1),
 c0 AS (SELECT s AS spot, y0 / n0 AS m FROM cells WHERE n0 > 0), c1 AS (SELECT s AS spot, y1 / n1 AS m FROM cells WHERE n1 > 0)
 SELECT round(sum(y1 - n1 * {_nearest("0")}) / sum(n1), 5) AS att, round((sum(y1 - n1 * {_nearest("0")}) + sum(n0 * {_nearest("1")} - y0)) / sum(n1 + n0), 5) AS ate, CAST(sum(n1 + n0) AS BIGINT) AS n
 FROM cells ASOF LEFT JOIN c0 b0 ON s >= b0.spot ASOF LEFT JOIN c0 a0 ON s <= a0.spot ASOF LEFT JOIN c1 b1 ON s >= b1.spot ASOF LEFT JOIN c1 a1 ON s <= a1.spot""",
)
def matched(spark: SparkSession, sf: str) -> DataFrame:
    found = C.match_on_score(study(spark, sf), "t", "x", "y")
    return found.select(F.round("att", 5).alias("att"), F.round("ate", 5).alias("ate"), "n")


@query("ca4_aipw")
def aipw(spark: SparkSession, sf: str) -> DataFrame:
    return C.doubly_robust(study(spark, sf), "t", "y", ["x", "z"], ["l_orderkey", "l_linenumber"])


@query("ca5_forest_dr")
def forest(spark: SparkSession, sf: str) -> DataFrame:
    return C.forest_effect(study(spark, sf), "t", "y", ["x", "z"], ["l_orderkey", "l_linenumber"])


@query("ca7_iv_2sls", f"SELECT round(covar_pop(z, y) / covar_pop(z, t), 3) AS point, count(*) AS n FROM {STUDY}")
def iv(spark: SparkSession, sf: str) -> DataFrame:
    return C.two_stage(study(spark, sf), "t", "y", ["z"]).select(F.round("point", 3).alias("point"), "n")


@query("ca8_conformal_ci", f"SELECT list_sort(list(s))[CAST(least(ceil((count(*) + 1) * 0.9), count(*)) AS BIGINT)] AS half_width, count(*) AS n FROM (SELECT abs(y - 25) AS s FROM {STUDY})")
def conformal(spark: SparkSession, sf: str) -> DataFrame:
    return C.conformal_half_width(study(spark, sf).select(F.abs(F.col("y") - 25).alias("s")), "s")


SHARE = f"(SELECT avg(t) OVER (PARTITION BY x) AS propensity FROM {STUDY})"


@query("ca9_propensity_diag", f"SELECT min(propensity) AS least, max(propensity) AS most, round(avg(propensity), 6) AS mean, round(quantile_cont(propensity, 0.5), 6) AS p50, avg(CAST(propensity NOT BETWEEN 0.05 AND 0.95 AS INTEGER)) > 0.1 AS warn FROM {SHARE}")
def diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    df = study(spark, sf)
    shares = df.groupBy("x").agg(F.avg("t").alias("propensity"))
    return C.propensity_diagnostics(df.join(shares, "x")).select("least", "most", F.round("mean", 6).alias("mean"), F.round("p50", 6).alias("p50"), "warn")


@query("ca10_sensitivity")
def sensitive(spark: SparkSession, sf: str) -> DataFrame:
    return C.sensitivity(C.ols_effect(study(spark, sf), "t", "y", ["x"]), 25.0)


@query("ca11_refuters")
def refute(spark: SparkSession, sf: str) -> DataFrame:
    return C.refuters(study(spark, sf), "t", "y", ["x"], ["l_orderkey", "l_linenumber"])


@query("ca12_confidence")
def confident(spark: SparkSession, sf: str) -> DataFrame:
    df = study(spark, sf)
    both = C.ols_effect(df, "t", "y", ["x"]).unionByName(C.ols_effect(df, "t", "y", ["x", "z"]).withColumn("method", F.lit("ols_z")))
    rate = refute(spark, sf).agg(F.avg(F.col("passed").cast("double"))).first()[0]
    return C.confidence(both, rate, False)


@query("ca14_verdict")
def verdict(spark: SparkSession, sf: str) -> DataFrame:
    return C.verdict(C.ols_effect(study(spark, sf), "t", "y", ["x"]))


@query("rc1_partial_corr_rank", f"SELECT candidate, round(r, 5) AS partial_r FROM (SELECT 'x' AS candidate, abs((corr(y, x) - corr(y, z) * corr(x, z)) / sqrt((1 - corr(y, z) ** 2) * (1 - corr(x, z) ** 2))) AS r FROM {STUDY} UNION ALL SELECT 'z', abs((corr(y, z) - corr(y, x) * corr(x, z)) / sqrt((1 - corr(y, x) ** 2) * (1 - corr(x, z) ** 2))) FROM {STUDY})")
def causes(spark: SparkSession, sf: str) -> DataFrame:
    return C.partial_correlation(study(spark, sf), "y", ["x", "z"]).select("candidate", F.round("partial_r", 5).alias("partial_r"))


@query("rc2_stationarity", "SELECT round(abs(avg(y) FILTER (k <= n // 2) - avg(y) FILTER (k > n // 2)) / sqrt((var_pop(y) FILTER (k <= n // 2) + var_pop(y) FILTER (k > n // 2)) / 2), 5) AS shift FROM (SELECT o_totalprice AS y, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS k, count(*) OVER () AS n FROM orders)")
def stationary(spark: SparkSession, sf: str) -> DataFrame:
    return C.split_stationarity(t(spark, sf, "orders"), "o_totalprice", [F.col("o_orderdate"), F.col("o_orderkey")]).select(F.round("shift", 5).alias("shift"))


_STEPS = "(SELECT y - lag(y) OVER w AS d, lag(y) OVER w AS level FROM (SELECT o_totalprice AS y, o_orderdate, o_orderkey FROM orders) WINDOW w AS (ORDER BY o_orderdate, o_orderkey))"


@query("rc2_unit_root", f"SELECT round(b / sqrt((syy - b * sxy) / (n - 2) / sxx), 4) AS t, n, b / sqrt((syy - b * sxy) / (n - 2) / sxx) < -2.86 AS stationary FROM (SELECT regr_slope(d, level) AS b, regr_sxx(d, level) AS sxx, regr_syy(d, level) AS syy, regr_sxy(d, level) AS sxy, count(*) AS n FROM {_STEPS} WHERE d IS NOT NULL)")
def rooted(spark: SparkSession, sf: str) -> DataFrame:
    """The Dickey-Fuller test without lags; a test holds the choice of lags to a least-squares fit."""
    found = C.unit_root(t(spark, sf, "orders"), "o_totalprice", [F.col("o_orderdate"), F.col("o_orderkey")], lags=0)
    return found.select(F.round("t", 4).alias("t"), "n", "stationary")


@query("rc2_unit_root_lags")
def rooted_with_lags(spark: SparkSession, sf: str) -> DataFrame:
    found = C.unit_root(t(spark, sf, "orders"), "o_totalprice", [F.col("o_orderdate"), F.col("o_orderkey")])
    return found.withColumn("t", F.round("t", 4))


_SPLIT = f"(SELECT *, l_orderkey % 10 >= 7 AS held, avg(t) OVER (PARTITION BY x) AS e FROM {STUDY})"


@query(
    "ca8_weighted_conformal",
    f"""WITH c AS (SELECT avg(y) AS centre FROM {_SPLIT} WHERE NOT held), s AS (SELECT abs(y - centre) AS s, CASE WHEN t = 1 THEN 1 / greatest(e, 0.025) ELSE 1 / greatest(1 - e, 0.025) END AS w FROM {_SPLIT}, c WHERE held),
 u AS (SELECT s, sum(sum(w)) OVER (ORDER BY s) AS up, sum(sum(w)) OVER () AS total FROM s GROUP BY s)
 SELECT round((SELECT centre FROM c), 6) AS centre, round(min(s) FILTER (up / (total + 1) >= 0.9), 6) AS half_width, (SELECT count(*) FROM s) AS n FROM u""",
)
def weighted_conformal(spark: SparkSession, sf: str) -> DataFrame:
    """Three tenths of the orders held out, weighed by how seldom their rows are treated as they are."""
    df = study(spark, sf)
    shares = df.groupBy("x").agg(F.avg("t").alias("e"))
    weighed = df.join(shares, "x").withColumn("w", 1 / F.greatest(F.when(F.col("t") == 1, F.col("e")).otherwise(1 - F.col("e")), F.lit(0.025)))
    found = C.split_conformal(weighed, "y", "w", F.col("l_orderkey") % 10 >= 7)
    return found.select(F.round("centre", 6).alias("centre"), F.round("half_width", 6).alias("half_width"), "n")


@query(
    "ca11_unobserved_cause",
    f"""WITH r AS (SELECT var_pop(t) - covar_pop(t, x) ** 2 / var_pop(x) AS v, covar_pop(t, y) - covar_pop(t, x) * covar_pop(x, y) / var_pop(x) AS c, var_pop(y) - covar_pop(x, y) ** 2 / var_pop(x) AS w FROM {STUDY}),
 g AS (SELECT f.k AS on_treatment, g.k AS on_outcome, c / v AS baseline, (c + f.k * sqrt(v) * g.k * sqrt(w)) / (v + f.k ** 2 * v) AS added, c / v - f.k * sqrt(v) * g.k * sqrt(w) / v AS corrected FROM r, (VALUES (0.1::DOUBLE), (0.25), (0.5)) f(k), (VALUES (0.1::DOUBLE), (0.25), (0.5)) g(k))
 SELECT on_treatment, on_outcome, round(baseline, 4) AS baseline, round(added, 4) AS added, round(corrected, 4) AS corrected, abs(added - baseline) < greatest(abs(baseline) * 0.2, 0.1) AS passed FROM g""",
)
def hidden(spark: SparkSession, sf: str) -> DataFrame:
    found = C.unobserved_cause(study(spark, sf), "t", "y", ["x"])
    return found.select("on_treatment", "on_outcome", *[F.round(c, 4).alias(c) for c in ("baseline", "added", "corrected")], "passed")


@query(
    "rc1_anomaly_rank",
    f"""WITH r AS ({SQL["rc1_partial_corr_rank"]}), s AS (SELECT abs(avg(x) FILTER (y > 60) - avg(x)) / stddev_samp(x) AS x, abs(avg(z) FILTER (y > 60) - avg(z)) / stddev_samp(z) AS z FROM {STUDY})
 SELECT candidate, round(CASE candidate WHEN 'x' THEN s.x ELSE s.z END, 5) AS shift, round(partial_r * (1 + least(CASE candidate WHEN 'x' THEN s.x ELSE s.z END, 3) / 3), 4) AS score FROM r, s""",
)
def anomaly_causes(spark: SparkSession, sf: str) -> DataFrame:
    """What moved in the dearest lines, over how much it goes with the price in all."""
    df = study(spark, sf)
    return C.root_causes(df, df.filter("y > 60"), "y", ["x", "z"]).select("candidate", F.round("shift", 5).alias("shift"), F.round("score", 4).alias("score"))
