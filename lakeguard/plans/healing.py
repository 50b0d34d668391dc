"""Queries of gates, conformal alarms, numeric semantics and repairs, over monthly and quarterly batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeguard.functions.storage import kept
from lakeguard.operators import drift as D
from lakeguard.operators import healing as H
from lakeguard.plans import drift as P
from lakeguard.plans.profile import gaps
from lakeguard.plans.steps import t

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = P.registrar(QUERIES, SQL)

#: Vectors of each month's orders, and their likeness to the first month's.
MONTHS = """tokens AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, unnest(['o_orderpriority:' || o_orderpriority, 'o_orderstatus:' || o_orderstatus]) AS token FROM orders),
 sums AS (SELECT month, CAST('0x' || substr(md5(token), 1, 8) AS BIGINT) % 256 AS bucket, sum(CASE WHEN CAST('0x' || substr(md5(token), 9, 8) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END) AS w FROM tokens GROUP BY ALL),
 vec AS (SELECT month, bucket, w / sqrt(sum(w * w) OVER (PARTITION BY month)) AS w FROM sums),
 likeness AS (SELECT a.month, round(sum(a.w * b.w), 6) AS s, row_number() OVER (ORDER BY a.month) AS i FROM vec a JOIN (SELECT * FROM vec WHERE month = (SELECT min(month) FROM vec)) b USING (bucket) GROUP BY a.month)"""


def _semantic(spark: SparkSession, sf: str) -> DataFrame:
    vectors = D.batch_vectors(t(spark, sf, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM")), ["month"], ["o_orderpriority", "o_orderstatus"])
    first = vectors.agg(F.min("month").alias("first"))
    reference = vectors.join(F.broadcast(first), F.col("month") == F.col("first")).select(F.col("month").alias("reference"), "bucket", "w")
    return D.semantic_drift(vectors, reference, ["month"], "reference")


@query(
    "dr8_similarity_gate",
    f"""WITH {MONTHS}, g AS (SELECT month, i, CASE WHEN i = 1 THEN 1.0 ELSE s END AS similarity, CASE WHEN i <= 5 THEN 0.75 ELSE greatest(0.75 * 0.8, least(avg(CASE WHEN i > 1 THEN s END) OVER w - 2 * stddev_samp(CASE WHEN i > 1 THEN s END) OVER w, 0.75)) END AS threshold FROM likeness WINDOW w AS (ORDER BY month ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))
 SELECT month, similarity, round(threshold, 5) AS threshold, similarity >= threshold AS allowed FROM g""",
)
def gate(spark: SparkSession, sf: str) -> DataFrame:
    found = _semantic(spark, sf).select(F.lit("orders").alias("source"), "month", F.round(1 - F.col("distance"), 6).alias("similarity"))
    return H.similarity_gate(found, "source", "month").select("month", "similarity", F.round("threshold", 5).alias("threshold"), "allowed")


@query(
    "dr9_drift_detect",
    f"""WITH schema AS ({P.SQL["dr1_schema_drift"]}), stat AS ({P.SQL["dr5_statistical_drift"]}), months AS (SELECT DISTINCT strftime(l_shipdate, '%Y-%m') AS month FROM lineitem),
 sem AS (WITH {MONTHS} SELECT month, CASE WHEN 1 - s > 0.75 THEN 'critical' WHEN 1 - s > 0.5 THEN 'high' WHEN 1 - s > 0.375 THEN 'medium' WHEN 1 - s > 0.25 THEN 'low' END AS severity FROM likeness)
 SELECT month, CASE WHEN schema.severity IS NOT NULL THEN 'schema' WHEN stat.severity IS NOT NULL THEN 'statistical' WHEN sem.severity IS NOT NULL THEN 'semantic' END AS kind, coalesce(schema.severity, stat.severity, sem.severity) AS severity
 FROM months LEFT JOIN schema USING (month) LEFT JOIN stat USING (month) LEFT JOIN sem USING (month)""",
)
def detect(spark: SparkSession, sf: str) -> DataFrame:
    months = t(spark, sf, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM").alias("month"))
    found = {"schema": P.schema(spark, sf), "statistical": P.statistical(spark, sf), "semantic": _semantic(spark, sf)}
    return H.first_drift(months, ["month"], found)


@query(
    "dr12_conformal_martingale",
    f"""WITH {P.W1}, d AS (SELECT quarter, round(w1, 4) AS w1, row_number() OVER (ORDER BY quarter) AS i, CAST('0x' || substr(md5('orders' || quarter), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM w1),
 pv AS (SELECT a.i, a.u, (count(*) FILTER (b.w1 > a.w1) + a.u * (count(*) FILTER (b.w1 = a.w1) + 1)) / a.i AS p FROM d a JOIN d b ON b.i < a.i WHERE a.i > 4 GROUP BY a.i, a.u),
 bets AS (SELECT i, sum(ln((k + 0.5) / 100) + ((k + 0.5) / 100 - 1) * ln(greatest(least(p, 1), 1e-6))) OVER (PARTITION BY k ORDER BY i) AS l FROM pv, range(0, 100) r(k)),
 wl AS (SELECT i, avg(exp(l)) AS wealth FROM bets GROUP BY i),
 o AS (SELECT d.quarter, d.i, pv.p, coalesce(wealth, 1.0) AS wealth FROM d LEFT JOIN pv USING (i) LEFT JOIN wl USING (i))
 SELECT quarter, round(p, 6) AS p, round(wealth, 5) AS wealth, wealth >= 10 AND coalesce(max(wealth) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 10 AS alarm FROM o""",
)
def conformal(spark: SparkSession, sf: str) -> DataFrame:
    scores = D.wasserstein(*P.quarterly(spark, sf), ["quarter"]).select(F.lit("orders").alias("source"), "quarter", F.round("w1", 4).alias("w1"))
    tie = F.conv(F.substring(F.md5(F.concat("source", "quarter")), 1, 8), 16, 10).cast("long") / 4294967296.0
    found = H.conformal_alarms(scores, "source", "quarter", "w1", tie, warmup=4, alpha=0.1)
    return found.select("quarter", F.round("p", 6).alias("p"), F.round("wealth", 5).alias("wealth"), "alarm")


@query(
    "dr12_alarm_after_a_move",
    """WITH d AS (SELECT l_returnflag AS source, strftime(l_shipdate, '%Y-%m') AS month, round(avg(l_quantity) + CASE WHEN l_returnflag = 'R' AND strftime(l_shipdate, '%Y-%m') >= '1999' THEN 9 ELSE 0 END, 3) AS v FROM lineitem GROUP BY l_returnflag, strftime(l_shipdate, '%Y-%m')),
 n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY month) AS i FROM d),
 pv AS (SELECT a.source, a.i, (count(*) FILTER (b.v > a.v) + 0.5 * (count(*) FILTER (b.v = a.v) + 1)) / a.i AS p FROM n a JOIN n b ON b.source = a.source AND b.i < a.i WHERE a.i > 10 GROUP BY a.source, a.i),
 bets AS (SELECT source, i, sum(ln((k + 0.5) / 100) + ((k + 0.5) / 100 - 1) * ln(greatest(least(p, 1), 1e-6))) OVER (PARTITION BY source, k ORDER BY i) AS l FROM pv, range(0, 100) r(k)),
 w AS (SELECT source, i, avg(exp(l)) AS wealth FROM bets GROUP BY ALL)
 SELECT source, month, wealth >= 100 AND coalesce(max(wealth) OVER (PARTITION BY source ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 100 AS alarm FROM n LEFT JOIN w USING (source, i) QUALIFY coalesce(alarm, false)""",
)
def moved(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly means by flag, those of one flag moved from 1999 on: the months of alarm."""
    month, flag = F.date_format("l_shipdate", "yyyy-MM").alias("month"), F.col("l_returnflag").alias("source")
    means = t(spark, sf, "lineitem").groupBy(flag, month).agg(F.avg("l_quantity").alias("v"))
    scores = means.withColumn("v", F.round(F.col("v") + F.when((F.col("source") == "R") & (F.col("month") >= "1999"), 9).otherwise(0), 3))
    return H.conformal_alarms(scores, "source", "month", "v", F.lit(0.5)).filter("alarm").select("source", "month", "alarm")


# ------------------------------------------------------------ numeric semantics
ORDER = ["l_orderkey", "l_linenumber", "v"]
#: Months whose quantities are in thousandths: an error of unit.
BUG = "month IN ('1997-03', '1997-04', '1997-05', '1997-06', '1997-10')"


def _rows(spark: SparkSession, sf: str, bug: bool = False) -> DataFrame:
    df = t(spark, sf, "lineitem").withColumn("month", F.date_format("l_shipdate", "yyyy-MM"))
    if bug:
        df = df.withColumn("l_quantity", F.when(F.expr(BUG), F.col("l_quantity") * 1000).otherwise(F.col("l_quantity")))
    return D.long_form(df, ["month", *ORDER[:2]], ["l_quantity", "l_tax"])


def _features(rows: str, keys: str) -> str:
    """SQL of the sixteen features of ``rows(keys, column, v, l_orderkey, l_linenumber)``."""
    return f"""SELECT {keys}, "column", [avg(lg), stddev_pop(lg), avg(whole), count(DISTINCT v) / count(*), avg(CAST(v > 0 AS INT)), avg(CAST(v < 0 AS INT)), avg(dec), stddev_pop(dec), avg(floor(lg) + 1), avg(round0), coalesce(avg(CAST(v > b AS INT)), 0), CAST(max(abs(v)) <= 1 AS INT), CAST(min(v) >= 0 AND max(v) <= 100 AS INT),
 (q(v, 0.05) - q(v, 0.5)) / iqr(v), (q(v, 0.25) - q(v, 0.5)) / iqr(v), (q(v, 0.95) - q(v, 0.5)) / iqr(v)] AS f
 FROM (SELECT *, log10(abs(v) + 1) AS lg, CAST(abs(v - round_even(v, 0)) <= 1e-8 + 1e-5 * abs(round_even(v, 0)) AS INT) AS whole, CASE WHEN i <= 500 THEN length(regexp_extract(printf('%.6f', v), '\\.(\\d*?)0*$', 1)) END AS dec, CASE WHEN i <= 500 THEN CAST(round_even(v, 0) % 10 = 0 AND v <> 0 AS INT) END AS round0
  FROM (SELECT *, row_number() OVER w AS i, lag(v) OVER w AS b FROM ({rows}) WINDOW w AS (PARTITION BY {keys}, "column" ORDER BY l_orderkey, l_linenumber, v))) GROUP BY {keys}, "column\"""".replace("iqr(v)", "CASE WHEN q(v, 0.75) > q(v, 0.25) THEN q(v, 0.75) - q(v, 0.25) ELSE 1 END").replace("q(v, ", "quantile_cont(v, ")


LINES = """SELECT strftime(l_shipdate, '%Y-%m') AS month, l_orderkey, l_linenumber, 'l_quantity' AS "column", l_quantity AS v FROM lineitem UNION ALL SELECT strftime(l_shipdate, '%Y-%m'), l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem"""
BUGGED = f"""SELECT month, l_orderkey, l_linenumber, "column", CASE WHEN "column" = 'l_quantity' AND {BUG} THEN v * 1000 ELSE v END AS v FROM ({LINES})"""
BASE = f"""feat AS ({_features(LINES, "month")}), each AS (SELECT month, "column", unnest(f) AS x, unnest(range(0, 16)) AS k FROM feat),
 spread AS (SELECT "column", k, avg(x) AS mu, greatest(stddev_pop(x), 1e-9) AS sigma FROM each WHERE month < '1996' GROUP BY ALL),
 z AS (SELECT month, "column", sqrt(sum(pow((x - mu) / sigma, 2))) AS z FROM each JOIN spread USING ("column", k) GROUP BY ALL),
 healthy AS (SELECT "column", avg(z) AS healthy_z FROM z WHERE month < '1996' GROUP BY 1)"""


@query("dr13_numeric_encode", f"""SELECT month, "column", unnest(range(0, 16))::INT AS k, round(unnest(f), 5) + 0.0 AS x FROM ({_features(LINES, "month")})""")
def encoded(spark: SparkSession, sf: str) -> DataFrame:
    return H.encode(_rows(spark, sf), ["month"], ORDER).select("month", "column", F.posexplode("f").alias("k", "x")).withColumn("x", F.round("x", 5) + 0.0)


def _baseline(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return H.fit_baseline(H.encode(_rows(spark, sf).filter("month < '1996'"), ["month"], ORDER), ["month"])


@query("dr14_numeric_baseline", f"""WITH {BASE} SELECT month, "column", round(z, 3) AS z, z > 3 * greatest(healthy_z, 1e-9) AS drifted FROM z JOIN healthy USING ("column") WHERE month >= '1996'""")
def numeric(spark: SparkSession, sf: str) -> DataFrame:
    spread, healthy = _baseline(spark, sf)
    z = H.distances(H.encode(_rows(spark, sf).filter("month >= '1996'"), ["month"], ORDER), spread, ["month"])
    return z.join(F.broadcast(healthy), "column").select("month", "column", F.round("z", 3).alias("z"), (F.col("z") > 3 * F.greatest("healthy_z", F.lit(1e-9))).alias("drifted"))


@query(
    "dr15_type_prototypes",
    f"""WITH {BASE}, bug AS (SELECT month, "column", unnest(f) AS x, unnest(range(0, 16)) AS k FROM ({_features(BUGGED, "month")}) WHERE month >= '1996'),
 centre AS (SELECT "column" AS type, k, avg(x) AS c FROM each WHERE month < '1996' GROUP BY ALL),
 spreads AS (SELECT type, avg(r) AS spread FROM (SELECT month, type, sqrt(sum(pow(x - c, 2))) AS r FROM each JOIN centre ON type = "column" AND centre.k = each.k WHERE month < '1996' GROUP BY ALL) GROUP BY 1),
 met AS (SELECT month, "column", type, sqrt(sum(pow(x - c, 2))) AS distance FROM bug JOIN centre USING (k) GROUP BY ALL),
 best AS (SELECT *, row_number() OVER (PARTITION BY month, "column" ORDER BY distance, type) AS i FROM met)
 SELECT month, "column", type, round(distance, 4) AS distance, distance > 2 * spread AS drifted FROM best JOIN spreads USING (type) WHERE i = 1""",
)
def prototypes(spark: SparkSession, sf: str) -> DataFrame:
    samples = H.encode(_rows(spark, sf).filter("month < '1996'"), ["month"], ORDER)
    features = H.encode(_rows(spark, sf, True).filter("month >= '1996'"), ["month"], ORDER)
    return H.nearest_prototype(features, samples, ["month"], ["month"]).withColumn("distance", F.round("distance", 4))


TRIED = ", ".join(f"({i}, '{n}', {f})" for i, (n, f) in enumerate((("none", 1.0), *H.TRANSFORMS)))


def _proposals(spark: SparkSession, sf: str) -> DataFrame:
    return H.heal_proposals(_rows(spark, sf, True).filter("month >= '1997' AND month < '1998'"), ["month"], ORDER, _baseline(spark, sf))


@query(
    "dr16_heal_proposal",
    f"""WITH {BASE}, tried(rank, transform, factor) AS (VALUES {TRIED}), many AS (SELECT month, rank, l_orderkey, l_linenumber, "column", v * factor AS v FROM ({BUGGED}), tried WHERE month >= '1997' AND month < '1998'),
 zz AS (SELECT month, rank, "column", round(sqrt(sum(pow((x - mu) / sigma, 2))), 6) AS z FROM (SELECT month, rank, "column", unnest(f) AS x, unnest(range(0, 16)) AS k FROM ({_features("SELECT * FROM many", "month, rank")})) JOIN spread USING ("column", k) GROUP BY ALL),
 best AS (SELECT month, "column", rank, z AS z_after, max(z) FILTER (rank = 0) OVER w AS z_before, row_number() OVER (PARTITION BY month, "column" ORDER BY z, rank) AS i FROM zz WINDOW w AS (PARTITION BY month, "column"))
 SELECT month, "column", transform, z_after <= 0.5 * z_before AND z_after <= 3 * healthy_z AND transform <> 'none' AS accepted, z_before > 3 * healthy_z AS drifted FROM best JOIN tried USING (rank) JOIN healthy USING ("column") WHERE i = 1""",
)
def proposals(spark: SparkSession, sf: str) -> DataFrame:
    return _proposals(spark, sf).select("month", "column", "transform", "accepted", "drifted")


@query("dr17_heal_controller")
def controller(spark: SparkSession, sf: str) -> DataFrame:
    found = H.heal_control(_proposals(spark, sf).withColumn("source", F.lit("lineitem")), "source", "month")
    return found.select("month", "column", "state", "event", "applied", "applied_factor")


# ------------------------------------------------------------ repairs
@query(
    "dr18_repair_plan",
    f"""WITH stat AS ({P.SQL["dr5_statistical_drift"]}), sch AS ({P.SQL["dr1_schema_drift"]}), fold AS (WITH {P.KL}, s AS (SELECT month, max(shift) AS shift FROM shift GROUP BY 1) SELECT * FROM s)
 SELECT month, 'columns removed' AS cause, 'fill_missing' AS repair, 0.9::DOUBLE AS confidence, false AS hold FROM sch
 UNION ALL SELECT month, CASE WHEN max_kl > 0.75 THEN 'severe distribution shift' WHEN max_kl > 0.3 THEN 'significant distribution drift' ELSE 'mild statistical drift' END, CASE WHEN max_kl > 0.75 THEN 'rescale' WHEN max_kl > 0.3 THEN 'clip' ELSE 'monitor' END, CASE WHEN max_kl > 0.75 THEN 0.7::DOUBLE WHEN max_kl > 0.3 THEN 0.8::DOUBLE ELSE 0.85::DOUBLE END, shift > 3 FROM stat JOIN fold USING (month) WHERE max_kl > 0""",
)
def plans(spark: SparkSession, sf: str) -> DataFrame:
    none = F.lit(0).cast("long")
    schema = P.schema(spark, sf).select("month", "kind", "added", "removed", F.lit(None).cast("double").alias("max_kl"), F.lit(None).cast("double").alias("shift"))
    shifts = P.shift(spark, sf).groupBy("month").agg(F.max("shift").alias("shift"))
    stat = P.statistical(spark, sf).filter("max_kl > 0").join(shifts, "month").select("month", F.lit("statistical").alias("kind"), none.alias("added"), none.alias("removed"), "max_kl", "shift")
    return H.repair_plan(schema.unionByName(stat).withColumn("zeta", F.lit(0.15))).select("month", "cause", "repair", "confidence", "hold")


#: Every third row's quantity is 50 by mistake; repairs that leave them, clip them, or drop all of 50.
FAULTY = "CASE WHEN l_orderkey % 3 = 0 THEN 50.0 ELSE l_quantity END"
OUTCOMES = f"""rows AS (SELECT strftime(l_shipdate, '%Y-%m') AS month, {FAULTY} AS v, l_quantity AS old FROM lineitem),
 cand AS (SELECT month, 'a_leave' AS candidate, 'l_quantity' AS "column", v FROM rows WHERE month >= '1996' UNION ALL SELECT month, 'b_clip', 'l_quantity', least(v, 40.0) FROM rows WHERE month >= '1996' UNION ALL SELECT month, 'c_drop', 'l_quantity', v FROM rows WHERE month >= '1996' AND v < 50),
 p AS ({P._hist("SELECT * FROM cand", "month, candidate")}), q AS ({P._hist("SELECT 'l_quantity' AS \"column\", old AS v FROM rows WHERE month < '1996'", "")}),
 grid AS (SELECT month, candidate, bin, sum(p) AS p, sum(q) AS q FROM (SELECT month, candidate, bin, n AS p, 0 AS q FROM p UNION ALL SELECT h.month, h.candidate, q.bin, 0, q.n FROM q, (SELECT DISTINCT month, candidate FROM p) h) GROUP BY ALL),
 share AS (SELECT *, p / sum(p) OVER w + 1e-10 AS a, q / sum(q) OVER w + 1e-10 AS b FROM grid WINDOW w AS (PARTITION BY month, candidate)),
 kl AS (SELECT month, candidate, round(greatest(sum(a * ln(a / b)), 0), 6) AS kl FROM share GROUP BY ALL)"""


def _outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """(month, candidate, kl): divergence of the faulty months after each repair."""
    rows = t(spark, sf, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM").alias("month"), F.expr(FAULTY).alias("v"), F.col("l_quantity").alias("old"), F.lit("l_quantity").alias("column"))
    new, base = rows.filter("month >= '1996'"), rows.filter("month < '1996'").select("column", F.col("old").alias("v"))
    done = [new.select("month", F.lit("a_leave").alias("candidate"), "column", "v"), new.select("month", F.lit("b_clip").alias("candidate"), "column", F.least("v", F.lit(40.0)).alias("v")), new.filter("v < 50").select("month", F.lit("c_drop").alias("candidate"), "column", "v")]
    keys = ["month", "candidate"]
    found = D.kl_divergence(D.histograms(done[0].unionByName(done[1]).unionByName(done[2]), keys), D.histograms(base), keys)
    return found.select("month", "candidate", F.round("kl", 6).alias("kl"))


def _with_before(spark: SparkSession, sf: str) -> DataFrame:
    found = _outcomes(spark, sf)
    before = found.filter("candidate = 'a_leave'").select("month", F.col("kl").alias("before"))
    return found.filter("candidate <> 'a_leave'").join(before, "month")


@query("dr19_repair_validate", f"WITH {OUTCOMES} SELECT c.month, c.candidate, b.kl AS pre_kl, c.kl AS post_kl, c.kl <= 0.15 OR (b.kl > 0 AND c.kl < 0.5 * b.kl) AS passed FROM kl c JOIN kl b ON b.month = c.month AND b.candidate = 'a_leave' WHERE c.candidate <> 'a_leave'")
def validated(spark: SparkSession, sf: str) -> DataFrame:
    found = _with_before(spark, sf).select("month", "candidate", F.col("before").alias("pre_kl"), F.col("kl").alias("post_kl"), F.lit(0.15).alias("limit"))
    return H.validate_repairs(found).drop("limit")


@query("dr20_repair_select", f"WITH {OUTCOMES}, i AS (SELECT c.month, c.candidate, b.kl - c.kl AS improvement, row_number() OVER (PARTITION BY c.month ORDER BY b.kl - c.kl DESC, c.candidate) AS k FROM kl c JOIN kl b ON b.month = c.month AND b.candidate = 'a_leave' WHERE c.candidate <> 'a_leave') SELECT month, candidate, round(improvement, 5) AS improvement, round(improvement - abs(improvement) * 0.2 - 0.05, 5) AS ci_lower, round(improvement + abs(improvement) * 0.2 + 0.05, 5) AS ci_upper FROM i WHERE k = 1")
def selected(spark: SparkSession, sf: str) -> DataFrame:
    found = H.select_repair(_with_before(spark, sf).withColumnRenamed("kl", "after"), ["month"])
    return found.select("month", "candidate", *[F.round(c, 5).alias(c) for c in ("improvement", "ci_lower", "ci_upper")])


_CHANGED = "SELECT strftime(l_shipdate, '%Y-%m') AS month, l_quantity AS v FROM lineitem"
_AWAY = "abs(avg(v) - 25) / 25"


@query(
    "ud3_injected_score",
    f"""WITH b AS (SELECT month, {_AWAY} AS before FROM ({_CHANGED}) GROUP BY 1),
 a AS (SELECT month, 'clip' AS candidate, {_AWAY} AS after FROM (SELECT month, least(v, 45) AS v FROM ({_CHANGED})) GROUP BY 1 UNION ALL SELECT month, 'shift', {_AWAY} FROM (SELECT month, v - 0.5 AS v FROM ({_CHANGED})) GROUP BY 1),
 i AS (SELECT month, candidate, before - after AS improvement, row_number() OVER (PARTITION BY month ORDER BY before - after DESC, candidate) AS k FROM a JOIN b USING (month))
 SELECT month, candidate, round(improvement, 5) AS improvement FROM i WHERE k = 1""",
)
def injected(spark: SparkSession, sf: str) -> DataFrame:
    rows = t(spark, sf, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM").alias("month"), F.col("l_quantity").cast("double").alias("v"))
    candidates = {
        "clip": lambda df: df.withColumn("v", F.least("v", F.lit(45.0))),
        "shift": lambda df: df.withColumn("v", F.col("v") - 0.5),
        "broken": lambda df: df.withColumn("v", F.col("no_such_column")),
    }
    scored = H.score_candidates(rows, candidates, ["month"], F.abs(F.avg("v") - 25) / 25)
    return H.select_repair(scored, ["month"]).select("month", "candidate", F.round("improvement", 5).alias("improvement"))


@query(
    "dr21_drift_gated_write",
    f"""WITH stat AS ({P.SQL["dr5_statistical_drift"]}), m AS (SELECT strftime(l_shipdate, '%Y-%m') AS month, l_quantity AS v, coalesce(severity IN ('medium', 'high', 'critical'), false) AS hit FROM lineitem LEFT JOIN stat ON month = strftime(l_shipdate, '%Y-%m'))
 SELECT month, CASE WHEN NOT hit THEN 'lake' WHEN substr(month, 7, 1) <> '1' THEN 'lake' ELSE 'held' END AS place, count(*) AS n, round(sum(CASE WHEN hit AND substr(month, 7, 1) <> '1' THEN least(v, 45) ELSE v END), 2) AS quantity FROM m GROUP BY ALL""",
)
def written(spark: SparkSession, sf: str) -> DataFrame:
    rows = t(spark, sf, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM").alias("month"), F.col("l_quantity").alias("v"))
    drifts = P.statistical(spark, sf).select("month", "severity", (F.substring("month", 7, 1) != "1").alias("healed"))
    lake, held = H.gated(rows, drifts, ["month"], lambda df: df.withColumn("v", F.least("v", F.lit(45.0))))
    both = kept(lake.select(F.lit("lake").alias("place"), "month", "v"), "lake").unionByName(kept(held.select(F.lit("held").alias("place"), "month", "v"), "held"))
    return both.groupBy("month", "place").agg(F.count("*").alias("n"), F.round(F.sum("v"), 2).alias("quantity"))


@query("dr24_healing_alerts", """WITH m AS (SELECT o_orderpriority AS source, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS total, round(count(*) FILTER (o_orderstatus = 'F') / count(*), 6) AS quality, round(count(*) FILTER (o_orderstatus = 'F') / count(*) * least(1, 60 / greatest(coalesce(avg(o_orderkey % 150) FILTER (o_orderkey % 150 > 0), 1), 1e-3)), 6) AS composite FROM orders GROUP BY ALL),
 f AS (SELECT *, coalesce(lag(composite) OVER w > composite AND lag(composite, 2) OVER w > lag(composite) OVER w AND lag(composite, 3) OVER w > lag(composite, 2) OVER w AND lag(composite, 4) OVER w > lag(composite, 3) OVER w, false) AS falls FROM m WINDOW w AS (PARTITION BY source ORDER BY month))
 SELECT source, month, 'quality' AS metric, 'critical' AS level, quality AS value FROM f WHERE total >= 3 AND quality < 0.3 UNION ALL SELECT source, month, 'composite', 'critical', composite FROM f WHERE total >= 3 AND composite < 0.2 UNION ALL SELECT source, month, 'trend', 'warning', composite FROM f WHERE falls""")
def alerts(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "deployed").when(F.col("o_orderstatus") == "P", "failed").otherwise("pending")
    events = t(spark, sf, "orders").select(F.struct(F.col("o_orderpriority").alias("source"), F.date_format("o_orderdate", "yyyy-MM").alias("month")).alias("source"), status.alias("status"), (F.col("o_orderkey") % 150).alias("latency"))
    scores = D.healing_scores(events).select("source.source", "source.month", "total", F.round("quality", 6).alias("quality"), F.round("composite", 6).alias("composite"))
    return H.healing_alerts(scores, "source", "month", {"quality": 0.3, "composite": 0.2})


# ------------------------------------------------------------ versions and status
@query("dr25_baseline_register", f"""WITH q AS ({P._hist("SELECT l_returnflag AS source, 'l_quantity' AS \"column\", l_quantity AS v FROM lineitem WHERE l_shipdate < '1996-01-01'", "source")}), v AS (SELECT 1 AS version, source, "column", bin, n FROM q) SELECT * FROM v""")
def registered(spark: SparkSession, sf: str) -> DataFrame:
    rows = t(spark, sf, "lineitem").filter("l_shipdate < '1996-01-01'").withColumnRenamed("l_returnflag", "source")
    counts = D.histograms(D.long_form(rows, ["source"], ["l_quantity"]), ["source"])
    # one folder for each source and version, read back as the reference of later batches
    return kept(counts.withColumn("version", F.lit(1)), "baseline", by=["source", "version"]).select("version", "source", "column", "bin", "n")


@query(
    "dr25_whole_baseline",
    f"""WITH o AS (SELECT o_orderstatus AS source, o_orderpriority, o_totalprice FROM orders), tokens AS (SELECT source, 'o_orderpriority:' || o_orderpriority AS token FROM o),
 sums AS (SELECT source, CAST('0x' || substr(md5(token), 1, 8) AS BIGINT) % 256 AS bucket, sum(CASE WHEN CAST('0x' || substr(md5(token), 9, 8) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END) AS w FROM tokens GROUP BY ALL),
 q AS ({P._hist("SELECT source, 'o_totalprice' AS \"column\", o_totalprice AS v FROM o", "source")})
 SELECT source, 'schema' AS part, name AS item, NULL::DOUBLE AS value, 3 AS version FROM (SELECT DISTINCT source FROM o), (VALUES ('o_totalprice=double'), ('o_orderpriority=string')) n(name)
 UNION ALL SELECT source, 'histogram', "column" || '=' || bin, n, 3 FROM q UNION ALL SELECT source, 'vector', CAST(bucket AS VARCHAR), round(w / sqrt(sum(w * w) OVER (PARTITION BY source)), 6), 3 FROM sums""",
)
def whole_baseline(spark: SparkSession, sf: str) -> DataFrame:
    """Schema, histograms and vector of each source, kept by source and version and read back."""
    rows = t(spark, sf, "orders").select(F.col("o_orderstatus").alias("source"), "o_orderpriority", "o_totalprice")
    held = {k: kept(v, f"baseline-{k}", by=["source", "version"]) for k, v in D.baseline(rows, ["source"], ["o_totalprice"], ["o_orderpriority"], version=3).items()}
    items = {"schema": (F.concat_ws("=", "name", "type"), F.lit(None)), "histogram": (F.concat_ws("=", "column", "bin"), F.col("n")), "vector": (F.col("bucket").cast("string"), F.round("w", 6))}
    parts = [held[k].select("source", F.lit(k).alias("part"), item.alias("item"), value.cast("double").alias("value"), "version") for k, (item, value) in items.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("dr26_reference_versions", "SELECT o_orderpriority AS source, arg_max(o_orderkey % 7, (o_orderdate, o_orderkey)) AS version FROM orders GROUP BY 1")
def versions(spark: SparkSession, sf: str) -> DataFrame:
    rows = t(spark, sf, "orders").select(F.col("o_orderpriority").alias("source"), (F.col("o_orderkey") % 7).alias("version"), "o_orderdate", "o_orderkey")
    return H.active_versions(rows, "source", "version", ["o_orderdate", "o_orderkey"])


@query("dr27_source_status", """WITH e AS (SELECT l_suppkey AS source, count(*) AS k, max(l_shipdate) AS latest FROM lineitem WHERE l_quantity > 49 GROUP BY 1), b AS (SELECT DISTINCT s_suppkey AS source FROM supplier WHERE s_nationkey % 2 = 0), r AS (SELECT l_suppkey AS source, count(*) AS deployed FROM lineitem WHERE l_quantity < 2 AND l_returnflag = 'R' GROUP BY 1)
 SELECT source, least(coalesce(k, 0), 3) AS recent, latest, b.source IS NOT NULL AS has_baseline, coalesce(deployed, 0) AS deployed FROM e FULL JOIN b USING (source) FULL JOIN r USING (source)""".replace("b.source IS NOT NULL", "source IN (SELECT source FROM b)"))
def status(spark: SparkSession, sf: str) -> DataFrame:
    items = t(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "source")
    known = t(spark, sf, "supplier").filter("s_nationkey % 2 = 0").select(F.col("s_suppkey").alias("source"))
    repairs = items.filter("l_quantity < 2").select("source", (F.col("l_returnflag") == "R").alias("active"))
    return H.source_status(items.filter("l_quantity > 49"), known, repairs, "source", ["l_shipdate", "l_orderkey", "l_linenumber"])


@query("dr29_apply_repairs", "SELECT l_returnflag, count(*) AS n, round(sum(least(l_quantity, 40) * 10), 2) AS quantity FROM lineitem GROUP BY 1")
def repaired(spark: SparkSession, sf: str) -> DataFrame:
    chain = [
        ("clip", lambda df: df.withColumn("l_quantity", F.least("l_quantity", F.lit(40.0))), True),
        ("off", lambda df: df.limit(0), False),
        ("scale", lambda df: df.withColumn("l_quantity", F.col("l_quantity") * 10), True),
        ("doubled", lambda df: df.withColumn("l_quantity", F.col("l_quantity") * 2), True),
    ]
    # the last one is rolled back; a further one that names no column stops the chain
    chain = [*H.roll_back(chain), ("broken", lambda df: df.withColumn("x", F.col("no_such_column")), True), ("after", lambda df: df.limit(0), True)]
    df, _ = H.apply_repairs(t(spark, sf, "lineitem"), chain)
    return df.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("dr30_deploy_gate", "SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN false ELSE o_orderstatus IN ('F', 'O') END AS deploy FROM orders")
def deployed(spark: SparkSession, sf: str) -> DataFrame:
    severity = F.when(F.col("o_orderstatus") == "F", "low").when(F.col("o_orderstatus") == "O", F.lit(None)).otherwise("high")
    repairs = t(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderpriority").startswith("1"), "model").alias("method"), severity.alias("severity"))
    return H.deploy_gate(repairs).select("o_orderkey", "deploy")
