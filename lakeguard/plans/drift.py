"""Queries of drift, alarms and healing, over monthly, quarterly and yearly batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeguard.operators import drift as D
from lakeguard.plans.profile import GAPS, gaps
from lakeguard.plans.steps import t

QUERIES: dict = {}
SQL: dict[str, str] = {}


def registrar(queries: dict, sqls: dict):
    """The decorator that enters a query, and the SQL that it is held against, under a name."""

    def query(name: str, sql: str | None = None):
        def register(f):
            queries[name] = f
            if sql:
                sqls[name] = sql
            return f

        return register

    return query


query = registrar(QUERIES, SQL)


def monthly(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Months from 1996 on, and the rows of 1995 as their baseline."""
    df = D.long_form(t(spark, sf, "lineitem").withColumn("month", F.date_format("l_shipdate", "yyyy-MM")), ["month"], ["l_quantity", "l_tax"])
    return df.filter("month >= '1996'"), df.filter("month < '1996'").drop("month")


def quarterly(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    df = t(spark, sf, "orders").withColumn("quarter", F.concat(F.year("o_orderdate"), F.lit("-"), F.quarter("o_orderdate")))
    df = D.long_form(df, ["quarter"], ["o_totalprice"])
    return df.filter("quarter >= '1996'"), df.filter("quarter < '1996'").drop("quarter")


LONG = """long AS (SELECT strftime(l_shipdate, '%Y-%m') AS month, 'l_quantity' AS "column", l_quantity AS v FROM lineitem UNION ALL SELECT strftime(l_shipdate, '%Y-%m'), 'l_tax', l_tax FROM lineitem)"""


def _hist(rows: str, keys: str) -> str:
    by = f'{keys}, "column"' if keys else '"column"'
    return f"SELECT {by}, CASE WHEN hi = lo THEN 0 ELSE CAST(least(floor((v - lo) / (hi - lo) * 50), 49) AS BIGINT) END AS bin, count(*) AS n FROM (SELECT *, min(v) OVER w AS lo, max(v) OVER w AS hi FROM ({rows}) WINDOW w AS (PARTITION BY {by})) GROUP BY ALL"


KL = f"""{LONG}, p AS ({_hist("SELECT * FROM long WHERE month >= '1996'", "month")}), q AS ({_hist("SELECT * FROM long WHERE month < '1996'", "")}),
 grid AS (SELECT month, "column", bin, sum(p) AS p, sum(q) AS q FROM (SELECT month, "column", bin, n AS p, 0 AS q FROM p UNION ALL SELECT h.month, q."column", q.bin, 0, q.n FROM q JOIN (SELECT DISTINCT month, "column" FROM p) h USING ("column")) GROUP BY ALL),
 share AS (SELECT *, p / sum(p) OVER w + 1e-10 AS a, q / sum(q) OVER w + 1e-10 AS b FROM grid WINDOW w AS (PARTITION BY month, "column")),
 kl AS (SELECT month, "column", greatest(sum(a * ln(a / b)), 0) AS kl FROM share GROUP BY ALL),
 shift AS (SELECT month, "column", abs(avg(v) - any_value(m)) / any_value(s) AS shift FROM long JOIN (SELECT "column", avg(v) AS m, stddev_pop(v) AS s FROM long WHERE month < '1996' GROUP BY 1) USING ("column") WHERE month >= '1996' GROUP BY ALL)"""


def _schemas(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys…, name, type) of the columns that have values in a batch."""
    named = D.long_form(df, keys, columns).groupBy(*keys, F.col("column").alias("name"))
    return named.agg(F.when(F.bool_and(F.col("v") == F.floor("v")), "integer").otherwise("double").alias("type"))


@query("dr1_schema_drift", f"""SELECT month, 'schema_change' AS kind, 0::BIGINT AS added, count(*) FILTER (n = 0) AS removed, 0::BIGINT AS changed, 'high' AS severity FROM (SELECT month, 'quantity' AS name, count(quantity) AS n FROM {GAPS} GROUP BY 1 UNION ALL SELECT month, 'tax', count(tax) FROM {GAPS} GROUP BY 1) GROUP BY month HAVING count(*) FILTER (n = 0) > 0""")
def schema(spark: SparkSession, sf: str) -> DataFrame:
    found = _schemas(gaps(spark, sf), ["month"], ["quantity", "tax"])
    baseline = _schemas(gaps(spark, sf), [], ["quantity", "tax"])
    return D.schema_drift(found, baseline.withColumn("type", F.lit("unknown")), ["month"])


@query("dr2_kl_divergence", f"""WITH {KL} SELECT month, "column", round(kl, 6) AS kl FROM kl""")
def kl(spark: SparkSession, sf: str) -> DataFrame:
    new, base = monthly(spark, sf)
    return D.kl_divergence(D.histograms(new, ["month"]), D.histograms(base), ["month"]).withColumn("kl", F.round("kl", 6))


@query("dr3_location_shift", f"""WITH {KL} SELECT month, "column", round(shift, 6) AS shift FROM shift""")
def shift(spark: SparkSession, sf: str) -> DataFrame:
    return D.location_shift(*monthly(spark, sf), ["month"]).withColumn("shift", F.round("shift", 6))


def _measures(spark: SparkSession, sf: str) -> DataFrame:
    month = F.date_format("l_shipdate", "yyyy-MM")
    rows = t(spark, sf, "lineitem").withColumn("month", F.when(month >= "1996", month))  # 1995 is the baseline
    return D.measures(D.long_form(rows, ["month"], ["l_quantity", "l_tax"]), "month").withColumn("source", F.lit("lineitem"))


#: No month moves by two deviations here, so history is plain and a window says the same as the fold.
FOLD = f"""WITH {KL}, m AS (SELECT month, avg(round(kl, 6)) AS average, max(kl) AS top, row_number() OVER (ORDER BY month) AS k FROM kl GROUP BY month),
 z AS (SELECT month, top, k, CASE WHEN k <= 5 THEN 0.15 ELSE greatest(avg(average) OVER w + 2 * stddev_pop(average) OVER w, 0.075) END AS zeta FROM m WINDOW w AS (ORDER BY month ROWS BETWEEN 200 PRECEDING AND 1 PRECEDING))"""


@query("dr4_adaptive_threshold", f"{FOLD} SELECT month, round(zeta, 6) AS zeta FROM z")
def threshold(spark: SparkSession, sf: str) -> DataFrame:
    return D.statistical_drift(_measures(spark, sf), "source", "month").select("month", F.round("zeta", 6).alias("zeta"))


@query("dr5_statistical_drift", f"{FOLD} SELECT month, round(CASE WHEN top > zeta THEN top ELSE 0 END, 6) AS max_kl, top > zeta AND k > 5 AS flagged, CASE WHEN top > zeta AND k > 5 THEN CASE WHEN top > 3 * zeta THEN 'critical' WHEN top > 2 * zeta THEN 'high' WHEN top > 1.5 * zeta THEN 'medium' ELSE 'low' END END AS severity FROM z")
def statistical(spark: SparkSession, sf: str) -> DataFrame:
    return D.statistical_drift(_measures(spark, sf), "source", "month").select("month", F.round("max_kl", 6).alias("max_kl"), "flagged", "severity")


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return D.batch_vectors(t(spark, sf, "orders").withColumn("year", F.year("o_orderdate")), ["year"], ["o_orderpriority", "o_orderstatus"])


VECTORS = """tokens AS (SELECT year(o_orderdate) AS year, unnest(['o_orderpriority:' || o_orderpriority, 'o_orderstatus:' || o_orderstatus]) AS token FROM orders),
 sums AS (SELECT year, CAST('0x' || substr(md5(token), 1, 8) AS BIGINT) % 256 AS bucket, sum(CASE WHEN CAST('0x' || substr(md5(token), 9, 8) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END) AS w FROM tokens GROUP BY ALL),
 vec AS (SELECT year, bucket, w / sqrt(sum(w * w) OVER (PARTITION BY year)) AS w FROM sums)"""


@query("dr6_batch_embedding", f"WITH {VECTORS} SELECT CAST(year AS INTEGER) AS year, bucket, round(w, 6) AS w FROM vec")
def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return _vectors(spark, sf).withColumn("w", F.round("w", 6))


@query("dr7_semantic_drift", f"WITH {VECTORS} SELECT CAST(a.year AS INTEGER) AS year, round(1 - sum(a.w * b.w), 6) AS distance, CASE WHEN 1 - sum(a.w * b.w) > 0.75 THEN 'critical' WHEN 1 - sum(a.w * b.w) > 0.5 THEN 'high' WHEN 1 - sum(a.w * b.w) > 0.375 THEN 'medium' WHEN 1 - sum(a.w * b.w) > 0.25 THEN 'low' END AS severity FROM vec a JOIN (SELECT * FROM vec WHERE year = (SELECT min(year) FROM vec)) b USING (bucket) GROUP BY a.year")
def semantic(spark: SparkSession, sf: str) -> DataFrame:
    found = _vectors(spark, sf)
    first = found.agg(F.min("year").alias("first"))
    reference = found.join(F.broadcast(first), F.col("year") == F.col("first")).select(F.col("year").alias("reference"), "bucket", "w")
    return D.semantic_drift(found, reference, ["year"], "reference").withColumn("distance", F.round("distance", 6) + 0.0)


W1 = """r AS (SELECT year(o_orderdate) || '-' || quarter(o_orderdate) AS quarter, o_totalprice AS v FROM orders),
 a AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS n FROM r WHERE quarter < '1996'),
 b AS (SELECT quarter, v, row_number() OVER (PARTITION BY quarter ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY quarter) AS n FROM r WHERE quarter >= '1996'),
 sizes AS (SELECT DISTINCT quarter, b.n AS nb, na FROM b, (SELECT max(n) AS na FROM a)),
 l AS (SELECT quarter, v, i, n, na AS m FROM b JOIN sizes USING (quarter) WHERE nb >= na UNION ALL SELECT quarter, v, i, n, nb FROM a, sizes WHERE nb < na),
 s AS (SELECT quarter, v, i FROM a, sizes WHERE nb >= na UNION ALL SELECT quarter, v, i FROM b JOIN sizes USING (quarter) WHERE nb < na),
 spot AS (SELECT quarter, v, m, CASE WHEN n = m THEN CAST(i AS DOUBLE) WHEN n = 1 THEN 0 ELSE i * (m - 1) / (n - 1) END AS place FROM l),
 w1 AS (SELECT spot.quarter, avg(abs(spot.v - (x.v * (1 - place + floor(place)) + y.v * (place - floor(place))))) AS w1 FROM spot JOIN s x ON x.quarter = spot.quarter AND x.i = floor(place) JOIN s y ON y.quarter = spot.quarter AND y.i = least(floor(place) + 1, m - 1) GROUP BY 1)"""


@query("dr10_wasserstein", f"WITH {W1} SELECT quarter, round(w1, 4) AS w1 FROM w1")
def distance(spark: SparkSession, sf: str) -> DataFrame:
    return D.wasserstein(*quarterly(spark, sf), ["quarter"]).select("quarter", F.round("w1", 4).alias("w1"))


@query(
    "dr11_azuma_martingale",
    f"""WITH {W1}, d AS (SELECT *, row_number() OVER (ORDER BY quarter) AS k FROM w1), e AS (SELECT avg(w1) AS e FROM d WHERE k <= 8), c AS (SELECT max(abs(w1 - e)) AS c FROM d, e WHERE k <= 8),
 m AS (SELECT quarter, k, c, sum(CASE WHEN k > 8 THEN greatest(least(w1 - e, c), -c) ELSE 0 END) OVER (ORDER BY k) AS m FROM d, e, c)
 SELECT quarter, round(m, 2) AS m, CASE WHEN k > 8 THEN round(sqrt(2 * ln(1 / 0.01) * (k - 8)) * c, 2) END AS epsilon, k > 8 AND abs(m) >= sqrt(2 * ln(1 / 0.01) * greatest(k - 8, 0)) * c AS alarm FROM m""",
)
def martingale(spark: SparkSession, sf: str) -> DataFrame:
    found = D.azuma_alarms(D.wasserstein(*quarterly(spark, sf), ["quarter"]), ["column"], "quarter", learn=8)
    return found.select("quarter", F.round("m", 2).alias("m"), F.round("epsilon", 2).alias("epsilon"), "alarm")


@query("dr22_canary_split", "SELECT CASE WHEN (o_orderkey % 1000) / 1000 < 0.75 THEN 'current' ELSE 'canary' END AS version, count(*) AS n FROM orders GROUP BY 1")
def canary(spark: SparkSession, sf: str) -> DataFrame:
    return D.canary_split(t(spark, sf, "orders"), F.col("o_orderkey"), {"current": 3.0, "canary": 1.0}).groupBy("version").agg(F.count("*").alias("n"))


@query(
    "dr22_canary_promotion",
    """WITH r AS (SELECT o_orderpriority AS source, o_orderstatus AS version, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY o_orderpriority) AS weight FROM orders GROUP BY o_orderpriority, o_orderstatus),
 k AS (SELECT o_orderpriority AS source, avg(o_orderkey % 100 / 100.0) AS avg_score FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS i FROM orders WHERE o_orderstatus = 'P') WHERE i <= 3 GROUP BY 1 HAVING count(*) = 3),
 g AS (SELECT r.*, k.avg_score, k.avg_score >= 0.5 AS hit, CASE WHEN k.avg_score >= 0.5 THEN least(1, (SELECT c.weight FROM r c WHERE c.source = r.source AND c.version = 'P') + 0.2) - (SELECT c.weight FROM r c WHERE c.source = r.source AND c.version = 'P') ELSE 0 END AS gain, sum(CASE WHEN version = 'F' THEN r.weight ELSE 0 END) OVER (PARTITION BY r.source) AS others FROM r LEFT JOIN k USING (source))
 SELECT source, version, round(CASE WHEN version = 'P' THEN weight + gain WHEN version = 'F' THEN greatest(0, weight * (1 - gain / others)) ELSE weight END, 6) AS weight, CASE WHEN version = 'P' THEN round(avg_score, 6) END AS avg_score, CASE WHEN version = 'P' THEN coalesce(hit, false) END AS promoted FROM g""",
)
def promotion(spark: SparkSession, sf: str) -> DataFrame:
    """Routes by the share of orders in each status, one a canary, one being drained."""
    orders = t(spark, sf, "orders").select(F.col("o_orderpriority").alias("source"), F.col("o_orderstatus").alias("version"), "o_orderdate", "o_orderkey", (F.col("o_orderkey") % 100 / 100.0).alias("score"))
    counts = orders.groupBy("source", "version").agg(F.count("*").alias("n"))
    totals = counts.groupBy("source").agg(F.sum("n").alias("all"))
    routes = counts.join(totals, "source").select("source", "version", (F.col("n") / F.col("all")).alias("weight"), (F.col("version") == "P").alias("canary"), (F.col("version") == "O").alias("drained"))
    found = D.promote_canaries(routes, orders, "source", ["o_orderdate", "o_orderkey"], least_score=0.5)
    return found.select("source", "version", F.round("weight", 6).alias("weight"), F.round("avg_score", 6).alias("avg_score"), "promoted")


@query("dr23_healing_score", """SELECT source, total, resolved, failed, round(resolved / total, 6) AS quality, round(least(1, 60 / lat), 6) AS speed, round(resolved / total * ln(1 + 1 / lat), 6) AS contribution, round(resolved / total * least(1, 60 / lat), 6) AS composite
 FROM (SELECT o_orderpriority AS source, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS resolved, count(*) FILTER (o_orderstatus = 'P') AS failed, avg(o_orderkey % 150) FILTER (o_orderkey % 150 > 0) AS lat FROM orders GROUP BY 1)""")
def healing(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "deployed").when(F.col("o_orderstatus") == "P", "failed").otherwise("pending")
    events = t(spark, sf, "orders").select(F.col("o_orderpriority").alias("source"), status.alias("status"), (F.col("o_orderkey") % 150).alias("latency"))
    return D.healing_scores(events).drop("latency").withColumns({c: F.round(c, 6) for c in ("quality", "speed", "contribution", "composite")})


_STATES = "SELECT o_orderpriority AS source, ['schema', 'semantic', 'statistical'][o_orderkey % 3 + 1] AS drift_type, o_orderstatus AS s, o_orderkey % 150 AS latency FROM orders"


def _healed(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "deployed").when(F.col("o_orderstatus") == "P", "failed").otherwise("pending")
    kinds = F.array(*map(F.lit, ("schema", "semantic", "statistical")))
    return t(spark, sf, "orders").select(F.col("o_orderpriority").alias("source"), F.get(kinds, (F.col("o_orderkey") % 3).cast("int")).alias("drift_type"), status.alias("status"), (F.col("o_orderkey") % 150).alias("latency"))


@query("dr23_healing_by_type", f"SELECT source, drift_type, count(*) AS total, count(*) FILTER (s = 'F') AS resolved, round(count(*) FILTER (s = 'F') / count(*), 6) AS quality, round(coalesce(avg(latency) FILTER (latency > 0), 0), 6) AS latency FROM ({_STATES}) GROUP BY ALL")
def healing_types(spark: SparkSession, sf: str) -> DataFrame:
    return D.healing_by_type(_healed(spark, sf)).withColumns({c: F.round(c, 6) for c in ("quality", "latency")})


@query(
    "dr23_healing_summary",
    f"""SELECT count(*) AS sources, CAST(sum(total) AS BIGINT) AS total, CAST(sum(resolved) AS BIGINT) AS resolved, round(avg(resolved / total * ln(1 + 1 / lat)), 6) AS contribution, round(avg(resolved / total), 6) AS quality, round(avg(least(1, 60 / lat)), 6) AS speed, round(avg(resolved / total * least(1, 60 / lat)), 6) AS composite
 FROM (SELECT source, count(*) AS total, count(*) FILTER (s = 'F') AS resolved, avg(latency) FILTER (latency > 0) AS lat FROM ({_STATES}) GROUP BY 1)""",
)
def healing_over_sources(spark: SparkSession, sf: str) -> DataFrame:
    found = D.healing_summary(D.healing_scores(_healed(spark, sf).drop("drift_type")))
    return found.withColumns({c: F.round(c, 6) for c in ("contribution", "quality", "speed", "composite")})


@query("dr28_missing_source", "SELECT s_suppkey, CAST(y.year AS INTEGER) AS year FROM supplier, (SELECT DISTINCT year(l_shipdate) AS year FROM lineitem) y WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND year(l_shipdate) = y.year AND l_quantity >= 50 AND l_discount > 0.095)")
def missing(spark: SparkSession, sf: str) -> DataFrame:
    items = t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), F.year("l_shipdate").alias("year"), "l_quantity", "l_discount")
    expected = t(spark, sf, "supplier").select("s_suppkey").crossJoin(F.broadcast(items.select("year").distinct()))  # a row for each year
    return D.missing_sources(expected, items.filter("l_quantity >= 50 AND l_discount > 0.095"), ["s_suppkey", "year"])
