"""Queries of profiles, data quality and insights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeguard.operators import profile as P
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


def items(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "lineitem")


def gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Line items by month with nulls that follow from the keys."""
    return items(spark, sf).select(F.date_format("l_shipdate", "yyyy-MM").alias("month"), F.when(F.col("l_orderkey") % 3 != 0, F.col("l_quantity")).alias("quantity"), F.when(F.month("l_shipdate") % 2 == 0, F.col("l_tax")).alias("tax"))


GAPS = "(SELECT strftime(l_shipdate, '%Y-%m') AS month, CASE WHEN l_orderkey % 3 <> 0 THEN l_quantity END AS quantity, CASE WHEN month(l_shipdate) % 2 = 0 THEN l_tax END AS tax FROM lineitem)"


def _profile_sql(columns: dict[str, bool], table: str) -> str:
    parts = []
    for c, number in columns.items():
        stats = f"CAST(min({c}) AS DOUBLE), CAST(max({c}) AS DOUBLE), round(avg({c}), 6)" if number else "CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE)"
        top = f"(SELECT string_agg(v, '|' ORDER BY n DESC, v) FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n FROM {table} WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT 3))"
        parts.append(f"SELECT '{c}', count({c}), count(*) - count({c}), count(DISTINCT {c}), {stats}, {top} FROM {table}")
    return 'SELECT * FROM (' + " UNION ALL ".join(parts) + ') v("column", non_null, nulls, "distinct", "min", "max", mean, top)'


@query("ag6_profile_table", _profile_sql({"c_custkey": True, "c_nationkey": True, "c_mktsegment": False}, "customer"))
def profile(spark: SparkSession, sf: str) -> DataFrame:
    return P.profile_table(t(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")).withColumn("mean", F.round("mean", 6))


@query(
    "ag7_describe_numeric",
    """SELECT count(l_extendedprice) AS "count", round(avg(l_extendedprice), 4) AS mean, min(l_extendedprice) AS "min", max(l_extendedprice) AS "max", round(max(l_extendedprice) - min(l_extendedprice), 4) AS "range", round(stddev(l_extendedprice), 4) AS std, round(median(l_extendedprice), 4) AS median,
    list_sort(list(l_extendedprice))[greatest(1, CAST(floor(count(*) * 0.25) AS BIGINT))] AS p25, list_sort(list(l_extendedprice))[least(count(*), CAST(floor(count(*) * 0.75) AS BIGINT) + 1)] AS p75 FROM lineitem""",
)
def describe(spark: SparkSession, sf: str) -> DataFrame:
    df = P.describe_numeric(items(spark, sf), "l_extendedprice")
    return df.withColumns({c: F.round(c, 4) for c in ("mean", "range", "std", "median")})


@query("ag8_classify_columns", """SELECT * FROM (VALUES ('c_custkey', 'id'), ('c_name', 'text'), ('c_nationkey', 'numeric'), ('c_acctbal', 'numeric'), ('c_mktsegment', 'categorical')) v("column", kind)""")
def classify(spark: SparkSession, sf: str) -> DataFrame:
    return P.classify_columns(t(spark, sf, "customer"))


@query("ag9_source_counts", "SELECT count(*) AS active_sources, CAST(sum(n) AS BIGINT) AS total_rows FROM (SELECT count(*) AS n FROM orders UNION ALL SELECT count(*) FROM customer UNION ALL SELECT count(*) FROM supplier) WHERE n > 0")
def source_counts(spark: SparkSession, sf: str) -> DataFrame:
    counts = [t(spark, sf, x).agg(F.count("*").alias("n")) for x in ("orders", "customer", "supplier")]
    return counts[0].union(counts[1]).union(counts[2]).filter("n > 0").agg(F.count("*").alias("active_sources"), F.sum("n").alias("total_rows"))


@query("ag12_histogram", "SELECT 'l_extendedprice' AS \"column\", CAST(least(floor((l_extendedprice - lo) / ((hi - lo) / 50)), 49) AS BIGINT) AS bin, count(*) AS n FROM lineitem, (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem) GROUP BY 2")
def histogram(spark: SparkSession, sf: str) -> DataFrame:
    return P.histogram(items(spark, sf), ["l_extendedprice"])


@query("ag13_category_counts", """SELECT 'l_returnflag' AS "column", l_returnflag AS value, count(*) AS n FROM lineitem GROUP BY 2 UNION ALL SELECT 'l_linestatus', l_linestatus, count(*) FROM lineitem GROUP BY 2""")
def categories(spark: SparkSession, sf: str) -> DataFrame:
    return P.category_counts(items(spark, sf), ["l_returnflag", "l_linestatus"])


@query(
    "ag14_batch_distribution",
    f"""SELECT month, 'quantity' AS "column", round(avg(quantity), 4) AS mean, round(stddev_pop(quantity), 4) AS std, round(1 - count(quantity) / count(*), 4) AS null_rate, count(DISTINCT quantity) AS "distinct", count(*) AS n FROM {GAPS} GROUP BY month
    UNION ALL SELECT month, 'tax', round(avg(tax), 4), round(stddev_pop(tax), 4), round(1 - count(tax) / count(*), 4), count(DISTINCT tax), count(*) FROM {GAPS} GROUP BY month""",
)
def batch(spark: SparkSession, sf: str) -> DataFrame:
    df = P.batch_stats(gaps(spark, sf), ["month"], ["quantity", "tax"])
    return df.withColumns({c: F.round(c, 4) for c in ("mean", "std", "null_rate")})


@query("ag15_correlation_matrix", "SELECT 'l_quantity' AS a, 'net' AS b, round(corr(l_quantity, l_quantity * (1 - l_discount)), 6) AS r, 'strong' AS strength FROM lineitem")
def correlation(spark: SparkSession, sf: str) -> DataFrame:
    df = items(spark, sf).withColumn("net", F.col("l_quantity") * (1 - F.col("l_discount")))
    return P.correlations(df, ["l_quantity", "net", "l_tax"]).withColumn("r", F.round("r", 6))


@query("ag18_data_card", """SELECT * FROM (SELECT 's_suppkey' AS "column", 'bigint' AS type, count(*) AS "rows", count(DISTINCT s_suppkey) AS "distinct", 0.0::DOUBLE AS null_share FROM supplier UNION ALL SELECT 's_name', 'string', count(*), count(DISTINCT s_name), 0.0 FROM supplier)""")
def card(spark: SparkSession, sf: str) -> DataFrame:
    return P.data_card(t(spark, sf, "supplier").select("s_suppkey", "s_name"))


@query("ag19_session_counts", "SELECT conv_id, max(turn) AS last_turn, count(*) AS messages FROM conversations GROUP BY conv_id")
def sessions(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last_turn"), F.count("*").alias("messages")).orderBy(F.desc("last_turn"), "conv_id")


@query("wf4_trend_halves", "SELECT round(avg(v) FILTER (k <= n // 2), 4) AS \"first\", round(avg(v) FILTER (k > n // 2), 4) AS \"second\", max(n) AS n, abs((avg(v) FILTER (k > n // 2) - avg(v) FILTER (k <= n // 2)) / avg(v) FILTER (k <= n // 2)) >= 0.1 AS flagged FROM (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS k, count(*) OVER () AS n FROM orders)")
def trend(spark: SparkSession, sf: str) -> DataFrame:
    df = P.trend_halves(t(spark, sf, "orders"), "o_totalprice", [F.col("o_orderdate"), F.col("o_orderkey")])
    return df.select(F.round("first", 4).alias("first"), F.round("second", 4).alias("second"), "n", "flagged")


@query("wf5_zscore_anomaly", "SELECT o_orderkey, round(abs(o_totalprice - m) / s, 6) AS z FROM orders, (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM orders) WHERE abs(o_totalprice - m) / s > 1.5")
def zscore(spark: SparkSession, sf: str) -> DataFrame:
    return P.zscore_anomalies(t(spark, sf, "orders"), "o_totalprice", threshold=1.5).select("o_orderkey", F.round("z", 6).alias("z"))


IQR = "(SELECT list_sort(list(v))[CAST(floor(count(*) * 0.25) AS BIGINT) + 1] AS q1, list_sort(list(v))[CAST(floor(count(*) * 0.75) AS BIGINT) + 1] AS q3 FROM (SELECT l_extendedprice * l_quantity AS v FROM lineitem))"


@query("wf6_iqr_outliers", f"SELECT l_orderkey, l_linenumber FROM lineitem, {IQR} WHERE l_extendedprice * l_quantity < q1 - 1.5 * (q3 - q1) OR l_extendedprice * l_quantity > q3 + 1.5 * (q3 - q1)")
def iqr(spark: SparkSession, sf: str) -> DataFrame:
    return P.iqr_outliers(items(spark, sf).withColumn("v", F.col("l_extendedprice") * F.col("l_quantity")), "v").select("l_orderkey", "l_linenumber")


CHECKS = f"""SELECT 'row_count' AS "check", '*' AS "column", CAST(count(*) AS DOUBLE) AS metric, count(*) >= 1 AS passed FROM {GAPS}
 UNION ALL SELECT 'null_rate', 'month', round(1 - count(month) / count(*), 6), 1 - count(month) / count(*) <= 0.1 FROM {GAPS}
 UNION ALL SELECT 'null_rate', 'quantity', round(1 - count(quantity) / count(*), 6), 1 - count(quantity) / count(*) <= 0.1 FROM {GAPS}
 UNION ALL SELECT 'null_rate', 'tax', round(1 - count(tax) / count(*), 6), 1 - count(tax) / count(*) <= 0.1 FROM {GAPS}"""


@query("dq1_null_rate", CHECKS)
def null_rate(spark: SparkSession, sf: str) -> DataFrame:
    return P.quality_checks(gaps(spark, sf)).withColumn("metric", F.round("metric", 6))


@query("dq2_uniqueness", """SELECT 'uniqueness' AS "check", 'o_custkey' AS "column", round(count(DISTINCT o_custkey) / count(*), 6) AS metric, count(DISTINCT o_custkey) = count(*) AS passed FROM orders UNION ALL SELECT 'uniqueness', 'o_orderkey', round(count(DISTINCT o_orderkey) / count(*), 6), count(DISTINCT o_orderkey) = count(*) FROM orders""")
def uniqueness(spark: SparkSession, sf: str) -> DataFrame:
    return P.quality_checks(t(spark, sf, "orders").select("o_orderkey", "o_custkey")).filter(F.col("check") == "uniqueness").withColumn("metric", F.round("metric", 6))


@query("dq3_row_count", """SELECT 'row_count' AS "check", '*' AS "column", CAST(count(*) AS DOUBLE) AS metric, count(*) >= 1 AS passed FROM orders""")
def row_count(spark: SparkSession, sf: str) -> DataFrame:
    return P.quality_checks(t(spark, sf, "orders").select("o_orderstatus")).filter(F.col("check") == "row_count")


@query("dq4_batch_null_alerts", f"""SELECT * FROM (SELECT month, 'quantity' AS "column", round(1 - count(quantity) / count(*), 6) AS null_rate, CASE WHEN 1 - count(quantity) / count(*) > 0.5 THEN 'high' ELSE 'medium' END AS severity FROM {GAPS} GROUP BY month UNION ALL SELECT month, 'tax', round(1 - count(tax) / count(*), 6), CASE WHEN 1 - count(tax) / count(*) > 0.5 THEN 'high' ELSE 'medium' END FROM {GAPS} GROUP BY month) WHERE null_rate > 0.3""")
def null_alerts(spark: SparkSession, sf: str) -> DataFrame:
    return P.null_alerts(gaps(spark, sf), ["month"], ["quantity", "tax"]).withColumn("null_rate", F.round("null_rate", 6))


@query("dq5_threshold_alerts", "SELECT l_orderkey, l_linenumber, 'bulk' AS label FROM lineitem WHERE l_quantity >= 49 UNION ALL SELECT l_orderkey, l_linenumber, 'cheap' FROM lineitem WHERE l_extendedprice < 2000")
def thresholds(spark: SparkSession, sf: str) -> DataFrame:
    rules = [{"column": "l_quantity", "op": ">=", "value": 49, "label": "bulk"}, {"column": "l_extendedprice", "op": "<", "value": 2000, "label": "cheap"}]
    return P.threshold_alerts(items(spark, sf), rules).select("l_orderkey", "l_linenumber", "label")


@query("dq6_quality_audit", f"SELECT count(*) AS checks, count(*) FILTER (passed) AS passed, round(100 * count(*) FILTER (passed) / count(*), 6) AS score FROM ({CHECKS})")
def audit(spark: SparkSession, sf: str) -> DataFrame:
    return P.quality_score(P.quality_checks(gaps(spark, sf))).withColumn("score", F.round("score", 6))


@query("in1_insight_report")
def insights(spark: SparkSession, sf: str) -> DataFrame:
    df = t(spark, sf, "orders")
    return P.insight_report(df, ["o_totalprice"], [F.col("o_orderdate"), F.col("o_orderkey")]).withColumn("value", F.round("value", 6))


@query("jn7_relationship_detect", "SELECT * FROM (VALUES ('orders', 'o_custkey', 'customer', 'c_custkey'), ('nation', 'n_regionkey', 'region', 'r_regionkey'), ('customer', 'c_nationkey', 'nation', 'n_nationkey')) v(child, child_column, parent, parent_column)")
def relations(spark: SparkSession, sf: str) -> DataFrame:
    found = P.relationships({x: t(spark, sf, x) for x in ("customer", "orders", "nation", "region")}, 0.9)
    return found.select("child", "child_column", "parent", "parent_column")
