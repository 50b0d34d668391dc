"""Queries of sources and sinks, operational feedback, vectors and synthetic tables."""

from __future__ import annotations

import math
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeguard.operators import vectors as V
from lakeguard.plans.steps import t
from lakeguard.sources import tables as R

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def shared(spark: SparkSession, name: str) -> str:
    """A new folder of the shared one; a local one where none is named (tests)."""
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", "") or tempfile.mkdtemp(prefix="spark-io-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("io1_read_csv", "SELECT s_suppkey, s_name, s_nationkey, round(s_acctbal, 2) AS s_acctbal FROM supplier")
def read_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = shared(spark, "csv")
    R.write_file(t(spark, sf, "supplier"), path, "csv")
    return R.read_csv(spark, path).select(F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_name", "s_nationkey", F.round("s_acctbal", 2).alias("s_acctbal"))


@query("io2_read_parquet_json", "SELECT n_nationkey, n_name FROM nation")
def read_json(spark: SparkSession, sf: str) -> DataFrame:
    path = shared(spark, "json")
    R.write_file(t(spark, sf, "nation"), path, "json")
    return R.read_file(spark, path, "json").select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name")


@query("io3_register_dataset", "SELECT r_name, count(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name")
def register(spark: SparkSession, sf: str) -> DataFrame:
    R.register(spark, {x: f"{sf}/{x}.parquet" for x in ("region", "nation")}, prefix="ds_")
    return spark.sql("SELECT r_name, count(*) AS n FROM ds_region JOIN ds_nation ON r_regionkey = n_regionkey GROUP BY r_name")


@query("io5_read_kafka_batch", "SELECT event_id, props AS raw, NOT json_valid(CASE WHEN event_id % 5 = 0 THEN 'bad {' ELSE props END) AS broken FROM events")
def parse(spark: SparkSession, sf: str) -> DataFrame:
    df = t(spark, sf, "events").select("event_id", F.col("props").alias("raw"), F.when(F.col("event_id") % 5 == 0, "bad {").otherwise(F.col("props")).alias("value"))
    return R.parse_messages(df, "value").select("event_id", "raw", F.col("_raw").isNotNull().alias("broken"))


@query("io6_read_table_query", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def table_query(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql("SELECT o_orderstatus, count(*) AS n FROM {o} GROUP BY 1", o=t(spark, sf, "orders"))


@query("io7_ledger_normalize", "SELECT sha256('acme-' || o_orderkey || '-invoice') AS erc, 'netsuite' AS system_origin, CAST(o_totalprice - 100 AS DECIMAL(18,2))::DOUBLE AS amount, o_orderpriority AS account_code, strftime(o_orderdate, '%Y-%m-%d') AS posted FROM orders")
def normalize(spark: SparkSession, sf: str) -> DataFrame:
    raw = t(spark, sf, "orders").select(F.col("o_orderkey").alias("internalId"), F.lit("invoice").alias("tranType"), F.col("o_totalprice").alias("debit"), F.lit(100.0).alias("credit"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("tranDate"), F.lit("USD").alias("currency"), F.col("o_orderpriority").alias("accountNumber"), F.lit("").alias("memo"))
    return R.normalize_netsuite(raw, "acme").select("erc", "system_origin", F.col("amount").cast("double").alias("amount"), "account_code", F.date_format("posted_at", "yyyy-MM-dd").alias("posted"))


@query("io8_write_file", "SELECT c_custkey, c_mktsegment FROM customer")
def write(spark: SparkSession, sf: str) -> DataFrame:
    path = shared(spark, "parquet")
    R.write_file(t(spark, sf, "customer").select("c_custkey", "c_mktsegment"), path, "parquet")
    return R.read_file(spark, path, "parquet")


@query("io11_preview")
def preview(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "orders").limit(50)


@query("io12_lake_append_by_name", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS o_orderstatus, o_totalprice FROM orders")
def append(spark: SparkSession, sf: str) -> DataFrame:
    path, df = shared(spark, "lake"), t(spark, sf, "orders")
    for b, part in enumerate((df.filter("o_orderkey % 2 = 0").select("o_orderkey", "o_orderstatus", "o_totalprice"), df.filter("o_orderkey % 2 = 1").select("o_totalprice", "o_orderkey"))):
        for _ in range(2):  # a batch that comes again replaces itself
            R.append_batch(part, path, b)
    return R.read_lake(spark, path).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("io13_schema_catalog")
def schema_catalog(spark: SparkSession, sf: str) -> DataFrame:
    return R.schema_catalog(t(spark, sf, "orders"), "orders")


@query("io15_query_file", "SELECT count(*) AS n FROM part WHERE p_size > 25")
def query_file(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(f"SELECT count(*) AS n FROM parquet.`{sf}/part.parquet` WHERE p_size > 25")


# ------------------------------------------------------------ feedback
def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "events").select("event_id", F.col("event_type").alias("task"), (F.col("user_id") % 20).alias("agent"), (F.col("value") < 25).alias("failed"), (F.col("value") * 100).alias("ms"), "ts")


OUTCOMES = "(SELECT event_id, event_type AS task, user_id % 20 AS agent, value < 25 AS failed, value * 100 AS ms, ts FROM events)"


@query("fb1_failure_rates", f"SELECT agent, task, count(*) AS total, count(*) FILTER (failed) AS failures, round(avg(ms), 4) AS avg_ms FROM {OUTCOMES} WHERE ts > (SELECT max(ts) - INTERVAL 7 DAY FROM events) GROUP BY ALL HAVING count(*) >= 5 AND count(*) FILTER (failed) >= 0.3 * count(*)")
def failures(spark: SparkSession, sf: str) -> DataFrame:
    df = outcomes(spark, sf)
    recent = df.join(F.broadcast(df.agg((F.max("ts") - F.expr("INTERVAL 7 DAYS")).alias("_since")))).filter("ts > _since")
    return recent.groupBy("agent", "task").agg(F.count("*").alias("total"), F.count_if("failed").alias("failures"), F.round(F.avg("ms"), 4).alias("avg_ms")).filter("total >= 5 AND failures >= 0.3 * total")


@query("fb2_slow_patterns", f"SELECT agent, task, round(avg(ms), 4) AS avg_ms FROM {OUTCOMES} WHERE NOT failed GROUP BY ALL HAVING avg(ms) > 5000 AND count(*) >= 5 ORDER BY avg_ms DESC, agent, task LIMIT 5")
def slow(spark: SparkSession, sf: str) -> DataFrame:
    df = outcomes(spark, sf).filter("NOT failed").groupBy("agent", "task").agg(F.round(F.avg("ms"), 4).alias("avg_ms"), F.count("*").alias("n"))
    return df.filter("avg_ms > 5000 AND n >= 5").orderBy(F.desc("avg_ms"), "agent", "task").limit(5).drop("n")


@query("fb3_pattern_rank", f"SELECT task, count(*) FILTER (NOT failed) AS successes, round(count(*) FILTER (NOT failed) / count(*), 6) AS rate FROM {OUTCOMES} GROUP BY task HAVING count(*) FILTER (NOT failed) >= 0.6 * count(*)")
def ranked(spark: SparkSession, sf: str) -> DataFrame:
    df = outcomes(spark, sf).groupBy("task").agg(F.count_if(~F.col("failed")).alias("successes"), F.count("*").alias("n"))
    return df.withColumn("rate", F.round(F.col("successes") / F.col("n"), 6)).filter("successes >= 0.6 * n").orderBy(F.desc(F.col("rate") * F.col("successes"))).drop("n")


@query("fb4_pattern_upsert", f"SELECT task, count(*) AS n, round(avg(ms), 4) AS mean FROM {OUTCOMES} GROUP BY task")
def upsert(spark: SparkSession, sf: str) -> DataFrame:
    df = outcomes(spark, sf)
    state = df.filter("event_id % 2 = 0").groupBy("task").agg(F.count("*").alias("n0"), F.avg("ms").alias("m0"))
    batch = df.filter("event_id % 2 = 1").groupBy("task").agg(F.count("*").alias("n1"), F.avg("ms").alias("m1"))
    n0, n1 = F.coalesce("n0", F.lit(0)), F.coalesce("n1", F.lit(0))
    mean = (n0 * F.coalesce("m0", F.lit(0.0)) + n1 * F.coalesce("m1", F.lit(0.0))) / (n0 + n1)
    return state.join(batch, "task", "full").select("task", (n0 + n1).alias("n"), F.round(mean, 4).alias("mean"))


@query("fb5_lineage_counts", "SELECT l_partkey AS node, count(DISTINCT l_orderkey) AS referenced_by FROM lineitem GROUP BY 1")
def lineage(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("node")).agg(F.count_distinct("l_orderkey").alias("referenced_by"))


@query("fb6_feedback_summary", f"SELECT agent, count(*) AS total, round(avg(ms), 4) AS avg_ms FROM {OUTCOMES} GROUP BY agent")
def summary(spark: SparkSession, sf: str) -> DataFrame:
    return outcomes(spark, sf).groupBy("agent").agg(F.count("*").alias("total"), F.round(F.avg("ms"), 4).alias("avg_ms")).orderBy(F.desc("total"), "agent")


@query("fb7_query_batch")
def batch(spark: SparkSession, sf: str) -> DataFrame:
    return R.query_batch(spark, {"orders": t(spark, sf, "orders")}, {"all": "SELECT count(*) AS n FROM {orders}", "bad": "SELECT nothing FROM {orders}", "open": "SELECT count(*) AS n FROM {orders} WHERE o_orderstatus = 'O'"})


# ------------------------------------------------------------ vectors and distances
def _near(spark: SparkSession, sf: str, measure: str = "cosine", k: int = 5) -> DataFrame:
    """The k nearest of every fiftieth vector."""
    df = t(spark, sf, "embeddings").filter("embedding IS NOT NULL").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    return V.knn(df.filter("vec_id % 50 = 0"), df, k, measure)


@query("vs1_knn", "SELECT query_id, vec_id, s AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS s FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)) WHERE rank <= 5")
def knn(spark: SparkSession, sf: str) -> DataFrame:
    return _near(spark, sf)


def _nearest_sql(measure: str, value: str, order: str) -> str:
    return f"SELECT '{measure}' AS measure, query_id, vec_id, s AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}, vec_id) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id, round({value}, 9) AS s FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) a JOIN (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)) WHERE rank <= 5"


@query("vs1_knn_measures", _nearest_sql("l2", "list_sum(list_transform(list_zip(a.e, b.e), lambda p: (p[1] - p[2]) ** 2))", "s") + " UNION ALL " + _nearest_sql("inner_product", "list_inner_product(a.e, b.e)", "s DESC"))
def knn_measures(spark: SparkSession, sf: str) -> DataFrame:
    both = [_near(spark, sf, m).withColumn("measure", F.lit(m)) for m in ("l2", "inner_product")]
    return both[0].unionByName(both[1])


PLACES = "(SELECT c_custkey AS id, (c_custkey * 37 % 1800) / 10.0 - 90 AS lat, (c_custkey * 91 % 3600) / 10.0 - 180 AS lon FROM customer)"


@query("vs4_radius_join", f"SELECT a.id AS a, b.id AS b FROM {PLACES} a JOIN {PLACES} b ON a.id < b.id AND abs(a.lat - b.lat) <= 1.1 AND 2 * 6371 * asin(least(1, sqrt(sin(radians(b.lat - a.lat) / 2) ** 2 + cos(radians(a.lat)) * cos(radians(b.lat)) * sin(radians(b.lon - a.lon) / 2) ** 2))) <= 100")
def radius(spark: SparkSession, sf: str) -> DataFrame:
    places = t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") * 37 % 1800 / 10.0 - 90).alias("lat"), (F.col("c_custkey") * 91 % 3600 / 10.0 - 180).alias("lon"))
    return R.radius_pairs(places, 100.0)


# ------------------------------------------------------------ synthetic tables
@query("sy1_generate")
def synthetic(spark: SparkSession, sf: str) -> DataFrame:
    n = t(spark, sf, "orders").count()
    spec = {"order_id": {"kind": "sequence"}, "amount": {"kind": "lognormal", "mean": 3.0, "sd": 1.0}, "region": {"kind": "category", "values": {"a": 0.5, "b": 0.3, "c": 0.2}}, "status": {"kind": "category", "values": {"open": 1.0}, "null_rate": 0.05}, "noise": {"kind": "normal", "mean": 0.0, "sd": math.e}}
    return R.synthesize(spark, n, spec, seed=7)
