"""Queries of streams that run, tables, browsing, summaries, indexed vectors and effect reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeguard.functions.storage import shared_path
from lakeguard.operators import causal as C
from lakeguard.operators import profile as R
from lakeguard.operators import vectors as V
from lakeguard.plans.causal import study
from lakeguard.plans.drift import registrar
from lakeguard.plans.operations import knn
from lakeguard.plans.steps import t
from lakeguard.sources import connectors
from lakeguard.sources import tables as T
from lakeguard.streaming import windows as S

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = registrar(QUERIES, SQL)


# ------------------------------------------------------------ streams
def _events(spark: SparkSession, sf: str, files: int = 4) -> tuple[str, str]:
    """A folder with the events dealt over some files, and their schema: what a producer would have left there."""
    path = shared_path(spark, "events-in")
    events = t(spark, sf, "events")
    events.repartition(files, "user_id").write.parquet(path)
    return path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema)


COUNTS = "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1"


def _counts(df: DataFrame) -> DataFrame:
    return df.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def _run(spark: SparkSession, path: str, schema: str, sinks: list, checkpoint: str) -> None:
    S.fan_out(S.file_stream(spark, path, schema, "parquet", time="ts"), sinks, checkpoint).awaitTermination()


@query("sm1_file_stream", COUNTS)
def file_stream(spark: SparkSession, sf: str) -> DataFrame:
    path, schema = _events(spark, sf)
    out = shared_path(spark, "events-out")
    _run(spark, path, schema, [S.file_sink(out, "parquet")], shared_path(spark, "events-offsets"))
    return _counts(spark.read.parquet(out))


@query("sm19_checkpoint_recover", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def recovered(spark: SparkSession, sf: str) -> DataFrame:
    """The stream stops after the first files; started again it reads the others once."""
    path, schema = _events(spark, sf)
    out, checkpoint, folder = (shared_path(spark, f"events-{x}") for x in ("out", "offsets", "part"))
    for part in ("user_id % 2 = 0", "user_id % 2 <> 0", None):
        if part:
            spark.read.schema(schema).parquet(path).filter(part).write.mode("append").parquet(folder)
        _run(spark, folder, schema, [S.file_sink(out, "parquet")], checkpoint)
    return _counts(spark.read.parquet(out))


@query("sm20_foreach_sinks", f"SELECT 'json' AS sink, * FROM ({COUNTS}) UNION ALL SELECT 'parquet', * FROM ({COUNTS})")
def sinks(spark: SparkSession, sf: str) -> DataFrame:
    path, schema = _events(spark, sf)
    out = {fmt: shared_path(spark, f"events-{fmt}") for fmt in ("json", "parquet")}
    _run(spark, path, schema, [S.file_sink(p, fmt) for fmt, p in out.items()], shared_path(spark, "events-offsets"))
    read = {"json": spark.read.schema("event_type string, value double").json(out["json"]), "parquet": spark.read.parquet(out["parquet"])}
    both = [_counts(df).select(F.lit(fmt).alias("sink"), "event_type", "n", "total") for fmt, df in read.items()]
    return both[0].unionByName(both[1])


@query("ud1_late_policy", "SELECT event_type, count(*) FILTER (day >= 20) AS on_time, count(*) FILTER (day < 20 AND value > 50) AS kept, count(*) FILTER (day < 20 AND NOT value > 50) AS dropped FROM (SELECT *, day(ts) AS day FROM events WHERE value IS NOT NULL) GROUP BY 1")
def policy(spark: SparkSession, sf: str) -> DataFrame:
    marked = S.with_policy(t(spark, sf, "events").filter("value IS NOT NULL"), F.dayofmonth("ts") < 20, F.col("value") > 50)
    return marked.groupBy("event_type").agg(*[F.count_if(F.col("decision") == d).alias(d) for d in ("on_time", "kept", "dropped")])


# ------------------------------------------------------------ tables
@query("io10_write_table", "SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey < 10")
def table_write(spark: SparkSession, sf: str) -> DataFrame:
    """A table replaced, then appended to, in the shared folder."""
    rows = t(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    path = shared_path(spark, "supplier-table")
    for part, mode in (("s_nationkey >= 0", "overwrite"), ("s_nationkey < 5", "overwrite"), ("s_nationkey BETWEEN 5 AND 9", "append")):
        rows.filter(part).write.mode(mode).parquet(path)
    return spark.read.parquet(path)


@query("io14_browse", "SELECT table_name AS \"table\", column_name AS \"column\", ordinal_position - 1 AS ordinal FROM information_schema.columns WHERE table_name IN ('region', 'nation', 'orders')")
def browse(spark: SparkSession, sf: str) -> DataFrame:
    return T.browse({name: t(spark, sf, name) for name in ("region", "nation", "orders")}).select("table", "column", "ordinal")


@query(
    "in2_stats_summary",
    """WITH v AS (SELECT unnest(['c_acctbal', 'c_nationkey']) AS metric, unnest([c_acctbal, CAST(c_nationkey AS DOUBLE)]) AS v FROM customer),
 q AS (SELECT metric, count(*) AS n, avg(v) AS mean, stddev_samp(v) AS sd, min(v) AS least, max(v) AS most, quantile_cont(v, 0.5) AS median FROM v GROUP BY 1)
 SELECT metric, n, round(mean, 4) AS mean, round(sd, 4) AS sd, least, most, round(median, 4) AS median FROM q""",
)
def summary(spark: SparkSession, sf: str) -> DataFrame:
    found = R.stats_summary(t(spark, sf, "customer"), ["c_acctbal", "c_nationkey"])
    return found.select("metric", "n", *[F.round(c, 4).alias(c) for c in ("mean", "sd")], "least", "most", F.round("median", 4).alias("median"))


# ------------------------------------------------------------ vectors
@query("vs2_knn_bucketed")
def bucketed(spark: SparkSession, sf: str) -> DataFrame:
    """The five nearest of every fiftieth vector among those that share a bucket with it, and the recall against all rows."""
    vectors = t(spark, sf, "embeddings").select("vec_id", "embedding")
    found = V.knn_bucketed(vectors.filter("vec_id % 50 = 0"), vectors, 5)
    exact = knn(spark, sf).select("query_id", "vec_id", F.lit(1).alias("true"))
    recall = exact.join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
    return found.join(F.broadcast(recall))


@query("vs3_vector_append", "SELECT id, label, size FROM (SELECT row_number() OVER (ORDER BY part, vec_id) - 1 AS id, label, len(embedding) AS size FROM (SELECT *, vec_id % 2 AS part FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = 64))")
def appended(spark: SparkSession, sf: str) -> DataFrame:
    vectors = t(spark, sf, "embeddings")
    store = V.append(None, vectors.filter("vec_id % 2 = 0"), ["vec_id"], 64)
    return V.append(store, vectors.filter("vec_id % 2 = 1"), ["vec_id"], 64).select("id", "label", F.size("embedding").alias("size"))


# ------------------------------------------------------------ effects
def _estimates(spark: SparkSession, sf: str) -> DataFrame:
    df = study(spark, sf)
    ids = ["l_orderkey", "l_linenumber"]
    return C.ols_effect(df, "t", "y", ["x"]).unionByName(C.tmle(df, "t", "y", ["x"], ids), True)


@query("ca13_disagreement")
def disagree(spark: SparkSession, sf: str) -> DataFrame:
    df, ids = study(spark, sf), ["l_orderkey", "l_linenumber"]
    both = C.tmle(df, "t", "y", ["x"], ids).unionByName(C.forest_effect(df, "t", "y", ["x"], ids), True)
    return C.disagreement(both, "tmle", "forest_dr")


@query("ca15_effect_report")
def report(spark: SparkSession, sf: str) -> DataFrame:
    return C.effect_report(study(spark, sf), "t", "y", ["x"], ["l_orderkey", "l_linenumber"])


# ------------------------------------------------------------ connectors
@query("ud4_connector", "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate FROM orders")
def connector(spark: SparkSession, sf: str) -> DataFrame:
    """The orders, written and read by a connector that is not Spark's."""
    connectors.register(spark)
    path = shared_path(spark, "arrow")
    t(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate").write.format("arrow_files").mode("append").save(path)
    return spark.read.format("arrow_files").load(path)
