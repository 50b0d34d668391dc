"""Queries of the pipeline steps, each with the SQL that it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeguard.operators import steps as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def holes(df: DataFrame) -> DataFrame:
    """Orders with nulls that follow from the key."""
    return df.select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("price"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("priority"))


HOLES = "(SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS price, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS priority FROM orders)"


@query("pf1_filter", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders WHERE o_totalprice >= 100000 AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus NOT LIKE 'P%'")
def _(spark: SparkSession, sf: str) -> DataFrame:
    df = S.filter_step(t(spark, sf, "orders"), "o_totalprice", ">=", "100000")
    df = S.filter_step(S.filter_step(df, "o_orderpriority", "IN", ["1-URGENT", "2-HIGH"]), "o_orderstatus", "NOT LIKE", "P%")
    return df.select("o_orderkey", "o_orderpriority", "o_totalprice")


@query("pf2_filter_expr", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount > 0.05 AND l_quantity < 10")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "lineitem").where("l_discount > 0.05 AND l_quantity < 10").select("l_orderkey", "l_linenumber")


@query("pf3_drop_columns", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "customer").drop("c_acctbal", "c_nationkey")


@query("pf4_rename", "SELECT s_name AS supplier, s_suppkey AS id, s_nationkey, s_acctbal FROM supplier")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return S.rename_first(t(spark, sf, "supplier"), {"s_name": "supplier", "s_suppkey": "id"})


@query("pf5_add_column", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "lineitem").withColumn("net", F.expr("round(l_extendedprice * (1 - l_discount), 4)")).select("l_orderkey", "l_linenumber", "net")


@query("pf6_cast", "SELECT p_partkey, CAST(p_size AS VARCHAR) AS p_size_cast, try_cast(right(p_brand, 1) AS INTEGER) AS digit FROM part")
def _(spark: SparkSession, sf: str) -> DataFrame:
    df = S.cast_step(t(spark, sf, "part"), "p_size", "VARCHAR").withColumn("digit", F.expr("right(p_brand, 1)"))
    return S.cast_step(df, "digit", "INTEGER", in_place=True, strict=False).select("p_partkey", "p_size_cast", "digit")


@query("pf7_fill_missing", f"SELECT o_orderkey, round(coalesce(price, (SELECT median(price) FROM {HOLES})), 4) AS price_filled, coalesce(priority, 'none') AS priority_filled FROM {HOLES}")
def _(spark: SparkSession, sf: str) -> DataFrame:
    df = S.fill_missing(S.fill_missing(holes(t(spark, sf, "orders")), "price", "median"), "priority", "value", "none")
    return df.select("o_orderkey", F.round("price_filled", 4).alias("price_filled"), "priority_filled")


@query("pf8_fill_all", f"SELECT o_orderkey, round(coalesce(price, (SELECT avg(price) FROM {HOLES})), 3) AS price, coalesce(priority, 'none') AS priority FROM {HOLES}")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return S.fill_all(holes(t(spark, sf, "orders")), "mean", "none").withColumn("price", F.round("price", 3))


@query("pf9_custom_sql", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return S.custom_sql(t(spark, sf, "orders"), "SELECT o_orderstatus, count(*) AS n FROM {{prev}} GROUP BY o_orderstatus")


@query("pf10_step_chain", "SELECT o_orderpriority, round(sum(l_extendedprice * (1 - l_discount)), 3) AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity >= 10 GROUP BY o_orderpriority ORDER BY o_orderpriority")
def _(spark: SparkSession, sf: str) -> DataFrame:
    chain = [
        S.Step("filter", {"column": "l_quantity", "operator": ">=", "value": 10}),
        S.Step("join", {"right": t(spark, sf, "orders"), "left_key": "l_orderkey", "right_key": "o_orderkey"}),
        S.Step("add", {"name": "net", "expression": "l_extendedprice * (1 - l_discount)"}),
        S.Step("unheard_of"),
        S.Step("group", {"group_by": ["o_orderpriority"], "aggregations": [{"function": "SUM", "column": "net", "alias": "revenue"}, {"function": "COUNT", "column": "*", "alias": "n"}]}),
        S.Step("sort", {"column": "o_orderpriority"}),
    ]
    return S.run_chain(t(spark, sf, "lineitem"), chain).frame.withColumn("revenue", F.round("revenue", 3))


@query("pf11_sanitize_names", "SELECT c_custkey AS _1st_key, c_name AS the_name, c_mktsegment AS the_name_1 FROM customer")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return S.sanitize_names(t(spark, sf, "customer").select(F.col("c_custkey").alias("1st key"), F.col("c_name").alias("the name"), F.col("c_mktsegment").alias("the-name")))


@query("pf12_redact_pii", "SELECT c_custkey, '[REDACTED]' AS name, c_mktsegment, '[REDACTED]' AS inner_phone, c_nationkey AS inner_nation FROM customer")
def _(spark: SparkSession, sf: str) -> DataFrame:
    df = t(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("name"), "c_mktsegment", F.struct(F.col("c_name").alias("phone"), F.col("c_nationkey").alias("nation")).alias("inner"))
    return S.redact(df).select("c_custkey", "name", "c_mktsegment", F.col("inner.phone").alias("inner_phone"), F.col("inner.nation").alias("inner_nation"))


@query("pf13_tokenize_pii")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return S.tokenize_pii(t(spark, sf, "customer").select("c_custkey", "c_name"), "c_name", b"demonstration key", "crm")


@query("pf14_repair_rename", "SELECT s_acctbal, s_name, s_suppkey FROM supplier")
def _(spark: SparkSession, sf: str) -> DataFrame:
    drifted = t(spark, sf, "supplier").select(F.col("s_acctbal").alias("x_acct"), F.col("s_name").alias("x_name"), "s_suppkey")
    return S.repair_rename(drifted, ["s_acctbal", "s_name", "s_suppkey"])


@query("pf15_repair_missing", "SELECT s_suppkey, CAST(NULL AS DOUBLE) AS s_acctbal, CAST(NULL AS VARCHAR) AS s_name FROM supplier")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return S.repair_missing(t(spark, sf, "supplier").select("s_suppkey"), {"s_suppkey": "bigint", "s_acctbal": "double", "s_name": "string"})


@query("pf16_repair_extra", "SELECT s_suppkey, s_name FROM supplier")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return S.repair_extra(t(spark, sf, "supplier").withColumn("surprise", F.lit(1)), ["s_suppkey", "s_name"])


@query("pf17_repair_cast", "SELECT o_orderkey, try_cast(CASE WHEN o_orderkey % 3 = 0 THEN 'bad' ELSE CAST(o_custkey AS VARCHAR) END AS BIGINT) AS o_custkey FROM orders")
def _(spark: SparkSession, sf: str) -> DataFrame:
    bad = t(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "bad").otherwise(F.col("o_custkey").cast("string")).alias("o_custkey"))
    return S.repair_cast(bad, {"o_custkey": "bigint"})


@query("pf18_repair_rescale", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * 100 / 100.0, 4) AS l_extendedprice FROM lineitem")
def _(spark: SparkSession, sf: str) -> DataFrame:
    good = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    fixed = S.repair_rescale(good.withColumn("l_extendedprice", F.col("l_extendedprice") * 100), "l_extendedprice", good)
    return fixed.withColumn("l_extendedprice", F.round("l_extendedprice", 4))


@query(
    "pf19_repair_clip",
    "WITH s AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS d FROM lineitem) SELECT l_orderkey, l_linenumber, round(greatest(least(l_quantity * 3, m + 3 * d), m - 3 * d), 6) AS l_quantity FROM lineitem, s",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    base = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return S.repair_clip(base.withColumn("l_quantity", F.col("l_quantity") * 3), ["l_quantity"], base).withColumn("l_quantity", F.round("l_quantity", 6))


@query(
    "pf20_causal_encode",
    """SELECT CAST(l_discount > (SELECT median(l_discount) FROM lineitem) AS INTEGER) AS l_discount, l_extendedprice, l_quantity,
    CAST(l_returnflag = 'N' AS INTEGER) * 1.0::DOUBLE AS l_returnflag_N, CAST(l_returnflag = 'R' AS INTEGER) * 1.0::DOUBLE AS l_returnflag_R, CAST(l_linestatus = 'O' AS INTEGER) * 1.0::DOUBLE AS l_linestatus FROM lineitem""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return S.causal_encode(t(spark, sf, "lineitem"), "l_discount", "l_extendedprice", ["l_quantity", "l_returnflag", "l_linestatus"])


# ------------------------------------------------------------ joins
@query("jn1_equi_join", "SELECT o_orderkey, c_name, o_totalprice FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_mktsegment = 'BUILDING'")
def _(spark: SparkSession, sf: str) -> DataFrame:
    right = t(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'")
    return S.join_step(t(spark, sf, "orders"), right, "o_custkey", "c_custkey", "LEFT").select("o_orderkey", "c_name", "o_totalprice")


@query("jn2_cross_join", "SELECT r_name, n_name FROM region CROSS JOIN nation")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return S.join_step(t(spark, sf, "region"), t(spark, sf, "nation"), "", "", "CROSS").select("r_name", "n_name")


# ------------------------------------------------------------ aggregations
@query("ag1_group_agg", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_discount), 6) AS disc, min(l_tax) AS lo, max(l_tax) AS hi, median(l_quantity) AS med, round(stddev(l_quantity), 6) AS sd FROM lineitem GROUP BY ALL")
def _(spark: SparkSession, sf: str) -> DataFrame:
    wanted = [("COUNT", "*", "n"), ("SUM", "l_quantity", "qty"), ("AVG", "l_discount", "disc"), ("MIN", "l_tax", "lo"), ("MAX", "l_tax", "hi"), ("MEDIAN", "l_quantity", "med"), ("STDDEV", "l_quantity", "sd"), ("NOVEL", "l_tax", "x")]
    df = S.group_agg(t(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], [{"function": f, "column": c, "alias": a} for f, c, a in wanted])
    return df.withColumns({"qty": F.round("qty", 2), "disc": F.round("disc", 6), "sd": F.round("sd", 6)})


@query("ag2_pivot", "SELECT o_orderpriority, round(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 2) AS F, round(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 2) AS O FROM orders GROUP BY o_orderpriority")
def _(spark: SparkSession, sf: str) -> DataFrame:
    df = S.pivot_step(t(spark, sf, "orders").select("o_orderpriority", "o_orderstatus", "o_totalprice"), "o_orderstatus", ["F", "O"], "SUM", "o_totalprice")
    return df.withColumns({"F": F.round("F", 2), "O": F.round("O", 2)})


@query("ag3_unpivot", "SELECT l_orderkey, l_linenumber, variable, value FROM (SELECT l_orderkey, l_linenumber, l_discount, l_tax FROM lineitem) UNPIVOT (value FOR variable IN (l_discount, l_tax))")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return S.unpivot_step(t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax"), ["l_discount", "l_tax"])


@query("ag4_dedup_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").distinct()


@query("ag5_dedup_keys", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def _(spark: SparkSession, sf: str) -> DataFrame:
    df = S.dedup_keys(t(spark, sf, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")])
    return df.select("o_custkey", "o_orderkey", "o_totalprice")


# ------------------------------------------------------------ windows
@query("wf1_ranking", "SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr, ntile(4) OVER w AS tile FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    df = t(spark, sf, "orders")
    order = [F.col("o_totalprice"), F.col("o_orderkey")]
    for f, a in (("ROW_NUMBER", "rn"), ("RANK", "rk"), ("DENSE_RANK", "dr"), ("NTILE", "tile")):
        df = S.window_step(df, f, ["o_orderpriority"], order, a)
    return df.select("o_orderkey", *[F.col(c).cast("long").alias(c) for c in ("rn", "rk", "dr", "tile")])


@query("wf2_analytic", "SELECT o_orderkey, lag(o_totalprice) OVER w AS prev, lead(o_totalprice, 2, 0) OVER w AS nxt FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    order = [F.col("o_orderkey")]
    df = S.window_step(t(spark, sf, "orders"), "LAG", ["o_custkey"], order, "prev", "o_totalprice")
    return S.window_step(df, "LEAD", ["o_custkey"], order, "nxt", "o_totalprice", 2, 0.0).select("o_orderkey", "prev", "nxt")


@query("wf3_agg_window", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 2) AS running, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 4) AS near FROM orders")
def _(spark: SparkSession, sf: str) -> DataFrame:
    order = [F.col("o_orderkey")]
    df = S.window_step(t(spark, sf, "orders"), "SUM", ["o_custkey"], order, "running", "o_totalprice")
    df = S.window_step(df, "AVG", ["o_custkey"], order, "near", "o_totalprice", frame=("rows", -1, 1))
    return df.select("o_orderkey", F.round("running", 2).alias("running"), F.round("near", 4).alias("near"))


# ------------------------------------------------------------ sorting and sets
@query("so1_sort", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc_nulls_last(), "o_orderkey")


@query("so2_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@query("so3_topk", "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey ORDER BY n DESC, l_partkey LIMIT 10")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l_partkey").limit(10)


@query("st1_union", "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer UNION SELECT s_suppkey, s_name, NULL FROM supplier")
def _(spark: SparkSession, sf: str) -> DataFrame:
    left = t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return S.union_step(left, t(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), distinct=True)


@query("st2_intersect", "SELECT o_custkey AS key FROM orders INTERSECT SELECT c_custkey FROM customer")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "orders").select(F.col("o_custkey").alias("key")).intersect(t(spark, sf, "customer").select("c_custkey"))


@query(
    "st3_results_agree",
    """WITH a AS (SELECT o_orderstatus AS v FROM orders), b AS (SELECT o_orderstatus AS v FROM orders WHERE o_orderkey % 10 <> 0),
    ca AS (SELECT v, count(*) AS n FROM a GROUP BY v), cb AS (SELECT v, count(*) AS n FROM b GROUP BY v)
    SELECT 'text' AS tag, coalesce(ca.v, cb.v) AS value, coalesce(ca.n, 0) AS left_n, coalesce(cb.n, 0) AS right_n FROM ca FULL JOIN cb ON ca.v = cb.v WHERE coalesce(ca.n, 0) <> coalesce(cb.n, 0)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    df = t(spark, sf, "orders")
    return S.results_agree(df.select("o_orderstatus"), df.filter("o_orderkey % 10 <> 0").select(F.col("o_orderstatus").alias("other")))


# ------------------------------------------------------------ scalar functions
@query("sc1_null_case", f"SELECT o_orderkey, CASE WHEN price IS NULL THEN 'none' WHEN price > 150000 THEN 'high' ELSE 'low' END AS band, round(coalesce(price, 0), 1) AS price, greatest(o_orderkey, 100) AS k FROM {HOLES}")
def _(spark: SparkSession, sf: str) -> DataFrame:
    band = F.when(F.col("price").isNull(), "none").when(F.col("price") > 150000, "high").otherwise("low")
    return holes(t(spark, sf, "orders")).select("o_orderkey", band.alias("band"), F.round(F.coalesce("price", F.lit(0.0)), 1).alias("price"), F.greatest(F.col("o_orderkey"), F.lit(100)).alias("k"))


@query("sc2_string_clean", "SELECT c_custkey, trim('  ' || c_name || ' ') AS c_name FROM customer WHERE c_name LIKE '%1%'")
def _(spark: SparkSession, sf: str) -> DataFrame:
    padded = t(spark, sf, "customer").select("c_custkey", F.concat(F.lit("  "), "c_name", F.lit(" ")).alias("c_name"))
    return S.trim_strings(padded).filter(F.col("c_name").like("%1%"))


@query("sc3_safe_float", "SELECT event_id, CASE WHEN isfinite(v) THEN v END AS number FROM (SELECT event_id, try_cast(CASE event_id % 4 WHEN 0 THEN 'x' WHEN 1 THEN 'NaN' WHEN 2 THEN 'Infinity' ELSE CAST(event_id AS VARCHAR) END AS DOUBLE) AS v FROM events)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    raw = F.when(e % 4 == 0, "x").when(e % 4 == 1, "NaN").when(e % 4 == 2, "Infinity").otherwise(e.cast("string"))
    d = raw.try_cast("double")
    return t(spark, sf, "events").select("event_id", F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d).alias("number"))


@query(
    "sc4_date_patterns",
    r"""SELECT o_orderkey, CASE WHEN regexp_matches(s, '^\d{4}-\d{2}-\d{2}') THEN 'iso' WHEN regexp_matches(s, '^\d{1,2}/\d{1,2}/\d{4}') THEN 'slash' ELSE 'other' END AS kind
    FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%m/%d/%Y') ELSE 'soon' END AS s FROM orders)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey") % 3
    s = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.date_format("o_orderdate", "MM/dd/yyyy")).otherwise("soon")
    kind = F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}"), "iso").when(s.rlike(r"^\d{1,2}/\d{1,2}/\d{4}"), "slash").otherwise("other")
    return t(spark, sf, "orders").select("o_orderkey", kind.alias("kind"))


@query("sc5_first_digit", "SELECT o_orderkey, CAST(regexp_extract(CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR), '[1-9]') AS INTEGER) AS digit FROM orders")
def _(spark: SparkSession, sf: str) -> DataFrame:
    from lakeguard.functions.numbers import first_digit

    return t(spark, sf, "orders").select("o_orderkey", first_digit(F.col("o_totalprice")).alias("digit"))


@query("sc6_canonical_json", """SELECT s_suppkey, sha256('{"balance":"' || printf('%.6f', s_acctbal) || '","id":' || s_suppkey || ',"name":"' || s_name || '"}') AS digest FROM supplier""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    from lakeguard.functions.numbers import canonical_json

    df = t(spark, sf, "supplier")
    return df.select("s_suppkey", F.sha2(canonical_json({"name": (F.col("s_name"), "string"), "id": (F.col("s_suppkey"), "bigint"), "balance": (F.col("s_acctbal"), "double")}), 256).alias("digest"))


@query("sc7_round_dollar", "SELECT l_orderkey, l_linenumber, l_quantity * 100 > 0 AND (l_quantity * 100) % 1000 = 0 AS round_dollar FROM lineitem")
def _(spark: SparkSession, sf: str) -> DataFrame:
    a = F.col("l_quantity") * 100
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", ((a > 0) & (a % 1000 == 0)).alias("round_dollar"))


@query("sc8_cutoff_days", "SELECT o_orderkey, CAST(last_day(CAST(o_orderdate AS DATE)) - CAST(o_orderdate AS DATE) AS BIGINT) BETWEEN 0 AND 3 AS near_end FROM orders")
def _(spark: SparkSession, sf: str) -> DataFrame:
    left = F.datediff(F.last_day(F.to_date("o_orderdate")), F.to_date("o_orderdate"))
    return t(spark, sf, "orders").select("o_orderkey", left.between(0, 3).alias("near_end"))


@query("sc9_json_extract", "SELECT event_id, json_extract_string(props, '$.' || (SELECT json_keys(props)[1] FROM events ORDER BY event_id LIMIT 1)) AS field FROM events")
def _(spark: SparkSession, sf: str) -> DataFrame:
    df = t(spark, sf, "events")
    key = df.orderBy("event_id").limit(1).select(F.json_object_keys("props")[0]).first()[0]
    return df.select("event_id", F.get_json_object("props", f"$.{key}").alias("field"))
