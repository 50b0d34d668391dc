"""Every query of the library that has SQL, held against DuckDB on sf0.001."""

import math
import os

import duckdb
import pytest

from lakeguard import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    return v if isinstance(v, (int, bool, type(None))) else str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


#: Held on sf0.01 only: small tables give other classes or no trend.
LARGER = {"ag8_classify_columns", "jn7_relationship_detect", "wf8_chain_verify", "ag15_correlation_matrix", "ca7_iv_2sls", "pf18_repair_rescale"}


@pytest.mark.parametrize("name", sorted(set(catalog.oracle_sql()) - LARGER))
def test_matches_sql(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    found = con.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert table(df.columns, df.collect()) == table(columns, found.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_others_run(spark, name):
    df = catalog.queries()[name](spark, SF)
    assert all(len(r) == len(df.columns) for r in df.collect())


def test_hmac_tokens(spark):
    import hashlib
    import hmac

    from lakeguard.operators.steps import tokenize_pii

    df = spark.createDataFrame([("a@b.c",), (None,)], "email string")
    got = [r[0] for r in tokenize_pii(df, "email", b"k" * 80, "ctx").collect()]
    want = "PII-" + hmac.new(b"k" * 80, b"ctx|email|a@b.c", hashlib.sha256).hexdigest()[:12]
    assert got == [want, None]


def test_rank_does_not_depend_on_partitions(spark):
    from pyspark.sql import functions as F

    from lakeguard.functions.ranking import global_rank

    for parts in (1, 7):
        df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(parts)
        assert all(r.v == r.pos for r in global_rank(df, [F.col("v")]).collect())


def test_merkle_matches_recursive_split(spark):
    import hashlib

    from lakeguard.operators.audit import merkle_root

    def tree(leaves):
        if len(leaves) == 1:
            return hashlib.sha256(b"\0" + leaves[0]).digest()
        k = 1
        while k * 2 < len(leaves):
            k *= 2
        return hashlib.sha256(b"\1" + tree(leaves[:k]) + tree(leaves[k:])).digest()

    for n in (1, 2, 5, 9):
        values = [f"r{i}" for i in range(n)]
        df = spark.createDataFrame([("t", i, v) for i, v in enumerate(values)], "k string, i long, v string")
        assert merkle_root(df, "k", "i", "v").first().root == tree([v.encode() for v in values]).hex()


def test_stream_equals_batch(spark, tmp_path):
    from pyspark.sql import functions as F

    from lakeguard.streaming import windows as W

    source = str(tmp_path / "in")
    spark.read.parquet(f"{SF}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("key"), "value").write.parquet(source)
    batch = spark.read.parquet(source)
    stream = spark.readStream.schema(batch.schema).parquet(source)
    fired = W.tumbling(stream, "1 day", [("SUM", "value", "total")], "10 minutes")
    out = str(tmp_path / "out")
    W.fan_out(fired, [W.file_sink(out, "parquet")], str(tmp_path / "check")).awaitTermination()
    rows = {(r.key, r.window_start, r.event_count) for r in spark.read.parquet(out).collect()}
    want = {(r.key, r.window_start, r.event_count) for r in W.closed(batch, W.tumbling(batch, "1 day", [("SUM", "value", "total")]), "10 minutes").collect()}
    assert rows == want
