"""Connectors: Arrow files of our own, and JDBC against the Derby that Spark brings along."""

import uuid

import pytest
from pyspark.sql import functions as F

from lakeguard.operators import healing as H
from lakeguard.sources import connectors
from lakeguard.sources import tables as T

ROWS = [(1, "a", 1.5, None), (2, None, None, [1, 2]), (2, None, None, [1, 2]), (None, "", float("inf"), [])]
SCHEMA = "k long, s string, d double, l array<int>"


def test_arrow_files_keep_rows_and_replace(spark, tmp_path):
    connectors.register(spark)
    df, path = spark.createDataFrame(ROWS, SCHEMA).repartition(3), str(tmp_path / "out")
    df.write.format("arrow_files").mode("append").save(path)
    df.write.format("arrow_files").mode("append").save(path)
    back = spark.read.format("arrow_files").load(path)
    assert back.schema == df.schema and sorted(map(repr, back.collect())) == sorted(map(repr, df.collect() * 2))
    df.filter("k = 1").write.format("arrow_files").mode("overwrite").save(path)
    assert [tuple(r) for r in spark.read.format("arrow_files").load(path).collect()] == [ROWS[0]]


def test_arrow_files_that_were_not_committed_are_not_read(spark, tmp_path):
    connectors.register(spark)
    df, path = spark.createDataFrame(ROWS, SCHEMA), tmp_path / "out"
    df.filter("false").write.format("arrow_files").mode("append").save(str(path))
    (path / "part-lost.arrow").write_bytes(b"half a file")
    back = spark.read.format("arrow_files").load(str(path))
    assert back.count() == 0 and back.schema == df.schema
    with pytest.raises(Exception, match="no committed Arrow files"):
        spark.read.format("arrow_files").load(str(tmp_path / "none")).collect()


def test_jdbc_round_trip_in_ranges(spark):
    url, known = f"jdbc:derby:memory:m{uuid.uuid4().hex};create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    df = spark.range(100).select(F.col("id").alias("K"), F.when(F.col("id") % 7 != 0, F.col("id").cast("string")).alias("S"))
    T.write_jdbc(df, url, "things", known, "fail")
    T.write_jdbc(df, url, "things", known, "append")
    back = T.read_jdbc(spark, url, "things", known, "K", 0, 100, 4)
    assert back.rdd.getNumPartitions() == 4
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(map(tuple, df.collect() * 2), key=repr)
    assert T.read_jdbc(spark, url, "(SELECT max(K) AS M FROM things) q", known).first().M == 99
    T.write_jdbc(df.limit(3), url, "things", known, "replace")
    assert T.read_jdbc(spark, url, "things", known).count() == 3
    with pytest.raises(Exception, match="(?i)exist"):
        T.write_jdbc(df, url, "things", known, "fail")


def test_injected_scores_pass_over_candidates_that_fail(spark):
    df = spark.createDataFrame([("a", 10.0), ("a", 30.0), ("b", 1.0), (None, 5.0)], "g string, v double")
    candidates = {"halve": lambda d: d.withColumn("v", F.col("v") / 2), "broken": lambda d: d.withColumn("v", F.col("nothing")), "same": lambda d: d}
    scored = H.score_candidates(df, candidates, ["g"], F.avg("v"))
    assert {(r.g, r.candidate): (r.before, r.after) for r in scored.collect()} == {("a", "halve"): (20, 10), ("a", "broken"): (20, None), ("a", "same"): (20, 20), ("b", "halve"): (1, 0.5), ("b", "broken"): (1, None), ("b", "same"): (1, 1)}
    assert {r.g: r.candidate for r in H.select_repair(scored, ["g"]).collect()} == {"a": "halve", "b": "halve"}
