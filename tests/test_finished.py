"""Weighted half widths, hidden causes, causal graphs, anomaly scores, proofs and nearest vectors, against plain Python."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeguard.functions.ranking import running_total
from lakeguard.operators import audit as A
from lakeguard.operators import causal as C
from lakeguard.operators import vectors as V


def test_running_totals_do_not_depend_on_partitions(spark):
    for parts in (1, 5):
        df = spark.range(500).select((F.col("id") * 7 % 500).alias("v")).repartition(parts)
        assert all(r.up == r.v * (r.v + 1) // 2 for r in running_total(df, [F.col("v")], "v", "up").collect())


@pytest.mark.parametrize("alpha", [0.05, 0.1, 0.4])
def test_weighted_half_width(spark, alpha):
    rng = random.Random(alpha)
    rows = [(float(rng.randint(0, 30)), rng.choice([0.0, 0.5, 1.0, 4.0])) for _ in range(120)]
    got = C.weighted_half_width(spark.createDataFrame([*rows, (None, 1.0), (2.0, None)], "s double, w double"), "s", "w", alpha).first()
    total, up, want = sum(w for _, w in rows), 0.0, math.inf
    for s, w in sorted(rows):
        up += w
        if up / (total + 1) >= 1 - alpha:
            want = s
            break
    assert (got.half_width, got.n) == (want, 120)
    # equal weights: the plain order statistic
    plain = spark.createDataFrame([(s, 1.0) for s, _ in rows], "s double, w double")
    assert C.weighted_half_width(plain, "s", "w", alpha).first().half_width == C.conformal_half_width(plain, "s", alpha).first().half_width


def test_weights_that_do_not_do(spark):
    few = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0)], "s double, w double")
    assert C.weighted_half_width(few, "s", "w", 0.1).first().half_width == math.inf
    assert C.weighted_half_width(few.filter("false"), "s", "w").collect() == []
    assert C.weighted_half_width(few.withColumn("w", F.lit(0.0)), "s", "w").collect() == []
    with pytest.raises(Exception, match="negative"):
        C.weighted_half_width(few.withColumn("w", -F.col("w")), "s", "w").collect()


def test_hidden_cause_of_known_strength(spark):
    """y = 2 t + 1.5 u + x, t = 0.8 u + x + noise: without u the estimate is too large, and taking its strengths off mends it."""
    rng = np.random.default_rng(4)
    n = 20_000
    u, x, e, d = (rng.normal(size=n) for _ in range(4))
    t = 0.8 * u + x + e
    y = 2 * t + 1.5 * u + x + d
    df = spark.createDataFrame([tuple(map(float, r)) for r in np.stack((t, y, x), 1)], "t double, y double, x double")

    def left(v):
        z = np.stack((np.ones(n), x), 1)
        return v - z @ np.linalg.lstsq(z, v, rcond=None)[0]

    f, g = 0.8 / left(t).std(), 1.5 / left(y).std()
    row = C.unobserved_cause(df, "t", "y", ["x"], [f], [g]).first()
    assert row.baseline > 2.5 and row.corrected == pytest.approx(2.0, abs=0.05)
    # a cause of that strength put into the data, by brute force
    v = rng.normal(size=n)
    z = np.stack((np.ones(n), t + 0.8 * v, x), 1)
    assert row.added == pytest.approx(np.linalg.lstsq(z, y + 1.5 * v, rcond=None)[0][1], abs=0.05)
    assert [r.passed for r in C.unobserved_cause(df, "t", "y", ["x"], [0.01, 2.0], [0.01]).collect()] == [True, False]


EDGES = [("z", "t"), ("z2", "t"), ("w", "t"), ("w", "m"), ("m", "y"), ("x", "t"), ("x", "y"), ("t", "y"), ("t", "s"), ("s", "t"), ("y", "t"), ("z", "t")]


def test_instruments_from_edges(spark):
    edges = spark.createDataFrame(EDGES, "src string, dst string")
    # z and z2 tie and come by name; w reaches the outcome by m; x is a confounder; s is a cycle with the treatment
    assert [tuple(r) for r in C.instruments(edges, "t", "y").collect()] == [("s", False), ("w", True), ("z", False), ("z2", False)]
    assert C.instruments(edges, "x", "y").collect() == []
    far = C.descendants(edges, spark.createDataFrame([("z",), ("m",)], "origin string"))
    assert sorted(map(tuple, far.collect())) == [("m", "s"), ("m", "t"), ("m", "y"), ("z", "s"), ("z", "t"), ("z", "y")]


def test_effect_by_the_graphs_instruments(spark):
    rng = np.random.default_rng(1)
    n = 8_000
    z, u, x = rng.integers(0, 2, n).astype(float), rng.normal(size=n), rng.normal(size=n)
    t = z + 0.7 * u + 0.5 * x + 0.3 * rng.normal(size=n)
    y = 2 * t + 1.5 * u + x + 0.3 * rng.normal(size=n)
    df = spark.createDataFrame([tuple(map(float, r)) for r in np.stack((t, y, z, x), 1)], "t double, y double, z double, x double")
    edges = spark.createDataFrame([("z", "t"), ("x", "t"), ("x", "y"), ("t", "y")], "src string, dst string")
    assert C.graph_effect(df, edges, "t", "y").first().point == pytest.approx(2.0, abs=0.15)
    with pytest.raises(ValueError, match="no instrument"):
        C.graph_effect(df, edges.filter("src <> 'z'"), "t", "y")


def test_what_moved_counts_more(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=2_000), rng.normal(size=2_000)
    rows = [tuple(map(float, r)) for r in np.stack((a + b + 0.5 * rng.normal(size=2_000), a, b, np.ones(2_000)), 1)]
    df = spark.createDataFrame(rows, "y double, a double, b double, c double")
    odd = spark.createDataFrame([(9.0, 0.0, 9.0, 5.0), (9.0, 0.0, 11.0, None)], "y double, a double, b double, c double")
    found = {r.candidate: r for r in C.root_causes(df, odd, "y", ["a", "b"]).collect()}
    assert found["b"].shift == pytest.approx((10 - b.mean()) / b.std(ddof=1)) and found["b"].score == pytest.approx(2 * found["b"].partial_r)
    assert found["a"].score < found["b"].score
    assert {r.candidate: r.shift for r in C.root_causes(df, odd.filter("false"), "y", ["a", "b"]).collect()} == {"a": 0.0, "b": 0.0}


@pytest.mark.parametrize("n", [1, 2, 5, 8, 13])
def test_proofs_are_verified(spark, n):
    leaves = cut_rows = spark.createDataFrame([("k", i, f"r{i}") for i in range(n)], "key string, leaf long, value string")
    root = A.merkle_root(cut_rows, "key", "leaf", "value")
    proofs = A.inclusion_proof(cut_rows, "key", "leaf", "value", leaves)
    assert all(r.valid for r in A.verify_proofs(proofs, leaves, root).collect())
    other = leaves.withColumn("value", F.when(F.col("leaf") == 0, "forged").otherwise(F.col("value")))
    assert {r.leaf: r.valid for r in A.verify_proofs(proofs, other, root).collect()} == {i: i > 0 for i in range(n)}
    wrong = root.withColumn("root", F.lit(hashlib.sha256(b"x").hexdigest()))
    assert not any(r.valid for r in A.verify_proofs(proofs, leaves, wrong).collect())
    assert not any(r.valid for r in A.verify_proofs(proofs, leaves, root.filter("false")).collect())


@pytest.mark.parametrize("measure", ["cosine", "l2", "inner_product"])
def test_nearest_by_each_measure(spark, measure):
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(120, 6)), 3)
    x[7], x[8], x[9] = x[3], x[3], 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, e array<double>")
    got = V.knn(df.filter("vec_id % 10 = 3 OR vec_id = 9"), df, 4, measure).collect()
    for i in [*range(3, 120, 10), 9]:
        norm = np.sqrt((x * x).sum(1))
        with np.errstate(all="ignore"):
            s = {"cosine": x @ x[i] / norm / norm[i], "inner_product": x @ x[i], "l2": ((x - x[i]) ** 2).sum(1)}[measure]
        order = sorted((round(float(v if measure == "l2" else -v), 9) + 0.0, j) for j, v in enumerate(s) if j != i and not math.isnan(v))
        want = [] if measure == "cosine" and i == 9 else [j for _, j in order[:4]]
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == i), key=lambda r: r.rank)] == want


@pytest.mark.parametrize("measure", ["cosine", "l2", "inner_product"])
def test_nearest_over_blocks_of_both_sides(spark, measure, monkeypatch):
    """Copies, ties, another size, null components, several blocks of queries and vectors: as brute force, ties by id."""
    from decimal import ROUND_HALF_UP, Decimal

    monkeypatch.setattr(V, "BLOCK_ROWS", 40)
    rng = np.random.default_rng(8)
    x = rng.integers(-3, 4, size=(300, 3)).astype(float) / 8
    x[100:160] = x[5]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, [1.0, None, 0.0]), (901, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, e array<double>")
    got = {}
    for r in V.knn(df.filter("vec_id % 3 = 0"), df, 5, measure).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.similarity)

    def value(a, b):
        dot = sum(p * q for p, q in zip(a, b, strict=True))
        s = {"cosine": lambda: dot / (math.sqrt(sum(p * p for p in a)) * math.sqrt(sum(q * q for q in b))), "inner_product": lambda: dot, "l2": lambda: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))}[measure]()
        return float(Decimal(repr(s)).quantize(Decimal("1e-9"), ROUND_HALF_UP))

    for i in range(0, 300, 3):
        if measure == "cosine" and not x[i].any():
            assert i not in got
            continue
        all_of = [(value(x[i].tolist(), x[j].tolist()), j) for j in range(300) if j != i and (measure != "cosine" or x[j].any())]
        want = sorted((s if measure == "l2" else -s, j) for s, j in all_of)[:5]
        assert [got[i][k][0] for k in range(1, 6)] == [j for _, j in want]
    assert 900 not in got and 901 not in got


def test_nearest_does_not_compare_pair_by_pair(spark):
    """Pairs meet as matrices in a task: no row of the plan is a pair before the k best are known."""
    df = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(50)], "vec_id long, e array<double>")
    plan = V.knn(df, df, 3)._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "zip_with" not in plan


def test_leaves_of_one_chain_are_dealt_over_all_tasks(spark):
    """A tenant's records leave the chain in one task; the levels above it and the proofs have them in all."""
    df = spark.range(20_000).select(F.lit("t").alias("tenant"), "id", F.col("id").cast("string").alias("payload"))
    chain = A.append(df, "tenant", ["id"], "payload").withColumn("i", F.col("seq") - 1)
    leaves = A.merkle_levels(chain, "tenant", "i", "record_hash")[0]
    sizes = [r["count"] for r in leaves.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 1 and max(sizes) < 15_000
