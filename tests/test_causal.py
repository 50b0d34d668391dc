"""Effect estimates on made processes with known effects."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeguard.operators import causal as C


def made(spark, n=4000):
    """One confounder; the treatment adds 1.5."""
    normal = [F.randn(seed) for seed in (11, 12)]
    df = spark.range(0, n, 1, 2).select("id", normal[0].alias("x"), F.rand(13).alias("u"), normal[1].alias("noise"))
    t = (F.col("u") < 1 / (1 + F.exp(-0.6 * F.col("x")))).cast("int")
    return df.withColumn("t", t).withColumn("y", 1.5 * F.col("t") + F.col("x") + F.col("noise")).cache()


def test_targeted_and_doubly_robust(spark):
    df = made(spark)
    for found in (C.tmle(df, "t", "y", ["x"], ["id"]).first(), C.doubly_robust(df, "t", "y", ["x"], ["id"]).first()):
        assert abs(found.point - 1.5) < 0.2 and found.ci_lower < 1.5 < found.ci_upper and found.n == 4000


def test_matching_meets_brute_force(spark):
    rows = [(i, i % 3 == 0, float((i * 37) % 50) / 10 + (i % 7 == 0) * 20, float(i % 11)) for i in range(200)] + [(900, True, None, 1.0), (901, False, 1.0, None)]
    df = spark.createDataFrame(rows, "id int, t boolean, s double, y double").withColumn("t", F.col("t").cast("int"))
    known = [(int(t), s, y) for _, t, s, y in rows if s is not None and y is not None]

    def other(t, s):
        near = min(((abs(v - s), v) for a, v, _ in known if a != t))[1]
        ys = [y for a, v, y in known if a != t and v == near]
        return sum(ys) / len(ys)

    gaps = [(t, (y - other(t, s)) * (1 if t else -1)) for t, s, y in known]
    treated = [g for t, g in gaps if t]
    found = C.match_on_score(df, "t", "y", "s").first()
    assert abs(found.att - sum(treated) / len(treated)) < 1e-9
    assert abs(found.ate - sum(g for _, g in gaps) / len(gaps)) < 1e-9 and found.n == len(gaps)


def test_one_arm_has_no_match(spark):
    df = spark.createDataFrame([(1, 0.5, 1.0)], "t int, s double, y double")
    assert C.match_on_score(df, "t", "y", "s").first().att is None


def test_forest_finds_effects_that_differ(spark):
    df = made(spark).withColumn("y", F.col("y") + F.when(F.col("x") > 0, F.col("t")).otherwise(-F.col("t")))
    found = C.forest_effect(df, "t", "y", ["x"], ["id"], rounds=8, trees=8).first()
    assert abs(found.point - 1.5) < 0.25 and found.ci_lower < 1.5 < found.ci_upper and found.n == 4000
    assert list(found.cate) == sorted(found.cate) and len(found.cate) == 10
    assert found.cate[0] < 1.2 and found.cate[-1] > 1.8


def test_forest_without_both_arms(spark):
    df = spark.createDataFrame([(i, 1, float(i), 0.0) for i in range(9)] + [(99, 0, None, 0.0)], "id int, t int, y double, x double")
    found = C.forest_effect(df, "t", "y", ["x"], ["id"]).first()
    assert found.point is None and found.cate is None and found.n == 9


def dickey_fuller(y, lags):
    """The t statistics of all numbers of lags by plain least squares, with their AIC."""
    d = np.diff(y)
    out = []
    for p in range(lags + 1):
        x = np.array([[1.0, y[i], *[d[i - j] for j in range(1, p + 1)]] for i in range(lags, len(d))])
        z = d[lags:]
        beta = np.linalg.lstsq(x, z, rcond=None)[0]
        rest = ((z - x @ beta) ** 2).sum()
        error = np.sqrt(rest / (len(z) - p - 2) * np.linalg.inv(x.T @ x)[1, 1])
        out.append((len(z) * np.log(rest / len(z)) + 2 * (p + 2), beta[1] / error, p, len(z)))
    return min(out)


def test_unit_root_meets_least_squares(spark):
    rng = np.random.default_rng(3)
    noise = rng.normal(size=600)
    walk, calm = np.cumsum(noise) + 1000, [0.0, 0.0]
    for e in noise:
        calm.append(0.3 * calm[-1] + 0.4 * calm[-2] + e)
    for series, still in ((walk, False), (np.array(calm), True)):
        rows = [(i, float(v)) for i, v in enumerate(series)] + [(7000, None)]
        found = C.unit_root(spark.createDataFrame(rows, "i int, v double"), "v", [F.col("i")], lags=3, block=64).first()
        _, stat, p, n = dickey_fuller(series, 3)
        assert abs(found.t - stat) < 1e-6 and (found.lags, found.n) == (p, n) and found.stationary == still


def test_unit_root_of_short_and_constant_series(spark):
    for rows in ([(i, 1.0) for i in range(50)], [(i, float(i % 3)) for i in range(20)], []):
        found = C.unit_root(spark.createDataFrame(rows, "i int, v double"), "v", [F.col("i")]).first()
        assert found.t is None and found.stationary and found.n == len(rows)


def test_order_statistics_of_frequent_values(spark):
    """Half of the rows have one value; a weight stands for as many rows."""
    from lakeguard.functions.ranking import order_statistics

    values = [7.0] * 500 + [float(i) for i in range(400)] + [None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    n = F.col("n")
    picks = {"a": F.lit(0), "b": F.floor(n / 2), "c": n - 1, "d": F.floor(n * 0.25)}
    want = sorted(v for v in values if v is not None)
    assert order_statistics(df, "v", picks).first().asDict() == {"a": want[0], "b": want[450], "c": want[899], "d": want[225], "n": 900}
    assert order_statistics(df.groupBy("v").agg(F.count("*").alias("w")), "v", picks, "w").first().n == 900
    assert "_k" in str(order_statistics(df, "v", picks)._jdf.queryExecution().analyzed().toString())


def test_forest_works_on_cells_of_equal_rows(spark, monkeypatch):
    """Rows of few different confounders are summed up before anything is fitted; the interval is that of the single rows."""
    rows = []
    monkeypatch.setattr(C, "cut", lambda df, keep=C.cut: rows.append((out := keep(df)).count()) or out)
    df = made(spark).withColumn("x", F.round("x").cast("double"))
    many = df.unionByName(df.withColumn("id", F.col("id") + 100_000)).unionByName(df.withColumn("id", F.col("id") + 200_000))
    monkeypatch.setattr(C, "CELL_PARTS", 8)
    found = C.forest_effect(many, "t", "y", ["x"], ["id"], rounds=4, trees=8).first()
    assert found.n == 12_000 and max(rows) < 600
    assert found.ci_lower < found.point < found.ci_upper and abs(found.point - 1.5) < 0.4
    monkeypatch.setattr(C, "CELL_PARTS", 1_000_000)
    single = C.forest_effect(many, "t", "y", ["x"], ["id"], rounds=4, trees=8).first()
    assert single.ci_upper - single.ci_lower == pytest.approx(found.ci_upper - found.ci_lower, rel=1e-9)


def test_describe_sorts_for_the_median(spark):
    """No aggregate holds all values of a column."""
    from lakeguard.operators.profile import describe_numeric

    df = spark.createDataFrame([(float(v),) for v in (5, 1, 4, 2)], "v double")
    found = describe_numeric(df, "v")
    assert found.first()["median"] == 3.0 and "median(" not in found._jdf.queryExecution().analyzed().toString()


def test_classes_without_an_expansion_of_rows(spark):
    from lakeguard.operators.profile import classify_columns

    df = spark.createDataFrame([(i, f"n{i}", "2024-01-01", None) for i in range(60)], "a_id int, name string, day string, none string")
    found = classify_columns(df)
    assert {r.column: r.kind for r in found.collect()} == {"a_id": "id", "name": "text", "day": "date", "none": "date"}
    assert {r.column for r in classify_columns(df.filter("false")).collect()} == set(df.columns)
    assert "Expand" not in found._jdf.queryExecution().optimizedPlan().toString()


def by_rows(rows, folds):
    """TMLE and AIPW of (fold, t, y, x) by plain sums over single rows: (point, half width) each."""
    fold, t, y, x = (np.array(c, float) for c in zip(*rows, strict=True))
    z = np.column_stack([np.ones(len(x)), x])
    e, m0, m1 = (np.zeros(len(x)) for _ in range(3))
    for k in range(folds):
        train, test = fold != k, fold == k
        b = np.zeros(2)
        for _ in range(50):
            p = 1 / (1 + np.exp(-z[train] @ b))
            b += np.linalg.solve((z[train] * (p * (1 - p))[:, None]).T @ z[train], z[train].T @ (t[train] - p))
        e[test] = np.clip(1 / (1 + np.exp(-z[test] @ b)), 0.025, 0.975)
        for arm, m in ((0, m0), (1, m1)):
            own = train & (t == arm)
            m[test] = z[test] @ np.linalg.lstsq(z[own], y[own], rcond=None)[0]
    h, r = t / e - (1 - t) / (1 - e), y - np.where(t == 1, m1, m0)
    eps = (h * r).sum() / (h * h).sum()
    curves = {"tmle": m1 - m0 + eps / e + eps / (1 - e) + h * (r - eps * h), "aipw": m1 - m0 + h * r}
    return {k: (v.mean(), 1.96 * v.std(ddof=1) / np.sqrt(len(v))) for k, v in curves.items()}


def test_cross_fits_read_rows_once_and_meet_brute_force(spark):
    """Targeted and doubly robust estimates fit cells, with the numbers of single rows; a null takes no part."""
    df = made(spark, 2000).withColumn("x", F.round("x", 1).cast("double")).select("id", "t", "x", "y")
    odd = spark.createDataFrame([(10_001, 1, None, 1.0), (10_002, 0, 1.0, None), (10_003, 1, float("nan"), 2.0), (10_004, 0, 0.5, float("nan"))], "id long, t int, x double, y double")
    rows = df.select(F.pmod(F.xxhash64("id"), F.lit(3)), "t", "y", "x").collect()
    expected = by_rows(rows, 3)
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = df.unionByName(odd).mapInArrow(counted, "id long, t int, x double, y double")
    for method, f in (("tmle", C.tmle), ("aipw", C.doubly_robust)):
        seen.value = 0
        found = f(df, "t", "y", ["x"], ["id"], 3).first()
        assert seen.value == len(rows) + 4, method
        point, half = expected[method]
        assert found.method == method and found.n == 2000
        assert found.point == pytest.approx(point, abs=1e-5) and (found.ci_upper - found.ci_lower) / 2 == pytest.approx(half, rel=1e-4)


def test_cross_fits_without_confounders_or_with_unique_ones(spark):
    df = made(spark)
    plain = C.tmle(df, "t", "y", [], ["id"]).first()
    means = {r.t: r.m for r in df.groupBy("t").agg(F.avg("y").alias("m")).collect()}
    assert plain.n == 4000 and plain.point == pytest.approx(means[1] - means[0], abs=0.02)
    expected = by_rows(df.select(F.pmod(F.xxhash64("id"), F.lit(2)), "t", "y", "x").collect(), 2)
    single = C.tmle(df, "t", "y", ["x"], ["id"]).first()
    assert single.point == pytest.approx(expected["tmle"][0], abs=1e-5) and (single.ci_upper - single.ci_lower) / 2 == pytest.approx(expected["tmle"][1], rel=1e-4)
