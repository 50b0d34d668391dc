"""Drift operators on small batches with known answers."""

import pytest

from lakeguard.operators import drift as D


def longs(spark, rows):
    return spark.createDataFrame(rows, "batch string, column string, v double")


@pytest.mark.parametrize(("mine", "base", "want"), [([8.0], [5.0], 3.0), ([0.0, 0.0, 0.0], [5.0, 5.0, 5.0], 5.0), ([0.0, 10.0], [0.0, 5.0, 10.0], 0.0), ([1.0, 2.0, 3.0, 4.0], [1.0], 1.5)])
def test_wasserstein(spark, mine, base, want):
    left = longs(spark, [("b", "x", v) for v in mine])
    right = longs(spark, [("", "x", v) for v in base]).drop("batch")
    assert [round(r.w1, 9) for r in D.wasserstein(left, right, ["batch"]).collect()] == [want]


def test_same_batch_has_no_drift(spark):
    rows = [(b, "x", float(i)) for b in ("a", "b") for i in range(50)]
    new, base = longs(spark, rows), longs(spark, rows).filter("batch = 'a'").drop("batch")
    kl = D.kl_divergence(D.histograms(new, ["batch"]), D.histograms(base), ["batch"])
    assert all(abs(r.kl) < 1e-9 for r in kl.collect())
    assert all(r["shift"] == 0 for r in D.location_shift(new, base, ["batch"]).collect())


def python_fold(batches, zeta0=0.15):
    """The fold of thresholds, batch by batch."""
    history, out = [], []
    for cols in batches:
        zeta = zeta0
        if len(history) >= 5:
            mean = sum(history) / len(history)
            zeta = max(mean + 2 * (sum((x - mean) ** 2 for x in history) / len(history)) ** 0.5, zeta0 * 0.5)
        lifted = {c: max(kl, s * zeta) if s > 2 else kl for c, (kl, s) in cols.items()}
        history = (history + [sum(round(k, 6) for k in lifted.values()) / len(lifted)])[-200:]
        over = {c for c, k in lifted.items() if k > zeta}
        out.append((round(zeta, 9), tuple(sorted(over)), bool(over) and (len(history) > 5 or max(s for _, s in cols.values()) > 2)))
    return out


def test_threshold_folds_lifted_divergences(spark):
    batches = [{"x": (0.01 * (i % 4), 3.0 if i in (2, 230) else 0.1), "y": (0.5 if i % 9 == 4 else 0.02, 0.0)} for i in range(240)]
    rows = [("s", f"{i:04d}", c, kl, s) for i, cols in enumerate(batches) for c, (kl, s) in cols.items()]
    df = spark.createDataFrame(rows, "source string, batch string, column string, kl double, shift double")
    got = [(round(r.zeta, 9), tuple(sorted(r.columns)), r.flagged) for r in D.statistical_drift(df, "source", "batch").orderBy("batch").collect()]
    assert got == python_fold(batches)


def test_alarm_after_a_move(spark):
    rows = [("s", i, 1.0 + (0.1 if i % 2 else -0.1)) for i in range(20)] + [("s", i, 5.0) for i in range(20, 60)]
    df = spark.createDataFrame(rows, "source string, n int, w1 double")
    got = {r.n: r.alarm for r in D.azuma_alarms(df, ["source"], "n", learn=20, persist=3).collect()}
    assert not any(got[i] for i in range(20)) and got[59]


def test_schema_kinds(spark):
    base = spark.createDataFrame([("a", "int"), ("b", "int"), ("c", "unknown")], "name string, type string")
    rows = [("same", "a", "int"), ("same", "b", "int"), ("same", "c", "x"), ("typed", "a", "string"), ("typed", "b", "int"), ("typed", "c", "x"), ("less", "a", "int"), ("more", "a", "int"), ("more", "b", "int"), ("more", "c", "x"), ("more", "d", "int")]
    df = spark.createDataFrame(rows, "batch string, name string, type string")
    got = {r.batch: (r.kind, r.severity) for r in D.schema_drift(df, base, ["batch"]).collect()}
    assert got == {"typed": ("type_change", "medium"), "less": ("schema_change", "critical"), "more": ("schema_change", "medium")}


def test_canaries_gain_from_routes_that_stay(spark):
    routes = spark.createDataFrame([("s", "old", 0.6, False, False), ("s", "older", 0.2, False, False), ("s", "gone", 0.1, False, True), ("s", "new", 0.1, True, False), ("t", "new", 0.9, True, False), ("t", "old", 0.1, False, False), ("u", "new", 0.5, True, False)], "source string, version string, weight double, canary boolean, drained boolean")
    scores = spark.createDataFrame([("s", "new", i, x) for i, x in enumerate([0.0, 0.7, 0.6, 0.8])] + [("t", "new", i, 1.0) for i in range(3)] + [("u", "new", 0, 1.0), ("s", "old", 0, 1.0)], "source string, version string, i int, score double")
    got = {(r.source, r.version): (round(r.weight, 9), r.promoted) for r in D.promote_canaries(routes, scores, "source", ["i"]).collect()}
    assert got == {("s", "old"): (0.45, None), ("s", "older"): (0.15, None), ("s", "gone"): (0.1, None), ("s", "new"): (0.3, True), ("t", "new"): (1.0, True), ("t", "old"): (0.0, None), ("u", "new"): (0.5, False)}
