"""Whitening held against whole numbers and fractions of Python."""

import math

import numpy as np
import pytest

from lakeguard.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, component string, key int"


def rows_of(spark, rows, schema=SCHEMA, **options):
    return W.whiten(spark.createDataFrame(rows, schema), **options).collect()


def check(found, rows, components=32):
    """Everything the contract says, from the definition."""
    want = W.brute_force([(k, v) for k, v, *_ in rows], components)
    n, d = want["n"], len(want["centred"][0][1])
    k = min(components, d)
    assert len(found) == n * k
    assert {r.n for r in found} == {n}
    assert sorted(r.deviation for r in found if r.component == 1) == sorted(s for _, s in want["deviation"])
    e = want["explained"] * np.trace(want["cov"])
    assert np.allclose([next(r.explained for r in found if r.component == c + 1) for c in range(k)], want["explained"], rtol=1e-4, atol=1e-12)
    assert all(r.identity_error <= 1e-4 for r in found)
    return want, e


def test_every_value(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(90, 5)) * [8, 3, 1, 0.2, 0.05] + 40
    rows = [(i, [float(np.float32(x)) for x in base[i % 60]], "x", 1) for i in range(90)]
    found = rows_of(spark, rows)
    want, e = check(found, rows)
    y = np.zeros((90, 5))
    for r in found:
        y[r.vec_id, r.component - 1] = r.whitened
    x = np.array([v for _, v in want["centred"]])
    axes = x.T @ y / 90 / np.sqrt(e)
    assert np.allclose(want["cov"] @ axes, axes * e, atol=1e-9 * e[0])
    assert np.allclose(x @ axes / np.sqrt(e), y)
    assert np.abs(y.T @ y / 90 - np.eye(5)).max() < 1e-9


def test_rows_that_take_no_part(spark):
    good = [(1, [0.0, 1.0], "a", 1), (2, [1.0, 0.5], "b", 2), (2, [1.0, 0.5], "b", 2), (None, [3.0, 3.0], None, None)]
    bad = [(5, None, "c", 1), (6, [1.0, None], "c", 1), (7, [math.nan, 1.0], "c", 1), (8, [math.inf, 1.0], "c", 1), (9, [], "c", 1)]
    found = rows_of(spark, good + bad)
    check(found, good)
    assert sorted((r.vec_id or 0, r.component) for r in found) == [(0, 1), (0, 2), (1, 1), (1, 2), (2, 1), (2, 1), (2, 2), (2, 2)]


def test_constant_empty_and_other_lengths(spark):
    assert rows_of(spark, []) == []
    found = rows_of(spark, [(i, [2.0, 2.0], "a", 1) for i in range(7)] + [(9, [1.0, 2.0, 3.0], "a", 1)])
    assert sorted({(r.vec_id, r.n) for r in found}) == [(i, 7) for i in range(7)] + [(9, 1)]
    assert {(r.deviation, r.whitened, r.explained, r.identity_error) for r in found} == {(0, None, 0.0, 0.0)}


def test_weights_of_one(spark):
    rows = [(i, [float(i % 3), float(i % 2)], "a", 1) for i in range(60)] + [(60 + i, [0.0, 0.0], "a", 1) for i in range(500)]
    assert {r.n for r in rows_of(spark, rows)} == {560}
    found = rows_of(spark, rows, weigh="one")
    assert {r.n for r in found} == {6} and len(found) == 2 * 560
    check([r for r in found if r.vec_id < 6], rows[:6])
    with pytest.raises(ValueError):
        rows_of(spark, rows, weigh="two")


def test_large_entries_and_sums(spark):
    assert W.exact_sums(np.array([[2**61, -5], [2**61, 1]]), np.array([3, 2])) == [5 * 2**61, -13]
    x = np.array([[2**40, 0], [0, 7]])
    assert W.deviations(x, 2, [2**40, 7]) == [None, None]
    assert W.deviations(np.array([[5, 1], [2, 8]]), 2, [7, 9]) == [9 + 49, 9 + 49]
    rows = [(1, [1e300, 1.0]), (2, [2.0**40, 1.0]), (3, [2.0**40 + 1, 5.0]), (4, [2.0**40, 9.0])]
    found = rows_of(spark, rows, "vec_id long, embedding array<double>")
    assert {r.vec_id for r in found} == {2, 3, 4}
    check(found, rows[1:])
