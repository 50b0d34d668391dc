"""Runs held against following every period from every word."""

import random

import numpy as np
import pytest

from lakeguard.llm import periods as P
from lakeguard.llm.kernels import mix


def stretches(w, length, exponent):
    best = {}
    for q in range(1, len(w) // exponent + 1):
        s = 0
        while s + q < len(w):
            e = s + q
            while e < len(w) and w[e] == w[e - q]:
                e += 1
            if e - s >= max(length, exponent * q):
                best.setdefault((s, e), q)
            s = e - q + 1
    return sorted([s, e, q] for (s, e), q in best.items())


def sample(rng):
    n = rng.randint(0, 70)
    w = [rng.randrange(rng.choice([1, 2, 5])) for _ in range(n)]
    if n and rng.random() < 0.5:
        a, p = rng.randrange(n), rng.randint(1, 9)
        w = [w[i] if i < a else w[min(n - 1, a + (i - a) % p)] for i in range(n)]
    return w


@pytest.mark.parametrize("step", [1, 2, 7, 64, 1000])
def test_chunks_of_any_length(step):
    rng = random.Random(step)
    for _ in range(60):
        w, length, exponent = sample(rng), rng.choice([2, 6]), rng.choice([2, 3, 4])
        hashes = mix(np.array(w, np.uint64) + np.uint64(11))
        catcher = P.SquareCatcher(len(w), length, exponent)
        for i in range(0, len(w), step):
            catcher.append(hashes[i : i + step])
            assert catcher.runs().tolist() == stretches(w[: i + step], length, exponent)


def test_query_against_brute_force(spark):
    rng = random.Random(1)
    texts = [" ".join(f"w{x}" for x in sample(rng)) for _ in range(150)]
    texts += ["", None, "la " * 5, "la " * 6, " \t\n", "a b " * 4, "a b " * 3 + "a", "é x " * 30, "a b a b c " * 9, "x" * 100_000, "la\x0bla\x0cla\rla\nla\tla la", "ba " + "la " * 3000]
    rows = list(enumerate(texts)) + [(None, "la " * 40), (None, None), (7, texts[7]), (7, texts[7])]
    docs = spark.createDataFrame([(d, t, "s", 1) for d, t in rows], "doc_id long, text string, runs string, n int")
    found = P.digests(P.collapse_runs(P.plant(docs))).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, P.brute_force(rows)))
    assert P.digests(P.collapse_runs(P.plant(docs.limit(0)))).collect() == []


def test_long_text(spark):
    rng = random.Random(2)
    w = [f"w{rng.randrange(40)}" for _ in range(30_000)]
    w[9_000:17_000] = w[9_000:10_000] * 8
    w[20_000:20_090] = ["x", "y", "z"] * 30
    for i in (8_999, 17_000, 19_999, 20_090):
        w[i] = f"edge{i}"
    row = P.collapse_runs(spark.createDataFrame([(1, " ".join(w))], "doc_id long, text string")).first()
    runs = [tuple(r) for r in row.runs]
    assert [r for r in runs if r[1] > 50] == [(9_000, 8_000, 1_000), (20_000, 90, 3)]
    assert row.n_words == 30_000 and len(row.collapsed.split()) == 30_000 - sum(size - q for _, size, q in runs)
