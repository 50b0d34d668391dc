"""Texts and words whose regular build defeats hashes that are sums of powers."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakeguard.llm import decontaminate, ngram_lm, substrings, tokens
from lakeguard.llm.kernels import SPACE_WORDS, Rolling, Words, strings


def thue_morse(n, a="a", b="b"):
    """n letters, and the same with both letters changed for each other."""
    bits = [i.bit_count() % 2 for i in range(n)]
    return "".join(b if x else a for x in bits), "".join(a if x else b for x in bits)


def key(r):
    return tuple((x is None, str(x)) for x in r)


@pytest.fixture(scope="module", params=[32, 64, 1024, 2048])
def pair(request):
    one, other = thue_morse(request.param)
    return f"x{one}x", f"x{other}x"


def filled(seed, n):
    return list(np.random.default_rng(seed).choice([f"w{i}" for i in range(200)], n))


def test_words_and_spans_differ(pair):
    raw, offsets = strings(pa.array([" ".join(pair), *thue_morse(64, "u ", "v "), *thue_morse(1024, "u ", "v ")]))
    words = Words(raw, offsets, SPACE_WORDS)
    for seed in (0, 77):
        h, r = words.hashes(seed), Rolling(words, seed)
        assert h[0] != h[1]
        spans = r.span(np.array([2, 66, 130, 1154]), np.array([66, 130, 1154, 2178]))
        assert len(set(spans.tolist())) == 4
    assert (words.hashes(0) != words.hashes(77)).all()


def test_spans_depend_on_words_alone():
    rng = np.random.default_rng(1)
    text = " ".join(rng.choice([f"w{i}" * (i % 40 + 1) for i in range(60)], 300))
    raw, offsets = strings(pa.array(["before it", f"some more {text}", text]))
    words = Words(raw, offsets, SPACE_WORDS)
    r = Rolling(words)
    for size in (1, 2, 3, 7, 8, 9, 35, 200):
        s = np.arange(300 - size + 1)
        assert (r.span(s + 4, s + 4 + size) == r.span(s + 304, s + 304 + size)).all()
    assert (r.grams(10)[4:290] == r.span(np.arange(4, 290), np.arange(14, 300))).all()


def test_tokens(pair):
    e = tokens._Encoder(tokens.vocabulary())
    flat, n = e.ids(*strings(pa.array(list(pair))))
    assert [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])] == [[*e.tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in pair]


def test_substrings(spark, pair):
    head, tail = filled(1, 20), filled(2, 20)
    rows = [(1, " ".join([*head, pair[0], *tail])), (2, " ".join([*head, pair[1], *tail]))]
    got = [tuple(r) for r in substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()]
    assert sorted(got, key=key) == sorted(substrings.brute_force(rows), key=key)


@pytest.mark.parametrize("cap", [0, 1 << 20])
def test_contamination(spark, pair, cap):
    head, tail = filled(1, 20), filled(2, 20)
    rows = [(1, " ".join([*head, pair[0], *tail])), (2, " ".join([*head, pair[1], *tail])), (3, None)]
    items = [(7, " ".join([*head, pair[1], *tail])), (None, " ".join(head)), (None, " ".join(tail)), (8, pair[0])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contamination(spark.createDataFrame(rows, "doc_id long, text string"), bench, broadcast_bytes=cap)
    got = [(r.doc_id, r.n_words, r.n_hit, len(r["items"])) for r in found.collect()]
    assert sorted(got, key=key) == sorted((w[:4] for w in decontaminate.brute_force(rows, items)), key=key)


def test_backoff(spark, pair):
    rows = [(1, " ".join([*filled(1, 20), pair[0], "end"])), (2, " ".join([*filled(1, 20), pair[1], "end"])), (3, pair[0])]
    got = sorted(ngram_lm.stupid_backoff(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    for g, w in zip(got, ngram_lm.brute_force(rows), strict=True):
        assert (g.doc_id, g.n_words, g.n_known) == (w[0], w[1], w[4])
        assert g.log_score == pytest.approx(w[2], abs=1e-4)


def test_backoff_counts_beyond_32_bits():
    hashes, counts = np.array([3, 9], np.uint64), np.array([1 << 40, 5])
    blob = ngram_lm.pack(hashes, counts)
    assert ngram_lm.unpack_hashes(blob[0]).tolist() == [3, 9] and ngram_lm.unpack_counts(blob[1]).tolist() == [1 << 40, 5]


def test_suffix_tree_against_every_pair():
    rng = np.random.default_rng(8)
    runs = [b" ".join(rng.choice([b"a", b"b", b"c\xc3\xa9"], rng.integers(4, 30))) for _ in range(25)]
    starts = np.array([int(rng.integers(1, len(r.split()) + 1)) for r in runs])
    tree = substrings.SuffixTree(runs, starts)
    split = [r.split() for r in runs]

    def common(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    suffixes = [split[r][p:] for r, p in zip(tree.run.tolist(), tree.place.tolist(), strict=True)]
    want = [max(common(x, y) for j, y in enumerate(suffixes) if i != j) for i, x in enumerate(suffixes)]
    assert tree.depths().tolist() == want
    node = tree.nodes(3)
    for i, x in enumerate(suffixes):
        for j, y in enumerate(suffixes):
            if i != j:
                assert (node[i] == node[j]) == (common(x, y) >= 3)


def test_near_copies_of_one_passage(spark):
    """Many different runs around one gram, dealt whole and spread."""
    rng = np.random.default_rng(3)
    passage = filled(4, 60)
    rows = []
    for i in range(120):
        w = list(passage)
        for k in rng.integers(0, 60, 2):
            w[k] = f"v{rng.integers(0, 3)}"
        rows.append((i, " ".join([*filled(100 + i, 10), *w, *filled(300 + i, 10)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for group_runs in (4000, 7):
        got = [tuple(r) for r in substrings.dedup_substrings(docs, group_runs=group_runs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()]
        assert sorted(got, key=key) == sorted(substrings.brute_force(rows), key=key)
