"""Suffix-array dedup held against a table of all windows, and its merge against sorting."""

import os
import random
import time

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from lakeguard.llm import suffixes as S

SCHEMA = "doc_id long, text string, kept string, removed int"


def lcp(a, b):
    return len(os.path.commonprefix([a, b]))


@pytest.mark.parametrize("seed", range(6))
def test_loser_tree(seed):
    rng = random.Random(seed)
    for _ in range(60):
        runs = [sorted(bytes(rng.choices(b"ab\0", k=rng.randint(1, 9))) for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(1, 9))]
        shared = [[lcp(b"" if not i else r[i - 1], x) for i, x in enumerate(r)] for r in runs]
        order, prefix = S.merged(runs, shared)
        take = [iter(r) for r in runs]
        got = [next(take[k]) for k in order]
        assert got == sorted(x for r in runs for x in r)
        assert prefix == [0] + [lcp(a, b) for a, b in zip(got[:-1], got[1:], strict=True)]


def corpus(rng, docs, window):
    """Made texts with copies, near copies, shared passages, repeats inside, and edges one byte short of a window."""
    def words(n):
        return " ".join("".join(rng.choices("abé", k=rng.randint(1, 6))) for _ in range(n))

    passages = [words(25) for _ in range(4)]
    texts = []
    for _ in range(docs):
        kind = rng.random()
        if texts and kind < 0.2:
            texts.append(rng.choice(texts))
        elif texts and kind < 0.45:
            t = rng.choice(texts)
            i = rng.randrange(len(t) + 1)
            texts.append(t[:i] + rng.choice("xyz") + t[i + rng.randint(0, 3) :])
        elif kind < 0.7:
            p = rng.choice(passages)
            texts.append(words(rng.randint(0, 30)) + p[: rng.choice([window - 1, window, window + 1, len(p)])] + words(rng.randint(0, 30)))
        elif kind < 0.8:
            texts.append("ab" * rng.randint(0, 90))
        else:
            texts.append(words(rng.randint(0, 40)))
    return texts


@pytest.mark.parametrize("options", [{}, {"block_bytes": 700, "range_anchors": 50, "range_suffixes": 40}, {"block_bytes": 2000, "hot": 3}, {"window": 23, "block_bytes": 900}, {"hot": 1}])
def test_against_brute_force(spark, options):
    window = options.get("window", S.WINDOW)
    rng = random.Random(repr(options))
    texts = corpus(rng, 160, window) + ["", None, "x" * 49, "x" * 50, "y" * 400, "\0" * 120, "\0" * 90]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = list(zip(ids, texts, strict=True)) + [(None, texts[3]), (None, texts[4]), (ids[5], texts[9]), (ids[5], texts[5]), (-4, texts[7]), (None, None)]
    docs = spark.createDataFrame([(d, t, "k", 1) for d, t in rows], SCHEMA).repartition(5)
    found = S.dedup_bytes(docs, **options).selectExpr("doc_id", "n_bytes", "aggregate(removed, 0L, (n, s) -> n + s[1] - s[0])", "size(removed)", "sha2(kept, 256)").collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, S.brute_force(rows, window)))


def test_spans_are_what_is_cut(spark):
    shared = "the quick brown fox jumps over the lazy dog and then it sleeps all day"
    row = next(r for r in S.dedup_bytes(spark.createDataFrame([(2, f"é {shared} after"), (1, f"before {shared}!")], "doc_id long, text string")).collect() if r.doc_id == 2)
    text = f"é {shared} after".encode()
    (a, b), = row.removed
    assert text[a:b].decode() == f" {shared}" and bytes(row.kept) == text[:a] + text[b:]


def test_empty_and_wrong(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert S.dedup_bytes(docs).collect() == []
    with pytest.raises(ValueError):
        S.dedup_bytes(docs, window=200)


class Task:
    """Takes a step's function over batches or groups, to call it in this process."""

    def mapInArrow(self, run, schema):
        return run

    applyInArrow = mapInArrow

    def __getattr__(self, name):
        return lambda *columns: self


def block(texts):
    raw = [t.encode() for t in texts]
    return {"blk": 0, "ids": list(range(len(raw))), "sizes": list(map(len, raw)), "packed": zstandard.ZstdCompressor().compress(b"".join(raw))}


REPLIES = pa.list_(pa.struct([("hot", pa.bool_()), ("keys", pa.binary()), ("what", pa.binary())]))


def told(samples, code):
    """The first exchange's reply that has this code of all samples, which are distinct."""
    return {"range": 0, "codes": S._pack(np.full(len(samples.c), code, np.uint8))}


def cut(texts, first, replies):
    """The step's rows and its CPU seconds."""
    row = {k: v for k, v in block(texts).items() if k != "blk"} | {"told": [first], "replies": replies}
    batch = pa.table({k: pa.array([v], REPLIES if k == "replies" else None) for k, v in row.items()}).to_batches()[0]
    began = time.process_time()
    found = [x for out in S._cut(Task(), S.WINDOW, 1)(iter([batch])) for x in out.to_pylist()]
    return found, time.process_time() - began


def random_texts(seed, docs, n):
    rng = random.Random(seed)
    return ["".join(rng.choices("abcdefgh ", k=n)) for _ in range(docs)]


def test_a_block_is_cut_once_for_all_replies():
    texts = random_texts(1, 300, 4000)
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    samples = S.Samples(raw, np.arange(0, len(raw) + 1, 4000), S.WINDOW)
    keys, bits = samples.c[::20].copy(), (np.uint64(1) << (samples.at - samples.lo).astype(np.uint64)).view(np.int64)[::20].copy()
    one, quick = cut(texts, told(samples, 1), [{"hot": False, "keys": S._pack(keys), "what": S._pack(bits)}])
    many, slow = cut(texts, told(samples, 1), [{"hot": False, "keys": S._pack(keys[i : i + 1]), "what": S._pack(bits[i : i + 1])} for i in range(len(keys))])
    assert one == many and len(keys) > 3000 and sum(len(r["removed"]) for r in one) > 300
    assert slow < 4 * quick + 1  # a pass over the block for each reply takes many times that


def test_windows_of_frequent_anchors_only_are_looked_at(monkeypatch):
    texts = random_texts(2, 20, 4000)
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    samples = S.Samples(raw, np.arange(0, len(raw) + 1, 4000), S.WINDOW)
    _, _, keys = samples.singles(np.array([7]))
    code = np.zeros(len(samples.c), np.uint8)
    order, begins, *_ = samples.distinct(samples.doc)
    code[np.flatnonzero(order[begins] == 7)] = 2
    seen, whole = [], S.Samples.singles
    monkeypatch.setattr(S.Samples, "singles", lambda self, which: seen.append(len(which)) or whole(self, which))
    found, _ = cut(texts, {"range": 0, "codes": S._pack(code)}, [{"hot": True, "keys": S._pack(keys), "what": S._pack(np.full(len(keys), -1))}])
    assert sum(seen) == 1
    assert [(r["doc_id"], r["removed"]) for r in found if r["removed"]] == [(0, [[int(samples.lo[7]), int(samples.hi[7]) + S.WINDOW]])]


def step(run, rows, by):
    """What a step makes of each group."""
    groups = {}
    for r in rows.to_pylist():
        groups.setdefault(r[by], []).append(r)
    return pa.concat_tables([run(pa.Table.from_pylist(g, rows.schema)) for g in groups.values()])


def test_only_one_of_equal_samples_goes_on_and_merged_are_those_that_may_share_a_window(monkeypatch):
    common, blocks = random_texts(3, 40, 400), []
    for blk in range(12):
        own = random_texts(100 + blk, 20, 400)
        blocks.append({**block(common + own + [own[0][:200] + "x" + common[0][150:]]), "blk": blk})
        blocks[-1]["ids"] = [100 * blk + k for k in blocks[-1]["ids"]]
    schema = pa.schema([("blk", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("packed", pa.binary())])
    sent = pa.Table.from_batches(S._sent_anchors(Task(), S.WINDOW, 3)(iter(pa.Table.from_pylist(blocks, schema).to_batches())))
    codes = step(S._recurring(Task(), 1000), sent, "range").to_pylist()
    for b in blocks:
        b["told"] = [{"range": c["range"], "codes": c["codes"]} for c in codes if c["blk"] == b["blk"]]
    schema = schema.append(pa.field("told", pa.list_(pa.struct([("range", pa.int32()), ("codes", pa.binary())]))))
    rows = pa.Table.from_batches(S._sorted_runs(Task(), S.WINDOW, 3, 1)(iter(pa.Table.from_pylist(blocks, schema).to_batches())))
    seen, whole = [], S.merged
    monkeypatch.setattr(S, "merged", lambda heads, shared: seen.append(sum(map(len, heads))) or whole(heads, shared))
    found = S._covered(Task(), S.WINDOW)((pa.scalar(0), pa.scalar(False)), rows)
    # all blocks have 40 equal texts of some 20 samples, which the first loses to none; the joint of each last text has unequal neighbours
    going = sum(len(zstandard.decompress(x)) // 11 for x in rows["numbers"].to_pylist())
    assert going == sum(c["n"] for c in codes) < 60 * 12 and 12 <= sum(seen) <= going
    assert set(found["blk"].to_pylist()) == set(range(12))
