"""Periodic runs of words by online dyadic square catching.

Words are appended to a stream, a document after another with a word of its own
between them.  Over every completed block of 2^k words, aligned to its length,
there is a catcher for the squares whose first half contains the block: halves of
2^(k+1) - 1 to 2^(k+2) - 2 words.  An appended word ends one stretch of 2^k words
for each k; the two or three catchers of that k whose distance to the stretch is
such a half compare it with their blocks by rolling hashes.  Where they agree, the
agreement is followed to both sides by comparing stretches of halving lengths, and
if it covers a whole half, a square is reported.  Squares of one period that
overlap by that much are one run, and a run of several periods has the smallest.
A run that reaches the end of what is there stays open and grows with the words
that are appended next.

A chunk of any length can be appended at once; chunks of one word give the same runs
as the whole text.  Tasks append all documents of an Arrow batch, nothing is
shuffled, and memory is bounded by a slice of text or one document, if that is
longer.  Runs are confirmed on a second, independent hash of their words.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeguard.llm.common import only, table
from lakeguard.llm.kernels import SPACE_WORDS, Words, mix, slices, strings

#: A run has at least so many words and so many periods.
LENGTH, EXPONENT = 6, 4
_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)


class SquareCatcher:
    """Runs of a growing sequence of words, given by their hashes."""

    def __init__(self, longest: int, length: int = LENGTH, exponent: int = EXPONENT) -> None:
        """longest: words of the longest document; no run is longer."""
        if exponent < 2:
            raise ValueError("a run has two periods at least")
        self.length, self.exponent, self.longest = length, exponent, longest
        #: hashes of the 2^k words from each place on
        self.levels: list[np.ndarray] = [np.zeros(0, _U)]
        #: start and period of what agrees up to the last word
        self.open = np.zeros((0, 2), np.int64)
        self.closed: list[np.ndarray] = []

    def __len__(self) -> int:
        return len(self.levels[0])

    def append(self, words: np.ndarray) -> None:
        """Advances all catchers by these words."""
        before = len(self)
        self._grow(words)
        b, q = self._caught(before)
        b, q = np.concatenate((self.open[:, 0], b)), np.concatenate((self.open[:, 1], q))
        start, end = b - self._reach(b, b + q, -1), b + q + self._reach(b, b + q, 1)
        going = end == len(self)
        self.open = np.unique(np.stack((start, q), 1)[going], axis=0)
        self.closed.append(self._long_enough(start[~going], end[~going], q[~going]))

    def runs(self) -> np.ndarray:
        """Rows (start, end, period) by start and end, those that reach the last word included."""
        start, q = self.open.T
        found = np.concatenate((*self.closed, self._long_enough(start, np.full(len(start), len(self)), q)))
        # a stretch with several periods is one run, of the smallest
        found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
        return found[np.flatnonzero((np.diff(found[:, :2], axis=0, prepend=-1) != 0).any(1))]

    def _long_enough(self, start: np.ndarray, end: np.ndarray, q: np.ndarray) -> np.ndarray:
        fine = end - start >= np.maximum(self.length, self.exponent * q)
        return np.unique(np.stack((start, end, q), 1)[fine], axis=0)

    def _grow(self, words: np.ndarray) -> None:
        self.levels[0] = np.concatenate((self.levels[0], words))
        k = 1
        while 1 << k <= min(len(self), self.longest):
            if len(self.levels) == k:
                self.levels.append(np.zeros(0, _U))
            last, half, have = self.levels[k - 1], 1 << k - 1, len(self.levels[k])
            more = mix(last[have : len(last) - half] * _ODD + (last[have + half :] ^ _U(half)))
            self.levels[k] = np.concatenate((self.levels[k], more))
            k += 1

    def _caught(self, before: int) -> tuple[np.ndarray, np.ndarray]:
        """Blocks and periods at which a stretch that ends in the new words equals a catcher's block."""
        found_b, found_q = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, hashes in enumerate(self.levels):
            block = 1 << k
            least, most = 2 * block - 1, min(4 * block - 2, self.longest // self.exponent)
            p = np.arange(max(0, before - block + 1), len(hashes))
            # the last catcher that is far enough to the left, and the one before it
            last = (p - least) & -block
            for b in (last, last - block):
                near = np.flatnonzero((b >= 0) & (p - b <= most))
                same = near[hashes[b[near]] == hashes[p[near]]]
                found_b.append(b[same])
                found_q.append(p[same] - b[same])
        return np.concatenate(found_b), np.concatenate(found_q)

    def _reach(self, a: np.ndarray, b: np.ndarray, way: int) -> np.ndarray:
        """Words that agree from a and b on to the right (way 1), or before them to the left (way -1); b > a."""
        total = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            hashes, size = self.levels[k], 1 << k
            x, y = (a + total, b + total) if way > 0 else (a - total - size, b - total - size)
            inside = np.flatnonzero((x >= 0) & (y < len(hashes)))
            total[inside[hashes[x[inside]] == hashes[y[inside]]]] += size
        return total


def _catch(words: Words, length: int, exponent: int) -> np.ndarray:
    """Runs of the documents' words, as rows (start, end, period) in the numbers of all words."""
    counts = np.diff(words.first)
    docs = len(counts)
    at = np.arange(len(words)) + words.document()
    catcher = SquareCatcher(int(counts.max(initial=0)), length, exponent)
    stream = np.empty(len(words) + docs, _U)
    stream[at] = words.hashes()
    # a word of its own ends each document, so no run goes across
    stream[words.first[1:] + np.arange(docs)] = mix(np.arange(docs).astype(_U) * _ODD + _U(3))
    catcher.append(stream)
    runs = catcher.runs()
    runs[:, :2] -= np.searchsorted(words.first[1:] + np.arange(docs), runs[:, 0])[:, None]
    second = words.hashes(1)
    fine = [bool((second[s : e - q] == second[s + q : e]).all()) for s, e, q in runs.tolist()]
    return runs[np.array(fine, bool)]


def collapse_runs(docs: DataFrame, length: int = LENGTH, exponent: int = EXPONENT) -> DataFrame:
    """Rows (doc_id, n_words, runs, collapsed) of ``docs(doc_id, text)``.

    Words are what ASCII white space separates.  runs is an array of (start,
    length, period), by start and period, of the stretches whose smallest period
    is q, of at least ``length`` words and ``exponent`` periods, that no
    neighbouring word extends; collapsed has the words, joined by one space,
    that are in no run after the run's first q words.  Null and empty texts have
    no words and no runs; repeated rows and null doc_ids are rows like any
    others; an empty table gives no rows; extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = strings(batch.column(1))
            for i, j in slices(offsets):
                part = raw[offsets[i] : offsets[j]]
                words = Words(part, offsets[i : j + 1], SPACE_WORDS)
                found = _catch(words, length, exponent)
                of = np.searchsorted(words.first, found[:, 0], "right") - 1
                data, ends = part.tobytes(), (offsets[i : j + 1] - offsets[i]).tolist()
                first = np.searchsorted(of, np.arange(j - i + 1)).tolist()
                lists, texts = [], []
                for k in range(j - i):
                    split = data[ends[k] : ends[k + 1]].split()
                    own = found[first[k] : first[k + 1]] - [words.first[k], words.first[k], 0]
                    gone = np.zeros(len(split), bool)
                    for s, e, q in own.tolist():
                        gone[s + q : e] = True
                    if len(own):
                        split = [w for w, g in zip(split, gone.tolist(), strict=True) if not g]
                    texts.append(b" ".join(split).decode())
                    lists.append([{"start": s, "length": e - s, "period": q} for s, e, q in sorted(own.tolist(), key=lambda r: (r[0], r[2]))])
                kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(words.first)), pa.array(lists, kind), pa.array(texts, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    rows = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def plant(docs: DataFrame) -> DataFrame:
    """(doc_id, text): about every tenth document made periodic from some word on, as its doc_id says; no doc_id, no change."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for i, doc in enumerate(batch.column(0).to_pylist()):
                if doc is not None and texts[i]:
                    texts[i] = planted(doc, texts[i].encode()).decode()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, text string")


def planted(doc: int, text: bytes) -> bytes:
    """The text with each word from word a on replaced by one of the first p of these, in turn, if the doc_id's checksum ends in 0."""
    h = zlib.crc32(str(doc).encode())
    if h % 10:
        return text
    words = text.split()
    n, g = len(words), h // 10
    if not n:
        return text
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return b" ".join([*words[:a], *(words[a + (i - a) % p] for i in range(a, n))])


def digests(found: DataFrame) -> DataFrame:
    """The query's columns of rows (doc_id, runs, collapsed)."""
    runs = F.col("runs")
    # length/period is compared as products, so it is exact
    best = F.aggregate(
        F.slice(runs, 2, F.greatest(F.size(runs) - 1, F.lit(0))),
        F.get(runs, F.lit(0)),
        lambda a, r: F.when(r["length"] * a["period"] > a["length"] * r["period"], r).when((r["length"] * a["period"] == a["length"] * r["period"]) & (r["start"] == a["start"]) & (r["period"] < a["period"]), r).otherwise(a),
    )
    lines = F.concat_ws("", F.transform(runs, lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))))
    out = found.withColumn("best", best)
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(collapse_runs(plant(table(spark, sf_dir, "documents"))))


def brute_force(rows: list[tuple], length: int = LENGTH, exponent: int = EXPONENT, plant: bool = True) -> list[tuple]:
    """The query's rows by following every period from every word; for tests."""
    out = []
    for doc, text in rows:
        raw = (text or "").encode()
        w = (planted(doc, raw) if plant and doc is not None else raw).split()
        n = len(w)
        best: dict[tuple[int, int], int] = {}
        for q in range(1, n // exponent + 1):
            s = 0
            while s + q < n:
                e = s + q
                while e < n and w[e] == w[e - q]:
                    e += 1
                if e - s >= max(length, exponent * q):
                    best.setdefault((s, e), q)
                s = e - q + 1
        runs = sorted((s, e - s, q) for (s, e), q in best.items())
        gone = {i for s, size, q in runs for i in range(s + q, s + size)}
        top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
        text = "".join(f"{s},{size},{q}\n" for s, size, q in sorted(runs, key=lambda r: (r[0], r[2])))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(runs), *top, 1000 * top[1] // top[2] if runs else None, hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()))
    return out


QUERIES = {"op12_periodic_runs": query}
ORACLES: dict[str, str] = {}
