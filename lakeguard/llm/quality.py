"""Quality classifier: a generalised additive model with pairwise interactions.

Each text is measured by a few shape features.  Features are cut into bins, and
cyclic boosting fits one shallow tree after another, feature by feature and then
for the strongest pairs, each to what the others leave unexplained.  Trees on
one feature add up to a lookup table by bin, those on two features to a table by
two bins, so a score is a sum of table entries, taken for whole batches at once,
and every entry can be read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeguard.llm.common import materialise, only, table
from lakeguard.llm.kernels import SPACE_WORDS, Words, slices, strings

#: Labelled rows that the model is fitted on, at most: those with the least hash of their doc_id.
TRAIN_ROWS = 50_000
BINS = 32
PAIRS = 6
ROUNDS = 150
RATE = 0.1
#: Score from which a document is kept.
THRESHOLD = 0.7

FEATURES = ("log_words", "word_bytes", "long_words", "upper", "digits", "symbols", "stops", "lines", "bytes_line", "distinct_words", "repeated_next", "distinct_pairs", "symbol_words", "bare_symbol_words", "beyond_ascii", "bang_words")

_UPPER, _DIGIT, _SYMBOL, _STOP, _LINE, _BEYOND = range(6)
_CLASSES = np.zeros((6, 256), bool)
_CLASSES[_UPPER, 0x41:0x5B] = True
_CLASSES[_DIGIT, 0x30:0x3A] = True
_CLASSES[_SYMBOL, [c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) not in ".,;:'\"-()?"]] = True
_CLASSES[_STOP, [ord(c) for c in ".,;:?"]] = True
_CLASSES[_LINE, 0x0A] = True
_CLASSES[_BEYOND, 0x80:] = True


def features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text; an empty one is all zeros."""
    words = Words(raw, offsets, SPACE_WORDS)
    n_docs = len(offsets) - 1
    n_bytes, n_words = np.diff(offsets).astype(float), np.diff(words.first).astype(float)
    doc, starts, ends = words.document(), words.starts, words.ends
    one = np.maximum(n_words, 1)

    def per_byte(kind: int) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(_CLASSES[kind][raw], dtype=np.int64)))
        return (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(n_bytes, 1)

    def per_word(mask: np.ndarray) -> np.ndarray:
        return np.bincount(doc[mask], minlength=n_docs) / one

    def distinct(values: np.ndarray, of: np.ndarray, count: np.ndarray) -> np.ndarray:
        order = np.lexsort((values, of))
        v, o = values[order], of[order]
        new = np.concatenate(([True], (v[1:] != v[:-1]) | (o[1:] != o[:-1]))) if len(v) else np.zeros(0, bool)
        return np.bincount(o[new], minlength=n_docs) / np.maximum(count, 1)

    h, length = words.hashes(), ends - starts
    symbols = np.concatenate(([0], np.cumsum(_CLASSES[_SYMBOL][raw], dtype=np.int64)))
    in_word = symbols[ends] - symbols[starts]
    inside = doc[1:] == doc[:-1] if len(doc) else np.zeros(0, bool)
    pair = (h[1:] ^ (h[:-1] * np.uint64(0x9E3779B97F4A7C15)))[inside]
    lines = per_byte(_LINE) * n_bytes
    bang = raw[ends - 1] == 0x21 if len(ends) else np.zeros(0, bool)
    again = np.zeros(len(h), bool)
    again[1:] = inside & (h[1:] == h[:-1]) if len(h) else again[1:]
    return np.column_stack(
        [
            np.log1p(n_words),
            np.bincount(doc, length, minlength=n_docs) / one,
            per_word(length > 12),
            per_byte(_UPPER),
            per_byte(_DIGIT),
            per_byte(_SYMBOL),
            per_byte(_STOP),
            lines / one,
            n_bytes / (lines + 1) / 100,
            distinct(h, doc, n_words),
            per_word(again),
            distinct(pair, doc[1:][inside] if len(doc) else doc, np.maximum(n_words - 1, 1)),
            per_word(in_word > 0),
            per_word(in_word == length),
            per_byte(_BEYOND),
            per_word(bang),
        ]
    )


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Model:
    """Cuts of each feature, its table by bin, and the tables of pairs."""

    intercept: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: dict[tuple[int, int], np.ndarray]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, x[:, f], "right") for f, c in enumerate(self.cuts)]) if len(x) else np.zeros((0, len(self.cuts)), np.int64)

    def scores(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        z = np.full(len(x), self.intercept)
        for f, t in enumerate(self.tables):
            z += t[b[:, f]]
        for (f, g), t in self.pairs.items():
            z += t[b[:, f], b[:, g]]
        return _sigmoid(z)


def _tree(gradient: np.ndarray, weight: np.ndarray, leaves: int = 3) -> np.ndarray:
    """Values by bin of the regression tree with so many leaves on one ordered feature."""
    g, w = np.concatenate(([0], np.cumsum(gradient))), np.concatenate(([0], np.cumsum(weight)))
    edges = [0, len(gradient)]
    soft = 1.0

    def worth(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (g[b] - g[a]) ** 2 / (w[b] - w[a] + soft)

    for _ in range(leaves - 1):
        best = (1e-12, -1)
        for a, b in itertools.pairwise(edges):
            mid = np.arange(a + 1, b)
            if len(mid):
                gain = worth(np.full_like(mid, a), mid) + worth(mid, np.full_like(mid, b)) - worth(np.array([a]), np.array([b]))
                k = int(gain.argmax())
                best = max(best, (float(gain[k]), int(mid[k])))
        if best[1] < 0:
            break
        edges = sorted([*edges, best[1]])
    out = np.empty(len(gradient))
    for a, b in itertools.pairwise(edges):
        out[a:b] = (g[b] - g[a]) / (w[b] - w[a] + soft)
    return out


def _pair_tree(gradient: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, values) of the best four quadrants of two features' bins."""
    g = np.zeros((gradient.shape[0] + 1, gradient.shape[1] + 1))
    w = g.copy()
    g[1:, 1:], w[1:, 1:] = gradient.cumsum(0).cumsum(1), weight.cumsum(0).cumsum(1)

    def part(x: np.ndarray) -> tuple[np.ndarray, ...]:
        a, r, c, t = x[1:-1, 1:-1], x[1:-1, -1:], x[-1:, 1:-1], x[-1, -1]
        return a, r - a, c - a, t - r - c + a

    gs, ws = part(g), part(w)
    if not gs[0].size:
        return 0.0, np.zeros_like(gradient)
    gain = sum(x * x / (y + 1.0) for x, y in zip(gs, ws, strict=True))
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    q = [float(x[i, j] / (y[i, j] + 1.0)) for x, y in zip(gs, ws, strict=True)]
    out = np.empty_like(gradient)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = q
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray, bins: int = BINS, pairs: int = PAIRS, rounds: int = ROUNDS, rate: float = RATE) -> Model:
    """The model of labels y (0 or 1); without rows of both labels it knows their share alone."""
    share = (float(y.sum()) + 0.5) / (len(y) + 1)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for f in range(x.shape[1])]
    # a bin of its own for values above a cut that many rows share
    model = Model(float(np.log(share / (1 - share))), cuts, [np.zeros(len(c) + 1) for c in cuts], {})
    if not len(y) or y.min() == y.max():
        return model
    b = model.bins(x)
    z = np.full(len(y), model.intercept)
    for _ in range(rounds):
        for f, t in enumerate(model.tables):
            p = _sigmoid(z)
            n = len(t)
            step = rate * _tree(np.bincount(b[:, f], y - p, n), np.bincount(b[:, f], p * (1 - p), n))
            t += step
            z += step[b[:, f]]

    def grids(f: int, g: int) -> tuple[np.ndarray, np.ndarray]:
        p = _sigmoid(z)
        shape = (len(model.tables[f]), len(model.tables[g]))
        at = b[:, f] * shape[1] + b[:, g]
        size = shape[0] * shape[1]
        return np.bincount(at, y - p, size).reshape(shape), np.bincount(at, p * (1 - p), size).reshape(shape)

    gains = sorted(((_pair_tree(*grids(f, g))[0], f, g) for f, g in itertools.combinations(range(x.shape[1]), 2)), reverse=True)
    for _, f, g in gains[:pairs]:
        model.pairs[f, g] = np.zeros((len(model.tables[f]), len(model.tables[g])))
    for _ in range(rounds // 3):
        for (f, g), t in model.pairs.items():
            step = rate * _pair_tree(*grids(f, g))[1]
            t += step
            z += step[b[:, f], b[:, g]]
    return model


def _measured(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the features of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = strings(batch.column(1))
            parts = [features(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in slices(offsets)]
            x = np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), listed], ["doc_id", "x"])

    return only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, x array<double>")


def held_out(doc_id: Column) -> Column:
    """The rows that no label is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """The model of ``labels(doc_id, quality)``, fitted on at most train_rows labelled rows.

    The bound is the number of labelled ids that come to the driver as feature
    vectors; which ones is decided by a hash of doc_id.  Null ids and labels teach
    nothing; an id with two labels has the greater; of several rows of one id the
    one of least features counts; texts are read whole, whatever their length;
    extra columns are ignored; an empty table gives a model of equal scores.
    """
    known = only(labels, "doc_id", "quality").filter("quality IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out(F.col("doc_id")))
    chosen = known.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    chosen = F.broadcast(materialise(chosen))  # at most train_rows pairs of numbers, so the texts stay where they are
    picked = only(docs, "doc_id", "text").join(chosen, "doc_id")
    labelled = _measured(picked.select("doc_id", "text")).join(chosen, "doc_id").select("doc_id", "x", "quality")
    # of several rows of one id the one of least features, so at most train_rows come back and always the same
    one = labelled.groupBy("doc_id").agg(F.min("x").alias("x"), F.max("quality").alias("quality"))
    rows = sorted((r[0], tuple(r[1]), r[2]) for r in one.collect())
    x = np.array([r[1] for r in rows]).reshape(-1, len(FEATURES))
    return fit(x, np.array([r[2] for r in rows], float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row of ``docs(doc_id, text)``.

    Null and empty texts score as a text of no words; whole texts of any length
    are read; repeated rows score alike; an empty table gives no rows; extra
    columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # tables of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = strings(batch.column(1))
            out = [sent.value.scores(features(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])) for i, j in slices(offsets)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out) if out else np.zeros(0))], ["doc_id", "score"])

    return only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, score double")


def filter_quality(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score at least the threshold, all columns kept."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = strings(batch.column(at))
            out = [sent.value.scores(features(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])) >= threshold for i, j in slices(offsets)]
            if out:
                yield batch.filter(pa.array(np.concatenate(out)))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every row; null and empty texts score as a text of no words, repeated rows alike."""
    docs = table(spark, sf_dir, "documents")
    found = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op9_quality_gam": query}
ORACLES: dict[str, str] = {}
