"""Embedding whitening by weighted multiplicity covariance.

A vector's entries become integers, floor(64 c) + 1,000,000, so equal vectors are
found exactly: identical ones are grouped into one distinct vector with its
multiplicity.  The fit weighs a distinct vector by its multiplicity (every row
counts) or by one.  Per-dimension sums are exact; each task centres its distinct
vectors and multiplies them with their weights in one matrix product, and the
products of the tasks are summed by Spark.  The entries are centred on the whole
number nearest to the mean before they are multiplied, so products of integers are
summed without rounding below 2^53, in any order, and what is left of the mean, at
most a half, is taken off afterwards.  Every distinct vector is whitened once; rows
of vectors that occur once have their result there, and only the others are joined
back: the few most frequent vectors by a bounded broadcast, the rest by a shuffle.

Nothing but one row for each pair of dimensions reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeguard.llm.common import keep, only, table

#: Entries become floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64.0, 1_000_000
#: Components that are returned, at most.
COMPONENTS = 32
#: A distinct vector that has more than one row in so many is joined back by broadcast; there are fewer of them than this.
HOT = 200
#: An eigenvalue below this share of the largest, by dimension, is zero but for rounding.
_ZERO = 1e-14
_WIDTHS = (np.int8, np.int16, np.int32, np.int64)
_TOP = 2**63 - 1


@dataclass
class Fit:
    """What a length's vectors were fitted to: rows, sums by dimension, axes as columns with their eigenvalues."""

    n: int
    sums: list[int]
    values: np.ndarray
    axes: np.ndarray
    total: float

    def base(self) -> tuple[np.ndarray, np.ndarray]:
        """The whole numbers nearest to the means, and what is left of these."""
        whole = [(2 * s + self.n) // (2 * self.n) for s in self.sums]
        return np.array(whole, np.int64), np.array([(s - self.n * m) / self.n for s, m in zip(self.sums, whole, strict=True)])

    def scales(self) -> np.ndarray:
        """1 / sqrt(e) of each component, NaN for those without variance."""
        fine = self.values > _ZERO * len(self.sums) * max(self.values.max(initial=0.0), 0.0)
        return np.where(fine, 1 / np.sqrt(np.where(fine, self.values, 1.0)), np.nan)


def _pack(x: np.ndarray) -> list[bytes]:
    """Each vector of integers as bytes: the width of its entries and the entries less the offset; equal vectors have equal bytes."""
    low = x - OFFSET
    reach = np.maximum(low.max(1), -(low.min(1) + 1)) if x.shape[1] else np.zeros(len(x), np.int64)
    width = np.searchsorted([1 << 7, 1 << 15, 1 << 31], reach, "right")
    out: list[bytes] = [b""] * len(x)
    for k, kind in enumerate(_WIDTHS):
        for i in np.flatnonzero(width == k).tolist():
            out[i] = bytes([k]) + low[i].astype(kind).tobytes()
    return out


def _unpack(keys: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indexes, vectors as rows of long) of the packed vectors, by their lengths."""
    sizes: dict[tuple[int, int], list[int]] = {}
    for i, k in enumerate(keys):
        sizes.setdefault((k[0], len(k)), []).append(i)
    for (kind, _), at in sizes.items():
        flat = np.frombuffer(b"".join(keys[i][1:] for i in at), _WIDTHS[kind])
        yield np.array(at), flat.reshape(len(at), -1).astype(np.int64) + OFFSET


def _keyed(vectors: DataFrame) -> DataFrame:
    """(vec_id, key): rows whose vector takes part, with the vector's integers packed."""
    e = F.col("embedding")
    # beyond 2^62 there is no long for an entry
    fine = F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * SCALE) < float(2**62)))
    rows = only(vectors, "vec_id", "embedding").select(F.col("vec_id").cast("long").alias("vec_id"), e.cast("array<double>").alias("embedding")).filter(e.isNotNull() & fine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            size = np.diff(np.asarray(lists.offsets))
            keys: list[bytes] = [b""] * batch.num_rows
            for d in np.unique(size).tolist():
                at = np.flatnonzero(size == d)
                c = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), d)
                for i, k in zip(at.tolist(), _pack(np.floor(SCALE * c).astype(np.int64) + OFFSET), strict=True):
                    keys[i] = k
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary())], ["vec_id", "key"])

    return rows.mapInArrow(run, "vec_id long, key binary")


def exact_sums(x: np.ndarray, w: np.ndarray) -> list[int]:
    """Weighted sums of the columns, as whole numbers of any size."""
    if not len(x) or float(np.abs(x).max(initial=0)) * float(w.sum()) < 2.0**62:
        return (w @ x).tolist()
    return (w.astype(object) @ x.astype(object)).tolist()


def _means(nodes: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Rows and exact sums by vector length; one row for each dimension comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = batch.column(1).to_numpy()
            for at, x in _unpack(batch.column(0).to_pylist()):
                d = x.shape[1]
                sums = [*exact_sums(x, w[at]), int(w[at].sum())]
                yield pa.RecordBatch.from_arrays([pa.array([d] * (d + 1), pa.int32()), pa.array(range(d + 1), pa.int32()), pa.array([str(s) for s in sums])], ["d", "i", "s"])

    rows = nodes.select("key", "f").mapInArrow(run, "d int, i int, s string").groupBy("d", "i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    out: dict[int, tuple[int, list[int]]] = {}
    for d in {r.d for r in rows}:
        own = {r.i: int(r.s) for r in rows if r.d == d}
        out[d] = own[d], [own[i] for i in range(d)]
    return out


def _products(nodes: DataFrame, project, sent) -> dict[int, np.ndarray]:
    """Weighted sums of products by vector length: of each distinct vector, as ``project`` centres it, with a 1 appended."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            w = batch.column(1).to_numpy().astype(np.float64)
            for d, at, y in project(batch, sent.value):
                y = np.concatenate((y, np.ones((len(y), 1))), 1)
                total[d] = total.get(d, 0) + y.T @ (y * w[at, None])
        for d, m in total.items():
            i, j = np.triu_indices(len(m))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), d), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(m[i, j])], ["d", "i", "j", "v"])

    rows = nodes.mapInArrow(run, "d int, i int, j int, v double").groupBy("d", "i", "j").agg(F.sum("v").alias("v")).toArrow()  # one for each pair of dimensions
    d, i, j, v = (rows[c].to_numpy() for c in ("d", "i", "j", "v"))
    out: dict[int, np.ndarray] = {}
    for length in np.unique(d).tolist():
        own = d == length
        m = np.zeros((int(i[own].max()) + 1,) * 2)
        m[i[own], j[own]] = m[j[own], i[own]] = v[own]
        out[length] = m
    return out


def _centred(batch: pa.RecordBatch, bases: dict) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for at, x in _unpack(batch.column(0).to_pylist()):
        if x.shape[1]:
            yield x.shape[1], at, (x - bases[x.shape[1]]).astype(np.float64)


def fit(nodes: DataFrame) -> dict[int, Fit]:
    """Fits of the distinct vectors ``nodes(key, f)``, f being their weights, by length; empty vectors have none."""
    means = {d: m for d, m in _means(nodes).items() if d}
    if not means:
        return {}
    empty = np.zeros(0)
    fits = {d: Fit(n, sums, empty, empty, 0.0) for d, (n, sums) in means.items()}
    sent = nodes.sparkSession.sparkContext.broadcast({d: f.base()[0] for d, f in fits.items()})  # a number for each dimension
    for d, m in _products(nodes.select("key", "f"), _centred, sent).items():
        f = fits[d]
        rest = f.base()[1]
        v = m[:-1, :-1] / f.n - np.outer(rest, rest)
        values, axes = np.linalg.eigh(v)
        values, axes = np.maximum(values[::-1], 0.0), axes[:, ::-1]
        # one sign wherever it runs: the largest entry is positive
        axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(d)] < 0, -1.0, 1.0)
        f.values, f.axes, f.total = values, axes, float(np.trace(v))
    return fits


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over the dimensions of (n x - S)^2 of each row, exact; null where it leaves a long."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n for s in sums], np.int64)
    a = x - whole
    if n * float(np.abs(a).max(initial=0)) + n < 2.0**31.5 / max(1.0, len(sums) ** 0.5):
        t = a * n - rest
        return (t * t).sum(1).tolist()
    t = a.astype(object) * n - rest.astype(object)
    return [int(s) if s <= _TOP else None for s in (t * t).sum(1)]


_WHITE = "key binary, d int, w long, f long, vec_id long, deviation long, whitened array<double>"


def _whitened(nodes: DataFrame, sent, components: int) -> DataFrame:
    """Every distinct vector with its deviation and its whitened components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _unpack(batch.column(0).to_pylist()):
                d = x.shape[1]
                if not d:
                    continue
                f = sent.value[d]
                base, rest = f.base()
                k = min(components, d)
                y = ((x - base) - rest) @ f.axes[:, :k] * f.scales()[:k]
                flat = pa.array(y.ravel(), pa.float64(), from_pandas=True)  # NaN, where there is no variance, is null
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * k), flat)
                rows = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.full(len(at), d), pa.int32()), rows.column(1), rows.column(2), rows.column(3), pa.array(deviations(x, f.n, f.sums), pa.int64()), lists], ["key", "d", "w", "f", "vec_id", "deviation", "whitened"])

    return nodes.select("key", "w", "f", "vec_id").mapInArrow(run, _WHITE)


def _parts(batch: pa.RecordBatch, _) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Whitened vectors, without the components that have no variance."""
    size, lists = batch.column(0).to_numpy(), batch.column(2)
    for d in np.unique(size).tolist():
        at = np.flatnonzero(size == d)
        y = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1)
        yield d, at, np.nan_to_num(y)


def identity_errors(white: DataFrame, fits: dict[int, Fit], components: int) -> dict[int, float]:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, by length."""
    sent = white.sparkSession.sparkContext.broadcast({})
    out = {}
    for d, m in _products(white.select("d", "f", "whitened"), _parts, sent).items():
        n = fits[d].n
        mean = m[-1, :-1] / n
        fine = ~np.isnan(fits[d].scales()[:components])
        gap = m[:-1, :-1] / n - np.outer(mean, mean) - np.eye(len(mean))
        out[d] = float(np.abs(gap[np.ix_(fine, fine)]).max(initial=0.0))
    return out


def whiten(vectors: DataFrame, components: int = COMPONENTS, weigh: str = "count") -> DataFrame:
    """Rows (vec_id, component, n, deviation, whitened, explained, identity_error) of ``vectors(vec_id, embedding)``.

    ``weigh`` is "count" (each row counts in the fit) or "one" (each distinct
    vector does); n is the number of what counts.  Rows whose vector is null, or
    holds null, NaN, infinite or entries beyond 2^56 (which have no long) are left
    out; an empty vector has no components and so no rows.  Vectors of different
    lengths are fitted for themselves.  Repeated rows and null vec_ids stay as
    often as they come.  A component without variance, such as all but the first
    of two distinct vectors, has a null ``whitened`` and explains 0; deviation is
    null beyond a long.  An empty table gives no rows; extra columns are ignored.
    """
    if weigh not in ("count", "one"):
        raise ValueError(f"weigh is count or one, not {weigh}")
    keyed = _keyed(vectors)
    nodes = keyed.groupBy("key").agg(F.count("*").alias("w"), F.min("vec_id").alias("vec_id"))
    nodes = keep(nodes.withColumn("f", F.col("w") if weigh == "count" else F.lit(1).cast("long")), "distinct")
    fits = fit(nodes)
    sent = vectors.sparkSession.sparkContext.broadcast(fits)  # a number for each pair of dimensions
    white = keep(_whitened(nodes, sent, components), "whitened")
    errors = identity_errors(white, fits, components)

    # rows of vectors that occur once are there already; fewer than HOT vectors have more than a HOTth of all rows
    total = nodes.agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
    often = F.col("w") * HOT > max(total, HOT)
    found = ("d", "deviation", "whitened")
    hot = F.broadcast(white.filter(often).select("key", *found))
    rest = white.filter((F.col("w") > 1) & ~often).select("key", *found)
    once = white.filter((F.col("w") == 1) & ~often).select("vec_id", *found)
    rows = once.unionByName(keyed.join(hot, "key").select("vec_id", *found)).unionByName(keyed.join(hot.select("key"), "key", "left_anti").join(rest, "key").select("vec_id", *found))
    shown = [(d, f.n, [float(e) / f.total if f.total else 0.0 for e in np.where(np.isnan(f.scales()), 0.0, f.values)[:components]], errors.get(d, 0.0)) for d, f in fits.items()]
    sizes = vectors.sparkSession.createDataFrame(shown, "d int, n long, explained array<double>, identity_error double")  # a row for each length
    each = rows.join(F.broadcast(sizes), "d").withColumn("i", F.explode(F.sequence(F.lit(0), F.size("explained") - 1)))
    return each.select("vec_id", (F.col("i") + 1).cast("int").alias("component"), "n", "deviation", F.get("whitened", F.col("i")).alias("whitened"), F.get("explained", F.col("i")).alias("explained"), "identity_error")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def brute_force(rows: list[tuple], components: int = COMPONENTS) -> dict:
    """The same of vectors of one length, in whole numbers and fractions of Python; for tests.

    n, the deviation of each row, the covariance, and the share of each component.
    """
    kept = [(k, [math.floor(64 * c) + 1_000_000 for c in v]) for k, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    n, d = len(kept), len(kept[0][1])
    sums = [sum(x[i] for _, x in kept) for i in range(d)]
    cov = np.array([[float(Fraction(sum((n * x[i] - sums[i]) * (n * x[j] - sums[j]) for _, x in kept), n**3)) for j in range(d)] for i in range(d)])
    e = np.linalg.eigvalsh(cov)[::-1]
    return {"n": n, "deviation": [(k, sum((n * x[i] - sums[i]) ** 2 for i in range(d))) for k, x in kept], "cov": cov, "explained": (e / e.sum())[:components], "centred": [(k, [float(Fraction(n * x[i] - sums[i], n)) for i in range(d)]) for k, x in kept]}


QUERIES = {"op11_embedding_whitening": query}
ORACLES: dict[str, str] = {}
