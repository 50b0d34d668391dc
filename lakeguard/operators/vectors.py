"""Search in buckets of random projections, and stores of vectors that grow."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeguard.functions.ranking import global_rank
from lakeguard.functions.storage import cut

#: Rows to a bucket, about, and tables of buckets; each table has projections of its own.
BUCKET_ROWS, TABLES = 64, 24
#: Rows of a block of vectors and of a block of queries, about: two of them are in memory at once.
BLOCK_ROWS = 20_000
#: Queries of a block that are compared at once.
AT_ONCE = 256
#: How far a product of matrices and a sum in order may be apart, in parts of the vectors' sizes, and how far equal rounded values.
ERROR, ROUNDED = 1e-11, 1.1e-9


def _matrix(vectors: pa.ChunkedArray, size: int) -> np.ndarray:
    return vectors.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype("float64")


def _in_order(a: np.ndarray, b: np.ndarray, squares: bool = False) -> np.ndarray:
    """Sums over the components from the first to the last, as a fold over them gives."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += (a[:, i] - b[:, i]) ** 2 if squares else a[:, i] * b[:, i]
    return out


def _best(asked: pa.Table, block: pa.Table, k: int, measure: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, vector ids, values) of one size: of each query the k nearest of the block, and those that may round to the same.

    Products of matrices say which pairs may be among them; the values of these
    are summed in order.  Of equal vectors the first by id are enough.
    """
    size, sign = asked["d"][0].as_py(), -1.0 if measure == "l2" else 1.0
    ids, x, n = block["id"].to_numpy(), _matrix(block["e"], size), block["n"].to_numpy()
    order = np.argsort(ids, kind="stable")
    _, same = np.unique(x[order].view(f"V{8 * size}").ravel(), return_inverse=True)
    by = np.argsort(same, kind="stable")
    starts = np.concatenate(([0], np.cumsum(np.bincount(same))[:-1]))
    order = order[by[np.arange(len(by)) - starts[same[by]] <= k]]  # k and the query itself
    ids, x, n = ids[order], x[order], n[order]
    who, q, m = asked["id"].to_numpy(), _matrix(asked["e"], size), asked["n"].to_numpy()
    found = []
    for at in range(0, len(who), AT_ONCE):
        some = slice(at, at + AT_ONCE)
        with np.errstate(all="ignore"):
            s = q[some] @ x.T
            scale = np.outer(m[some], n)
            if measure == "cosine":
                s, scale = s / scale, 1.0
            elif measure == "l2":
                scale = m[some, None] ** 2 + n**2
                s = 2 * s - scale
            low = s - (ROUNDED + ERROR * scale)
            high = s + (ROUNDED + ERROR * scale)
        odd = ~(np.isfinite(low) & np.isfinite(high))
        low[odd], high[odd] = -np.inf, np.inf  # always looked at
        mine = who[some, None] == ids
        low[mine] = high[mine] = -np.inf
        if len(ids) > k:
            least = np.partition(low, len(ids) - k, axis=1)[:, len(ids) - k, None]
            keep = (high >= least) & ~mine
        else:
            keep = ~mine
        i, j = np.nonzero(keep)
        with np.errstate(all="ignore"):
            value = _in_order(q[some][i], x[j], measure == "l2")
            if measure == "cosine":
                value = value / (m[some][i] * n[j])
        # once more with what is exact; a value that is no number counts as the greatest, as it does in a sort
        key = np.where(np.isnan(value), np.inf, value) * sign
        place = np.lexsort((ids[j], -key, i))
        i, j, value, key = i[place], j[place], value[place], key[place]
        first = np.searchsorted(i, np.arange(len(who[some])))
        last = np.minimum(first + k, np.append(first[1:], len(i))) - 1
        bound = np.where(last >= first, key[np.clip(last, 0, max(len(key) - 1, 0))], -np.inf) if len(key) else np.full(len(who[some]), -np.inf)
        near = key >= bound[i] - ROUNDED if len(key) else np.zeros(0, bool)
        found.append((who[some][i[near]], ids[j[near]], value[near]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _ready(df: DataFrame, measure: str) -> DataFrame:
    """(id, e, d, n): vectors that have a value for the measure, with size and length."""
    length = F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    out = df.select(F.col("vec_id").cast("long").alias("id"), F.col("e").cast("array<double>").alias("e"), F.size("e").alias("d"), length.alias("n")).filter("n IS NOT NULL AND d > 0")
    return out.filter("n > 0") if measure == "cosine" else out


def _met(queries: DataFrame, vectors: DataFrame, by: list[str], k: int, measure: str) -> DataFrame:
    """(query_id, vec_id, similarity) of pairs that agree in the columns ``by``, in matrices; the k best of each group and more where they are alike."""
    def meet(asked: pa.Table, block: pa.Table) -> pa.Table:
        who, ids, value = _best(asked, block, k, measure) if asked.num_rows and block.num_rows else (np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0))
        return pa.table({"query_id": pa.array(who, pa.int64()), "vec_id": pa.array(ids, pa.int64()), "similarity": pa.array(value, pa.float64())})

    pairs = queries.groupBy(*by).cogroup(vectors.groupBy(*by)).applyInArrow(meet, "query_id long, vec_id long, similarity double")
    return pairs.withColumn("similarity", F.round("similarity", 9))


def _ranked(pairs: DataFrame, k: int, measure: str = "cosine") -> DataFrame:
    best = [F.asc("similarity") if measure == "l2" else F.desc("similarity"), F.asc("vec_id")]
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*best)).cast("long"))
    return ranked.filter(F.col("rank") <= k).select("query_id", "vec_id", "similarity", "rank")


def knn(queries: DataFrame, vectors: DataFrame, k: int, measure: str = "cosine") -> DataFrame:
    """(query_id, vec_id, similarity, rank): the k nearest of ``vectors(vec_id, e)`` to each of ``queries(vec_id, e)``, itself left out.

    measure is cosine (zero vectors have none), l2 (similarity is the squared
    distance, the least first) or inner_product.  Both sides are dealt into blocks, as many as
    they need; each block of queries meets each block of vectors, as a product of matrices in one
    task, and passes on k for each query.  Vectors with null components are left out, and pairs of
    different sizes, as they have no value.
    """
    asked, dealt = _ready(queries, measure), _ready(vectors, measure)
    blocks = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-vectors.count() // BLOCK_ROWS))
    rounds = max(1, -(-queries.count() // BLOCK_ROWS))

    def block(n: int) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")

    def each(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    asked = asked.withColumn("a", block(rounds)).withColumn("b", each(blocks))
    dealt = dealt.withColumn("b", block(blocks)).withColumn("a", each(rounds))
    return _ranked(_met(asked, dealt, ["a", "b", "d"], k, measure), k, measure)


def knn_bucketed(queries: DataFrame, vectors: DataFrame, k: int, bucket_rows: int = BUCKET_ROWS, tables: int = TABLES, seed: int = 5) -> DataFrame:
    """(query_id, vec_id, similarity, rank): the k nearest by cosine of ``queries`` among ``vectors(vec_id, embedding)``.

    In each table a vector's bucket is the signs of random projections, as many
    as make buckets of some ``bucket_rows``.  Candidates share a bucket in one
    table at least and are ranked by their exact cosine.  Null, zero and odd-sized
    vectors are left out.
    """
    clean = vectors.filter(F.col("embedding").isNotNull() & F.exists("embedding", lambda x: x != 0))
    top = clean.agg(F.count("*").alias("n"), F.mode(F.size("embedding")).alias("d")).first()
    if not top["n"]:
        return vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, similarity double, rank long")
    size, bits = top["d"], max(1, int(np.log2(max(2, top["n"] / bucket_rows))))
    planes = np.random.default_rng(seed).normal(size=(tables, bits, size)).reshape(-1, size).T

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            up = (_matrix(pa.chunked_array([batch["e"]]), size) @ planes >= 0).reshape(-1, tables, bits)
            codes = np.packbits(up, axis=2)
            buckets = pa.array([[bytes(t) for t in row] for row in codes], pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([*batch.columns, buckets], [*batch.schema.names, "buckets"])

    def dealt(df: DataFrame) -> DataFrame:
        fit = df.filter(F.size("embedding") == size).withColumn("e", F.col("embedding").cast("array<double>"))
        return _ready(fit, "cosine").mapInArrow(sides, "id long, e array<double>, d int, n double, buckets array<binary>").select("id", "e", "d", "n", F.posexplode("buckets").alias("table", "bucket"))

    return _ranked(_met(dealt(queries), dealt(clean), ["table", "bucket"], k, "cosine").distinct(), k)


def append(store: DataFrame | None, vectors: DataFrame, order: Sequence[str], size: int) -> DataFrame:
    """The store with the vectors of the right size added, numbered on from its last id in ``order``."""
    fit = vectors.filter(F.col("embedding").isNotNull() & (F.size("embedding") == size))
    numbered = global_rank(fit, [F.col(c) for c in order], name="id")
    if store is None:
        return cut(numbered)
    last = store.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("_last"))
    return cut(store.unionByName(numbered.join(F.broadcast(last)).withColumn("id", F.col("id") + F.col("_last") + 1).drop("_last")))
