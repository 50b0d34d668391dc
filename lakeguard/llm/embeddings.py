"""Embedding near-duplicates by a robust-pruned flat graph.

Distinct vectors are dealt to the shards of their nearest centroids, so shards
overlap.  In every shard each vector keeps a robust-pruned list of neighbours; a
vector's lists of all its shards are united.  The search starts at a shard's
medoid, which is always expanded first, and at the vector itself, walks greedily
towards it and then expands as long as neighbours are within range or near it, so
a dense group is followed to its end.  Links found are verified by the cosine in
double precision.  While the graph is built, all vectors of a shard within range
of each are counted; a vector whose walk finds fewer is compared to the whole
shard, so that no link inside a shard is lost.

A pair is counted in one shard only, the first that both vectors are in.  Each
shard passes on counts and one link to a representative per vector, never its
pairs.  A crowded shard is cut into chunks whose pairs are groups of their own.
Identical vectors are one node with a weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeguard.llm.common import connected, keep, materialise, only, partitions, table
from lakeguard.llm.kernels import components

COSINE = 0.95
#: Vectors that the centroids are fitted on, at most: those of the least hash.  Every vector is indexed.
SAMPLE_ROWS = 16_384
#: Shards that a vector belongs to, and vectors in one, about.
OVERLAP = 4
SHARD_ROWS = 1500
#: Vectors of a chunk of a crowded shard.
CHUNK_ROWS = 1500
#: Neighbours of the graph, candidates they are pruned from, and the pruning factor.
DEGREE, POOL, ALPHA = 24, 48, 1.2
#: Further neighbours, spread over those within range that are no candidates.
SPREAD = 16
#: Places and steps of the greedy walk; how far below the range the expansion goes on.
BEAM, STEPS, SLACK = 12, 10, 0.1
SEED = 7


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; they are scaled by their greatest component first, so that no square leaves a double's range."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def centroids(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """k unit centroids of unit vectors, by spherical k-means."""
    rng = np.random.default_rng(SEED)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        best = np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, best, x)
        norm = np.sqrt((total * total).sum(1, keepdims=True))
        c = np.where(norm > 1e-9, total / np.maximum(norm, 1e-9), c)
    return c


def robust_prune(x: np.ndarray, degree: int = DEGREE, pool: int = POOL, alpha: float = ALPHA, cosine: float = COSINE, spread: int = SPREAD) -> tuple[np.ndarray, np.ndarray]:
    """Neighbour lists (rows of indexes, -1 where fewer) of unit vectors, and how many are within range of each.

    Of a vector's nearest candidates the nearest is kept and those drop out that
    it is alpha times nearer to than the vector is; then the next one left, and so on.
    Where more are within range than the pool takes, ``spread`` of the others, from
    the nearest to the farthest, are neighbours as well: a tight bunch would else
    have edges to itself alone.
    """
    n = len(x)
    pool = min(pool, n - 1)
    out = np.full((n, degree + spread), -1, np.int64)
    within = np.zeros(n, np.int64)
    if pool < 1:
        return out, within
    for i in range(0, n, 256):
        own = np.arange(i, min(i + 256, n))
        sim = x[own] @ x.T
        sim[np.arange(len(own)), own] = -2
        within[own] = (sim >= cosine).sum(1)
        for r in np.flatnonzero(within[own] > pool):
            inside = np.flatnonzero(sim[r] >= cosine)
            inside = inside[np.argsort(-sim[r, inside], kind="stable")][pool:]
            far_ones = inside[np.unique(np.linspace(0, len(inside) - 1, spread).astype(int))]
            out[own[r], degree : degree + len(far_ones)] = far_ones
        near = np.argpartition(-sim, pool - 1, axis=1)[:, :pool]
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(sim, near, 1), axis=1, kind="stable"), 1)
        far = np.sqrt(np.maximum(0, 2 - 2 * np.take_along_axis(sim, near, 1)))
        among = x[near]
        between = np.sqrt(np.maximum(0, 2 - 2 * np.matmul(among, among.transpose(0, 2, 1))))
        alive = np.ones(near.shape, bool)
        held = np.zeros(len(own), np.int64)
        for t in range(pool):
            take = np.flatnonzero(alive[:, t] & (held < degree))
            out[own[take], held[take]] = near[take, t]
            held[take] += 1
            alive[take, t + 1 :] &= alpha * between[take, t, t + 1 :] > far[take, t + 1 :]
    return out, within


def range_search(x: np.ndarray, graph: np.ndarray, cosine: float = COSINE, slack: float = SLACK, beam: int = BEAM, steps: int = STEPS, within: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a < b) of unit vectors within range that the walk over ``graph`` reaches from every vector.

    With ``within``, the number in range of each, vectors of which it reaches fewer are compared to all.
    """
    n, width = graph.shape
    centre = x.mean(0)
    medoid = int((x @ centre).argmax())
    found: list[np.ndarray] = []
    for i in range(0, n, 128):
        own = np.arange(i, min(i + 128, n))
        q, rows = x[own], np.arange(len(own))
        seen = np.zeros((len(own), n), bool)
        best = np.full((len(own), beam), -1, np.int64)
        score = np.full((len(own), beam), -2.0)
        done = np.ones((len(own), beam), bool)
        best[:, 0], score[:, 0], done[:, 0] = medoid, q @ x[medoid], False
        best[:, 1], score[:, 1], done[:, 1] = own, 1.0, False
        seen[:, medoid] = True
        seen[rows, own] = True
        near_q, near_v = [rows], [own]
        for step in range(steps):
            # the medoid first, or the vector's own neighbours push it out of the beam
            pick = np.where(done, -3, score).argmax(1) if step else np.zeros(len(own), np.int64)
            go = ~done[rows, pick]
            if not go.any():
                break
            done[rows, pick] = True
            nodes = np.where(go, best[rows, pick], own)
            nb = graph[nodes]
            fresh = (nb >= 0) & ~seen[rows[:, None], np.maximum(nb, 0)]
            sim = np.where(fresh, np.einsum("bd,brd->br", q, x[np.maximum(nb, 0)]), -2)
            r, c = np.nonzero(fresh)
            seen[r, nb[r, c]] = True
            close = sim[r, c] >= cosine - slack
            near_q.append(r[close])
            near_v.append(nb[r, c][close])
            every = np.concatenate((score, sim), 1)
            top = np.argpartition(-every, beam - 1, axis=1)[:, :beam]
            best, score = np.take_along_axis(np.concatenate((best, nb), 1), top, 1), np.take_along_axis(every, top, 1)
            done = np.take_along_axis(np.concatenate((done, ~fresh), 1), top, 1)
        # the medoid may be within range itself
        near_q.append(rows)
        near_v.append(np.full(len(own), medoid))
        fq, fv = np.concatenate(near_q), np.concatenate(near_v)
        while len(fq):
            sim = np.einsum("pd,pd->p", q[fq], x[fv])
            hit = sim >= cosine
            a, b = own[fq[hit]], fv[hit]
            other = a != b
            found.append(np.unique(np.minimum(a, b)[other] * n + np.maximum(a, b)[other]))
            near = sim >= cosine - slack
            fq, fv = fq[near], fv[near]
            next_q, next_v = [], []
            for k in range(0, len(fq), 50_000):
                nb = graph[fv[k : k + 50_000]]
                qq = np.repeat(fq[k : k + 50_000], width)
                vv = nb.ravel()
                ok = vv >= 0
                qq, vv = qq[ok], vv[ok]
                ok = ~seen[qq, vv]
                key = np.unique(qq[ok] * n + vv[ok])
                qq, vv = key // n, key % n
                seen[qq, vv] = True
                next_q.append(qq)
                next_v.append(vv)
            fq, fv = (np.concatenate(next_q), np.concatenate(next_v)) if next_q else (fq[:0], fv[:0])
    key = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    if within is not None:
        short = np.flatnonzero(np.bincount(key // n, minlength=n) + np.bincount(key % n, minlength=n) < within)
        more = [key]
        for i in range(0, len(short), 128):
            a, b = np.nonzero(x[short[i : i + 128]] @ x.T >= cosine)
            a = short[i : i + 128][a]
            more.append((np.minimum(a, b) * n + np.maximum(a, b))[a != b])
        key = np.unique(np.concatenate(more))
    return key // n, key % n


def _component(vectors: DataFrame) -> str:
    """float if the components are floats, else double."""
    return "float" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "double"


def _valid(vectors: DataFrame) -> DataFrame:
    e = F.col("embedding")
    size = F.coalesce(F.size(e), F.lit(0))
    finite = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.withColumn("valid", F.coalesce((size > 0) & finite & F.exists(e, lambda v: v != 0), F.lit(False)))


def _fit(nodes: DataFrame, sample_rows: int, shard_rows: int, overlap: int) -> dict[int, np.ndarray]:
    """Centroids by vector length, fitted on the driver on a bounded sample."""
    sizes = {r[0]: r[1] for r in nodes.groupBy(F.size("embedding")).count().collect()}  # one row for each length
    out = {}
    for d, n in sizes.items():
        sample = nodes.filter(F.size("embedding") == d).orderBy(F.xxhash64("embedding"), "rid").limit(min(sample_rows, max(1024, (32 << 20) // (8 * d)))).select("embedding").toArrow()
        x = unit(_matrix(sample["embedding"]))
        out[d] = centroids(x, max(1, min(len(x) // 4, round(n * overlap / shard_rows)))) if len(x) >= 8 else x[:1]
    return out


_MEMBER = "shard long, shards array<long>, rid long, w long, embedding array<{}>"


def _deal(nodes: DataFrame, fitted: dict[int, np.ndarray], overlap: int) -> DataFrame:
    """A row for each node and shard."""
    sent = nodes.sparkSession.sparkContext.broadcast(fitted)  # as many as the bounded sample allows
    first, base = {}, 0
    for d in sorted(fitted):
        first[d] = base
        base += len(fitted[d])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.diff(np.asarray(batch.column(2).offsets))
            for d in np.unique(lengths).tolist():
                part = batch.filter(pa.array(lengths == d))
                c = sent.value[d]
                k = min(overlap, len(c))
                for i in range(0, part.num_rows, 2048):
                    rows = part.slice(i, 2048)
                    sim = unit(_matrix(rows.column(2))) @ c.T
                    shards = np.sort(np.argpartition(-sim, k - 1, axis=1)[:, :k] + first[d], axis=1)
                    back = np.repeat(np.arange(len(shards)), k)
                    listed = pa.ListArray.from_arrays(pa.array(np.arange(len(shards) + 1, dtype=np.int32) * k), pa.array(shards.ravel())).take(pa.array(back))
                    yield pa.RecordBatch.from_arrays([pa.array(shards.ravel()), listed, rows.column(0).take(pa.array(back)), rows.column(1).take(pa.array(back)), rows.column(2).take(pa.array(back))], ["shard", "shards", "rid", "w", "embedding"])

    return nodes.select("rid", "w", "embedding").mapInArrow(run, _MEMBER.format(_component(nodes)))


def links(nodes: DataFrame, cosine: float = COSINE, sample_rows: int = SAMPLE_ROWS, shard_rows: int = SHARD_ROWS, overlap: int = OVERLAP, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(rid, n, root) of ``nodes(rid, w, embedding)``: linked weight found in a group, and the group's smallest node linked to it."""
    dealt = _deal(nodes, _fit(nodes, sample_rows, shard_rows, overlap), overlap)
    # one row for each shard that is crowded
    crowd = dealt.groupBy("shard").count().filter(F.col("count") > 2 * chunk_rows).select("shard", F.ceil(F.col("count") / chunk_rows).cast("int").alias("chunks"))
    members = keep(
        dealt.join(F.broadcast(crowd), "shard", "left")
        .withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        .withColumn("chunk", F.pmod(F.xxhash64("rid"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("shard", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "shards", "rid", "w", "embedding"),
        "members",
    )
    n = partitions(nodes.sparkSession)

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        rid = rows["rid"].to_numpy()
        graph, within = robust_prune(unit(_matrix(rows["embedding"])), cosine=cosine)
        counts = (graph >= 0).sum(1)
        listed = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(rid[graph[graph >= 0]]))
        where = {c: pa.array(np.full(len(rid), k.as_py()), pa.int64()) for c, k in zip("sij", key, strict=True)}
        return pa.table({"rid": rows["rid"], "nb": listed, **where, "k": pa.array(within)})

    # lists and numbers of one vector: one for each of its shards and chunk pairs
    united = members.repartition(n, "shard", "i", "j").groupBy("shard", "i", "j").applyInArrow(build, "rid long, nb array<long>, s long, i long, j long, k long").groupBy("rid").agg(F.array_distinct(F.flatten(F.collect_list("nb"))).alias("nb"), F.collect_list(F.struct("s", "i", "j", "k")).alias("within"))

    def search(key: tuple, rows: pa.Table) -> pa.Table:
        shard, i, j = (k.as_py() for k in key)
        rows = rows.sort_by("rid")
        rid, w, chunk = (rows[c].to_numpy() for c in ("rid", "w", "chunk"))
        x = unit(_matrix(rows["embedding"]))
        lists = rows["nb"].combine_chunks()
        flat, lengths = lists.flatten().to_numpy(zero_copy_only=False), np.diff(np.asarray(lists.offsets))
        at = np.minimum(np.searchsorted(rid, flat), len(rid) - 1)
        here = rid[at] == flat
        owner = np.repeat(np.arange(len(rid)), lengths)[here]
        per = np.bincount(owner, minlength=len(rid))
        graph = np.full((len(rid), max(1, int(per.max(initial=0)))), -1, np.int64)
        graph[owner, np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)] = at[here]
        a, b = range_search(x, graph, cosine, within=rows["k"].to_numpy())
        fine = np.ones(len(a), bool)
        if i != j:
            fine &= chunk[a] != chunk[b]
        shards = rows["shards"].combine_chunks().flatten().to_numpy().reshape(len(rid), -1)
        for k in range(0, len(a), 200_000):
            s, t = shards[a[k : k + 200_000]], shards[b[k : k + 200_000]]
            both = np.where((s[:, :, None] == t[:, None, :]).any(2), s, np.iinfo(np.int64).max).min(1)
            fine[k : k + 200_000] &= both == shard
        a, b = a[fine], b[fine]
        total = np.bincount(a, w[b], len(rid)) + np.bincount(b, w[a], len(rid))
        label = components(len(rid), a, b)
        out = np.flatnonzero(total > 0)
        return pa.table({"rid": rid[out], "n": total[out].astype(np.int64), "root": rid[label[out]]})

    def own(w):
        return (w["s"] == F.col("shard")) & (w["i"] == F.col("i")) & (w["j"] == F.col("j"))

    joined = members.join(united, "rid").withColumn("k", F.filter("within", own)[0]["k"]).drop("within")
    return joined.groupBy("shard", "i", "j").applyInArrow(search, "rid long, n long, root long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, **index: int) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors(vec_id, embedding)``.

    Vectors that are null, empty, zero, or hold null or non-finite components
    link with nothing; vectors of different lengths do not link.  Repeated rows
    and equal vectors link with each other.  component_id is the smallest vec_id
    that links reach; a row with a null vec_id is kept only if its component has
    no other.  An empty table gives no rows; extra columns are ignored.
    """
    marked = _valid(only(vectors, "vec_id", "embedding").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{_component(vectors)}>").alias("embedding")))
    nodes = materialise(marked.filter("valid").groupBy("embedding").agg(F.count("*").alias("w"), F.min("vec_id").alias("least")).withColumn("rid", F.monotonically_increasing_id()))
    found = materialise(links(nodes, cosine, **index))
    counts = found.groupBy("rid").agg(F.sum("n").alias("n"))
    groups = connected(found.select(F.col("rid").alias("u"), F.col("root").alias("v")))
    named = groups.join(nodes.select("rid", "least"), F.col("node") == F.col("rid"))
    least = named.groupBy("root").agg(F.min("least").alias("smallest"))
    of = named.join(least, "root").select("rid", "smallest")
    summary = nodes.join(counts, "rid", "left").join(of, "rid", "left").select("embedding", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("smallest", "least").alias("component_id"))
    summary = materialise(summary)
    linked = marked.filter("valid").join(summary, "embedding").select("vec_id", "n_links", "component_id")
    alone = marked.filter("not valid").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def audit_recall(vectors: DataFrame, found: DataFrame, cosine: float = COSINE, every: int = 50, blocks: int = 16) -> float:
    """Share of the links of every fiftieth vector, counted against all rows in blocks, that ``found`` has."""
    rows = _valid(only(vectors, "vec_id", "embedding")).filter("valid")
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks))
    asked = rows.filter(F.col("vec_id") % every == 0).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(F.col("block").cast("long").alias("block"), F.size("embedding").alias("d"), "vec_id", "embedding")
    dealt = rows.select(block.cast("long").alias("block"), F.size("embedding").alias("d"), "vec_id", "embedding")

    def compare(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({"vec_id": pa.array([], pa.int64()), "links": pa.array([], pa.int64())})
        a, b = unit(_matrix(left["embedding"])), unit(_matrix(right["embedding"]))
        k = sum(((a @ b[i : i + 1024].T) >= cosine).sum(1) for i in range(0, len(b), 1024))
        return pa.table({"vec_id": left["vec_id"], "links": pa.array(np.asarray(k, np.int64))})

    true = asked.groupBy("block", "d").cogroup(dealt.groupBy("block", "d")).applyInArrow(compare, "vec_id long, links long").groupBy("vec_id").agg((F.sum("links") - 1).alias("links"))
    row = true.join(found, "vec_id").agg(F.sum("links"), F.sum(F.least("links", "n_links"))).first()
    return float(row[1]) / row[0] if row[0] else 1.0


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE = r"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS u, vec_id AS r FROM embeddings UNION SELECT l.v AS u, reach.r FROM reach JOIN l ON l.u = reach.u),
c AS (SELECT u, min(r) AS component_id FROM reach GROUP BY u),
n AS (SELECT u, count(*) AS k FROM l GROUP BY u)
SELECT e.vec_id, CAST(coalesce(k, 0) AS BIGINT) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN c ON c.u = e.vec_id LEFT JOIN n ON n.u = e.vec_id
"""

QUERIES = {"op7_embedding_near_dedup": query}
ORACLES = {"op7_embedding_near_dedup": ORACLE}
