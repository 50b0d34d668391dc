"""Mixing sources to target weights by the cube method.

A document of a source whose target is r times its size is taken floor(r) times
and once more with probability r - floor(r).  The cube method draws these last
takes so that in every source the taken tokens and the taken documents stay
balanced: inclusion probabilities move along the null space of the two balance
constraints until all but two documents of a block are decided.  Blocks are
groups of one source's documents by hash, so a hot source spreads over many
tasks; the few undecided ones of all blocks fly again in fewer, larger blocks,
and the landing at the end settles at most two documents of a source, then turns
over single documents of its block where that brings the tokens nearer.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeguard.llm.common import materialise, table
from lakeguard.llm.kernels import SPACE_WORDS, Words, slices, strings

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (1, 2, 3)
#: No source is taken more than so many times.
MOST = 3
#: Documents in a block of the first flight.
BLOCK_ROWS = 5000
SEED = 42
_EPS = 1e-9


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, tie): words of each text, and a hash that tells rows of one doc_id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = strings(batch.column(3))
            n = np.zeros(batch.num_rows, np.int64)
            for i, j in slices(offsets):
                n[i:j] = np.diff(Words(raw[offsets[i] : offsets[j]], offsets[i : j + 1], SPACE_WORDS).first)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), batch.column(2)], ["doc_id", "source", "size", "tie"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("tie"), F.col("text"))
    return picked.mapInArrow(run, "doc_id long, source string, size long, tie long")


def targets(totals: list[tuple[str | None, int]], weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> list[tuple[str | None, int, float]]:
    """(source, size, target): shares of the whole by weight, none above ``most`` times its source.

    What a source cannot take is shared by weight among those below their limit, until none is above.
    """
    totals = sorted(totals, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {i: Fraction(weights[i % len(weights)]) for i in range(len(totals))}
    left, got = Fraction(sum(n for _, n in totals)), {}
    open_ = {i for i, (_, n) in enumerate(totals) if n > 0}
    while open_:
        whole = sum(weight[i] for i in open_)
        above = {i for i in open_ if left * weight[i] / whole > most * totals[i][1]}
        for i in above or open_:
            got[i] = Fraction(most) * totals[i][1] if above else left * weight[i] / whole
        left -= sum(got[i] for i in above)
        open_ = open_ - above if above else set()
    return [(s, n, float(got.get(i, 0))) for i, (s, n) in enumerate(totals)]


def flight(p: np.ndarray, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Probabilities after the flight: all but at most two are 0 or 1, Σp and Σpx as before.

    p: inclusion probabilities.  x: token counts.  Three undecided documents at a
    time move along the vector that is orthogonal to (1, 1, 1) and to their tokens.
    """
    p = p.astype(float).copy()
    draws = rng.random(2 * len(p) + 4).tolist()
    size, prob = x.tolist(), p.tolist()
    live: list[int] = []
    used = 0
    for k in range(len(prob)):
        if not _EPS < prob[k] < 1 - _EPS:
            continue
        live.append(k)
        while len(live) == 3:
            a, b, c = live
            u = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
            if u == (0, 0, 0):
                u = (1, -1, 0)
            up = min((1 - prob[i]) / v if v > 0 else prob[i] / -v for i, v in zip(live, u, strict=True) if v)
            down = min(prob[i] / v if v > 0 else (1 - prob[i]) / -v for i, v in zip(live, u, strict=True) if v)
            step = up if draws[used] * (up + down) < down else -down
            used += 1
            for i, v in zip(live, u, strict=True):
                prob[i] = min(1.0, max(0.0, prob[i] + step * v))
            live = [i for i in live if _EPS < prob[i] < 1 - _EPS]
    out = np.array(prob)
    out[out <= _EPS], out[out >= 1 - _EPS] = 0.0, 1.0
    return out


def landing(p: np.ndarray, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Settles what a flight left, by the choice that keeps the tokens nearest; of equal ones at random."""
    p = p.copy()
    open_ = np.flatnonzero((p > 0) & (p < 1))
    if len(open_):
        goal = float((p[open_] * x[open_]).sum())
        tries = [np.array([(m >> i) & 1 for i in range(len(open_))]) for m in range(1 << len(open_))]
        cost = np.array([abs(float((t * x[open_]).sum()) - goal) for t in tries])
        near = np.flatnonzero(cost <= cost.min() + _EPS)
        p[open_] = tries[int(near[int(rng.random() * len(near))])]
    return p


def settle(start: np.ndarray, p: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A landed draw whose tokens are brought near those of ``start`` by turning over single documents.

    Each turn takes the document whose tokens are nearest to what is missing or
    too many, and only if that comes nearer, so it ends; of equal ones the first.
    """
    p = p.copy()
    while True:
        missing = float((start * x).sum() - (p * x).sum())
        change = np.where(p == 0, x, -x)
        k = int(np.abs(missing - change).argmin()) if len(p) else 0
        if not len(p) or abs(missing - change[k]) >= abs(missing) - _EPS:
            break
        p[k] = 1 - p[k]
    return p


_UNITS = "doc_id long, source string, size long, tie long, copy long, rho double, p double"


def _fly(units: DataFrame, blocks: str, land: bool) -> DataFrame:
    """Flies each block of a source's undecided rows, large ones first, so that what is left to land is small."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "doc_id", "tie", "copy"], ascending=[False, True, True, True], kind="stable", na_position="first")
        name = "" if key[0] is None else str(key[0])
        rng = np.random.default_rng([SEED, int(land), int(key[1]), *name.encode()])
        x = rows["size"].to_numpy(float)
        p = flight(rows["p"].to_numpy(), x, rng)
        rows["p"] = settle(rows["p"].to_numpy(), landing(p, x, rng), x) if land else p
        return rows.drop(columns="block")

    return units.withColumn("block", F.expr(blocks)).groupBy("source", "block").applyInPandas(run, _UNITS)


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """How often each row of ``docs(doc_id, text, source)`` is taken.

    Columns: doc_id, source, size, tie, source_size, target and copies (0 to
    ``most``).  Null and empty texts have size 0 and are taken at their source's
    rate; a source of only such texts has target 0 and none of it is taken; a
    null source is a source of its own, the last.  Rows that repeat are told
    apart by number.  An empty table gives no rows; extra columns are ignored.
    """
    spark = docs.sparkSession
    measured = materialise(sizes(docs))
    # one row for each source
    totals = [tuple(r) for r in measured.groupBy("source").agg(F.sum("size"), F.count("*")).collect()]
    goals = targets([(s, n) for s, n, _ in totals], weights, most)
    goal_rows = spark.createDataFrame(goals, "source string, source_size long, target double")
    same = Window.partitionBy("doc_id", "tie", "source", "size").orderBy("doc_id")
    units = (
        measured.withColumn("copy", F.row_number().over(same).cast("long"))
        .alias("m")
        .join(F.broadcast(goal_rows.alias("g")), F.col("m.source").eqNullSafe(F.col("g.source")))
        .select("doc_id", "m.source", "size", "tie", "copy", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rho"))
        .withColumn("p", F.col("rho") - F.floor("rho"))
    )
    n = max((k for _, _, k in totals), default=0)
    blocks = max(1, -(-n // block_rows))
    state = units.filter(f"p > {_EPS} and p < {1 - _EPS}")
    sure = units.filter(f"not (p > {_EPS} and p < {1 - _EPS})").withColumn("p", F.round("p"))
    done = [sure]
    while True:
        land = blocks == 1
        state = materialise(_fly(state, f"cast(pmod(xxhash64(doc_id, tie, copy), {blocks}) as long)", land))
        done.append(state.filter("p = 0 or p = 1"))
        if land:
            break
        state = state.filter("p > 0 and p < 1")
        blocks = -(-blocks * 2 // block_rows)  # two undecided rows for each block at most
    taken = done[0]
    for part in done[1:]:
        taken = taken.unionByName(part)
    return taken.withColumn("copies", (F.floor("rho") + F.col("p")).cast("int")).alias("m").join(F.broadcast(goal_rows.alias("g")), F.col("m.source").eqNullSafe(F.col("g.source"))).select("doc_id", "m.source", "size", "tie", "copy", "source_size", "target", "copies")


def apply_mix(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The rows of docs, each as often as it is taken, with the columns of docs, whatever their names."""
    # rows of one (doc_id, text, source) are taken in the order of their number, which is the same for equal rows
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    doc, source, tie = F.col("row.doc_id"), F.col("row.source"), F.xxhash64("row.text")
    keyed = held.select("row", doc.alias("doc_id"), source.alias("source"), tie.alias("tie"))
    same = Window.partitionBy("doc_id", "tie", "source").orderBy(F.xxhash64("row"))
    numbered = keyed.withColumn("copy", F.row_number().over(same).cast("long")).alias("a")
    taken = mixed.filter("copies > 0").select("doc_id", "tie", "source", "copy", "copies").alias("b")
    met = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.tie") == F.col("b.tie")) & F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.copy") == F.col("b.copy"))
    return numbered.join(taken, met).select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


QUERIES = {"op8_mix_sources": query}
ORACLES: dict[str, str] = {}
