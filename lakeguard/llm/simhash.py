"""SimHash near-duplicates by a binary trie self-join.

Fingerprints are computed per document.  Distinct ones are then dealt into
groups that agree on some of their blocks of bits: of five blocks two
fingerprints with at most four differing bits agree on one at least, of six on
two, so no link is lost.  The more fingerprints there are the more blocks are
used, so that groups stay small.  In every group the fingerprints form a binary
trie over their other bits; the trie is joined with itself by walking pairs of
nodes together, adding up the bits in which their paths differ, and leaving a
pair as soon as the budget is spent.  Groups pass on links to their local
representative only, never all pairs; a hot group is cut into chunks whose pairs
are separate groups, and a task reads its groups one after another.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeguard.llm.common import connected, materialise, only, partitions, table
from lakeguard.llm.kernels import components, strings

#: Differing bits of a link.
MAX_BITS = 4
#: Words in a shingle.
SHINGLE = 4
SEED = 42
#: Most fingerprints of one group before it is cut into chunks.
GROUP_ROWS = 200_000
#: Rows that a task holds at a time, or one group, if that has more.
HELD_ROWS = 500_000


def fingerprint(raw: bytes, shingle: int = SHINGLE) -> int:
    """Fingerprint of a UTF-8 text: 64 bits, each set if it is set in over half of the shingles' hashes.

    A text of fewer words than a shingle is one shingle; one of no words gives 0.
    """
    words = raw.lower().split()  # on bytes both know ASCII only
    n = len(words)
    if n <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED) if n else 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[: n - shingle] + 1))
    digest, seed = xxhash.xxh64_intdigest, SEED
    h = np.fromiter((digest(joined[s:e], seed) for s, e in zip(starts.tolist(), ends[shingle - 1 :].tolist(), strict=True)), np.uint64, n - shingle + 1)
    total = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        total += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, carried: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp long) and the longs ``carried`` for every row; a null or empty text has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = strings(batch.column(1))
            data = raw.tobytes()
            fp = np.fromiter((fingerprint(data[a:b], shingle) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64)), *batch.columns[2:]], ["doc_id", "fp", *carried])

    return only(docs, "doc_id", "text", *carried).mapInArrow(run, ", ".join(f"`{c}` long" for c in ("doc_id", "fp", *carried)))


def trie_links(keys: np.ndarray, groups: np.ndarray, depth: int, budget: int, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of at most ``budget`` bits between the sorted ``keys`` of the same group.

    A trie node is a range of the sorted array; ``depth`` bits are equal in a
    group.  Pairs of nodes whose keys all have the same label already are left out.
    """
    n = len(keys)
    runs = np.concatenate(([0], np.cumsum(label[1:] != label[:-1])))
    first = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1])))
    last = np.append(first[1:], n)
    alo, ahi, blo, bhi, err = first, last, first, last, np.zeros(len(first), np.int64)
    out_a, out_b = [], []
    for bit in range(63 - depth, -2, -1):
        size_a, size_b = ahi - alo, bhi - blo
        same = (alo == blo) & (ahi == bhi)
        keep = (size_a > 0) & (size_b > 0) & (err <= budget) & ~(same & (size_a < 2))
        settled = (label[np.minimum(alo, n - 1)] == label[np.minimum(blo, n - 1)]) & (runs[np.minimum(alo, n - 1)] == runs[np.maximum(ahi - 1, 0)]) & (runs[np.minimum(blo, n - 1)] == runs[np.maximum(bhi - 1, 0)])
        keep &= ~settled
        small = keep & ((size_a * size_b <= 64) | (bit < 0))
        if small.any():
            sa, sb = size_a[small], size_b[small]
            k = sa * sb
            which = np.repeat(np.arange(len(k)), k)
            at = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
            a, b = alo[small][which] + at // sb[which], blo[small][which] + at % sb[which]
            fine = (a != b) & (np.bitwise_count(keys[a] ^ keys[b]) <= budget)
            out_a.append(a[fine])
            out_b.append(b[fine])
        keep &= ~small
        if bit < 0 or not keep.any():
            break
        alo, ahi, blo, bhi, err, same = (x[keep] for x in (alo, ahi, blo, bhi, err, same))
        ones = np.concatenate(([0], np.cumsum((keys >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)))
        amid, bmid = ahi - (ones[ahi] - ones[alo]), bhi - (ones[bhi] - ones[blo])
        other = ~same
        alo, ahi, blo, bhi, err = (
            np.concatenate(x)
            for x in (
                (alo, amid, alo, amid[other]),
                (amid, ahi, amid, ahi[other]),
                (blo, bmid, bmid, blo[other]),
                (bmid, bhi, bhi, bmid[other]),
                (err, err, err + 1, err[other] + 1),
            )
        )
    none = np.zeros(0, np.int64)
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (none, none)


def _deals(max_bits: int, blocks: int) -> list[list[tuple[int, int]]]:
    """For each set of blocks that two fingerprints may agree on: all (first bit from the top, width), the agreeing ones first."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    cuts = [(edges[i], edges[i + 1] - edges[i]) for i in range(blocks)]
    return [[cuts[i] for i in agreed] + [c for i, c in enumerate(cuts) if i not in agreed] for agreed in combinations(range(blocks), blocks - max_bits)]


def _turned(fp: np.ndarray, order: list[tuple[int, int]]) -> np.ndarray:
    """Fingerprints with their blocks in another order."""
    out = np.zeros(len(fp), np.uint64)
    for first, width in order:
        out = (out << np.uint64(width)) | ((fp >> np.uint64(64 - first - width)) & np.uint64((1 << width) - 1))
    return out


def _groups(batches: Iterator[pa.RecordBatch], held: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The sorted columns of the batches, some whole groups (equal in all but the first column) at a time."""
    parts: list[list[np.ndarray]] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        parts.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        rows += batch.num_rows
        if rows >= held:
            columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
            change = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns[1:]]))
            if len(change):
                cut = int(change[-1]) + 1
                yield tuple(c[:cut] for c in columns)
                columns = [c[cut:] for c in columns]
            parts, rows = [columns], len(columns[0])
    if rows:
        yield tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def links(fps: DataFrame, max_bits: int = MAX_BITS, group_rows: int = GROUP_ROWS, blocks: int | None = None, held_rows: int = HELD_ROWS) -> DataFrame:
    """Links (u, v) that join the same distinct fingerprints ``fps(fp)`` as all pairs within max_bits do.

    One link to the representative is kept for each fingerprint and group.
    """
    spark = fps.sparkSession
    total = fps.count()
    if blocks is None:
        # the fewest blocks whose groups, if even, hold no more than group_rows
        blocks = next(m for m in range(max_bits + 1, max_bits + 5) if total >> (m - max_bits) * (64 // m) <= group_rows or m == max_bits + 4)
    deals = _deals(max_bits, blocks)
    agreed = blocks - max_bits

    def part(order: list[tuple[int, int]]) -> Column:
        key = F.lit(0).cast("long")
        for first, width in order[:agreed]:
            key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned("fp", 64 - first - width).bitwiseAND(F.lit((1 << width) - 1)))
        return key

    dealt = fps.select("fp", F.posexplode(F.array(*[part(order) for order in deals])).alias("r", "b"))
    n = partitions(spark)
    target = min(group_rows, max(1000, 2 * total * len(deals) // n))
    # groups beyond the target: few, but as many as the data has, so joined by what Spark finds best
    hot = dealt.groupBy("r", "b").count().filter(F.col("count") > target).select("r", "b", F.ceil(F.col("count") / target).cast("int").alias("chunks"))
    dealt = (
        dealt.join(hot, ["r", "b"], "left")
        .withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("fp", "r", "b", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
        .repartition(n, "r", "b", "i", "j")
        .sortWithinPartitions("r", "b", "i", "j")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fp, r, b, i, j in _groups(batches, held_rows):
            fp = fp.view(np.uint64)
            for deal in np.unique(r).tolist():
                own = np.flatnonzero(r == deal)
                order = deals[deal]
                width = sum(w for _, w in order[:agreed])
                turned = _turned(fp[own], order)
                sort = np.lexsort((turned, j[own], i[own], b[own]))
                own, turned = own[sort], turned[sort]
                change = (b[own][1:] != b[own][:-1]) | (i[own][1:] != i[own][:-1]) | (j[own][1:] != j[own][:-1])
                group = np.concatenate(([0], np.cumsum(change)))
                label = np.arange(len(own))
                for budget in sorted({1, max_bits}):  # close ones first: they settle most of a dense group
                    x, y = trie_links(turned, group, width, budget, label)
                    label = components(len(own), x, y, label)
                moved = np.flatnonzero(label != np.arange(len(own)))
                if len(moved):
                    yield pa.RecordBatch.from_arrays([pa.array(fp[own[moved]].view(np.int64)), pa.array(fp[own[label[moved]]].view(np.int64))], ["u", "v"])

    return dealt.mapInArrow(run, "u long, v long")


def first_rows(docs: DataFrame, order: tuple[str, ...], max_bits: int = MAX_BITS, shingle: int = SHINGLE) -> DataFrame:
    """The longs ``order`` of one row of each component of ``docs(doc_id, text, *order)``.

    It is the row of the least doc_id, null after all others, and of its rows the
    first by ``order``.  Minima are taken by fingerprint, then by component.
    """
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *order)
    reps = materialise(fingerprints(docs, shingle, order).groupBy("fp").agg(F.min(own).alias("first")))
    groups = connected(links(reps.select("fp"), max_bits))
    found = reps.join(groups, F.col("node") == F.col("fp"), "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first"))
    return found.select(*[F.col("first")[c].alias(c) for c in order])


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs(doc_id, text)``.

    component_id is the smallest doc_id that links reach, the row's own included.
    Null, empty and blank texts share fingerprint 0; repeated rows share a
    fingerprint; null doc_ids are never a component's id unless it has no other.
    An empty table gives no rows; extra columns are ignored.
    """
    marked = materialise(fingerprints(docs, shingle))
    reps = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    groups = connected(links(reps.select("fp"), max_bits))
    named = groups.join(reps, F.col("node") == F.col("fp")).select("fp", "root", "rep")
    least = named.groupBy("root").agg(F.min("rep").alias("least"))
    final = reps.join(named.join(least, "root").select("fp", "least"), "fp", "left").select("fp", F.coalesce("least", "rep").alias("component_id"))
    # cut here, so that the join has a shuffle on both sides and a hot fingerprint can be split
    return marked.join(materialise(final), "fp").select("doc_id", "fp", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op3_simhash_near_dedup": query}
ORACLES: dict[str, str] = {}
