"""Substring dedup by prefix-partitioned suffix trees.

The suffixes of all documents are split by prefixes of variable length: a
suffix's prefix reaches from its first word to the end of the gram of least
hash among its first 35 words, 10 to 35 words in all.  Suffixes with equal heads
of 35 words have equal prefixes, so each subtree can be built for itself.
Neighbouring suffixes whose prefixes end in the same gram travel together, as one
run of words:

* a gram that occurs once ends prefixes of leaves only and goes no further;
* runs that are equal as a whole are repeated, and one of them stands for all;
* the runs of all other prefixes are dealt into groups that fit a task's memory,
  where their words, not hashes of them, are sorted into a suffix tree: suffixes
  in order, with the number of words that neighbours share.  An internal node of
  35 words or more is a repeat, and the deepest one above a leaf the longest
  repeat that starts there.

A prefix with more runs than a group takes is spread over several; each builds
its part of the subtree and passes on one head for each node of 35 words, and
heads are counted over the parts.  Counts are aggregations, which Spark combines
before it shuffles, so hot prefixes with thousands of copies are never gathered
in one task.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, compress, count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeguard.llm.common import keep, only, table
from lakeguard.llm.kernels import SPACE_WORDS, Rolling, Words, mix, signed, slices, strings, window_runs

#: Words in a repeat, at least.
WINDOW = 35
#: Words in the gram that ends a prefix.
GRAM = 10
#: Runs in a group, about: some 60 words each, whose tree takes some 4 kB a run.
GROUP_RUNS = 4000
#: A run of windows is packed as start * _RUN + length - 1.
_RUN = 1 << 12
#: Texts that are unpacked at a time.
_ROWS = 256
#: Seeds of the hash of a run's words, and of the two of a head.
_EDGE, _HEAD = 5, (0, 77)


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with a key that is never null: the doc_id and a hash of the text, for doc_ids that repeat or are null."""
    none = F.col("doc_id").isNull()
    return only(docs, "doc_id", "text").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("d"), F.xxhash64(none, "text").alias("t"), "text", none.alias("nameless"))


def _packed(docs: DataFrame) -> DataFrame:
    """The keyed rows with their texts compressed, for the one shuffle that carries texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            raw, offsets = strings(batch.column(2))
            data = raw.tobytes()
            blobs = [pack(data[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(blobs, pa.binary())], ["d", "t", "nameless", "packed"])

    return _keyed(docs).mapInArrow(run, "d long, t long, nameless boolean, packed binary")


def _unpacked(column: pa.Array) -> list[bytes]:
    unpack = zstandard.ZstdDecompressor().decompress
    return [unpack(x) for x in column.to_pylist()]


def _runs(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(d, t, at, h, c): a run of windows, the hash of its gram, the digest of its edge."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = strings(batch.column(2))
            d, t = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for i, j in slices(offsets):
                words = Words(raw[offsets[i] : offsets[j]], offsets[i : j + 1], SPACE_WORDS)
                rolling, edge = Rolling(words), Rolling(words, _EDGE)
                lo, hi, anchor = window_runs(words, rolling, window, gram)
                if not len(lo):
                    continue
                doc = np.searchsorted(words.first, lo, "right") - 1
                h = rolling.span(anchor, anchor + gram)
                c = edge.span(lo, hi + window) ^ mix((anchor - lo).astype(np.uint64))
                at = (lo - words.first[doc]) * _RUN + (hi - lo)
                yield pa.RecordBatch.from_arrays([pa.array(d[i:j][doc]), pa.array(t[i:j][doc]), pa.array(at), pa.array(signed(h)), pa.array(signed(c))], ["d", "t", "at", "h", "c"])

    return _keyed(docs).select("d", "t", "text").mapInArrow(run, "d long, t long, at long, h long, c long")


_FRAGMENT = "h long, parts int, d long, t long, at long, single boolean, words binary"


def _fragments(listed: DataFrame, window: int) -> DataFrame:
    """The words of chosen runs, ``listed(d, t, packed, runs)``; single marks runs that occur once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            base = np.asarray(lists.offsets, np.int64)
            at, h, parts, single = (lists.values.field(c).to_numpy(zero_copy_only=False) for c in ("at", "h", "parts", "single"))
            for i in range(0, batch.num_rows, _ROWS):
                texts = _unpacked(batch.column(2).slice(i, _ROWS))
                j = i + len(texts)
                data = b"".join(texts)
                words = Words(np.frombuffer(data, np.uint8), np.concatenate(([0], np.cumsum(list(map(len, texts))))), SPACE_WORDS)
                mine = slice(base[i], base[j])
                doc = np.repeat(np.arange(j - i), np.diff(base[i : j + 1]))
                first = words.first[doc] + at[mine] // _RUN
                last = first + at[mine] % _RUN + window - 1
                cut = pa.array([data[s:e] for s, e in zip(words.starts[first].tolist(), words.ends[last].tolist(), strict=True)], pa.binary())
                of = pa.array(i + doc)
                yield pa.RecordBatch.from_arrays([pa.array(h[mine]), pa.array(parts[mine], pa.int32()), batch.column(0).take(of), batch.column(1).take(of), pa.array(at[mine]), pa.array(single[mine], pa.bool_()), cut], ["h", "parts", "d", "t", "at", "single", "words"])

    return listed.select("d", "t", "packed", "runs").mapInArrow(run, _FRAGMENT)


class SuffixTree:
    """The suffixes that start at the first words of some runs, as a suffix array with the depths of its nodes.

    Words are numbered by their bytes.  Suffixes are ranked by their first 1, 2,
    4, … words until a rank covers a run; no two runs' ends are equal, so
    no suffix reaches into the next run.
    """

    def __init__(self, runs: list[bytes], starts: np.ndarray) -> None:
        split = [r.split() for r in runs]
        numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
        sizes = np.fromiter(map(len, split), np.int64, len(split)) + 1
        ends = np.cumsum(sizes)
        n = int(sizes.sum())
        ids = np.empty(n, np.int64)
        inside = np.ones(n, bool)
        inside[ends - 1] = False
        ids[inside] = np.fromiter(map(numbers.__getitem__, chain.from_iterable(split)), np.int64, n - len(split))
        ids[ends - 1] = len(numbers) + np.arange(len(split))
        #: ranks[k] by the 2^k words from each place
        self.ranks = [ids]
        while 1 << len(self.ranks) - 1 < sizes.max(initial=0):
            last, half = self.ranks[-1], 1 << len(self.ranks) - 1
            then = np.full(n, -1, np.int64)
            then[:-half] = last[half:]
            self.ranks.append(np.unique(last * (n + 1) + then + 1, return_inverse=True)[1])
        #: run and number in it of each suffix
        self.run = np.repeat(np.arange(len(runs)), starts)
        self.place = np.arange(len(self.run)) - np.repeat(np.cumsum(starts) - starts, starts)
        at = (ends - sizes)[self.run] + self.place
        order = np.argsort(self.ranks[-1][at], kind="stable")
        self.run, self.place, self.at = self.run[order], self.place[order], at[order]
        #: words that each suffix in order shares with the one before
        self.shared = self._common(self.at[:-1], self.at[1:])

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        total = np.zeros(len(a), np.int64)
        n = len(self.ranks[0])
        for k in range(len(self.ranks) - 1, -1, -1):
            x, y = np.minimum(a + total, n - 1), np.minimum(b + total, n - 1)
            total += (self.ranks[k][x] == self.ranks[k][y]).astype(np.int64) << k
        return total

    def depths(self) -> np.ndarray:
        """Words of the deepest internal node above each leaf: the longest repeat that starts there."""
        edge = np.zeros(1, np.int64)
        return np.maximum(np.concatenate((edge, self.shared)), np.concatenate((self.shared, edge)))[: len(self.run)]

    def nodes(self, depth: int) -> np.ndarray:
        """The number of the subtree below ``depth`` words that each leaf belongs to."""
        return np.concatenate(([0], np.cumsum(self.shared < depth)))[: len(self.run)]


_FOUND = "d long, t long, at long, w1 long, w2 long, leaves long"


def _subtrees(fragments: DataFrame, groups: int, window: int) -> DataFrame:
    """Repeats that start in runs which occur once, and, without w1 being null, the heads of nodes of spread prefixes."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        d, t, at, single = (rows[c].to_numpy() for c in ("d", "t", "at", "single"))
        runs = rows["words"].to_pylist()
        tree = SuffixTree(runs, at % _RUN + 1)
        found = np.flatnonzero((tree.depths() >= window) & single[tree.run])
        of, start = tree.run[found], at[tree.run[found]] // _RUN + tree.place[found]
        out = [(d[of], t[of], start * _RUN, None, None, np.zeros(len(of), np.int64))]
        if key[1].as_py() >= 0:
            node = tree.nodes(window)
            first = np.flatnonzero(np.diff(node, prepend=-1))
            leaves = np.diff(np.append(first, len(node)))
            raw = b" ".join(runs)
            words = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), SPACE_WORDS)
            # the tree counts the end of each run as a word
            s = tree.at[first] - tree.run[first]
            w1, w2 = (signed(Rolling(words, seed).span(s, s + window)) for seed in _HEAD)
            of = tree.run[first]
            # a head that only a single run has may still be repeated elsewhere
            alone = (leaves == 1) & single[of]
            out.append((d[of], t[of], np.where(alone, (at[of] // _RUN + tree.place[first]) * _RUN, -1), w1, w2, leaves))
        none = np.zeros(0, np.int64)
        columns = {}
        for i, c in enumerate(("d", "t", "at", "w1", "w2", "leaves")):
            parts = [pa.nulls(len(x[0]), pa.int64()) if x[i] is None else pa.array(x[i], pa.int64()) for x in out]
            columns[c] = pa.chunked_array(parts or [pa.array(none)])
        return pa.table(columns)

    spread = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("d", "t", "at"), F.col("parts")).cast("int")).otherwise(-1)
    group = F.when(F.col("parts") > 1, F.col("h")).otherwise(F.pmod(F.xxhash64("h"), F.lit(groups)))
    return fragments.select(group.alias("g"), spread.alias("part"), "d", "t", "at", "single", "words").groupBy("g", "part").applyInArrow(run, _FOUND)


def repeats(docs: DataFrame, packed: DataFrame, window: int = WINDOW, gram: int = GRAM, group_runs: int = GROUP_RUNS) -> DataFrame:
    """Ranges of repeated windows: rows (d, t, at), at = start * 4096 + further starts.

    d and t name the row: its doc_id (0 for null) and a hash of its text;
    ``packed`` has the texts by these.
    """
    runs = _runs(docs, window, gram)
    # kept, so that the join below has a shuffle on both sides and a hot gram's runs can be split
    nodes = runs.groupBy("h").agg(F.count("*").alias("n"), F.min("c").alias("c0"), F.max("c").alias("c1")).filter("n > 1").select("h", (F.col("c0") != F.col("c1")).alias("mixed"))
    nodes = keep(nodes, "nodes")
    shared = keep(runs.join(nodes, "h"), "runs")
    edges = keep(shared.groupBy("h", "c", "mixed").agg(F.count("*").alias("n"), F.min(F.struct("d", "t", "at")).alias("rep")), "edges")
    whole = shared.join(edges.filter("n > 1").select("h", "c"), ["h", "c"]).select("d", "t", "at")
    mixed = edges.filter("mixed").select("h", "rep", (F.col("n") == 1).alias("single"))
    groups = max(1, -(-mixed.count() // group_runs))
    # prefixes with more runs than a group takes
    hot = keep(mixed.groupBy("h").count().filter(F.col("count") > group_runs).select("h", F.ceil(F.col("count") / group_runs).cast("int").alias("parts")), "hot")
    chosen = mixed.join(hot, "h", "left").groupBy("rep.d", "rep.t").agg(F.collect_set(F.struct(F.col("rep.at").alias("at"), "h", F.coalesce("parts", F.lit(1)).alias("parts"), "single")).alias("runs"))
    found = keep(_subtrees(_fragments(packed.join(chosen, ["d", "t"]), window), groups, window), "found")
    below = found.filter("w1 IS NULL").select("d", "t", "at")
    heads = found.filter("w1 IS NOT NULL")
    across = heads.groupBy("w1", "w2").agg(F.sum("leaves").alias("n")).filter("n > 1").select("w1", "w2")
    spread = heads.filter("at >= 0").join(across, ["w1", "w2"]).select("d", "t", "at")
    return whole.unionAll(below).unionAll(spread)


def _cut(ranges: np.ndarray, n: int, window: int) -> np.ndarray:
    """Which of n words the windows that start in the packed ranges cover."""
    edge = np.zeros(n + 1, np.int64)
    lo = ranges // _RUN
    np.add.at(edge, lo, 1)
    np.add.at(edge, np.minimum(lo + ranges % _RUN + window, n), -1)
    return np.cumsum(edge[:-1]) > 0


def dedup_substrings(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, group_runs: int = GROUP_RUNS) -> DataFrame:
    """Every row of ``docs(doc_id, text)`` without the words in repeats of ``window`` or more words.

    Columns: doc_id, n_words, n_removed, kept (the words left, joined by one
    space) and spans (array of [first word, end) of the maximal repeats).  Words
    are what ASCII white space separates; a window counts as repeated if its
    words start a window anywhere else, in the same document or another row,
    identical rows included.  Null and empty texts have no words; texts of fewer
    words than a window lose none; an empty table gives no rows; extra columns
    are ignored.
    """
    packed = _packed(docs)
    # equal rows of one doc_id find the same ranges, which are listed once
    lists = repeats(docs, packed, window, gram, group_runs).groupBy("d", "t").agg(F.collect_set("at").alias("ranges"))
    joined = packed.join(lists, ["d", "t"], "left").select(F.when(~F.col("nameless"), F.col("d")).alias("doc_id"), "packed", "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            for blob, found in zip(batch.column(1), batch.column(2), strict=True):
                words = unpack(blob.as_py()).split()
                rows[0].append(len(words))
                if found.values is None or not words:
                    rows[1].append(0)
                    rows[2].append(b" ".join(words).decode())
                    rows[3].append([])
                    continue
                gone = _cut(found.values.to_numpy(zero_copy_only=False), len(words), window)
                flips = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
                rows[1].append(int(gone.sum()))
                rows[2].append(b" ".join(compress(words, (~gone).tolist())).decode())
                rows[3].append(flips.reshape(-1, 2).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.string()), pa.array(rows[3], pa.list_(pa.list_(pa.int64())))], ["doc_id", "n_words", "n_removed", "kept", "spans"])

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string, spans array<array<long>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_substrings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple], window: int = WINDOW) -> list[tuple]:
    """The same result by counting every window's words; for tests."""
    split = [(k, (text or "").encode().split()) for k, text in rows]
    seen: dict[tuple, int] = {}
    for _, w in split:
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            seen[key] = seen.get(key, 0) + 1
    out = []
    for k, w in split:
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if seen[tuple(w[s : s + window])] > 1:
                gone[s : s + window] = [True] * window
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((k, len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


ORACLE = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, unnest(range(1, greatest(len(ws) - 33, 1))) AS i FROM w),
k AS (SELECT s.doc_id, s.i, md5(array_to_string(ws[s.i : s.i + 34], ' ')) AS h FROM s JOIN w USING (doc_id)),
r AS (SELECT doc_id, i FROM k WHERE h IN (SELECT h FROM k GROUP BY h HAVING count(*) > 1)),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM r),
g AS (SELECT doc_id, list(p) AS gone FROM c GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(coalesce(gone, [])) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN ws ELSE list_transform(list_filter(range(1, len(ws) + 1), lambda p: NOT list_contains(gone, p)), lambda p: ws[p]) END, ' ')) AS kept_sha256
FROM w LEFT JOIN g ON g.doc_id = w.doc_id
"""

QUERIES = {"op10_substring_dedup": query}
ORACLES = {"op10_substring_dedup": ORACLE}
