"""Stupid-backoff language model scores, computed relationally.

The model is the corpus' own counts of 1- to 3-grams.  Documents are dealt into
blocks by hash.  A block explodes its texts into n-grams and sends each distinct
one with its number to the partition of the count table that its hash belongs
to; the count table adds the numbers of all blocks up and is joined back to the
blocks' n-grams, which look up their totals and sum the scores per document.
N-grams travel as sorted 64-bit hashes, packed by the thousand: rows of
(block, partition, hashes, counts) instead of a row for each n-gram.  A block
sends every n-gram once, however often it has it, so frequent ones put no more
on a partition than the number of blocks.

A document's own n-grams are taken off the counts before it is scored, so that
it is measured by the rest of the corpus and the backoff has work to do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeguard.llm.common import only, partitions, table
from lakeguard.llm.kernels import SPACE_WORDS, Rolling, Words, mix, strings

ORDER = 3
BACKOFF = 0.4
#: Bytes of text in a block, and distinct n-grams in a partition of the count table, about.
BLOCK_BYTES = 8 << 20
TABLE_GRAMS = 2_000_000

_U = np.uint64


def pack(hashes: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted hashes as differences and counts, both by byte planes, compressed."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    steps = np.diff(hashes, prepend=_U(0)).astype("<u8")
    return squeeze(_planes(steps)), squeeze(_planes(counts.astype("<u8")))


def _planes(x: np.ndarray) -> bytes:
    """Numbers of eight bytes, all first bytes before all second ones and so on."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack_counts(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view("<i8").ravel()


def unpack_hashes(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).view("<u8").ravel(), dtype=_U)


class Grams:
    """The n-grams of some texts: per order the hash at each word that ends one, and the word's document."""

    def __init__(self, texts: list[bytes], order: int) -> None:
        offsets = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))))
        words = Words(np.frombuffer(b"".join(texts), np.uint8), offsets, SPACE_WORDS, lower=True)
        rolling = Rolling(words)
        self.n_words = np.diff(words.first)
        self.doc = words.document()
        place = np.arange(len(words)) - words.first[self.doc]
        #: (places, hashes) by order
        self.by_order: list[tuple[np.ndarray, np.ndarray]] = []
        for n in range(1, order + 1):
            at = np.flatnonzero(place >= n - 1)
            self.by_order.append((at, mix(rolling.span(at - n + 1, at + 1) + _U(n))))

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        every = np.concatenate([h for _, h in self.by_order])
        return np.unique(every, return_counts=True)


def scores(grams: Grams, hashes: np.ndarray, totals: np.ndarray, words: int, backoff: float = BACKOFF) -> tuple[np.ndarray, np.ndarray]:
    """Per document: the sum of log10 of its words' scores, and how many words the highest order knew.

    totals: corpus counts of the sorted ``hashes``; words: words of the corpus.
    """
    n_docs = len(grams.n_words)
    n = len(grams.doc)
    counts: list[np.ndarray] = []
    for at, h in grams.by_order:
        index = np.searchsorted(hashes, h)
        key = grams.doc[at] * max(1, len(hashes)) + index
        _, back, own = np.unique(key, return_inverse=True, return_counts=True)
        left = np.zeros(n)
        left[at] = totals[index] - own[back]
        counts.append(left)
    rest = np.maximum(words - grams.n_words[grams.doc], 1)
    order = len(counts)
    # a word that the rest of the corpus lacks counts as half an occurrence
    score = np.maximum(counts[0], 0.5) / rest
    known = np.zeros(n, bool)
    for k in range(1, order):
        context = np.zeros(n)
        context[1:] = counts[k - 1][:-1]
        known = (counts[k] > 0) & (context > 0)
        score = np.where(known, counts[k] / np.maximum(context, 1), backoff * score)
    return np.bincount(grams.doc, np.log10(score), n_docs), np.bincount(grams.doc, known, n_docs)


def stupid_backoff(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, block_bytes: int = BLOCK_BYTES, table_grams: int = TABLE_GRAMS) -> DataFrame:
    """Scores of every row of ``docs(doc_id, text)`` by the counts of all other rows.

    Columns: doc_id, n_words, log_score (sum of log10 over words), mean_log_score
    (null without words) and n_known (words whose n-gram of the highest order
    occurs elsewhere).  Words are what ASCII white space separates, A-Z in lower
    case.  Null and empty texts have no words and score 0; a row that repeats
    counts as elsewhere; an empty table gives no rows; extra columns are ignored.
    """
    spark = docs.sparkSession
    docs = only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    size, words = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.coalesce(F.sum(F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+"))), F.lit(0))).first()
    n_blocks = max(1, -(-size // block_bytes))
    bits = max(0, int(-(-words * order // table_grams) - 1).bit_length())
    n = partitions(spark)

    def shut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            raw, offsets = strings(batch.column(2))
            data = raw.tobytes()
            blobs = [squeeze(data[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(blobs, pa.binary())], ["block", "doc_id", "packed"])

    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).cast("int").alias("block")
    packed = docs.select(block, "doc_id", "text").mapInArrow(shut, "block int, doc_id long, packed binary")

    def texts(column: pa.ChunkedArray) -> list[bytes]:
        unzip = zstandard.ZstdDecompressor().decompress
        return [unzip(x) for x in column.to_pylist()]

    def explode(key: tuple, rows: pa.Table) -> pa.Table:
        hashes, counts = Grams(texts(rows["packed"]), order).distinct()
        part = (hashes >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)
        first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else np.zeros(0, np.int64)
        blobs = [pack(hashes[s:e], counts[s:e]) for s, e in zip(first.tolist(), [*first[1:].tolist(), len(part)], strict=False)]
        return pa.table({"block": pa.array([key[0].as_py()] * len(blobs), pa.int32()), "part": pa.array(part[first], pa.int32()), "hashes": pa.array([b[0] for b in blobs], pa.binary()), "counts": pa.array([b[1] for b in blobs], pa.binary())})

    grams = packed.groupBy("block").applyInArrow(explode, "block int, part int, hashes binary, counts binary")

    def add_up(key: tuple, rows: pa.Table) -> pa.Table:
        listed = [unpack_hashes(x) for x in rows["hashes"].to_pylist()]
        counts = np.concatenate([unpack_counts(x) for x in rows["counts"].to_pylist()])
        _, back = np.unique(np.concatenate(listed), return_inverse=True)
        totals = np.bincount(back, counts).astype(np.int64)[back]
        ends = np.cumsum([len(x) for x in listed])
        squeeze = zstandard.ZstdCompressor(level=1).compress
        blobs = [squeeze(_planes(x)) for x in np.split(totals, ends[:-1])]
        return pa.table({"block": rows["block"], "part": rows["part"], "totals": pa.array(blobs, pa.binary())})

    totals = grams.repartition(max(n, min(1 << bits, 4 * n)), "part").groupBy("part").applyInArrow(add_up, "block int, part int, totals binary")

    def look_up(key: tuple, rows: pa.Table, found: pa.Table) -> pa.Table:
        own = Grams(texts(rows["packed"]), order)
        hashes, _ = own.distinct()
        parts = sorted(zip(found["part"].to_pylist(), found["totals"].to_pylist(), strict=True))
        counts = np.concatenate([unpack_counts(x) for _, x in parts]) if parts else np.zeros(0, np.int64)
        logs, known = scores(own, hashes, counts, words, backoff)
        return pa.table({"doc_id": rows["doc_id"], "n_words": pa.array(own.n_words), "log_score": pa.array(logs), "n_known": pa.array(known.astype(np.int64))})

    scored = packed.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(look_up, "doc_id long, n_words long, log_score double, n_known long")
    return scored.select("doc_id", "n_words", "log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")).alias("mean_log_score"), "n_known")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stupid_backoff(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", F.round("log_score", 6).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"), "n_known")


def brute_force(rows: list[tuple], order: int = ORDER, backoff: float = BACKOFF) -> list[tuple]:
    """The query's rows by dictionaries; for tests."""
    import math
    from collections import Counter

    split = [(k, (t or "").encode().lower().split()) for k, t in rows]

    def grams(w: list[bytes]) -> Counter:
        return Counter(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1))

    every: Counter = Counter()
    for _, w in split:
        every.update(grams(w))
    total = sum(len(w) for _, w in split)
    out = []
    for k, w in split:
        own = grams(w)
        logs, known = 0.0, 0
        for i in range(len(w)):
            rest = max(total - len(w), 1)
            s = max(every[(w[i],)] - own[(w[i],)], 0.5) / rest
            hit = False
            for n in range(2, order + 1):
                g = tuple(w[i - n + 1 : i + 1]) if i >= n - 1 else None
                c = every[g] - own[g] if g else 0
                b = every[g[:-1]] - own[g[:-1]] if g else 0
                hit = c > 0 and b > 0
                s = c / b if hit else backoff * s
            logs += math.log10(s)
            known += hit
        out.append((k, len(w), round(logs, 6), round(logs / len(w), 6) if w else None, known))
    return out


QUERIES = {"op5_stupid_backoff": query}
ORACLES: dict[str, str] = {}
