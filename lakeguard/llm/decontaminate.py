"""Benchmark decontamination by winnowing.

Every window of ten words keeps the hash of its least 5-gram, so any span of ten
or more shared words has a fingerprint in common on both sides.  Test
fingerprints are joined to the training fingerprints; hits are extended to their
windows, and windows are compared by 128 bits, two hashes that are independent
from the words' bytes up.

The benchmark becomes one table of windows, which both plans use, so they give
the same rows.  If it is small, which is measured first, it is sent to every
task as sorted arrays.  A larger one is joined by shuffles: fingerprints first,
then the windows of the documents that were hit.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeguard.llm.common import only, table
from lakeguard.llm.kernels import ALNUM_WORDS, Rolling, Words, mix, signed, slices, strings, window_runs

#: Words in a window.
WINDOW = 10
#: Words in a gram: a window of ten words has six.
GRAM = 5
#: Most bytes of benchmark text that are broadcast; its windows take some seven times as much in a worker.
BROADCAST_BYTES = 8 << 20
#: Seed of a window's second hash.
_SECOND = 77
#: A run is packed as (start * _RUN + length - 1) * _SIZE + words in a window.
_RUN, _SIZE = 1 << 8, 1 << 6

_NONE = np.zeros(0, np.int64)


def _spans(words: Words, rolling: Rolling, size: int, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lo, hi, fingerprint) of the runs of windows of ``size`` words.

    Windows shorter than the full one, which short items need, are their own fingerprints.
    """
    if size == window:
        lo, hi, anchor = window_runs(words, rolling, window, gram)
        return lo, hi, rolling.span(anchor, anchor + gram)
    if len(words) < size:
        return _NONE, _NONE, np.zeros(0, np.uint64)
    start = np.arange(len(words) - size + 1)
    end = np.repeat(words.first[1:], np.diff(words.first))[: len(start)]
    start = start[start + size <= end]
    return start, start, mix(rolling.span(start, start + size) + np.uint64(size))


_KNOWN = "f long, size int, w1 long, w2 long, item_id long"


def item_windows(items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(f, size, w1, w2, item_id): the windows of ``items(item_id, text)`` with their fingerprints and 128 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = strings(batch.column(1))
            for i in range(batch.num_rows):
                words = Words(raw[offsets[i] : offsets[i + 1]], offsets[i : i + 2], ALNUM_WORDS, lower=True)
                size = min(window, len(words))
                if not size:
                    continue
                one, two = Rolling(words), Rolling(words, _SECOND)
                lo, hi, prints = _spans(words, one, size, window, gram)
                s, f = np.arange(len(words) - size + 1), np.repeat(prints, hi - lo + 1)
                item = batch.column(0).take(pa.array(np.full(len(s), i)))
                yield pa.RecordBatch.from_arrays([pa.array(signed(f)), pa.array(np.full(len(s), size, np.int32)), pa.array(signed(one.span(s, s + size))), pa.array(signed(two.span(s, s + size))), item], ["f", "size", "w1", "w2", "item_id"])

    return items.mapInArrow(run, _KNOWN)


class _Windows:
    """A small benchmark's windows as sorted arrays."""

    def __init__(self, known: pa.Table) -> None:
        size = known["size"].to_numpy()
        f, w1, w2 = (known[c].to_numpy().view(np.uint64) for c in ("f", "w1", "w2"))
        self.prints = {int(k): np.unique(f[size == k]) for k in np.unique(size)}
        order = np.lexsort((w2, w1, size))
        self.size, self.w1, self.w2 = size[order], w1[order], w2[order]
        #: of the window in each place: its item, null as None
        self.item = known["item_id"].take(pa.array(order)).to_pylist()
        self.range = {int(k): (int(np.searchsorted(self.size, k, "left")), int(np.searchsorted(self.size, k, "right"))) for k in np.unique(size)}

    def hits(self, words: Words, window: int, gram: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(size, starts, places of known windows) of the windows in ``words`` that items have; a start comes once for each item."""
        one, two = Rolling(words), None
        for size, (low, high) in self.range.items():
            lo, hi, prints = _spans(words, one, size, window, gram)
            known = _among(prints, self.prints[size])
            lo, k = lo[known], hi[known] - lo[known] + 1
            s = np.repeat(lo - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
            if not len(s):
                continue
            w1 = one.span(s, s + size)
            left, right = (low + np.searchsorted(self.w1[low:high], w1, side) for side in ("left", "right"))
            k = right - left
            s, place = np.repeat(s, k), np.repeat(left - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
            two = two or Rolling(words, _SECOND)
            same = self.w2[place] == two.span(s, s + size)
            yield size, s[same], place[same]


def _among(x: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)
    return sorted_[at] == x


_RESULT = "doc_id long, n_words long, n_hit long, items array<long>, spans array<array<long>>"


def _merged(starts: np.ndarray, sizes: np.ndarray, n: int) -> tuple[int, list[list[int]]]:
    """Words covered, and the spans that they form."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + sizes, -1)
    hit = np.cumsum(edge[:-1]) > 0
    flips = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    return int(hit.sum()), flips.reshape(-1, 2).tolist()


def _batch(ids: list, n_words: np.ndarray, n_hit: np.ndarray, items: list[list[int]], spans: list[list[list[int]]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n_words), pa.array(n_hit), pa.array(items, pa.list_(pa.int64())), pa.array(spans, pa.list_(pa.list_(pa.int64())))], ["doc_id", "n_words", "n_hit", "items", "spans"])


#: The windows that a Python worker has made of a broadcast, kept from task to task.
_made: dict[str, _Windows] = {}


def _ordered(items: set) -> list:
    """Ids in order, null last."""
    return sorted(items, key=lambda x: (x is None, x or 0))


def _small(docs: DataFrame, known: pa.Table, window: int, gram: int) -> DataFrame:
    sent, name = docs.sparkSession.sparkContext.broadcast(known), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _made:
            _made.clear()
            _made[name] = _Windows(sent.value)
        own = _made[name]
        for batch in batches:
            ids = batch.column(0).to_pylist()
            raw, offsets = strings(batch.column(1))
            for i, j in slices(offsets):
                words = Words(raw[offsets[i] : offsets[j]], offsets[i : j + 1], ALNUM_WORDS, lower=True)
                found: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
                for size, s, place in own.hits(words, window, gram):
                    doc = np.searchsorted(words.first, s, "right") - 1
                    for d in np.unique(doc).tolist():
                        mine = doc == d
                        found.setdefault(d, []).append((s[mine] - words.first[d], np.full(int(mine.sum()), size), place[mine]))
                n_words, n_hit = np.diff(words.first), np.zeros(j - i, np.int64)
                items, spans = [[] for _ in range(j - i)], [[] for _ in range(j - i)]
                for d, parts in found.items():
                    starts, sizes, places = (np.concatenate(x) for x in zip(*parts, strict=True))
                    n_hit[d], spans[d] = _merged(starts, sizes, int(n_words[d]))
                    items[d] = _ordered({own.item[p] for p in np.unique(places).tolist()})
                yield _batch(ids[i:j], n_words, n_hit, items, spans)

    return docs.mapInArrow(run, _RESULT)


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with keys that are never null: two hashes of doc_id and text."""
    named = ["doc_id", F.col("doc_id").isNull(), "text", F.col("text").isNull()]
    return docs.select(F.xxhash64(*named).alias("d"), F.xxhash64(F.lit(1), *named).alias("t"), "doc_id", "text")


def _large(docs: DataFrame, items: DataFrame, window: int, gram: int) -> DataFrame:
    known = item_windows(items, window, gram)
    sizes = sorted(r[0] for r in known.select("size").distinct().collect())  # at most ``window`` numbers

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = strings(batch.column(2))
            d, t = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for i, j in slices(offsets):
                words = Words(raw[offsets[i] : offsets[j]], offsets[i : j + 1], ALNUM_WORDS, lower=True)
                rolling = Rolling(words)
                for size in sizes:
                    lo, hi, f = _spans(words, rolling, size, window, gram)
                    doc = np.searchsorted(words.first, lo, "right") - 1
                    at = ((lo - words.first[doc]) * _RUN + hi - lo) * _SIZE + size
                    yield pa.RecordBatch.from_arrays([pa.array(signed(f)), pa.array(d[i:j][doc]), pa.array(t[i:j][doc]), pa.array(at)], ["f", "d", "t", "at"])

    keyed = _keyed(docs)
    texts = keyed.select("d", "t", "text")
    chosen = texts.mapInArrow(runs, "f long, d long, t long, at long").join(known.select("f").distinct(), "f", "left_semi").groupBy("d", "t").agg(F.collect_set("at").alias("runs"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = strings(batch.column(2))
            d, t = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for i, packed in enumerate(batch.column(3)):
                words = Words(raw[offsets[i] : offsets[i + 1]], offsets[i : i + 2], ALNUM_WORDS, lower=True)
                at = packed.values.to_numpy(zero_copy_only=False)
                size, at = at % _SIZE, at // _SIZE
                lo, k = at // _RUN, at % _RUN + 1
                s, size = np.repeat(lo - (np.cumsum(k) - k), k) + np.arange(int(k.sum())), np.repeat(size, k)
                one, two = Rolling(words), Rolling(words, _SECOND)
                yield pa.RecordBatch.from_arrays([pa.array(signed(one.span(s, s + size))), pa.array(signed(two.span(s, s + size))), pa.array(np.full(len(s), d[i])), pa.array(np.full(len(s), t[i])), pa.array(s * _SIZE + size)], ["w1", "w2", "d", "t", "place"])

    opened = texts.join(chosen, ["d", "t"]).mapInArrow(windows, "w1 long, w2 long, d long, t long, place long")
    hits = opened.join(known.select("w1", "w2", "item_id").distinct(), ["w1", "w2"]).groupBy("d", "t").agg(F.transform(F.array_sort(F.collect_set(F.struct(F.col("item_id").isNull().alias("none"), "item_id"))), lambda x: x["item_id"]).alias("items"), F.collect_set("place").alias("places"))

    def result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            raw, offsets = strings(batch.column(1))
            n_words, n_hit = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            spans: list[list[list[int]]] = [[] for _ in ids]
            for i, j in slices(offsets):
                n_words[i:j] = np.diff(Words(raw[offsets[i] : offsets[j]], offsets[i : j + 1], ALNUM_WORDS, lower=True).first)
            for i, places in enumerate(batch.column(3)):
                if places.values is not None:
                    at = places.values.to_numpy(zero_copy_only=False)
                    n_hit[i], spans[i] = _merged(at // _SIZE, at % _SIZE, int(n_words[i]))
            yield _batch(ids, n_words, n_hit, [x or [] for x in batch.column(2).to_pylist()], spans)

    return keyed.join(hits, ["d", "t"], "left").select("doc_id", "text", "items", "places").mapInArrow(result, _RESULT)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hits of ``items(item_id, text)`` in every row of ``docs(doc_id, text)``.

    Columns: doc_id, n_words, n_hit (words inside a shared window), items (ids
    of the items with windows in the document, sorted) and spans (array of
    [first word, end)).  Words are runs of ASCII digits, letters and anything
    beyond ASCII, in lower case; an item of fewer than ``window`` words is one
    window; items without an id count as one, which comes last.  Null and empty
    texts have no words, and items of none hit nothing; an empty benchmark gives
    zeros; an empty table gives no rows; repeated rows stay; extra columns are
    ignored.
    """
    docs = only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    items = only(items, "item_id", "text").withColumn("item_id", F.col("item_id").cast("long")).filter("text IS NOT NULL")
    size, rows = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    if size + 64 * rows <= broadcast_bytes:
        return _small(docs, item_windows(items, window, gram).toArrow(), window, gram)
    return _large(docs, items, window, gram)


def _names(items: Column) -> Column:
    """Ids as strings, sorted as strings, joined by commas."""
    return F.array_join(F.array_sort(F.transform(items, lambda x: x.cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(_names(F.col("items")), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def brute_force(docs: list[tuple], items: list[tuple], window: int = WINDOW) -> list[tuple]:
    """The query's rows, window by window; for tests."""
    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    lower = {c: c + 32 for c in range(65, 91)}

    def split(text: str | None) -> list[str]:
        return pattern.findall((text or "").translate(lower))

    of: dict[tuple, set] = {}
    for item, text in items:
        w = split(text)
        size = min(window, len(w))
        for s in range(len(w) - size + 1 if size else 0):
            of.setdefault(tuple(w[s : s + size]), set()).add(item)
    sizes = {len(k) for k in of}
    out = []
    for doc, text in docs:
        w = split(text)
        hit, found = set(), set()
        for size in sizes:
            for s in range(len(w) - size + 1):
                if got := of.get(tuple(w[s : s + size])):
                    hit.update(range(s, s + size))
                    found |= got
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(str(x) for x in found if x is not None)).encode()).hexdigest(), bool(hit)))
    return out


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(ws[s : s + n - 1], ' ') AS k
       FROM (SELECT item_id, ws, least(10, len(ws)) AS n, unnest(range(1, greatest(len(ws) - least(10, len(ws)) + 2, 1))) AS s FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, s, array_to_string(ws[s : s + n - 1], ' ') AS k
       FROM (SELECT doc_id, ws, n, unnest(range(1, greatest(len(ws) - n + 2, 1))) AS s FROM d CROSS JOIN sizes)),
hits AS (SELECT doc_id, dw.n, s, item_id FROM dw JOIN bw USING (k)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON words.doc_id = d.doc_id LEFT JOIN found ON found.doc_id = d.doc_id
"""

QUERIES = {"op1_decontaminate": query}
ORACLES = {"op1_decontaminate": ORACLE}
