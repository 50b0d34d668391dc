"""Suffix-array dedup by a distributed merge sort that knows common prefixes.

Documents travel in blocks.  Of the suffixes in a block those are sampled that
start at an anchor: every window of 50 bytes chooses the 16 bytes of least hash in
it, so equal windows choose the same place, and neighbouring windows with one
anchor are one sample.  Three exchanges follow, each between blocks and ranges of
hashes:

1. Blocks send the sorted hashes of their anchors, each with a hash of the sample
   and its least doc_id.  A sample that a smaller document has as well is covered
   as a whole; of equal ones only that of the least document goes on, and only if
   unequal samples have its anchor.  Two bits come back for each.
2. The suffixes left are sorted in their block: a sorted run of suffixes, each
   sent as the length of the prefix it shares with the one before and the bytes
   that differ.  The runs of all blocks are merged by a loser tree that keeps
   for every run's head the prefix it shares with the last suffix put out and
   compares only what comes after it.  The result is the suffix array of a range with
   its common prefixes: windows whose bytes from the anchor on are equal are
   neighbours in it, and equal windows are those whose bytes before it agree
   as well.  The least doc_id among equal windows decides.
3. What is covered comes back to the block, which cuts its texts.

Equal samples of a block are sent once, with their least doc_id, so copies meet
combined.  An anchor with very many unequal samples (a common line with ever
different neighbours) is dealt by its single windows instead of the anchor.  Blocks, ranges
and tasks are bounded by bytes and counts, nothing is gathered by document or by
passage.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeguard.llm.common import keep, only, partitions, table
from lakeguard.llm.kernels import mix, signed, slices, strings, window_minima

#: Bytes in a repeat, at least, and bytes that choose an anchor.
WINDOW = 50
GRAM = 16
#: Bytes of text in a block (or one document), anchors in a range of the first exchange, suffixes in one of the second.
BLOCK_BYTES = 6 << 20
RANGE_ANCHORS = 2_000_000
RANGE_SUFFIXES = 200_000
#: Anchors of so many unequal samples are dealt by windows.
HOT = 200_000
#: Bytes of text whose places are hashed at a time, and suffixes.
_SLICE, _TEXTS = 1 << 16, 1 << 14
#: Bits of an anchor's hash in the first exchange, and bytes of a sample's.
_BITS = 46
_BYTES = 6
#: What the first exchange says of a sample: it goes on, by its anchor or by its windows, or a smaller document has it.
_ON, _OFTEN, _COVERED = 1, 2, 3
#: What stands for a null doc_id: it comes after all others.
_LAST = 2**63 - 1

_U = np.uint64
#: The least numbers of 2 … 8 bytes.
_POWERS = np.array([1 << 8 * k for k in range(1, 8)], _U)
_ODD, _MORE = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)


#: Made once, as many of a task's blobs are small.
_ZIP, _UNZIP = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _zip(raw: bytes) -> bytes:
    return _ZIP.compress(raw)


def _unzip(blob: bytes) -> bytes:
    return _UNZIP.decompress(blob)


def _places(x: np.ndarray) -> bytes:
    """An array's bytes by their places in a number."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _numbers(raw: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def _pack(x: np.ndarray) -> bytes:
    return _zip(_places(x))


def _unpack(blob: bytes, kind: type) -> np.ndarray:
    return _numbers(_unzip(blob), kind)


def _eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number; there are none beyond the end."""
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    return np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))


def _gram(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Hashes of 16 bytes, given as two numbers."""
    y = high * _ODD
    y ^= y >> _U(32)
    y *= _MORE
    y ^= y >> _U(29)
    y ^= low
    return mix(y)


def grams(raw: np.ndarray) -> np.ndarray:
    """Hashes of the 16 bytes from each place on."""
    n = len(raw) - GRAM + 1
    if n <= 0:
        return np.zeros(0, _U)
    eight = _eights(raw)
    return _gram(eight[:n], eight[8 : 8 + n])


def _digest(hashes: np.ndarray, start: np.ndarray, end: np.ndarray, at: np.ndarray, longest: int) -> np.ndarray:
    """Hash of the bytes start … end - 1 and of the anchor's place in them."""
    out = mix((end - start).astype(_U) * _ODD + (at - start).astype(_U))
    for o in range(0, longest, GRAM):
        out = mix(out * _ODD + hashes[np.minimum(start + o, end - GRAM)])
    return out


def _digest_at(eight: np.ndarray, start: np.ndarray, end: np.ndarray, at: np.ndarray, longest: int) -> np.ndarray:
    """The same of few places, without the hashes of all."""
    out = mix((end - start).astype(_U) * _ODD + (at - start).astype(_U))
    for o in range(0, longest, GRAM):
        place = np.minimum(start + o, end - GRAM)
        out = mix(out * _ODD + _gram(eight[place], eight[place + 8]))
    return out


class Samples:
    """The anchors of a block's texts: where they are, the windows that chose them, and hashes."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, window: int) -> None:
        self.window, self.raw = window, raw
        self._eight: np.ndarray | None = None
        found: list[list[np.ndarray]] = [[], [], [], [], []]
        for i, j in slices(offsets, _SLICE):
            base, first = offsets[i], offsets[i : j + 1] - offsets[i]
            hashes = grams(raw[base : offsets[j]])
            if len(hashes) < window - GRAM + 1:
                continue
            least = window_minima(hashes, window - GRAM + 1)
            end = np.repeat(first[1:], np.diff(first))[: len(least)]
            valid = np.flatnonzero(np.arange(len(least)) + window <= end)
            if not len(valid):
                continue
            anchor = least[valid]
            breaks = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1] + 1))))
            lo, hi, at = valid[breaks], valid[np.append(breaks[1:], len(valid)) - 1], anchor[breaks]
            context = _digest(hashes, lo, hi + window, at, 2 * window - GRAM)
            for held, x in zip(found, (lo + base, hi + base, at + base, mix(hashes[at] ^ _MORE), context), strict=True):
                held.append(x)
        none = np.zeros(0, np.int64)
        #: windows lo … hi chose the anchor at; h and c are hashes of the anchor (mixed anew: the least of many are no even ones) and of all its windows' bytes
        self.lo, self.hi, self.at = (np.concatenate((none, *x)) for x in found[:3])
        self.h, self.c = (np.concatenate((none.view(_U), *x)) for x in found[3:])
        self.doc = np.searchsorted(offsets, self.at, "right") - 1

    def distinct(self, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(order of the samples by their anchors' hashes, where in it each distinct sample begins, its anchor's hash, its least document)."""
        rest = _U(64 - _BITS)
        key = self.h >> rest
        order = np.argsort(key << rest | self.c >> _U(_BITS), kind="stable")
        key, c = key[order], self.c[order]
        begins = np.flatnonzero(np.concatenate((np.ones(min(len(c), 1), bool), (c[1:] != c[:-1]) | (key[1:] != key[:-1]))))
        return order, begins, key[begins], np.minimum.reduceat(doc[order], begins) if len(begins) else doc

    def digests(self, at: np.ndarray) -> np.ndarray:
        """Hashes of the windows from these places on."""
        if self._eight is None:
            self._eight = _eights(self.raw)
        return _digest_at(self._eight, at, at + self.window, at, self.window)

    def singles(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sample, window, digest) of every window of the chosen samples."""
        counts = self.hi[chosen] - self.lo[chosen] + 1
        of = np.repeat(chosen, counts)
        at = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts) + self.lo[of]
        digests = np.zeros(len(of), _U)
        for i in range(0, len(of), 1 << 16):
            digests[i : i + (1 << 16)] = self.digests(at[i : i + (1 << 16)])
        return of, at, digests


def _ranged(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Which of so many even ranges each hash is in."""
    return ((keys >> _U(32)) * _U(ranges) >> _U(32)).astype(np.int64)


_BLOCK = "blk long, n_bytes long, ids array<long>, sizes array<long>, packed binary"


def _blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """Texts in compressed blocks, kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        ids: list = []
        texts: list[bytes] = []
        size = 0

        def block() -> pa.RecordBatch:
            packed = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([size], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([list(map(len, texts))], pa.list_(pa.int64())), pa.array([packed], pa.binary())], ["blk", "n_bytes", "ids", "sizes", "packed"])

        for batch in batches:
            raw, offsets = strings(batch.column(1))
            ends = offsets.tolist()
            for k, doc in enumerate(batch.column(0).to_pylist()):
                length = ends[k + 1] - ends[k]
                if texts and size + length > block_bytes:
                    yield block()
                    number, ids, texts, size = number + 1, [], [], 0
                ids.append(doc)
                texts.append(raw[ends[k] : ends[k + 1]].tobytes())
                size += length
        if texts:
            yield block()

    rows = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return keep(rows.mapInArrow(run, _BLOCK), "blocks")


def _opened(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, list, np.ndarray, np.ndarray]]:
    """(row, order of its documents, their ids, bytes, offsets) of each block."""
    for r in range(batch.num_rows):
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(batch.column("packed")[r].as_py()), np.uint8)
        ids = batch.column("ids")[r].as_py()
        offsets = np.concatenate(([0], np.cumsum(np.asarray(batch.column("sizes")[r].as_py(), np.int64))))
        yield r, np.array([_LAST if d is None else d for d in ids], np.int64), ids, raw, offsets


# ------------------------------------------------- first exchange: which samples recur
def _range_edges(key: np.ndarray, ranges: int) -> np.ndarray:
    """Where each range begins among sorted hashes of anchors."""
    return np.searchsorted(_ranged(key << _U(64 - _BITS), ranges), np.arange(ranges + 1))


def _sent_anchors(blocks: DataFrame, window: int, ranges: int) -> DataFrame:
    """Rows (range, blk, first, steps, contexts, docs): the block's distinct samples, their anchors as differences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, ids, _, raw, offsets in _opened(batch):
                found = Samples(raw, offsets, window)
                order, begins, keys, least = found.distinct(ids[found.doc])
                edges = _range_edges(keys, ranges).tolist()
                contexts = np.ascontiguousarray((found.c[order[begins]] >> _U(64 - 8 * _BYTES)).view(np.uint8).reshape(-1, 8)[:, :_BYTES])
                rows: list[list] = [[], [], [], [], []]
                for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                    if a == b:
                        continue
                    steps = np.diff(keys[a:b])
                    wide = len(steps) and int(steps.max()) >= 1 << 32
                    for held, x in zip(rows, (k, int(keys[a]), steps.astype("<u8" if wide else "<u4").tobytes(), contexts[a:b].tobytes(), _pack(least[a:b])), strict=True):
                        held.append(x)
                n = len(rows[0])
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array([batch.column("blk")[r].as_py()] * n, pa.int64()), pa.array(rows[1], pa.int64()), *[pa.array(x, pa.binary()) for x in rows[2:]]], ["range", "blk", "first", "steps", "contexts", "docs"])

    return blocks.mapInArrow(run, "range int, blk long, first long, steps binary, contexts binary, docs binary")


def _recurring(sent: DataFrame, hot: int) -> DataFrame:
    """Rows (blk, range, n, codes): what becomes of each sample (0: nothing), n of them go on; a row for those with any."""

    def run(rows: pa.Table) -> pa.Table:
        keys, contexts, docs = [], [], []
        for first, steps, blob, packed in zip(*(rows[c].to_pylist() for c in ("first", "steps", "contexts", "docs")), strict=True):
            doc = _unpack(packed, np.int64)
            gaps = np.frombuffer(steps, "<u4" if len(steps) == 4 * (len(doc) - 1) else "<u8").astype(_U)
            keys.append(_U(first) + np.concatenate((np.zeros(1, _U), np.cumsum(gaps, dtype=_U))))
            context = np.zeros((len(doc), 8), np.uint8)
            context[:, :_BYTES] = np.frombuffer(blob, np.uint8).reshape(-1, _BYTES)
            contexts.append(context.view(_U).reshape(-1))
            docs.append(doc)
        key, context, doc = map(np.concatenate, (keys, contexts, docs))
        both = key << _U(64 - _BITS) | context >> _U(8 * _BYTES + _BITS - 64)
        order = np.argsort(both, kind="stable")
        ranked = both[order]
        if ((ranked[1:] == ranked[:-1]) & (context[order[1:]] != context[order[:-1]])).any():
            order = np.lexsort((context, both))
        key, ranked, doc = key[order], context[order], doc[order]
        anchors = np.concatenate(([True], key[1:] != key[:-1]))
        begins = np.flatnonzero(anchors | np.concatenate(([False], ranked[1:] != ranked[:-1])))
        many = _sizes(begins, len(key))
        of = np.cumsum(anchors) - 1
        unequal = np.bincount(of[begins])[of]
        told = np.where(np.repeat(np.minimum.reduceat(doc, begins), many) < doc, _COVERED, np.where(unequal < 2, 0, np.where(unequal >= hot, _OFTEN, _ON)))
        codes = np.empty(len(key), np.uint8)
        codes[order] = told
        cuts = np.split(codes, np.cumsum([len(k) for k in keys])[:-1])
        some = [i for i, x in enumerate(cuts) if x.any()]
        return pa.table({"blk": rows["blk"].take(pa.array(some, pa.int64())), "range": rows["range"].take(pa.array(some, pa.int64())), "n": pa.array([int(((cuts[i] == _ON) | (cuts[i] == _OFTEN)).sum()) for i in some], pa.int64()), "codes": pa.array([_pack(cuts[i]) for i in some], pa.binary())})

    return sent.groupBy("range").applyInArrow(run, "blk long, range int, n long, codes binary")


def _codes(told: list | None, keys: np.ndarray, ranges: int) -> np.ndarray:
    """The codes of a block's distinct samples."""
    edges, out = _range_edges(keys, ranges), np.zeros(len(keys), np.uint8)
    for reply in told or []:
        out[edges[reply["range"]] : edges[reply["range"] + 1]] = _unpack(reply["codes"], np.uint8)
    return out


# ------------------------------------------------- second exchange: sorted runs of suffixes
def _sort(raw: np.ndarray, start: np.ndarray, size: np.ndarray, part: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings by part and bytes, and the length of the prefix that each in order shares with the one before."""
    eight = _eights(raw)
    masks = np.array([(1 << 8 * k) - 1 for k in range(9)], _U)
    words = []
    for o in range(0, longest, 8):
        left = np.clip(size - o, 0, 8)
        words.append((eight[np.minimum(start + o, len(raw))] & masks[left]).byteswap())
    order = np.lexsort((size, *words[::-1], part))
    shared = np.zeros(len(order), np.int64)
    going = np.flatnonzero(part[order][1:] == part[order][:-1]) + 1
    for w in words:
        x = w[order[going]] ^ w[order[going - 1]]
        # bytes before the first that differs
        shared[going] += np.where(x == 0, 8, 7 - np.searchsorted(_POWERS, x, "right"))
        going = going[x == 0]
    return order, np.minimum(shared, np.minimum(size[order], np.concatenate(([0], size[order][:-1]))))


def _gathered(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> bytes:
    """The spans of bytes, one after another."""
    at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    return raw[at].tobytes()


#: numbers: of each suffix the prefix it shares, its size, the bytes before it and the document; texts: the bytes that differ, then those before.
_RUN = "part int, hot boolean, blk long, numbers binary, texts binary"


def _sorted_runs(joined: DataFrame, window: int, ranges: int, parts: int) -> DataFrame:
    """Each block's suffixes that go on, front-coded, a row for each part and kind."""

    def rows(raw: np.ndarray, blk: int, start: np.ndarray, at: np.ndarray, end: np.ndarray, docs: np.ndarray, keys: np.ndarray, hot: bool) -> pa.RecordBatch | None:
        part = _ranged(keys, parts)
        order, shared = _sort(raw, at, end - at, part, window)
        start, at, end, docs, part = (x[order] for x in (start, at, end, docs, part))
        edges = np.flatnonzero(np.diff(part, prepend=-1, append=-2))
        out: list[list] = [[], [], []]
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            own, lcp = slice(a, b), shared[a:b]
            rest = _gathered(raw, at[own] + lcp, end[own] - at[own] - lcp)
            left = _gathered(raw, start[own], at[own] - start[own])
            counts = np.concatenate((lcp, end[own] - at[own], at[own] - start[own])).astype(np.uint8).tobytes()
            for held, x in zip(out, (int(part[a]), _zip(counts + _places(docs[own])), _zip(rest + left)), strict=True):
                held.append(x)
        n = len(out[0])
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array([hot] * n, pa.bool_()), pa.array([blk] * n, pa.int64()), *[pa.array(x, pa.binary()) for x in out[1:]]], ["part", "hot", "blk", "numbers", "texts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, ids, _, raw, offsets in _opened(batch):
                blk, found = batch.column("blk")[r].as_py(), Samples(raw, offsets, window)
                order, begins, keys, least = found.distinct(ids[found.doc])
                code, one = _codes(batch.column("told")[r].as_py(), keys, ranges), order[begins]
                once = one[code == _ON]
                if len(once):
                    yield rows(raw, blk, found.lo[once], found.at[once], found.hi[once] + window, least[code == _ON], found.h[once], False)
                often = one[code == _OFTEN]
                if len(often):
                    sample, at, digest = found.singles(often)
                    low = np.zeros(len(found.doc), np.int64)
                    low[one] = least
                    first, docs = _first(digest, low[sample], np.arange(len(at)))
                    yield rows(raw, blk, at[first], at[first], at[first] + window, docs, digest[first], True)

    return joined.select("blk", "ids", "sizes", "packed", "told").mapInArrow(run, _RUN)


def _first(keys: np.ndarray, docs: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each distinct key one of its places, with the least document."""
    order, begins = _groups(keys)
    return of[order[begins]], np.minimum.reduceat(docs[order], begins)


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the keys, equal ones as they came, and where in it each distinct key begins."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    return order, np.flatnonzero(np.concatenate((np.ones(min(len(keys), 1), bool), ranked[1:] != ranked[:-1])))


def _sizes(begins: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(begins, n))


def merged(heads: list[list[bytes]], shared: list[list[int]]) -> tuple[list[int], list[int]]:
    """Merges sorted runs: (run of each string in order, prefix it shares with the one before).

    A loser tree with common prefixes: of two heads the one that shares more with
    the last string put out is smaller, and if they share as much, they are
    compared from there on; the loser keeps what it shares with the winner.
    """
    runs = len(heads)
    size = 1 << max(runs - 1, 0).bit_length()
    at = [0] * size
    head: list[bytes] = [h[0] if h else b"" for h in heads] + [b""] * (size - runs)
    common = [0 if h else -1 for h in heads] + [-1] * (size - runs)  # -1: the run is at its end
    loser = [0] * size
    left = [len(h) for h in heads]

    def play(a: int, b: int) -> tuple[int, int]:
        i = common[a]
        if i != common[b]:
            return (a, b) if i > common[b] else (b, a)
        if i < 0:
            return a, b
        x, y = head[a], head[b]
        if x[i:] == y[i:]:
            common[b] = len(x)
            return a, b
        n = min(len(x), len(y))
        while i < n and x[i] == y[i]:
            i += 1
        if x[i:] < y[i:]:
            common[b] = i
            return a, b
        common[a] = i
        return b, a

    best = list(range(size))
    node = size // 2
    while node:
        won = []
        for k in range(node):
            w, loser[node + k] = play(best[2 * k], best[2 * k + 1])
            won.append(w)
        best, node = won, node // 2
    w = best[0]
    order, prefix = [], []
    for _ in range(sum(left)):
        order.append(w)
        prefix.append(common[w])
        at[w] += 1
        if at[w] < left[w]:
            head[w], common[w] = heads[w][at[w]], shared[w][at[w]]
        else:
            common[w] = -1
        node = (w + size) // 2
        while node:
            o = loser[node]
            if common[o] > common[w]:
                loser[node], w = w, o
            elif common[o] == common[w] >= 0:
                w, loser[node] = play(w, o)
            node //= 2
    return order, prefix


def _decoded(shared: np.ndarray, size: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Front-coded strings as rows of bytes, with zeros behind up to whole eights."""
    own = size - shared
    begin = np.cumsum(own) - own - shared
    out = np.zeros((-(-int(size.max()) // 8) * 8, len(size)), np.uint8)
    row = np.arange(len(size))
    for p in range(int(size.max())):
        long = np.flatnonzero(size > p)
        # the byte is that of the last string which did not take it from the one before
        source = np.maximum.accumulate(np.where(shared <= p, row, 0))[long]
        out[p, long] = rest[begin[source] + p]
    return np.ascontiguousarray(out.T)


def _hashed(texts: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """A hash of each row's bytes, a whole number of eights, and its seed."""
    out = mix(seed.astype(_U) * _ODD)
    for o in range(0, texts.shape[1], 8):
        out = mix(out * _ODD + np.ascontiguousarray(texts[:, o : o + 8]).view(_U).reshape(-1))
    return out


class Runs:
    """The sorted runs of a range: all their suffixes one after another, the equal ones known."""

    def __init__(self, rows: pa.Table, window: int) -> None:
        self.window = window
        counts, docs, rests, lefts, sizes = [], [], [], [], []
        for numbers, texts in zip(rows["numbers"].to_pylist(), rows["texts"].to_pylist(), strict=True):
            raw, text = _unzip(numbers), _unzip(texts)
            n = len(raw) // 11
            three = np.frombuffer(raw, np.uint8, 3 * n).reshape(3, n)
            cut = int(three[1].sum(dtype=np.int64) - three[0].sum(dtype=np.int64))
            for held, x in zip((counts, docs, rests, lefts, sizes), (three, _numbers(raw[3 * n :], np.int64), text[:cut], text[cut:], n), strict=True):
                held.append(x)
        self.shared, self.size, self.back = np.concatenate(counts, axis=1).astype(np.int64)
        self.doc = np.concatenate(docs)
        #: suffixes of run r are edges[r] … edges[r + 1]
        self.edges = np.concatenate(([0], np.cumsum(sizes)))
        #: bytes before the anchor, which end at column ``middle``, and from the anchor on
        self.middle = -(-(window - GRAM) // 8) * 8
        suffixes = _decoded(self.shared, self.size, np.frombuffer(b"".join(rests), np.uint8))
        self.texts = np.zeros((len(self.doc), self.middle + suffixes.shape[1]), np.uint8)
        self.texts[:, self.middle :] = suffixes
        column = np.repeat(self.middle - np.cumsum(self.back), self.back) + np.arange(int(self.back.sum()))
        self.texts[np.repeat(np.arange(len(self.doc)), self.back), column] = np.frombuffer(b"".join(lefts), np.uint8)
        #: string: the first suffix of equal bytes
        order, begins = _groups(_hashed(suffixes, self.size))
        ranked = suffixes[order]
        first = np.zeros(len(order), bool)
        first[begins] = True
        same = np.flatnonzero(~first)
        first[same] = (self.size[order[same]] != self.size[order[same - 1]]) | (ranked[same] != ranked[same - 1]).any(axis=1)
        begins = np.flatnonzero(first)
        self.string = np.empty(len(order), np.int64)
        self.string[order] = np.repeat(order[begins], _sizes(begins, len(order)))
        # samples: those of equal bytes before and from the anchor on, with their least document
        order, begins = _groups(_hashed(self.texts[:, : self.middle], self.string << 7 | self.back))
        self.sample = np.empty(len(order), np.int64)
        self.sample[order] = np.repeat(np.arange(len(begins)), _sizes(begins, len(order)))
        #: of each sample one suffix, and the least document
        self.one, self.least = order[begins], np.minimum.reduceat(self.doc[order], begins)

    def open(self) -> np.ndarray:
        """Samples that may share a window with an unequal one.

        A window has ``mid`` bytes before the anchor or at least window - mid + 1
        from it on, so an equal one agrees in these.
        """
        mid, width = (self.window - GRAM) // 2, self.window - (self.window - GRAM) // 2 + 1
        found = np.zeros(len(self.one), bool)
        for begin, end, chosen in ((self.middle - mid, self.middle + GRAM, np.flatnonzero(self.back[self.one] >= mid)), (self.middle, self.middle + width, np.flatnonzero(self.size[self.one] >= width))):
            if len(chosen):
                part = np.zeros((len(chosen), -(-(end - begin) // 8) * 8), np.uint8)
                part[:, : end - begin] = self.texts[self.one[chosen], begin:end]
                order, begins = _groups(_hashed(part, np.zeros(len(chosen), _U)))
                many = _sizes(begins, len(order))
                found[chosen[order]] |= np.repeat(many > 1, many)
        return np.flatnonzero(found)

    def merge(self, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of each of these strings in the order of all, prefix that each in order shares with the one before)."""
        # what a string shares with the last one left of its run is the least of what lies between
        shared = np.minimum.reduceat(self.shared[: strings[-1] + 1], np.concatenate(([0], strings[:-1] + 1)))
        width = self.texts.shape[1] - self.middle
        raw = self.texts[strings, self.middle :].tobytes()
        texts = [raw[i : i + n] for i, n in zip(range(0, len(raw), width), self.size[strings].tolist(), strict=True)]
        cuts = np.unique(np.searchsorted(strings, self.edges)).tolist()
        lcp = shared.tolist()
        spans = list(zip(cuts[:-1], cuts[1:], strict=True))
        run_of, prefix = merged([texts[a:b] for a, b in spans], [lcp[a:b] for a, b in spans])
        return np.argsort(np.array(run_of), kind="stable"), np.array(prefix)

    def masks(self) -> tuple[np.ndarray, np.ndarray]:
        """(bits: bytes before the anchor of windows that a document below the sample's least has; least document that has any of its windows)."""
        window, mask, least = self.window, np.zeros(len(self.one), _U), self.least.copy()
        chosen = self.open()
        if not len(chosen):
            return mask, least
        one, doc = self.one[chosen], self.least[chosen]
        strings, of = np.unique(self.string[one], return_inverse=True)
        place, prefix = self.merge(strings)
        place, size, back = place[of], self.size[one], self.back[one]
        seen = np.zeros(len(one), _U)  # hash of the bytes before the anchor, so far
        for t in range(window - GRAM + 1):
            if t:
                far = np.flatnonzero(back >= t)
                seen[far] = mix((seen[far] ^ self.texts[one[far], self.middle - t]) * _ODD + _U(t))
            valid = np.flatnonzero((size >= window - t) & (back >= t))
            if not len(valid):
                continue
            # the suffixes that share window - t bytes are neighbours in the array
            order, begins = _groups(mix(np.cumsum(prefix < window - t)[place[valid]].astype(_U) * _ODD + seen[valid]))
            low = np.empty(len(valid), np.int64)
            low[order] = np.repeat(np.minimum.reduceat(doc[valid][order], begins), _sizes(begins, len(order)))
            mask[chosen[valid[low < doc[valid]]]] |= _U(1 << t)
            least[chosen[valid]] = np.minimum(least[chosen[valid]], low)
        return mask, least

    def digests(self, samples: np.ndarray, longest: int) -> np.ndarray:
        """The samples' hashes, as their blocks have them."""
        out = np.zeros(len(samples), _U)
        for i in range(0, len(samples), _TEXTS):
            one = self.one[samples[i : i + _TEXTS]]
            at = np.arange(len(one)) * self.texts.shape[1] + self.middle
            out[i : i + _TEXTS] = _digest_at(_eights(self.texts[one].reshape(-1)), at - self.back[one], at + self.size[one], at, longest)
        return out


def _covered(parts: DataFrame, window: int) -> DataFrame:
    """Rows (blk, hot, keys, what): digests of samples with the windows (bits: bytes before the anchor) that a smaller document has, or, if hot, of windows with the least document that has them."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        hot = key[1].as_py()
        runs = Runs(rows, window)
        mask, least = runs.masks()
        bits = mask[runs.sample]
        told = np.arange(len(runs.doc)) if hot else np.flatnonzero(bits)
        out: list[list] = [[], [], []]
        if len(told):
            samples, of = np.unique(runs.sample[told], return_inverse=True)
            keys = runs.digests(samples, window if hot else 2 * window - GRAM)[of]
            what = least[runs.sample[told]] if hot else signed(bits[told])
            cuts = np.searchsorted(told, runs.edges).tolist()
            for blk, a, b in zip(rows["blk"].to_pylist(), cuts[:-1], cuts[1:], strict=True):
                if a < b:
                    for held, x in zip(out, (blk, _pack(keys[a:b]), _pack(what[a:b])), strict=True):
                        held.append(x)
        return pa.table({"blk": pa.array(out[0], pa.int64()), "hot": pa.array([hot] * len(out[0]), pa.bool_()), "keys": pa.array(out[1], pa.binary()), "what": pa.array(out[2], pa.binary())})

    return parts.groupBy("part", "hot").applyInArrow(run, "blk long, hot boolean, keys binary, what binary")


# ------------------------------------------------- third exchange: cutting
def _cut(joined: DataFrame, window: int, ranges: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, ids, named, raw, offsets in _opened(batch):
                found = Samples(raw, offsets, window)
                doc = ids[found.doc]
                begins = np.zeros(len(raw) + 1, np.uint8)
                order, first, anchors, least = found.distinct(doc)
                code, many = _codes(batch.column("told")[r].as_py(), anchors, ranges), _sizes(first, len(order))
                # of each sample its place among the distinct ones
                of = np.empty(len(order), np.int64)
                of[order] = np.repeat(np.arange(len(first)), many)
                # a smaller document has an equal sample, in the block or elsewhere
                mask = np.zeros(len(doc), _U)
                whole = ((_U(1) << (found.at - found.lo + 1).astype(_U)) - _U(1)) & ~((_U(1) << (found.at - found.hi).astype(_U)) - _U(1))
                covered = (code[of] == _COVERED) | (least[of] < doc)
                mask[covered] = whole[covered]
                keys: dict[bool, list] = {False: [np.zeros(0, _U)], True: [np.zeros(0, _U)]}
                what: dict[bool, list] = {False: [np.zeros(0, np.int64)], True: [np.zeros(0, np.int64)]}
                for reply in batch.column("replies")[r].as_py() or []:
                    keys[reply["hot"]].append(_unpack(reply["keys"], _U))
                    what[reply["hot"]].append(_unpack(reply["what"], np.int64))
                key, told = np.concatenate(keys[False]), np.concatenate(what[False]).view(_U)
                if len(key):
                    # to all samples of a digest, those of all replies at once: the bits mean windows, which are the same in each
                    by = np.argsort(key)
                    key, told = key[by], told[by]
                    on = np.flatnonzero(code == _ON)
                    c = found.c[order[first[on]]]
                    place = np.minimum(np.searchsorted(key, c), len(key) - 1)
                    bits = np.zeros(len(first), _U)
                    bits[on] = np.where(key[place] == c, told[place], _U(0))
                    mask |= bits[of] & whole
                some = np.flatnonzero(mask)
                for t in range(window - GRAM + 1):
                    begins[found.at[some[(mask[some] >> _U(t) & _U(1)).astype(bool)]] - t] = 1
                key, limit = np.concatenate(keys[True]), np.concatenate(what[True])
                if len(key):
                    by = np.argsort(key)
                    key, limit = key[by], limit[by]
                    often = np.flatnonzero(code[of] == _OFTEN)
                    for i in range(0, len(often), 1 << 16):
                        sample, at, digest = found.singles(often[i : i + (1 << 16)])
                        place = np.minimum(np.searchsorted(key, digest), len(key) - 1)
                        begins[at[(key[place] == digest) & (limit[place] < doc[sample])]] = 1
                total = np.cumsum(np.concatenate((begins[:1] * 0, begins[:-1])), dtype=np.int32)
                earlier = np.zeros(len(raw), np.int32)
                earlier[window - 1 :] = total[: max(len(raw) - window + 1, 0)]
                gone = total[1:] > earlier
                edge = np.zeros(len(raw) + 1, bool)
                edge[offsets] = True
                starts = np.flatnonzero(gone & (edge[:-1] | ~np.concatenate(([False], gone[:-1]))))
                stops = np.flatnonzero(gone & (edge[1:] | ~np.concatenate((gone[1:], [False])))) + 1
                of = np.searchsorted(offsets, starts, "right") - 1
                listed = np.searchsorted(of, np.arange(len(named) + 1))
                spans = np.stack((starts - offsets[of], stops - offsets[of]), 1)
                kept = raw[~gone].tobytes()
                cuts = np.cumsum(np.concatenate(([False], ~gone)), dtype=np.int32 if len(raw) < 1 << 31 else np.int64)[offsets].tolist()
                inner = pa.ListArray.from_arrays(pa.array(np.arange(len(spans) + 1, dtype=np.int32) * 2), pa.array(spans.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(named, pa.int64()), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(pa.array(listed, pa.int32()), inner), pa.array([kept[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], ["doc_id", "n_bytes", "removed", "kept"])

    return joined.select("ids", "sizes", "packed", "told", "replies").mapInArrow(run, "doc_id long, n_bytes long, removed array<array<long>>, kept binary")


def dedup_bytes(docs: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, range_anchors: int = RANGE_ANCHORS, range_suffixes: int = RANGE_SUFFIXES, hot: int = HOT) -> DataFrame:
    """Rows (doc_id, n_bytes, removed, kept) of ``docs(doc_id, text)``.

    removed is an array of [first byte, end) of the longest runs of bytes that
    are covered by strings of ``window`` bytes which also start in a row with a
    smaller doc_id; kept has the other bytes, which need not be whole characters.
    Rows of equal doc_ids take nothing from each other; null doc_ids come after
    all others.  Null and empty texts have no bytes, texts of fewer than
    ``window`` lose none; an empty table gives no rows; extra columns are ignored.
    """
    if not GRAM + 1 < window <= GRAM + 63:
        raise ValueError(f"window must be more than {GRAM + 1} and at most {GRAM + 63} bytes")
    least = partitions(docs.sparkSession)
    blocks = _blocks(docs, block_bytes)
    total = blocks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    # a random order has two anchors in as many bytes as a window has grams, and one
    ranges = max(least, -(-2 * total // (window - GRAM + 2) // range_anchors))
    # dealt by number, as these tasks' work is far more than their bytes say
    codes = keep(_recurring(_sent_anchors(blocks, window, ranges).repartitionById(ranges, "range"), hot), "recurring")
    going = codes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    replies = codes.groupBy("blk").agg(F.collect_list(F.struct("range", "codes")).alias("told"))  # a row for each range
    parts = max(least, -(-going // range_suffixes))
    runs = _sorted_runs(blocks.join(replies, "blk"), window, ranges, parts)
    found = _covered(runs.repartitionById(parts, "part"), window).groupBy("blk").agg(F.collect_list(F.struct("hot", "keys", "what")).alias("replies"))
    return _cut(blocks.join(replies, "blk", "left").join(found, "blk", "left"), window, ranges)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_bytes(table(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple], window: int = WINDOW) -> list[tuple]:
    """The query's rows by a table of all windows; for tests."""
    texts = [(_LAST if d is None else d, d, (t or "").encode()) for d, t in rows]
    least: dict[bytes, int] = {}
    for k, _, b in texts:
        for i in range(len(b) - window + 1):
            w = b[i : i + window]
            least[w] = min(k, least.get(w, k))
    out = []
    for k, d, b in texts:
        gone = np.zeros(len(b) + 2, bool)
        for i in range(len(b) - window + 1):
            if least[b[i : i + window]] < k:
                gone[i + 1 : i + 1 + window] = True
        kept = bytes(x for x, g in zip(b, gone[1:].tolist(), strict=False) if not g)
        out.append((d, len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


QUERIES = {"op13_suffix_dedup": query}
ORACLES: dict[str, str] = {}
