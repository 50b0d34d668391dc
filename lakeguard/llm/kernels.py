"""Array kernels shared by the text operators.

They run inside Spark tasks on the Arrow batches that ``mapInArrow`` hands
over and work on UTF-8 bytes: words are found with a byte table and hashed eight
bytes at a time, each step mixed in full, and a span of words gets its hash from
two overlapping spans of half the length or more, so no Python loop runs over
words.  Nothing is a sum of powers, whose value for regular texts is known
beforehand.  Hashes of two seeds are independent of each other from the bytes up.
Memory is bounded by ``SLICE`` bytes of text (or one document, if that is longer).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text that one pass holds as arrays.
SLICE = 1 << 21
#: Longest words, in bytes, that are hashed eight bytes at a time; xxh3 takes longer ones.
_LONG = 64

_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)
#: The low 0 … 8 bytes of eight.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit mixing hash."""
    x = x ^ (x >> _U(33))
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


def byte_table(space: bool) -> np.ndarray:
    """True for bytes inside a word.

    space: words are runs of anything but ASCII white space; otherwise runs of
    ASCII digits, lower-case letters and anything beyond ASCII.
    """
    t = np.zeros(256, bool)
    if space:
        t[:] = True
        t[[0x20, *range(0x09, 0x0E)]] = False
    else:
        t[0x30:0x3A] = t[0x61:0x7B] = t[0x80:] = True
    return t


LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
SPACE_WORDS = byte_table(True)
ALNUM_WORDS = byte_table(False)


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    raw = raw[offs[0] : offs[-1]]
    return raw, offs - offs[0]


def slices(offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """Words of consecutive documents: spans of bytes, hashes, and the first word of each document."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray, lower: bool = False) -> None:
        offsets = offsets - offsets[0]
        self.raw = LOWER[raw] if lower else raw
        self.offsets = offsets
        word = inside[self.raw]
        before = np.zeros(len(word) + 1, bool)
        before[1:] = word
        after = np.zeros(len(word) + 1, bool)
        after[:-1] = word
        # a document's first byte follows no word
        edge = np.zeros(len(word) + 1, bool)
        edge[offsets] = True
        begins = np.flatnonzero(word & (~before[:-1] | edge[:-1]))
        ends = np.flatnonzero(word & (~after[1:] | edge[1:])) + 1
        self.starts, self.ends = begins, ends
        #: words of document i are first[i] … first[i + 1]
        self.first = np.searchsorted(begins, offsets)
        self._hashes: dict[int, np.ndarray] = {}
        self._eight: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.starts)

    def eight(self, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The bytes from each place on as a number, at most eight, or ``length`` if that is less; the others are 0."""
        if self._eight is None:
            n = len(self.raw)
            padded = np.zeros(n + 8, np.uint8)
            padded[:n] = self.raw
            self._eight = np.ndarray((n + 1,), "<u8", padded, strides=(1,))
        return self._eight[at] & _MASKS[np.minimum(length, 8)]

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word's bytes and their number."""
        if seed not in self._hashes:
            length = self.ends - self.starts
            out = mix(length.astype(_U) * _ODD + _U(seed))
            short = np.flatnonzero(length <= _LONG)
            for at in range(0, _LONG, 8):
                if at:
                    short = short[length[short] > at]
                if not len(short):
                    break
                out[short] = mix((out[short] ^ self.eight(self.starts[short] + at, length[short] - at)) * _ODD)
            for i in np.flatnonzero(length > _LONG).tolist():
                out[i] = xxhash.xxh3_64_intdigest(self.raw[self.starts[i] : self.ends[i]].tobytes(), seed)
            self._hashes[seed] = out
        return self._hashes[seed]

    def document(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


class Rolling:
    """Hashes of any span of words."""

    def __init__(self, words: Words, seed: int = 0) -> None:
        self.n = len(words)
        #: hashes of the 1, 2, 4, … words that start at each word
        self.levels = [words.hashes(seed)]

    def _level(self, k: int) -> np.ndarray:
        while len(self.levels) <= k:
            last, half = self.levels[-1], 1 << len(self.levels) - 1
            self.levels.append(mix(last[:-half] * _ODD + (last[half:] ^ _U(half))) if len(last) > half else last[:0])
        return self.levels[k]

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the words start … end - 1, at least one; spans of other lengths get other hashes."""
        size = end - start
        out = np.empty(len(size), _U)
        for length in np.unique(size).tolist():
            own = np.flatnonzero(size == length)
            k = length.bit_length() - 1
            level = self._level(k)
            out[own] = mix((level[start[own]] + _U(length)) * _ODD + level[end[own] - (1 << k)])
        return out

    def grams(self, k: int) -> np.ndarray:
        """Hashes of all runs of k words, those across documents included."""
        if self.n < k:
            return np.zeros(0, _U)
        half = k.bit_length() - 1
        level = self._level(half)
        m = self.n - k + 1
        return mix((level[:m] + _U(k)) * _ODD + level[k - (1 << half) :][:m])


def window_minima(h: np.ndarray, w: int) -> np.ndarray:
    """Position of the minimum of each w consecutive hashes; of equal ones the first."""
    n = len(h)
    if n < w:
        return np.zeros(0, np.int64)
    bits = max(1, int(n - 1).bit_length())
    low = _U((1 << bits) - 1)
    # the order looks at the high bits, so it does not change with the position of a text in a batch
    keep = _U(((1 << 64) - 1) ^ ((1 << 30) - 1)) if bits <= 30 else ~low
    key = (h & keep) | np.arange(n, dtype=_U)
    have = 1
    while 2 * have <= w:
        key = np.minimum(key[: len(key) - have], key[have:])
        have *= 2
    if have < w:
        key = np.minimum(key[: n - w + 1], key[w - have : w - have + n - w + 1])
    return (key & (low if bits > 30 else _U((1 << 30) - 1))).astype(np.int64)


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)


def components(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Smallest member of each node's component under the links a - b, joined to those that ``label`` has already."""
    label = np.arange(n) if label is None else label.copy()
    while len(a):
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            break
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        lo, hi = np.minimum(la, lb), np.maximum(la, lb)
        np.minimum.at(label, hi, lo)
        while True:
            deeper = label[label]
            if np.array_equal(deeper, label):
                break
            label = deeper
    return label


def window_runs(words: Words, rolling: Rolling, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Winnowing: (lo, hi, anchor) of runs of consecutive windows that choose the same gram.

    A window of ``window`` words starts at each word that has as many words left
    in its document; it chooses the gram of least hash in it.  The choice depends
    on the window's words alone, so equal windows choose equal grams at equal
    places, and every window belongs to exactly one run.
    """
    none = np.zeros(0, np.int64)
    n = len(words)
    if n < window:
        return none, none, none
    least = window_minima(rolling.grams(gram), window - gram + 1)
    counts = np.diff(words.first)
    end = np.repeat(words.first[1:], counts)[: len(least)]
    valid = np.flatnonzero(np.arange(len(least)) + window <= end)
    if not len(valid):
        return none, none, none
    anchor = least[valid]
    breaks = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1] + 1))))
    return valid[breaks], valid[np.append(breaks[1:], len(valid)) - 1], anchor[breaks]
