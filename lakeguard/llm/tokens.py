"""Token ids in patched frame-of-reference blocks.

Documents are range-partitioned by doc_id, so the shards in their order hold all
ids in ascending order of documents.  A shard is a row with the ids of
consecutive documents: blocks of ``BLOCK`` ids, each with its minimum subtracted
and packed at the width that most of its ids need; ids that do not fit are
listed as exceptions, and an index gives the byte at which each block starts, so
a reader can decode one block alone.  Shards are written by Spark's own writer,
whose commit makes lost executors and repeated tasks harmless.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from lakeguard.llm.common import partitions, scratch, table
from lakeguard.llm.kernels import SPACE_WORDS, Words, mix, slices, strings

#: Ids in a block.
BLOCK = 256
#: Share of a block's ids that the packed width must hold.
PERCENTILE = 0.9
#: Ids in a shard, about; a longer document has a shard of its own.
SHARD_IDS = 1 << 19
#: Id that ends every document.
END = 1
#: Distinct words, and parts of words, whose ids a worker keeps, about.
CACHE_WORDS = 800_000


# ---------------------------------------------------------------- the format
def _pack(v: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK values below 2^width as rows of bytes, little-endian bit order."""
    n = len(v)
    words = -(-BLOCK * width // 32)
    out = np.zeros((words + 1, n), np.uint64)
    columns = np.ascontiguousarray(v.T).astype(np.uint64)
    for j in range(BLOCK):
        at, shift = divmod(j * width, 32)
        moved = columns[j] << np.uint64(shift)
        out[at] |= moved & np.uint64(0xFFFFFFFF)
        if shift + width > 32:
            out[at + 1] |= moved >> np.uint64(32)
    return np.ascontiguousarray(out[:words].T.astype("<u4")).view(np.uint8).reshape(n, -1)


def _unpack(packed: np.ndarray, width: int) -> np.ndarray:
    """The rows that ``_pack`` was given."""
    n = len(packed)
    words = np.zeros((packed.shape[1] // 4 + 1, n), np.uint64)
    words[:-1] = np.ascontiguousarray(packed).view("<u4").reshape(n, -1).T
    out = np.empty((BLOCK, n), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for j in range(BLOCK):
        at, shift = divmod(j * width, 32)
        x = words[at]
        if shift + width > 32:
            x = x | (words[at + 1] << np.uint64(32))
        out[j] = (x >> np.uint64(shift)) & mask
    return np.ascontiguousarray(out.T)


def encode(ids: np.ndarray, percentile: float = PERCENTILE) -> tuple[bytes, bytes]:
    """(payload, index) of uint32 ids.

    A block is: minimum (u32), width (u8), exceptions (u16), the packed values,
    then the exceptions' places (u8 each) and high parts (u32 each).  The last
    block is padded with its last id.  The index has a u64 for each block.
    """
    n = len(ids)
    if not n:
        return b"", b""
    v = np.concatenate([ids, np.full(-n % BLOCK, ids[-1])]).astype(np.uint32).reshape(-1, BLOCK)
    low = v.min(1)
    v = v - low[:, None]
    need = np.sort(v, axis=1)[:, min(BLOCK - 1, int(np.ceil(percentile * BLOCK)) - 1)]
    widths = np.ceil(np.log2(need.astype(float) + 1)).astype(np.int64)
    blocks: list[bytes] = [b""] * len(v)
    for width in np.unique(widths).tolist():
        own = np.flatnonzero(widths == width)
        inner = v[own] & np.uint32((1 << width) - 1)
        packed = _pack(inner, width) if width else np.zeros((len(own), 0), np.uint8)
        high = v[own] >> np.uint32(width)
        row, place = np.nonzero(high)
        counts = np.bincount(row, minlength=len(own))
        at = np.concatenate(([0], np.cumsum(counts)))
        places, highs = place.astype(np.uint8), high[row, place].astype("<u4")
        for k, b in enumerate(own.tolist()):
            s, e = at[k], at[k + 1]
            blocks[b] = int(low[b]).to_bytes(4, "little") + bytes((width,)) + int(e - s).to_bytes(2, "little") + packed[k].tobytes() + places[s:e].tobytes() + highs[s:e].tobytes()
    sizes = np.fromiter(map(len, blocks), np.uint64, len(blocks))
    return b"".join(blocks), (np.cumsum(sizes) - sizes).astype("<u8").tobytes()


def decode(payload: bytes, index: bytes, n: int) -> np.ndarray:
    """The ``n`` ids of a shard."""
    if not n:
        return np.zeros(0, np.uint32)
    raw = np.frombuffer(payload, np.uint8)
    starts = np.frombuffer(index, "<u8").astype(np.int64)
    low = raw[starts[:, None] + np.arange(4)].view("<u4").ravel()
    widths = raw[starts + 4]
    extra = raw[starts[:, None] + np.arange(5, 7)].view("<u2").ravel().astype(np.int64)
    out = np.empty((len(starts), BLOCK), np.uint32)
    for width in np.unique(widths).tolist():
        own = np.flatnonzero(widths == width)
        size = 4 * -(-BLOCK * width // 32)
        v = _unpack(raw[starts[own][:, None] + np.arange(7, 7 + size)], width) if width else np.zeros((len(own), BLOCK), np.uint32)
        k = extra[own]
        if k.sum():
            row = np.repeat(np.arange(len(own)), k)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)
            place = raw[starts[own][row] + 7 + size + nth]
            at = starts[own][row] + 7 + size + k[row] + 4 * nth
            v[row, place] |= raw[at[:, None] + np.arange(4)].view("<u4").ravel() << np.uint32(width)
        out[own] = v + low[own][:, None]
    return out.ravel()[:n]


def decode_block(payload: bytes, index: bytes, block: int) -> np.ndarray:
    """The ids of one block, read without the others."""
    starts = np.frombuffer(index, "<u8").astype(np.int64)
    end = int(starts[block + 1]) if block + 1 < len(starts) else len(payload)
    return decode(payload[int(starts[block]) : end], np.zeros(1, "<u8").tobytes(), BLOCK)


# ---------------------------------------------------------------- the encoder
#: Stands between words that are encoded together; white space keeps it apart from them.
_MARK = "\x01"
#: Words or parts encoded together.
_TOGETHER = 512
#: Bytes of a short word, at most, and bits of its place in the table of these.
_SHORT, _PLACES = 15, 21
#: Letters, then signs: words that the vocabulary splits into these two parts, whose letters have one lower
#: case each and join with no neighbour.
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\\[-`{-~]*)")


class _Encoder:
    """Ids of texts by way of their distinct words, of which it remembers about ``cache``, and as many parts.

    The vocabulary drops white space and no token spans it, so a text's ids are
    those of its parts between ASCII white space.  Words are numbered by a
    dictionary of their bytes, so two words never pass for each other.  Plain
    words are looked up by their letters in lower case and their signs, so that
    "Word," and "word" need one encoding.
    """

    def __init__(self, path: str, cache: int = CACHE_WORDS) -> None:
        # Spark runs the tasks; threads of the library's own would only cost memory
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.cache = cache
        mark = self.tokenizer.encode(_MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        # the same vocabulary for parts that are in lower case and split already; each ends in a token that says so
        self.parts = Tokenizer.from_file(path)
        self.parts.normalizer = normalizers.Sequence([])
        self.parts.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        names = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(names.values()) + 1, bool)
        self.closes[[i for token, i in names.items() if token.endswith("</w>")]] = True
        tried = ["plain", "a", "\u00e9t\u00e9", "$$$", "."]
        self.plain = self._parts(tried) == [self.tokenizer.encode(w, add_special_tokens=False).ids for w in tried]
        self._clear_words()
        self._clear_parts()

    def _clear_words(self) -> None:
        #: the number of each word; an unknown one gets the next
        self.known: defaultdict[bytes, int] = defaultdict(count().__next__)
        #: bytes and number of the short word in each place
        self.keys, self.there = np.zeros((1 << _PLACES, 2), np.uint64), np.zeros(1 << _PLACES, np.int64)
        #: the ids of words by number
        self.words = _Lists()

    def _clear_parts(self) -> None:
        #: the same of parts of plain words
        self.known_parts: defaultdict[str, int] = defaultdict(count().__next__)
        self.pieces = _Lists()

    def _parts(self, tried: list[str]) -> list[list[int]]:
        """Ids of parts one by one."""
        return [self.parts.encode(w, add_special_tokens=False).ids for w in tried]

    def _encode_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths) of parts of plain words."""
        flat = np.concatenate([np.array(self.parts.encode_batch_fast([" ".join(parts[i : i + _TOGETHER])], add_special_tokens=False)[0].ids, np.uint32) for i in range(0, len(parts), _TOGETHER)])
        ends = np.flatnonzero(self.closes[flat])
        if len(ends) != len(parts):
            raise RuntimeError("the vocabulary does not end every part with a token of its own")
        return flat, np.diff(ends, prepend=-1)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths) of words without white space."""
        if self.mark is None or any(_MARK in w for w in words):
            found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
            return np.concatenate(found), np.fromiter(map(len, found), np.int64, len(found))
        parts = []
        for i in range(0, len(words), _TOGETHER):
            # one text at a time: what the library makes of it is many times larger than the ids
            parts.append(np.array(self.tokenizer.encode_batch_fast([f" {_MARK} ".join(words[i : i + _TOGETHER]) + f" {_MARK}"], add_special_tokens=False)[0].ids, np.uint32))
        flat = np.concatenate(parts)
        marks = np.flatnonzero(flat == self.mark)
        return flat[flat != self.mark], np.diff(marks, prepend=-1) - 1

    def _learn(self, words: list[str]) -> None:
        """Adds the ids of new words in their order: as one or two parts, or whole."""
        pieces, numbers, before = self.pieces, self.known_parts, len(self.known_parts)
        one, two = np.zeros(len(words), np.int64), np.full(len(words), -1, np.int64)
        odd: list[int] = []
        match = _PLAIN.fullmatch
        for i, w in enumerate(words):
            m = match(w) if self.plain else None
            if m is None:
                odd.append(i)
                continue
            letters, signs = m.groups()
            one[i] = numbers[letters.lower()]
            if signs:
                two[i] = numbers[signs]
        if fresh := list(islice(reversed(numbers), len(numbers) - before))[::-1]:
            pieces.add(*self._encode_parts(fresh))
        if odd:
            # odd words are pieces without a name
            at = pieces.size
            pieces.add(*self._encode([words[i] for i in odd]))
            one[odd] = np.arange(at, pieces.size)
            for k in range(at, pieces.size):
                numbers[f" {k}"]
        both = np.column_stack((one, two)).ravel()
        lengths = np.where(two >= 0, pieces.lengths()[two], 0) + pieces.lengths()[one]
        self.words.add(pieces.gather(both[both >= 0]), lengths)

    def _numbers(self, words: Words) -> np.ndarray:
        """The number of each word.

        Words of up to 15 bytes are looked up by these bytes and their length in a
        table with one place for each hash first; the dictionary has the others,
        and those whose place another word has taken.
        """
        start, length = words.starts, words.ends - words.starts
        keys = np.empty((len(start), 2), np.uint64)
        keys[:, 0] = words.eight(start, length)
        keys[:, 1] = length.astype(np.uint64) << np.uint64(56)
        more = np.flatnonzero((length > 8) & (length <= _SHORT))
        keys[more, 1] |= words.eight(start[more] + 8, length[more] - 8)
        place = (mix(keys[:, 0] ^ mix(keys[:, 1])) >> np.uint64(64 - _PLACES)).astype(np.int64)
        number = self.there[place]
        left = np.flatnonzero(~((self.keys[place] == keys).all(1) & (length <= _SHORT)))
        if len(left):
            data, before = words.raw.tobytes(), len(self.known)
            number[left] = np.fromiter(map(self.known.__getitem__, (data[a:b] for a, b in zip(start[left].tolist(), words.ends[left].tolist(), strict=True))), np.int64, len(left))
            new = [w.decode() for w in islice(reversed(self.known), len(self.known) - before)]
            if new:
                self._learn(new[::-1])
            left = left[length[left] <= _SHORT]
            # of several words for one place the last one gets it
            last = np.unique(place[left][::-1], return_index=True)[1]
            left = left[::-1][last]
            self.keys[place[left]], self.there[place[left]] = keys[left], number[left]
        return number

    def ids(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with its end; lengths)."""
        if len(self.known) > self.cache:
            self._clear_words()
        if len(self.known_parts) > self.cache:
            self._clear_parts()
        words = Words(raw, offsets, SPACE_WORDS)
        number = self._numbers(words)
        total = np.concatenate(([0], np.cumsum(self.words.lengths()[number])))
        lengths = np.diff(total[words.first]) + 1
        out = np.full(int(lengths.sum()), END, np.uint32)
        body = np.ones(len(out), bool)
        body[np.cumsum(lengths) - 1] = False
        out[body] = self.words.gather(number)
        return out, lengths


class _Growing:
    """An array that grows at its end."""

    def __init__(self, dtype: type) -> None:
        self.room, self.n = np.zeros(1 << 12, dtype), 0

    def add(self, x: np.ndarray) -> None:
        if self.n + len(x) > len(self.room):
            self.room = np.concatenate((self.room[: self.n], np.zeros(max(self.n, 2 * len(x)), self.room.dtype)))
        self.room[self.n : self.n + len(x)] = x
        self.n += len(x)

    def all(self) -> np.ndarray:
        return self.room[: self.n]


class _Lists:
    """Lists of ids by number."""

    def __init__(self) -> None:
        self.flat, self.first, self.length = _Growing(np.uint32), _Growing(np.int64), _Growing(np.int64)

    @property
    def size(self) -> int:
        return self.first.n

    def add(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        self.first.add(self.flat.n + np.cumsum(lengths) - lengths)
        self.length.add(lengths)
        self.flat.add(flat)

    def lengths(self) -> np.ndarray:
        return self.length.all()

    def gather(self, numbers: np.ndarray) -> np.ndarray:
        """The lists of these numbers, one after another."""
        each = self.lengths()[numbers]
        total = np.cumsum(each)
        return self.flat.all()[np.repeat(self.first.all()[numbers] - total + each, each) + np.arange(int(total[-1]) if len(total) else 0)]


#: Kept by a Python worker from task to task.
_encoders: dict[str, _Encoder] = {}


_SHARD = "shard int, seq long, before long, doc_ids array<long>, n_tokens array<long>, n_ids long, payload binary, index binary"


def write_tokens(docs: DataFrame, tokenizer: str, path: str) -> None:
    """Writes the ids of ``docs(doc_id, text)`` to ``path`` as shards in ascending order of doc_id, null first.

    Rows of one doc_id follow each other in the order of their texts.
    """
    n = partitions(docs.sparkSession)
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, seq = TaskContext.get().partitionId(), 0
        if tokenizer not in _encoders:
            _encoders[tokenizer] = _Encoder(tokenizer)
        encoder = _encoders[tokenizer]
        ids: list[np.ndarray] = []
        names: list = []
        lengths: list[np.ndarray] = []
        held = before = 0

        def flush() -> pa.RecordBatch:
            flat = np.concatenate(ids)
            payload, index = encode(flat)
            kept = np.concatenate(lengths)
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([seq], pa.int64()), pa.array([before], pa.int64()), pa.array([names], pa.list_(pa.int64())), pa.array([kept], pa.list_(pa.int64())), pa.array([len(flat)], pa.int64()), pa.array([payload], pa.binary()), pa.array([index], pa.binary())],
                ["shard", "seq", "before", "doc_ids", "n_tokens", "n_ids", "payload", "index"],
            )

        for batch in batches:
            raw, offsets = strings(batch.column(1))
            of = batch.column(0).to_pylist()
            for i, j in slices(offsets):
                flat, k = encoder.ids(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                ids.append(flat)
                lengths.append(k)
                names += of[i:j]
                held += len(flat)
                if held >= SHARD_IDS:
                    yield flush()
                    seq, before, held = seq + 1, before + held, 0
                    ids, names, lengths = [], [], []
        if names:
            yield flush()

    ordered.mapInArrow(run, _SHARD).write.mode("overwrite").parquet(path)


def _shards(spark: SparkSession, path: str) -> tuple[DataFrame, Broadcast]:
    """The shards, and the number of ids before each task's first one.

    The sums are one row for each task that wrote, whatever it wrote.
    """
    shards = spark.read.schema(_SHARD).parquet(path)
    before, base = 0, {}
    for shard, k in sorted((r[0], r[1]) for r in shards.groupBy("shard").agg(F.sum("n_ids")).collect()):
        base[shard] = before
        before += k
    return shards, spark.sparkContext.broadcast(base)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Documents of the shards: doc_id, start (ids of all documents before it), n_tokens, ids."""
    shards, sent = _shards(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard, before, n_ids, payload, index = (batch.column(i)[row].as_py() for i in (0, 2, 5, 6, 7))
                names = batch.column(3)[row].values
                counts = batch.column(4)[row].values.to_numpy(zero_copy_only=False)
                ids = decode(payload, index, n_ids).astype("<u4")
                ends = np.cumsum(counts)
                base = sent.value[shard] + before
                for i in range(0, len(counts), 256):
                    k = counts[i : i + 256]
                    first = int(ends[i] - counts[i])
                    offsets = np.concatenate(([0], np.cumsum(k)))
                    flat = ids[first : first + int(offsets[-1])]
                    listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat.view(np.int32)))
                    yield pa.RecordBatch.from_arrays([names.slice(i, 256), pa.array(base + first + offsets[:-1]), pa.array(k), listed], ["doc_id", "start", "n_tokens", "ids"])

    return shards.mapInArrow(run, "doc_id long, start long, n_tokens long, ids array<int>")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of the shards' documents; the ids stay in the task."""
    shards, sent = _shards(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard, before, n_ids, payload, index = (batch.column(i)[row].as_py() for i in (0, 2, 5, 6, 7))
                counts = batch.column(4)[row].values.to_numpy(zero_copy_only=False)
                data = memoryview(decode(payload, index, n_ids).astype("<u4").tobytes())
                ends = np.cumsum(counts)
                starts = ends - counts
                crc = np.fromiter((zlib.crc32(data[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)), np.int64, len(counts))
                yield pa.RecordBatch.from_arrays([batch.column(3)[row].values, pa.array(sent.value[shard] + before + starts), pa.array(counts), pa.array(crc)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenise(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Writes the shards of ``docs(doc_id, text)`` and reads them back: doc_id, start, n_tokens, ids_crc32.

    Every row gives the ids of its text and the end id; a null or empty text
    gives the end id alone.  Null doc_ids come first; rows of one doc_id are
    ordered by their texts' hashes; an empty table gives no rows; extra columns
    are ignored.
    """
    spark = docs.sparkSession
    path = path or scratch(spark, "tokens")
    write_tokens(docs, tokenizer, path)
    return read_digests(spark, path)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenise(table(spark, sf_dir, "documents"), vocabulary())


QUERIES = {"op4_token_blocks": query}
ORACLES: dict[str, str] = {}
