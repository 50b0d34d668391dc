"""A partitioned message log in a shared folder, as a Spark streaming source with offsets of its own.

A log is a folder with a subfolder ``partition=K`` for each partition.  Its
segments are files of JSON lines named by the numbers of their messages, first to
last, so the newest offset is known from names alone.  Producers append segments
under a draft name and rename them, so none is seen half written.

A reader's batch takes at most ``max_messages``.  The offsets up to which a group
of consumers has asked for messages are left in the log's ``groups`` folder, as a
stream that starts again has to ask for more than it has had; what was read and
what was not is kept by Spark's checkpoint alone.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from lakeguard.sources.connectors import _place
from lakeguard.sources.tables import parse_messages

if TYPE_CHECKING:
    import pyarrow as pa

SCHEMA = "partition int, offset long, key string, value string, timestamp timestamp"
#: Columns that messages may be spread over, at most: a schema is no place for more.
MOST_KEYS = 10_000


def _segments(path: str) -> dict[int, list[tuple[int, int, str]]]:
    """(first, end, file) of the segments of each partition, in order."""
    from pyarrow import fs

    system, folder = _place(path)
    out: dict[int, list[tuple[int, int, str]]] = {}
    for info in system.get_file_info(fs.FileSelector(folder, allow_not_found=True, recursive=True)):
        parent = info.path.rsplit("/", 2)[-2]
        if parent.startswith("partition="):
            held = out.setdefault(int(parent[10:]), [])
            if info.base_name.endswith(".jsonl"):
                first, end, _ = info.base_name[:-6].split("-")
                held.append((int(first), int(end), info.path))
    return {p: sorted(s) for p, s in out.items()}


def append_log(df: DataFrame, path: str, partitions: int, key: Column, value: Column, timestamp: Column) -> None:
    """Appends the rows as messages, dealt to the log's partitions by their keys, a task for each partition.

    Segments carry the write's own number in their names, so a task that is repeated
    sees that its first attempt is there already.  A log has one writer at a time.
    """
    write = uuid.uuid4().hex[:12]
    rows = df.select(F.pmod(F.xxhash64(key), F.lit(partitions)).cast("int").alias("partition"), key.cast("string").alias("key"), value.cast("string").alias("value"), F.unix_micros(timestamp.cast("timestamp")).alias("timestamp"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        system, folder = _place(path)
        out, number, count, draft = None, -1, 0, ""
        for batch in batches:
            for p, k, v, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    number = p
                    system.create_dir(f"{folder}/partition={p}", recursive=True)
                    draft = f"{folder}/partition={p}/{write}-{uuid.uuid4().hex}.draft"
                    out = system.open_output_stream(draft)
                out.write((json.dumps([k, v, t], ensure_ascii=False) + "\n").encode())
                count += 1
        if out is not None:
            out.close()
            there = _segments(path).get(number, [])
            if any(name.endswith(f"-{write}.jsonl") for _, _, name in there):
                system.delete_file(draft)
            else:
                first = there[-1][1] if there else 0
                system.move(draft, f"{folder}/partition={number}/{first:020d}-{first + count:020d}-{write}.jsonl")
        yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64())], ["n"])

    rows.repartitionById(partitions, "partition").mapInArrow(run, "n long").agg(F.sum("n")).collect()  # one number


@dataclass
class _Span(InputPartition):
    partition: int
    start: int
    end: int


def _read(path: str, span: _Span) -> Iterator[tuple]:
    from datetime import UTC, datetime, timedelta

    zero = datetime(1970, 1, 1, tzinfo=UTC)
    system, _ = _place(path)
    for first, end, name in _segments(path).get(span.partition, []):
        if end <= span.start or first >= span.end:
            continue
        with system.open_input_stream(name) as f:
            left = b""
            number = first
            while chunk := f.read(1 << 20):
                *lines, left = (left + chunk).split(b"\n")
                for line in lines:
                    if span.start <= number < span.end:
                        key, value, micros = json.loads(line)
                        yield span.partition, number, key, value, None if micros is None else zero + timedelta(microseconds=micros)
                    number += 1


class _StreamReader(DataSourceStreamReader):
    def __init__(self, path: str, group: str, most: int):
        self.path, self.group, self.most = path, group, most

    def _asked(self) -> str:
        return f"{_place(self.path)[1]}/groups/{self.group}.json"

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """As far as the group has asked and at most ``most`` messages on, dealt evenly to the partitions that have more."""
        from pyarrow import fs

        system, folder = _place(self.path)
        at = {}
        if system.get_file_info(self._asked()).type != fs.FileType.NotFound:
            with system.open_input_stream(self._asked()) as f:
                at = json.loads(f.read())
        newest = {str(p): s[-1][1] for p, s in _segments(self.path).items() if s}
        left = self.most
        behind = sorted(p for p in newest if newest[p] > at.get(p, 0))
        for i, p in enumerate(sorted(behind, key=lambda p: newest[p] - at.get(p, 0))):
            take = min(newest[p] - at.get(p, 0), -(-left // (len(behind) - i)))
            at[p] = at.get(p, 0) + take
            left -= take
        if behind:
            system.create_dir(f"{folder}/groups", recursive=True)
            draft = f"{self._asked()}-{uuid.uuid4().hex}"
            with system.open_output_stream(draft) as f:
                f.write(json.dumps(at).encode())
            system.move(draft, self._asked())
        return at

    def partitions(self, start: dict, end: dict) -> list[_Span]:
        return [_Span(int(p), start.get(p, 0), e) for p, e in sorted(end.items()) if e > start.get(p, 0)]

    def read(self, partition: _Span) -> Iterator[tuple]:
        return _read(self.path, partition)

    def commit(self, end: dict) -> None:
        pass


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[_Span]:
        return [_Span(p, s[0][0], s[-1][1]) for p, s in sorted(_segments(self.path).items()) if s] or [_Span(0, 0, 0)]

    def read(self, partition: _Span) -> Iterator[tuple]:
        return _read(self.path, partition)


class MessageLog(DataSource):
    """``format("message_log")`` with the options path, and for streams group and max_messages."""

    @classmethod
    def name(cls) -> str:
        return "message_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> _Reader:
        return _Reader(self.options["path"])

    def streamReader(self, schema: Any) -> _StreamReader:
        return _StreamReader(self.options["path"], self.options.get("group", "default"), int(self.options.get("max_messages", 10_000)))


def log_stream(spark: SparkSession, path: str, group: str, max_messages: int = 10_000) -> DataFrame:
    spark.dataSource.register(MessageLog)
    return spark.readStream.format("message_log").option("group", group).option("max_messages", max_messages).load(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """All messages of a log."""
    spark.dataSource.register(MessageLog)
    return spark.read.format("message_log").load(path)


def drain(start: Callable[[], StreamingQuery], most: int | None = None) -> int:
    """Runs a stream batch after batch until nothing is left or ``most`` messages are read; returns how many were.

    ``start`` starts a query that reads what is there once; each start goes on from
    the checkpoint of the last.
    """
    total = 0
    while most is None or total < most:
        query = start()
        query.awaitTermination()
        got = sum(max(p.numInputRows, 0) for p in query.recentProgress)
        if not got:
            break
        total += got
    return total


def event_columns(messages: DataFrame, key_field: str | None = None) -> DataFrame:
    """Adds ts and key to messages: the field ``timestamp`` (epoch seconds) and the key field of the value, else the message's own."""
    seconds = F.get_json_object("value", "$.timestamp").try_cast("double")
    key = F.coalesce(F.get_json_object("value", f"$.{key_field}"), F.col("key")) if key_field else F.col("key")
    return messages.withColumns({"ts": F.coalesce(F.timestamp_seconds(seconds), F.col("timestamp")), "key": key})


def message_keys(messages: DataFrame, value: str = "value") -> list[str]:
    """The names that the messages' JSON objects have, with _raw (no JSON) and _value (other JSON) where there are such, by name."""
    parsed = parse_messages(messages, value)
    names = F.array_union(F.coalesce(F.map_keys("_json"), F.array().cast("array<string>")), F.filter(F.array(F.when(F.col("_raw").isNotNull() | F.col(value).isNull(), "_raw"), F.when(F.col("_value").isNotNull(), "_value")), lambda x: x.isNotNull()))
    found = [r[0] for r in parsed.select(F.explode(names).alias("k")).distinct().limit(MOST_KEYS + 1).collect()]
    if len(found) > MOST_KEYS:
        raise ValueError(f"the messages have more than {MOST_KEYS} different keys")
    return sorted(found)


def key_columns(messages: DataFrame, value: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """A text column for each key of the messages' JSON objects; a message that is no object has _raw or _value instead."""
    parsed = parse_messages(messages, value)
    made = {"_raw": F.col("_raw"), "_value": F.col("_value")}
    return parsed.select(*keep, *[made.get(k, F.col("_json")[k]).alias(k) for k in message_keys(messages, value)])
