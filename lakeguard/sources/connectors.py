"""A connector of one's own: Arrow IPC files as a Spark source and sink.

It shows the interface that further connectors follow: a ``DataSource`` class, registered with the session
by ``register``, read and written by its name like any built-in format.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

if TYPE_CHECKING:
    import pyarrow as pa


def _place(path: str) -> tuple:
    """The file system of a path or URI and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _manifests(path: str) -> list[dict]:
    """What committed writes have left; a folder without any, or no folder, gives an empty list."""
    from pyarrow import fs

    system, folder = _place(path)
    found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    out = []
    for info in sorted(found, key=lambda i: i.path):
        if info.base_name.startswith("manifest-"):
            with system.open_input_stream(info.path) as f:
                out.append(json.loads(f.read()) | {"manifest": info.base_name})
    return out


@dataclass
class _File(InputPartition):
    name: str


@dataclass
class _Written(WriterCommitMessage):
    name: str | None


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[_File]:
        return [_File(name) for m in _manifests(self.path) for name in m["files"]] or [_File("")]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        if not partition.name:
            return
        system, folder = _place(self.path)
        with system.open_input_file(f"{folder}/{partition.name}") as f, pa.ipc.open_file(f) as batches:
            for i in range(batches.num_record_batches):
                yield batches.get_batch(i)


class _Writer(DataSourceArrowWriter):
    """Each task attempt writes a file of its own name; only files that the commit lists are ever read.

    So a repeated or a lost task leaves no rows twice and none half written.
    """

    def __init__(self, path: str, schema: StructType, overwrite: bool):
        self.path, self.schema, self.overwrite = path, schema.json(), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        import pyarrow as pa

        first = next(iterator, None)
        if first is None:
            return _Written(None)
        system, folder = _place(self.path)
        system.create_dir(folder, recursive=True)
        name = f"part-{uuid.uuid4().hex}.arrow"
        with system.open_output_stream(f"{folder}/{name}") as f, pa.ipc.new_file(f, first.schema) as out:
            out.write_batch(first)
            for batch in iterator:
                out.write_batch(batch)
        return _Written(name)

    def commit(self, messages: list[_Written | None]) -> None:
        system, folder = _place(self.path)
        system.create_dir(folder, recursive=True)
        old = _manifests(self.path) if self.overwrite else []
        draft, name = f"{folder}/draft-{uuid.uuid4().hex}", f"{folder}/manifest-{uuid.uuid4().hex}"
        with system.open_output_stream(draft) as f:
            f.write(json.dumps({"schema": self.schema, "files": [m.name for m in messages if m and m.name]}).encode())
        system.move(draft, name)
        for m in old:
            system.delete_file(f"{folder}/{m['manifest']}")
            for gone in m["files"]:
                system.delete_file(f"{folder}/{gone}")

    def abort(self, messages: list[_Written | None]) -> None:
        system, folder = _place(self.path)
        for m in messages:
            if m and m.name:
                system.delete_file(f"{folder}/{m.name}")


class ArrowFiles(DataSource):
    """``spark.read.format("arrow_files").load(path)`` and ``df.write.format("arrow_files").mode(…).save(path)``."""

    @classmethod
    def name(cls) -> str:
        return "arrow_files"

    def schema(self) -> StructType:
        found = _manifests(self.options["path"])
        if not found:
            raise FileNotFoundError(f"no committed Arrow files in {self.options['path']}")
        return StructType.fromJson(json.loads(found[-1]["schema"]))

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], schema, overwrite)


def register(spark: SparkSession, source: type[DataSource] = ArrowFiles) -> None:
    """Makes a connector known to the session by its name."""
    spark.dataSource.register(source)
