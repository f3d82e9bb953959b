"""Files of a mounted volume as a data source: listed by tasks, read as far as asked.

A volume is a folder that every executor sees under the same path. The driver
only counts out slots; each task goes through the folder's names, takes those
whose hash falls into its slot (with all that is below them), and looks at these
alone. Of a file no more than the asked bytes are read, whatever its size.
"""

from __future__ import annotations

import os
import stat
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from weftline.packaging import ship

SCHEMA = "path string, is_directory boolean, length bigint, modified timestamp, content binary, error string"
#: Rows and content bytes of a batch.
_ROWS, _BYTES = 1_000, 16 << 20


class _Slot(InputPartition):
    """The names with this number modulo the number of slots."""


class VolumeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root = os.path.normpath(options["path"].removeprefix("file:"))
        if self.root.startswith("//"):
            self.root = self.root[1:]
        self.slots = max(1, int(options.get("slots", "1")))
        self.bytes = int(options.get("bytes", "0"))
        self.deep = options.get("recursive", "true").lower() == "true"
        self.hidden = options.get("hidden", "false").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        return [_Slot(n) for n in range(self.slots)]

    def _entries(self, slot: int) -> Iterator[tuple[str, os.stat_result | None, str | None]]:
        """Path, state and problem of everything in the slot; a folder that cannot be listed has a problem."""
        folders = [self.root]
        while folders:
            folder = folders.pop()
            try:
                with os.scandir(folder) as found:
                    for entry in found:
                        if folder == self.root and zlib.crc32(os.fsencode(entry.name)) % self.slots != slot:
                            continue
                        if not self.hidden and _is_hidden(entry.name):
                            continue
                        try:
                            state = entry.stat()
                        except OSError as problem:
                            yield entry.path, None, str(problem)
                            continue
                        if stat.S_ISDIR(state.st_mode) and self.deep and not entry.is_symlink():
                            folders.append(entry.path)
                        yield entry.path, state, None
            except NotADirectoryError:
                if slot == 0:
                    yield self.root, os.stat(self.root), None
            except OSError as problem:
                if folder != self.root or slot == 0:
                    yield folder, None, str(problem)

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for path, state, problem in self._entries(partition.value):
            content, folder = None, state is not None and stat.S_ISDIR(state.st_mode)
            if self.bytes and state is not None and stat.S_ISREG(state.st_mode):
                try:
                    with open(path, "rb") as file:
                        content = file.read(self.bytes)
                except OSError as unread:
                    problem = str(unread)
            size = None if state is None or folder else state.st_size
            when = None if state is None else datetime.fromtimestamp(state.st_mtime, UTC)
            rows.append((path, folder, size, when, content, problem))
            held += len(content or b"")
            if len(rows) >= _ROWS or held >= _BYTES:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)


def _is_hidden(name: str) -> bool:
    """What Spark's own readers leave out."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.bool_(), pa.int64(), pa.timestamp("us", "UTC"), pa.binary(), pa.string()]
    names = ["path", "is_directory", "length", "modified", "content", "error"]
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


class VolumeFiles(DataSource):
    """``spark.read.format("weftline_volume")`` with options path, bytes, recursive, hidden and slots."""

    @classmethod
    def name(cls) -> str:
        return "weftline_volume"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return VolumeReader(dict(self.options))


def volume_files(
    spark: SparkSession, path: str, max_bytes: int = 0, recursive: bool = True, hidden: bool = False, slots: int | None = None
) -> DataFrame:
    """``(path, is_directory, length, modified, content, error)`` of everything below a mounted folder.

    ``content`` holds the first ``max_bytes`` of each file, or is null for 0. A
    folder or file that cannot be read is a row with an ``error``; the others still
    count. Links are listed and not followed. Names that begin with a full stop or an underscore are left
    out without ``hidden``. ``slots`` is the number of tasks.
    """
    ship(spark)
    spark.dataSource.register(VolumeFiles)
    slots = slots or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    reader = spark.read.format("weftline_volume").option("bytes", max_bytes).option("recursive", str(recursive).lower())
    return reader.option("hidden", str(hidden).lower()).option("slots", slots).load(path)
