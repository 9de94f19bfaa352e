"""Append logs: frames of two 64-bit little-endian lengths, key, value.

Read by spark.read.format("kvlog").load("/path/*.log"). Columns: path, k, rec. An incomplete last
frame, as a crash leaves it, is dropped. One partition per file; a file is read in pieces.

Written by df.select("k", "rec").write.format("kvlog").mode("append").save("/folder"): a log per task, which gets its
final name when all tasks are done. A path without scheme is in the default file system; pyarrow must be able to open it.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .shared import qualified

PIECE = 4 << 20
ROWS = 4096
SCHEMA = pa.schema([("path", pa.string()), ("k", pa.binary()), ("rec", pa.binary())])


def frame(key: bytes, rec: bytes) -> bytes:
    return struct.pack("<qq", len(key), len(rec)) + key + rec


def frames(stream) -> Iterator[tuple[bytes, bytes]]:
    held = b""
    while True:
        more = stream.read(PIECE)
        held, at = held + more, 0
        while len(held) - at >= 16:
            k, v = struct.unpack_from("<qq", held, at)
            if k < 0 or v < 0:
                raise ValueError("negative length in a log")
            if len(held) - at - 16 < k + v:
                break
            yield held[at + 16 : at + 16 + k], held[at + 16 + k : at + 16 + k + v]
            at += 16 + k + v
        held = held[at:]
        if not more:
            return


TEMPORARY = "."


def _absolute(path: str) -> str:
    """On the driver: with its scheme; patterns stay as they are."""
    spark = SparkSession.getActiveSession()
    if "://" in path or spark is None:
        return path if "://" in path else f"file://{path}"
    folder, _, name = path.rpartition("/")
    return f"{qualified(spark, folder or '/').rstrip('/')}/{name}"


class LogReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def _files(self) -> list[str]:
        from fnmatch import fnmatch

        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(self.path)
        scheme = self.path.split("://")[0] + "://"
        folder, _, name = at.rpartition("/")
        if any(c in name for c in "*?["):
            found = [f.path for f in store.get_file_info(fs.FileSelector(folder)) if fnmatch(f.base_name, name)]
        elif store.get_file_info(at).type == fs.FileType.Directory:
            found = [f.path for f in store.get_file_info(fs.FileSelector(at)) if f.is_file and not f.base_name.startswith(TEMPORARY)]
        else:
            found = [at]
        return [f"{scheme}{p}" for p in sorted(found)]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self._files()] or [InputPartition(None)]

    def read(self, partition: InputPartition):
        from pyarrow import fs

        if partition.value is None:
            return
        store, at = fs.FileSystem.from_uri(partition.value)
        with store.open_input_stream(at) as stream:
            rows: list[dict] = []
            for k, rec in frames(stream):
                rows.append({"path": partition.value, "k": k, "rec": rec})
                if len(rows) == ROWS:
                    yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)


@dataclass
class Written(WriterCommitMessage):
    temporary: str
    final: str


class LogWriter(DataSourceArrowWriter):
    """Each task writes a log under a hidden name; the driver gives all of them their names when every task is done."""

    def __init__(self, path: str, schema):
        if not {"k", "rec"} <= set(schema.names):
            raise ValueError("kvlog writes columns k and rec")
        self.path, self.at = path, (schema.names.index("k"), schema.names.index("rec"))

    def write(self, batches) -> Written:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(self.path)
        store.create_dir(base, recursive=True)
        name = uuid.uuid4().hex
        out = Written(f"{base}/{TEMPORARY}{name}.log", f"{base}/{name}.log")
        with store.open_output_stream(out.temporary) as stream:
            for batch in batches:
                for k, rec in zip(batch.column(self.at[0]).to_pylist(), batch.column(self.at[1]).to_pylist()):
                    stream.write(frame(k, rec))
        return out

    def commit(self, messages) -> None:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.path)
        for m in messages:
            if m is not None:
                store.move(m.temporary, m.final)

    def abort(self, messages) -> None:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.path)
        for m in messages:
            if m is not None:
                store.delete_file(m.temporary)


class LogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "kvlog"

    def schema(self) -> str:
        return "path string, k binary, rec binary"

    def reader(self, schema) -> LogReader:
        return LogReader(_absolute(self.options["path"]))

    def writer(self, schema, overwrite: bool) -> LogWriter:
        if overwrite:
            raise ValueError("logs are only appended to")
        return LogWriter(_absolute(self.options["path"]), schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LogSource)
