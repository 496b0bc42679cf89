"""Server-sent events as a data source: files of a folder in batch or as a stream, and a writer that commits whole files.

    spark.dataSource.register(ServerSentEvents)
    spark.read.format("sse").load(folder)        # file, seq, event, data
    df.write.format("sse").mode("append").save(folder)  # columns event and data
    df.write.format("sse").option("compression", "zstd").mode("append").save(folder)  # or gzip; readers go by a file's ending

Files are read where tasks run, so the folder is one that all machines mount.
Names ascend with their commits, which is what a stream goes by.  Both ways go
in pieces, so a task holds a few MB and one event, however long a file is; a
task writes several files once one has ``FILE_BYTES`` of text.
"""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage

ENDS = {"none": ".sse", "gzip": ".sse.gz", "zstd": ".sse.zst"}
PIECE_BYTES = 1 << 20
FILE_BYTES = 64 << 20


def parse(text: str) -> Iterator[tuple[str | None, str]]:
    """(event, data) of each block; comments, blocks without data and the end mark are skipped."""
    return _parse(text.replace("\r\n", "\n"))


def _parse(text: str) -> Iterator[tuple[str | None, str]]:
    for block in text.split("\n\n"):
        event, data = None, []
        for line in block.split("\n"):
            name, _, value = line.partition(":")
            value = value.removeprefix(" ")
            if name == "data":
                data.append(value)
            elif name == "event":
                event = value
        if data and data != ["[DONE]"]:
            yield event, "\n".join(data)


def blocks(event: pa.Array | None, data: pa.Array) -> pa.Array:
    """Events as text; every line of data has a field of its own."""
    if data.null_count:
        raise ValueError("an event needs data")
    text = lambda x: x.cast(pa.large_string())
    said = lambda x: pa.scalar(x, pa.large_string())
    head = said("") if event is None else pc.fill_null(pc.binary_join_element_wise(said("event: "), text(event), said("\n"), said("")), "")
    return pc.binary_join_element_wise(head, said("data: "), pc.replace_substring(text(data), "\n", "\ndata: "), said("\n\n"), said(""))


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.path = path


@dataclass
class _Written(WriterCommitMessage):
    paths: list[str]


class ServerSentEvents(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sse"

    def schema(self) -> str:
        return "file string, seq int, event string, data string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(_local(self.options["path"]))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(_local(self.options["path"]))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(_local(self.options["path"]), self._compression(), overwrite)

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamArrowWriter:
        return _StreamWriter(_local(self.options["path"]), self._compression())

    def _compression(self) -> str:
        found = self.options.get("compression", "none")
        if found not in ENDS:
            raise ValueError(f"compression is one of {', '.join(ENDS)}, not {found}")
        return found


def _local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


def _names(path: str) -> list[str]:
    return sorted(x for x in os.listdir(path) if x.endswith(tuple(ENDS.values()))) if os.path.isdir(path) else []


def _pieces(source: pa.NativeFile) -> Iterator[str]:
    """The text between blank lines, some ``PIECE_BYTES`` at a time; what is read grows with a block that has no end yet."""
    rest = cr = b""
    while chunk := source.read(max(PIECE_BYTES, len(rest))):
        chunk = cr + chunk
        cr = b"\r" if chunk.endswith(b"\r") else b""  # the line end may go on
        text = rest + chunk[: len(chunk) - len(cr)].replace(b"\r\n", b"\n")
        cut = text.rfind(b"\n\n")
        if cut >= 0:
            yield text[:cut].decode("utf-8", "replace")
        rest = text[cut + 2 :] if cut >= 0 else text
    yield (rest + cr).decode("utf-8", "replace")


def _columns(text: str) -> tuple[pa.Array, pa.Array]:
    """event and data of blocks, over whole columns where a block has at most one of either; else line by line."""
    by_block = pc.split_pattern(pc.split_pattern(pa.array([text], pa.large_string()), "\n\n").flatten(), "\n")
    lines, block = by_block.flatten(), pc.list_parent_indices(by_block).to_numpy()
    bare = pc.any(pc.is_in(lines, pa.array(["data", "event"], pa.large_string()))).as_py()
    at, values = {}, {}
    for name in ("data", "event"):
        has = pc.starts_with(lines, f"{name}:")
        found, n = lines.filter(has), len(name) + 1
        spaced, found = pc.starts_with(found, f"{name}: "), found.cast(pa.large_binary())
        if not pc.all(spaced).as_py():
            found = pc.if_else(spaced, found, pc.binary_replace_slice(found, n, n, b" "))
        values[name] = pc.binary_replace_slice(found, 0, n + 1, b"").cast(pa.string())
        at[name] = block[has.to_numpy(zero_copy_only=False)]
    if bare or any((x[1:] == x[:-1]).any() for x in at.values()):
        rows = list(_parse(text))
        return pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())
    event, data = values["event"], values["data"]
    if not np.array_equal(at["event"], at["data"]):
        place = np.full(len(by_block), -1)
        place[at["event"]] = np.arange(len(event))
        place = place[at["data"]]
        event = event.take(pa.array(place, mask=place < 0))
    said = pc.not_equal(data, "[DONE]")
    return event.filter(said), data.filter(said)


def _rows(path: str) -> Iterator[pa.RecordBatch]:
    with pa.input_stream(path, compression="detect") as source:
        seq, name = 0, os.path.basename(path)
        for text in _pieces(source):
            event, data = _columns(text)
            if n := len(data):
                yield pa.RecordBatch.from_arrays([pa.repeat(name, n), pa.array(range(seq, seq + n), pa.int32()), event, data], ["file", "seq", "event", "data"])
                seq += n


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [_File(f"{self.path}/{x}") for x in _names(self.path)]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        return _rows(partition.path) if partition is not None and getattr(partition, "path", None) else iter(())


class _StreamReader(DataSourceStreamReader):
    """An offset is the name of the last file."""

    def __init__(self, path: str) -> None:
        self.path = path

    def initialOffset(self) -> dict:
        return {"file": ""}

    def latestOffset(self) -> dict:
        return {"file": max(_names(self.path), default="")}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_File(f"{self.path}/{x}") for x in _names(self.path) if start["file"] < x <= end["file"]]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        return _rows(partition.path)


class _Writing:
    """Tasks write files that no reader takes; the commit gives them their names in order, or deletes them."""

    path: str
    compression: str

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        os.makedirs(self.path, exist_ok=True)
        paths: list[str] = []
        out, n = None, 0
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                if out is None:
                    paths.append(f"{self.path}/.tmp-{uuid.uuid4().hex}")
                    out, n = pa.output_stream(paths[-1], compression=None if self.compression == "none" else self.compression), 0
                text = blocks(batch.column("event") if "event" in batch.schema.names else None, batch.column("data"))
                out.write(text.buffers()[2])
                n += text.buffers()[2].size
                if n >= FILE_BYTES:
                    out.close()
                    out = None
            if out is not None:
                out.close()
        except BaseException:
            self._drop([_Written(paths)])
            raise
        return _Written(paths)

    def _name(self, messages: list[_Written | None], prefix: str) -> None:
        for k, message in enumerate(messages):
            for i, path in enumerate(message.paths if message is not None else []):
                os.replace(path, f"{self.path}/{prefix}-{k:06d}-{i:06d}{ENDS[self.compression]}")

    def _drop(self, messages: list[_Written | None]) -> None:
        for message in messages:
            for path in message.paths if message is not None else []:
                if os.path.exists(path):
                    os.remove(path)


class _Writer(_Writing, DataSourceArrowWriter):
    def __init__(self, path: str, compression: str, overwrite: bool) -> None:
        self.path, self.compression, self.overwrite = path, compression, overwrite

    def commit(self, messages: list) -> None:
        if self.overwrite:
            for x in _names(self.path):
                os.remove(f"{self.path}/{x}")
        self._name(messages, f"{time.time_ns():020d}")

    def abort(self, messages: list) -> None:
        self._drop(messages)


class _StreamWriter(_Writing, DataSourceStreamArrowWriter):
    """A micro-batch that comes again writes files of the same names, as many rows and tasks as it had."""

    def __init__(self, path: str, compression: str) -> None:
        self.path, self.compression = path, compression

    def commit(self, messages: list, batchId: int) -> None:
        prefix = f"{batchId:020d}"
        for x in _names(self.path):
            if x.startswith(prefix):
                os.remove(f"{self.path}/{x}")
        self._name(messages, prefix)

    def abort(self, messages: list, batchId: int) -> None:
        self._drop(messages)
