"""Webhook requests as a streaming source: the files that a receiver leaves in a folder, in the order of their names.

A receiver appends files of JSON lines (a request a line) and gives them names that ascend, such as times;
it moves a file into the folder when it is whole. An offset is the last name read and how many files the
folder held up to it, so a restart goes on where the checkpoint says; a file that turns up among those
already read is an error, not a silent loss. The driver lists names and sizes only, tasks read the files; a large file is
many tasks, each with the lines that begin in its range of bytes.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..session import ship

#: Fields of a request; rows of an Arrow batch; files and bytes of a partition.
FIELDS = ("id", "kind", "address", "us", "api_key", "content_type", "body")
BATCH, FILES, BYTES = 1_000, 256, 8 << 20


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


def request(line: str) -> tuple:
    """A line's fields; a line that is no JSON object is a request whose body can't be read."""
    try:
        found = json.loads(line)
    except ValueError:
        found = None
    if not isinstance(found, dict):
        return (*[None] * (len(FIELDS) - 1), line)
    text = lambda v: v if v is None or isinstance(v, str) else json.dumps(v)
    us = found.get("us")
    whole = isinstance(us, int) and not isinstance(us, bool) and abs(us) < 1 << 63
    return tuple((us if whole else None) if name == "us" else text(found.get(name)) for name in FIELDS)


class Files(InputPartition):
    """Some of a folder's files, or a range of a large one, one after the other: path, first byte, byte after the last."""

    def __init__(self, pieces: list[tuple[str, int, int]]):
        self.pieces = pieces


def lines(f: io.BufferedReader, start: int, end: int) -> Iterator[str]:
    """The lines that begin in a range of bytes."""
    at = start
    if start:  # a line that begins before is another range's
        f.seek(start - 1)
        at += len(f.readline()) - 1
    while at < end and (line := f.readline()):
        at += len(line)
        yield line.decode("utf-8", "replace").rstrip("\r\n")


class _Stream(DataSourceStreamReader):
    def __init__(self, folder: str):
        self.folder = folder

    def _list(self) -> list[fs.FileInfo]:
        store, path = _at(self.folder)
        found = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
        return sorted((f for f in found if f.is_file and not f.base_name.startswith((".", "_"))), key=lambda f: f.base_name)

    def initialOffset(self) -> dict:
        return {"at": "", "files": 0}

    def latestOffset(self) -> dict:
        found = self._list()
        return {"at": found[-1].base_name, "files": len(found)} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        found = self._list()
        if sum(f.base_name <= start["at"] for f in found) > start["files"]:
            raise ValueError(f"a file came to {self.folder} with a name not after {start['at']}, which was read before")
        out, size = [], 0
        for f in found:
            if start["at"] < f.base_name <= end["at"]:
                for low in range(0, max(f.size, 1), BYTES):
                    high = min(low + BYTES, f.size)
                    if not out or size + high - low > BYTES or len(out[-1].pieces) >= FILES:
                        out.append(Files([]))
                        size = 0
                    out[-1].pieces.append((f.path, low, high))
                    size += high - low
        return out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = _at(self.folder)
        kinds = [pa.int64() if name == "us" else pa.string() for name in FIELDS]
        for path, start, end in partition.pieces:
            with store.open_input_file(path) as f, io.BufferedReader(f) as read:
                found = (request(line) for line in lines(read, start, end) if line.strip())
                while rows := list(islice(found, BATCH)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], list(FIELDS))


class RequestFiles(DataSource):
    """The format "request_files"; the option `path` is the folder."""

    @classmethod
    def name(cls) -> str:
        return "request_files"

    def schema(self) -> str:
        return ", ".join(f"{name} {'long' if name == 'us' else 'string'}" for name in FIELDS)

    def streamReader(self, schema) -> _Stream:
        return _Stream(self.options["path"])


def stream_requests(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the requests that a receiver leaves in a folder, as `evidence.received` takes them."""
    ship(spark)
    spark.dataSource.register(RequestFiles)
    return spark.readStream.format("request_files").load(path)
