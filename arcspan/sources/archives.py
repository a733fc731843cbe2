"""ZIP archives as a Spark data source: a partition is one large member or many small ones, read as streams.

The driver reads the archives' directories only, several at once; a task opens its archives where they lie (a
local or shared folder, HDFS or an object store, by the URI), seeks to its members and passes their records on in
batches. Small members of many go together up to `TOGETHER` bytes, so tasks follow the input and not the number of files.
So what a task holds is one batch, however large the archive or the member; what can't be told from
its beginning (a YAML file, a JSON value over several lines that is no array) is one value and is held whole.
"""

from __future__ import annotations

import csv
import io
import json
import zipfile
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from itertools import groupby, islice
from typing import IO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Files of an archive that are telemetry (fixed values); records of a batch; characters read at once.
TELEMETRY = (".json", ".jsonl", ".ndjson", ".csv", ".yaml", ".yml")
BATCH, PIECE = 1_000, 1 << 16
#: Bytes of members (uncompressed) that one task reads at most, unless a single one is larger; tasks that smaller
#: inputs are dealt over; what opening a member counts; archives whose directories are read at a time.
TOGETHER, SPREAD, OPENING, READERS = 16 << 20, 256, 1 << 16, 16
#: Between an archive's path and a member's.
INSIDE = "::"


def flat(record: dict) -> dict[str, str]:
    """A record's plain keys, and dotted ones for what is nested and not null, as strings.

    A plain key with a dot in it is kept before a nested value of the same name.
    """
    out: dict[str, str] = {}
    stack = [("", record)]
    while stack:
        prefix, value = stack.pop(0)
        for k, v in value.items():
            if isinstance(v, dict):
                stack.append((f"{prefix}{k}.", v))
            elif v is not None or not prefix:
                out.setdefault(prefix + str(k), v if v is None or isinstance(v, str) else json.dumps(v))
    return out


def _elements(text: IO[str]) -> Iterator[object]:
    """The elements of a JSON array, one after the other; ValueError where it is none."""
    decoder, held, more = json.JSONDecoder(), "", True

    def fill() -> bool:
        nonlocal held, more
        piece = text.read(PIECE)
        held, more = held + piece, bool(piece)
        return more

    def skip() -> str:
        """The next character that is no space, empty at the end."""
        nonlocal held
        held = held.lstrip(" \t\r\n﻿")
        while not held and fill():
            held = held.lstrip(" \t\r\n﻿")
        return held[:1]

    if skip() != "[":
        raise ValueError("no array")
    held = held[1:]
    if skip() == "]":
        held = held[1:]
    else:
        while True:
            skip()
            while True:
                try:
                    value, end = decoder.raw_decode(held)
                except ValueError:
                    if not fill():
                        raise
                    continue
                # A number may go on in the next piece: what follows tells.
                if held[end:].lstrip(" \t\r\n")[:1] in (",", "]") or not fill():
                    break
            yield value
            held = held[end:]
            mark = skip()
            held = held[1:]
            if mark == "]":
                break
            if mark != ",":
                raise ValueError("no comma")
    if skip():
        raise ValueError("more than an array")


def records(name: str, open_: Callable[[], IO[bytes]]) -> Iterator[dict]:
    """The records of one telemetry file: a JSON array, JSON lines, CSV or YAML; bad lines go.

    `open_` opens the file, more than once where it takes a look to tell what it is.
    """
    low = name.lower()
    text = lambda **how: io.TextIOWrapper(open_(), "utf-8", "ignore", **how)
    if low.endswith((".yaml", ".yml")):
        import yaml

        with text() as f:
            try:
                found = yaml.safe_load(f)
            except yaml.YAMLError:
                found = []
        found = iter(found if isinstance(found, list) else [found])
    elif low.endswith(".csv"):
        found = _csv(text)
    else:
        found = _json(text)
    return (x for x in found if isinstance(x, dict))


def _csv(text: Callable[..., IO[str]]) -> Iterator[dict]:
    with text(newline="") as f:
        yield from csv.DictReader(f)


def _json(text: Callable[..., IO[str]]) -> Iterator[object]:
    try:
        with text() as f:  # an array that breaks off is no array, so all of it is looked at first
            whole = sum(1 for _ in _elements(f)) >= 0
    except ValueError:
        whole = False
    if whole:
        with text() as f:
            yield from _elements(f)
        return
    with text() as f:
        first = next((line for line in f if line.strip()), "")
    try:
        json.loads(first)
    except ValueError:
        with text() as f:
            try:
                found = json.loads(f.read())
                yield from found if isinstance(found, list) else [found]
                return
            except ValueError:
                pass
    with text() as f:
        for line in f:
            try:
                yield json.loads(line)
            except ValueError:
                continue


@contextmanager
def opened(uri: str) -> Iterator[zipfile.ZipFile]:
    """An archive, read where it lies."""
    store, path = fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")
    with store.open_input_file(path) as f, zipfile.ZipFile(f) as archive:
        yield archive


class Members(InputPartition):
    """Members (archive, name) that one task reads."""

    def __init__(self, members: list[tuple[str, str]]):
        self.members = members


class _Reader(DataSourceReader):
    def __init__(self, archives: list[str], endings: tuple[str, ...], member: str | None):
        self.archives, self.endings, self.member = archives, endings, member

    def _directory(self, uri: str) -> list[tuple[str, str, int]]:
        """Archive, name and size of the members to read; none of a file that is no archive."""
        try:
            with opened(uri) as archive:
                return [(uri, i.filename, i.file_size) for i in archive.infolist() if i.filename.lower().endswith(self.endings) and self.member in (None, i.filename)]
        except (zipfile.BadZipFile, pa.ArrowInvalid):  # the latter for files too short to be one
            return []

    def partitions(self) -> list[Members]:
        with ThreadPoolExecutor(READERS) as pool:
            found = [m for some in pool.map(self._directory, self.archives) for m in some]
        most = min(TOGETHER, sum(size + OPENING for _, _, size in found) // SPREAD)
        out, held = [], 0
        for uri, name, size in found:
            held += size + OPENING
            if not out or held > most:
                out.append(Members([]))
                held = size + OPENING
            out[-1].members.append((uri, name))
        return out

    def read(self, partition: Members) -> Iterator[pa.RecordBatch]:
        kind = pa.map_(pa.string(), pa.string())
        for uri, own in groupby(partition.members, lambda m: m[0]):
            with opened(uri) as archive:
                for _, member in own:
                    found = records(member, lambda: archive.open(member))
                    while batch := list(islice(found, BATCH)):
                        n = len(batch)
                        yield pa.RecordBatch.from_arrays([pa.array([f"{uri}{INSIDE}{member}"] * n), pa.array([uri] * n), pa.array([member] * n), pa.array([list(flat(r).items()) for r in batch], kind)], ["path", "archive", "member", "record"])


class ArchiveMembers(DataSource):
    """The format "archive_members". Options: archives, their URIs as a JSON list; endings, of members to read;
    member, to read only those of that name."""

    @classmethod
    def name(cls) -> str:
        return "archive_members"

    def schema(self) -> str:
        return "path string, archive string, member string, record map<string,string>"

    def reader(self, schema) -> _Reader:
        endings = tuple(json.loads(self.options.get("endings", json.dumps(TELEMETRY))))
        return _Reader(json.loads(self.options["archives"]), endings, self.options.get("member"))
