"""Byte-level BPE encoding and decoding.

`encode` adds the packed token ids of each text (little-endian unsigned 32-bit), `decode` turns
packed ids back into bytes. Both are one map over the rows: no shuffle, nothing collected, and
the vocabulary (tens of thousands of entries, a file of fixed size) is broadcast once.

How a pre-token is encoded: its bytes are read as Latin-1, an Aho-Corasick automaton over the
vocabulary finds at each position the longest token, and a backtracking search goes through
them from left to right. A token may follow another only if merging by rank would leave
exactly those two when given their joined bytes; this is found by undoing merges and is
remembered for each pair. Where no longest token fits, its longest prefix in the vocabulary is
tried, and a position from which nothing fits is never tried again, so the time is linear in
the length, even for a pre-token of a million bytes. The result is that of the exact merges.

Edge cases: null and empty texts give no ids; repeated rows give repeated results; an empty
table gives an empty table; all columns of the input stay, and a column that has the
output's name is replaced. Ids outside the vocabulary raise ValueError in `decode`.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_arrow, texts
from .pretoken import BYTE_LEVEL, splitter

#: Pre-tokens, and pairs of tokens, that a worker remembers at most; results don't depend on it.
CACHED, PAIRS, CACHED_CHARS = 400_000, 1_000_000, 48


def read_ranks(path: str) -> bytes:
    """A rank file (base64 token, space, rank), read on the driver."""
    with open(path, "rb") as file:
        return file.read()


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes to rank."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


class Encoder:
    """Exact merges by rank over one vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.rank = {token.decode("latin-1"): i for token, i in ranks.items()}
        self.text = {i: token for token, i in self.rank.items()}
        self.automaton = ahocorasick.Automaton()
        self.shorter: dict[int, int] = {}  # the longest token that is a proper prefix
        self.halves: dict[int, tuple[int, int]] = {}  # what a token was merged from
        self.whole: dict[tuple[int, int], int] = {}  # what two tokens merge into
        self.follows: dict[int, bool] = {}
        reachable = []
        for i, token in self.text.items():
            at = len(token) - 1
            while at > 0 and token[:at] not in self.rank:
                at -= 1
            if at > 0:
                self.shorter[i] = self.rank[token[:at]]
        for i, token in sorted(self.text.items()):
            if len(token) == 1:
                self.halves[i] = (i, i)
                reachable.append(i)
                continue
            left = self.shorter.get(i)
            while left is not None:
                right = self.rank.get(token[len(self.text[left]) :])
                if right is not None and left < i and right < i and left in self.halves and right in self.halves and self._fits(left, right):
                    self.halves[i], self.whole[left, right] = (left, right), i
                    reachable.append(i)
                    break
                left = self.shorter.get(left)
        # A token that no merges lead to is only ever a whole pre-token.
        self.unreachable = {self.text[i] for i in self.text.keys() - set(reachable)}
        for i in reachable:
            self.automaton.add_word(self.text[i], i)
        self.automaton.make_automaton()
        self.long = [0] * (max(self.text, default=-1) + 1)
        for i, token in self.text.items():
            self.long[i] = len(token)
        for i, left in list(self.shorter.items()):
            while left is not None and left not in self.halves:
                left = self.shorter.get(left)
            if left is None:
                del self.shorter[i]
            else:
                self.shorter[i] = left

    def _fits(self, left: int, right: int) -> bool:
        """Whether merging the joined bytes of two tokens by rank ends with just these two.

        The last merges of either side are undone, the later one first; if two neighbours at the
        seam would have merged before the merge that is undone, the two don't stay apart.
        """
        halves, whole = self.halves, self.whole
        before = 1 << 62
        while True:
            merged = whole.get((left, right))
            if merged is not None and merged < before:
                return False
            if left > right:
                before, inner = left, halves[left][1]
                if inner == left:  # a single byte: nothing to undo on this side
                    before, inner = right + 1, halves[right][0]
                    if inner == right:
                        return True
                    right = inner
                else:
                    left = inner
            else:
                before, inner = right + 1, halves[right][0]
                if inner == right:
                    before, inner = left, halves[left][1]
                    if inner == left:
                        return True
                    left = inner
                else:
                    right = inner

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        text = piece.decode("latin-1")
        found = self.rank.get(text)
        if found is not None:
            return [found]
        size, long, shorter, follows = len(text), self.long, self.shorter, self.follows
        longest = [-1] * size
        for end, i in self.automaton.iter(text):
            longest[end + 1 - long[i]] = i  # ends come in order: the longest stays
        dead = bytearray(size + 1)
        out: list[int] = []
        at, last = 0, -1
        i = longest[0] if size else -1
        while at < size:
            end = at + long[i]
            if not dead[end]:
                key = last << 32 | i
                fits = last < 0 or follows.get(key)
                if fits is None:
                    if len(follows) >= PAIRS:
                        follows.clear()
                    fits = follows[key] = self._fits(last, i)
                if fits:
                    out.append(i)
                    last = i
                    at = end
                    if at < size:
                        i = longest[at]
                    continue
            i = shorter.get(i, -1)
            if i < 0:  # nothing fits here: go back to the token before
                dead[at] = 1
                i = out.pop()
                at -= long[i]
                last = out[-1] if out else -1
        return out


class _Packed(dict):
    """Pre-token to its packed ids; what is missing is encoded, short ones are remembered."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        ids = pack(self.encoder.encode_piece(piece.encode("utf-8", "surrogatepass")))
        if len(piece) <= CACHED_CHARS:
            if len(self) >= CACHED:
                self.clear()
            self[piece] = ids
        return ids


def pack(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if out.itemsize != 4 or __import__("sys").byteorder != "little":
        import struct

        return struct.pack(f"<{len(ids)}I", *ids)
    return out.tobytes()


def unpack(data: bytes) -> list[int]:
    """What `pack` packed."""
    import struct

    return list(struct.unpack(f"<{len(data) // 4}I", data))


_worker: dict = {}


def encoder_for(data: bytes, pattern: str) -> Callable[[str], bytes]:
    """This worker's function from a text to its packed ids."""
    key = (hash(data), len(data), pattern)
    if key not in _worker:
        _worker.clear()
        ids, split = _Packed(Encoder(parse_ranks(data))), splitter(pattern)
        _worker[key] = lambda text: b"".join(map(ids.__getitem__, split(text)))
    return _worker[key]


def _with(df: DataFrame, column: str, kind: T.DataType) -> tuple[list[str], T.StructType]:
    kept = [f for f in df.schema.fields if f.name != column]
    return [f.name for f in kept], T.StructType([*kept, T.StructField(column, kind)])


def _appended(batch: pa.RecordBatch, names: list[str], column: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), column], [*names, "out"])


def encode(df: DataFrame, ranks: bytes, text: str = "text", out: str = "ids", pattern: str = BYTE_LEVEL) -> DataFrame:
    """`df` with the packed ids of `text` in the binary column `out`; `ranks`: a rank file's bytes."""
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    names, schema = _with(df, out, T.BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = encoder_for(shared.value, pattern)
        for batch in batches:
            made = pa.array([ids(x) for x in texts(batch.column(batch.schema.get_field_index(text)))], pa.binary())
            yield _appended(batch, names, made).rename_columns([*names, out])

    return map_arrow(df, run, schema)


def decode(df: DataFrame, ranks: bytes, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """`df` with the bytes that the packed `ids` stand for in the binary column `out`."""
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    names, schema = _with(df, out, T.BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        tokens = {i: token for token, i in parse_ranks(shared.value).items()}
        table = [tokens.get(i) for i in range(max(tokens, default=-1) + 1)]
        for batch in batches:
            made = []
            for x in batch.column(batch.schema.get_field_index(ids)).to_pylist():
                try:
                    made.append(b"".join(map(table.__getitem__, np.frombuffer(x or b"", "<u4").tolist())))
                except (IndexError, TypeError):
                    raise ValueError("an id is not in the vocabulary") from None
            yield _appended(batch, names, pa.array(made, pa.binary())).rename_columns([*names, out])

    return map_arrow(df, run, schema)
