"""Token counts by a two-tier lookup of pre-token lengths.

First pass: each partition keeps its most frequent pre-tokens in a bounded summary (counters
that are lowered by the median when full, so memory is fixed); summaries, not pre-tokens, are merged, by
groups of partitions, until a few are left. The driver encodes the most frequent pre-tokens
once and broadcasts a table of their lengths, whose size is fixed by `frequent`.

Second pass: a text's count is the sum over its pre-tokens of the broadcast table's length;
what is not there is encoded by the library and kept in the worker's own bounded cache. No
pre-token is shuffled. Which pre-tokens the table holds changes the speed only.

Texts with a special token's string, or with characters whose class differs between Unicode
versions, are encoded whole by the library, as are all texts under files of other kinds.

Edge cases: null and empty texts count 0 tokens; repeated rows are counted each; an empty table
gives an empty table; columns of the input that have an output's name are replaced.
"""

from __future__ import annotations

import json
import pickle
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, texts
from .pretoken import settled, splitter
from .vocab import is_byte_level, library, read_tokenizer, specials

#: Entries of the broadcast table; of a summary; of a worker's cache; summaries merged at once.
FREQUENT, SUMMARY, CACHED, CACHED_CHARS, FAN_IN = 65_536, 16_384, 400_000, 48, 32


_worker: dict = {}


def _lengths(data: str, table: dict[str, int]) -> tuple[Callable[[str], int], Callable[[str], int]]:
    """This worker's functions from a pre-token, and from a whole text, to its tokens under the file.

    The cache outlives the task: later tasks of the worker go on with it. What it holds is right for the
    file whatever the table.
    """
    key = (hash(data), len(data))
    if key in _worker:
        return _worker[key]
    own = library(data)

    def whole(text: str) -> int:
        return len(own.encode(text, add_special_tokens=False).ids)

    class Lengths(dict):
        def __missing__(self, piece: str) -> int:
            n = whole(piece)
            if len(piece) <= CACHED_CHARS:
                if len(self) >= CACHED:
                    self.clear()
                    self.update(table)
                self[piece] = n
            return n

    _worker.clear()
    _worker[key] = Lengths(table).__getitem__, whole
    return _worker[key]


def _shrink(counts: Counter, size: int) -> None:
    """Keep the `size` largest, lowered by the largest of the rest."""
    if len(counts) > size:
        ordered = counts.most_common(size + 1)
        low = ordered[-1][1]
        counts.clear()
        counts.update({k: n - low for k, n in ordered[:-1] if n > low})


def frequent_pretokens(df: DataFrame, text: str = "text", frequent: int = FREQUENT, summary: int = SUMMARY) -> list[str]:
    """The most frequent pre-tokens of all texts, from bounded summaries of every partition."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        split, counts = splitter(), Counter()
        for batch in batches:
            for x in texts(batch.column(0)):
                if len(x) <= 1_000_000 or settled(x):
                    counts.update(split(x))
                if len(counts) > 8 * summary:
                    for k in [k for k in counts if len(k) > CACHED_CHARS]:
                        del counts[k]
                    _shrink(counts, 2 * summary)
        _shrink(counts, summary)
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int64()), "counts": pa.array([pickle.dumps(dict(counts))], pa.binary())})

    def merge(_key, table: pa.Table) -> pa.Table:
        counts = Counter()
        for part, data in zip(table["part"].to_pylist(), table["counts"].to_pylist()):
            counts.update(pickle.loads(data))
        _shrink(counts, summary)
        return pa.table({"part": pa.array([part // FAN_IN], pa.int64()), "counts": pa.array([pickle.dumps(dict(counts))], pa.binary())})

    schema = "part long, counts binary"
    parts = df.rdd.getNumPartitions()
    out = map_arrow(df.select(text), count, schema)
    while parts > FAN_IN:
        out, parts = out.groupBy(F.floor(F.col("part") / FAN_IN)).applyInArrow(merge, schema), -(-parts // FAN_IN)
    counts = Counter()
    for row in out.select("counts").collect():  # at most FAN_IN summaries
        counts.update(pickle.loads(row[0]))
    return [k for k, _ in counts.most_common(frequent) if len(k) <= CACHED_CHARS]


def token_counts(df: DataFrame, tokenizer: str, text: str = "text", out: str = "n_tokens", frequent: int = FREQUENT) -> DataFrame:
    """`df` with the number of tokens of `text`; `tokenizer`: a `tokenizers` file's path."""
    data = read_tokenizer(tokenizer)
    config = json.loads(data)
    table: dict[str, int] = {}
    if is_byte_level(config):
        known, own = frequent_pretokens(df, text, frequent), library(data)
        table = {k: len(e.ids) for k, e in zip(known, own.encode_batch(known, add_special_tokens=False))}
    marks, plain = specials(config), is_byte_level(config)
    shared = df.sparkSession.sparkContext.broadcast((data, table))
    kept = [f for f in df.schema.fields if f.name != out]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, table = shared.value
        of, whole = _lengths(data, table)
        split = splitter()

        def n_tokens(x: str) -> int:
            if plain and settled(x) and not any(m in x for m in marks):
                return sum(map(of, split(x)))
            return whole(x)

        for batch in batches:
            at = batch.schema.get_field_index
            made = pa.array([n_tokens(x) for x in texts(batch.column(at(text)))], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(at(n)) for n in names), made], [*names, out])

    return map_arrow(df, run, T.StructType([*kept, T.StructField(out, T.LongType())]))
