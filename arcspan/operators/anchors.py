"""Windows anchored at their first event, found in parallel along a series.

An event more than `width` after its window's first event opens the next window, so anchors form a
chain: from each event a jump leads to the first event after its window, by a range search. A long
series is cut into segments (`series.cut`). Whatever happened before, a segment is entered with one
number, the end of the window that is open, and left with another; what it does to that number is a
step function, told by jump pointers that are doubled until they leave the segment. These functions
are composed in a tree, `FAN` neighbours at a time, until each key has `FAN` blocks at most; then the
numbers at which blocks, and in turn segments, are entered follow from the first event on, and all
segments follow their chains at once.

A step function has a step for each distinct time in the first `width` of its segment, as no
window that is open at its start reaches farther.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from ..sinks import spool
from .series import KEY, PART

#: Neighbouring segments, or blocks, that one task composes.
FAN = 32
#: The end of a window before all events.
NEVER = -(2**63)
STEPS = f"{KEY} string, {PART} int, entries array<long>, ends array<long>, opened array<long>"
ENTER = f"{KEY} string, {PART} int, open_end long, opened long"


def chase(jumps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the last one of its chain of jumps, and the number of jumps to it; a jump to
    the place itself, or past the end, ends the chain."""
    n = len(jumps)
    at = np.where(jumps < n, jumps, np.arange(n))
    steps = (at != np.arange(n)).astype(np.int64)
    while True:
        after = at[at]
        if (after == at).all():
            return at, steps
        steps, at = steps + steps[at], after


class Steps:
    """What a segment makes of the end of the window that is open before it: a window open until t < entries[i]
    (and not < entries[i - 1]) leads to ends[i], after opened[i] windows; one open beyond all entries stays."""

    def __init__(self, entries: np.ndarray, ends: np.ndarray, opened: np.ndarray):
        self.entries, self.ends, self.opened = entries, ends, opened

    @classmethod
    def of(cls, times: np.ndarray, width: int) -> Steps:
        """Of a segment's distinct times, sorted."""
        last, jumps = chase(np.searchsorted(times, times + width, "right"))
        near = int(np.searchsorted(times, times[0] + width, "right")) + 1
        return cls(times[:near], times[last[:near]] + width, jumps[:near] + 1)

    def apply(self, open_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ends of the windows open after the segment, and how many it opened."""
        at = np.searchsorted(self.entries, open_end, "right")
        there = at < len(self.entries)
        at = np.minimum(at, len(self.entries) - 1)
        return np.where(there, self.ends[at], open_end), np.where(there, self.opened[at], 0)

    def then(self, later: Steps, width: int) -> Steps:
        """Both segments as one."""
        ends, more = later.apply(self.ends)
        entries = np.concatenate([self.entries, later.entries])
        near = int(np.searchsorted(entries, entries[0] + width, "right")) + 1
        return Steps(entries[:near], np.concatenate([ends, later.ends])[:near], np.concatenate([self.opened + more, later.opened])[:near])


def _groups(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.Table]:
    """The runs of equal `columns` of sorted batches."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not len(batch):
            continue
        keys = list(zip(*(batch.column(c).to_pylist() for c in columns)))
        start = 0
        for i in range(len(keys) + 1):
            if i == len(keys) or keys[i] != keys[start]:
                if held and keys[start] != now:
                    yield pa.Table.from_batches(held).combine_chunks()
                    held = []
                now = keys[start]
                held.append(batch.slice(start, i - start))
                start = i
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _grouped(df: DataFrame, by: list[str], order: list[str], fn: Callable[[pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """`fn` on each group of `df`, its rows in order."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, by):
            yield fn(table)

    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, schema)


def _row(key: str, part: int, s: Steps) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([key]), pa.array([part], pa.int32()), *(pa.array([x.tolist()], pa.list_(pa.int64())) for x in (s.entries, s.ends, s.opened))], [KEY, PART, "entries", "ends", "opened"])


def _steps(table: pa.Table, i: int) -> Steps:
    return Steps(*(table[c][i].values.to_numpy() for c in ("entries", "ends", "opened")))


def entering(times: DataFrame, width: int) -> DataFrame:
    """For each segment of `times` (_k, _part, us: distinct): open_end, the end of the window that is open before
    it (`NEVER` before the first), and opened, the number of windows before it."""

    def one(table: pa.Table) -> pa.RecordBatch:
        return _row(table[KEY][0].as_py(), table[PART][0].as_py(), Steps.of(table["us"].to_numpy(), width))

    def join(table: pa.Table) -> pa.RecordBatch:
        out = _steps(table, 0)
        for i in range(1, len(table)):
            out = out.then(_steps(table, i), width)
        return _row(table[KEY][0].as_py(), table["block"][0].as_py(), out)

    levels = [spool(_grouped(times, [KEY, PART], ["us"], one, STEPS))]
    parts = levels[0].agg(F.max(PART)).first()[0] or 0
    while parts >= FAN:
        blocks = levels[-1].withColumn("block", F.floor(F.col(PART) / FAN).cast("int"))
        levels.append(spool(_grouped(blocks, [KEY, "block"], [PART], join, STEPS)))
        parts //= FAN

    def enter(table: pa.Table) -> pa.RecordBatch:
        """The parts of one block in order, the block's own entry in its first row."""
        end, opened = np.array([table["open_end"][0].as_py()]), table["before"][0].as_py()
        ends, before = [], []
        for i in range(1, len(table)):
            ends.append(int(end[0]))
            before.append(opened)
            end, more = _steps(table, i).apply(end)
            opened += int(more[0])
        return pa.RecordBatch.from_arrays([table[KEY].combine_chunks().slice(1), table[PART].combine_chunks().slice(1), pa.array(ends, pa.int64()), pa.array(before, pa.int64())], [KEY, PART, "open_end", "opened"])

    found = None
    for level in reversed(levels):
        # The last level is one block a key, entered before all events.
        block = F.lit(0) if found is None else F.floor(F.col(PART) / FAN).cast("int")
        if found is None:
            found = level.select(KEY).distinct().select(KEY, F.lit(0).alias(PART), F.lit(NEVER).alias("open_end"), F.lit(0).cast("long").alias("opened"))
        heads = found.select(KEY, F.col(PART).alias("block"), F.lit(-1).alias(PART), "open_end", F.col("opened").alias("before"))
        both = heads.unionByName(level.withColumn("block", block), allowMissingColumns=True)
        found = _grouped(both, [KEY, "block"], [PART], enter, ENTER)
    return found


def starts(times: DataFrame, width: int) -> DataFrame:
    """The windows of `times` (_k, _part, us: distinct): _k, _part, at, window_start, window_index.

    A window has a row at its first event, and one at `NEVER` in each later segment in which it may be
    open still.
    """
    rows = times.unionByName(entering(times, width), allowMissingColumns=True).withColumn("first", F.col("us").isNull())

    def follow(table: pa.Table) -> pa.RecordBatch:
        end, opened = table["open_end"][0].as_py(), table["opened"][0].as_py()
        t = table["us"].combine_chunks().slice(1).to_numpy()
        jumps, chain = np.searchsorted(t, t + width, "right"), []
        at = int(np.searchsorted(t, end, "right")) if end != NEVER else 0
        while at < len(t):
            chain.append(at)
            at = int(jumps[at])
        begun, index = t[chain].tolist(), list(range(opened, opened + len(chain)))
        places = list(begun)
        if end != NEVER:
            places, begun, index = [NEVER, *places], [end - width, *begun], [opened - 1, *index]
        n, key, part = len(places), table[KEY][0].as_py(), table[PART][0].as_py()
        return pa.RecordBatch.from_arrays([pa.array([key] * n, pa.string()), pa.array([part] * n, pa.int32()), pa.array(places, pa.int64()), pa.array(begun, pa.int64()), pa.array(index, pa.int32())], [KEY, PART, "at", "window_start", "window_index"])

    return _grouped(rows, [KEY, PART], ["us"], follow, f"{KEY} string, {PART} int, at long, window_start long, window_index int")
