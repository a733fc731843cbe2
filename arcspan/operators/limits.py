"""Rate limits over sliding windows, replayed from the requests' own times.

Whether a request passes depends on those that passed before it, so this is a fold over a key's
requests in order. Spark sorts them; a stream of batches passes, and what is held is the last
`limit` times. After a pause as long as the window nothing that passed counts any more, so a limit
that refuses is folded burst by burst: the requests between two such pauses go to a task of their own.
Only a burst that never pauses is one task, as a limit that makes requests wait is for each key, whose
queue may outlast a pause.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from . import series

#: Requests, and seconds of the window, of the address limit and of the key limit (fixed values).
BY_ADDRESS, BY_KEY = (20, 60), (14, 62)


def _fold(df: DataFrame, key: str, us: str, id: str, limit: int, seconds: int, blocking: bool) -> DataFrame:
    ship(df.sparkSession)
    width = seconds * 1_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, passed, out = None, deque(), 0
        for batch in batches:
            ids, keys, times = batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            found = []
            for k, t in zip(keys, times):
                if k != now:
                    now, passed, out = k, deque(), t
                at = max(t, out) if blocking else t
                while passed and at - passed[0] >= width:
                    passed.popleft()
                if len(passed) < limit:
                    passed.append(at)
                elif blocking:
                    at = passed.popleft() + width
                    passed.append(at)
                else:
                    at = None
                out = at if blocking else out
                found.append(at)
            yield pa.RecordBatch.from_arrays([ids, pa.array(found, pa.int64())], ["id", "passed_us"])

    rows = df.select(F.col(id).cast("string").alias("id"), F.col(key).cast("string").alias("key"), F.col(us).cast("long").alias("us"))
    rows = rows.filter("key is not null and key != '' and us is not null")
    if not blocking:
        rows = _bursts(rows, width)
    ordered = rows.repartition("key").sortWithinPartitions("key", "us", "id")
    return ordered.mapInArrow(run, "id string, passed_us long")


def _bursts(rows: DataFrame, width: int) -> DataFrame:
    """Requests (id, key, us) with keys that tell bursts apart, too."""
    order = ["us", "id"]
    parts = series.with_halo(series.cut(rows, ["key"], order), order, 1)
    pause = F.coalesce(F.col("us") - F.lag("us").over(series.along(order)) >= width, F.lit(False))
    marked = parts.withColumn("_pause", pause).filter(f"{series.HALO} = 0")
    # Pauses are numbered as they come; a request is in the burst of the last one up to its time.
    both = marked.select("id", "key", "us", series.KEY, series.PART, F.col("_pause").cast("long").alias("_b"))
    both.whole = getattr(parts, "whole", False)
    counted = series.running(both, order, F.col("_b"), "_before")
    return counted.select("id", F.concat("key", F.lit("\u0000"), (F.col("_before") + F.col("_b")).cast("string")).alias("key"), "us")


def admitted(df: DataFrame, key: str, us: str, id: str, limit: int = BY_ADDRESS[0], seconds: int = BY_ADDRESS[1]) -> DataFrame:
    """Rows id (as string) and accepted: a request passes if fewer than `limit` passed in the `seconds`
    before it; refused ones don't count. Of requests at one time the smaller id comes first.
    Requests without a key or a time are not limited and not in the result."""
    return _fold(df, key, us, id, limit, seconds, False).select("id", F.col("passed_us").isNotNull().alias("accepted"))


def released(df: DataFrame, key: str, us: str, id: str, limit: int = BY_KEY[0], seconds: int = BY_KEY[1]) -> DataFrame:
    """Rows id (as string) and released_us: when each request goes through a limiter that makes it wait."""
    return _fold(df, key, us, id, limit, seconds, True).select("id", F.col("passed_us").alias("released_us"))
