"""Best-two-fit packing of tokenised documents into sequences.

`cut` tokenises each document, appends the end id and cuts what is longer than a sequence; the
first piece may be the shorter one. `pack` places pieces: it needs only how many pieces there
are of each length. That histogram has at most `limit` rows whatever the data's size, so the
packing itself is planned on the driver for whole classes of equal bins: a bin is filled
greedily, largest piece first; then its smallest piece is replaced by the two unpacked pieces
that fit the widened gap most tightly, if they fill it further; the same pattern is repeated as
long as there are pieces for it. Every pattern uses up a length, so there are few. Pieces then
find their place by their rank among those of the same length: ranks within the partition
that wrote them, plus the counts of the partitions before, so neither a common length nor a
large partition gathers in one task.

Edge cases: null and empty texts give one piece, the end id alone; repeated rows are packed
each; an empty table gives an empty table; a piece that is null, empty or longer than the
limit raises ValueError; input columns with an output's name are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Spool, map_arrow, texts
from .vocab import ids_for, read_tokenizer


def cut(df: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", limit: int = 1024, end: int = 2) -> DataFrame:
    """Pieces of at most `limit` ids: the id column, piece, start, length, ids (packed)."""
    shared = df.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = ids_for(shared.value)
        for batch in batches:
            ids, keys, pieces, starts, lengths, found = batch.column(0), [], [], [], [], []
            for row, x in enumerate(texts(batch.column(1))):
                all_ids = encode(x)
                all_ids.append(end)
                n, data = len(all_ids), np.array(all_ids, "<u4").tobytes()
                at, piece = 0, 0
                while at < n:
                    size = (n % limit or limit) if at == 0 else limit
                    keys.append(row)
                    pieces.append(piece)
                    starts.append(at)
                    lengths.append(size)
                    found.append(data[4 * at : 4 * (at + size)])
                    at, piece = at + size, piece + 1
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(keys, pa.int64())), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(found, pa.binary())], [id, "piece", "start", "length", "ids"])

    kind = df.schema[id].dataType.simpleString()
    return map_arrow(df.select(id, text), run, f"`{id}` {kind}, piece int, start long, length long, ids binary")


def plan(counts: dict[int, int], limit: int) -> list[tuple[list[int], int]]:
    """Patterns of piece lengths, and how many bins have each; all pieces are used."""
    left = np.zeros(limit + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    out = []
    top = limit
    while True:
        while top > 0 and left[top] == 0:
            top -= 1
        if top == 0:
            return out
        there = np.flatnonzero(left)
        bin_, gap, used = [], limit, np.zeros(limit + 1, np.int64)
        while gap > 0:
            free = there[left[there] > used[there]]
            k = int(np.searchsorted(free, gap, "right")) - 1
            if k < 0:
                break
            size = int(free[k])
            take = min(gap // size, int(left[size] - used[size]))
            bin_ += [size] * take
            used[size] += take
            gap -= take * size
        if gap and len(bin_) > 1:
            small = bin_[-1]
            used[small] -= 1
            free = there[(left[there] > used[there]) & (there < small + gap)]
            best, pair = small, None
            if len(free):
                # for each first piece the largest second one that still fits
                second = np.searchsorted(free, small + gap - free, "right") - 1
                for a, k in zip(free, second):
                    while k >= 0 and free[k] == a and left[a] - used[a] < 2:
                        k -= 1
                    if k >= 0 and a + free[k] > best:
                        best, pair = int(a + free[k]), (int(a), int(free[k]))
            if pair:
                bin_ = sorted([*bin_[:-1], *pair], reverse=True)
                for x in pair:
                    used[x] += 1
            else:
                used[small] += 1
        kinds = np.flatnonzero(used)
        times = int((left[kinds] // used[kinds]).min())
        left[kinds] -= times * used[kinds]
        out.append((bin_, times))


def slots(patterns: list[tuple[list[int], int]]) -> np.ndarray:
    """Rows (length, first rank, sequence id of that rank, offset), by length and rank: the pieces
    of a length with ranks from the first on go to one sequence after the other."""
    rank: dict[int, int] = {}
    rows, base = [], 0
    for bin_, times in patterns:
        offset = 0
        for length in bin_:
            rows.append((length, rank.get(length, 0), base, offset))
            rank[length] = rank.get(length, 0) + times
            offset += length
        base += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(df: DataFrame, limit: int = 1024, length: str = "length") -> DataFrame:
    """`df` with sequence_id and offset: where each row's piece lies. Columns of these names are
    replaced; others are kept, whatever their names."""
    spark = df.sparkSession
    df = df.drop("sequence_id", "offset")
    given, names = df.columns, [f"c{i}" for i in range(len(df.columns))]
    # Within, the caller's columns go by number, so none of them is taken for one of the job's own.
    df, length = df.toDF(*names), names[[c.lower() for c in given].index(length.lower())]
    kept = Spool(spark).write(df.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}))
    by_part = kept.groupBy(F.col(length).alias("_length"), "_part").agg(F.count("*").alias("_n"))
    counts = {r[0]: r[1] for r in by_part.groupBy("_length").agg(F.sum("_n")).collect()}
    if any(k is None or not 0 < k <= limit for k in counts):
        raise ValueError("a piece is null, empty or longer than the limit")
    shared = spark.sparkContext.broadcast(slots(plan(counts, limit)))
    before = by_part.withColumn("_before", F.sum("_n").over(Window.partitionBy("_length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = kept.withColumn("_rank", F.row_number().over(Window.partitionBy(length, "_part").orderBy("_row"))).join(
        before.withColumnRenamed("_part", "_of"), (F.col("_length") == F.col(length)) & (F.col("_of") == F.col("_part"))
    ).withColumn("_rank", F.col("_rank") - 1 + F.coalesce("_before", F.lit(0)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        starts = (table[:, 0] << 44) + table[:, 1]
        for batch in batches:
            at = batch.schema.get_field_index
            rank = batch.column(at("_rank")).to_numpy(zero_copy_only=False)
            k = np.searchsorted(starts, (batch.column(at(length)).to_numpy(zero_copy_only=False).astype(np.int64) << 44) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*(batch.column(at(n)) for n in names), pa.array(table[k, 2] + rank - table[k, 1]), pa.array(table[k, 3])], [*names, "sequence_id", "offset"])

    schema = kept.select(names).schema.add("sequence_id", "long").add("offset", "long")
    return map_arrow(ranked.select(*names, "_rank"), place, schema).toDF(*given, "sequence_id", "offset")
