"""Exact nearest vectors by blocked matrix products.

A stated query set is broadcast in blocks of a bounded number of queries. Every task multiplies
its Arrow batches with a block's matrix, piece by piece; the products only choose candidates,
with a margin for their rounding, and the distances of these are taken again from the differences.
A task holds the `k` best of each query so far and emits them once, as one row a query, so a pair is
never a row. These lists are merged in a tree: where there are many tasks, those of
`FAN` of them first, then the rest.

Vectors that are null, hold null or non-finite components, or are of another length than the
query take no part. Of equally near vectors the smaller id comes first; rows that repeat an id
are found once each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from ..session import ship
from ..sinks import spool

#: Queries that are broadcast at once; products held at once; lists that one task merges; bytes of a task's input, about.
MOST, PRODUCTS, FAN, PARTITION = 10_000, 4_000_000, 64, 128 << 20


def _usable(vector: str) -> Column:
    return F.coalesce(F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))), F.lit(False)) & (F.size(vector) > 0)


class Best:
    """The k nearest so far of each slot (a query, or a query and a group), as parallel arrays."""

    def __init__(self, slots: int, k: int):
        self.k, self.bound = k, np.full(slots, np.inf)
        self.slot, self.distance, self.row = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.ids: pa.Array | None = None  # of the rows held

    def add(self, slot: np.ndarray, distance: np.ndarray, row: np.ndarray, ids: pa.Array) -> None:
        """Candidates, as places in `ids`."""
        if not len(slot):
            return
        some, place = np.unique(row, return_inverse=True)
        ids = ids.take(pa.array(some))
        held = 0 if self.ids is None else len(self.ids)
        self.ids = ids if self.ids is None else pa.concat_arrays([self.ids, ids])
        self.slot, self.distance, self.row = np.append(self.slot, slot), np.append(self.distance, distance), np.append(self.row, held + place)
        turn = np.empty(len(self.ids), np.int64)  # ids in their order, for ties
        turn[pc.sort_indices(self.ids).to_numpy()] = np.arange(len(self.ids))
        order = np.lexsort((turn[self.row], self.distance, self.slot))
        s = self.slot[order]
        first = np.concatenate([[True], s[1:] != s[:-1]])
        rank = np.arange(len(s)) - np.flatnonzero(first)[np.cumsum(first) - 1]
        keep = order[rank < self.k]
        last = order[rank == self.k - 1]
        self.bound[self.slot[last]] = self.distance[last]
        self.slot, self.distance = self.slot[keep], self.distance[keep]
        rows, self.row = np.unique(self.row[keep], return_inverse=True)
        self.ids = self.ids.take(pa.array(rows))

    def lists(self, slots: np.ndarray, parts: np.ndarray, kind: pa.DataType) -> pa.RecordBatch:
        """A row (slot, part, ids, distances) for each slot that has any; slots have these names and parts."""
        some, first = np.unique(self.slot, return_index=True)
        ends = pa.array(np.append(first, len(self.slot)).astype(np.int32))
        ids = pa.array([], kind) if self.ids is None else self.ids.take(pa.array(self.row))
        return pa.RecordBatch.from_arrays([
            pa.array(slots[some]), pa.array(parts[some]), pa.ListArray.from_arrays(ends, ids), pa.ListArray.from_arrays(ends, pa.array(self.distance)),
        ], ["slot", "part", "ids", "distances"])


def _search(best: Best, slots: np.ndarray, q: np.ndarray, x: np.ndarray, ids: pa.Array) -> None:
    """Offer the rows `x` to the queries `q`."""
    with np.errstate(over="ignore"):
        squares, own = (q * q).sum(1), (x * x).sum(1)
    step = max(1, PRODUCTS // max(len(q), 1))
    for start in range(0, len(x), step):
        part, norm = x[start : start + step], own[start : start + step]
        with np.errstate(over="ignore", invalid="ignore"):
            rough = squares[:, None] - 2 * (q @ part.T) + norm
            slack = 1e-12 * q.shape[1] * (squares + norm.max(initial=0))
            near = np.partition(rough, best.k - 1, axis=1)[:, best.k - 1] + 2 * slack if len(part) > best.k else np.full(len(q), np.inf)
            # A product that overflowed decides nothing: such rows stay candidates.
            a, b = np.nonzero(~(rough > np.minimum(best.bound[slots] + slack, near)[:, None]))
        for low in range(0, len(a), PRODUCTS // q.shape[1] + 1):
            i, j = a[low : low + PRODUCTS // q.shape[1] + 1], b[low : low + PRODUCTS // q.shape[1] + 1]
            with np.errstate(over="ignore"):
                exact = ((q[i] - part[j]) ** 2).sum(1)
            best.add(slots[i], exact, start + j, ids)


def _merged(rows: pa.Table, k: int) -> pa.RecordBatch:
    """Lists of the same slot and part, merged into one."""
    rows = rows.combine_chunks()
    slot, part = rows["slot"].to_numpy(), rows["part"].to_numpy()
    first = np.concatenate([[True], (slot[1:] != slot[:-1]) | (part[1:] != part[:-1])])
    ids, best = rows["ids"].combine_chunks(), Best(int(first.sum()), k)
    flat = ids.flatten()
    best.add(np.repeat(np.cumsum(first) - 1, pc.list_value_length(ids).to_numpy()), rows["distances"].combine_chunks().flatten().to_numpy(), np.arange(len(flat)), flat)
    return best.lists(slot[first], part[first], flat.type)


def nearest(queries: DataFrame, vectors: DataFrame, query_id: str, id: str, vector: str, k: int, most: int = MOST, group: str | None = None) -> DataFrame:
    """The k nearest vectors of each query (query_id, q), exactly: columns query_id, id, rank, distance.

    With `group`, a column of `vectors`, the k nearest of each group that the query names (in its
    column providers) are found, and the group is a column of the result. More than `most` queries are
    searched in blocks, one pass over the vectors each.
    """
    asked = queries.select(query_id, "q", *(["providers"] if group else [])).filter(_usable("q"))
    n = asked.count()
    if n <= most:
        return _block(asked, vectors, query_id, id, vector, k, group)
    blocks = -(-n // most)
    block = F.pmod(F.xxhash64(query_id), F.lit(blocks))
    found = [spool(_block(asked.filter(block == b), vectors, query_id, id, vector, k, group)) for b in range(blocks)]
    return reduce(DataFrame.unionByName, found)


def _block(asked: DataFrame, vectors: DataFrame, query_id: str, id: str, vector: str, k: int, group: str | None) -> DataFrame:
    """`nearest` of queries that are broadcast at once."""
    spark = vectors.sparkSession
    ship(spark)
    rows = asked.select(F.col(query_id).alias("id"), F.col("q").cast("array<double>").alias("q"), *(["providers"] if group else [])).toArrow().to_pydict()
    groups = sorted({g for named in rows["providers"] for g in named or []}) if group else [None]
    code = {g: i for i, g in enumerate(groups)}
    sides: dict[tuple[int, str | None], tuple[np.ndarray, np.ndarray]] = {}
    for g in groups:
        chosen = [i for i, q in enumerate(rows["q"]) if not group or g in (rows["providers"][i] or [])]
        for dim in {len(rows["q"][i]) for i in chosen}:
            some = [i for i in chosen if len(rows["q"][i]) == dim]
            sides[dim, g] = np.array(some) * len(groups) + code[g], np.array([rows["q"][i] for i in some], np.float64)
    shared = spark.sparkContext.broadcast(sides)
    slots = len(rows["q"]) * len(groups)
    id_field = vectors.select(F.col(id).alias("id")).schema["id"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, part, kind = Best(slots, k), 0, None
        for batch in batches:
            if not len(batch):
                continue
            part, kind = batch.column(2)[0].as_py(), batch.column(0).type
            size = pc.list_value_length(batch.column(1)).to_numpy()
            of = np.array(batch.column(3).to_pylist(), object) if group else None
            for (dim, g), (slot, q) in shared.value.items():
                take = size == dim if of is None else (size == dim) & (of == g)
                if not take.any():
                    continue
                some = batch if take.all() else batch.filter(pa.array(take))
                x = some.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                _search(best, slot, q, x, some.column(0))
        if kind is not None:
            yield best.lists(np.arange(slots), np.full(slots, part), kind)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # the last slot's lists, as the next batch may have more of them
        for batch in batches:
            if len(batch):
                table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
                slot, part = table["slot"].to_numpy(), table["part"].to_numpy()
                start = int(((slot == slot[-1]) & (part == part[-1])).argmax())
                held = table.slice(start)
                if start:
                    yield _merged(table.slice(0, start), k)
        if held is not None:
            yield _merged(held, k)

    schema = StructType([StructField("slot", LongType()), StructField("part", LongType()), StructField("ids", ArrayType(id_field.dataType)), StructField("distances", ArrayType(DoubleType()))])
    there = vectors.filter(_usable(vector)).select(F.col(id).alias("id"), F.col(vector).alias("v"), F.spark_partition_id().alias("part"), *([F.col(group).alias("g")] if group else []))
    found = there.mapInArrow(search, schema)
    size = int(str(vectors._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > FAN * PARTITION:  # a level of the tree: lists of FAN tasks become one
        found = found.withColumn("part", F.floor(F.col("part") / FAN).cast("long")).repartition("slot", "part").sortWithinPartitions("slot", "part").mapInArrow(merge, schema)
    last = found.withColumn("part", F.lit(0).cast("long")).repartition("slot").sortWithinPartitions("slot").mapInArrow(merge, schema)
    # The block's queries by number: at most as many rows as were broadcast.
    kind = asked.schema[query_id].dataType
    names = spark.createDataFrame(list(enumerate(rows["id"])), StructType([StructField("_n", LongType()), StructField(query_id, kind)]))
    out = last.select((F.col("slot") / len(groups)).cast("long").alias("_n"), (F.col("slot") % len(groups)).cast("int").alias("_g"), F.posexplode(F.arrays_zip("ids", "distances")).alias("_p", "_h"))
    out = out.join(F.broadcast(names), "_n").select(query_id, "_g", F.col("_h.ids").alias(id), (F.col("_p") + 1).cast("int").alias("rank"), F.col("_h.distances").alias("distance"))
    if not group:
        return out.drop("_g")
    labels = spark.createDataFrame([(i, g) for g, i in code.items()], StructType([StructField("_g", IntegerType()), StructField(group, StringType())]))
    return out.join(F.broadcast(labels), "_g").drop("_g")
