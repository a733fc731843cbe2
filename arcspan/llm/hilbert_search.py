"""Approximate nearest neighbours by shifted space-filling curves.

Every vector is put on a sphere (an extra component turns the largest inner product into the
nearest point) and projected, once for each of `CURVES` curves, onto `DIMENSIONS` random
orthogonal directions with a random shift; its place on the Hilbert curve through that space is
its key. For each curve Spark range-partitions all vectors and queries by key and gives them
ranks. A query is compared, exactly and on the original vectors, with all vectors up to
`window` ranks before and after it on any curve (rounded up to whole blocks of ranks), and the
best of all curves are merged.

The window is fitted: for a bounded sample of queries (`PROBES`) the true neighbours are found by
brute force over all rows, and the window is the distance in ranks at which a share of `RECALL`
of them is in reach. So recall is measured on each input, and the window grows with it as far
as the data's dimension demands. Ranks, not keys, make the blocks, so equal or crowded vectors
spread over as many tasks as any others; a block's queries are cut into pieces, so a task holds
`MOST_BLOCK` vectors and as many queries at most.

Edge cases: vectors that are null, zero, of another length than most, or that hold null or
non-finite components take no part, nor do rows with a null id; a query finds every row but its
own, other rows with its id included; ties go to the smaller id; with fewer candidates than
asked for, all are returned; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Spool, map_arrow
from .embedding_dedup import dimension, matrix, usable, _runs, _same

#: Curves; directions and bits of each; queries that the window is fitted on; share of their neighbours in reach.
CURVES, DIMENSIONS, BITS, PROBES, RECALL = 12, 4, 8, 128, 0.96
#: Vectors that the scale of the projections is taken from; ranks of a block, and queries that it is compared with at once.
SAMPLE, LEAST_BLOCK, MOST_BLOCK = 5_000, 256, 8_192


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places of cells (rows by axes, integers of `bits` bits) on the Hilbert curve.

    By exchanging and inverting the axes' low bits from the top bit down, then Gray decoding; the
    bits of all axes are then interleaved.
    """
    x = cells.T.astype(np.int64).copy()
    axes = len(x)
    for shift in range(bits - 1, 0, -1):
        low = (1 << shift) - 1
        for a in range(axes):
            up = (x[a] >> shift & 1).astype(bool)
            swap = np.where(up, 0, (x[0] ^ x[a]) & low)
            x[0] ^= np.where(up, low, swap)
            if a:
                x[a] ^= swap
    for a in range(1, axes):
        x[a] ^= x[a - 1]
    turn = np.zeros_like(x[0])
    for shift in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> shift & 1, (1 << shift) - 1, 0)
    x ^= turn
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for a in range(axes):
            key = key << 1 | (x[a] >> b & 1)
    return key


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties by id; near ties at the border are kept in too."""
    if len(scores) > k:
        border = -np.partition(-scores, k - 1)[k - 1]
        some = np.flatnonzero(scores >= border - 1e-9 * max(1.0, abs(border)))
    else:
        some = np.arange(len(scores))
    return some


def _top(q: np.ndarray, own: int, x: np.ndarray, ids: np.ndarray, rows: np.ndarray, rough: np.ndarray, k: int):
    """Ids, rows and exact scores of one query's best candidates."""
    rough = np.where(rows == own, -np.inf, rough)
    some = _best(rough, ids, k)
    some = some[rough[some] > -np.inf]
    exact = (x[some] * q).sum(axis=1)
    order = np.lexsort((rows[some], ids[some], -exact))[:k]
    return ids[some][order], rows[some][order], exact[order]


def search(df: DataFrame, is_query: Column, k: int = 20, id: str = "vec_id", vector: str = "embedding", curves: int = CURVES, seed: int = 0) -> DataFrame:
    """Columns query_id, rank, vec_id, score: the k nearest found of each row where `is_query`."""
    spark = df.sparkSession
    spool = Spool(spark)
    rows = df.withColumn("_query", F.coalesce(is_query, F.lit(False))).select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), "_query")
    dim = dimension(rows, "v")
    base = spool.write(rows.filter(usable("v", dim) & F.col("id").isNotNull()).withColumn("r", F.monotonically_increasing_id()))
    schema = "query_id long, rank int, vec_id long, score double"
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    n, most = base.agg(F.count("*"), F.max(norm)).first()
    if not n:
        return spark.createDataFrame([], schema)
    rng = np.random.default_rng(seed)
    directions = np.stack([np.linalg.qr(rng.standard_normal((dim + 1, min(DIMENSIONS, dim + 1))))[0] for _ in range(curves)])

    def lifted(x: np.ndarray, query: np.ndarray) -> np.ndarray:
        squares = (x * x).sum(1)
        out = np.concatenate([x, np.sqrt(np.maximum(most - squares, 0))[:, None]], 1)
        out[query] = np.concatenate([x[query] * np.sqrt(most / squares[query])[:, None], np.zeros((int(query.sum()), 1))], 1)
        return out

    some = base.orderBy(F.xxhash64("r")).limit(SAMPLE).select("v").toArrow()["v"].combine_chunks()
    some = matrix(some, dim)
    at = np.einsum("nd,cdk->cnk", lifted(some, np.zeros(len(some), bool)), directions)
    middle, spread = at.mean(1), np.maximum(at.std(1), 1e-12)
    shift = rng.uniform(-0.5, 0.5, middle.shape)
    shared = spark.sparkContext.broadcast((directions, middle, spread, shift))

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directions, middle, spread, shift = shared.value
        for batch in batches:
            if not len(batch):
                continue
            x, asks, r = matrix(batch.column(0), dim), batch.column(1).to_numpy(zero_copy_only=False).astype(bool), batch.column(2).to_numpy()
            both = np.concatenate([np.arange(len(x)), np.flatnonzero(asks)])
            kind = np.arange(len(both)) >= len(x)
            points = lifted(x[both], kind)
            for c in range(len(directions)):
                cells = ((points @ directions[c] - middle[c]) / (7 * spread[c]) + 0.5 + shift[c] / 7) * 2**BITS
                keys = hilbert_keys(np.clip(cells, 0, 2**BITS - 1).astype(np.int64), BITS)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(both), c, np.int32)), pa.array(keys), pa.array(kind), pa.array(r[both])], ["curve", "key", "asks", "r"])

    keyed = map_arrow(base.select("v", "_query", "r"), key, "curve int, key long, asks boolean, r long")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8)
    dealt = keyed.repartitionByRange(parts, "curve", "key", F.xxhash64("r")).sortWithinPartitions("curve", "key", F.xxhash64("r"))
    ordered = spool.write(dealt.select("curve", "asks", "r", F.monotonically_increasing_id().alias("pos")))
    part = F.shiftright("pos", 33)
    sums = ordered.groupBy("curve", part.alias("part")).agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    before = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("curve", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("add"))
    # One row for each curve and partition: a size that the number of partitions bounds.
    ranked = ordered.withColumn("part", part).join(F.broadcast(sums), ["curve", "part"]).select("curve", "asks", "r", (F.col("pos") + F.col("add")).alias("rank"))

    window = _window(base, ranked, n, k, dim)
    block = int(np.clip(window // 2, LEAST_BLOCK, MOST_BLOCK))
    mine = F.floor(F.col("rank") / block).cast("long")
    first, last = F.floor((F.col("rank") - window) / block).cast("long"), F.floor((F.col("rank") + window) / block).cast("long")
    stored = ranked.filter("not asks").select("curve", mine.alias("block"), "asks", "r")
    asked = ranked.filter("asks").select("curve", F.explode(F.sequence(F.greatest(first, F.lit(0).cast("long")), last)).alias("block"), "asks", "r")
    # Many queries of a block are cut into pieces, each of which meets all of the block's vectors.
    pieces = asked.groupBy("curve", "block").agg(F.ceil(F.count("*") / MOST_BLOCK).cast("int").alias("pieces"))
    stored = stored.join(pieces, ["curve", "block"]).select("curve", "block", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), "asks", "r")
    asked = asked.join(pieces, ["curve", "block"]).select("curve", "block", F.pmod(F.xxhash64("r"), F.col("pieces")).cast("int").alias("piece"), "asks", "r")
    order = ["curve", "block", "piece"]
    met = stored.unionByName(asked).join(base.select("r", "id", "v"), "r").repartition(*order).sortWithinPartitions(*order)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in grouped(batches, order):
            table = pa.Table.from_batches(parts).combine_chunks()
            asks, r, ids = table["asks"].to_numpy(), table["r"].to_numpy(), table["id"].to_numpy()
            if asks.all() or not asks.any():
                continue
            x = matrix(table["v"].combine_chunks(), dim)
            stored, queries = np.flatnonzero(~asks), np.flatnonzero(asks)
            there, out = x[stored], []
            for start in range(0, len(queries), 256):
                some = queries[start : start + 256]
                for q, rough in zip(some, x[some] @ there.T):
                    out.append((int(r[q]), int(ids[q]), *_top(x[q], r[q], there, ids[stored], r[stored], rough, k)))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out]), pa.array([o[1] for o in out]), *(pa.array([o[j].tolist() for o in out], pa.list_(kind)) for j, kind in ((2, pa.int64()), (3, pa.int64()), (4, pa.float64())))], ["q", "query_id", "ids", "rows", "scores"])

    found = map_arrow(met, compare, "q long, query_id long, ids array<long>, rows array<long>, scores array<double>")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in grouped(batches, ["q"]):
            table = pa.Table.from_batches(parts).combine_chunks()
            ids, r, scores = (table[c].combine_chunks().flatten().to_numpy() for c in ("ids", "rows", "scores"))
            _, one = np.unique(r, return_index=True)
            best = one[np.lexsort((r[one], ids[one], -scores[one]))][:k]
            if len(best):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), table["query_id"][0].as_py(), np.int64)), pa.array(np.arange(1, len(best) + 1, dtype=np.int32)), pa.array(ids[best]), pa.array(scores[best])], ["query_id", "rank", "vec_id", "score"])

    return map_arrow(found.repartition("q").sortWithinPartitions("q"), merge, schema)


def grouped(batches: Iterator[pa.RecordBatch], order: list[str]) -> Iterator[list[pa.RecordBatch]]:
    """The groups of equal keys of sorted batches, each as a list of slices."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for part in _runs(batch, order):
            if held and not _same(held[-1], part, order):
                yield held
                held = []
            held.append(part)
    if held:
        yield held


def brute_force(base: DataFrame, queries: list[tuple[int, int, list[float]]], k: int, dim: int) -> DataFrame:
    """Columns q, r: the true neighbours of a bounded list of queries (row, id, vector)."""
    shared = base.sparkSession.sparkContext.broadcast(queries)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        q = np.array([x[2] for x in asked])
        for batch in batches:
            if len(batch):
                x, ids, r = matrix(batch.column(0), dim), batch.column(1).to_numpy(), batch.column(2).to_numpy()
                for (own, _, v), rough in zip(asked, q @ x.T):
                    i, rows, scores = _top(np.array(v), own, x, ids, r, rough, k)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), own, np.int64)), pa.array(i), pa.array(rows), pa.array(scores)], ["q", "id", "r", "score"])

    near = map_arrow(base.select("v", "id", "r"), scan, "q long, id long, r long, score double")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id", "r"))
    return near.withColumn("place", place).filter(F.col("place") <= k).select("q", "r")


def _window(base: DataFrame, ranked: DataFrame, n: int, k: int, dim: int) -> int:
    """Ranks to either side that reach a share of RECALL of the true neighbours of sampled queries."""
    probes = base.filter("_query").orderBy(F.xxhash64("r"), "r").limit(PROBES).collect()
    if not probes:
        return 1
    truth = brute_force(base, [(p.r, p.id, p.v) for p in probes], k, dim)
    asked = F.broadcast(ranked.filter("asks").join(F.broadcast(truth.select("q").distinct()), F.col("r") == F.col("q")).select("q", "curve", F.col("rank").alias("from")))
    pairs = ranked.filter("not asks").join(F.broadcast(truth), "r").join(asked, ["q", "curve"])
    away = pairs.groupBy("q", "r").agg(F.min(F.abs(F.col("rank") - F.col("from"))).alias("away")).toPandas()["away"].to_numpy()
    return int(np.ceil(np.quantile(away, RECALL))) + 1 if len(away) else 1
