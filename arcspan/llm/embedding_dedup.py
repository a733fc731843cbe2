"""Embedding near-duplicates by iterative quantisation and multi-index Hamming tables.

Fitting, on a bounded sample of distinct vectors (`SAMPLE`): principal axes, then a rotation
found by alternating between binary codes and the rotation closest to them (Procrustes), so that
the bits are balanced and lose little; at least `ROTATIONS` such codes from different starts. Every
vector is coded. The codes are cut into substrings of about the logarithm of the number of vectors;
each substring is one hash table, and vectors that agree in one are compared exactly by cosine
on the original vectors, in double precision.

Longer substrings agree less often, so there are as many tables as keep the chance to miss a pair
at `least` under `MISS` if bits agree independently, and codes for as many. The share of links found
is then measured: `PROBES` vectors are compared with all others; while it is under 1 - `MISS`,
tables are doubled, `DOUBLINGS` times at most, and a warning says what share is left.

What the tables are dealt by first are codes, not vectors: an entry has its vector's number and
`SIGNATURE` bits of its code. In each bucket the Hamming distances of these are taken, and an entry
goes on only if another is within `radius` of it, which a pair at `least` exceeds with a chance of
1 in 10,000 at most. Vectors travel to the tables of such entries alone, where they are reranked.

A pair that meets in several tables counts in the first only, which both codes tell, so links
are counted inside the buckets and pairs are never listed; what leaves a bucket is a link count
per vector and the edges of a spanning forest. Equal vectors are one class with a multiplicity
before any of this. A bucket larger than `BLOCK` is cut into blocks, and each pair of blocks is a
task of its own: no cap, and no bucket in one task.

Edge cases: vectors that are null, zero, of another length than most, or that hold null or
non-finite components link with nothing, as do rows with a null id; their component is their
own id and they are kept. Rows that repeat an id are compared like others. An empty table gives
an empty table.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Spool, map_arrow
from .components import components, local_labels

#: Vectors that the codes are fitted on at most; codes at least; bits of a code at most; a bucket's block.
SAMPLE, ROTATIONS, BITS, BLOCK = 10_000, 4, 64, 2_048
#: Share of links missed at most; vectors that it is measured on; how often tables are doubled for it.
MISS, PROBES, DOUBLINGS = 0.01, 512, 2
#: Bits of a code that an entry carries, and the chance to lose a pair at the least cosine by them.
SIGNATURE, LOST = 64, 1e-4


def usable(column: str, dim: int) -> F.Column:
    """Whether a vector takes part."""
    x = F.col(column)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.coalesce((F.size(x) == dim) & finite & F.exists(x, lambda v: v != 0), F.lit(False))


def dimension(df: DataFrame, column: str) -> int:
    """The most frequent vector length, the smaller of equally frequent ones; 0 if none."""
    top = df.filter(F.col(column).isNotNull()).groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), "d").first()
    return top[0] if top else 0


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """An Arrow column of equally long vectors as doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; scaled first by their largest part, so squares don't overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def tables_for(width: int, least: float) -> int:
    """Tables of `width` bits that miss a pair with the cosine `least` with a chance of at most `MISS`."""
    agree = (1 - np.arccos(np.clip(least, -1, 1)) / np.pi) ** width
    return int(np.ceil(np.log(MISS) / np.log1p(-agree))) if 0 < agree < 1 else 1


def radius(least: float, bits: int = SIGNATURE) -> int:
    """The Hamming distance that codes of a pair with the cosine `least` exceed with a chance of at most
    `LOST`, if bits agree independently."""
    apart, chance, out = np.arccos(np.clip(least, -1, 1)) / np.pi, 1.0, -1
    while chance > LOST and out < bits:
        out += 1
        chance -= math.comb(bits, out) * apart**out * (1 - apart) ** (bits - out)
    return out


def bucket_keys(x: np.ndarray, projections: np.ndarray, tables: int, width: int) -> np.ndarray:
    """Every unit vector's bucket in each table."""
    bits = (x @ projections >= 0)[:, : tables * width].reshape(len(x), tables, width)
    return (bits * (1 << np.arange(width))).sum(2)


def fit(sample: np.ndarray, seed: int = 0, rounds: int = 30, rotations: int = ROTATIONS) -> list[np.ndarray]:
    """One projection (dim by bits) for each code; a code's bits are the signs of the products."""
    dim = sample.shape[1]
    bits = min(dim, BITS)
    x = unit(sample)
    _, axes = np.linalg.eigh(x.T @ x)
    axes = axes[:, ::-1][:, :bits]
    v, rng, out = x @ axes, np.random.default_rng(seed), []
    for _ in range(rotations):
        r, _ = np.linalg.qr(rng.standard_normal((bits, bits)))
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        out.append(axes @ r)
    return out


def near_duplicates(df: DataFrame, id: str = "vec_id", vector: str = "embedding", least: float = 0.9) -> DataFrame:
    """Columns id, n_links, component_id, kept: one row for each row of `df`."""
    spark = df.sparkSession
    spool = Spool(spark)
    rows = df.select(F.col(id).cast("long").alias("id"), F.col(vector).alias("v"))
    dim = dimension(rows, "v")
    good = usable("v", dim) & F.col("id").isNotNull()
    # Equal vectors are told by two 64-bit hashes, so only those, not vectors, are keys of joins.
    hashed = rows.filter(good).select("id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))
    classes = hashed.groupBy("h1", "h2").agg(F.first("v").alias("v"), F.min("id").alias("rep"), F.count("*").alias("copies"))
    classes = spool.write(classes.withColumn("k", F.monotonically_increasing_id()))
    n = classes.count()
    alone = rows.filter(~good)
    lonely = alone.select(F.col("id").alias(id), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    if not n:
        return lonely
    sample = classes.orderBy(F.xxhash64("v"), "rep").limit(SAMPLE).select("v").toArrow()["v"].combine_chunks()
    sample = matrix(sample, dim)
    bits = min(dim, BITS)
    width = int(np.clip(round(np.log2(n)) - 3, 6, 16))
    tables = max(ROTATIONS * bits // width, tables_for(width, least))
    for attempt in range(DOUBLINGS + 1):
        projections = np.concatenate(fit(sample, rotations=-(-tables * width // bits)), 1)
        met, links = _recall(classes, sample[:PROBES], projections, tables, width, dim, least)
        if met >= (1 - MISS) * links:
            break
        if attempt == DOUBLINGS:
            warnings.warn(f"{met} of {links} links of the probes share a bucket", stacklevel=2)
        else:
            tables *= 2
    shared = spark.sparkContext.broadcast(projections)
    kind = "<f4" if dict(df.dtypes)[vector] == "array<float>" else "<f8"  # vectors travel as they are

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unit(matrix(batch.column(0), dim)) if len(batch) else np.zeros((0, dim))
            keys = bucket_keys(x, shared.value, tables, width)
            signs = np.packbits(x @ shared.value[:, :SIGNATURE] >= 0, axis=1)
            signs = np.pad(signs, ((0, 0), (0, SIGNATURE // 8 - signs.shape[1]))).copy().view("<i8")[:, 0]
            raw = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(x), dim)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array([r.tobytes() for r in raw], pa.binary()), pa.array([r.tobytes() for r in keys.astype(np.uint16)], pa.binary()), pa.array(signs), pa.array(keys.tolist(), pa.list_(pa.int32()))], ["k", "copies", "raw", "keys", "signs", "buckets"])

    coded = spool.write(map_arrow(classes.select("v", "k", "copies"), code, "k long, copies long, raw binary, keys binary, signs long, buckets array<int>"))
    near = radius(least, min(SIGNATURE, projections.shape[1]))
    order = ["t", "bucket", "i", "j"]

    def retrieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches, order):
            k, signs = table["k"].to_numpy(), table["signs"].to_numpy().view(np.uint64)
            met = np.zeros(len(k), bool)
            for start in range(0, len(k), 512):
                close = np.bitwise_count(signs[start : start + 512, None] ^ signs[None]) <= near
                met[start : start + 512] = close.sum(1) > 1  # itself is one
            if met.any():
                yield pa.RecordBatch.from_arrays([table["t"].combine_chunks().filter(pa.array(met)), table["bucket"].combine_chunks().filter(pa.array(met)), pa.array(k[met])], ["t", "bucket", "k"])

    few = _in_blocks(coded.select("k", "signs", F.posexplode("buckets").alias("t", "bucket")), order, ["k", "signs"])
    met = spool.write(map_arrow(few, retrieve, "t int, bucket int, k long").distinct())
    dealt = _in_blocks(met.join(coded.select("k", "copies", "raw", "keys"), "k"), order, ["block", "k", "copies", "raw", "keys"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches, order):
            yield from _links(table, dim, kind, least)

    found = map_arrow(dealt, compare, "a long, b long, n long")
    found = spool.write(found)
    counts = found.filter("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    roots = components(found.filter("b is not null").select("a", "b"), spool)
    linked = classes.select("k", "rep", "copies").join(counts, classes["k"] == counts["a"], "left").join(roots, F.col("k") == F.col("node"), "left")
    linked = linked.withColumn("root", F.coalesce("root", "k"))
    ids = linked.groupBy("root").agg(F.min("rep").alias("component_id"))
    by_class = linked.join(ids, "root").select("k", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    by_vector = classes.select("h1", "h2", "k").join(by_class, "k").drop("k")
    out = hashed.drop("v").join(by_vector, ["h1", "h2"]).select(F.col("id").alias(id), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
    return out.unionByName(lonely)


def _in_blocks(entries: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    """Entries (t, bucket, k, ...) of buckets of two and more, dealt and sorted by pairs of their blocks."""
    sizes = entries.groupBy("t", "bucket").agg(F.count("*").alias("size")).filter("size > 1")
    own = F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int")
    entries = entries.join(sizes, ["t", "bucket"]).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("block", own)
    entries = entries.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = [F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")]
    return entries.select("t", "bucket", *pair, *columns).repartition(*order).sortWithinPartitions(*order, "k")


def _grouped(batches: Iterator[pa.RecordBatch], order: list[str]) -> Iterator[pa.Table]:
    """The groups of equal keys of sorted batches, of two rows and more."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for part in _runs(batch, order):
            if held and not _same(held[-1], part, order):
                if sum(map(len, held)) > 1:
                    yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(part)
    if sum(map(len, held)) > 1:
        yield pa.Table.from_batches(held).combine_chunks()


def _recall(classes: DataFrame, probes: np.ndarray, projections: np.ndarray, tables: int, width: int, dim: int, least: float) -> tuple[int, int]:
    """How many links of the probes with other vectors share a bucket, and how many there are, by brute force."""
    probes = unit(probes)
    shared = classes.sparkSession.sparkContext.broadcast((probes, bucket_keys(probes, projections, tables, width), projections))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes, keys, projections = shared.value
        met = links = 0
        for batch in batches:
            if not len(batch):
                continue
            x = unit(matrix(batch.column(0), dim))
            cosine = x @ probes.T
            a, b = np.nonzero((cosine >= least) & (cosine < 1 - 1e-12))  # not the probe itself
            rows, a = np.unique(a, return_inverse=True)
            own = bucket_keys(x[rows], projections, tables, width)
            met += int((own[a] == keys[b]).any(1).sum())
            links += len(a)
        yield pa.RecordBatch.from_arrays([pa.array([met]), pa.array([links])], ["met", "links"])

    found = map_arrow(classes.select("v"), run, "met long, links long").agg(F.sum("met"), F.sum("links")).first()
    return found[0] or 0, found[1] or 0


def _runs(batch: pa.RecordBatch, order: list[str]) -> Iterator[pa.RecordBatch]:
    """A sorted batch's slices of equal keys."""
    if not len(batch):
        return
    change = np.zeros(len(batch) - 1, bool)
    for name in order:
        x = batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)
        change |= x[1:] != x[:-1]
    edges = [0, *(np.flatnonzero(change) + 1).tolist(), len(batch)]
    for a, b in zip(edges, edges[1:]):
        yield batch.slice(a, b - a)


def _same(a: pa.RecordBatch, b: pa.RecordBatch, order: list[str]) -> bool:
    at = a.schema.get_field_index
    return all(a.column(at(n))[0].as_py() == b.column(at(n))[0].as_py() for n in order)


def _links(table: pa.Table, dim: int, kind: str, least: float) -> Iterator[pa.RecordBatch]:
    """Link counts and a spanning forest of one bucket, or of two of its blocks."""
    get = lambda name: table[name].to_numpy()
    k, copies, block = get("k"), get("copies"), get("block")
    x = unit(np.frombuffer(b"".join(table["raw"].to_pylist()), kind).astype(np.float64).reshape(-1, dim))
    keys = np.frombuffer(b"".join(table["keys"].to_pylist()), np.uint16).reshape(len(k), -1)
    t, i, j = table["t"][0].as_py(), table["i"][0].as_py(), table["j"][0].as_py()
    n = np.zeros(len(k), np.int64)
    label = np.arange(len(k))
    for start in range(0, len(k), 512):
        a, b = np.nonzero(x[start : start + 512] @ x.T >= least)
        a = a + start
        use = (a < b) & (True if i == j else block[a] != block[b])
        a, b = a[use], b[use]
        first = ~(keys[a, :t] == keys[b, :t]).any(1)
        n += np.bincount(a[first], copies[b[first]], len(k)).astype(np.int64) + np.bincount(b[first], copies[a[first]], len(k)).astype(np.int64)
        if len(a):
            label = local_labels(len(k), np.append(np.arange(len(k)), a), np.append(label, b))
    moved = np.flatnonzero(label != np.arange(len(k)))
    some = np.flatnonzero(n)
    ends = np.stack([moved, label[moved]], 1)
    if len(some) or len(ends):
        yield pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([k[some], k[ends[:, 0]]])),
            pa.array([None] * len(some) + k[ends[:, 1]].tolist(), pa.int64()),
            pa.array(np.concatenate([n[some], np.zeros(len(ends), np.int64)])),
        ], ["a", "b", "n"])
