"""Embedding whitening by a tall-and-skinny QR decomposition (TSQR).

Components become long integers floor(scale * c) + offset. The transform is fitted on each distinct
integer vector once: sums by dimension are exact, so centring, (n * x - sum) / n, rounds once; every task
reduces its centred rows to one triangular factor R, block by block; factors are stacked and reduced
again, `FAN` at a time, in a tree of shuffles; and the singular value decomposition of the last one gives the
principal axes (right vectors) and the eigenvalues (squared singular values over n). No covariance
of the rows is formed, so small eigenvalues keep their digits. What reaches the driver is one
triangle and the sums: dimensions squared, whatever the number of rows.

How white the result is gets measured by another pass over the fit list: the largest entry by
which the covariance of the whitened, centred rows differs from the identity.

Edge cases: rows whose vector is null or holds null or non-finite entries are left out, as are those
of another length than most of the rest (the shorter length where two are equally frequent). Rows
with a null id or a repeated id are kept as they are. Axes without variance (eigenvalue under `FLAT`
times the largest) can't be scaled to 1 and are left out, so a single distinct vector gives no
rows; so does an empty table. Integers saturate at 2**62; deviations are exact, and null where a
long can't hold them. Other columns of the table are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Spool, map_arrow

#: Rows that are reduced at once; factors that one task of the tree merges; share of the largest eigenvalue that counts as none.
ROWS, FAN, FLAT = 8_192, 16, 1e-13
MOST = 2**62


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """An Arrow column of equally long lists as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exact: 64-bit integers where they suffice, else Python's."""
    top = max(int(np.abs(x).max(initial=0)) * n, max(map(abs, sums), default=0))
    kind = np.int64 if 2 * top < 2**63 else object
    return x.astype(kind) * n - np.array(sums, kind)


def squares(d: np.ndarray) -> list[int | None]:
    """Each row's exact sum of squares; None where a long can't hold it."""
    if d.dtype != object and int(np.abs(d).max(initial=0)) ** 2 * max(d.shape[1], 1) < 2**63:
        return (d * d).sum(1).tolist()
    return [int(v) if v < 2**63 else None for v in (d.astype(object) ** 2).sum(1)]


def triangle(r: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
    """The R factor of `rows` under the R factor so far."""
    return np.linalg.qr(rows if r is None else np.concatenate([r, rows]), mode="r")


def _batches(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[np.ndarray]:
    """The first column's rows, `ROWS` and more at a time."""
    held: list[np.ndarray] = []
    for batch in batches:
        if len(batch):
            held.append(matrix(batch.column(0), dim))
        if sum(map(len, held)) >= ROWS:
            yield np.concatenate(held)
            held = []
    if held:
        yield np.concatenate(held)


def _factor(part: int, r: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([r.astype("<f8").tobytes()], pa.binary())], ["part", "r"])


def tsqr(rows: DataFrame, dim: int, n: int, sums: list[int], spool: Spool) -> np.ndarray:
    """The R factor of (x - sums / n) for the column x (array<long>) of `rows`, reduced in a tree of shuffles."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, part = None, None

        def arrays() -> Iterator[pa.RecordBatch]:
            nonlocal part
            for batch in batches:
                if len(batch):
                    part = batch.column(1)[0].as_py()
                yield batch

        for x in _batches(arrays(), dim):
            r = triangle(r, deviations(x, n, sums).astype(np.float64) / n)
        if r is not None:
            yield _factor(part, r)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, r = None, None
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if r is not None and part != now:
                    yield _factor(now, r)
                    r = None
                now, r = part, triangle(r, np.frombuffer(data, "<f8").reshape(-1, dim))
        if r is not None:
            yield _factor(now, r)

    schema = "part long, r binary"
    factors = spool.write(map_arrow(rows.select("x", F.spark_partition_id().alias("part")), reduce, schema))
    while factors.count() > FAN:
        nearby = factors.select(F.floor(F.col("part") / FAN).cast("long").alias("part"), "r")
        after = spool.write(map_arrow(nearby.repartition("part").sortWithinPartitions("part"), merge, schema))
        spool.drop(factors)
        factors = after
    r = None
    for row in factors.orderBy("part").collect():  # FAN triangles at most
        r = triangle(r, np.frombuffer(row.r, "<f8").reshape(-1, dim))
    return r


def _totals(rows: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Number of rows and exact sums by dimension of the column x."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(dim + 1, object)
        for x in _batches(batches, dim):
            sums[:dim] += x.sum(0, dtype=np.int64 if int(np.abs(x).max()) < 2**40 else object).astype(object)
            sums[dim] += len(x)
        yield pa.RecordBatch.from_arrays([pa.array([[Decimal(int(v)) for v in sums]], pa.list_(pa.decimal128(38, 0)))], ["sums"])

    found = map_arrow(rows.select("x"), add, "sums array<decimal(38,0)>").select(F.posexplode("sums"))
    sums = [int(r.s) for r in found.groupBy("pos").agg(F.sum("col").alias("s")).orderBy("pos").collect()]
    return (sums[dim], sums[:dim]) if sums else (0, [])


def _identity_error(rows: DataFrame, dim: int, n: int, sums: list[int], axes: np.ndarray) -> float:
    """Largest entry by which the covariance of the whitened rows differs from the identity."""
    k = axes.shape[1]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, products = np.zeros(k), np.zeros((k, k))
        for x in _batches(batches, dim):
            w = (deviations(x, n, sums).astype(np.float64) / n) @ axes
            total += w.sum(0)
            products += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([total, products.ravel()]).tolist()], pa.list_(pa.float64()))], ["sums"])

    found = map_arrow(rows.select("x"), add, "sums array<double>").select(F.posexplode("sums"))
    found = np.array([r.s for r in found.groupBy("pos").agg(F.sum("col").alias("s")).orderBy("pos").collect()])
    # Rows are centred before they are multiplied; what is left of their mean is rounding.
    mean = found[:k] / n
    return float(np.abs(found[k:].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())


class Whitening:
    """A fitted transform: n, sums by dimension, `axes` (dimensions by components, scaled), shares of variance, `error`."""

    def __init__(self, dim: int, n: int, sums: list[int], axes: np.ndarray, explained: np.ndarray, error: float):
        self.dim, self.n, self.sums, self.axes, self.explained, self.error = dim, n, sums, axes, explained, error


def integer_vectors(df: DataFrame, id: str, vector: str, scale: int, offset: int) -> tuple[DataFrame, int]:
    """Columns id, x (array<long>) of the rows that take part, and the length of their vectors."""
    v = F.col("v")
    fine = F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))), F.lit(False))
    rows = df.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter(fine)
    top = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = top[0] if top else 0
    whole = F.transform("v", lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(float(MOST))), F.lit(-float(MOST)))).cast("long") + offset)
    return rows.filter(F.size("v") == dim).select("id", whole.alias("x")), dim


def fit(rows: DataFrame, dim: int, components: int = 16) -> Whitening | None:
    """The transform of `integer_vectors`' rows to at most `components` axes; None where nothing varies."""
    spool = Spool(rows.sparkSession)
    distinct = spool.write(rows.select("x").distinct())
    n, sums = _totals(distinct, dim) if dim else (0, [])
    if not n:
        return None
    _, singular, right = np.linalg.svd(tsqr(distinct, dim, n, sums, spool))
    values = singular**2 / n
    keep = [i for i in range(min(components, len(values))) if values[i] > FLAT * values[0] and values[i] > 0]
    if not keep:
        return None
    right = right[keep]
    right *= np.where(np.take_along_axis(right, np.abs(right).argmax(1)[:, None], 1) < 0, -1.0, 1.0)
    axes = right.T / np.sqrt(values[keep])
    out = Whitening(dim, n, sums, axes, values[keep] / values.sum(), _identity_error(distinct, dim, n, sums, axes))
    spool.drop(distinct)
    return out


def transform(rows: DataFrame, model: Whitening) -> DataFrame:
    """Columns id, deviation, whitened (array, one entry a component) of `integer_vectors`' rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                d = deviations(matrix(batch.column(1), model.dim), model.n, model.sums)
                white = (d.astype(np.float64) / model.n) @ model.axes
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(squares(d), pa.int64()), pa.array(white.tolist(), pa.list_(pa.float64()))], ["id", "deviation", "whitened"])

    return map_arrow(rows, run, "id long, deviation long, whitened array<double>")


def whiten(df: DataFrame, components: int = 16, id: str = "vec_id", vector: str = "embedding", scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """One row for each row that takes part and each component (from 1, by falling variance).

    Columns: id, component, n (distinct vectors), deviation (exact sum of (n * x - sum)^2), whitened,
    explained (the component's share of all variance) and identity_error (of the whole transform).
    """
    rows, dim = integer_vectors(df, id, vector, scale, offset)
    model = fit(rows, dim, components)
    if model is None:
        return df.sparkSession.createDataFrame([], f"{id} long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    out = transform(rows, model).select(F.col("id").alias(id), "deviation", F.posexplode("whitened").alias("at", "whitened"))
    explained = F.element_at(F.array(*(F.lit(float(e)) for e in model.explained)), F.col("at") + 1)
    return out.select(id, (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(model.error).alias("identity_error"))
