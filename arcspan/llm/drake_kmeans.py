"""Centroid clustering (Lloyd's rounds) with Drake's adaptive distance bounds, exact to the last integer.

Components become integers floor(scale * x), so distances and means are exact and do not depend on
the order of rows. Vectors travel in blocks of up to `BLOCK`; with each vector goes its state: the
centroid it is assigned to, an upper bound of its distance, the `b` centroids that were nearest
after that with a lower bound each, and one more bound for all others. A round moves the bounds by the
centroids' drifts. Where the upper bound is under every lower bound the assignment stands unseen;
else the distance to the own centroid is taken exactly, then those to the named centroids whose
bound it reaches, and where the order is open even then, to all. Bounds are rounded outwards, so a
tie or a rounding error leads to an exact comparison, never to a wrong assignment. After each round
`b` falls to the deepest name that any vector needed (but not under an eighth of the centroids).

A round is one map over blocks, written to the shared folder, so a lost executor costs the tasks
that it ran. Blocks report what their moved vectors add to and take from each centroid's sums; only
those totals (centroids by dimensions) reach the driver, and no row is shuffled. A round that moves
no centroid ends the loop, as further rounds would repeat it.

Edge cases: vectors that are null, of another length or that hold null or non-finite components are
left out; zero vectors are kept. A null id counts as empty text where centroids are chosen, and rows
that repeat an id are vectors of their own (the smaller vector comes first). With fewer vectors
than centroids there are as many centroids as vectors; an empty table gives an empty table.
Components saturate at integers of 2**62; distances and sums over them are exact, and null where a
long can't hold them. Other columns of the table are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Spool, map_arrow

#: Vectors of a block; the share by which bounds are rounded outwards; the largest saturated integer.
BLOCK, SLACK, MOST = 4_096, 1e-12, 2**62
STATE = "ids array<long>, x binary, wide boolean, own binary, upper binary, named binary, lower binary, moved array<decimal(38,0)>, depth int"


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as 64-bit integers."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(x * scale), -MOST, MOST).astype(np.int64)


def _exactly(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as doubles if all sums of squares of differences are exact in these, else as Python integers."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(y).max(initial=0)))
    kind = np.float64 if x.shape[-1] * (2 * top + 1) ** 2 < 2**53 else object
    return x.astype(kind), y.astype(kind)


def to_all(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all centroids."""
    x, c = _exactly(x, c)
    return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)


def to_one(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row to the centroid beside it."""
    x, c = _exactly(x, c)
    return ((x - c) ** 2).sum(1)


def _root(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64))


class State:
    """Assignments and bounds of a block's vectors."""

    def __init__(self, own: np.ndarray, upper: np.ndarray, named: np.ndarray, lower: np.ndarray):
        self.own, self.upper, self.named, self.lower = own, upper, named, lower  # lower's last column: all others

    @classmethod
    def scan(cls, x: np.ndarray, c: np.ndarray, b: int) -> State:
        """By the distances to all centroids."""
        squared = to_all(x, c)
        order = np.argsort(squared, axis=1, kind="stable")  # ties: the smaller number
        near = _root(np.take_along_axis(squared, order[:, : b + 2], 1))
        beyond = near[:, b + 1] if len(c) > b + 1 else np.full(len(x), np.inf)
        lower = np.concatenate([near[:, 1 : b + 1], beyond[:, None]], 1) * (1 - SLACK)
        return cls(order[:, 0], near[:, 0] * (1 + SLACK), order[:, 1 : b + 1], lower)

    def narrow(self, b: int) -> None:
        """Keep the b nearest names; what is left out joins the bound of all others."""
        if b < self.named.shape[1]:
            order = np.argsort(self.lower[:, :-1], axis=1, kind="stable")
            sorted_ = np.take_along_axis(self.lower[:, :-1], order, 1)
            rest = np.minimum(self.lower[:, -1], sorted_[:, b])
            self.named = np.take_along_axis(self.named, order, 1)[:, :b]
            self.lower = np.concatenate([sorted_[:, :b], rest[:, None]], 1)

    def move(self, x: np.ndarray, c: np.ndarray, drift: np.ndarray) -> int:
        """Assign anew after the centroids moved to `c`; how many names any vector needed at most."""
        self.upper = (self.upper + drift[self.own]) * (1 + SLACK)
        by = np.concatenate([drift[self.named], np.full((len(x), 1), drift.max())], 1)
        self.lower = self.lower - by - SLACK * (np.where(np.isfinite(self.lower), np.abs(self.lower), 0) + by)
        rows = np.flatnonzero(~(self.upper < self.lower.min(1)))
        if not len(rows):
            return 0
        best = to_one(x[rows], c[self.own[rows]])
        self.upper[rows] = _root(best) * (1 + SLACK)
        open_ = ~(self.upper[rows] < self.lower[rows].min(1))
        rows, best = rows[open_], best[open_]
        if not len(rows):
            return 0
        asked = ~(self.upper[rows, None] < self.lower[rows, :-1])
        own, winner = self.own[rows].copy(), np.full(len(rows), -1)
        at_own = best.copy()
        for j in range(asked.shape[1]):
            some = np.flatnonzero(asked[:, j])
            if not len(some):
                continue
            name = self.named[rows[some], j]
            squared = to_one(x[rows[some]], c[name])
            self.lower[rows[some], j] = _root(squared) * (1 - SLACK)
            wins = (squared < best[some]) | ((squared == best[some]) & (name < own[some]))
            best[some[wins]], own[some[wins]], winner[some[wins]] = squared[wins], name[wins], j
        swap = np.flatnonzero(winner >= 0)  # the former centroid takes the winner's place among the names
        self.named[rows[swap], winner[swap]] = self.own[rows[swap]]
        self.lower[rows[swap], winner[swap]] = _root(at_own[swap]) * (1 - SLACK)
        self.own[rows], self.upper[rows] = own, _root(best) * (1 + SLACK)
        unsure = rows[~(self.upper[rows] < self.lower[rows, -1])]
        if len(unsure):
            again = State.scan(x[unsure], c, self.named.shape[1])
            self.own[unsure], self.upper[unsure], self.named[unsure], self.lower[unsure] = again.own, again.upper, again.named, again.lower
            return self.named.shape[1]
        return int(asked.sum(1).max())


def _sums(x: np.ndarray, own: np.ndarray, into: np.ndarray, sign: int, wide: bool) -> None:
    """Add (or take away) each centroid's vectors and their number."""
    for c in np.unique(own):
        some = x[own == c]
        into[c, :-1] += sign * some.sum(0, dtype=object if wide else np.int64).astype(object)
        into[c, -1] += sign * len(some)


def _pack(ids: pa.Array, x: np.ndarray, state: State, moved: np.ndarray, depth: int) -> pa.RecordBatch:
    wide = bool(np.abs(x).max(initial=0) > 32_767)
    one = lambda data: pa.array([data.tobytes()], pa.binary())
    return pa.RecordBatch.from_arrays([
        pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), one(x.astype("<i8" if wide else "<i2")), pa.array([wide]),
        one(state.own.astype("<u2")), one(state.upper), one(state.named.astype("<u2")), one(state.lower),
        pa.array([[Decimal(int(v)) for v in moved.ravel()]] if moved.any() else [None], pa.list_(pa.decimal128(38, 0))), pa.array([depth], pa.int32()),
    ], ["ids", "x", "wide", "own", "upper", "named", "lower", "moved", "depth"])


def _unpack(batch: pa.RecordBatch, dim: int) -> Iterator[tuple[pa.Array, np.ndarray, bool, State]]:
    get = {name: batch.column(name) for name in batch.schema.names}
    for i in range(len(batch)):
        wide = get["wide"][i].as_py()
        x = np.frombuffer(get["x"][i].as_py(), "<i8" if wide else "<i2").astype(np.int64).reshape(-1, dim)
        part = lambda name, kind: np.frombuffer(get[name][i].as_py(), kind).copy()
        state = State(part("own", "<u2").astype(np.int64), part("upper", "<f8"), part("named", "<u2").astype(np.int64).reshape(len(x), -1), part("lower", "<f8").reshape(len(x), -1))
        yield get["ids"][i].values, x, wide, state


def kept(vector: str, dim: int) -> F.Column:
    """Whether a vector has `dim` components, none null or non-finite."""
    x = F.col(vector)
    return F.coalesce((F.size(x) == dim) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))), F.lit(False))


def cluster(df: DataFrame, k: int = 8, rounds: int = 10, id: str = "vec_id", vector: str = "embedding", dim: int = 64, scale: int = 1024, seed: int = 3) -> tuple[DataFrame, list[list[int]]]:
    """Columns id, cluster, distance (squared) of every kept vector, and the final centroids.

    The first centroids are the `k` (65,535 at most) vectors with the smallest sha256 of "seed:id". The table
    returned is written to the shared folder; centroids (`k` by `dim` integers) are all that the driver holds.
    """
    if not 0 < k < 2**16:
        raise ValueError("k must be from 1 to 65,535")
    spark, spool = df.sparkSession, Spool(df.sparkSession)
    rows = df.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter(kept("v", dim))
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    first = rows.orderBy(F.sha2(text, 256), "v").limit(k).collect()
    schema = f"{id} long, cluster int, distance long"
    if not first:
        return spark.createDataFrame([], schema), []
    centroids = integers(np.array([r.v for r in first]), scale)
    count = len(centroids)
    b, least = max(1, min(-(-count // 4), count - 1)), max(1, count // 8)
    b = min(b, count - 1)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            x = integers(table["v"].combine_chunks().flatten().to_numpy().reshape(-1, dim), scale)
            state, sums = State.scan(x, centroids, b), np.zeros((count, dim + 1), object)
            _sums(x, state.own, sums, 1, bool(np.abs(x).max() > 2**40))
            return _pack(table["id"].combine_chunks(), x, state, sums, b)

        for batch in batches:
            for start in range(0, len(batch), BLOCK):
                part = batch.slice(start, BLOCK)
                if held and sum(map(len, held)) + len(part) > BLOCK:
                    yield block()
                    held.clear()
                held.append(part)
        if sum(map(len, held)):
            yield block()

    blocks = spool.write(map_arrow(rows, begin, STATE))
    sums = np.zeros((count, dim + 1), object)
    for _ in range(rounds):
        for r in blocks.select(F.posexplode("moved")).groupBy("pos").agg(F.sum("col").alias("s")).collect():
            sums[divmod(r.pos, dim + 1)] += int(r.s)
        means = np.array([[int(s) // int(row[-1]) for s in row[:-1]] if row[-1] else old.tolist() for row, old in zip(sums, centroids)], np.int64)
        drift = _root(to_one(means, centroids)) * (1 + SLACK)
        centroids = means
        if not drift.any():
            break
        after = spool.write(map_arrow(blocks.drop("moved", "depth"), _round(centroids, drift, dim, b), STATE))
        spool.drop(blocks)
        blocks = after
        b = min(b, max(least, blocks.agg(F.max("depth")).first()[0] or 0))
    final = centroids

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, x, _, state in _unpack(batch, dim):
                squared = to_one(x, final[state.own])
                far = [int(v) if v < 2**63 else None for v in squared]
                yield pa.RecordBatch.from_arrays([ids, pa.array(state.own.astype(np.int32)), pa.array(far, pa.int64())], [id, "cluster", "distance"])

    out = spool.write(map_arrow(blocks.drop("moved", "depth"), unfold, schema))
    spool.drop(blocks)
    return out, centroids.tolist()


def _round(centroids: np.ndarray, drift: np.ndarray, dim: int, b: int):
    """The map of one round: state in, state out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, x, wide, state in _unpack(batch, dim):
                state.narrow(b)
                before = state.own.copy()
                depth = state.move(x, centroids, drift)
                sums, moved = np.zeros((len(centroids), dim + 1), object), state.own != before
                _sums(x[moved], state.own[moved], sums, 1, wide)
                _sums(x[moved], before[moved], sums, -1, wide)
                yield _pack(ids, x, state, sums, depth)

    return run


def digest(centroid: list[int]) -> str:
    """sha256 of a centroid's integers, joined by commas."""
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def clusters(df: DataFrame, id: str = "vec_id", **options) -> DataFrame:
    """`cluster` with the inertia (sum of squared distances) of each cluster and of all, and each centroid's digest."""
    found, centroids = cluster(df, id=id, **options)
    whole = F.count("*") == F.count("distance")
    sums = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.when(whole, F.sum(F.col("distance").cast("decimal(38,0)"))).alias("s")).collect()}
    fits = lambda v: None if v is None or v >= 2**63 else int(v)
    total = None if None in sums.values() else fits(sum(sums.values()))
    facts = [(c, fits(sums[c]) if c in sums else 0, total, digest(m)) for c, m in enumerate(centroids)]
    # One row for each centroid, k at most.
    facts = df.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select(id, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle_sql(k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """The same rows by DuckDB: every round by the distances to all centroids."""

    def assign(n: int) -> str:
        far = f"list_sum(list_transform(range(1, {dim + 1}), lambda i: (x[i] - m[i]) * (x[i] - m[i])))::BIGINT"
        return f"a{n} AS MATERIALIZED (SELECT rid, arg_min(struct_pack(c := c, d := d), (d, c)) AS s FROM (SELECT rid, c, {far} AS d FROM v, c{n}) GROUP BY rid)"

    def update(n: int) -> str:
        parts = f"SELECT a.s.c AS c, t.j AS j, sum(x[t.j])::HUGEINT AS total, count(*) AS n FROM a{n - 1} a JOIN v USING (rid), (SELECT unnest(range(1, {dim + 1})) AS j) t GROUP BY 1, 2"
        found = f"SELECT c, list(((total - ((total % n) + n) % n) // n)::BIGINT ORDER BY j) AS m FROM ({parts}) GROUP BY c"
        return f"c{n} AS MATERIALIZED (SELECT o.c, coalesce(f.m, o.m) AS m FROM c{n - 1} o LEFT JOIN ({found}) f ON f.c = o.c)"

    steps = [assign(0)] + [s for n in range(1, rounds + 1) for s in (update(n), assign(n))]
    finite = "len(list_filter(embedding, lambda z: z IS NOT NULL AND isfinite(z)))"
    start = f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(vec_id::VARCHAR, '')), e) - 1 AS c, x AS m FROM v QUALIFY c < {k})"
    rows = f"v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, embedding AS e, list_transform(embedding, lambda z: floor({scale} * z::DOUBLE)::BIGINT) AS x FROM embeddings WHERE len(embedding) = {dim} AND {finite} = {dim})"
    last = f"r AS (SELECT vec_id, a.s.c AS c, a.s.d AS d FROM a{rounds} a JOIN v USING (rid))"
    inertia = "sum(d) OVER (PARTITION BY r.c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia"
    return f"WITH {rows}, {start}, {', '.join(steps)}, {last} SELECT vec_id, r.c::INTEGER AS cluster, d AS distance, {inertia}, sha256(array_to_string(m, ',')) AS centroid_sha256 FROM r JOIN c{rounds} f ON f.c = r.c"
