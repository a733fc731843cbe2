"""Clustering, line dedup and whitening against brute force, and their edge cases."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from arcspan.llm import drake_kmeans, line_dedup, whitening
from arcspan.llm.cuckoo import CuckooFilter, buckets_for

VECTORS = "vec_id long, embedding array<double>"


def vectors(rng, n, dim=64, spread=0.1, centres=8):
    middle = rng.standard_normal((centres, dim))
    return [(middle[i % centres] + spread * rng.standard_normal(dim)).tolist() for i in range(n)]


def lloyd(rows, k, rounds, scale=1024, seed=3):
    """Plain rounds with Python's integers."""
    order = sorted((hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), v, [math.floor(Fraction(x) * scale) for x in v]) for i, v in rows)
    found = [(i, [math.floor(Fraction(x) * scale) for x in v]) for i, v in rows]
    c = [x for _, _, x in order[:k]]
    far = lambda x, m: sum((a - b) ** 2 for a, b in zip(x, m))
    assign = lambda: [min(range(len(c)), key=lambda j: (far(x, c[j]), j)) for _, x in found]
    for _ in range(rounds):
        own = assign()
        for j in range(len(c)):
            if mine := [x for (_, x), o in zip(found, own) if o == j]:
                c[j] = [sum(col) // len(mine) for col in zip(*mine)]
    own = assign()
    return [(i, o, far(x, c[o])) for (i, x), o in zip(found, own)], c


@pytest.mark.parametrize("seed, n, k, spread", [(0, 300, 8, 0.1), (1, 400, 8, 3.0), (2, 5, 8, 1.0), (3, 250, 20, 1.0), (4, 50, 1, 1.0), (5, 60, 2, 1.0)])
def test_clusters_equal_plain_rounds(spark, seed, n, k, spread):
    rows = list(enumerate(vectors(np.random.default_rng(seed), n, spread=spread)))
    rows += [(7, rows[0][1]), (None, rows[1][1]), (999, [0.0] * 64)]  # repeated, without id, zero
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    found, centroids = drake_kmeans.cluster(df, k=k)
    want, c = lloyd(rows, k, 10)
    assert centroids == c
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(map(tuple, found.collect()), key=key) == sorted(want, key=key)


def test_bounds_save_distances():
    """Far fewer exact distances than rows times centroids, and assignments that are the nearest."""
    rng = np.random.default_rng(0)
    x = drake_kmeans.integers(np.array(vectors(rng, 2000, centres=16)), 1024)
    c = x[:16].copy()
    state, seen = drake_kmeans.State.scan(x, c, 4), []
    plain_all, plain_one = drake_kmeans.to_all, drake_kmeans.to_one
    try:
        drake_kmeans.to_all = lambda a, b: (seen.append(len(a) * len(b)), plain_all(a, b))[1]
        drake_kmeans.to_one = lambda a, b: (seen.append(len(a)), plain_one(a, b))[1]
        for _ in range(5):
            moved = c + rng.integers(-40, 41, c.shape)
            drift = np.sqrt(((moved - c) ** 2).sum(1)) * (1 + 1e-12)
            c = moved
            state.move(x, c, drift)
            assert (state.own == plain_all(x, c).argmin(1)).all()
    finally:
        drake_kmeans.to_all, drake_kmeans.to_one = plain_all, plain_one
    assert sum(seen) < 5 * 2000 * 16 / 3


def test_clusters_of_odd_rows(spark):
    good = vectors(np.random.default_rng(1), 30)
    rows = [(i, v) for i, v in enumerate(good)]
    odd = [(100, None), (101, []), (102, good[0][:63]), (103, [float("nan")] + good[0][1:]), (104, [float("inf")] + good[0][1:]), (105, [None] + good[0][1:]), (106, good[0] + [0.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows + odd], VECTORS + ", id string, cluster int")
    got = drake_kmeans.clusters(df).collect()
    want, c = lloyd(rows, 8, 10)
    assert sorted((r.vec_id, r.cluster, r.distance) for r in got) == sorted(want)
    assert {(r.cluster, r.centroid_sha256) for r in got} == {(o, hashlib.sha256(",".join(map(str, c[o])).encode()).hexdigest()) for _, o, _ in want}
    assert all(r.inertia == sum(d for _, _, d in want) and r.cluster_inertia == sum(d for _, o, d in want if o == r.cluster) for r in got)
    assert drake_kmeans.clusters(df.filter("vec_id > 99")).count() == 0 and drake_kmeans.clusters(df.limit(0)).count() == 0
    same = spark.createDataFrame([(i, good[0]) for i in range(20)], VECTORS)
    assert {(r.cluster, r.distance) for r in drake_kmeans.clusters(same).collect()} == {(0, 0)}
    huge = spark.createDataFrame([(i, [1e300 if i % 2 else -1e300] * 64) for i in range(20)] + [(50, [1e5] * 64)], VECTORS)
    assert drake_kmeans.clusters(huge).count() == 21


def test_filter_against_sets():
    rng = np.random.default_rng(0)
    for n in (1, 3, 50, 20_000):
        keys = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        f = CuckooFilter(buckets_for(len(keys)))
        for part in np.array_split(keys, 3):
            f.insert(part)
        assert f.contains(keys).all() and f.held == len(keys)
        gone = keys[::2]
        f.delete(gone)
        f = CuckooFilter.from_bytes(f.to_bytes())
        assert f.contains(keys[1::2]).all() and f.held == len(keys) - len(gone)
        others = rng.integers(0, 2**63, 100_000).astype(np.uint64)
        assert f.contains(others).mean() < 0.001
        f.delete(keys[1::2])
        assert not f.table.any() and not len(f.stash) and not f.contains(keys).any()
    full = CuckooFilter(2)  # far too small: the stash takes the rest
    keys = np.arange(1, 60, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    full.insert(keys)
    assert full.contains(keys).all() and len(full.stash) == 59 - 8
    full.delete(keys)
    assert not full.contains(keys).any() and not full.table.any()


def plain_dedup(docs):
    """What is kept of each document's lines; `docs`: rows (id, text)."""
    key = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for i, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                held.setdefault(key(line), set()).add(-1 if i is None else i)
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        stay = [s for s in lines if len(held.get(key(s), ())) < 3 or max(held[key(s)]) == (-1 if i is None else i)]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


def corpus(seed, n):
    rng = random.Random(seed)
    pool = [f"line number {i} of the pool" for i in range(40)] + ["short", "", "  ", "ÄÖÜ äöü with twenty signs", "x" * 19, "y" * 20]
    spice = lambda s: rng.choice([s, s.upper(), f"  {s}\t", f"{s}\r"])
    docs = [(i, "\n".join(spice(rng.choice(pool[: rng.choice([3, 46])])) for _ in range(rng.randrange(0, 12)))) for i in range(n)]
    return docs + [(n, None), (n + 1, ""), (n + 2, "\n\n"), (3, "line number 1 of the pool\nmine"), (None, "line number 2 of the pool\nits own line that nobody else has")]


def cleaned(index, docs, spark):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    key = lambda r: (r[0] is None, r[0] or 0, r[3])
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in index.clean(df).collect()), key=key), sorted(plain_dedup(docs), key=key)


def test_lines_of_batches_and_deletions(spark):
    """After any insertions and deletions the index says what a fresh one of the rest would say."""
    docs = corpus(0, 60)
    read = lambda d: spark.createDataFrame(d, "doc_id long, text string")
    index = line_dedup.LineIndex(spark, shards=4)
    index.insert(read(docs[:20]))
    got, want = cleaned(index, docs[:20], spark)
    assert got == want and any(r[2] for r in want)
    index.insert(read(docs[20:]))
    got, want = cleaned(index, docs, spark)
    assert got == want
    index.delete(read([(i, None) for i in range(30, 55)] + [(12345, None)]))  # among them the largest ids of many lines
    rest = [d for d in docs if d[0] is None or not 30 <= d[0] < 55]
    got, want = cleaned(index, rest, spark)
    assert got == want and any(r[2] for r in want)
    index.delete(read([d for d in rest if d[0] != 4]))
    assert {r[2] for r in cleaned(index, [d for d in docs if d[0] == 4], spark)[0]} == {0}
    assert index.filters().agg({"held": "sum"}).first()[0] == 0
    index.insert(read(docs))
    again = line_dedup.LineIndex(spark, index.path, shards=4)
    got, want = cleaned(again, docs, spark)
    assert again.generation == 5 and got == want
    counts = {r.h: (r.n, r.largest) for r in again.counts().filter("n > 0").collect()}
    fresh = line_dedup.LineIndex(spark)
    fresh.insert(read(docs))
    assert counts == {r.h: (r.n, r.largest) for r in fresh.counts().collect()}


def test_filters_grow(spark):
    """Batches that make filters too small have them built again from the exact table."""
    docs = [(10 * b + i, "\n".join(f"repeated line {j} of batch {b}" for j in range(80))) for b in range(3) for i in range(3)]
    index = line_dedup.LineIndex(spark, shards=2)
    for b in range(3):
        index.insert(spark.createDataFrame(docs[3 * b : 3 * b + 3], "doc_id long, text string"))
    assert {r.held for r in index.filters().collect()} and index.filters().agg({"held": "sum"}).first()[0] == 240
    got, want = cleaned(index, docs, spark)
    assert got == want and sum(r[2] for r in want) == 480


def test_lines_edge_cases(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    index = line_dedup.LineIndex(spark)
    index.insert(empty)
    assert index.clean(empty).count() == 0
    long = "\n".join(f"a line of a very long text {i % 5000}" for i in range(60_000))
    rows = [(i, long if i < 3 else "A LINE of a very long text 7", i, "b", i) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines int, gone string, `_DOC` long")
    index.insert(df)
    got = {r.doc_id: r for r in index.clean(df).collect()}
    want = {r[0]: r for r in plain_dedup([r[:2] for r in rows])}
    assert {i: (r.n_lines, r.n_dropped, r.text) for i, r in got.items()} == {i: r[1:] for i, r in want.items()}
    assert all(r["gone"] == "b" and r["_DOC"] == i for i, r in got.items())


@pytest.mark.parametrize("n, dim", [(400, 64), (100, 5), (3, 4), (1, 8), (50, 20)])
def test_whitening_equals_eigenvectors(spark, n, dim):
    rng = np.random.default_rng(n)
    x = rng.standard_normal((n, dim)) * np.linspace(3, 0.5, dim)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, x[0].tolist()) for i in range(40)]
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS).repartition(23)).collect()
    whole = {i: [math.floor(64 * c) + 1_000_000 for c in v] for i, v in rows}
    fit = np.array(sorted({tuple(v) for v in whole.values()}))
    m, sums = len(fit), fit.sum(0)
    centred = (m * fit - sums) / m
    values, axes = np.linalg.eigh(centred.T @ centred / m)
    values, axes = values[::-1], axes[:, ::-1]
    rank = min(16, dim, m - 1)
    assert {(r.vec_id, r.component) for r in got} == {(i, c) for i in whole for c in range(1, rank + 1)} and len(got) == len(rows) * rank
    white = {}
    for r in got:
        d = [m * a - int(s) for a, s in zip(whole[r.vec_id], sums)]
        assert r.n == m and r.deviation == sum(v * v for v in d)
        assert abs(r.explained - values[r.component - 1] / values.sum()) < 1e-10 and r.identity_error < 1e-8
        white.setdefault(r.component, []).append((r.whitened, float(np.array(d) / m @ axes[:, r.component - 1] / math.sqrt(values[r.component - 1]))))
    for pairs in white.values():
        a, b = np.array(pairs).T
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-6


def test_factors_merge_in_a_tree(spark):
    """More partitions than one task merges, some empty."""
    x = np.random.default_rng(0).integers(-50, 50, (300, 6))
    df = spark.createDataFrame([(v.tolist(),) for v in x], "x array<long>").repartition(70)
    sums = x.sum(0).tolist()
    r = whitening.tsqr(df, 6, 300, sums, whitening.Spool(spark))
    centred = x - np.array(sums) / 300
    assert np.allclose(r.T @ r, centred.T @ centred)


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(2)
    fine = [(i, v) for i, v in enumerate(rng.standard_normal((30, 6)).tolist())] + [(None, [0.0] * 6)]
    odd = [(100, None), (101, [1.0] * 7), (102, [float("nan")] * 6), (103, [None] * 6), (104, [float("-inf")] + [0.0] * 5), (105, [])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in fine + odd], VECTORS + ", x int, component int")
    got = whitening.whiten(df).collect()
    assert {r.vec_id for r in got} == {i for i, _ in fine} and {r.n for r in got} == {31}
    assert whitening.whiten(df.filter("vec_id in (100, 102, 103)")).count() == 0 and whitening.whiten(df.limit(0)).count() == 0
    flat = spark.createDataFrame([(i, [1.0, float(i), 2.0]) for i in range(9)], VECTORS)
    assert {r.component for r in whitening.whiten(flat).collect()} == {1}
    huge = spark.createDataFrame([(i, [1e300 * (-1) ** i, float(i), 0.0]) for i in range(9)], VECTORS)
    assert {r.deviation for r in whitening.whiten(huge).collect()} == {None}
