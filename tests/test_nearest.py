"""Exact nearest vectors against brute force."""

import numpy as np
import pytest

from arcspan.operators import nearest


def brute(queries, rows, k, groups=None):
    """(query, group, rank, id, distance) by plain sums."""
    out = []
    for name, q, wanted in queries:
        for g in wanted if groups else [None]:
            fine = [(sum((a - b) * (a - b) for a, b in zip(q, v)), i) for i, v, of in rows if q and v and len(q) == len(v) and all(x is not None and np.isfinite(x) for x in v) and (not groups or of == g)]
            out += [(name, g, r, i, d) for r, (d, i) in enumerate(sorted(fine)[:k], 1)]
    return sorted(out, key=str)


def rows_of(rng, n):
    base = rng.integers(-3, 4, (n, 5)).astype(float)  # whole numbers: many ties
    rows = [(f"v{i:03d}", v.tolist(), "ab"[i % 2]) for i, v in enumerate(base)]
    return rows + [("v000", base[1].tolist(), "a"), ("n1", None, "a"), ("n2", [], "a"), ("n3", [1.0, None, 1.0, 1.0, 1.0], "b"), ("n4", [float("nan")] * 5, "b"), ("s1", [0.0, 1.0], "a"), ("far", [1e200] * 5, "a")]


@pytest.mark.parametrize("grouped", [False, True])
@pytest.mark.parametrize("tree", [False, True])
def test_against_brute_force(spark, monkeypatch, grouped, tree):
    if tree:  # two levels, and products and candidates in small pieces
        for name, value in (("PARTITION", 1), ("FAN", 3), ("PRODUCTS", 60)):
            monkeypatch.setattr(nearest, name, value)
    rng = np.random.default_rng(0)
    rows = rows_of(rng, 150)
    queries = [(i, rng.integers(-3, 4, 5).astype(float).tolist(), ["a", "b", "none"][: 1 + i % 3]) for i in range(20)]
    queries += [(50, [0.0, 0.0], ["a"]), (51, None, ["a"]), (52, [float("inf")] * 5, ["a"]), (53, [1e200] * 5, ["a"])]
    v = spark.createDataFrame([(i, x, g, 1) for i, x, g in rows], "id string, v array<double>, source string, rank int").repartition(10)
    q = spark.createDataFrame(queries, "qid long, q array<double>, providers array<string>")
    got = nearest.nearest(q, v, "qid", "id", "v", 7, group="source" if grouped else None).collect()
    got = sorted(((r.qid, r.source if grouped else None, r["rank"], r.id, r.distance) for r in got), key=str)
    want = brute([x for x in queries if x[1] and np.isfinite(x[1]).all()], rows, 7, grouped)
    assert [x[:4] for x in got] == [x[:4] for x in want] and np.allclose([x[4] for x in got], [x[4] for x in want])


def test_many_queries_and_few_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, v.tolist(), None) for i, v in enumerate(rng.standard_normal((300, 16)))]
    v = spark.createDataFrame([r[:2] for r in rows], "id long, v array<float>").repartition(3)
    exact = [(r.id, [float(x) for x in r.v], None) for r in v.collect()]
    q = spark.createDataFrame([r[:2] for r in exact], "qid long, q array<double>")
    got = sorted(((r.qid, None, r["rank"], r.id) for r in nearest.nearest(q, v, "qid", "id", "v", 3, most=100).collect()), key=str)
    assert got == [x[:4] for x in brute(exact, exact, 3)]
    assert nearest.nearest(q, v.limit(0), "qid", "id", "v", 3).count() == 0 and nearest.nearest(q.limit(0), v, "qid", "id", "v", 3).count() == 0
    assert nearest.nearest(q, v.limit(2), "qid", "id", "v", 3).count() == 600


def test_no_pair_is_a_row(spark):
    """Neither a nested loop nor a sort of pairs is in the plan."""
    v = spark.range(100).selectExpr("id", "array(double(id), 1d) as v")
    plan = nearest.nearest(v.selectExpr("id as qid", "v as q"), v, "qid", "id", "v", 3)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan and "Window" not in plan
