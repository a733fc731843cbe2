"""Joins, near-duplicates and searches against brute force."""

import random
import re

import numpy as np
import pytest

from arcspan.llm import embedding_dedup, hilbert_search, license_scan, ngram_join
from arcspan.llm.common import Spool
from arcspan.llm.components import components
from arcspan.llm.shingles import shingle_sets


def _find(parent, a):
    while parent[a] != a:
        a = parent[a]
    return a


def _components(n, edges):
    parent = list(range(n))
    for a, b in edges:
        a, b = _find(parent, a), _find(parent, b)
        parent[max(a, b)] = min(a, b)
    return [_find(parent, k) for k in range(n)]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(k, k + 1) for k in range(100, 140)] + [(5, 5)]
    got = dict(components(spark.createDataFrame(edges + [(None, 3)], "a long, b long"), Spool(spark)).collect())
    want = _components(200, edges)
    assert got == {k: want[k] for k in {x for e in edges if e[0] != e[1] for x in e}}
    assert components(spark.createDataFrame([], "a long, b long"), Spool(spark)).count() == 0


def _set(text, size=5):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + size]) for k in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} if words else set()


def test_shingle_hashes_agree_with_sets():
    texts = ["a b c d e f", "A b\tC d e f", "a b c d", "a b c", "", None, " \n", "x y z x y z x y z x y z", "word " * 300_000, "é É ü"]
    runs = [(first, counts, h) for first, counts, h in shingle_sets(texts)]
    counts = [c for _, cs, _ in runs for c in cs]
    assert counts == [len(_set(t)) for t in texts]
    h = np.concatenate([x for _, _, x in runs])
    ends = np.cumsum(counts)
    sets = [frozenset(h[e - c : e].tolist()) for e, c in zip(ends, counts)]
    assert sets[0] == sets[1] and sets[2] != sets[3] and len(set(sets)) == len({frozenset(_set(t)) for t in texts})


def _near_copies(rng):
    vocabulary = [f"w{k}" for k in range(3000)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts = [None, "", " \t", "one two", "One two", "one two three", "a b c d e", "a b c d e"]
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([20, 80, 200]))]
        for _ in range(rng.choice([1, 2, 6])):
            copy = list(base)
            for _ in range(rng.randrange(0, 6)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy).upper() if rng.random() < 0.3 else " ".join(copy))
    texts += [" ".join([*(rng.choice(vocabulary) for _ in range(100)), *passage]) for _ in range(25)]
    texts += [" ".join(passage), " ".join(passage[:-4]), " ".join(passage[4:])] + [texts[20]] * 12
    return texts


#: Of the join: all in one block; hot shingles, many chunks and parts; clusters cut into many blocks.
SETTINGS = [(64, {}), (3, {"HOT": 3, "LOCAL": 2, "CHUNK": 800, "PART": 100}), (4, {"BLOCK": 3, "PIVOTS": 1, "CHUNK": 500, "CELLS": 1000}), (5, {"BLOCK": 2, "ENTRIES": 300, "PIVOTS": 2, "HOT": 5})]


@pytest.mark.parametrize("hot,few", SETTINGS)
def test_ngram_join(spark, monkeypatch, hot, few):
    for name, value in few.items():
        monkeypatch.setattr(ngram_join, name, value)
    texts = _near_copies(random.Random(hot))
    sets = [_set(t) for t in texts]
    edges = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = _components(len(sets), edges)
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in enumerate(texts)] + [(None, texts[20], 1, "x")], "doc_id long, text string, n long, h string").repartition(3)
    rows = ngram_join.similar_components(df).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]])
    assert ngram_join.similar_components(df.filter("false")).count() == 0


def _vectors(rng, n, dim=16):
    x = rng.standard_normal((n, dim))
    x[: n // 4] = x[0] + 0.05 * rng.standard_normal((n // 4, dim))
    x[n // 4 : n // 2] = x[n // 2 : n // 2 + n // 4] + 0.1 * rng.standard_normal((n // 4, dim))
    x[5] = x[6]
    return x.astype(np.float32)


BAD = [None, [], [0.0] * 16, [float("nan")] * 16, [1.0] * 5, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15]


def test_embedding_dedup(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    x = _vectors(np.random.default_rng(1), 160)
    n = len(x)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = unit @ unit.T >= 0.9
    want = _components(n, zip(*np.nonzero(np.triu(near, 1))))
    rows = [(k, v.tolist(), "x") for k, v in enumerate(x)] + [(n + k, v, "x") for k, v in enumerate(BAD)] + [(None, x[0].tolist(), "x")]
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, k string")).collect()}
    assert len(got) == len(rows)
    found = sum(got[k]["n_links"] for k in range(n))
    assert 0.97 * (near.sum() - n) <= found <= near.sum() - n
    assert all(got[k]["n_links"] <= near[k].sum() - 1 for k in range(n))
    assert np.mean([got[k]["component_id"] == want[k] for k in range(n)]) > 0.97
    assert all(got[n + k]["n_links"] == 0 and got[n + k]["kept"] and got[n + k]["component_id"] == n + k for k in range(len(BAD)))
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_dedup.near_duplicates(none).count() == 0


def test_embedding_dedup_finds_links_at_any_width(spark):
    """Few dimensions give few bits a code, many rows wide substrings; neither may lose links."""
    x = np.random.default_rng(4).standard_normal((400, 4)).astype(np.float32)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    links = (unit @ unit.T >= 0.9).sum() - len(x)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    found = sum(r["n_links"] for r in embedding_dedup.near_duplicates(df).collect())
    assert 0.97 * links <= found <= links


@pytest.mark.parametrize("width", [6, 11, 14, 16])
def test_embedding_tables_bound_misses(width):
    """Pairs at the smallest cosine share a bucket, at the substring widths of small and large tables."""
    rng = np.random.default_rng(width)
    a, other = (embedding_dedup.unit(rng.standard_normal((4000, 64))) for _ in "ab")
    side = embedding_dedup.unit(other - (other * a).sum(1)[:, None] * a)
    b = 0.9 * a + np.sqrt(1 - 0.81) * side
    tables = embedding_dedup.tables_for(width, 0.9)
    projections = np.concatenate(embedding_dedup.fit(a, rounds=5, rotations=-(-tables * width // 64)), 1)
    keys = [embedding_dedup.bucket_keys(v, projections, tables, width) for v in (a, b)]
    assert (keys[0] == keys[1]).any(1).mean() >= 0.98


def test_hilbert_keys_are_a_curve():
    """On a whole grid the keys are a permutation, and neighbours on the curve are neighbours in space."""
    cells = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    keys = hilbert_search.hilbert_keys(cells, 3)
    assert sorted(keys) == list(range(512))
    walk = cells[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_hilbert_search(spark, monkeypatch):
    monkeypatch.setattr(hilbert_search, "LEAST_BLOCK", 32)
    x = _vectors(np.random.default_rng(2), 600) * np.random.default_rng(3).uniform(0.5, 2, (600, 1)).astype(np.float32)
    n = len(x)
    rows = [(k, v.tolist(), "x") for k, v in enumerate(x)] + [(n + 20 + k, v, "x") for k, v in enumerate(BAD)] + [(None, x[0].tolist(), "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    from pyspark.sql import functions as F

    got = {}
    for r in hilbert_search.search(df, F.col("vec_id") % 20 == 0, 10).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, n, 20))
    hits = 0
    for q, found in got.items():
        found.sort()
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -np.inf
        want = np.lexsort((np.arange(n), -s))[:10]
        hits += len(set(want) & {v for _, v, _ in found})
        assert [r for r, _, _ in found] == list(range(1, 11)) and all(abs(s[v] - y) < 1e-9 for _, v, y in found)
        assert [(-y, v) for _, v, y in found] == sorted((-y, v) for _, v, y in found)
    assert hits / (10 * len(got)) >= 0.9
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in hilbert_search.search(few, F.col("vec_id") == 0).orderBy("rank").collect()] == [(0, 1, 1, 0.5), (0, 2, 2, 0.5)]
    assert hilbert_search.search(few.filter("false"), F.lit(True)).count() == 0


def test_license_scan(spark):
    mit = "Released under the MIT License."
    long = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    filler = " ".join(f"word{k}" for k in range(400))
    texts = [None, "", "MIT License", mit, f"{filler} {mit} {filler}", f"{filler}\n# {long.upper()}\n{filler}", f"{filler} {long.replace('binary', 'object')} {filler}", " ".join(long.split()[:9]), f"{mit} {mit}"]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, w string")
    got = {(r["doc_id"], r["license"]): r for r in license_scan.scan(df).collect()}
    assert set(got) == {(3, "MIT"), (4, "MIT"), (5, "BSD-3-Clause"), (8, "MIT")} | ({(6, "BSD-3-Clause")} & set(got))
    assert got[4, "MIT"]["first_word"] == 400 and got[4, "MIT"]["containment"] == 1.0 and got[8, "MIT"]["first_word"] == 0
    assert license_scan.scan(df.filter("false")).count() == 0
    with pytest.raises(ValueError):
        license_scan.scan(df, [("X", "too short")])


def test_license_scan_keeps_repeated_rows_and_long_texts(spark):
    mit, filler = "Released under the MIT License.", "word " * 250_000
    rows = [(1, mit), (1, mit), (1, "x y z a b c"), (None, mit), (None, mit), (2, f"{filler}{mit} {filler}"), (3, f"{mit} " * 400), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["first_word"]) for r in license_scan.scan(df).collect()), key=str)
    assert got == sorted([(1, 0), (1, 0), (None, 0), (None, 0), (2, 250_000), (3, 0)], key=str)


def test_license_scan_finds_whole_texts(spark):
    """Each licence's own text, alone, inside others and with a few words changed."""
    from arcspan.llm.license_texts import LICENSES

    rng, rows = random.Random(3), []
    for k, (_, text) in enumerate(LICENSES):
        words = text.split()
        rows.append((k, text))
        rows.append((1000 + k, f"a b c d {text.upper()} e f g h"))
        if len(words) > 60:
            for _ in range(len(words) // 60):
                words[rng.randrange(len(words))] = "changed"
            rows.append((2000 + k, " ".join(words)))
    got = {(r["doc_id"], r["license"]) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all((k, LICENSES[k % 1000][0]) in got for k, _ in rows)


def _sql(oracle, **tables):
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    for name, rows in tables.items():
        con.register(name, pd.DataFrame(rows, columns=["doc_id", "text"]))
    return con.execute(oracle).fetchall()


def test_license_scan_against_sql(spark):
    from arcspan.llm.license_texts import LICENSES

    rng = random.Random(8)
    filler = lambda n: [rng.choice(["the", "this", "software", "license", "free", "under", "of", "any", "use"]) for _ in range(n)]
    rows = [(k, " ".join([*filler(rng.randrange(30)), *rng.choice(LICENSES)[1].split()[rng.randrange(2) :], *filler(rng.randrange(30))])) for k in range(120)]
    got = {(r["doc_id"], r["license"], round(r["containment"], 9), r["first_word"]) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(a, b, round(c, 9), d) for a, b, c, d in _sql(license_scan.oracle_sql(), documents=rows)} and len(got) > 100


@pytest.mark.parametrize("most", [64, 8192])
def test_many_equal_vectors(spark, monkeypatch, most):
    """A large group of equal vectors: all links counted, all candidates alike, ties by id."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 64)
    monkeypatch.setattr(hilbert_search, "MOST_BLOCK", most)
    monkeypatch.setattr(hilbert_search, "LEAST_BLOCK", 32)
    rng = np.random.default_rng(6)
    x = rng.standard_normal((400, 8)).astype(np.float32)
    x[100:] = x[100]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df).collect()}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = (unit @ unit.T >= 0.9).sum(1) - 1
    assert all(got[k]["n_links"] == near[k] for k in range(100, 400)) and len({got[k]["component_id"] for k in range(100, 400)}) == 1
    from pyspark.sql import functions as F

    found = {}
    for r in hilbert_search.search(df, F.col("vec_id") % 20 == 0, 20).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    s = x.astype(float) @ x[100].astype(float)
    above = [int(v) for v in np.argsort(-s, kind="stable") if s[v] > s[100] + 1e-9]
    for q in range(100, 400, 20):
        ids = [v for _, v in sorted(found[q])]
        tied = [v for v in range(100, 400) if v != q]
        assert len(ids) == 20 and [v for v in ids if v >= 100] == tied[: 20 - len([v for v in ids if v < 100])] and set(v for v in ids if v < 100) <= set(above)


def test_long_and_repeated_texts_join(spark):
    rng = random.Random(2)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(200_000))
    rows = [(1, long), (2, long + " and more"), (3, long.upper()), (4, "other words " * 3), (4, "other words " * 3), (4, long), (None, long)]
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in ngram_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    # One id under two texts: each row is in the component of its own text.
    assert got == [(-1, -1), (1, 1), (2, 1), (3, 1), (4, 1), (4, 4), (4, 4)]


def test_signatures_lose_no_links():
    """Codes of pairs at the least cosine lie within the radius, those of other pairs mostly outside."""
    rng = np.random.default_rng(3)
    a, other = (embedding_dedup.unit(rng.standard_normal((20_000, 64))) for _ in "ab")
    side = embedding_dedup.unit(other - (other * a).sum(1)[:, None] * a)
    b = 0.9 * a + np.sqrt(1 - 0.81) * side
    projection = embedding_dedup.fit(a[:4000], rounds=5, rotations=1)[0]
    apart = lambda x, y: ((x @ projection >= 0) != (y @ projection >= 0)).sum(1)
    assert (apart(a, b) > embedding_dedup.radius(0.9)).mean() < 5e-4 and (apart(a, a[::-1]) > embedding_dedup.radius(0.9)).mean() > 0.95
