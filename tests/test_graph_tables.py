"""Centrality, communities and ranks on tables against plain searches."""

import os
import random
from collections import deque

import pytest

from arcspan import sinks
from arcspan.operators import graph


def frames(spark, n, links):
    nodes = spark.createDataFrame([(f"n{i:03d}",) for i in range(n)], "node_id string")
    edges = spark.createDataFrame([(f"n{a:03d}", f"n{b:03d}", "t") for a, b in links] or [], "src string, dst string, type string")
    return nodes, edges


def brandes(n, links):
    """Betweenness and closeness by one search a node."""
    out = {a: sorted({y for x, y in links if x == a and y != a}) for a in range(n)}
    between, reach, far = [0.0] * n, [0] * n, [0] * n
    for s in range(n):
        depth, paths, order, queue = {s: 0}, {s: 1}, [], deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in out[v]:
                if w not in depth:
                    depth[w] = depth[v] + 1
                    queue.append(w)
                if depth[w] == depth[v] + 1:
                    paths[w] = paths.get(w, 0) + paths[v]
        share = dict.fromkeys(order, 0.0)
        for v in reversed(order):
            share[v] = sum(paths[v] / paths[w] * (1 + share[w]) for w in out[v] if depth[w] == depth[v] + 1)
            if v != s:
                between[v] += share[v]
                reach[v] += 1
                far[v] += depth[v]
    scale = (n - 1) * (n - 2)
    return {f"n{v:03d}": (between[v] / scale, reach[v] / far[v] * reach[v] / (n - 1) if far[v] else 0.0) for v in range(n)}


def random_links(seed, n, m):
    rng = random.Random(seed)
    return [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]


GRAPHS = {"sparse": (40, random_links(0, 40, 55)), "dense": (25, random_links(1, 25, 200)), "star": (30, [(0, i) for i in range(1, 30)] + [(i, 0) for i in range(1, 30, 2)]), "grid": (16, [(4 * y + x, 4 * y + x + 1) for y in range(4) for x in range(3)] + [(4 * y + x, 4 * y + x + 4) for y in range(3) for x in range(4)])}


@pytest.mark.parametrize("name, pairs", [("sparse", 10**9), ("dense", 400), ("grid", 10**9)])
def test_centrality(spark, name, pairs):
    n, links = GRAPHS[name]
    got = {r.node_id: (r.betweenness, r.closeness) for r in graph.centrality(*frames(spark, n, links), pairs=pairs).collect()}
    want = brandes(n, links)
    assert got.keys() == want.keys() and all(abs(a - b) < 1e-9 for k in want for a, b in zip(got[k], want[k]))


def test_sampled_centrality(spark):
    n, links = 300, random_links(2, 300, 1500)
    assert graph.sources_for(300, 0.0) == 300 and graph.sources_for(300, 0.15) == 245 and graph.sources_for(10**9, 0.01) < 150_000
    got = {r.node_id: r.betweenness for r in graph.centrality(*frames(spark, n, links), error=0.15).collect()}
    want = brandes(n, links)
    assert max(abs(got[k] - want[k][0]) for k in want) < 0.15 and any(got[k] != want[k][0] for k in want)


def modularity(n, links, of):
    pairs = {(min(a, b), max(a, b)) for a, b in links if a != b}
    m, degree = len(pairs), [0] * n
    for a, b in pairs:
        degree[a] += 1
        degree[b] += 1
    inside = sum(of[a] == of[b] for a, b in pairs) / m
    return inside - sum((sum(degree[v] for v in range(n) if of[v] == c) / (2 * m)) ** 2 for c in set(of.values()))


def greedy(n, links):
    """Communities by joining, again and again, the two whose union gains most."""
    of = {v: v for v in range(n)}
    best = modularity(n, links, of)
    while True:
        found = max(((modularity(n, links, {v: a if c == b else c for v, c in of.items()}), a, b) for a in set(of.values()) for b in set(of.values()) if a < b and any({of[x], of[y]} == {a, b} for x, y in links)), default=(best, 0, 0))
        if found[0] <= best + 1e-12:
            return best
        best, a, b = found
        of = {v: a if c == b else c for v, c in of.items()}


def planted(seed):
    rng = random.Random(seed)
    return 40, [(a, b) for a in range(40) for b in range(a) if rng.random() < (0.5 if a // 10 == b // 10 else 0.04)]


@pytest.mark.parametrize("name", ["planted0", "star", "grid"])
def test_communities(spark, name):
    n, links = planted(int(name[-1])) if name.startswith("planted") else GRAPHS[name]
    rows = graph.communities(*frames(spark, n, links)).collect()
    of = {int(r.node_id[1:]): r.community for r in rows}
    assert len(rows) == n and all(min(f"n{v:03d}" for v in of if of[v] == c) == c for c in set(of.values()))
    assert modularity(n, links, of) >= 0.95 * greedy(n, links)


def test_graphs_without_links(spark):
    nodes, edges = frames(spark, 3, [(0, 0)])
    assert {r.community for r in graph.communities(nodes, edges).collect()} == {"n000", "n001", "n002"}
    assert {(r.betweenness, r.closeness) for r in graph.centrality(nodes, edges).collect()} == {(0.0, 0.0)}
    assert graph.centrality(nodes.limit(0), edges).count() == 0 and graph.communities(nodes.limit(0), edges).count() == 0


def test_ranks_converge_or_raise_and_free_their_tables(spark):
    nodes, edges = frames(spark, *GRAPHS["sparse"])
    folder = sinks.shared_dir(nodes).removeprefix("file://")
    spools = lambda: {f for f in os.listdir(folder) if f.startswith("spool-")}
    before = spools()
    ranks = graph.pagerank(nodes, edges, tolerance=1e-12)
    assert abs(ranks.agg({"rank": "sum"}).first()[0] - 1) < 1e-9 and len(spools() - before) == 1
    with pytest.raises(ValueError, match="after 3 rounds"):
        graph.pagerank(nodes, edges, rounds=3, tolerance=1e-12)
    before = spools()
    graph.components(nodes, edges).collect()
    graph.shortest_paths(edges, nodes.limit(1)).collect()
    assert len(spools() - before) <= 1 + 2 * graph.ROUNDS
