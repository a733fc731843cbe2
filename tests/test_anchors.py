"""Anchored windows, first copies and rate limits of busy keys against plain folds."""

import random
from collections import deque

import numpy as np
import pytest

from arcspan.operators import anchors, endpoint, evidence, limits, series


@pytest.fixture
def many_parts(spark, monkeypatch):
    """Series cut into many segments, composed over several levels."""
    keys = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    old = [spark.conf.get(k) for k in keys]
    spark.conf.set(keys[0], "30")
    spark.conf.set(keys[1], "false")
    monkeypatch.setattr(series, "SMALL", 0)
    monkeypatch.setattr(anchors, "FAN", 3)
    yield
    for k, v in zip(keys, old):
        spark.conf.set(k, v)


def events(seed):
    """A busy key, dense and with pauses; some small ones, a null one, rows without a time, repeated times."""
    rng = random.Random(seed)
    t, rows = 0, []
    for _ in range(1500):
        t += rng.choice([0, 1, 1, 2, 3, 7, 20 if seed % 2 else 4, 200 if rng.random() < 0.02 else 1])
        rows.append(("busy", t))
    rows += [(k, rng.randrange(500)) for k in "abcdefgh" for _ in range(rng.randrange(1, 20))]
    return rows + [(None, 5), (None, 40), (None, 400), ("busy", None)]


def plain_windows(rows, width):
    out = {}
    for key in {k for k, _ in rows}:
        start, index = None, -1
        for t in sorted(t for k, t in rows if k == key and t is not None):
            if start is None or t > start + width:
                start, index = t, index + 1
            out.setdefault((key, t), (index, start))
    return out


@pytest.mark.parametrize("seed, width", [(0, 13), (1, 13), (2, 60), (3, 500), (4, 0)])
def test_windows(spark, many_parts, seed, width):
    rows = events(seed)
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "k string, us long, n int").repartition(6)
    got = endpoint.anchored_windows(df, ["k"], "us", width)
    assert got.columns == ["k", "us", "n", "window_index", "window_start"]
    found = got.collect()
    want = plain_windows(rows, width)
    assert len(found) == len(rows) - 1 and all((r.window_index, r.window_start) == want[r.k, r.us] for r in found)


def test_a_busy_key_is_spread(spark, many_parts):
    df = spark.createDataFrame([("busy", t) for t in range(6000)], "k string, us long").repartition(6)
    parts = series.cut(df, ["k"], ["us"])
    sizes = [r["count"] for r in parts.groupBy(series.PART).count().collect()]
    assert len(sizes) > 20 and max(sizes) < 1000
    times = parts.select(series.KEY, series.PART, "us").distinct()
    found = anchors.starts(times, 99).collect()
    assert sorted(r.window_start for r in found if r.at != anchors.NEVER) == list(range(0, 6000, 100))
    # Every segment but the first learns where it stands without seeing the others' rows.
    assert {r._part for r in found if r.at == anchors.NEVER} == {r._part for r in times.select(series.PART).distinct().collect()} - {0}


def test_steps_compose():
    rng = np.random.default_rng(0)
    for width in (1, 7, 30, 400):
        t = np.unique(rng.integers(0, 600, 200))
        cuts = np.sort(rng.choice(np.arange(1, len(t)), 6, replace=False))
        pieces = [anchors.Steps.of(p, width) for p in np.split(t, cuts)]
        whole = pieces[0]
        for p in pieces[1:]:
            whole = whole.then(p, width)
        for open_end in [anchors.NEVER, *range(int(t[0]) - 1, int(t[0]) + width)]:
            end, n = open_end, 0
            for x in t:
                if x > end:
                    end, n = x + width, n + 1
            assert [int(v[0]) for v in whole.apply(np.array([open_end]))] == [end, n]


def test_first_copies(spark, many_parts):
    rows = [(k, t * 1_000_000) for k, t in events(5) if t is not None and k is not None]
    df = spark.createDataFrame([(*r, "x") for r in rows], "k string, us long, x string")
    found = evidence.ttl_dedup(df, "k", "us", 60_000_000).filter("not is_duplicate").collect()
    want = {(k, s) for (k, _), (_, s) in plain_windows(rows, 60_000_000).items()}
    assert sorted((r.k, r.us) for r in found) == sorted(want)


@pytest.mark.parametrize("seed", [0, 1, 3])
def test_limits(spark, many_parts, seed):
    rows = [(k, t, f"{i:05d}") for i, (k, t) in enumerate(events(seed))]
    df = spark.createDataFrame([(k, None if t is None else t * 1_000_000, i) for k, t, i in rows], "k string, us long, id string")
    got = {r.id: r.accepted for r in limits.admitted(df, "k", "us", "id", 4, 30).collect()}
    want = {}
    for key in {k for k, _, _ in rows if k}:
        passed = deque()
        for t, i in sorted((t, i) for k, t, i in rows if k == key and t is not None):
            while passed and t - passed[0] >= 30:
                passed.popleft()
            want[i] = len(passed) < 4
            if want[i]:
                passed.append(t)
    assert got == want
    bursts = limits._bursts(df.selectExpr("id", "k as key", "us").filter("key = 'busy' and us is not null"), 30_000_000)
    busy = sorted(t for k, t, _ in rows if k == "busy" and t is not None)
    assert bursts.select("key").distinct().count() == 1 + sum(b - a >= 30 for a, b in zip(busy, busy[1:])) > 1
