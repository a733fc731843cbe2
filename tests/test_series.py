"""Scans over segments against the window form, with a busy key spread over tasks."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from arcspan.operators import industrial, series


@pytest.fixture(scope="module")
def readings(spark):
    """A tag with nearly all rows, small ones, one without values, one of one row and a null tag."""
    rng = np.random.default_rng(0)
    rows = [("busy", i, float(v)) for i, v in enumerate(np.repeat(rng.integers(-2, 3, 700), rng.integers(1, 9, 700)))]
    rows += [("flat", i, 5.0) for i in range(900)] + [("void", i, None) for i in range(30)] + [("one", 3, 2.0)] + [(None, i, float(i % 3)) for i in range(40)]
    rows += [("holes", i, None if 40 < i % 300 < 280 else float(i % 7)) for i in range(1500)]
    return spark.createDataFrame(rows, "tag string, i long, x double").repartition(7)


@pytest.fixture(params=[True, False])
def many_parts(spark, monkeypatch, request):
    """Enough partitions that runs and halos cross several segments; or one segment a series."""
    if not request.param:
        yield False
        return
    monkeypatch.setattr(series, "SMALL", 0)
    keys = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    old = [spark.conf.get(k) for k in keys]
    spark.conf.set(keys[0], "40")
    spark.conf.set(keys[1], "false")
    yield True
    for k, v in zip(keys, old):
        spark.conf.set(k, v)


def by_windows(df):
    """The plain form of `dynamics`: one task a tag."""
    own = Window.partitionBy("tag")
    by, x = own.orderBy("i"), F.col("x")
    rows = df.withColumns({"_d": x - F.lag(x).over(by), "_s": F.signum(x - F.avg(x).over(own))})
    rows = rows.withColumns({"_c": (F.col("_s") != F.lag("_s").over(by)).cast("int"), "_t": F.when(F.lag("_d").over(by).isNotNull(), (F.signum("_d") != F.signum(F.lag("_d").over(by))).cast("int")), "_run": F.sum(F.when(F.col("_d") == 0, 0).otherwise(1)).over(by)})
    rows = rows.withColumn("_flat", F.count(F.when(F.col("_d") == 0, 1)).over(Window.partitionBy("tag", "_run")))
    return rows.groupBy("tag").agg(F.coalesce(F.sum("_c"), F.lit(0)), F.max("_flat"), F.coalesce(F.sum("_t"), F.lit(0)), F.count_if(F.col("_d") != 0), F.round(F.coalesce(F.avg(F.abs("_d")), F.lit(0.0)), 9), F.round((F.max_by("x", "i") - F.min_by("x", "i")) / F.count("*"), 9))


def test_dynamics(spark, readings, many_parts):
    d = industrial.dynamics(readings, ["tag"], "i", "x")
    got = d.select("tag", "zero_crossings", "flatline", "oscillations", "state_changes", F.round("diff_abs_mean", 9), F.round("rate_of_change", 9)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, map(tuple, by_windows(readings).collect())))
    assert {r.tag: r.flatline for r in d.collect()}["flat"] == 899


def test_halo_over_short_segments(spark, many_parts):
    """Segments of one row: what is three rows back is three segments away."""
    if not many_parts:
        return
    df = spark.createDataFrame([("a", i, i) for i in range(35)], "tag string, i long, v long")
    parts = series.cut(df, ["tag"], ["i"])
    assert parts.select(series.PART).distinct().count() > 15
    at = series.along(["i"])
    got = series.with_halo(parts, ["i"], 3).withColumn("b", F.lag("v", 3).over(at)).filter("_halo = 0").select("v", "b").collect()
    assert {r.v: r.b for r in got} == {i: i - 3 if i >= 3 else None for i in range(35)}


def test_numbers_and_spread(spark, readings, many_parts):
    got = {(r.tag, r.i): r.idx for r in industrial.index_rows(readings, "tag", ["i"]).collect()}
    assert got == {(r.tag, r.i): r.n for r in readings.withColumn("n", F.row_number().over(Window.partitionBy("tag").orderBy("i")) - 1).collect()}
    if not many_parts:
        return
    busy = series.cut(readings, ["tag"], ["i"]).filter("tag = 'busy'").groupBy(series.PART).count().collect()
    assert len(busy) > 10 and max(r["count"] for r in busy) < 0.2 * sum(r["count"] for r in busy)


def test_missing_and_percentiles(spark, readings, many_parts):
    got = {r.tag: (round(r.missing_share, 9), r.longest_missing, r.distinct, r.constant, r.near_constant) for r in industrial.missing_profile(readings, "tag", "i", "x").collect()}
    assert got["holes"] == (round(1195 / 1500, 9), 239, 7, False, False) and got["void"] == (1.0, 30, 0, True, True) and got["one"] == (0.0, 0, 1, True, True) and len(got) == 6
    at = (0.0, 0.013, 0.25, 0.5, 0.777, 1.0)
    plain = {r.tag: r.p for r in readings.groupBy("tag").agg(F.percentile("x", F.array(*map(F.lit, at))).alias("p")).collect()}
    assert {r.tag: r.p for r in industrial.percentiles(readings, "tag", "x", at).collect()} == plain
    whole = readings.groupBy("tag", "x").agg(F.count("*").alias("c"))
    assert {r.tag: r.p for r in series.percentiles(whole, ["tag"], "x", list(at), "c").collect()} == plain


def test_integrity(spark, many_parts):
    rng = np.random.default_rng(1)
    times = {t: np.sort(rng.integers(0, 3000, n)) for t, n in (("a", 900), ("b", 50), ("c", 1), (None, 30))}
    df = spark.createDataFrame([(t, int(v)) for t, all_ in times.items() for v in all_], "tag string, us long").repartition(5)
    got = {r.tag: (r.n, r.duplicates, r.interval, r.gaps, r.missing) for r in industrial.integrity(df, "tag", "us").collect()}
    for t, v in times.items():
        gap = np.diff(v)
        step = float(np.median(gap[gap > 0])) if (gap > 0).any() else None
        some = len(np.unique(v))
        assert got[t][:4] == (len(v), len(v) - some, step, int((gap > 1.5 * step).sum()) if step else 0)
        assert got[t][4] == (max(int((v[-1] - v[0]) // step) + 1 - some, 0) if step else 0)
