"""Queries on industrial time series: each event type is a tag, its values by time the readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import industrial as op
from .registry import EVENTS_SQL, events, query

_I = f"""{EVENTS_SQL}, i AS (SELECT event_type AS tag, event_id, us, value, CASE WHEN k >= 90 THEN 1 ELSE 0 END AS attack, row_number() OVER (PARTITION BY event_type ORDER BY us, event_id) - 1 AS idx, count(*) OVER (PARTITION BY event_type) AS total FROM e)"""
_W = f"""{_I}, w AS (SELECT tag, w AS window_id, idx, us, value, attack FROM i, (SELECT unnest(range(0, 100000)) AS w) x WHERE idx >= 10 * w AND idx < 10 * w + 60 AND 10 * w + 60 <= total AND 10 * w <= idx)"""


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select(F.col("event_type").alias("tag"), "event_id", "us", "value", "user_id", F.when(F.col("k") >= 90, 1).otherwise(0).alias("attack"))
    return op.index_rows(e, "tag", ["us", "event_id"])


@query(f"WITH {_W} SELECT tag, window_id, min(us) AS start_us, max(us) AS end_us, count(*) AS n_rows, max(attack) AS label, round(avg(attack), 6) AS attack_ratio FROM w GROUP BY tag, window_id")
def ot_sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 60 rows, one every 10."""
    w = op.sliding_windows(_series(spark, sf_dir).select("tag", "idx", "us", "attack"), "tag")
    return w.groupBy("tag", "window_id").agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count("*").alias("n_rows"), F.max("attack").alias("label"), F.round(F.avg("attack"), 6).alias("attack_ratio"))


_STATS = "count(value) AS n, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, min(value) AS low, max(value) AS high, round(quantile_cont(value, 0.5), 4) AS median, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 4) AS iqr, round(sum(value * value), 2) AS energy"


@query(f"WITH {_W} SELECT tag, window_id, {_STATS} FROM w GROUP BY tag, window_id")
def ot_sensor_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of each window."""
    w = op.sliding_windows(_series(spark, sf_dir).select("tag", "idx", "value"), "tag")
    d = op.describe(w, ["tag", "window_id"], "value")
    r = lambda c, k=4: F.round(c, k).alias(c)
    return d.select("tag", "window_id", "n", r("mean"), r("std"), "low", "high", r("median"), r("iqr"), r("energy", 2))


@query(f"""WITH {_I}, b AS (SELECT tag, least(floor((value - min(value) OVER (PARTITION BY tag)) / ((max(value) OVER (PARTITION BY tag) - min(value) OVER (PARTITION BY tag)) / 10)), 9) AS bin FROM i),
c AS (SELECT tag, bin, count(*) AS n FROM b GROUP BY 1, 2) SELECT tag, round(-sum(p * log2(p)), 6) AS entropy FROM (SELECT tag, n / sum(n) OVER (PARTITION BY tag) AS p FROM c) GROUP BY tag""")
def ot_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram entropy of each tag."""
    return op.histogram_entropy(_series(spark, sf_dir), ["tag"], "value").select("tag", F.round("entropy", 6).alias("entropy"))


@query(f"""WITH {_I}, v AS (SELECT tag, idx, floor(value / 50) AS x FROM i), d AS (SELECT *, x - lag(x) OVER (PARTITION BY tag ORDER BY idx) AS d, sign(x - avg(x) OVER (PARTITION BY tag)) AS s FROM v),
f AS (SELECT *, CASE WHEN s != lag(s) OVER (PARTITION BY tag ORDER BY idx) THEN 1 ELSE 0 END AS c, CASE WHEN sign(d) != sign(lag(d) OVER (PARTITION BY tag ORDER BY idx)) THEN 1 ELSE 0 END AS t,
 sum(CASE WHEN d = 0 THEN 0 ELSE 1 END) OVER (PARTITION BY tag ORDER BY idx) AS run FROM d),
r AS (SELECT tag, run, count(*) FILTER (WHERE d = 0) AS flat FROM f GROUP BY 1, 2)
SELECT f.tag, CAST(sum(c) AS BIGINT) AS zero_crossings, CAST(sum(t) AS BIGINT) AS oscillations, (SELECT max(flat) FROM r WHERE r.tag = f.tag) AS flatline, count(*) FILTER (WHERE d != 0) AS state_changes,
 round((arg_max(x, idx) - arg_min(x, idx)) / count(*), 6) AS rate_of_change, round(avg(abs(d)), 6) AS diff_abs_mean FROM f GROUP BY f.tag""")
def ot_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crossings, runs and oscillations of each tag's coarse readings."""
    s = _series(spark, sf_dir).withColumn("x", F.floor(F.col("value") / 50).cast("double"))
    d = op.dynamics(s, ["tag"], "idx", "x")
    return d.select("tag", "zero_crossings", "oscillations", "flatline", "state_changes", F.round("rate_of_change", 6).alias("rate_of_change"), F.round("diff_abs_mean", 6).alias("diff_abs_mean"))


_PIVOT = f"{_I}, p AS (SELECT idx, max(CASE WHEN tag = 'click' THEN value END) AS a, max(CASE WHEN tag = 'error' THEN value END) AS b, max(CASE WHEN tag = 'view' THEN value END) AS c FROM i GROUP BY idx)"


@query(f"WITH {_PIVOT} SELECT round(corr(a, b), 6) AS corr_a_b, round(covar_samp(a, b), 4) AS cov_a_b, round(corr(a, c), 6) AS corr_a_c, round(corr(b, c), 6) AS corr_b_c FROM p WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL")
def ot_pairwise_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlations of tags at the same place, in one aggregation."""
    s = _series(spark, sf_dir)
    pick = lambda t: F.max(F.when(F.col("tag") == t, F.col("value")))
    wide = s.groupBy("idx").agg(pick("click").alias("a"), pick("error").alias("b"), pick("view").alias("c")).dropna()
    p = op.pairwise(wide.withColumn("g", F.lit(1)), ["g"], ["a", "b", "c"])
    return p.select(F.round("corr_a_b", 6).alias("corr_a_b"), F.round("cov_a_b", 4).alias("cov_a_b"), F.round("corr_a_c", 6).alias("corr_a_c"), F.round("corr_b_c", 6).alias("corr_b_c"))


@query(f"""WITH {_I}, s AS (SELECT tag, us // 60000000 AS m, us // 60000000 - lag(us // 60000000) OVER (PARTITION BY tag ORDER BY us) AS gap FROM i),
t AS (SELECT tag, quantile_cont(CASE WHEN gap > 0 THEN gap END, 0.5) AS interval_m, count(*) AS n, count(DISTINCT m) AS d, max(m) - min(m) AS span FROM s GROUP BY tag)
SELECT t.tag, n, n - d AS duplicates, interval_m AS "interval", (SELECT count(*) FROM s WHERE s.tag = t.tag AND gap > 1.5 * interval_m) AS gaps, CAST(greatest(floor(span / interval_m) + 1 - d, 0) AS BIGINT) AS missing FROM t""")
def ot_temporal_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicates, gaps and missing minutes of each tag."""
    s = _series(spark, sf_dir).withColumn("m", F.floor(F.col("us") / 60_000_000))
    return op.integrity(s, "tag", "m")


@query(f"""WITH {_I}, v AS (SELECT tag, idx, CASE WHEN value >= 60 THEN value END AS x FROM i), r AS (SELECT tag, x, sum(CASE WHEN x IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY tag ORDER BY idx) AS run FROM v),
l AS (SELECT tag, max(n) AS longest_missing FROM (SELECT tag, run, count(*) FILTER (WHERE x IS NULL) AS n FROM r GROUP BY 1, 2) GROUP BY tag)
SELECT tag, round(avg(CASE WHEN x IS NULL THEN 1.0 ELSE 0 END), 6) AS missing_share, longest_missing, count(DISTINCT x) AS "distinct", count(DISTINCT x) <= 5 AS near_constant FROM v JOIN l USING (tag) GROUP BY tag, longest_missing""")
def ot_missing_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls of each tag, and their longest run."""
    s = _series(spark, sf_dir).withColumn("x", F.when(F.col("value") >= 60, F.col("value")))
    return op.missing_profile(s, "tag", "idx", "x").select("tag", F.round("missing_share", 6).alias("missing_share"), "longest_missing", "distinct", "near_constant")


@query(f"WITH {_I} SELECT tag, round(quantile_cont(value, 0.01), 4) AS p01, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.99), 4) AS p99 FROM i GROUP BY tag")
def ot_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of each tag."""
    p = op.percentiles(_series(spark, sf_dir), "tag", "value")
    return p.select("tag", F.round(F.col("p")[0], 4).alias("p01"), F.round(F.col("p")[3], 4).alias("p50"), F.round(F.col("p")[6], 4).alias("p99"))


@query(f"WITH {_I} SELECT tag, round(abs(avg(value) FILTER (WHERE attack = 1) - avg(value) FILTER (WHERE attack = 0)), 4) AS mean_shift, round(stddev_samp(value) FILTER (WHERE attack = 1) / (stddev_samp(value) FILTER (WHERE attack = 0) + 1e-6), 4) AS std_ratio FROM i GROUP BY tag")
def ot_distribution_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attack rows against normal ones."""
    s = op.shift(_series(spark, sf_dir), "tag", "value", "attack")
    return s.select("tag", F.round("mean_shift", 4).alias("mean_shift"), F.round("std_ratio", 4).alias("std_ratio"))


_CAL = f"{_I}, m AS (SELECT avg(-value) AS mu, stddev_pop(-value) AS sd FROM i), c AS (SELECT event_id, 1 / (1 + exp(-((-value - mu) / sd))) AS s, attack * 0.9::DOUBLE AS p FROM i, m), r AS (SELECT *, CASE WHEN s >= 0.85 THEN 'CRITICAL' WHEN s >= 0.70 THEN 'HIGH' WHEN s >= 0.45 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM c)"


@query(f"WITH {_CAL} SELECT event_id, round(s, 6) AS score, severity, round(CASE WHEN p > 0 THEN 0.6 * s + 0.4 * p ELSE s END, 6) AS risk, CASE WHEN severity IN ('HIGH', 'CRITICAL') THEN 0.85 ELSE 0.65 END::DOUBLE AS confidence FROM r")
def ot_calibrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated scores, bands, risk and confidence."""
    s = _series(spark, sf_dir)
    m = s.agg(F.avg(-F.col("value")).alias("mu"), F.stddev_pop(-F.col("value")).alias("sd"))
    c = s.join(F.broadcast(m)).withColumn("s", op.calibrate(F.col("value"), F.col("mu"), F.col("sd"))).withColumn("severity", op.band(F.col("s")))
    return c.select("event_id", F.round("s", 6).alias("score"), "severity", F.round(op.risk(F.col("s"), F.col("attack") * 0.9), 6).alias("risk"), op.confidence(F.col("severity")).alias("confidence"))


@query(f"""WITH {_I}, b AS (SELECT tag, avg(value) AS bm, stddev_samp(value) AS bs FROM i GROUP BY tag), f AS (SELECT idx // 60 AS block, tag, avg(value) AS m FROM i GROUP BY 1, 2)
SELECT block, list(tag ORDER BY round(-abs(m - bm) / bs, 9), tag)[1:3] AS shifted FROM f JOIN b USING (tag) GROUP BY block""")
def ot_shifted_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tags farthest from their baseline in each block."""
    s = _series(spark, sf_dir)
    base = s.groupBy("tag").agg(F.avg("value").alias("base_mean"), F.stddev_samp("value").alias("base_std"))
    f = s.groupBy(F.floor(F.col("idx") / 60).alias("block"), "tag").agg(F.avg("value").alias("mean"), (F.max("value") - F.min("value")).alias("range"))
    return op.shifted_variables(f, ["block"], base, 3)


@query(f"""WITH {_I}, f AS (SELECT idx // 60 AS block, tag, count(*) AS n, max(value) - min(value) AS r FROM i GROUP BY 1, 2)
SELECT block, list_sort(list_distinct(list_filter(list(CASE WHEN n > 45 THEN 'Sensor flatline detected: ' || tag || ' remained constant for ' || n || 's' END), lambda x: x IS NOT NULL))) || ['Window deviates strongly from historical normal industrial baseline'] AS reasons FROM f GROUP BY block""")
def ot_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons from long features."""
    s = _series(spark, sf_dir)
    f = s.groupBy(F.floor(F.col("idx") / 60).alias("block"), "tag").agg(F.count("*").alias("value"))
    long = f.select("block", F.concat(F.lit("sensor_"), "tag", F.lit("_flatline_duration")).alias("name"), "value", F.lit(0.8).alias("risk"))
    return op.reasons(long, ["block"], "risk")


@query("SELECT 'sensor_value' AS tag, count(*) AS n, round(avg(value), 6) AS mean FROM events UNION ALL SELECT 'sensor_user_id', count(*), round(avg(user_id), 6) FROM events")
def ot_roles_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns classified by role and turned to long form."""
    e = events(spark, sf_dir).select("us", "value", F.col("user_id"), F.when(F.col("k") >= 90, 1).otherwise(0).alias("attack"), F.lit(None).cast("double").alias("empty"))
    long = op.to_long(e, "us", "attack", op.limit_tags(op.classify_columns(e, "us", "attack")))
    return long.groupBy("tag").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
