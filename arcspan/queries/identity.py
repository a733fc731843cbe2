"""Queries on authentication behaviour."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import identity as op
from .registry import EVENTS_SQL, events, query

_HOURS = f"""{EVENTS_SQL},
f AS (SELECT user_id, us, k, us // 3600000000 AS w, min(us // 3600000000) OVER (PARTITION BY user_id, k) AS fw,
  us - lag(us) OVER (PARTITION BY user_id, us // 3600000000 ORDER BY us) AS gap FROM e),
h AS (SELECT user_id AS "user", w AS window_id, count(*) AS auth_count, count(DISTINCT k) AS unique_computers,
  count(DISTINCT CASE WHEN fw = w THEN k END) AS new_computers, (max(us) - min(us)) / 3600000000 AS active_hours,
  CASE WHEN count(*) > 1 THEN (max(us) - min(us)) / (count(*) - 1) / 1000000 ELSE 0 END AS mean_gap,
  coalesce(min(gap) / 1000000, 0) AS min_gap, coalesce(max(gap) / 1000000, 0) AS max_gap FROM f GROUP BY user_id, w),
g AS (SELECT *, unique_computers / greatest(active_hours, 0.001::DOUBLE) AS fanout_rate,
  CASE WHEN unique_computers > 0 THEN new_computers / unique_computers ELSE 0 END AS new_computer_ratio,
  CAST(window_id % 24 AS INT) AS "hour", CASE WHEN window_id % 24 < 8 OR window_id % 24 > 20 THEN 1 ELSE 0 END AS off_hours FROM h)"""


def _z(value: str) -> str:
    over = "OVER (PARTITION BY \"user\" ORDER BY window_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"coalesce(CASE WHEN count({value}) {over} < 3 OR stddev_pop({value}) {over} < 1e-4 OR stddev_pop({value}) {over} IS NULL THEN 0 ELSE ({value} - avg({value}) {over}) / stddev_pop({value}) {over} END, 0)"


_GAP = "CASE WHEN auth_count >= 2 THEN mean_gap END"
_Z = f"""{_HOURS},
z AS (SELECT *, {_z("auth_count::DOUBLE")} AS za, {_z("unique_computers::DOUBLE")} AS zu, {_z("fanout_rate")} AS zf, {_z("(" + _GAP + ")")} AS zg FROM g)"""


@query(f"""WITH {_Z} SELECT "user", window_id, auth_count, unique_computers, new_computer_ratio, fanout_rate, mean_gap, min_gap, max_gap, "hour", off_hours,
round(greatest(-10, least(10, za)), 4) AS auth_count_zscore, round(greatest(-10, least(10, zu)), 4) AS unique_computers_zscore,
round(greatest(-10, least(10, zf)), 4) AS fanout_rate_zscore, round(greatest(-10, least(10, zg)), 4) AS mean_auth_gap_zscore FROM z""")
def identity_user_hour_zscores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User-hours with z-scores against each user's own earlier hours."""
    z = op.zscores(op.user_hours(events(spark, sf_dir)))
    r = lambda name: F.round(name, 4).alias(name)
    return z.select("user", "window_id", "auth_count", "unique_computers", "new_computer_ratio", "fanout_rate", "mean_gap", "min_gap", "max_gap", "hour", "off_hours", r("auth_count_zscore"), r("unique_computers_zscore"), r("fanout_rate_zscore"), r("mean_auth_gap_zscore"))


@query(f"""WITH {_HOURS}, d AS (SELECT window_id, row_number() OVER (ORDER BY window_id) AS p, count(*) OVER () AS n FROM (SELECT DISTINCT window_id FROM g)),
c AS (SELECT window_id AS cut FROM d WHERE p = greatest(floor(n * 0.8::DOUBLE), 1))
SELECT CASE WHEN window_id <= cut THEN 'train' ELSE 'test' END AS split, count(*) AS n_rows, min(window_id) AS first_window, max(window_id) AS last_window FROM g, c GROUP BY 1""")
def identity_temporal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train and test hours, split at a window boundary."""
    out = op.temporal_split(op.user_hours(events(spark, sf_dir)))
    return out.groupBy("split").agg(F.count("*").alias("n_rows"), F.min("window_id").alias("first_window"), F.max("window_id").alias("last_window"))


@query(f"""WITH {_Z} SELECT "user", window_id, list_filter([
CASE WHEN new_computer_ratio > 0.5 THEN '# of accessed computers are new for this user' END,
CASE WHEN za > 3 THEN 'authentication volume is # standard deviations above user baseline' END,
CASE WHEN zu > 3 THEN 'computer traversal is # standard deviations above user baseline' END,
CASE WHEN off_hours = 1 THEN 'activity occurred outside configured normal hours' END,
CASE WHEN fanout_rate > 10 THEN 'high host traversal velocity: # computers/hour' END,
CASE WHEN zg > 3 THEN 'authentication timing gap is # standard deviations above user baseline' WHEN zg < -3 THEN 'authentication timing gap is # standard deviations below user baseline' END,
CASE WHEN zf > 3 THEN 'host traversal velocity is # standard deviations above user baseline' END], lambda x: x IS NOT NULL) AS reasons FROM z""")
def identity_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why an hour stands out, all seven rules; figures, which engines print differently, as #."""
    z = op.reasons(op.zscores(op.user_hours(events(spark, sf_dir))))
    return z.select("user", "window_id", F.transform("reasons", lambda x: F.regexp_replace(x, r"-?[0-9]+\.[0-9]%?", "#")).alias("reasons"))


@query(f"""WITH {_Z}, p AS (SELECT quantile_cont(auth_count, 0.99) AS busy FROM z)
SELECT "user", window_id, auth_count >= busy AND abs(round(za, 9)) < 2 AND abs(round(zu, 9)) < 2 AND new_computer_ratio < 0.2 AS service_like, auth_count <= 2 AND unique_computers <= 2 AND new_computer_ratio = 0 AND off_hours = 0 AS low_activity,
 round(za, 9) >= 5 OR round(zu, 9) >= 5 OR round(zf, 9) >= 5 OR (new_computer_ratio >= 0.5 AND unique_computers >= 5) OR (off_hours = 1 AND new_computer_ratio >= 0.5) AS strong_deviation FROM z, p""")
def identity_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User-hours that look like service accounts, have little activity, or deviate strongly."""
    return op.masks(op.zscores(op.user_hours(events(spark, sf_dir)))).select("user", "window_id", "service_like", "low_activity", "strong_deviation")


_COHORT = f"""{_HOURS}, u AS (SELECT "user", sum(auth_count) AS total, count(*) AS hours, max(auth_count) AS busiest FROM g GROUP BY "user"),
p AS (SELECT quantile_cont(total, 0.99) AS p99 FROM u)"""


@query(f"""WITH {_COHORT} SELECT "user", CAST(total AS BIGINT) AS total, hours, total >= p99 AS service_like, hours < 10 AS low_activity FROM u, p""")
def identity_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by activity: the top hundredth looks like service accounts."""
    users = op.user_hours(events(spark, sf_dir)).groupBy("user").agg(F.sum("auth_count").alias("total"), F.count("*").alias("hours"))
    p99 = users.agg(F.percentile("total", F.lit(0.99)).alias("p99"))  # one row
    return users.join(F.broadcast(p99)).select("user", "total", "hours", (F.col("total") >= F.col("p99")).alias("service_like"), (F.col("hours") < 10).alias("low_activity"))


_BASE = "b AS (SELECT user_id, event_type, count(value) AS n, avg(value) AS mean, stddev_pop(value) AS std, arg_max(value, (ts, event_id)) AS last_value FROM events WHERE value IS NOT NULL GROUP BY 1, 2)"


@query(f"WITH {_BASE} SELECT user_id, event_type, n, round(mean, 6) AS mean, round(std, 6) AS std, last_value, n >= 10 AS is_established FROM b")
def baseline_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running statistics of each user's value by event type."""
    b = op.baseline(events(spark, sf_dir).withColumn("o", F.struct("us", "event_id")), "user_id", "event_type", "value", "o")
    return b.select("user_id", "event_type", F.col("count").alias("n"), F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "last_value", "is_established")


@query(f"""WITH {_BASE} SELECT event_id, round(CASE WHEN n < 3 THEN NULL WHEN std = 0 THEN CASE WHEN value = mean THEN 0 ELSE 'inf'::DOUBLE END ELSE abs(value - mean) / std END, 4) AS deviation
FROM events JOIN b USING (user_id, event_type)""")
def baseline_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's deviation from its user's baseline."""
    e = events(spark, sf_dir).withColumn("o", F.struct("us", "event_id"))
    b = op.baseline(e, "user_id", "event_type", "value", "o").select("user_id", "event_type", "count", "mean", "std")
    d = op.deviation(F.col("value"), F.col("count"), F.col("mean"), F.col("std"))
    return e.join(b, ["user_id", "event_type"]).select("event_id", F.round(d, 4).alias("deviation"))


@query("SELECT count(DISTINCT user_id) AS entities, count(DISTINCT event_type) AS metrics, count(DISTINCT (user_id, event_type)) AS baselines FROM events WHERE user_id % 10 != 0")
def baseline_counts_after_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many baselines stay when those of some entities are reset (an anti-join)."""
    e = events(spark, sf_dir)
    gone = e.filter(F.col("user_id") % 10 == 0).select("user_id").distinct()
    return op.baseline_counts(op.reset_baselines(e, gone, "user_id"), "user_id", "event_type")


@query(f"WITH {_HOURS}, r AS (SELECT min(mean_gap) AS lo, max(mean_gap) AS hi FROM g) SELECT \"user\", window_id, round(greatest(0, least(1, (hi - mean_gap) / (hi - lo))), 6) AS score FROM g, r")
def identity_anomaly_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw score turned to 0..1 by its range."""
    h = op.user_hours(events(spark, sf_dir))
    r = h.agg(F.min("mean_gap").alias("lo"), F.max("mean_gap").alias("hi"))
    return h.join(F.broadcast(r)).select("user", "window_id", F.round(op.anomaly_score("mean_gap", "lo", "hi"), 6).alias("score"))
