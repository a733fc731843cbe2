"""Queries on whole jobs, models and sources."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import models, sinks, sources
from ..plans import detection
from .evidence import _E, _evidence
from .registry import events, query, table


@query(f"WITH {_E} SELECT entity, round(max(CASE WHEN detector = 'network' THEN risk_score END), 6) AS network_score, round(max(CASE WHEN detector = 'endpoint' THEN risk_score END), 6) AS endpoint_score, count(DISTINCT CASE WHEN risk_score > 0 THEN detector END) AS diversity FROM v GROUP BY entity")
def job_detector_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of each entity by detector."""
    r = detection.detector_roll_up(_evidence(spark, sf_dir), "entity")
    return r.select("entity", F.round("network_score", 6).alias("network_score"), F.round("endpoint_score", 6).alias("endpoint_score"), "diversity")


@query("""WITH i AS (SELECT event_id, value / (SELECT max(value) FROM events) AS s, event_id % 9 = 0 AS p FROM events), g AS (SELECT event_id, CASE WHEN p THEN 'ESCALATE' WHEN s < 0.4 THEN 'ALLOW' WHEN s < 0.6 THEN 'MONITOR' WHEN s * 100 > 98 THEN 'ESCALATE' ELSE 'AUTO' END AS decision, s FROM i)
SELECT decision, CASE WHEN decision = 'AUTO' THEN CASE WHEN s * 100 > 90 THEN 'ESCALATED' ELSE 'RESOLVED' END ELSE decision END AS status, count(*) AS n FROM g GROUP BY 1, 2""")
def job_decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents decided."""
    e = events(spark, sf_dir)
    top = e.agg(F.max("value").alias("t"))
    none = F.lit(None).cast("double")
    i = e.join(F.broadcast(top)).select("event_id", (F.col("value") / F.col("t")).alias("score"), F.when(F.col("event_id") % 9 == 0, "Payment Gateway").otherwise("Laptop").alias("asset"), F.lit(True).alias("is_malicious"), none.alias("risk_score"), none.alias("confidence"))
    out = detection.decide(i, F.array(F.lit("block_ip")))
    return out.groupBy(F.col("gate.decision").alias("decision"), "status").agg(F.count("*").alias("n"))


@query("SELECT user_id, count(*) AS n_lines, round((max(epoch_us(ts)) - min(epoch_us(ts))) / 60000000, 4) AS active_minutes FROM events GROUP BY user_id")
def job_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's timeline."""
    t = detection.timeline(events(spark, sf_dir), "user_id", "us", F.format_string("%s: %.2f", F.col("event_type"), F.col("value")))
    return t.select("user_id", F.size("lines").cast("long").alias("n_lines"), F.round("active_minutes", 4).alias("active_minutes"))


@query()
def model_isolation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anomaly scores of all events (trees are drawn; tested on planted outliers)."""
    e = events(spark, sf_dir).select("event_id", "value", F.col("k").cast("double").alias("k"))
    return models.score_isolation_forest(e, models.fit_isolation_forest(e, ["value", "k"], "event_id", trees=50)).select("event_id", "raw_score")


@query()
def model_boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees on events (tested on held-out accuracy)."""
    e = events(spark, sf_dir).select("event_id", "value", F.col("k").cast("double").alias("k"), (F.col("event_type") == "purchase").cast("double").alias("label"))
    return models.fit_boosted(e, ["value", "k"], "label", rounds=5).transform(e).select("event_id", "prediction")


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE user_id IS NOT NULL GROUP BY event_type")
def source_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written with `;` and read back with the delimiter found."""
    path = f"{sinks.shared_dir(events(spark, sf_dir))}/csv-{uuid.uuid4().hex}"
    events(spark, sf_dir).select("event_id", "event_type", "value").write.option("header", True).option("sep", ";").csv(path)
    back = sources.read_csv(spark, path, "event_id long, event_type string, value double")
    return back.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT role, count(*) AS n FROM conversations GROUP BY role")
def source_jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows appended as JSON lines and read back."""
    c = table(spark, sf_dir, "conversations")
    path = f"{sinks.shared_dir(c)}/jsonl-{uuid.uuid4().hex}"
    sinks.append_jsonl(c, path)
    return sources.read_jsonl(spark, path, "conv_id long, turn long, role string, text string").groupBy("role").agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def source_parquet_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parquet sets with differing columns united by name."""
    e = events(spark, sf_dir)
    root = f"{sinks.shared_dir(e)}/union-{uuid.uuid4().hex}"
    e.filter("event_id % 2 = 0").select("event_id", F.col("event_type").alias("label")).write.parquet(f"{root}/a")
    e.filter("event_id % 2 = 1").select("event_id", F.col("event_type").alias("Label_x"), "value").write.parquet(f"{root}/b")
    out = sources.read_parquet_union(spark, [f"{root}/a", f"{root}/b"], "label", {"Label_x": "label"})
    return out.groupBy(F.col("label").alias("event_type")).agg(F.count("*").alias("n"))
