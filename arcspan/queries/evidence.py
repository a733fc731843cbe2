"""Queries on evidence operators; each event is a piece of evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evidence as op
from .registry import EVENTS_SQL, events, query

_E = f"""{EVENTS_SQL}, v AS (SELECT event_id, us, k, CASE event_type WHEN 'error' THEN 'endpoint' WHEN 'click' THEN 'network' WHEN 'view' THEN 'identity' WHEN 'signup' THEN 'ot' ELSE 'unknown' END AS detector,
 'u' || user_id AS entity, 'user' AS entity_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, k / 50 - 0.2::DOUBLE AS confidence, value / max(value) OVER () AS risk_score,
 CASE WHEN k < 25 THEN 'low' WHEN k < 50 THEN 'medium' WHEN k < 75 THEN 'high' ELSE 'critical' END AS severity FROM e)"""


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    top = e.agg(F.max("value").alias("top"))
    k, t = F.col("k"), F.col("event_type")
    detector = F.when(t == "error", "endpoint").when(t == "click", "network").when(t == "view", "identity").when(t == "signup", "ot").otherwise("unknown")
    severity = F.when(k < 25, "low").when(k < 50, "medium").when(k < 75, "high").otherwise("critical")
    return e.join(F.broadcast(top)).select("event_id", "us", "k", detector.alias("detector"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("entity"), F.lit("user").alias("entity_type"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), (k / 50 - 0.2).alias("confidence"), (F.col("value") / F.col("top")).alias("risk_score"), severity.alias("severity"))


@query(f"WITH {_E} SELECT event_id, [x FOR x IN [CASE WHEN detector = 'unknown' THEN 'invalid detector' END, CASE WHEN confidence < 0 OR confidence > 1 THEN 'confidence out of range' END] IF x IS NOT NULL] AS errors FROM v")
def evidence_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that is wrong with each piece of evidence."""
    return _evidence(spark, sf_dir).select("event_id", op.errors().alias("errors"))


@query(f"WITH {_E} SELECT count(*) AS complete FROM v WHERE detector != '' AND entity != ''")
def evidence_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much evidence has all required fields."""
    return _evidence(spark, sf_dir).filter(op.contract()).agg(F.count("*").alias("complete"))


@query(f"WITH {_E} SELECT event_id, upper(detector) AS detector, upper(severity) AS severity, greatest(0, least(1, confidence)) AS confidence, epoch_us(CAST(timestamp AS TIMESTAMP)) AS us, 0 AS n_reasons FROM v")
def evidence_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence in its normal form."""
    n = op.normalize(_evidence(spark, sf_dir).withColumn("top_reasons", F.lit(None).cast("array<string>")))
    return n.select("event_id", "detector", "severity", "confidence", F.unix_micros("time").alias("us"), F.size("top_reasons").alias("n_reasons"))


@query(f"WITH {_E} SELECT event_id FROM v WHERE detector IN ('network', 'endpoint') AND severity IN ('high', 'critical') AND risk_score >= 0.2 AND CAST(timestamp AS TIMESTAMP) BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'")
def evidence_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a subscriber gets."""
    f = op.subscriber_filter(["NETWORK", "ENDPOINT"], severities=["high", "critical"], least_risk=0.2, since="2024-01-05", until="2024-01-20")
    return _evidence(spark, sf_dir).filter(f).select("event_id")


_TTL = 6 * 3_600_000_000


@query(f"""WITH RECURSIVE {_E}, o AS (SELECT detector, entity, severity, us, row_number() OVER (PARTITION BY detector, entity, severity ORDER BY us) AS p FROM v),
w AS (SELECT detector, entity, severity, us, p, us AS start, false AS is_duplicate FROM o WHERE p = 1
 UNION ALL SELECT o.detector, o.entity, o.severity, o.us, o.p, CASE WHEN o.us - w.start > {_TTL} THEN o.us ELSE w.start END, o.us - w.start <= {_TTL} FROM w JOIN o ON o.detector = w.detector AND o.entity = w.entity AND o.severity = w.severity AND o.p = w.p + 1)
SELECT detector, severity, is_duplicate, count(*) AS n FROM w GROUP BY 1, 2, 3""")
def evidence_ttl_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicates within a time to live that they don't renew."""
    v = _evidence(spark, sf_dir).withColumn("hash", op.content_hash(["detector", "entity", "severity"], [], []))
    return op.ttl_dedup(v, "hash", "us", _TTL).groupBy("detector", "severity", "is_duplicate").agg(F.count("*").alias("n"))


@query(f"WITH {_E} SELECT detector, event_id, CAST(row_number() OVER (PARTITION BY detector ORDER BY CASE severity WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 ELSE 2 END DESC, us, event_id) AS INT) AS place FROM v")
def evidence_priority_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each detector's queue, whole."""
    v = op.priority_order(_evidence(spark, sf_dir), op.severity_order(F.col("severity")), ["us", "event_id"], ["detector"])
    return v.select("detector", "event_id", "place")


@query(f"WITH {_E} SELECT event_id, CAST(row_number() OVER (ORDER BY CASE severity WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 ELSE 2 END DESC, us, event_id) AS INT) AS place FROM v")
def evidence_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One queue of all evidence, sorted by ranges."""
    return op.priority_order(_evidence(spark, sf_dir), op.severity_order(F.col("severity")), ["us", "event_id"]).select("event_id", "place")


@query(f"WITH {_E} SELECT entity, count(*) AS n, round(max(risk_score), 6) AS risk FROM v GROUP BY entity")
def evidence_serialize_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence to JSON and back."""
    text = _evidence(spark, sf_dir).select(op.serialize(["entity", "risk_score"]).alias("j"))
    back = text.select(op.deserialize(F.col("j"), "entity string, risk_score double").alias("x")).select("x.*")
    return back.groupBy("entity").agg(F.count("*").alias("n"), F.round(F.max("risk_score"), 6).alias("risk"))


@query(f"WITH {_E} SELECT severity_new AS severity, count(*) AS n FROM (SELECT CASE WHEN risk_score >= 0.5 THEN 'HIGH' WHEN risk_score >= 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS severity_new FROM v) GROUP BY 1")
def evidence_from_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A detector's scores as evidence."""
    out = op.from_detector(_evidence(spark, sf_dir), "NETWORK", "entity", "USER", "risk_score", "timestamp", 0.9)
    return out.groupBy("severity").agg(F.count("*").alias("n"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'canarytoken' ELSE 'conpot' END AS source, 'critical' AS severity, 'ip:' || CASE WHEN event_id % 5 = 0 THEN 'unknown' ELSE '10.0.0.' || user_id END AS entity_id,
CASE WHEN event_id % 2 = 0 THEN 'Canarytoken triggered: ' || event_type || ' token '' '' accessed from ' ELSE 'OT/ICS honeypot interaction: ' || event_type || ' from ' END || CASE WHEN event_id % 5 = 0 THEN 'unknown' ELSE '10.0.0.' || user_id END AS description FROM events""")
def evidence_honeypot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoys' payloads in the unified schema."""
    i = F.col("event_id")
    ip = F.when(i % 5 != 0, F.concat(F.lit("10.0.0."), F.col("user_id").cast("string")))
    payload = F.create_map(F.lit("source_ip"), ip, F.lit("channel"), F.col("event_type"), F.lit("protocol"), F.col("event_type"), F.lit("memo"), F.lit(" "))
    both = F.when(i % 2 == 0, op.normalize_honeypot(payload, "canarytoken")).otherwise(op.normalize_honeypot(payload, "conpot"))
    return events(spark, sf_dir).select("event_id", both.alias("x")).select("event_id", "x.source", "x.severity", "x.entity_id", "x.description")


@query("""SELECT 'network' AS detector, CASE WHEN event_id % 7 = 0 THEN 'unknown-host' ELSE 'e' || user_id END AS entity_id, '' AS timestamp, round(value / 1000, 6) AS score FROM events WHERE event_type = 'click'
UNION ALL SELECT 'identity', CASE WHEN event_id % 7 = 0 THEN 'unknown-user' ELSE 'e' || user_id END, '', round(CAST(json_extract_string(props, '$.k') AS BIGINT) / 100, 6) FROM events WHERE event_type = 'view'""")
def telemetry_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry of two types, adapted and given to the detector of its type."""
    e = events(spark, sf_dir).filter("event_type in ('click', 'view')")
    entity = F.when(F.col("event_id") % 7 != 0, F.concat(F.lit("e"), F.col("user_id").cast("string")))
    data = F.create_map(F.lit("value"), F.col("value"), F.lit("k"), F.col("k").cast("double"))
    telemetry = e.select(F.when(F.col("event_type") == "click", "network").otherwise("identity").alias("telemetry_type"), entity.alias("entity_id"), data.alias("data"))
    scored = lambda name, x: lambda df: df.select(F.lit(name).alias("detector"), "entity_id", "timestamp", F.round(x, 6).alias("score"))
    return op.dispatch(telemetry, {"network": scored("network", F.col("features")["value"] / 1000), "identity": scored("identity", F.col("features")["k"] / 100)})
