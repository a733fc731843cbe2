"""Queries on verification, limits, decoys, evidence identity, scores and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize, scoring
from ..operators import decoys, endpoint, evidence, industrial, limits, response, retrieval, verification
from ..plans import detection, harness
from .evidence import _E, _TTL, _evidence
from .registry import EVENTS_SQL, events, query, table

SECOND = 1_000_000
DAY = 86_400 * SECOND


def _incidents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """An incident for each user, begun a while after its first event, and events as edges."""
    e = events(spark, sf_dir)
    top = e.agg(F.max("value").alias("t"))
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = e.join(F.broadcast(top)).select(text("user:u", "user_id").alias("src"), text("host:h", "k").alias("dst"), F.col("event_type").alias("type"), "us", (F.col("value") / F.col("t")).alias("risk"))
    u = F.col("user_id")
    i = e.groupBy("user_id").agg(F.min("us").alias("first")).select(
        u.alias("incident_id"), text("u", "user_id").alias("asset"), (F.col("first") + (u % 7) * DAY).alias("start_us"), F.array(F.when(u % 2 == 0, "block_ip").otherwise("revoke_access")).alias("actions"),
        F.array(F.when(u % 5 == 0, "FAILED").otherwise("SUCCESS")).alias("statuses"),
    )
    return i, edges


_LOOP = f"""{EVENTS_SQL}, t AS (SELECT max(value) AS t FROM e), i AS (SELECT user_id, min(us) + (user_id % 7) * {DAY} AS start FROM e GROUP BY user_id),
s AS (SELECT i.user_id, start, max(CASE WHEN us <= start + {2 * DAY} THEN value / t END) AS r0, count(CASE WHEN us <= start + {2 * DAY} THEN 1 END) AS n0, max(CASE WHEN us <= start + {5 * DAY} THEN value / t END) AS r1, count(CASE WHEN us <= start + {5 * DAY} THEN 1 END) AS n1
 FROM i LEFT JOIN e ON e.user_id = i.user_id AND e.us >= start, t GROUP BY i.user_id, start),
v AS (SELECT user_id AS incident_id, CASE WHEN user_id % 5 = 0 THEN 'FAILED' WHEN n0 = 0 THEN 'CONTAINED' WHEN r0 >= 0.2 THEN 'FAILED' WHEN n1 = 0 THEN 'CONTAINED' WHEN r1 >= 0.2 THEN 'FAILED' ELSE 'PARTIALLY_CONTAINED' END AS state,
 CASE WHEN user_id % 5 = 0 THEN 0 WHEN n0 = 0 OR r0 >= 0.2 THEN 1 ELSE 2 END AS attempts, CASE WHEN user_id % 5 = 0 THEN 0 WHEN n0 = 0 OR r0 >= 0.2 THEN n0 ELSE n1 END AS collected FROM s)"""


@query(f"""WITH {_LOOP} SELECT incident_id, state, attempts, collected, CASE state WHEN 'CONTAINED' THEN 'RESOLVE' WHEN 'FAILED' THEN 'ESCALATE' ELSE 'MONITOR' END AS decision,
CASE state WHEN 'CONTAINED' THEN 'RESOLVED' WHEN 'FAILED' THEN 'ESCALATED' ELSE 'PARTIALLY_CONTAINED' END AS final_state, CASE WHEN state != 'FAILED' THEN [] WHEN incident_id % 2 = 0 THEN ['isolate_host'] ELSE ['notify_analyst'] END AS backup FROM v""")
def incident_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed-loop verification of each incident: two checks, two and five days after its start."""
    incidents, edges = _incidents(spark, sf_dir)
    v = verification.verify(incidents, edges, delay=2 * 86_400.0, retries=2, interval=3 * 86_400.0, most=1e9, escalate=0.2)
    return v.select("incident_id", "state", "attempts", "collected", "decision", F.element_at("transitions", -1).alias("final_state"), "backup")


@query(f"WITH {EVENTS_SQL}, i AS (SELECT user_id, min(us) + (user_id % 7) * {DAY} AS start FROM e GROUP BY user_id) SELECT i.user_id AS incident_id, count(*) AS n, max(us) AS last_us FROM i JOIN (SELECT DISTINCT user_id, k, event_type, us, value FROM e) e ON e.user_id = i.user_id AND us >= start GROUP BY 1")
def incident_events_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is seen of each incident's asset from its start on."""
    incidents, edges = _incidents(spark, sf_dir)
    return verification.events_since(incidents, edges).groupBy("incident_id").agg(F.count("*").alias("n"), F.max("us").alias("last_us"))


@query(f"""WITH {_LOOP}, m AS (SELECT state, CASE WHEN incident_id % 2 = 0 THEN 'NETWORK' ELSE 'IDENTITY' END AS detector FROM v)
SELECT detector, CASE state WHEN 'CONTAINED' THEN 'INFO' WHEN 'FAILED' THEN 'CRITICAL' ELSE 'HIGH' END AS severity, CASE state WHEN 'CONTAINED' THEN 0.0 WHEN 'FAILED' THEN 1.0 ELSE 0.4 END::DOUBLE AS risk_score, count(*) AS n FROM m GROUP BY 1, 2, 3""")
def incident_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence that verification gives back."""
    incidents, edges = _incidents(spark, sf_dir)
    v = verification.verify(incidents, edges, delay=2 * 86_400.0, retries=2, interval=3 * 86_400.0, most=1e9, escalate=0.2)
    return verification.feedback(v, "start_us").groupBy("detector", "severity", "risk_score").agg(F.count("*").alias("n"))


@query(f"""WITH {EVENTS_SQL}, u AS (SELECT user_id, user_id % 100 / 100::DOUBLE AS score, user_id % 9 = 0 AS guarded FROM (SELECT DISTINCT user_id FROM e)),
d AS (SELECT *, CASE WHEN guarded THEN 'ESCALATE' WHEN score < 0.4 THEN 'ALLOW' WHEN score < 0.6 THEN 'MONITOR' WHEN score * 100 > 98 THEN 'ESCALATE' ELSE 'AUTO' END AS decision FROM u)
SELECT user_id AS incident_id, decision, CASE decision WHEN 'ESCALATE' THEN 'ESCALATED' WHEN 'AUTO' THEN CASE WHEN score * 100 > 90 THEN 'ESCALATED' ELSE 'RESOLVED' END ELSE 'RESOLVED' END AS outcome,
CASE decision WHEN 'ESCALATE' THEN 'ESCALATED' WHEN 'ALLOW' THEN 'RESOLVED' WHEN 'MONITOR' THEN 'INVESTIGATING' ELSE CASE WHEN score * 100 > 90 THEN 'ESCALATED' ELSE 'RESOLVED' END END AS state FROM d""")
def job_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents from preparation to verified outcome; assets of which nothing is seen later."""
    u = F.col("user_id")
    rows = events(spark, sf_dir).select("user_id").distinct().select(
        u.alias("incident_id"), (u % 100 / 100).alias("score"), F.when(u % 9 == 0, "Domain Controller").otherwise("Laptop").alias("asset"), F.array(F.lit("Isolate Endpoint"), F.lit("isolate_host")).alias("planned"), F.lit(0).cast("long").alias("start_us"),
    )
    edges = _incidents(spark, sf_dir)[1]
    done, _ = detection.dispatch(rows, edges)
    return done.select(F.col("incident_id").cast("long").alias("incident_id"), F.col("gate.decision").alias("decision"), "outcome", "state")


_LIMITED = f"""WITH RECURSIVE {EVENTS_SQL}, o AS (SELECT user_id, event_id, us, row_number() OVER (PARTITION BY user_id ORDER BY us, CAST(event_id AS VARCHAR)) AS p FROM e),
w AS (SELECT user_id, event_id, us, p, [us] AS passed, true AS accepted FROM o WHERE p = 1
 UNION ALL SELECT user_id, event_id, us, p, CASE WHEN len(f) < 3 THEN f || [us] ELSE f END, len(f) < 3
 FROM (SELECT o.user_id, o.event_id, o.us, o.p, list_filter(w.passed, lambda x: o.us - x < {7 * DAY}) AS f FROM w JOIN o ON o.user_id = w.user_id AND o.p = w.p + 1))"""


@query(f"{_LIMITED} SELECT event_id, accepted FROM w")
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which events pass a limit of three a week and user; refused ones don't count."""
    out = limits.admitted(events(spark, sf_dir), "user_id", "us", "event_id", 3, 7 * 86_400)
    return out.select(F.col("id").cast("long").alias("event_id"), "accepted")


@query("""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'touched' WHEN doc_id % 4 = 0 THEN 'expired' ELSE 'active' END AS status, CASE doc_id % 3 WHEN 0 THEN 'credential' WHEN 1 THEN 'smb_share' ELSE 'x' END AS kind FROM documents)
SELECT kind, status, count(*) AS n, count(*) FILTER (WHERE kind = 'x') AS plain FROM d GROUP BY 1, 2""")
def decoy_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoys deployed, some touched, some expired (a touch counts more)."""
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select(i.alias("incident_id"), F.when(i % 3 == 0, "credential").when(i % 3 == 2, "x").alias("decoy_type"), F.lit("File Server").alias("placement_node"), (i * 0).alias("us"))
    log = decoys.deploy(d)
    ids = log.select("decoy_id", "us", F.col("incident_id").cast("long").alias("i"))
    whole = log.unionByName(decoys.events(log, ids.filter("i % 4 = 0"), "expired")).unionByName(decoys.events(log, ids.filter("i % 6 = 0"), "touched"))
    return decoys.states(whole).groupBy(F.col("decoy_type").alias("kind"), "status").agg(F.count("*").alias("n"), F.count_if(F.col("target_path") == "file_server_notes.txt").alias("plain"))


@query(f"""WITH {_E}, t AS (SELECT upper(detector) AS d, entity, upper(severity) AS s, round(risk_score, 6) AS r, round(confidence, 6) AS c, CASE WHEN k % 3 = 0 THEN NULL WHEN k % 3 = 1 THEN '' ELSE 'w' END AS w FROM v)
SELECT entity, count(*) AS n, count(DISTINCT (d, s, r, c, coalesce(w, '~'))) AS hashes FROM t GROUP BY entity""")
def evidence_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many different pieces of evidence each entity has, by the hash of ten fields."""
    v = _evidence(spark, sf_dir).withColumns({"window_start": F.when(F.col("k") % 3 == 1, "").when(F.col("k") % 3 == 2, "w"), "top_reasons": F.array(F.lit("b"), F.lit("a")), "metadata": F.create_map(F.lit("x"), F.lit("y"))})
    return evidence.evidence_hash(v).groupBy("entity").agg(F.count("*").alias("n"), F.count_distinct("hash").alias("hashes"))


@query(f"""WITH RECURSIVE {_E}, g AS (SELECT * FROM v WHERE detector != 'unknown' AND confidence BETWEEN 0 AND 1), h AS (SELECT *, concat_ws('~', detector, entity, severity, round(risk_score, 6), round(confidence, 6)) AS h FROM g),
o AS (SELECT h, severity, us, row_number() OVER (PARTITION BY h ORDER BY us) AS p FROM h),
w AS (SELECT h, severity, us, p, us AS start, true AS kept FROM o WHERE p = 1 UNION ALL SELECT o.h, o.severity, o.us, o.p, CASE WHEN o.us - w.start > {_TTL} THEN o.us ELSE w.start END, o.us - w.start > {_TTL} FROM w JOIN o ON o.h = w.h AND o.p = w.p + 1)
SELECT CASE severity WHEN 'critical' THEN 'CRITICAL' WHEN 'high' THEN 'HIGH' WHEN 'medium' THEN 'NORMAL' ELSE 'LOW' END AS priority, count(*) AS n FROM w WHERE kept GROUP BY 1""")
def evidence_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence taken in: valid, first copies, wrapped, queued."""
    v = _evidence(spark, sf_dir).withColumn("top_reasons", F.lit(None).cast("array<string>")).drop("k", "event_id")
    return evidence.ingest(v, "us", _TTL, F.lit("2024-01-01").cast("timestamp")).groupBy("priority").agg(F.count("*").alias("n"))


@query(f"WITH {_E} SELECT entity, count(*) AS n, round(max(risk_score), 6) AS risk FROM v GROUP BY entity")
def evidence_bytes_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence to bytes and back, the format found by the column's type."""
    text = _evidence(spark, sf_dir).select(evidence.serialize_as(["entity", "risk_score"], "bytes").alias("j"))
    back = text.select(evidence.deserialize_any(text, "j", "entity string, risk_score double").alias("x")).select("x.*")
    return back.groupBy("entity").agg(F.count("*").alias("n"), F.round(F.max("risk_score"), 6).alias("risk"))


@query(f"""WITH {_E} SELECT upper(detector) AS detector, CASE WHEN risk_score >= CASE detector WHEN 'endpoint' THEN 0.75 ELSE 0.5 END THEN 'HIGH' WHEN risk_score >= 0.3 AND detector != 'endpoint' THEN 'MEDIUM' ELSE 'LOW' END AS severity,
CASE detector WHEN 'network' THEN 0.9 WHEN 'identity' THEN 0.9 WHEN 'endpoint' THEN 0.85 ELSE 0.8 END::DOUBLE AS confidence, count(*) AS n FROM v WHERE detector != 'unknown' GROUP BY 1, 2, 3""")
def evidence_from_detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All detectors' outputs as evidence."""
    v = _evidence(spark, sf_dir)
    out = evidence.from_detectors({d: v.filter(F.col("detector") == d.lower()) for d in evidence.DETECTED}, "entity", "risk_score", "timestamp")
    return out.groupBy("detector", "severity", "confidence").agg(F.count("*").alias("n"))


@query("""SELECT event_id AS id, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN 'plain' || user_id ELSE 'deep' || user_id END AS process_name, 'h' || user_id AS host, CASE WHEN event_id % 2 = 0 THEN 'q' || event_type END AS dns_query,
CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id END AS parent_process_id, epoch_us(TIMESTAMP '2024-03-01 10:00:00') AS us FROM events""")
def endpoint_alias_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields found under any alias: a plain null counts, a nested null does not."""
    i, u = F.col("event_id"), F.col("user_id").cast("string")
    m = lambda **kv: F.create_map(*[x for k, v in kv.items() for x in (F.lit(k.replace("__", ".")), v)])
    none = F.lit(None).cast("string")
    name = F.when(i % 4 == 0, m(Image=none, process__name=u)).when(i % 4 == 1, m(process__executable=none, process_name=F.concat(F.lit("C:\\x\\plain"), u))).otherwise(m(process__executable=none, process__name=F.concat(F.lit("deep"), u)))
    rest = F.map_concat(m(host__name=F.concat(F.lit("h"), u), TimeCreated__SystemTime=F.lit("2024-03-01T10:00:00Z"), event__code=F.lit("1")), F.when(i % 2 == 0, m(dns__question__name=F.concat(F.lit("q"), "event_type"))).otherwise(m(zz=none)), F.when(i % 3 == 0, m(ParentProcessId=none, parent_process_id=u)).otherwise(m(process__parent__pid=u)))
    out = endpoint.normalize(events(spark, sf_dir).select(F.col("event_id").alias("id"), F.map_concat(name, rest).alias("record")))
    return out.select("id", "process_name", "host", "dns_query", "parent_process_id", F.unix_micros("timestamp").alias("us"))


@query(f"""WITH {EVENTS_SQL}, t AS (SELECT user_id, us // {DAY} AS day, us, event_id, 'p' || (k % 3) AS c, 'q' || (k % 2) AS p FROM e), f AS (SELECT user_id, day, arg_min(c, (us, event_id)) AS c, arg_min(p, (us, event_id)) AS p FROM t GROUP BY 1, 2)
SELECT t.user_id, t.day, count(*)::DOUBLE AS event_count, count(*) FILTER (WHERE t.c = f.c AND t.p = f.p)::DOUBLE AS parent_child_frequency FROM t JOIN f ON f.user_id = t.user_id AND f.day = t.day GROUP BY 1, 2""")
def endpoint_all_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 26 features of a window, of which these two are shown."""
    from .endpoint import _telemetry

    k = F.col("k").cast("long")
    t = _telemetry(events(spark, sf_dir).withColumn("id", F.col("event_id"))).withColumns({"day": F.floor(F.col("us") / DAY), "process_name": F.concat(F.lit("p"), (k % 3).cast("string")), "parent_process_name": F.concat(F.lit("q"), (k % 2).cast("string"))})
    return endpoint.all_features(t, ["user_id", "day"], F.struct("us", "id")).select("user_id", "day", "event_count", "parent_child_frequency")


@query("SELECT event_id, event_type = 'error' AS raw_hit, user_id % 2 = 0 AS alias_hit FROM events")
def sigma_field_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule fields by raw key whatever its case, then by alias."""
    record = F.create_map(F.lit("EVENTTYPE"), F.col("event_type"))
    e = events(spark, sf_dir).select("event_id", record.alias("record"), F.when(F.col("user_id") % 2 == 0, "cmd.exe").otherwise("x").alias("process_name"))
    get = endpoint.rule_field(e.columns, "record")
    return e.select("event_id", (get("EventType") == "error").alias("raw_hit"), (get("image") == "cmd.exe").alias("alias_hit"))


_O = f"{EVENTS_SQL}, i AS (SELECT event_type AS tag, value, floor(value / 50) AS x, row_number() OVER (PARTITION BY event_type ORDER BY us, event_id) AS idx FROM e)"


@query(f"WITH {_O}, d AS (SELECT *, x - lag(x) OVER (PARTITION BY tag ORDER BY idx) AS d FROM i) SELECT tag, round(var_samp(x), 6) AS variance, count(*) FILTER (WHERE d != 0) AS change_count FROM d GROUP BY tag")
def ot_controller(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variance and changes of controllers."""
    s = industrial.index_rows(events(spark, sf_dir).select(F.col("event_type").alias("tag"), "us", "event_id", F.floor(F.col("value") / 50).cast("double").alias("x")), "tag", ["us", "event_id"])
    return industrial.controller(s, ["tag"], "idx", "x").select("tag", F.round("variance", 6).alias("variance"), "change_count")


@query("""WITH c AS (SELECT abs(corr(l_quantity, l_extendedprice)) AS a, abs(corr(l_quantity, -2.0 * l_quantity + 1)) AS b, abs(corr(l_extendedprice, -2.0 * l_quantity + 1)) AS c FROM lineitem),
p AS (SELECT 'l_extendedprice' AS variable_1, 'l_quantity' AS variable_2, a AS correlation FROM c UNION ALL SELECT 'l_quantity', 'mirror', b FROM c UNION ALL SELECT 'l_extendedprice', 'mirror', c FROM c)
SELECT variable_1, variable_2, round(correlation, 6) AS correlation FROM p WHERE correlation >= 0.85""")
def ot_correlated_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of variables that move together, in either direction."""
    x = table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").cast("double").alias("l_extendedprice"), F.col("l_quantity").cast("double").alias("l_quantity"))
    out = industrial.correlated_pairs(x.withColumn("mirror", 1 - 2 * F.col("l_quantity")), ["l_extendedprice", "l_quantity", "mirror"])
    return out.select("variable_1", "variable_2", F.round("correlation", 6).alias("correlation"))


@query(f"WITH {EVENTS_SQL} SELECT event_id, (row_number() OVER (ORDER BY us, event_id) - 1) // 1000 AS chunk FROM e")
def source_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in chunks of a thousand by time."""
    from ..sources import chunks

    return chunks(events(spark, sf_dir), ["us", "event_id"], 1000).select("event_id", "chunk")


@query("""WITH e AS (SELECT DISTINCT user_id FROM events), f AS (SELECT user_id, user_id % 10 / 10::DOUBLE AS a, user_id % 7 / 7::DOUBLE AS b, ln(1 + user_id % 5)::DOUBLE AS c, user_id % 3 / 3::DOUBLE AS d, user_id % 2::DOUBLE AS h FROM e),
t AS (SELECT *, a * 0.3 + b * 0.2 + c * 0.2 + d * 0.2 + h * 0.1 AS s FROM f)
SELECT user_id, round(CASE WHEN s > 0 THEN a * 0.3 / s ELSE 0.2 END, 6) AS network, round(CASE WHEN s > 0 THEN c * 0.2 / s ELSE 0.2 END, 6) AS graph, round(CASE WHEN s > 0 THEN h * 0.1 / s ELSE 0.2 END, 6) AS deception FROM t""")
def meta_group_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of features summed by group."""
    u = F.col("user_id")
    f = events(spark, sf_dir).select("user_id").distinct().select("user_id", (u % 10 / 10).alias("network_score"), (u % 7 / 7).alias("identity_score"), (u % 5).cast("double").alias("node_degree"), (u % 3 / 3).alias("evidence_x"), (u % 2).cast("double").alias("honeypot_touched"))
    f = f.withColumnRenamed("evidence_x", "endpoint_score")
    weights = {"network_score": 0.3, "identity_score": 0.2, "node_degree": 0.2, "endpoint_score": 0.2, "honeypot_touched": 0.1}
    g = f.withColumn("g", scoring.group_shares(scoring.contributions(list(weights), weights)))
    return g.select("user_id", *[F.round(F.col("g")[n], 6).alias(n) for n in ("network", "graph", "deception")])


@query("""WITH e AS (SELECT DISTINCT user_id FROM events), f AS (SELECT user_id, user_id % 100 / 100::DOUBLE AS s, user_id % 2 > 0 AS a, user_id % 3 > 0 AS b FROM e),
c AS (SELECT *, CASE WHEN a OR b THEN (CASE WHEN a THEN 0.8::DOUBLE ELSE 0 END + CASE WHEN b THEN 0.6::DOUBLE ELSE 0 END) / (a::INT + b::INT) ELSE 1 END AS m FROM f) SELECT user_id, round(0.5 * 2 * abs(s - 0.5) + 0.5 * m, 6) AS confidence FROM c""")
def meta_model_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence in a model's score."""
    u = F.col("user_id")
    f = events(spark, sf_dir).select("user_id").distinct().select("user_id", (u % 100 / 100).alias("s"), (u % 2).cast("double").alias("network_score"), (u % 3).cast("double").alias("endpoint_score"), F.lit(0.0).alias("identity_score"), F.lit(0.0).alias("ot_score"), F.lit(0.8).alias("network_confidence"), F.lit(0.6).alias("endpoint_confidence"), F.lit(0.1).alias("identity_confidence"), F.lit(0.1).alias("ot_confidence"))
    return f.select("user_id", F.round(scoring.model_confidence(F.col("s")), 6).alias("confidence"))


@query("""SELECT user_id, CASE WHEN user_id % 3 = 0 THEN '10.0.0.' || user_id WHEN user_id % 3 = 1 THEN '10.1.0.' || user_id END AS attacker_ip, CASE WHEN user_id % 2 = 0 THEN 'e' || user_id ELSE 'x' || user_id END AS username,
round(CASE WHEN user_id % 5 = 0 THEN 0.9::DOUBLE ELSE 0.75 END, 6) AS confidence, 'INC-e' || user_id AS incident_id, 'e' || user_id AS asset, 'Unknown' AS attack_type FROM (SELECT DISTINCT user_id FROM events)""")
def incident_derive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents with address, user, confidence and names derived."""
    u = F.col("user_id")
    s = lambda p: F.concat(F.lit(p), u.cast("string"))
    d = events(spark, sf_dir).select("user_id").distinct().select(
        "user_id", s("e").alias("entity_id"), F.when(u % 2 == 0, "user").otherwise("host").alias("entity_type"), F.create_map(F.lit("src_ip"), F.when(u % 3 == 0, s("10.0.0.")), F.lit("username"), s("x")).alias("entities"),
        F.when(u % 3 == 1, F.array(s("10.1.0."))).alias("ips"), F.when(u % 5 == 0, 0.9).alias("hypothesis_confidence"),
    )
    return response.prepare(d).select("user_id", "attacker_ip", "username", F.round("confidence", 6).alias("confidence"), "incident_id", "asset", "attack_type")


@query("""SELECT user_id, CASE WHEN user_id % 4 = 0 THEN ['deploy_decoy', 'isolate_host', 'block_ip'] WHEN user_id % 4 = 1 THEN ['isolate_host', 'block_ip'] WHEN user_id % 4 = 2 THEN ['isolate_host', 'revoke_access'] ELSE ['deploy_decoy'] END AS actions FROM (SELECT DISTINCT user_id FROM events)""")
def incident_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each incident's actions, each once, in order."""
    m = F.col("user_id") % 4
    planned = F.when(m <= 1, F.array(F.lit("Isolate Endpoint"), F.lit("block_ip/domain"), F.lit("isolate_host"), F.lit("dance")))
    d = events(spark, sf_dir).select("user_id").distinct()
    return d.select("user_id", response.actions(m.isin(0, 3), planned, F.lit("Ransomware")).alias("actions"))


@query("SELECT doc_id, list_sort(list_distinct([lang, source, 'x'])) AS tags FROM documents")
def tags_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hits' tags merged, each once."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.array_sort(retrieval.merge_lists(F.array("lang", "source"), F.array(F.lit("x"), F.col("lang")))).alias("tags"))


@query("WITH d AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN TIMESTAMP '2024-01-10 00:00:00' - INTERVAL 1 DAY * (doc_id % 400) WHEN 1 THEN TIMESTAMP '2024-01-10 00:00:00' - INTERVAL 1 HOUR * (doc_id % 400) END AS t FROM documents) SELECT doc_id, CAST(floor((epoch_us(TIMESTAMP '2024-01-10 00:00:00') - epoch_us(t)) / 86400000000) AS INT) AS age FROM d")
def document_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days since a time given as ISO text with Z, an offset, or no time at all."""
    i = F.col("doc_id")
    now = F.lit("2024-01-10 00:00:00").cast("timestamp")
    days = F.date_format(F.timestamp_micros(F.unix_micros(now) - (i % 400) * DAY), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    hours = F.date_format(F.timestamp_micros(F.unix_micros(now) - (i % 400) * (DAY // 24)), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    text = F.when(i % 4 == 0, days).when(i % 4 == 1, hours).when(i % 4 == 2, "soon")
    return table(spark, sf_dir, "documents").select("doc_id", normalize.age_days(text, now).alias("age"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, NULL::VARCHAR AS none FROM events")
def json_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values at a path of JSON text."""
    return table(spark, sf_dir, "events").select("event_id", normalize.nested(F.col("props"), "k").alias("k"), normalize.nested(F.col("props"), "a.b").alias("none"))


@query()
def eval_harness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detectors and policy on events: their kind and number say what was true and what detectors thought."""
    e = events(spark, sf_dir)
    scores = {"network": F.col("value") / 1000, "identity": F.col("k") / 100, "endpoint": F.when(F.col("event_type") == "error", 0.9).otherwise(0.1), "ot": F.when(F.col("k") % 3 != 0, F.col("k") / 200)}
    made = {f"{d}_score": F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)) for d, x in scores.items()} | {f"{d}_confidence": F.lit(0.8) for d in scores}
    df = e.select((F.col("k") >= 75).cast("int").alias("truth"), F.lit(0).alias("honeypot"), *[x.alias(n) for n, x in made.items()])
    return harness.evaluate(df.withColumn("diversity", sum((F.coalesce(F.col(f"{d}_score"), F.lit(0.0)) > 0.3).cast("int") for d in scores)))


@query("SELECT conv_id, turn FROM conversations ORDER BY conv_id DESC, turn DESC LIMIT 20")
def ledger_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last twenty entries (a report's own limit)."""
    from ..sinks import tail

    return tail(table(spark, sf_dir, "conversations").select("conv_id", "turn"), ["conv_id", "turn"], 20)


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'Unknown threat' WHEN 1 THEN 'low' WHEN 2 THEN 'b' ELSE 'high' END AS hypothesis, CASE event_id % 4 WHEN 1 THEN 'T1' WHEN 3 THEN 'T2' END AS technique_id,
CASE event_id % 4 WHEN 0 THEN 0.1 WHEN 1 THEN 0.2 WHEN 2 THEN 0.9 ELSE 0.8 END::DOUBLE AS confidence, event_id % 4 IN (0, 2) AS is_benign FROM events""")
def top_hypothesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a response acts on: the surest malicious hypothesis, else the surest, else none."""
    h = lambda title, p, bad, *t: F.struct(F.lit(title).alias("title"), F.lit("d").alias("description"), F.lit(p).alias("confidence"), F.lit(bad).alias("is_malicious"), F.array(*map(F.lit, t)).cast("array<string>").alias("mitre_techniques"))
    i = F.col("event_id") % 4
    given = F.when(i == 1, F.array(h("b", 0.9, False), h("low", 0.2, True, "T1"))).when(i == 2, F.array(h("a", 0.5, False), h("b", 0.9, False))).when(i == 3, F.array(h("mid", 0.5, None), h("high", 0.8, None, "T2", "T3"), h("same", 0.8, True)))
    return events(spark, sf_dir).select("event_id", response.top_hypothesis(given).alias("h")).select("event_id", "h.hypothesis", "h.technique_id", "h.confidence", "h.is_benign")


@query("""WITH r AS (SELECT event_id, event_id % 5 AS m, event_type FROM events) SELECT event_id, CASE m WHEN 0 THEN 401 WHEN 1 THEN 400 ELSE 200 END AS status, CASE WHEN m >= 2 THEN 'ip:10.0.0.1' END AS entity_id, CASE WHEN m >= 2 THEN event_type || ' &' END AS channel FROM r""")
def decoy_webhooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Webhook requests, as JSON and as forms, some without a key or a body."""
    out = evidence.received(webhook_requests(spark, sf_dir), "secret")
    return out.select(F.col("id").alias("event_id"), "status", "event.entity_id", "event.channel")


def webhook_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for each event, each from an address of its own."""
    e, m = events(spark, sf_dir), F.col("event_id") % 5
    channel = F.concat("event_type", F.lit(" &"))
    body = F.when(m == 1, "").when(m == 2, F.to_json(F.struct(channel.alias("channel"), F.lit("10.0.0.1").alias("src_ip")))).otherwise(F.concat(F.lit("src_ip=10.0.0.1&channel="), F.url_encode(channel)))
    return e.select(F.col("event_id").alias("id"), F.lit("canarytoken").alias("kind"), F.concat(F.lit("a"), F.col("event_id").cast("string")).alias("address"), "us", F.when(m != 0, "secret").alias("api_key"), F.when(m == 2, "application/json").otherwise("application/x-www-form-urlencoded").alias("content_type"), body.alias("body"))
