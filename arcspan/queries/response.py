"""Queries on scores and responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import response as op
from .registry import EVENTS_SQL, events, query, table

_S = f"""{EVENTS_SQL}, s AS (SELECT user_id, max(CASE WHEN event_type = 'click' THEN value END) / 500 AS n, max(CASE WHEN event_type = 'view' THEN value END) / 1000 AS i, max(CASE WHEN event_type = 'error' THEN value END) / 700 AS p, max(CASE WHEN event_type = 'signup' THEN value END) / 900 AS o, count(DISTINCT event_type) AS diversity, max(CASE WHEN user_id % 50 = 0 THEN 1 ELSE 0 END) AS honeypot FROM e GROUP BY user_id),
c AS (SELECT user_id, diversity, honeypot, least(1, CASE WHEN user_id % 2 = 0 THEN n ELSE 0 END) AS n, least(1, CASE WHEN user_id % 3 = 0 THEN i ELSE 0 END) AS i, least(1, p) AS p, least(1, CASE WHEN user_id % 5 = 0 THEN o ELSE 0 END) AS o FROM s)"""


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's detector scores, rolled up in one aggregation."""
    e, t, v, u = events(spark, sf_dir), F.col("event_type"), F.col("value"), F.col("user_id")
    top = lambda kind, by: F.max(F.when(t == kind, v)) / by
    g = e.groupBy("user_id").agg(top("click", 500).alias("a"), top("view", 1000).alias("b"), top("error", 700).alias("c"), top("signup", 900).alias("d"), F.count_distinct("event_type").alias("diversity"))
    on = lambda c, m: F.least(F.lit(1.0), F.when(u % m == 0, F.col(c)).otherwise(0.0))
    return g.select("user_id", "diversity", F.when(u % 50 == 0, 1).otherwise(0).alias("honeypot"), on("a", 2).alias("network_score"), on("b", 3).alias("identity_score"), F.least(F.lit(1.0), F.col("c")).alias("endpoint_score"), on("d", 5).alias("ot_score"), *[F.lit(x).alias(f"{d}_confidence") for d, x in (("network", 0.9), ("identity", 0.8), ("endpoint", 0.7), ("ot", 0.6))])


_META = f"""WITH {_S}, u AS (SELECT *, (n > 0)::INT * 0.25::DOUBLE + (i > 0)::INT * 0.25::DOUBLE + (p > 0)::INT * 0.30::DOUBLE + (o > 0)::INT * 0.20::DOUBLE AS used, (n > 0)::INT + (i > 0)::INT + (p > 0)::INT + (o > 0)::INT AS active FROM c),
b AS (SELECT *, least(0.99, (CASE WHEN used > 0 THEN (n * 0.25 + i * 0.25 + p * 0.30 + o * 0.20) / used ELSE 0 END) * CASE WHEN diversity > 1 THEN 1 + 0.05 * least(diversity - 1, 4) ELSE 1 END) AS base,
 CASE WHEN active > 0 THEN ((n > 0)::INT * 0.9::DOUBLE + (i > 0)::INT * 0.8::DOUBLE + (p > 0)::INT * 0.7::DOUBLE + (o > 0)::INT * 0.6::DOUBLE) / active ELSE 1 END AS conf FROM u),
m AS (SELECT user_id, CASE WHEN honeypot > 0.5 THEN 0.95 WHEN active >= 2 THEN greatest(base, 0.75 * greatest(n, i, p, o)) ELSE base END AS score, CASE WHEN honeypot > 0.5 THEN 0.99 ELSE conf END AS confidence, n, i, p, o, diversity FROM b)"""


@query(f"{_META} SELECT user_id, round(score, 6) AS score, round(confidence, 6) AS confidence, CASE WHEN score < 0.4 THEN 'LOW' WHEN score < 0.6 THEN 'MEDIUM' WHEN score < 0.75 THEN 'HIGH' ELSE 'CRITICAL' END AS risk_level, round(CASE WHEN score > 0.5 THEN 0.5 + 0.45 * (1 - exp(-3 * (score - 0.5))) ELSE 0.5 - 0.45 * (1 - exp(-3 * (0.5 - score))) END, 6) AS softened FROM m")
def meta_fallback_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unified threat scores."""
    s = _scores(spark, sf_dir).withColumn("m", scoring.meta_score(F.col("diversity"), F.col("honeypot")))
    x = F.col("m.score")
    return s.select("user_id", F.round(x, 6).alias("score"), F.round("m.confidence", 6).alias("confidence"), scoring.risk_level(x).alias("risk_level"), F.round(scoring.soften(x), 6).alias("softened"))


_IMPORTANCE = {"network_score": 0.3, "identity_score": 0.2, "endpoint_score": 0.25, "ot_score": 0.15, "diversity_count": 0.1}


@query(f"""{_META}, t AS (SELECT user_id, n * 0.3::DOUBLE AS a, i * 0.2::DOUBLE AS b, p * 0.25::DOUBLE AS c, o * 0.15::DOUBLE AS d, ln(1 + diversity) * 0.1::DOUBLE AS e FROM m)
SELECT user_id, round(a / (a + b + c + d + e), 6) AS network_share, round(e / (a + b + c + d + e), 6) AS diversity_share FROM t""")
def meta_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What share each feature has in a score."""
    s = _scores(spark, sf_dir).withColumn("diversity_count", F.col("diversity"))
    m = s.withColumn("shares", scoring.contributions(list(_IMPORTANCE), _IMPORTANCE)).withColumn("top", scoring.top_features(F.col("shares")))
    return m.select("user_id", F.round(F.col("shares")["network_score"], 6).alias("network_share"), F.round(F.col("shares")["diversity_count"], 6).alias("diversity_share"))


_GATE = """CASE WHEN user_id % 11 = 0 THEN 'ESCALATE: Protected asset' WHEN user_id % 7 = 0 THEN 'ESCALATE: Dry run failed' WHEN score < 0.4 THEN 'ALLOW: ' || printf('Low threat score %.4f (benign)', score) WHEN score < 0.6 THEN 'MONITOR: ' || printf('Medium threat score %.4f (monitoring)', score)
WHEN confidence < 0.5 THEN 'ESCALATE: low' WHEN user_id % 5 = 0 THEN 'ESCALATE: High blast radius' WHEN score * 100 > 98 THEN 'ESCALATE: Risk score too high' ELSE 'AUTO: Policy checks passed' END"""


@query(f"{_META.replace('AS score, CASE WHEN honeypot', 'AS score0, CASE WHEN honeypot').replace('FROM b)', 'FROM b), r AS (SELECT user_id, round(score0, 3) AS score, confidence FROM m)')} SELECT user_id, {_GATE} AS outcome FROM r")
def policy_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions of the policy gate."""
    s = _scores(spark, sf_dir).withColumn("m", scoring.meta_score(F.col("diversity"), F.col("honeypot"))).withColumn("score", F.round("m.score", 3))
    u = F.col("user_id")
    asset = F.when(u % 11 == 0, "Domain Controller").otherwise("Laptop")
    run = op.dry_run(F.when(u % 7 == 0, F.array(F.lit("deploy_decoy"))).otherwise(F.array(F.lit("block_ip"))))
    blast = F.when(u % 5 == 0, "High").otherwise(run["blast_radius"])
    gate = op.policy_gate(asset, F.lit("x"), run["passes"], F.col("score"), F.col("m.confidence"), blast, F.col("score") * 100)
    return s.select("user_id", gate.alias("g")).select("user_id", F.concat_ws(": ", "g.decision", "g.reason").alias("outcome"))


@query("""WITH a AS (SELECT DISTINCT user_id % 6 AS kind FROM events) SELECT kind, kind NOT IN (2, 4) AS passes, CASE WHEN kind IN (2, 4) THEN 'HIGH' ELSE 'LOW' END AS blast_radius FROM a""")
def dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a dry run says of lists of actions."""
    k = F.col("kind")
    a = events(spark, sf_dir).select((F.col("user_id") % 6).alias("kind")).distinct()
    actions = F.when(k == 2, F.array(F.lit("block_ip"), F.lit("deploy_decoy"))).when(k == 4, F.array(F.lit("isolate_host"))).when(k == 5, F.array(op.canonical_action(F.lit("Isolate Endpoint")))).otherwise(F.array(F.lit("revoke_access")))
    return a.select("kind", op.dry_run(actions, F.when(k == 4, 3).otherwise(1)).alias("d")).select("kind", "d.*")


@query("""WITH c AS (SELECT DISTINCT user_id % 10 / 10 AS conf, user_id % 20 AS blast FROM events),
l AS (SELECT conf, blast, a, CASE WHEN blast > 10 AND a = 'isolate_endpoint' THEN contain * 0.6 ELSE contain END AS contain, impact FROM c, (VALUES ('isolate_endpoint', 0.9::DOUBLE, 0.2::DOUBLE), ('revoke_credentials', 0.8, 0.3), ('block_ip', 0.5, 0.1), ('snapshot_vm', 0.0, 0.05)) v(a, contain, impact)),
s AS (SELECT conf, blast, a, 0.7 * CASE WHEN conf > 0.7 AND blast > 10 THEN contain * 0.8 ELSE contain END - 0.3 * impact AS score FROM l)
SELECT conf, blast, list(a ORDER BY round(score, 4) DESC, a) AS actions, round(max(score), 3) AS best, conf >= 0.75 AND blast < 15 AS auto FROM s GROUP BY conf, blast""")
def action_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response actions, best first."""
    c = events(spark, sf_dir).select((F.col("user_id") % 10 / 10).alias("conf"), (F.col("user_id") % 20).alias("blast")).distinct()
    r = c.withColumn("r", op.rank_actions(F.col("conf"), F.col("blast")))
    return r.select("conf", "blast", F.transform("r", lambda a: a["action"]).alias("actions"), F.round(F.col("r")[0]["score"], 3).alias("best"), op.route(F.col("conf"), F.col("blast"), F.lit(False)).alias("auto"))


@query("SELECT event_type, round(CASE event_type WHEN 'click' THEN 0.6 * 0.9 - 0.4 * 0.2 WHEN 'view' THEN 0.6 * 0.75 - 0.4 * 0.4 ELSE 0.0 - 0.4 * 1.0 END::DOUBLE, 6) AS score, count(*) AS n FROM events GROUP BY event_type")
def execution_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Execution scores by action and impact."""
    t = F.col("event_type")
    action = F.when(t == "click", "Isolate Host").when(t == "view", "Revoke Credential").otherwise("?")
    impact = F.when(t == "click", "Low").when(t == "view", "Medium").otherwise("Critical")
    g = events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"))
    return g.select("event_type", F.round(op.execution_score(action, impact), 6).alias("score"), "n")


@query("SELECT user_id, CASE WHEN max(value) > 450 THEN 'ESCALATED' WHEN count(*) FILTER (WHERE event_type = 'error') > 0 THEN 'PERSISTING' ELSE 'RESOLVED' END AS status FROM events GROUP BY user_id")
def monitor_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status after all actions."""
    g = events(spark, sf_dir).groupBy("user_id").agg((F.max("value") / 5).alias("risk"), F.collect_set(F.when(F.col("event_type") == "error", "FAILED").otherwise("SUCCESS")).alias("s"))
    return g.select("user_id", op.monitor(F.col("risk"), F.col("s")).alias("status"))


@query("SELECT doc_id, round(least(1, CASE source WHEN 'src0' THEN 1.0 WHEN 'src1' THEN 0.8 ELSE 0.95 END * CASE WHEN doc_id % 3 = 0 THEN 0.7 ELSE 1.0 END + 0.2 * 0.5 + 0.1 * 0.5)::DOUBLE, 4) AS trust FROM documents")
def trust_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trust in each document."""
    d = table(spark, sf_dir, "documents")
    kind = F.when(F.col("source") == "src0", "attack").when(F.col("source") == "src1", "sigma").otherwise("policy")
    return d.select("doc_id", scoring.trust(kind, F.lit(0.5), F.lit(0.5), F.col("doc_id") % 3 != 0).alias("trust"))


@query("WITH a AS (SELECT doc_id, (doc_id * 7) % 1400 AS age, doc_id % 13 = 0 AS dep FROM documents) SELECT doc_id, CASE WHEN dep THEN 'deprecated' WHEN age <= 180 THEN 'fresh' WHEN age <= 365 THEN 'stale' ELSE 'deprecated' END AS category, round(CASE WHEN dep THEN 0 WHEN age <= 180 THEN 1 - 0.3 * (age / 180) WHEN age <= 365 THEN 0.7 - 0.3 * ((age - 180) / 185) ELSE greatest(0, 0.4 - 0.4 * ((age - 365) / 730)) END::DOUBLE, 4) AS score FROM a")
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Freshness of each document."""
    d = table(spark, sf_dir, "documents").select("doc_id", scoring.freshness((F.col("doc_id") * 7) % 1400, F.col("doc_id") % 13 == 0).alias("f"))
    return d.select("doc_id", "f.category", "f.score")


@query("WITH p AS (SELECT user_id, score FROM (SELECT user_id, CASE WHEN user_id % 4 = 0 THEN NULL ELSE user_id % 100 / 100 END AS score FROM (SELECT DISTINCT user_id FROM events))) SELECT user_id, coalesce(score, CASE WHEN user_id % 8 = 0 THEN 0.15 ELSE 0.75 END)::DOUBLE AS score, coalesce(score, CASE WHEN user_id % 8 = 0 THEN 0.15 ELSE 0.75 END)::DOUBLE * 100 AS risk_score FROM p")
def incident_prepare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents with defaults filled in."""
    u = F.col("user_id")
    d = events(spark, sf_dir).select("user_id").distinct().select("user_id", F.when(u % 4 != 0, u % 100 / 100).alias("score"), (u % 8 != 0).alias("is_malicious"), F.lit(None).cast("double").alias("risk_score"), F.lit(None).cast("double").alias("confidence"))
    return op.prepare(d).select("user_id", "score", "risk_score")


@query("""WITH RECURSIVE o AS (SELECT conv_id, CASE turn % 3 WHEN 0 THEN 'dispatch' WHEN 1 THEN 'contain' ELSE 'executed' END AS e, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
s AS (SELECT conv_id, p, n, CASE WHEN e = 'dispatch' THEN 'INVESTIGATING' ELSE 'OPEN' END AS state FROM o WHERE p = 1
 UNION ALL SELECT o.conv_id, o.p, o.n, CASE WHEN state = 'OPEN' AND e = 'dispatch' THEN 'INVESTIGATING' WHEN state = 'INVESTIGATING' AND e = 'contain' THEN 'CONTAINMENT_IN_PROGRESS' WHEN state = 'CONTAINMENT_IN_PROGRESS' AND e = 'executed' THEN 'VERIFICATION_PENDING' ELSE state END FROM s JOIN o ON o.conv_id = s.conv_id AND o.p = s.p + 1)
SELECT state, count(*) AS incidents FROM s WHERE p = n GROUP BY state""")
def incident_state_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents' states after their events."""
    t = F.col("turn") % 3
    c = table(spark, sf_dir, "conversations").withColumn("e", F.when(t == 0, "dispatch").when(t == 1, "contain").otherwise("executed"))
    return op.replay(c, "conv_id", "turn", "e").groupBy("state").agg(F.count("*").alias("incidents"))


@query("SELECT event_type, CASE event_type WHEN 'error' THEN ['isolate_host'] WHEN 'click' THEN ['block_ip', 'revoke_access'] ELSE ['block_ip'] END AS actions FROM (SELECT DISTINCT event_type FROM events)")
def playbook_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions for each kind of attack."""
    t = F.col("event_type")
    kind = F.when(t == "error", "Malware").when(t == "click", "Brute Force").otherwise("?")
    return events(spark, sf_dir).select("event_type").distinct().select("event_type", op.playbook(kind).alias("actions"))


@query("""WITH r AS (SELECT user_id, max(value) / 500 AS r FROM events GROUP BY 1), l AS (SELECT *, CASE WHEN user_id % 3 = 0 THEN 'pump-' ELSE 'host-' END || user_id AS label FROM r)
SELECT label, CASE WHEN user_id % 3 = 0 THEN 'ot' ELSE 'it' END AS zone, CASE WHEN r >= 0.85 THEN 'compromised' WHEN r >= 0.5 THEN 'at_risk' ELSE 'normal' END AS status, CASE WHEN user_id % 3 = 0 THEN 10 ELSE greatest(1, least(9, CAST(round_even(r * 10, 0) AS INT))) END AS criticality FROM l""")
def dashboard_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes as a dashboard shows them."""
    u = F.col("user_id")
    n = events(spark, sf_dir).groupBy("user_id").agg((F.max("value") / 500).alias("r"))
    name = F.concat(F.when(u % 3 == 0, "pump-").otherwise("host-"), u.cast("string"))
    return n.select(op.dashboard_node(F.concat(F.lit("HOST:"), name), F.lit(None).cast("string"), F.col("r")).alias("x")).select("x.label", "x.zone", "x.status", "x.criticality")
