"""Closed-loop verification of containment: is anything new seen of the asset after the actions?

The loop of checks (a delay, then retries at an interval) is replayed from the edges' own times:
at each attempt an incident sees the events of its asset from its start until then. All attempts
are conditional maxima of one aggregation, so events of an asset are never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .response import BACKUP, lookup

#: Seconds, attempts and the risk from which activity counts as an attack that goes on (fixed values).
DELAY_S, RETRIES, INTERVAL_S, MOST_S, ESCALATE = 2.0, 3, 1.0, 10.0, 0.8
#: Kinds of nodes that an asset's name may stand for (fixed values).
KINDS = ["host", "user", "process", "ip", "plc"]


def asset_nodes(incidents: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows incident_id, node_id: the nodes that an asset's name stands for, by the known kinds or by
    its plain name; where there is none, nodes whose last part is the name."""
    own = F.array(*[F.concat(F.lit(f"{k}:"), F.col("asset")) for k in KINDS], F.col("asset"))
    exact = incidents.select("incident_id", F.explode(own).alias("node_id")).join(nodes.select("node_id").distinct(), "node_id")
    rest = incidents.join(exact.select("incident_id").distinct(), "incident_id", "left_anti")
    ends = nodes.select("node_id", F.element_at(F.split("node_id", ":"), -1).alias("asset")).distinct()
    return exact.select("incident_id", "node_id").unionByName(rest.join(ends, "asset").select("incident_id", "node_id"))


def events_since(incidents: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges (src, dst, type, us, risk) of each incident's asset from its start_us on, each once."""
    ends = edges.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("node_id"), "*")
    nodes = asset_nodes(incidents, ends)
    met = ends.join(nodes, "node_id").join(incidents.select("incident_id", "start_us"), "incident_id").filter(F.col("us") >= F.col("start_us"))
    return met.drop("node_id").distinct()


def verify(incidents: DataFrame, edges: DataFrame, delay: float = DELAY_S, retries: int = RETRIES, interval: float = INTERVAL_S, most: float = MOST_S, escalate: float = ESCALATE) -> DataFrame:
    """`incidents` (incident_id, asset, start_us, actions, statuses) with the outcome of verification.

    Adds state, reason, attempts, collected (events seen at the last attempt), transitions (all
    states in order), decision and backup (playbooks that an escalation runs).
    """
    waits = [delay + k * interval for k in range(retries)]
    seen = events_since(incidents, edges)
    upto = [F.col("us") <= F.col("start_us") + int(w * 1e6) for w in waits]
    found = seen.groupBy("incident_id").agg(
        *[F.max(F.when(u, F.col("risk"))).alias(f"_r{k}") for k, u in enumerate(upto)], *[F.count_if(u).alias(f"_n{k}") for k, u in enumerate(upto)]
    )
    out = incidents.join(found, "incident_id", "left")
    made = lambda state, reason, k, n: F.struct(F.lit(state).alias("state"), reason.alias("reason"), F.lit(k).alias("attempts"), n.alias("collected"))
    n = lambda k: F.coalesce(F.col(f"_n{k}"), F.lit(0))
    result = made("FAILED", F.lit("No attempt was made"), 0, F.lit(0).cast("long"))
    for k in reversed(range(retries)):
        r = F.col(f"_r{k}")
        last = made("PARTIALLY_CONTAINED", F.format_string("Activity continuing with moderate/low risk: %.2f", r), k + 1, n(k)) if k == retries - 1 else result
        high = made("FAILED", F.format_string("Malicious activity persists with high risk: %.2f", r), k + 1, n(k))
        quiet = made("CONTAINED", F.lit("Telemetry resolved. No new evidence events detected for asset."), k + 1, n(k))
        result = F.when(n(k) == 0, quiet).when(r >= escalate, high).otherwise(last)
        if waits[k] > most:
            result = made("FAILED", F.lit(f"Verification timed out after {waits[k]:.2f}s"), k + 1, n(k - 1) if k else F.lit(0).cast("long"))
    failed = F.exists("statuses", lambda s: F.coalesce(s, F.lit("FAILED")) != "SUCCESS")
    result = F.when(failed, made("FAILED", F.lit("Containment action failed to execute"), 0, F.lit(0).cast("long"))).otherwise(result)
    out = out.withColumn("_v", result).select(*incidents.columns, "_v.*")
    state = F.col("state")
    path = F.when(state == "CONTAINED", F.array(F.lit("CONTAINED"), F.lit("RESOLVED"))).when(state == "PARTIALLY_CONTAINED", F.array(state)).otherwise(F.array(F.lit("FAILED"), F.lit("ESCALATED")))
    decision = F.when(state == "CONTAINED", "RESOLVE").when(state == "PARTIALLY_CONTAINED", "MONITOR").otherwise("ESCALATE")
    backup = F.array_distinct(F.array_compact(F.transform("actions", lambda a: lookup(a, BACKUP, None))))
    return out.withColumns({
        "transitions": F.concat(F.array(F.lit("CONTAINMENT_IN_PROGRESS"), F.lit("VERIFICATION_PENDING")), path),
        "decision": decision,
        "backup": F.when(decision == "ESCALATE", backup).otherwise(F.array().cast("array<string>")),
    })


def feedback_detector(actions: Column) -> Column:
    """The detector that a verification's evidence is given to, by the first action's name."""
    first = F.lower(F.coalesce(F.get(actions, F.lit(0)), F.lit("")))
    by_name = F.when(first.contains("ip"), "NETWORK").when(first.contains("access") | first.contains("credential"), "IDENTITY").when(first.contains("ot") | first.contains("plc"), "OT")
    return by_name.otherwise("ENDPOINT")


def feedback(verified: DataFrame, at: str) -> DataFrame:
    """Verified incidents as evidence rows, which go back into the stream."""
    state = F.col("state")
    risk = F.when(state == "CONTAINED", 0.0).when(state == "PARTIALLY_CONTAINED", 0.4).otherwise(1.0)
    severity = F.when(state == "CONTAINED", "INFO").when(state == "PARTIALLY_CONTAINED", "HIGH").otherwise("CRITICAL")
    reason = F.concat(F.lit("Closed-loop verification: "), state, F.lit(". Reason: "), F.col("reason"))
    return verified.select(
        feedback_detector(F.col("actions")).alias("detector"), F.col("asset").alias("entity"), F.lit("HOST").alias("entity_type"), F.col(at).cast("string").alias("timestamp"), F.lit(1.0).alias("confidence"),
        risk.alias("risk_score"), severity.alias("severity"), F.array(reason).alias("top_reasons"), F.create_map(F.lit("incident_id"), F.col("incident_id").cast("string"), F.lit("evidence_collected_count"), F.col("collected").cast("string")).alias("metadata"),
    )
