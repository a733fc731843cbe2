"""Whole jobs: telemetry to decisions, and an entity's context in the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import evidence, graph, response, verification
from ..sinks import spool


def decide(rows: DataFrame, actions: Column, asset: str = "asset") -> DataFrame:
    """Scored incidents to decisions: defaults, dry run, gate, status, in one projection."""
    incidents = response.prepare(rows).withColumn("_run", response.dry_run(actions))
    gate = response.policy_gate(F.col(asset), F.lit(None).cast("string"), F.col("_run.passes"), F.col("score"), F.col("confidence"), F.col("_run.blast_radius"), F.col("risk_score"))
    out = incidents.withColumn("gate", gate)
    statuses = F.when(F.col("gate.decision") == "AUTO", F.transform(actions, lambda a: F.lit("SUCCESS"))).otherwise(F.array().cast("array<string>"))
    return out.withColumn("status", F.when(F.col("gate.decision") == "AUTO", response.monitor(F.col("risk_score"), statuses)).otherwise(F.col("gate.decision"))).drop("_run")


def dispatch(rows: DataFrame, edges: DataFrame, start: str = "start_us") -> tuple[DataFrame, DataFrame]:
    """Incidents from their preparation to what verification found, and the evidence that feeds back.

    `rows`: any of the columns that `response.prepare` takes, planned (the plan's actions), decoy and
    `start` (microseconds); `edges`: src, dst, type, us, risk. Incidents: actions, gate, results of
    the actions, status, state, transitions, reason and decision of the verification where one ran.
    Status and state are those that dispatch gives each decision.
    """
    there = set(rows.columns)
    have = lambda c, kind: F.col(c) if c in there else F.lit(None).cast(kind)
    made = response.prepare(rows).withColumns({"start_us": F.col(start).cast("long"), "actions": response.actions(have("decoy", "boolean"), have("planned", "array<string>"), F.col("attack_type"))})
    made = made.withColumn("_run", response.dry_run(F.col("actions")))
    gate = response.policy_gate(F.col("asset"), have("asset_type", "string"), F.col("_run.passes"), F.col("score"), F.col("confidence"), F.col("_run.blast_radius"), F.col("risk_score"))
    made = spool(made.withColumn("gate", gate).withColumn("results", F.when(F.col("gate.decision") == "AUTO", response.standard_actions().outcomes(F.col("actions")))).drop("_run"))
    decision, statuses = F.col("gate.decision"), F.transform("results", lambda r: r["status"])
    outcome = F.when(decision == "AUTO", response.monitor(F.col("risk_score"), statuses)).when(decision == "ESCALATE", "ESCALATED").otherwise("RESOLVED")
    made = made.withColumns({"outcome": outcome, "statuses": statuses})
    checked = verification.verify(made.filter((decision == "AUTO") & (F.col("outcome") == "RESOLVED")).select("incident_id", "asset", "start_us", "actions", "statuses"), edges)
    checked = spool(checked)
    kept = checked.select("incident_id", "state", "reason", "transitions", "decision", "backup")
    array = lambda *xs: F.array(*map(F.lit, xs))
    states = (
        F.when(F.col("transitions").isNotNull(), F.concat(array("INVESTIGATING"), "transitions"))
        .when(decision == "ESCALATE", array("INVESTIGATING", "ESCALATED"))
        .when(decision == "ALLOW", array("INVESTIGATING", "RESOLVED"))
        .when(decision == "MONITOR", array("INVESTIGATING"))
        .when(F.col("outcome") == "PERSISTING", array("INVESTIGATING", "PARTIALLY_CONTAINED", "ESCALATED"))
        .otherwise(array("INVESTIGATING", "FAILED", "ESCALATED"))
    )
    incidents = made.drop("statuses").join(kept, "incident_id", "left").withColumn("transitions", states).withColumn("state", F.element_at("transitions", -1))
    return incidents, verification.feedback(checked.withColumn("at", F.timestamp_micros("start_us")), "at")


def graph_from_evidence(rows: DataFrame, us: str, ttl_us: int = evidence.TTL_US) -> tuple[DataFrame, DataFrame]:
    """Valid evidence, without duplicates, as merged nodes and edges."""
    good = rows.withColumn("_e", evidence.errors()).filter(F.size("_e") == 0).drop("_e")
    keyed = evidence.evidence_hash(good).withColumnRenamed("hash", "_h")
    first = evidence.ttl_dedup(keyed, "_h", us, ttl_us).filter("not is_duplicate").drop("_h", "is_duplicate")
    extracted = spool(graph.extract(first))
    return graph.merge_nodes(extracted), graph.merge_edges(extracted)


def detector_roll_up(rows: DataFrame, key: str) -> DataFrame:
    """Each entity's best score and confidence per detector, its honeypot flag and diversity."""
    d, s = F.upper("detector"), F.col("risk_score")
    made = []
    for name in scoring.WEIGHTS:
        made += [F.max(F.when(d == name.upper(), s)).alias(f"{name}_score"), F.max_by(F.col("confidence"), F.when(d == name.upper(), s)).alias(f"{name}_confidence")]
    return rows.groupBy(key).agg(*made, F.max((d == "HONEYPOT").cast("int")).alias("honeypot"), F.count_distinct(F.when(s > 0, d)).alias("diversity"))


def timeline(rows: DataFrame, key: str, us: str, text: Column) -> DataFrame:
    """Each entity's events as ordered lines of text, with the minutes they span."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(us).alias("o"), text.alias("t")))), lambda x: x["t"])
    return rows.groupBy(key).agg(lines.alias("lines"), F.when(F.count("*") >= 2, (F.max(us) - F.min(us)) / 6e7).otherwise(0.0).alias("active_minutes"))
