"""Response: dry run, policy gate, action ranking, monitoring, the incident state machine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Action rules (blast radius, passes), protected assets, action library, playbooks.
ACTIONS = {"block_ip": ("LOW", True), "revoke_access": ("LOW", True), "isolate_host": ("MEDIUM", True)}
PROTECTED = ["National Database", "Identity Provider", "Domain Controller", "Payment Gateway", "Hospital Core Server"]
LIBRARY = [("isolate_endpoint", 0.9, 0.2), ("revoke_credentials", 0.8, 0.3), ("block_ip", 0.5, 0.1), ("snapshot_vm", 0.0, 0.05)]
CONTAINMENT = {"Isolate Host": 0.9, "Revoke Credential": 0.75, "Block IP/Domain": 0.55, "Snapshot VM": 0.10, "Monitor only": 0.05}
IMPACT = {"Low": 0.2, "Medium": 0.4, "High": 0.6, "Critical": 1.0}
ALIASES = {
    "block_ip/domain": "block_ip", "block_source_ip": "block_ip", "isolate_endpoint": "isolate_host", "revoke_credential": "revoke_access", "revoke_credentials": "revoke_access",
}
PLAYBOOKS = {"Brute Force": ["block_ip", "revoke_access"], "Credential Theft": ["revoke_access"], "Malware": ["isolate_host"], "Ransomware": ["isolate_host", "revoke_access"], "DDoS": ["block_ip"], "Port Scan": ["block_ip"]}
BACKUP = {"block_ip": "isolate_host", "isolate_host": "notify_analyst", "revoke_access": "notify_analyst", "deploy_decoy": "notify_analyst"}


def lookup(key: Column, table: dict, default: object) -> Column:
    """A value of a small fixed table."""
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def canonical_action(action: Column) -> Column:
    """An action's canonical name."""
    plain = F.lower(F.regexp_replace(F.trim(action), r"[\s-]+", "_"))
    return F.coalesce(lookup(plain, ALIASES, None), plain)


def dry_run(actions: Column, reachable: Column | None = None) -> Column:
    """passes and blast_radius of a list of actions; isolation depends on how much is reachable."""
    isolated = F.lit("MEDIUM") if reachable is None else F.when(reachable >= 3, "HIGH").when(reachable >= 1, "MEDIUM").otherwise("LOW")
    radius = lambda a: F.when(a == "isolate_host", isolated).otherwise(lookup(a, {k: v[0] for k, v in ACTIONS.items()}, "HIGH"))
    passes = ~F.exists(actions, lambda a: ~a.isin(list(ACTIONS)) | ((a == "isolate_host") & (radius(a) == "HIGH")))
    worst = F.when(F.exists(actions, lambda a: radius(a) == "HIGH"), "HIGH").otherwise("LOW")
    return F.struct(passes.alias("passes"), worst.alias("blast_radius"))


def blast_level(reachable: Column) -> Column:
    """High, Medium or Low by the number of reachable nodes."""
    return F.when(reachable >= 3, "High").when(reachable >= 1, "Medium").otherwise("Low")


def policy_gate(asset: Column, asset_type: Column, passes: Column, score: Column, confidence: Column, blast_radius: Column, risk_score: Column) -> Column:
    """Decision and reason, by the first rule that applies."""
    made = lambda d, r: F.struct(F.lit(d).alias("decision"), (F.lit(r) if isinstance(r, str) else r).alias("reason"))
    no = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(no(asset.isin(PROTECTED)) | no(asset_type.isin(PROTECTED)), made("ESCALATE", "Protected asset"))
        .when(~F.coalesce(passes, F.lit(True)), made("ESCALATE", "Dry run failed"))
        .when(score < 0.40, made("ALLOW", F.format_string("Low threat score %.4f (benign)", score)))
        .when(score < 0.60, made("MONITOR", F.format_string("Medium threat score %.4f (monitoring)", score)))
        .when(F.coalesce(confidence, F.lit(0.0)) < 0.50, made("ESCALATE", F.format_string("Confidence %.4f below threshold %.4f", F.coalesce(confidence, F.lit(0.0)), F.lit(0.50))))
        .when(no(F.upper(blast_radius) == "HIGH"), made("ESCALATE", "High blast radius"))
        .when(F.coalesce(risk_score, F.lit(0.0)) > 98, made("ESCALATE", "Risk score too high"))
        .otherwise(made("AUTO", "Policy checks passed"))
    )


def rank_actions(confidence: Column, blast: Column, alpha: float = 0.7, beta: float = 0.3) -> Column:
    """All actions with their scores, best first, ties by name."""
    made = []
    for name, contain, impact in LIBRARY:
        c = F.when((blast > 10) & F.lit(name == "isolate_endpoint"), contain * 0.6).otherwise(contain)
        c = F.when((confidence > 0.7) & (blast > 10), c * 0.8).otherwise(c)
        made.append(F.struct((-F.bround(alpha * c - beta * impact, 4)).alias("minus"), F.lit(name).alias("action"), F.bround(c, 4).alias("containment")))
    return F.transform(F.array_sort(F.array(*made)), lambda a: F.struct(a["action"].alias("action"), (-a["minus"]).alias("score")))


def route(confidence: Column, blast: Column, reaches_ot: Column) -> Column:
    """Whether the response may run automatically."""
    return (confidence >= 0.75) & (blast < 15) & ~reaches_ot


def execution_score(action: Column, impact: Column) -> Column:
    """Containment against impact, of an action by name."""
    return 0.6 * lookup(action, CONTAINMENT, 0.0) - 0.4 * lookup(impact, IMPACT, 0.0)


def monitor(risk_score: Column, statuses: Column) -> Column:
    """An incident's status after its actions."""
    return F.when(risk_score > 90, "ESCALATED").when(F.exists(statuses, lambda s: F.coalesce(s, F.lit("FAILED")) != "SUCCESS"), "PERSISTING").otherwise("RESOLVED")


#: Keys of an incident's entities that may hold its address and its user, in order (fixed values).
IP_KEYS, USER_KEYS = ["source_ip", "src_ip", "attacker_ip"], ["user", "username"]


def prepare(df: DataFrame) -> DataFrame:
    """Incidents with what dispatch needs filled in; columns that `df` lacks count as null.

    score: 0.75, or 0.15 where is_malicious is false; risk_score: 100 times it; confidence: the
    hypothesis's, the incident's, else the score; incident_id, asset and attack_type from entity_id
    and classification; attacker_ip from entities (a map), ips (a list), then network_features (a
    map); username from a user entity, users (a list), then entities.
    """
    kinds = dict(df.dtypes)
    have = lambda c, kind="string": F.col(c) if c in kinds else F.lit(None).cast(kind)
    blank = lambda x: F.when(F.length(x) > 0, x)
    held = lambda c, keys: [blank(F.try_element_at(F.col(c), F.lit(k))) for k in keys] if c in kinds else []
    first = lambda c: [blank(F.get(F.col(c), F.lit(0)))] if c in kinds else []
    none = F.lit(None).cast("string")
    score = F.coalesce(have("score", "double"), F.when(F.coalesce(have("is_malicious", "boolean"), F.lit(True)), 0.75).otherwise(0.15))
    entity = F.coalesce(have("entity_id"), F.lit("UNKNOWN"))
    user = F.when(have("entity_type") == "user", entity)
    out = df.withColumn("score", score)
    return out.withColumns({
        "risk_score": F.col("score") * 100 if "risk_score" not in kinds else F.coalesce("risk_score", F.col("score") * 100),
        "confidence": F.coalesce(have("hypothesis_confidence", "double"), have("confidence", "double"), F.greatest("score", F.lit(0.0))),
        "incident_id": F.coalesce(have("incident_id").cast("string"), F.concat(F.lit("INC-"), entity)), "asset": F.coalesce(have("asset"), entity),
        "attack_type": F.coalesce(have("attack_type"), have("classification"), F.lit("Unknown")),
        "attacker_ip": F.coalesce(have("attacker_ip"), *held("entities", IP_KEYS), *first("ips"), *held("network_features", IP_KEYS[:2]), none),
        "username": F.coalesce(have("username"), user, *first("users"), *held("entities", USER_KEYS), none),
    })


def actions(decoy: Column, planned: Column, attack_type: Column) -> Column:
    """An incident's actions, each once, in order: a decoy where the strategy can be tested, the plan's
    known actions, or without any the playbook's."""
    known = F.filter(F.transform(F.coalesce(planned, F.array().cast("array<string>")), canonical_action), lambda a: a.isin([*ACTIONS, "deploy_decoy"]))
    chosen = F.concat(F.when(F.coalesce(decoy, F.lit(False)), F.array(F.lit("deploy_decoy"))).otherwise(F.array().cast("array<string>")), known)
    return F.array_distinct(F.when(F.size(chosen) > 0, chosen).otherwise(playbook(attack_type)))


def top_hypothesis(hypotheses: Column) -> Column:
    """The hypothesis that a response acts on: of an array of (title, description, confidence,
    is_malicious, mitre_techniques) the surest malicious one, else the surest, else an unknown
    benign one; ties go to the first. A missing flag counts as malicious, a missing confidence as 0."""
    mapped = F.transform(
        F.coalesce(hypotheses, F.array().cast("array<struct<title:string,description:string,confidence:double,is_malicious:boolean,mitre_techniques:array<string>>>")),
        lambda h, i: F.struct(
            (~F.coalesce(h["is_malicious"], F.lit(True))).alias("is_benign"), (-F.coalesce(h["confidence"], F.lit(0.0))).alias("minus"), i.alias("place"),
            h["title"].alias("hypothesis"), F.get(h["mitre_techniques"], F.lit(0)).alias("technique_id"), h["description"].alias("reasoning"),
        ),
    )
    made = lambda h: F.struct(h["hypothesis"].alias("hypothesis"), h["technique_id"].alias("technique_id"), (-h["minus"]).alias("confidence"), h["reasoning"].alias("reasoning"), h["is_benign"].alias("is_benign"))
    none = F.struct(F.lit("Unknown threat").alias("hypothesis"), F.lit(None).cast("string").alias("technique_id"), F.lit(0.1).alias("confidence"), F.lit("No hypotheses generated").alias("reasoning"), F.lit(True).alias("is_benign"))
    return F.coalesce(F.get(F.transform(F.slice(F.array_sort(mapped), 1, 1), made), F.lit(0)), none)


class Registry:
    """Response actions by name; each is an expression of its outcome, without side effects.

    An action is a function of the incident's columns (`have`: name to column) that gives a struct
    (action, status, message); one that is not known fails.
    """

    def __init__(self) -> None:
        self.known: dict[str, Callable[[], Column]] = {}

    def add(self, name: str, outcome: Callable[[], Column]) -> None:
        self.known[name] = outcome

    def outcomes(self, actions: Column) -> Column:
        """The outcome of each of a list of actions."""
        made = lambda a: F.struct(a.alias("action"), F.lit("FAILED").alias("status"), F.lit("Unknown action").alias("message"))

        def one(a: Column) -> Column:
            out = made(a)
            for name, outcome in self.known.items():
                out = F.when(a == name, outcome()).otherwise(out)
            return out

        return F.transform(actions, one)


def standard_actions(ip: str = "attacker_ip", host: str = "asset", user: str = "username") -> Registry:
    """The four actions: each succeeds if the incident has what it acts on."""
    out = Registry()

    def add(name: str, column: str, done: str, missing: str) -> None:
        there = F.coalesce(F.col(column), F.lit("")) != ""
        made = lambda status, text: F.struct(F.lit(name).alias("action"), F.lit(status).alias("status"), text.alias("message"))
        out.add(name, lambda: F.when(there, made("SUCCESS", F.concat(F.lit(done), F.col(column)))).otherwise(made("FAILED", F.lit(missing))))

    add("block_ip", ip, "Blocked ", "No address to block")
    add("isolate_host", host, "Isolated ", "No host to isolate")
    add("revoke_access", user, "Revoked access of ", "No user to revoke")
    add("deploy_decoy", host, "Decoy placed on ", "No host for a decoy")
    return out


def playbook(attack_type: Column) -> Column:
    """The actions for a kind of attack; blocking the address by default."""
    out = F.array(F.lit("block_ip"))
    for kind, actions in PLAYBOOKS.items():
        out = F.when(attack_type == kind, F.array(*map(F.lit, actions))).otherwise(out)
    return out


def dashboard_node(node_id: Column, name: Column, risk: Column) -> Column:
    """A node as a dashboard shows it: label, zone, status, criticality (half-even rounding)."""
    label = F.substring(F.coalesce(name, F.element_at(F.split(node_id, ":"), -1)), 1, 28)
    low, r = F.lower(label), F.coalesce(risk, F.lit(0.0))
    ot = low.contains("plc") | low.contains("scada") | low.contains("pump") | low.contains("sensor")
    zone = F.when(low.contains("internet"), "external").when(ot, "ot").otherwise("it")
    status = F.when(r >= 0.85, "compromised").when(r >= 0.5, "at_risk").otherwise("normal")
    critical = F.when(zone == "ot", 10).otherwise(F.greatest(F.lit(1), F.least(F.lit(9), F.bround(r * 10).cast("int"))))
    return F.struct(node_id.alias("id"), label.alias("label"), critical.alias("criticality"), zone.alias("zone"), status.alias("status"))


#: State and event to the next state (fixed values). The states and the order in which they follow each
#: other are those of dispatch and of verification; the events' names are this engine's own.
TRANSITIONS = {
    ("OPEN", "dispatch"): "INVESTIGATING", ("INVESTIGATING", "escalate"): "ESCALATED", ("INVESTIGATING", "allow"): "RESOLVED", ("INVESTIGATING", "monitor"): "INVESTIGATING",
    ("INVESTIGATING", "contain"): "CONTAINMENT_IN_PROGRESS", ("INVESTIGATING", "persist"): "PARTIALLY_CONTAINED", ("INVESTIGATING", "fail"): "FAILED",
    ("CONTAINMENT_IN_PROGRESS", "executed"): "VERIFICATION_PENDING", ("VERIFICATION_PENDING", "quiet"): "CONTAINED", ("VERIFICATION_PENDING", "active"): "PARTIALLY_CONTAINED",
    ("VERIFICATION_PENDING", "fail"): "FAILED", ("VERIFICATION_PENDING", "timeout"): "FAILED", ("CONTAINED", "close"): "RESOLVED", ("PARTIALLY_CONTAINED", "escalate"): "ESCALATED", ("FAILED", "escalate"): "ESCALATED",
}


def next_state(state: Column, event: Column) -> Column:
    """The state after an event; an event without a rule leaves it."""
    out = state
    for (s, e), to in TRANSITIONS.items():
        out = F.when((state == s) & (event == e), F.lit(to)).otherwise(out)
    return out


def replay(df: DataFrame, incident: str, order: str, event: str) -> DataFrame:
    """Each incident's state after all its events in order: a fold over its own short history."""
    history = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(event).alias("e"))))
    return df.groupBy(incident).agg(F.aggregate(history, F.lit("OPEN"), lambda s, x: next_state(s, x["e"])).alias("state"), F.count("*").alias("events"))


#: States of an incident that a person must look at (fixed values).
PENDING = ["ACTIVE", "ESCALATED"]


def approval_queue(incidents: DataFrame, status: str, score: str, id: str) -> DataFrame:
    """Incidents that wait for a person, with place: by score, highest first (none counts as 0), then id."""
    from .evidence import priority_order

    return priority_order(incidents.filter(F.col(status).isin(PENDING)), F.coalesce(F.col(score), F.lit(0)), [id])
