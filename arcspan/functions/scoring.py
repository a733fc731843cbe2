"""Scoring formulas as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Detectors, their weights, and the features whose weight is logarithmic (fixed values).
WEIGHTS = {"network": 0.25, "identity": 0.25, "endpoint": 0.30, "ot": 0.20}
LOGARITHMIC = ("count", "degree", "centrality", "pagerank", "activity")


def meta_score(diversity: Column, honeypot: Column) -> Column:
    """Unified threat score and confidence from columns <detector>_score and <detector>_confidence."""
    s = {d: F.coalesce(F.col(f"{d}_score"), F.lit(0.0)) for d in WEIGHTS}
    used = sum(F.when(s[d] > 0, F.lit(w)).otherwise(0.0) for d, w in WEIGHTS.items())
    active = sum(F.when(s[d] > 0, 1).otherwise(0) for d in WEIGHTS)
    base = F.when(used > 0, sum(s[d] * w for d, w in WEIGHTS.items()) / used).otherwise(0.0)
    base = F.when(diversity > 1, base * (1 + 0.05 * F.least(diversity - 1, F.lit(4)))).otherwise(base)
    base = F.least(base, F.lit(0.99))
    base = F.when(active >= 2, F.greatest(base, 0.75 * F.greatest(*s.values()))).otherwise(base)
    sure = sum(F.when(s[d] > 0, F.coalesce(F.col(f"{d}_confidence"), F.lit(1.0))).otherwise(0.0) for d in WEIGHTS)
    confidence = F.when(active > 0, sure / active).otherwise(1.0)
    touched = honeypot > 0.5
    return F.struct(F.when(touched, 0.95).otherwise(base).alias("score"), F.when(touched, 0.99).otherwise(confidence).alias("confidence"))


def soften(p: Column) -> Column:
    """A probability drawn in from both ends."""
    return F.when(p > 0.5, 0.5 + 0.45 * (1 - F.exp(-3 * (p - 0.5)))).otherwise(0.5 - 0.45 * (1 - F.exp(-3 * (0.5 - p))))


def risk_level(score: Column) -> Column:
    """LOW, MEDIUM, HIGH or CRITICAL."""
    return F.when(score < 0.40, "LOW").when(score < 0.60, "MEDIUM").when(score < 0.75, "HIGH").otherwise("CRITICAL")


def contributions(features: list[str], importance: dict[str, float]) -> Column:
    """Each feature's share of the score, as a map; equal shares if nothing contributes."""
    part = {f: (F.log1p(F.abs(F.col(f))) if any(x in f for x in LOGARITHMIC) else F.abs(F.col(f))) * importance.get(f, 0.0) for f in features}
    total = sum(part.values())
    return F.map_from_arrays(F.array(*map(F.lit, features)), F.array(*[F.when(total > 0, part[f] / total).otherwise(1.0 / len(features)) for f in features]))


#: Features by the group that their shares are summed in (fixed values).
GROUPS = {
    "network": ["network_score", "network_confidence", "network_severity"],
    "identity": ["identity_score", "identity_confidence", "identity_severity"],
    "endpoint": ["endpoint_score", "endpoint_confidence", "endpoint_severity", "sigma_match_count"],
    "ot": ["ot_score", "ot_confidence", "ot_severity"],
    "graph": [
        "degree_centrality", "betweenness_centrality", "closeness_centrality", "pagerank", "weakly_connected_components_count", "communities_count", "community_size", "node_degree",
    ],
    "threat_intel": ["threat_intel_match_count", "max_threat_intel_score"],
    "deception": ["honeypot_touched"],
    "other": ["evidence_diversity", "evidence_count", "historical_incident_frequency", "temporal_activity", "monitoring_queue_size", "monitoring_latency"],
}


def group_shares(shares: Column) -> Column:
    """Each group's share, as a map; shares of features in no group are left out of the total."""
    # One-element arrays bind a value to a name, so it is computed once.
    held = lambda m: F.struct(*[sum(F.coalesce(F.try_element_at(m, F.lit(f)), F.lit(0.0)) for f in names).alias(g) for g, names in GROUPS.items()])
    total = lambda p: sum(p[g] for g in GROUPS)
    parts = F.transform(F.transform(F.array(shares), held), lambda p: F.struct(p.alias("p"), total(p).alias("t")))
    share = lambda x: F.create_map(*[y for g in GROUPS for y in (F.lit(g), F.when(x["t"] > 0, x["p"][g] / x["t"]).otherwise(x["p"][g]))])
    return F.get(F.transform(parts, share), F.lit(0))


def model_confidence(score: Column) -> Column:
    """Confidence in a model's (softened) score: half its certainty, half the mean confidence of the
    detectors that have a score, from columns <detector>_score and <detector>_confidence."""
    has = [F.coalesce(F.col(f"{d}_score"), F.lit(0.0)) > 0 for d in WEIGHTS]
    sure = sum(F.when(h, F.coalesce(F.col(f"{d}_confidence"), F.lit(1.0))).otherwise(0.0) for h, d in zip(has, WEIGHTS))
    n = sum(h.cast("int") for h in has)
    return 0.5 * (2.0 * F.abs(score - 0.5)) + 0.5 * F.when(n > 0, sure / n).otherwise(1.0)


def top_features(shares: Column, n: int = 5) -> Column:
    """The names with the largest shares, ties by name."""
    pairs = F.transform(F.map_entries(shares), lambda e: F.struct((-F.round(e["value"], 12)).alias("v"), e["key"].alias("k")))
    return F.transform(F.slice(F.array_sort(pairs), 1, n), lambda p: p["k"])


def clean_feature(name: str) -> Column:
    """A missing, undefined or infinite feature as its default: confidence 1, all else 0."""
    x, default = F.col(name).cast("double"), 1.0 if "confidence" in name else 0.0
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), default).otherwise(x)


# How far each kind of source is trusted.
TRUST = {"attack": 1.0, "d3fend": 1.0, "cve": 1.0, "kev": 1.0, "sigma": 0.8, "yara": 0.8, "playbook": 0.95, "policy": 0.95, "historical_incident": 0.95}


def trust(source: Column, confidence: Column, filled: Column, validated: Column) -> Column:
    """Trust in a document; `filled`: the share of its descriptive fields that are there."""
    base = F.lit(0.8)
    for s, w in TRUST.items():
        base = F.when(source == s, w).otherwise(base)
    x = base * F.when(validated, 1.0).otherwise(0.7) + F.coalesce(confidence, F.lit(1.0)) * 0.2 + filled * 0.1
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)), 4)


def freshness(age_days: Column, deprecated: Column) -> Column:
    """Score and category of a document's age; an unknown age counts as 90 days."""
    age = F.coalesce(age_days, F.lit(90))
    made = lambda x, c: F.struct(F.bround(x, 4).alias("score"), F.lit(c).alias("category"))
    return (
        F.when(deprecated, made(F.lit(0.0), "deprecated"))
        .when(age <= 180, made(1.0 - 0.3 * (age / 180), "fresh"))
        .when(age <= 365, made(0.7 - 0.3 * ((age - 180) / 185), "stale"))
        .otherwise(made(F.greatest(F.lit(0.0), 0.4 - 0.4 * ((age - 365) / 730)), "deprecated"))
    )


def dense_confidence(distance: Column) -> Column:
    """Confidence of a dense hit."""
    return F.bround(F.greatest(F.lit(0.1), 1 - distance / 10), 2)


def graph_confidence(depth: Column) -> Column:
    """Confidence of a node found at a depth."""
    return F.bround(F.greatest(F.lit(0.1), 1 - 0.2 * depth), 2)
