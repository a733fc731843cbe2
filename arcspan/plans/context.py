"""An entity's context: its neighbourhood, paths, timeline, narrative, scores; saved and rendered.

Many entities are done at once. What is gathered for one is capped by the feature's own limits
(`NODES`, `EDGES`), so a hub's context has a fixed size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import graph

#: Steps, nodes and edges of a context at most (the feature's own limits).
RADIUS, NODES, EDGES = 2, 50, 100
#: Detectors of deception, and node types by the detector that their severity counts for (fixed values).
DECEPTION = ["DECEPTION", "HONEYPOT", "CANARYTOKEN", "CONPOT"]
TYPES = {"user": "identity", "process": "endpoint", "plc": "ot", "actuator": "ot", "sensor": "ot"}


def neighbourhood(edges: DataFrame, entities: DataFrame, radius: int = RADIUS, most: int = NODES) -> DataFrame:
    """Rows entity, node_id, depth, path: the first `most` nodes within `radius` steps, in either
    direction, nearest first; the path is the smallest of the shortest ones."""
    # Of what a node leads to, only so many can be among the first: at most `most` smaller ids are new, and as
    # many seen. So a hub is expanded to a bounded number of rows.
    nearest = F.row_number().over(Window.partitionBy("a").orderBy("b"))
    pairs = graph.both_ways(edges).withColumn("_n", nearest).filter(F.col("_n") <= 2 * most).drop("_n")
    seen = frontier = entities.select("entity", F.col("entity").alias("node_id"), F.lit(0).alias("depth"), F.array("entity").alias("path"))
    place = F.row_number().over(Window.partitionBy("entity").orderBy("depth", "node_id"))
    for step in range(1, radius + 1):
        reached = frontier.join(pairs, F.col("node_id") == F.col("a")).select("entity", F.col("b").alias("node_id"), F.concat("path", F.array("b")).alias("path"))
        new = reached.groupBy("entity", "node_id").agg(F.min("path").alias("path"))
        fresh = new.join(seen.select("entity", "node_id"), ["entity", "node_id"], "left_anti").select("entity", "node_id", F.lit(step).alias("depth"), "path")
        seen = seen.unionByName(fresh).withColumn("_p", place).filter(F.col("_p") <= most)
        # An entity whose context is full needs no further step.
        full = seen.filter(F.col("_p") == most).select("entity").distinct()
        frontier = seen.filter(F.col("depth") == step).drop("_p").join(full, "entity", "left_anti")
        seen = seen.drop("_p")
    return seen


def related(edges: DataFrame, near: DataFrame, most: int = EDGES) -> DataFrame:
    """Rows entity and edge: those with both ends in the neighbourhood, the first `most` by time."""
    a, b = (near.select("entity", F.col("node_id").alias(end)) for end in ("src", "dst"))
    both = edges.join(a, "src").join(b, ["entity", "dst"])
    place = F.row_number().over(Window.partitionBy("entity").orderBy("us", "src", "dst", "type"))
    return both.withColumn("_p", place).filter(F.col("_p") <= most).drop("_p")


def confidence_summary(mean: Column) -> Column:
    """Low, Medium or High by the mean confidence of events; null (no events) is not available."""
    return F.when(mean.isNull(), "N/A (No events)").when(mean < 0.5, "Low").when(mean < 0.8, "Medium").otherwise("High")


def line(detector: Column, entity: Column, risk: Column, reasons: Column) -> Column:
    """An event as a line of a timeline."""
    head = F.concat(detector, F.lit(" Specialist observed activity on '"), entity, F.lit("'"))
    return F.when(F.size(F.coalesce(reasons, F.array().cast("array<string>"))) > 0, F.concat(head, F.lit(": "), F.array_join(reasons, ", "))).otherwise(F.concat(head, F.lit(" with threat risk score "), F.format_string("%.2f", risk)))


def _is(field: str, value: str):
    """The predicate that an element's field is a value."""
    return lambda e: e[field] == value


def _kind(value: str):
    """The predicate that a node's id is of a kind."""
    return lambda n: F.lower(F.split(n["node_id"], ":")[0]) == value


def narrative(events: Column) -> Column:
    """A sentence on an array of events (detector, src, dst, family, process, targets, variables), grouped
    by detector in a fixed order; missing fields as in the lines' defaults."""
    plain = lambda x, default: F.coalesce(x, F.lit(default))
    some = lambda xs, before: F.when(F.size(F.coalesce(xs, F.array().cast("array<string>"))) > 0, F.concat(F.lit(before), F.array_join(xs, ", "))).otherwise("")
    texts = {
        "IDENTITY": lambda e: F.concat(F.lit("user "), plain(e["src"], "unknown"), F.lit(" authenticated"), some(e["targets"], " to targets ")),
        "ENDPOINT": lambda e: F.concat(F.lit("executed process '"), plain(e["process"], "unknown"), F.lit("' on host "), plain(e["src"], "unknown")),
        "NETWORK": lambda e: F.concat(F.lit("network flow from "), plain(e["src"], "unknown"), F.lit(" to "), plain(e["dst"], "unknown"), F.lit(" ("), plain(e["family"], "unknown"), F.lit(")")),
        "OT": lambda e: F.concat(F.lit("anomalous PLC changes on "), plain(e["src"], "unknown"), some(e["variables"], " affecting control loops ")),
    }
    parts = []
    for detector, text in texts.items():
        own = F.filter(events, _is("detector", detector))
        parts.append(F.when(F.size(own) > 0, F.array_join(F.transform(own, text), "; ")))
    told = F.array_join(F.array_compact(F.array(*parts)), ", which led to ")
    whole = F.concat(F.upper(F.substring(told, 1, 1)), F.substring(told, F.lit(2), F.length(told)), F.lit("."))
    return F.when(F.coalesce(F.size(events), F.lit(0)) <= 0, "No suspicious activity detected.").when(told == "", "Suspicious threat telemetry observed across detectors.").otherwise(whole)


def build(nodes: DataFrame, edges: DataFrame, entities: DataFrame, radius: int = RADIUS) -> DataFrame:
    """A row for each entity (entity): its context, scored by the weighted rule.

    `nodes`: node_id, type, risk, confidence, severity; `edges`: src, dst, type, us, risk, confidence,
    source_detector. An entity that is no node gets the fallback: no neighbours, confidence 0.1.
    """
    asked = entities.select("entity").distinct()
    known = asked.join(nodes.select(F.col("node_id").alias("entity")), "entity", "left_semi")
    near = neighbourhood(edges, known, radius)
    some = related(edges.select("src", "dst", "type", "us", "risk", "confidence", F.upper("source_detector").alias("detector")), near)
    plain = lambda x: F.element_at(F.split(x, ":"), -1)
    none = F.lit(None).cast("array<string>")
    event = F.struct("us", "src", "dst", "type", "detector", "risk", "confidence")
    told = F.struct(F.col("us").alias("us"), F.col("detector").alias("detector"), plain(F.col("src")).alias("src"), plain(F.col("dst")).alias("dst"), F.lit(None).cast("string").alias("family"), plain(F.col("dst")).alias("process"), none.alias("targets"), none.alias("variables"))
    active = F.when(F.col("risk") > 0, F.col("detector"))
    scores = []
    for d in scoring.WEIGHTS:
        own = F.col("detector").isin(["OT", "ICS"]) if d == "ot" else F.col("detector") == d.upper()
        scores += [F.max(F.when(own, F.col("risk"))).alias(f"{d}_score"), F.max(F.when(own & (F.col("risk") > 0), F.col("confidence"))).alias(f"{d}_confidence")]
    by_edges = some.groupBy("entity").agg(
        F.array_sort(F.collect_list(event)).alias("related_events"), F.array_sort(F.collect_list(told)).alias("_told"), F.avg("confidence").alias("_mean"), F.count_distinct(active).alias("diversity"),
        F.max(F.col("detector").isin(DECEPTION).cast("int")).alias("honeypot"), ((F.max("us") - F.min("us")) / 6e7).alias("temporal_activity"), *scores,
    )
    item = F.struct("depth", "node_id", "type", F.coalesce("risk", F.lit(0.0)).alias("risk"), F.coalesce("severity", F.lit("INFO")).alias("severity"))
    others = F.when(F.col("depth") > 0, F.struct("depth", "node_id", "path"))
    by_nodes = near.join(nodes, "node_id", "left").groupBy("entity").agg(F.array_sort(F.collect_list(item)).alias("supporting_evidence"), F.array_sort(F.collect_list(others)).alias("_paths"))
    out = asked.join(by_nodes, "entity", "left").join(by_edges, "entity", "left")
    found = F.col("supporting_evidence").isNotNull()
    out = out.withColumns({"honeypot": F.coalesce("honeypot", F.lit(0)), "diversity": F.coalesce("diversity", F.lit(0)), "found": found})
    out = out.withColumn("_m", scoring.meta_score(F.col("diversity"), F.col("honeypot")))
    fallback = F.concat(F.lit("Entity "), "entity", F.lit(" not found in graph. Diagnostic fallback applied."))
    lines = F.transform("related_events", lambda e: F.struct(e["us"].alias("us"), line(F.coalesce(e["detector"], F.lit("UNKNOWN")), e["src"], e["risk"], none).alias("description"), e["risk"].alias("risk"), e["confidence"].alias("confidence")))
    named = {"users": "user", "hosts": "host", "ips": "ip", "processes": "process"}
    parts = [F.transform(F.filter("supporting_evidence", _kind(k)), lambda n: F.split(n["node_id"], ":", 2)[1]).alias(name) for name, k in named.items()]
    score = F.when(found, F.col("_m.score")).otherwise(0.0)
    return out.select(
        "entity", "found", F.coalesce(F.transform("_paths", lambda p: p["node_id"]), F.array().cast("array<string>")).alias("related_entities"), F.coalesce(F.transform("_paths", lambda p: p["path"]), F.array().cast("array<array<string>>")).alias("graph_paths"),
        "related_events", "supporting_evidence", lines.alias("timeline"), F.when(found, narrative(F.col("_told"))).otherwise(fallback).alias("risk_summary"), confidence_summary(F.col("_mean")).alias("confidence_summary"),
        F.struct(*parts).alias("entities"), F.coalesce("temporal_activity", F.lit(0.0)).alias("temporal_activity"), *[F.coalesce(f"{d}_score", F.lit(0.0)).alias(f"{d}_score") for d in scoring.WEIGHTS],
        "diversity", "honeypot", score.alias("unified_threat_score"), F.when(found, F.col("_m.confidence")).otherwise(0.1).alias("confidence_score"), scoring.risk_level(score).alias("risk_level"),
    )


def with_memory(contexts: DataFrame, hits: DataFrame, name: str, fields: list[str]) -> DataFrame:
    """Contexts with search hits (entity, rank, fields) as an array of the name, best first."""
    own = hits.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("rank", *fields))).alias(name))
    return contexts.join(own, "entity", "left")


def markdown() -> Column:
    """A context (columns of `build`) as Markdown."""
    text = lambda f, *xs: F.format_string(f, *xs)
    entries = F.coalesce(F.transform("timeline", lambda e, i: text("%d. **[%s]** %s (Risk: %.2f, Conf: %.2f)\n", i + 1, F.date_format(F.timestamp_micros(e["us"]), "yyyy-MM-dd'T'HH:mm:ss"), e["description"], e["risk"], e["confidence"])), F.array().cast("array<string>"))
    features = F.coalesce(F.transform("supporting_evidence", lambda e: text("- **[GRAPH]** Entity: %s | Severity: %s | Risk Score: %.2f\n", e["node_id"], e["severity"], e["risk"])), F.array().cast("array<string>"))
    related = F.array_join("related_entities", ", ")
    paths = F.array_join(F.transform("graph_paths", lambda p: F.array_join(p, " > ")), "; ")
    none = lambda x, empty: F.when(F.coalesce(x, F.lit("")) == "", empty).otherwise(x)
    return F.concat(
        F.lit("# Correlation Security Context: "), "entity", F.lit("\n\n## Unified Threat Assessment\n"), text("- **Unified Threat Score**: `%.4f` (0.0 to 1.0 scale)\n", F.col("unified_threat_score")),
        text("- **Assessed Risk Level**: `%s`\n", F.col("risk_level")), text("- **Assessment Confidence**: `%.4f` (0.0 to 1.0 scale)\n", F.col("confidence_score")), F.lit("\n## Risk Assessment\n"), "risk_summary",
        F.lit("\n\n## Attack Timeline Chain\n"), none(F.array_join(entries, ""), "No timeline entries recorded."), F.lit("\n## Graph Connections\n- **Connected Entities**: "), none(related, "None"),
        F.lit("\n- **Observed Paths**: "), none(paths, "None"), F.lit("\n\n## Supporting Telemetry Features\n"), F.array_join(features, ""),
    )


def save(contexts: DataFrame, path: str) -> None:
    """Contexts as JSON lines."""
    contexts.write.mode("overwrite").json(path)


def load(like: DataFrame, path: str) -> DataFrame:
    """Contexts that `save` wrote, in the schema of `like`; keys that a line lacks are null."""
    return like.sparkSession.read.schema(like.schema).json(path)
