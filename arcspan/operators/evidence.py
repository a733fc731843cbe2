"""Typed evidence: contract, validation, normalisation, filters, TTL dedup, priority order."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import clip01
from .ranks import placed

# The closed sets of the evidence contract. Deception evidence is accepted, too.
DETECTORS = ["NETWORK", "IDENTITY", "ENDPOINT", "OT", "CLOUD", "EMAIL", "DNS", "HONEYPOT"]
ENTITY_TYPES = ["HOST", "USER", "PROCESS", "DEVICE", "PLC", "SENSOR", "ACTUATOR", "NETWORK_FLOW", "DOMAIN", "FILE", "REGISTRY", "SERVICE"]
SEVERITIES = ["INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL"]
PRIORITIES = {"LOW": 1, "NORMAL": 2, "HIGH": 3, "CRITICAL": 4}
REQUIRED = ["detector", "entity", "timestamp", "risk_score", "confidence", "severity"]
TTL_US = 600 * 1_000_000


def severity_order(severity: Column) -> Column:
    """A severity's rank, from 1; unknown ones 0."""
    out = F.lit(0)
    for k, s in enumerate(SEVERITIES, 1):
        out = F.when(F.upper(severity) == s, k).otherwise(out)
    return out


def contract(required: list[str] = REQUIRED) -> Column:
    """Whether all required fields are there and not empty."""
    out = F.lit(True)
    for c in required:
        out = out & F.col(c).isNotNull() & (F.col(c).cast("string") != "")
    return out


def errors() -> Column:
    """All that is wrong with an evidence row, in the order of its fields; none if valid."""
    out_of = lambda c: F.col(c).isNull() | F.isnan(c) | (F.col(c) < 0) | (F.col(c) > 1)
    member = lambda c, of: ~F.coalesce(F.upper(F.col(c)).isin(of), F.lit(False))
    return F.array_compact(F.array(
        F.when(member("detector", DETECTORS), "invalid detector"),
        F.when(F.coalesce(F.col("entity"), F.lit("")) == "", "missing entity"),
        F.when(member("entity_type", ENTITY_TYPES), "invalid entity_type"),
        F.when(F.try_to_timestamp(F.col("timestamp")).isNull(), "invalid timestamp"),
        F.when(out_of("confidence"), "confidence out of range"),
        F.when(out_of("risk_score"), "risk_score out of range"),
        F.when(member("severity", SEVERITIES), "invalid severity"),
    ))


def normalize(df: DataFrame) -> DataFrame:
    """Upper-case enumerations, scores within 0 and 1, times as timestamps, lists never null."""
    up = {c: F.upper(F.trim(F.col(c))) for c in ("detector", "entity_type", "severity")}
    return df.withColumns(up | {"entity": F.trim("entity"), "confidence": clip01(F.col("confidence")), "risk_score": clip01(F.col("risk_score")), "time": F.try_to_timestamp("timestamp"), "top_reasons": F.coalesce("top_reasons", F.array().cast("array<string>"))})


#: Fields of each class of evidence, and what missing ones become (fixed values).
CLASS_FIELDS = {
    "NETWORK": {"attack_family": "string", "protocol": "string", "source_ip": "string", "destination_ip": "string", "flow_duration": "double"},
    "IDENTITY": {"user": "string", "auth_count": "int", "computer_fanout": "int", "new_computer_ratio": "double", "off_hours": "boolean"},
    "ENDPOINT": {"process": "string", "sigma_hits": "array<string>", "mitre_candidates": "array<string>"},
    "OT": {"top_shifted_variables": "array<string>", "anomaly_score": "double", "attack_probability": "double"},
}


def coerce(df: DataFrame, detector: str) -> DataFrame:
    """Evidence of one class with that class's fields in their types: numbers 0, flags false, lists
    empty, texts empty where missing or unreadable; fields that `df` lacks are added."""
    out = {}
    for name, kind in CLASS_FIELDS[detector].items():
        there = F.col(name) if name in df.columns else F.lit(None)
        if kind.startswith("array"):
            held = there if dict(df.dtypes).get(name, "").startswith("array") else F.lit(None)
            out[name] = F.coalesce(held.cast(kind), F.array().cast(kind))
        else:
            default = {"string": "", "boolean": False}.get(kind, 0)
            out[name] = F.coalesce(there.cast("string") if kind == "string" else there.try_cast(kind), F.lit(default).cast(kind))
    return df.withColumns(out)


#: Priority of a severity (fixed values); any other is NORMAL.
BY_SEVERITY = {"CRITICAL": "CRITICAL", "HIGH": "HIGH", "MEDIUM": "NORMAL", "LOW": "LOW", "INFO": "LOW"}


def priority(severity: Column) -> Column:
    """The priority's name for a severity."""
    out = F.lit("NORMAL")
    for s, p in BY_SEVERITY.items():
        out = F.when(F.upper(severity) == s, p).otherwise(out)
    return out


def wrap(df: DataFrame, now: Column) -> DataFrame:
    """Evidence as events of the stream: id, time, detector, entity, priority, status, payload (JSON).

    The id comes from the content and the time, so a retried task gives the same one.
    """
    made = evidence_hash(df)
    id = F.concat(F.lit("EVT-"), F.upper(F.substring(F.sha2(F.concat_ws("|", "hash", F.col("timestamp").cast("string")), 256), 1, 12)))
    payload = F.to_json(F.struct(*df.columns))
    return made.select(id.alias("event_id"), now.alias("wrapped_at"), "detector", "entity", priority(F.col("severity")).alias("priority"), F.lit("PENDING").alias("status"), payload.alias("payload"), "hash")


def ingest(df: DataFrame, us: str, ttl_us: int = TTL_US, now: Column | None = None) -> DataFrame:
    """Evidence as it is taken in: valid rows, normal form, first copies only, as wrapped events in
    the order of the queue (place).

    `df` needs the contract's columns, top_reasons and `us`.
    """
    good = normalize(df.withColumn("_e", errors()).filter(F.size("_e") == 0).drop("_e"))
    first = ttl_dedup(evidence_hash(good).withColumnRenamed("hash", "_h"), "_h", us, ttl_us).filter("not is_duplicate").drop("_h", "is_duplicate")
    events = wrap(first, F.current_timestamp() if now is None else now)
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in PRIORITIES.items() for x in kv]), F.col("priority"))
    return priority_order(events, rank, ["wrapped_at", "event_id"])


def subscriber_filter(detectors: list[str] | None = None, entity_types: list[str] | None = None, severities: list[str] | None = None, entity: str | None = None, least_risk: float | None = None, least_confidence: float | None = None, since: str | None = None, until: str | None = None) -> Column:
    """A subscriber's conjunction of optional predicates; a time that cannot be read passes."""
    out = F.lit(True)
    for c, of in (("detector", detectors), ("entity_type", entity_types), ("severity", severities)):
        if of is not None:
            out = out & F.upper(F.col(c)).isin([x.upper() for x in of])
    if entity is not None:
        out = out & (F.col("entity") == entity)
    for c, least in (("risk_score", least_risk), ("confidence", least_confidence)):
        if least is not None:
            out = out & (F.col(c) >= least)
    time = F.try_to_timestamp(F.col("timestamp"))
    if since is not None:
        out = out & F.coalesce(time >= F.lit(since).cast("timestamp"), F.lit(True))
    if until is not None:
        out = out & F.coalesce(time <= F.lit(until).cast("timestamp"), F.lit(True))
    return F.coalesce(out, F.lit(False))


def content_hash(columns: list[str], scores: list[str], lists: list[str], maps: list[str] | None = None) -> Column:
    """SHA-256 of the fields that make evidence the same: scores to 6 places, lists and maps sorted.

    It is taken of the fields as JSON, so null, empty text and any sign in a value stay apart.
    """
    parts = [F.col(c).cast("string").alias(c) for c in columns]
    parts += [F.round(F.col(c).cast("double"), 6).alias(c) for c in scores]
    parts += [F.array_sort(F.coalesce(F.col(c), F.array().cast("array<string>"))).alias(c) for c in lists]
    parts += [F.array_sort(F.map_entries(F.coalesce(F.col(c), F.create_map().cast("map<string,string>")))).alias(c) for c in maps or []]
    return F.sha2(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}), 256)


def evidence_hash(df: DataFrame) -> DataFrame:
    """`df` with hash, of the ten core fields: names in their normal form, both window ends, both
    scores, severity, sorted reasons and metadata; the time of the evidence itself is left out."""
    kinds = dict(df.dtypes)
    string = {c: F.col(c).cast("string") if c in kinds else F.lit(None).cast("string") for c in ("window_start", "window_end")}
    none = {"top_reasons": F.array().cast("array<string>"), "metadata": F.create_map().cast("map<string,string>")}
    fields = {
        "detector": F.upper("detector"), "entity": F.trim("entity"), "entity_type": F.upper("entity_type"), **string, "risk_score": F.col("risk_score"), "confidence": F.col("confidence"), "severity": F.upper("severity"),
        **{c: F.col(c) if c in kinds else empty for c, empty in none.items()},
    }
    made = df.withColumns({f"_h_{c}": x for c, x in fields.items()})
    h = lambda *names: [f"_h_{c}" for c in names]
    of = content_hash(h("detector", "entity", "entity_type", "window_start", "window_end", "severity"), h("risk_score", "confidence"), h("top_reasons"), h("metadata"))
    return made.withColumn("hash", of).drop(*h(*fields))


def ttl_dedup(df: DataFrame, key: str, us: str, ttl_us: int = TTL_US) -> DataFrame:
    """`df` with is_duplicate: whether a first copy of the key is at most `ttl_us` old.

    Duplicates don't renew the time to live, so first copies are the anchors of the same fold as
    that of anchored windows. Of rows at a same time the first by all columns is the anchor's.
    """
    from .endpoint import anchored_windows

    w = anchored_windows(df, [key], us, ttl_us)
    # Only rows at a window's first time can be its first copy.
    place = F.row_number().over(Window.partitionBy(key, us).orderBy(F.xxhash64(*df.columns)))
    return w.withColumn("is_duplicate", (F.col(us) != F.col("window_start")) | (place > 1)).drop("window_index", "window_start")


def priority_order(df: DataFrame, priority: Column, arrival: list[str], partitions: list[str] | None = None) -> DataFrame:
    """`df` with place: by priority, highest first, then arrival; within `partitions` if given.

    One queue of all rows is sorted by ranges, not in one task.
    """
    order = [priority.desc(), *map(F.col, arrival)]
    if not partitions:
        return placed(df, order).withColumn("place", (F.col("_p") + 1).cast("int")).drop("_p", "_p_all")
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*partitions).orderBy(*order)))


def from_detector(df: DataFrame, detector: str, entity: str, entity_type: str, score: str, time: str, confidence: float, high: float = 0.5, medium: float | None = 0.3) -> DataFrame:
    """A detector's output as evidence rows; endpoint scores are high from 0.75 and never medium."""
    s = F.col(score)
    severity = F.when(s >= high, "HIGH")
    severity = (severity if medium is None else severity.when(s >= medium, "MEDIUM")).otherwise("LOW")
    return df.select(F.lit(detector).alias("detector"), F.col(entity).cast("string").alias("entity"), F.lit(entity_type).alias("entity_type"), F.col(time).cast("string").alias("timestamp"), F.lit(confidence).alias("confidence"), s.alias("risk_score"), severity.alias("severity"))


def serialize(columns: list[str]) -> Column:
    """A row as JSON."""
    return F.to_json(F.struct(*columns))


def deserialize(text: Column, schema: str) -> Column:
    """What `serialize` wrote; null if it cannot be read."""
    return F.from_json(text, schema)


def serialize_as(columns: list[str], kind: str) -> Column:
    """A row as `json` text, UTF-8 `bytes` or a `dict` (struct). `msgpack` needs a library that this
    engine does not require: ValueError, like any unknown kind."""
    if kind not in ("json", "bytes", "dict"):
        raise ValueError(f"unsupported serialisation: {kind}")
    return F.struct(*columns) if kind == "dict" else serialize(columns) if kind == "json" else F.encode(serialize(columns), "UTF-8")


def deserialize_any(df: DataFrame, column: str, schema: str) -> Column:
    """A struct, JSON text or its UTF-8 bytes in `column`, told apart by the column's type."""
    kind = dict(df.dtypes)[column]
    if kind.startswith("struct"):
        return F.col(column).cast(f"struct<{', '.join(':'.join(f.split(' ', 1)) for f in schema.split(', '))}>")
    if kind not in ("string", "binary"):
        raise ValueError(f"cannot read evidence from {kind}")
    return deserialize(F.decode(F.col(column), "UTF-8") if kind == "binary" else F.col(column), schema)


#: Detectors' entity types, confidences and cut-offs for severities (fixed values).
DETECTED = {"NETWORK": ("NETWORK_FLOW", 0.9, 0.5, 0.3), "IDENTITY": ("USER", 0.9, 0.5, 0.3), "ENDPOINT": ("HOST", 0.85, 0.75, None), "OT": ("PLC", 0.8, 0.5, 0.3)}


def from_detectors(outputs: dict[str, DataFrame], entity: str, score: str, time: str) -> DataFrame:
    """All detectors' outputs (by name) as one table of evidence."""
    out = None
    for name, df in outputs.items():
        kind, confidence, high, medium = DETECTED[name]
        made = from_detector(df, name, entity, kind, score, time, confidence, high, medium)
        out = made if out is None else out.unionByName(made)
    return out


def parse_payload(body: Column, content_type: Column) -> Column:
    """A webhook's body as a map of strings: JSON (values that are no text as JSON) or a form's fields;
    null if it is empty or cannot be read."""
    fields = F.transform_values(F.str_to_map(body, F.lit("&"), F.lit("=")), lambda _k, v: F.try_url_decode(F.coalesce(v, F.lit(""))))
    form = F.transform_keys(fields, lambda k, _v: F.try_url_decode(k))
    found = F.when(F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("application/json")), F.from_json(body, "map<string,string>")).otherwise(F.when(F.contains(body, F.lit("=")), form))
    return F.when(F.size(found) > 0, found)


def received(requests: DataFrame, key: str | None = None, limit: int | None = None, earlier: DataFrame | None = None) -> DataFrame:
    """Webhook requests (id, kind, address, us, api_key, content_type, body) as decoy events with the
    status that a receiver answers: 200, 400 (empty or unreadable), 401 (wrong key), 429 (too many).

    Requests of an address are limited as `limits.admitted` does. `earlier` (id, address, us) are requests
    of batches before that passed and count as such; `streaming.stateful.Receiver` keeps them.
    """
    from . import limits

    judged = requests.select(F.col("id").cast("string").alias("id"), "address", "us")
    if earlier is not None:  # under ids that no request has, before all others of their time
        judged = judged.unionByName(earlier.select(F.concat(F.lit("\u0000"), "id").alias("id"), "address", "us"))
    ok = limits.admitted(judged, "address", "us", "id", limit or limits.BY_ADDRESS[0], limits.BY_ADDRESS[1]).select(F.col("id").alias("_id"), "accepted")
    out = requests.join(ok, F.col("id").cast("string") == F.col("_id"), "left").withColumn("_p", parse_payload(F.col("body"), F.col("content_type")))
    wrong = F.lit(False) if key is None else ~F.col("api_key").eqNullSafe(key)
    status = F.when(~F.coalesce("accepted", F.lit(True)), 429).when(wrong, 401).when(F.col("_p").isNull(), 400).otherwise(200)
    event = F.when(F.col("kind") == "canarytoken", normalize_honeypot(F.col("_p"), "canarytoken")).otherwise(normalize_honeypot(F.col("_p"), "conpot"))
    return out.withColumn("status", status).withColumn("event", F.when(F.col("status") == 200, event)).drop("_id", "_p", "accepted")


def normalize_honeypot(payload: Column, kind: str) -> Column:
    """A decoy's raw payload (a map of strings) in the unified event schema; `kind`: canarytoken or conpot.

    The id is the first 16 digits of SHA-256 over the payload's sorted JSON; severity is fixed, as
    nothing benign touches a decoy.
    """
    first = lambda *names: F.coalesce(*[F.when(F.coalesce(payload[n], F.lit("")) != "", payload[n]) for n in names], F.lit("unknown"))
    sorted_json = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(payload))))
    ip = first("src_ip", "source_ip", "ip") if kind == "canarytoken" else first("src_ip", "source_ip")
    what = first("channel", "type") if kind == "canarytoken" else first("protocol", "data_type")
    text = F.concat(F.lit("Canarytoken triggered: "), what, F.lit(" token '"), F.coalesce(payload["memo"], F.lit("")), F.lit("' accessed from "), ip) if kind == "canarytoken" else F.concat(F.lit("OT/ICS honeypot interaction: "), what, F.lit(" from "), ip)
    return F.struct(
        F.substring(F.sha2(sorted_json, 256), 1, 16).alias("event_id"), payload["time" if kind == "canarytoken" else "timestamp"].alias("timestamp"), F.lit(kind).alias("source"),
        F.lit("honeypot" if kind == "canarytoken" else "honeypot_ot").alias("event_type"), F.lit("critical").alias("severity"), F.concat(F.lit("ip:"), ip).alias("entity_id"), what.alias("channel"), text.alias("description"), payload.alias("raw_payload"),
    )


def route(kind: Column, routes: dict[str, Column]) -> Column:
    """The adapter's column for a telemetry type; an unknown type is an error."""
    out = F.raise_error(F.concat(F.lit("unknown telemetry type "), F.coalesce(kind, F.lit("null")))).cast("string")
    for name, adapted in routes.items():
        out = F.when(kind == name, adapted).otherwise(out)
    return out


#: What an event without an entity is, by telemetry type (fixed values).
UNKNOWN = {"network": "unknown-host", "identity": "unknown-user"}


def adapt(df: DataFrame, kind: str) -> DataFrame:
    """Telemetry of a type as what its detector takes: entity_id, timestamp and features.

    `df`: entity_id and timestamp (or without them) and data, the features as they were computed; an
    event without data is an error.
    """
    there = set(df.columns)
    text = lambda name, default: F.coalesce(F.col(name).cast("string"), F.lit(default)) if name in there else F.lit(default)
    data = F.coalesce(F.col("data"), F.raise_error(F.lit("an event without data")))
    return df.select(text("entity_id", UNKNOWN.get(kind, "unknown")).alias("entity_id"), text("timestamp", "").alias("timestamp"), data.alias("features"))


def dispatch(df: DataFrame, detectors: dict[str, Callable[[DataFrame], DataFrame]], kind: str = "telemetry_type") -> DataFrame:
    """Each event to the detector of its type, as `adapt` gives it; all detectors' rows, which have the same columns.

    A type without a detector raises ValueError, before any detector runs.
    """
    known = F.coalesce(F.col(kind).isin(list(detectors)), F.lit(False))
    if unknown := df.filter(~known).select(kind).first():
        raise ValueError(f"unknown telemetry type: {unknown[0]}")
    return reduce(DataFrame.unionByName, [detect(adapt(df.filter(F.col(kind) == name), name)) for name, detect in detectors.items()])
