"""Queries on endpoint operators; event types stand for the kinds of endpoint events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import endpoint as op
from ..operators import sigma
from .registry import EVENTS_SQL, events, query

HOUR = 3_600_000_000
_WINDOWS = f"""WITH RECURSIVE {EVENTS_SQL},
o AS (SELECT user_id, event_type, us, event_id, k, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY us, event_id) AS p FROM e),
w AS (SELECT user_id, event_type, us, event_id, k, value, p, 0 AS i, us AS start FROM o WHERE p = 1
  UNION ALL SELECT o.user_id, o.event_type, o.us, o.event_id, o.k, o.value, o.p, CASE WHEN o.us - w.start > {24 * HOUR} THEN w.i + 1 ELSE w.i END, CASE WHEN o.us - w.start > {24 * HOUR} THEN o.us ELSE w.start END
  FROM w JOIN o ON o.user_id = w.user_id AND o.event_type = w.event_type AND o.p = w.p + 1)"""
KEYS = ["user_id", "event_type"]


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.anchored_windows(events(spark, sf_dir), KEYS, "us", 24 * HOUR)


@query(f"{_WINDOWS} SELECT user_id, event_type, i AS window_index, arg_min(k, (us, event_id)) AS parent, min(us) AS window_start, max(us) AS window_end, count(*) AS event_count FROM w GROUP BY 1, 2, 3")
def endpoint_anchored_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows anchored at their first event."""
    out = op.describe_windows(_windows(spark, sf_dir), KEYS, "us", "event_id", "k")
    return out.withColumnRenamed("parent_process", "parent")


def _telemetry(df: DataFrame) -> DataFrame:
    kinds = F.create_map(*[F.lit(x) for kv in {"click": "1", "view": "3", "signup": "7", "purchase": "10", "error": "13"}.items() for x in kv])
    k = F.col("k").cast("string")
    return df.withColumns({
        "event_id_s": kinds[F.col("event_type")], "process_name": F.concat(F.lit("p"), (F.col("user_id") % 7).cast("string"), F.lit(".exe")),
        "parent_process_name": F.when(F.col("user_id") % 3 == 0, "explorer.exe"), "command_line": F.when(F.col("k") % 2 == 0, F.concat(F.lit("run -enc "), k)),
        "destination_ip": k, "destination_port": F.col("k"), "image_loaded": F.concat(F.lit("C:\\Temp\\"), k), "granted_access": F.lpad(k, 4, "0"), "target_process": F.when(F.col("k") > 50, "lsass.exe"),
        "integrity_level": (F.col("k") % 2).cast("string"), "user": F.col("user_id").cast("string"),
    }).drop("event_id").withColumnRenamed("event_id_s", "event_id")


_FEATURES = f"""WITH {EVENTS_SQL}, t AS (SELECT *, us // {24 * HOUR} AS day FROM e),
f AS (SELECT user_id, day, count(*)::DOUBLE AS event_count,
 count(*) FILTER (WHERE event_type = 'click')::DOUBLE AS child_process_count, count(DISTINCT CASE WHEN event_type = 'click' THEN user_id % 7 END)::DOUBLE AS unique_child_processes,
 count(*) FILTER (WHERE event_type = 'view')::DOUBLE AS network_connection_count, count(DISTINCT CASE WHEN event_type = 'view' THEN k END)::DOUBLE AS unique_destination_count,
 count(*) FILTER (WHERE event_type = 'error')::DOUBLE AS registry_modification_count, count(*) FILTER (WHERE event_type = 'signup')::DOUBLE AS rare_image_load_count,
 count(*) FILTER (WHERE event_type = 'purchase' AND k > 50)::DOUBLE AS lsass_access_count,
 (count(DISTINCT k % 2) > 1)::INT::DOUBLE AS integrity_level_change, arg_min(CASE WHEN k % 2 = 0 THEN 'run -enc ' || k END, us) FILTER (WHERE k % 2 = 0) AS command,
 CASE WHEN user_id % 3 = 0 THEN 2 ELSE 1 END::DOUBLE AS process_depth FROM t GROUP BY user_id, day)
SELECT user_id, day, event_count, child_process_count, unique_child_processes, network_connection_count, unique_destination_count, registry_modification_count, rare_image_load_count, lsass_access_count, integrity_level_change, process_depth,
 coalesce(length(command), 0)::DOUBLE AS command_length, CASE WHEN command IS NULL THEN 0 ELSE 3 END::DOUBLE AS command_token_count, CASE WHEN command IS NULL THEN 0 ELSE 1 END::DOUBLE AS encoded_command_flag FROM f"""


@query(_FEATURES)
def endpoint_window_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of each user's day of endpoint events."""
    days = _telemetry(events(spark, sf_dir)).withColumn("day", F.floor(F.col("us") / (24 * HOUR)))
    out = op.window_features(days, ["user_id", "day"], F.col("us"))
    return out.select("user_id", "day", "event_count", "child_process_count", "unique_child_processes", "network_connection_count", "unique_destination_count", "registry_modification_count", "rare_image_load_count", "lsass_access_count", "integrity_level_change", "process_depth", "command_length", "command_token_count", "encoded_command_flag")


@query(f"""WITH f AS ({_FEATURES}) SELECT user_id, day, CASE WHEN encoded_command_flag > 0 OR lsass_access_count > 0 OR rare_image_load_count > 0 THEN 1 ELSE 0 END AS label FROM f""")
def endpoint_heuristic_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that look malicious."""
    days = _telemetry(events(spark, sf_dir)).withColumn("day", F.floor(F.col("us") / (24 * HOUR)))
    return op.window_features(days, ["user_id", "day"], F.col("us")).select("user_id", "day", op.heuristic_label().alias("label"))


@query("""WITH s AS (SELECT event_id, value / max(value) OVER () AS s, event_type IN ('error', 'purchase') AS strong, event_type != 'click' AS rules FROM events)
SELECT event_id, CASE WHEN s >= 0.75 THEN CASE WHEN strong THEN greatest(s, 0.95) ELSE s END WHEN strong THEN 0.8 WHEN rules THEN greatest(s, 0.5) ELSE s END::DOUBLE AS risk_score,
CASE WHEN s >= 0.75 THEN CASE WHEN strong THEN 'critical' WHEN s >= 0.85 THEN 'high' ELSE 'medium' END WHEN strong THEN 'medium' ELSE 'low' END AS severity,
CASE WHEN s >= 0.75 THEN CASE WHEN strong THEN 0.95 ELSE 0.75 END WHEN strong THEN 0.8 WHEN rules THEN 0.6 ELSE 0.5 END::DOUBLE AS confidence FROM s""")
def endpoint_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model scores and rule severities fused."""
    e = events(spark, sf_dir)
    top = e.agg(F.max("value").alias("top"))
    severity = F.when(F.col("event_type").isin("error", "purchase"), F.array(F.lit("high"))).when(F.col("event_type") != "click", F.array(F.lit("low"))).otherwise(F.array().cast("array<string>"))
    return e.join(F.broadcast(top)).select("event_id", op.fuse(F.col("value") / F.col("top"), severity).alias("x")).select("event_id", "x.*")


RULES = """
title: Failed action with large number
id: R1
level: high
tags: [attack.t1110]
detection:
  selection:
    type: [error, Purchase]
    props|contains: '"k": 9'
  condition: selection
---
title: Sign-up or view, but not small
id: R2
level: medium
detection:
  selection:
    type|startswith: [sign, vi]
  filter:
    props|endswith: '1}'
  condition: selection and not filter
---
title: Any of two
id: R3
level: critical
detection:
  sel_a: {type: click}
  sel_b: {props|contains: '7'}
  condition: any of sel_*
---
title: Broken
detection: [
"""
_MATCH = """e AS (SELECT event_id, user_id, ts, event_type, props, [x FOR x IN [CASE WHEN event_type IN ('error', 'purchase') AND contains(props, '"k": 9') THEN 'R1' END,
 CASE WHEN (starts_with(event_type, 'sign') OR starts_with(event_type, 'vi')) AND NOT ends_with(props, '1}') THEN 'R2' END, CASE WHEN event_type = 'click' OR contains(props, '7') THEN 'R3' END] IF x IS NOT NULL] AS rules FROM events)"""


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = RULES.rsplit("---", 1)[0]  # the last document is malformed
    get = {"type": F.col("event_type"), "props": F.col("props")}
    return sigma.match(events(spark, sf_dir), sigma.parse_rules(text), lambda name: get.get(name, F.lit(None).cast("string")))


@query(f"WITH {_MATCH} SELECT event_id, rules FROM e WHERE len(rules) > 0")
def sigma_match_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and the rules that they match."""
    out = _matched(spark, sf_dir).select("event_id", F.transform("matches", lambda m: m["rule_id"]).alias("rules"))
    return out.filter(F.size("rules") > 0)


@query(f"WITH {_MATCH}, x AS (SELECT user_id, unnest(rules) AS rule_id FROM e) SELECT user_id, rule_id, CASE rule_id WHEN 'R1' THEN 'high' WHEN 'R2' THEN 'medium' ELSE 'critical' END AS severity, CASE rule_id WHEN 'R1' THEN 0.85 ELSE 0.6 END::DOUBLE AS confidence, count(*) AS hits FROM x GROUP BY 1, 2")
def sigma_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's matches, once for every rule."""
    return sigma.dedup(_matched(spark, sf_dir), ["user_id"], F.struct("us", "event_id"))


@query("SELECT event_type AS provider, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, provider LIMIT 3")
def endpoint_provider_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent providers."""
    return op.provider_counts(events(spark, sf_dir), "event_type", 3)


@query("SELECT f AS field, s AS share, CASE WHEN s >= 0.8 THEN 'available' WHEN s >= 0.2 THEN 'partial' ELSE 'unavailable' END AS rating FROM (SELECT unnest(['event_id', 'odd', 'few']) AS f, unnest([avg(CASE WHEN event_id IS NOT NULL THEN 1.0 ELSE 0 END), avg(CASE WHEN event_id % 2 = 1 THEN 1.0 ELSE 0 END), avg(CASE WHEN event_id % 10 = 1 THEN 1.0 ELSE 0 END)]) AS s FROM events)")
def endpoint_field_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each field there is."""
    e = events(spark, sf_dir).select("event_id", F.when(F.col("event_id") % 2 == 1, 1).alias("odd"), F.when(F.col("event_id") % 10 == 1, 1).alias("few"))
    return op.field_availability(e)


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'missing_timestamp' WHEN event_id % 7 = 0 THEN 'missing_host' END AS reason, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'cmd.exe' END AS process_name, CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 THEN NULL ELSE 1 END::INT AS good FROM events")
def endpoint_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw records with aliased keys brought to canonical fields; a reason where they are discarded."""
    i = F.col("event_id")
    pairs = F.array(
        F.struct(F.lit("UtcTime").alias("k"), F.when(i % 5 == 0, F.lit(None)).otherwise(F.col("ts").cast("string")).alias("v")),
        F.struct(F.lit("Computer").alias("k"), F.when(i % 7 == 0, F.lit("")).otherwise(F.lit("h")).alias("v")),
        F.struct(F.when(i % 3 == 0, F.lit("process.name")).otherwise(F.lit("Image")).alias("k"), F.when(i % 3 == 0, F.lit(None)).otherwise(F.lit("C:\\Windows\\cmd.exe")).alias("v")),
        F.struct(F.lit("EventID").alias("k"), F.lit("1").alias("v")),
    )
    out = op.normalize(events(spark, sf_dir).select(i.alias("id"), F.map_from_entries(pairs).alias("record")))
    return out.select(F.col("id").alias("event_id"), "reason", "process_name", F.when(F.col("reason").isNull(), 1).alias("good"))
