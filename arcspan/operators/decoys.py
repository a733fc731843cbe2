"""Decoys' life cycle as an append-only log: deployed, touched, expired; no file is written.

A decoy's state is the fold of its log: expiry ends an active decoy only, a touch marks it for good.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Minutes that a decoy is watched, and file endings by kind (fixed values).
WINDOW_MINUTES = 30
ENDINGS = {"smb_share": "share.txt", "credential": "credentials.txt", "database": "backup.sql", "ot_config": "config.ini"}


def deploy(requests: DataFrame) -> DataFrame:
    """Log rows of new decoys (incident_id, decoy_type, placement_node, us): an id by their content, of 128 bits,
    as two of a million decoys would share one of 32.

    Missing kinds are a share on the database server, as the ledger expects them.
    """
    kind, node = F.coalesce("decoy_type", F.lit("smb_share")), F.coalesce("placement_node", F.lit("db_server"))
    incident = F.coalesce(F.col("incident_id").cast("string"), F.lit("UNKNOWN"))
    id = F.concat(F.lit("DECOY-"), F.upper(F.substring(F.sha2(F.concat_ws("|", incident, kind, node, F.col("us").cast("string")), 256), 1, 32)))
    slug = F.regexp_replace(F.lower(F.trim(node)), " ", "_")
    ending = F.lit("notes.txt")
    for k, e in ENDINGS.items():
        ending = F.when(kind == k, e).otherwise(ending)
    return requests.select(
        id.alias("decoy_id"), kind.alias("decoy_type"), node.alias("placement_node"), incident.alias("incident_id"), F.concat(slug, F.lit("_"), ending).alias("target_path"),
        F.lit(WINDOW_MINUTES).alias("observation_window_minutes"), F.lit("deployed").alias("event"), F.col("us").cast("long").alias("us"),
    )


def events(log: DataFrame, ids: DataFrame, event: str) -> DataFrame:
    """Log rows that mark decoys (decoy_id, us) as `touched` or `expired`; unknown ids give none."""
    known = log.filter("event = 'deployed'").drop("us", "event").dropDuplicates(["decoy_id"])
    return known.join(ids.select("decoy_id", F.col("us").cast("long").alias("us")), "decoy_id").withColumn("event", F.lit(event)).select(log.columns)


def states(log: DataFrame) -> DataFrame:
    """Each decoy's status and times: touched if ever touched, else expired if it expired, else active."""
    first = lambda e: F.min(F.when(F.col("event") == e, F.col("us")))
    keep = ["decoy_type", "placement_node", "incident_id", "target_path", "observation_window_minutes"]
    out = log.groupBy("decoy_id").agg(*[F.first(c).alias(c) for c in keep], first("deployed").alias("deployed_us"), first("touched").alias("touched_us"), first("expired").alias("expired_us"))
    return out.withColumn("status", status(F.col("touched_us"), F.col("expired_us")))


def status(touched: Column, expired: Column) -> Column:
    """A touch makes a decoy touched, also after its expiry; an expiry ends active ones."""
    return F.when(touched.isNotNull(), "touched").when(expired.isNotNull(), "expired").otherwise("active")


def active(log: DataFrame) -> DataFrame:
    """Decoys that are neither touched nor expired."""
    return states(log).filter("status = 'active'")


def due(log: DataFrame, now_us: Column) -> DataFrame:
    """Active decoys (decoy_id, us) whose window has ended: what `events(..., "expired")` takes."""
    end = F.col("deployed_us") + F.col("observation_window_minutes") * 60_000_000
    return active(log).filter(end <= now_us).select("decoy_id", now_us.cast("long").alias("us"))
