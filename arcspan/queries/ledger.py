"""Queries on the ledger: conversations are incidents, their turns entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ledger as op
from .registry import query, table

_CHAIN = f"""o AS (SELECT conv_id, turn, role || ':' || coalesce(text, '') AS p, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role || ':' || coalesce(text, '')) AS i FROM conversations),
c AS (SELECT conv_id, turn, i, sha256('{op.GENESIS}' || p) AS hash, '{op.GENESIS}' AS prev_hash FROM o WHERE i = 1 UNION ALL SELECT o.conv_id, o.turn, o.i, sha256(c.hash || o.p), c.hash FROM c JOIN o ON o.conv_id = c.conv_id AND o.i = c.i + 1)"""


def _chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = F.concat("role", F.lit(":"), F.coalesce("text", F.lit("")))
    return op.chain(table(spark, sf_dir, "conversations"), "conv_id", "turn", payload)


@query(f"WITH RECURSIVE {_CHAIN} SELECT conv_id, turn, prev_hash, hash FROM c")
def ledger_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash chains of all incidents."""
    return _chain(spark, sf_dir).select("conv_id", "turn", "prev_hash", "hash")


@query("SELECT conv_id, count(*) AS entries, count(*) FILTER (WHERE turn = 1 AND conv_id % 10 = 0) AS broken FROM conversations GROUP BY conv_id")
def ledger_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains checked, some of them tampered with: a changed payload breaks its own hash."""
    c = _chain(spark, sf_dir)
    tampered = c.withColumn("payload", F.when((F.col("conv_id") % 10 == 0) & (F.col("turn") == 1), F.concat("payload", F.lit("!"))).otherwise(F.col("payload")))
    return op.verify(tampered, "conv_id", "turn").groupBy("conv_id").agg(F.count("*").alias("entries"), F.count_if(~F.col("ok")).alias("broken"))


@query("SELECT conv_id, arg_min(role, turn) AS first_event, arg_max(CASE WHEN turn % 3 = 0 THEN 'ACTIVE' END, turn) FILTER (WHERE turn % 3 = 0) AS status, arg_max(length(text) / 1000, turn) AS score, max(turn) AS last_seen, count(*) AS entries FROM conversations GROUP BY conv_id")
def ledger_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents read from the ledger."""
    c = table(spark, sf_dir, "conversations").withColumns({"s": F.when(F.col("turn") % 3 == 0, "ACTIVE"), "x": F.length("text") / 1000})
    return op.incidents(c, "conv_id", "turn", "role", "s", "x")


@query("SELECT conv_id, bool_or(role = 'user') AS has_detect, bool_or(role = 'assistant') AS has_respond, bool_or(turn >= 3) AS has_verify FROM conversations GROUP BY conv_id")
def ledger_traceability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each incident's entries cover."""
    c = table(spark, sf_dir, "conversations")
    kinds = c.select("conv_id", "role").union(c.filter("turn >= 3").select("conv_id", F.lit("late")))
    out = op.traceability(kinds, "conv_id", "role", {"detect": ["user"], "respond": ["assistant"], "verify": ["late"]})
    return out.drop("coverage")


@query("SELECT conv_id FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 3 != 0) UNION SELECT conv_id FROM conversations")
def ledger_graph_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents of ledger and graph, each once."""
    c = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    return op.missing_from(c, c.filter("conv_id % 3 != 0"), "conv_id")


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1")
def ledger_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest row of each key of an append log."""
    from ..sinks import latest

    return latest(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id"], ["turn"])
