"""A hash-chained ledger: appending, verifying, and reading incidents from it.

Chains are per key (an incident), so they are built and checked in parallel; a single chain is the
case of one constant key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship

GENESIS = "0" * 64


def chain(df: DataFrame, key: str, order: str, payload: Column) -> DataFrame:
    """Rows key, order, payload, prev_hash and hash: SHA-256 of the previous hash and the payload.

    Each hash needs the one before, so a chain is a fold: Spark sorts the entries, a stream of batches
    passes, and one hash is held, however long a chain is. Entries of one place go by payload; a null
    payload counts as empty.
    """
    ship(df.sparkSession)
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, GENESIS
        for batch in batches:
            before, after = [], []
            for k, p in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist()):
                if k != now:
                    now, last = k, GENESIS
                before.append(last)
                last = hashlib.sha256((last + p).encode("utf-8", "surrogatepass")).hexdigest()
                after.append(last)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(before, pa.string()), pa.array(after, pa.string())], [key, order, "payload", "prev_hash", "hash"])

    rows = df.select(key, order, F.coalesce(payload, F.lit("")).alias("payload"), F.to_json(F.struct(key), {"ignoreNullFields": "false"}).alias("_k"))
    ordered = rows.repartition("_k").sortWithinPartitions("_k", order, "payload")
    return ordered.mapInArrow(run, f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, payload string, prev_hash string, hash string")


def verify(df: DataFrame, key: str, order: str) -> DataFrame:
    """`df` (payload, prev_hash, hash) with ok: the hash is right and follows the one before."""
    before = F.lag("hash", 1, GENESIS).over(Window.partitionBy(key).orderBy(order))
    right = F.sha2(F.concat("prev_hash", "payload"), 256) == F.col("hash")
    return df.withColumn("ok", right & (F.col("prev_hash") == before))


def canonical(data: object) -> str:
    """JSON with sorted keys, compact, ASCII only: what a ledger entry's hash is taken of."""
    import json

    return json.dumps(data, sort_keys=True, separators=(",", ":"), ensure_ascii=True)


def incidents(df: DataFrame, incident: str, order: str, kind: str, status: str, score: str) -> DataFrame:
    """One row per incident: the first entry's kind, the last known status and score, last time."""
    at = F.col(order)
    last = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), at))
    return df.groupBy(incident).agg(F.min_by(kind, at).alias("first_event"), last(status).alias("status"), last(score).alias("score"), F.max(at).alias("last_seen"), F.count("*").alias("entries"))


def traceability(df: DataFrame, incident: str, kind: str, wanted: dict[str, list[str]]) -> DataFrame:
    """Which stages each incident's entries cover, and the share of all stages; a stage is covered by
    any of its kinds."""
    out = df.groupBy(incident).agg(*[F.bool_or(F.col(kind).isin(kinds)).alias(f"has_{stage}") for stage, kinds in wanted.items()])
    return out.withColumn("coverage", sum(F.col(f"has_{s}").cast("int") for s in wanted) / len(wanted))


def missing_from(graph_incidents: DataFrame, ledger_incidents: DataFrame, id: str) -> DataFrame:
    """Ledger incidents and those of the graph that the ledger lacks."""
    return ledger_incidents.select(id).unionByName(graph_incidents.join(ledger_incidents, id, "left_anti").select(id))
