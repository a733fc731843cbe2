"""Streaming jobs replayed over the files of a table, to a memory sink or a table, then read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import streaming
from ..sinks import shared_dir
from ..sources.requests import stream_requests
from ..streaming import stateful
from .graph import evidence_rows
from .operations import webhook_requests
from .registry import ORACLES, events, query, table


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = table(spark, sf_dir, "events")
    return spark.readStream.schema(batch.schema).parquet(f"{sf_dir}/events.parquet*")


def _replay(out: DataFrame, mode: str, batch: DataFrame) -> DataFrame:
    """All available rows through the job; its result as a table in the shared folder."""
    root = f"{shared_dir(batch)}/stream-{uuid.uuid4().hex}"
    write = lambda rows, _id: rows.withColumn("_batch", F.lit(_id)).write.mode("append").parquet(f"{root}/out")
    q = out.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    return batch.sparkSession.read.schema(out.schema.add("_batch", "long")).parquet(f"{root}/out")


@query("SELECT epoch_us(date_trunc('day', ts)) AS start_us, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_replay_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts, streamed."""
    out = _replay(streaming.tumbling(_stream(spark, sf_dir), "ts", ["event_type"], "1 day", "40 days"), "update", table(spark, sf_dir, "events"))
    last = F.max_by("n", "_batch").alias("n"), F.max_by("total", "_batch").alias("total")
    return out.groupBy("start_us", "event_type").agg(*last).withColumn("total", F.round("total", 4))


@query("SELECT user_id, count(value) AS n, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std FROM events GROUP BY user_id")
def stream_replay_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's running baseline, streamed."""
    out = _replay(streaming.baselines(_stream(spark, sf_dir).select("user_id", "value"), "user_id", "value"), "update", table(spark, sf_dir, "events"))
    last = out.groupBy("user_id").agg(F.max_by(F.struct("n", "mean", "m2"), F.struct("_batch", "n")).alias("x")).select("user_id", "x.*")
    return last.select("user_id", "n", F.round("mean", 4).alias("mean"), F.round(F.sqrt(F.col("m2") / F.col("n")), 4).alias("std"))


def _in_files(df: DataFrame, files: int = 3) -> DataFrame:
    """A table as a stream of `files` micro-batches, its rows dealt by hash, so times come in any order."""
    path = f"{shared_dir(df)}/feed-{uuid.uuid4().hex}"
    df.repartition(files, F.xxhash64(*df.columns)).write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query(ORACLES["identity_user_hour_zscores"])
def stream_replay_behaviour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User-hours with scores against each user's history, streamed in several batches."""
    e = events(spark, sf_dir).select("user_id", "us", "k")
    out = _replay(stateful.behaviour(_in_files(e), "user_id", "us", "k", "400 days"), "update", e)
    names = [n for n in stateful.FIELDS if n not in ("window_id", "new_computers", "active_hours")]
    last = out.groupBy("user", "window_id").agg(F.max_by(F.struct(*names), "_batch").alias("x")).select("user", "window_id", "x.*")
    return last.withColumns({n: F.round(n, 4) for n in names if n.endswith("_zscore")})


def _graph_tables(spark: SparkSession, sf_dir: str) -> stateful.GraphTables:
    """Evidence streamed into a graph's tables, every batch of it twice, as after a failure."""
    rows = evidence_rows(spark, sf_dir)
    tables = stateful.GraphTables(spark, f"{shared_dir(rows)}/graph-{uuid.uuid4().hex}", every=2)

    def twice(batch: DataFrame, number: int) -> None:
        tables.add(batch, number)
        tables.add(batch, number)

    root = f"{shared_dir(rows)}/stream-{uuid.uuid4().hex}"
    _in_files(rows).writeStream.option("checkpointLocation", root).trigger(availableNow=True).foreachBatch(twice).start().awaitTermination()
    return tables


@query(ORACLES["graph_nodes"])
def stream_replay_graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes merged batch by batch."""
    n = _graph_tables(spark, sf_dir).nodes()
    return n.select("node_id", F.round("risk", 6).alias("risk"), "severity", "first_seen", "last_seen", "observations")


@query(ORACLES["graph_edges"])
def stream_replay_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges merged batch by batch."""
    return _graph_tables(spark, sf_dir).edges().select("src", "dst", "occurrence_count", "first_seen", "last_seen", "source_detector")


@query(ORACLES["decoy_webhooks"])
def stream_replay_webhooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Webhook requests from the files of a receiver, a batch for each of its two visits."""
    requests = webhook_requests(spark, sf_dir)
    root = f"{shared_dir(requests)}/stream-{uuid.uuid4().hex}"
    receiver = stateful.Receiver(spark, f"{root}/out", "secret")
    middle = requests.agg(F.expr("(min(us) + max(us)) div 2")).first()[0]
    for k, early in enumerate((F.col("us") <= middle, ~(F.col("us") <= middle))):
        requests.filter(early).write.json(f"{root}/written-{k}")
        _moved(spark, f"{root}/written-{k}", f"{root}/in", f"{k}-")
        stream_requests(spark, f"{root}/in").writeStream.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).foreachBatch(receiver.add).start().awaitTermination()
    return receiver.events().select(F.col("id").cast("long").alias("event_id"), "status", "event.entity_id", "event.channel")


def _moved(spark: SparkSession, source: str, target: str, prefix: str) -> None:
    """Moves a folder's data files, as a receiver does with those that are whole."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path(source).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path(target))
    for status in files.globStatus(path(f"{source}/part-*")):
        files.rename(status.getPath(), path(f"{target}/{prefix}{status.getPath().getName()}"))


_TTL = 6 * 3_600_000_000


@query(f"""WITH RECURSIVE o AS (SELECT event_type, user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts) AS p FROM events),
w AS (SELECT event_type, user_id, us, p, us AS start, true AS first FROM o WHERE p = 1
 UNION ALL SELECT o.event_type, o.user_id, o.us, o.p, CASE WHEN o.us - w.start > {_TTL} THEN o.us ELSE w.start END, o.us - w.start > {_TTL} FROM w JOIN o ON o.event_type = w.event_type AND o.user_id = w.user_id AND o.p = w.p + 1)
SELECT event_type, count(*) AS kept FROM w WHERE first GROUP BY event_type""")
def stream_replay_ttl_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First copies within a time to live, streamed."""
    s = _stream(spark, sf_dir).select(F.concat_ws("|", "event_type", "user_id").alias("key"), "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return _replay(streaming.ttl_dedup(s, "key", "us", _TTL), "append", table(spark, sf_dir, "events")).groupBy("event_type").agg(F.count("*").alias("kept"))


@query("""WITH g AS (SELECT user_id, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 3600000000 THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, us, sum(new) OVER (PARTITION BY user_id ORDER BY us) AS s FROM g) SELECT min(us) AS start_us, max(us) + 3600000000 AS end_us, user_id, count(*) AS n FROM s GROUP BY user_id, s""")
def stream_batch_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with an hour's gap (the same transformation on a batch)."""
    return streaming.sessions(table(spark, sf_dir, "events"), "ts", ["user_id"], "1 hour", "40 days")


@query("SELECT epoch_us(w) AS start_us, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01'), time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') - INTERVAL 6 HOUR]) AS w FROM events) GROUP BY 1, 2")
def stream_batch_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of twelve hours, one every six (the same transformation on a batch)."""
    return streaming.sliding(table(spark, sf_dir, "events"), "ts", ["event_type"], "12 hours", "6 hours", "40 days")
