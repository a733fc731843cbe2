"""Structured Streaming: windowed counts, stateful baselines, exact TTL dedup, fan-out, ingest.

Every job is a plain transformation of a streaming DataFrame; sources and sinks are the caller's.
Event time needs a timestamp with a zone, so `timestamp_ntz` columns are cast first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import evidence
from ..session import ship


def tumbling(df: DataFrame, time: str, keys: list[str], width: str, late: str) -> DataFrame:
    """Counts and sums by event-time window; rows later than `late` are dropped by the watermark."""
    t = F.col(time).cast("timestamp")
    out = df.withColumn("_t", t).withWatermark("_t", late).groupBy(F.window("_t", width).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.unix_micros("w.start").alias("start_us"), *keys, "n", "total")


def sliding(df: DataFrame, time: str, keys: list[str], width: str, step: str, late: str) -> DataFrame:
    """Counts by overlapping event-time windows."""
    out = df.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late).groupBy(F.window("_t", width, step).alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(F.unix_micros("w.start").alias("start_us"), *keys, "n")


def sessions(df: DataFrame, time: str, keys: list[str], gap: str, late: str) -> DataFrame:
    """Counts by session."""
    out = df.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late).groupBy(F.session_window("_t", gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), *keys, "n")


def baselines(df: DataFrame, key: str, value: str, idle_ms: int | None = None) -> DataFrame:
    """Running count, mean and sum of squared deviations of each key (Welford, merged by batch).

    With `idle_ms` a key that had no rows for so long is forgotten; without it state is kept, as a
    baseline is meant to last.
    """
    ship(df.sparkSession)
    kept = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, mean, m2 = state.get if state.exists else (0, 0.0, 0.0)
        for frame in frames:
            x = frame[value].dropna()
            if len(x):
                a, b = float(x.mean()), float(((x - x.mean()) ** 2).sum())
                away, total = a - mean, n + len(x)
                m2 += b + away * away * n * len(x) / total
                mean += away * len(x) / total
                n = total
        state.update((n, mean, m2))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({key: [k[0]], "n": [n], "mean": [mean], "m2": [m2]})

    kind = dict(df.dtypes)[key]
    return df.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, n long, mean double, m2 double", "n long, mean double, m2 double", "update", kept)


#: Groups that the keys of a TTL dedup are dealt into; each is one value of the state.
BUCKETS = 1 << 12


def ttl_dedup(df: DataFrame, key: str, us: str, ttl_us: int = evidence.TTL_US, late: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """First copies only: a copy within the time to live of the key's last first copy is dropped, and
    does not renew it. A row older than that first copy has none before it and is kept.

    State is one time per key, and the keys of a bucket (by hash) are one value: a call for each key costs far more
    than its rows. A key is removed when the watermark (`late` behind the latest row) has passed the time to
    live, by a timer in event time or with the bucket's next rows, so state is bounded by the keys of that span.
    A micro-batch rewrites the buckets that it has rows of; many small ones over many keys want more buckets.
    """
    ship(df.sparkSession)
    names, kinds = df.columns, dict(df.dtypes)

    def keep(_k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {k: (t, until) for k, t, until in zip(*state.get)} if state.exists else {}
        now, found = state.getCurrentWatermarkMs(), None
        if not state.hasTimedOut:
            found = pd.concat(list(frames)).sort_values(us, kind="stable")
            keys, out = found["_key"].tolist(), []
            for place, (k, t) in enumerate(zip(keys, found[us].tolist())):
                anchor = held[k][0] if k in held else None
                if anchor is None or t - anchor > ttl_us or t < anchor:
                    held[k] = (t if anchor is None else max(anchor, t), 0)
                    out.append(place)
            for k in set(keys):
                held[k] = (int(held[k][0]), max((int(held[k][0]) + ttl_us) // 1000 + 1, now + 1))
        held = {k: v for k, v in held.items() if v[1] >= now}
        if held:
            state.update((list(held), [t for t, _ in held.values()], [until for _, until in held.values()]))
            state.setTimeoutTimestamp(max(min(until for _, until in held.values()), now))
        else:
            state.remove()
        if found is not None:
            yield found.iloc[out][names]

    schema = ", ".join(f"`{n}` {kinds[n]}" for n in names)
    text = F.col(key) if kinds[key] == "string" else F.to_json(F.struct(key))
    timed = df.withColumns({"_event_time": F.timestamp_micros(us), "_key": text, "_bucket": F.pmod(F.xxhash64(text), F.lit(buckets))}).withWatermark("_event_time", late)
    return timed.groupBy("_bucket").applyInPandasWithState(keep, schema, "keys array<string>, anchors array<long>, deadlines array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def approximate_dedup(df: DataFrame, time: str, keys: list[str], ttl: str) -> DataFrame:
    """First copies by the built-in operator: by event time and watermark, so an approximation."""
    return df.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", ttl).dropDuplicatesWithinWatermark(keys).drop("_t")


def ingest(df: DataFrame, us: str | None = None, ttl_us: int = evidence.TTL_US, late: str = "10 minutes") -> DataFrame:
    """Evidence as it comes: valid rows in their normal form with a priority and a hash; with `us` first
    copies only, wrapped as events."""
    good = df.withColumn("errors", evidence.errors()).filter(F.size("errors") == 0).drop("errors")
    out = evidence.evidence_hash(evidence.normalize(good))
    if us is None:
        return out.withColumn("priority", evidence.severity_order(F.col("severity")))
    return evidence.wrap(ttl_dedup(out, "hash", us, ttl_us, late).drop("hash"), F.current_timestamp())


def latency(events: DataFrame, wrapped: str, now: Column) -> DataFrame:
    """How many events there are and the mean and largest time since they were wrapped, in milliseconds."""
    ms = (F.unix_micros(now) - F.unix_micros(wrapped)) / 1000.0
    return events.agg(F.count("*").alias("events_published"), F.avg(ms).alias("average_latency"), F.max(ms).alias("largest_latency"))


def counters(query: StreamingQuery) -> dict[str, float]:
    """A query's own measures so far: batches, rows, rows a second, mean duration of a batch in ms, and
    rows that its stateful operators hold or dropped as late."""
    seen = [p for p in query.recentProgress if p is not None]
    state = [s for p in seen[-1:] for s in p["stateOperators"]]
    durations = [p["durationMs"].get("triggerExecution", 0) for p in seen]
    return {
        "batches": len(seen), "rows": sum(p["numInputRows"] for p in seen), "rows_per_second": float(seen[-1]["processedRowsPerSecond"] or 0.0) if seen else 0.0,
        "average_ms": sum(durations) / len(durations) if durations else 0.0, "state_rows": sum(s["numRowsTotal"] for s in state), "late_rows": sum(s.get("numRowsDroppedByWatermark", 0) for s in state),
    }


def fan_out(subscribers: dict[str, tuple[object, Callable[[DataFrame], None]]], failed: Callable[[str, Exception], None]) -> Callable[[DataFrame, int], None]:
    """A `foreachBatch` function that gives each subscriber its filtered rows; a failing one is reported
    and does not keep the others from theirs. The batch is persisted for them."""

    def each(batch: DataFrame, _id: int) -> None:
        batch.persist()
        try:
            for name, (condition, receive) in subscribers.items():
                try:
                    receive(batch.filter(condition))
                except Exception as e:  # isolated by contract
                    failed(name, e)
        finally:
            batch.unpersist()

    return each
