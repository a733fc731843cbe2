"""State that lasts across micro-batches: seen-sets and histories by key, graph tables and address limits by batch.

`behaviour` keeps its state in Spark's state store (a value a user, and timers, of `transformWithState`);
`GraphTables` keeps a graph as tables in a folder, to which each micro-batch adds what it saw; `Receiver` the
requests that count against an address's limit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import evidence, graph, limits
from ..operators.identity import CLIP, HOUR_US, LEAST_HISTORY, LEAST_STD
from ..session import ship
from ..sinks import spool, unspool

#: What each user-hour tells; the same columns as those of `identity.user_hours` and `identity.zscores`.
FIELDS = {
    "window_id": "long", "auth_count": "long", "unique_computers": "long", "new_computers": "long", "active_hours": "double", "mean_gap": "double", "min_gap": "double",
    "max_gap": "double", "fanout_rate": "double", "new_computer_ratio": "double", "hour": "int", "off_hours": "int",
    "auth_count_zscore": "double", "unique_computers_zscore": "double", "fanout_rate_zscore": "double", "mean_auth_gap_zscore": "double",
}


def against_history(values: list[float | None]) -> list[float]:
    """Each value's deviation from those before it, as `identity.zscores` has it; nulls don't count.

    By running sums of the values less the first one, so that nothing large cancels.
    """
    x = np.array([np.nan if v is None else v for v in values], np.float64)
    there = ~np.isnan(x)
    if there.sum() <= LEAST_HISTORY:
        return [0.0] * len(x)
    y = np.where(there, x - x[there][0], 0.0)
    before = lambda v: np.concatenate([[0.0], np.cumsum(v)[:-1]])
    n = np.maximum(before(there), 1)
    mean = before(y) / n
    std = np.sqrt(np.maximum(before(y * y) / n - mean * mean, 0.0))
    good = there & (before(there) >= LEAST_HISTORY) & (std >= LEAST_STD)
    return np.where(good, np.clip((y - mean) / np.where(good, std, 1.0), -CLIP, CLIP), 0.0).tolist()


class _Behaviour(StatefulProcessor):
    """One user's computers (with the hour each was first reached) and hours, read and written as one value."""

    #: What an hour came to, a list for each over the user's hours; an hour that may still get rows keeps its times and computers.
    KEPT = ("n", "first", "last", "least", "most", "unique", "new", "times", "computers")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        kinds = ["array<long>"] * 3 + ["array<double>"] * 2 + ["array<long>"] * 2 + ["array<array<long>>", "array<array<string>>"]
        hours = ", ".join(f"{n} {k}" for n, k in zip(self.KEPT, kinds))
        self.state = handle.getValueState("history", f"hour array<long>, {hours}, computer array<string>, reached array<long>, timer long")

    def _read(self) -> tuple[dict[int, list], dict[str, int], int | None]:
        """Hours, computers, and when the next hour is to be closed."""
        held = self.state.get() if self.state.exists() else None
        if held is None:
            return {}, {}, None
        hour, *facts, computer, reached, timer = held
        return dict(zip(map(int, hour), map(list, zip(*facts)))), dict(zip(computer, map(int, reached))), timer

    def _write(self, known: dict[int, list], reached: dict[str, int], timer: int | None) -> None:
        """Keeps the state; one timer is for the earliest hour that is open."""
        ends = [(h + 1) * (HOUR_US // 1000) for h, v in known.items() if v[7] is not None]
        if ends and (timer is None or min(ends) < timer):
            timer = min(ends)
            self.handle.registerTimer(timer)
        self.state.update((list(known), *map(list, zip(*known.values())), list(reached), list(reached.values()), timer))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        changed: dict[int, tuple[list[int], set[str]]] = {}
        for frame in rows:
            for hour, us, computer in zip(frame["hour"].tolist(), frame["us"].tolist(), frame["computer"].tolist()):
                times, computers = changed.setdefault(hour, ([], set()))
                times.append(us)
                if isinstance(computer, str):
                    computers.add(computer)
        known, reached, timer = self._read()
        dirty: set[int] = set()
        for hour, (times, computers) in changed.items():
            if hour in known and known[hour][7] is None:
                continue  # closed by the watermark: these rows came too late
            old = known.get(hour)
            all_times, all_computers = sorted(times + list(old[7] if old else [])), sorted(computers | set(old[8] if old else []))
            gaps = [(b - a) / 1e6 for a, b in zip(all_times, all_times[1:])] or [0.0]
            known[hour] = [len(all_times), all_times[0], all_times[-1], min(gaps), max(gaps), len(all_computers), 0, all_times, all_computers]
            dirty.add(hour)
            for computer in computers:
                first = reached.get(computer)
                if first is None or hour < first:
                    reached[computer] = hour
                    if first is not None:
                        dirty.add(first)
        if not dirty:
            return
        for hour in dirty:
            state = known[hour]
            if state[8] is not None:
                state[6] = sum(reached[c] == hour for c in state[8])
            else:  # closed, and one of its new computers was reached earlier after all
                state[6] -= 1
        self._write(known, reached, timer)
        yield self._told(key, known, min(dirty))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known, reached, timer = self._read()
        past = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        for hour, state in known.items():
            if (hour + 1) * (HOUR_US // 1000) <= past:
                state[7] = state[8] = None
        if known:
            self._write(known, reached, None if timer is None or timer <= past else timer)
        return iter(())

    def _told(self, key, known: dict[int, list], since: int) -> pd.DataFrame:
        """The hours from `since` on; later ones have it in their history."""
        hours = sorted(known)
        n, first, last, least, most, unique, new = (np.array([known[h][i] for h in hours]) for i in range(7))
        active = (last - first) / HOUR_US
        gap = np.where(n > 1, (last - first) / np.maximum(n - 1, 1) / 1e6, 0.0)
        fan = unique / np.maximum(active, 0.001)
        clock = np.array(hours) % 24
        z = [against_history(v) for v in (n.astype(float).tolist(), unique.astype(float).tolist(), fan.tolist(), [g if k >= 2 else None for g, k in zip(gap.tolist(), n)])]
        out = pd.DataFrame(dict(zip(FIELDS, [hours, n, unique, new, active, gap, least, most, fan, np.where(unique > 0, new / np.maximum(unique, 1), 0.0), clock, ((clock < 8) | (clock > 20)).astype(int), *z])))
        out.insert(0, "user", key[0])
        return out[out["window_id"] >= since]

    def close(self) -> None:
        pass


def behaviour(df: DataFrame, user: str, us: str, computer: str, late: str) -> DataFrame:
    """Each user's hours (user, window_id, ...) with their scores against the user's own history, as rows come, in any order.

    A micro-batch gives, for each user that it has rows of, the hours that they change and all later ones,
    as these have them in their history; the last row of a user and hour holds. The computers that a user has
    reached and the hours are one value of the state, read and written once a batch; a timer takes the single
    times and computers of an hour out of it once the watermark (`late` behind the latest row) has passed it. Rows for an hour that is
    closed are left out. Rows with a null user or time are left out.
    """
    ship(df.sparkSession)
    # States and timers are offered by this store only.
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = df.filter(F.col(user).isNotNull() & F.col(us).isNotNull()).select(
        F.col(user).alias("user"), F.col(us).cast("long").alias("us"), F.col(computer).cast("string").alias("computer"), F.floor(F.col(us) / HOUR_US).cast("long").alias("hour"), F.timestamp_micros(us).alias("time"),
    ).withWatermark("time", late)
    schema = f"user {dict(df.dtypes)[user]}, " + ", ".join(f"{n} {k}" for n, k in FIELDS.items())
    return rows.groupBy("user").transformWithStateInPandas(_Behaviour(), schema, "Update", "EventTime")


class GraphTables:
    """A graph's merged nodes and edges in a folder, fed by micro-batches, each of which counts once.

    A batch writes what it saw under its number, over whatever an earlier try of the same batch left; the
    merged graph is the merge of all of them. Every `every` batches they are merged into one base
    table, whose number tells the batches it holds: a batch that comes again after that is known.
    """

    def __init__(self, spark: SparkSession, path: str, every: int = 16):
        self.spark, self.path, self.every = spark, path.rstrip("/"), every

    def _list(self) -> dict[str, list[int]]:
        """Numbers of the finished base and batch folders."""
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        files = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found: dict[str, list[int]] = {"base": [], "batch": []}
        if files.exists(where):
            for status in files.listStatus(where):
                kind, _, number = status.getPath().getName().partition("-")
                if kind in found and files.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}-{number}/edges/_SUCCESS")):
                    found[kind].append(int(number))
        return found

    def _parts(self) -> tuple[list[str], int]:
        """The folders that hold now, and the last batch in the base (-1 without one)."""
        found = self._list()
        base = max(found["base"], default=-1)
        return [f"{self.path}/base-{base}"] * (base >= 0) + [f"{self.path}/batch-{b}" for b in sorted(found["batch"]) if b > base], base

    def nodes(self) -> DataFrame:
        """All nodes, merged."""
        return self._merged("nodes", graph.update_nodes)

    def edges(self) -> DataFrame:
        """All edges, merged."""
        return self._merged("edges", graph.update_edges)

    def _merged(self, name: str, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
        parts, _ = self._parts()
        whole = self.spark.read.parquet(*[f"{p}/{name}" for p in parts])
        return merge(whole, whole.limit(0))

    def add(self, batch: DataFrame, number: int) -> None:
        """A `foreachBatch` function: evidence rows, as `graph.extract` needs them."""
        if number <= self._parts()[1]:
            return
        rows = graph.extract(batch)
        graph.merge_nodes(rows).write.mode("overwrite").parquet(f"{self.path}/batch-{number}/nodes")
        graph.merge_edges(rows).write.mode("overwrite").parquet(f"{self.path}/batch-{number}/edges")
        if (number + 1) % self.every == 0:
            nodes, edges = self.nodes(), self.edges()
            nodes.write.mode("overwrite").parquet(f"{self.path}/base-{number}/nodes")
            edges.write.mode("overwrite").parquet(f"{self.path}/base-{number}/edges")


class Receiver:
    """Webhook requests by micro-batch, with address limits that hold across batches.

    A batch's answers and events are written under its number, over whatever an earlier try of it left; then
    the requests that still count against their address (at most as many as the limit for each) go to
    a table that the next batch starts from. A batch is a Spark job, so a busy address is folded
    burst by burst, in many tasks, and not as one key of a state store.

    Batches are judged in their order, requests of a batch in that of their times. An address that had no
    request for `forget` seconds before the latest one of all is forgotten. Requests without an
    address or a time are not limited; ids are taken to be unique.
    """

    def __init__(self, spark: SparkSession, path: str, key: str | None = None, limit: int = limits.BY_ADDRESS[0], forget: int = 86_400):
        self.spark, self.path, self.key, self.limit, self.forget = spark, path.rstrip("/"), key, limit, forget

    def _files(self) -> tuple:
        jvm = self.spark.sparkContext._jvm
        at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _states(self) -> list[int]:
        """Numbers of the batches whose state is whole and still there, ascending."""
        files, at = self._files()
        if not files.exists(at("passed")):
            return []
        names = [status.getPath().getName() for status in files.listStatus(at("passed"))]
        return sorted(int(n.split("=")[1]) for n in names if files.exists(at(f"passed/{n}/_SUCCESS")))

    def events(self) -> DataFrame:
        """All requests so far with status, event and batch."""
        return self.spark.read.option("basePath", f"{self.path}/events").parquet(f"{self.path}/events/batch=*")

    def add(self, batch: DataFrame, number: int) -> None:
        """A `foreachBatch` function: requests, as `evidence.received` takes them."""
        states = self._states()
        last = max((n for n in states if n < number), default=None)
        if any(n > number for n in states):  # a later batch has begun from this one: its rows are written
            return
        earlier = None if last is None else self.spark.read.parquet(f"{self.path}/passed/batch={last}")
        out = f"{self.path}/events/batch={number}"
        batch = spool(batch)  # read once, however often it is judged
        evidence.received(batch, self.key, self.limit, earlier).write.mode("overwrite").parquet(out)
        passed = self.spark.read.parquet(out).filter("status != 429 and address is not null and address != '' and us is not null")
        passed = passed.select(F.col("id").cast("string").alias("id"), "address", F.col("us").cast("long").alias("us"))
        passed = passed if earlier is None else passed.unionByName(earlier)
        newest = passed.groupBy("address").agg(F.max("us").alias("_newest"))
        latest = newest.agg(F.max("_newest")).first()[0]
        if latest is not None:
            newest = newest.filter(F.col("_newest") >= latest - self.forget * 1_000_000)
        counts = passed.join(newest, "address").filter(F.col("us") > F.col("_newest") - limits.BY_ADDRESS[1] * 1_000_000).drop("_newest")
        counts.write.mode("overwrite").parquet(f"{self.path}/passed/batch={number}")
        unspool(batch)
        files, at = self._files()
        for old in states:
            if last is not None and old < last:  # the last one stays for another try of this batch
                files.delete(at(f"passed/batch={old}"), True)
