"""Protocols for what users add: detectors, providers, subscribers, embedders; and the publisher.

All take and return DataFrames, so what is plugged in stays part of one plan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .operators import evidence


@runtime_checkable
class Detector(Protocol):
    """Scores telemetry: `load` fetches the model once, `predict` adds risk_score and what explains it."""

    name: str

    def load(self) -> None: ...

    def predict(self, df: DataFrame) -> DataFrame: ...


@runtime_checkable
class Provider(Protocol):
    """A source of knowledge: documents taken in, and the best for queries (query_id, text, q)."""

    name: str

    def ingest(self, documents: DataFrame) -> None: ...

    def search(self, queries: DataFrame, limit: int, where: Column | None = None) -> DataFrame: ...


@runtime_checkable
class Subscriber(Protocol):
    """Receives the evidence that its condition lets through; `health` is a word for people."""

    name: str
    condition: Column

    def receive(self, batch: DataFrame) -> None: ...

    def health(self) -> str: ...


@runtime_checkable
class Embedder(Protocol):
    """Adds a vector column to texts; a model's own, for instance a Pandas UDF around it."""

    dimension: int

    def embed(self, df: DataFrame, text: str, out: str) -> DataFrame: ...


@dataclass
class Precomputed:
    """An embedder that looks texts up in a table (text, vector): texts it lacks get null."""

    table: DataFrame
    dimension: int
    text: str = "text"
    vector: str = "embedding"

    def embed(self, df: DataFrame, text: str, out: str) -> DataFrame:
        known = self.table.groupBy(F.col(self.text).alias("_t")).agg(F.min(self.vector).alias(out))
        return df.join(known, F.col(text) == F.col("_t"), "left").drop("_t")


def subscriptions(subscribers: list[Subscriber]) -> dict[str, tuple[Column, Callable[[DataFrame], None]]]:
    """Subscribers as `streaming.fan_out` takes them."""
    return {s.name: (s.condition, s.receive) for s in subscribers}


def run(detectors: list[Detector], telemetry: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Each detector's output on the telemetry of its name; detectors without any are left out."""
    out = {}
    for d in detectors:
        if d.name in telemetry:
            d.load()
            out[d.name] = d.predict(telemetry[d.name])
    return out


@dataclass
class Publisher:
    """Publishes evidence to a sink: a table appended to, a topic's writer, or anything that takes a
    DataFrame. `published` holds how many rows each call gave, refused ones under `refused`."""

    sink: Callable[[DataFrame], None]
    published: list[int] = field(default_factory=list)
    refused: list[int] = field(default_factory=list)

    def publish(self, df: DataFrame) -> int:
        """All rows, at once."""
        counted = df.count()
        self.sink(df)
        self.published.append(counted)
        return counted

    def publish_batch(self, many: list[DataFrame]) -> int:
        """Several tables of the same columns as one write."""
        out = many[0]
        for df in many[1:]:
            out = out.unionByName(df, allowMissingColumns=True)
        return self.publish(out)

    def publish_if_valid(self, df: DataFrame) -> int:
        """Rows that meet the contract; the others are counted as refused."""
        # Both are counted while the one write reads the rows, so they are of what was written.
        seen, ok = Observation(), F.size("_e") == 0
        checked = df.withColumn("_e", evidence.errors()).observe(seen, F.count_if(ok).alias("good"), F.count_if(~ok).alias("bad"))
        self.sink(checked.filter(ok).drop("_e"))
        counted = seen.get
        self.refused.append(counted["bad"])
        self.published.append(counted["good"])
        return counted["good"]

    def publish_stream(self, df: DataFrame, checkpoint: str):
        """A stream's rows, batch by batch, until the query that is returned is stopped."""
        return df.writeStream.foreachBatch(lambda batch, _id: self.publish(batch) and None).option("checkpointLocation", checkpoint).start()
