"""A bounded sample of labelled documents to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Spool

#: Labelled documents that a classifier is fitted on, at most.
SAMPLE = 12_000


def sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column | None = None, id: str = "doc_id", text: str = "text", bound: int = SAMPLE) -> DataFrame:
    """Columns key (long), text, label (int) of at most `bound` labelled documents.

    Chosen by hash of the id, so for one input always the same. Rows without id or label are left
    out; repeated label rows count once (the larger label), and so do rows that repeat an id (the
    largest text), so `bound` bounds the rows. `usable` restricts the labels, say to a training
    fold. The sample's labels are broadcast; its texts are combined in tasks and written once.
    """
    chosen = labels.select(F.col(id).alias("_id"), F.col(label).alias("_label")).filter("_id is not null and _label is not null")
    if usable is not None:
        chosen = chosen.filter(usable)
    chosen = chosen.groupBy("_id").agg(F.max("_label").alias("_label")).orderBy(F.xxhash64("_id"), "_id").limit(bound)
    joined = docs.select(F.col(id).alias("_doc"), F.col(text).alias("text")).join(F.broadcast(chosen), F.col("_doc") == F.col("_id"))
    one = joined.groupBy("_id").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"), F.max("_label").alias("_label"))
    return Spool(docs.sparkSession).write(one.select(F.xxhash64("_id").alias("key"), "text", F.col("_label").cast("int").alias("label")))
