"""A corpus pipeline in four stages: toxicity, quality, near-duplicates, packing.

Each stage is a function of (spark, docs, sf_dir); it gets all that the one before kept, written
as Parquet and read again. The first three return the columns of `documents`, the last the
packed pieces.

Edge cases: empty tables pass through all stages; null texts count as empty; a row with a null
id is never a duplicate of another; of rows that repeat an id and its text one stays, while
other texts under a repeated id are documents of their own; extra columns of the input, whatever
their names and types, are kept by the first three stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcspan.llm import labelled, ngram_join, packing, quality, toxicity
from arcspan.llm.common import Spool, remainder

#: Scores from which a document is toxic, or good (those of the operators' queries), and rows broadcast at most.
TOXIC, GOOD, IDS_MOST = 0.7, 0.7, 1_000_000


def _free(docs: DataFrame, name: str) -> str:
    """A column name like `name` that the table does not have."""
    there = {c.lower() for c in docs.columns}
    while name.lower() in there:
        name = f"_{name}"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(labelled.sample(docs, labels, "toxic", remainder("_id", 3) != 1))
    out = _free(docs, "_toxicity")
    return toxicity.score(docs, model, out=out).filter(F.col(out) < TOXIC).drop(out)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(labelled.sample(docs, labels, "quality", remainder("_id", 4) != 2))
    out = _free(docs, "_quality")
    return quality.score(docs, model, out=out).filter(F.col(out) >= GOOD).drop(out)


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of the n-gram Jaccard join, that with the smallest id."""
    # Rows are told apart by a hash of id and text, as ids may repeat.
    columns, row = docs.columns, _free(docs, "_row")
    docs = docs.withColumn(row, F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", F.coalesce("text", F.lit("")))))
    groups = Spool(spark).write(ngram_join.similar_components(docs, id=row))
    far = groups.filter(F.col(row) != F.col("component_id")).select(row, "component_id").distinct()
    again = groups.filter(F.col(row).isNotNull()).groupBy(row).count().filter("count > 1").select(row)
    # A checked number of rows is broadcast, so texts stay where they are; beyond it, they are joined.
    hint = F.broadcast if far.count() <= IDS_MOST // 2 and again.count() <= IDS_MOST else lambda x: x
    members = far.unionByName(far.select(F.col("component_id").alias(row), "component_id").distinct())
    members = docs.select(row, "doc_id").join(hint(members), row).distinct()
    first = members.groupBy("component_id").agg(F.min(F.struct("doc_id", F.col(row).alias("r"))).alias("first"))
    gone = members.join(hint(first), "component_id").filter(F.col(row) != F.col("first.r")).select(row)
    kept = docs.join(hint(gone), row, "left_anti")
    once = kept.join(hint(again), row, "left_anti").select(columns)
    # Of repeated rows any one stays; they differ in extra columns at most.
    return once.unionByName(kept.join(hint(again), row, "left_semi").dropDuplicates([row]).select(columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents' pieces and their places in sequences of 1024 tokens."""
    pieces = packing.cut(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


STAGES = [("toxicity", drop_toxic), ("quality", keep_good), ("near duplicates", keep_one_of_similar), ("packing", pack)]

#: No SQL: two stages are fitted classifiers. Tested stage by stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over `documents`."""
    spool, docs = Spool(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for place, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if place < len(STAGES) - 1:
            docs = spool.write(docs)
            if place:
                spool.drop(before)
    return docs
