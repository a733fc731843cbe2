"""Network flows: label families, class weights, splits and bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import clean_name, finite
from .ranks import placed


def clean_frame(df: DataFrame, numeric: list[str]) -> DataFrame:
    """Clean column names; named columns as finite doubles, else 0."""
    out = df.toDF(*map(clean_name, df.columns))
    names = {clean_name(c) for c in numeric}
    return out.select(*[finite(F.col(c).try_cast("double")).alias(c) if c in names else F.col(c) for c in out.columns])


def map_family(label: Column, families: dict[str, str]) -> Column:
    """A label's family; null labels stay null, unknown ones are an error."""
    pairs = [F.lit(x) for kv in families.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), F.trim(label))
    return F.when(label.isNull(), None).when(found.isNull(), F.raise_error(F.concat(F.lit("unknown label "), label)).cast("string")).otherwise(found)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Each class's count and its balanced weight N / (K * n); one row per class."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"), F.count("*").alias("classes"))  # one row
    return counts.join(F.broadcast(total)).select(label, "n", (F.col("total") / (F.col("classes") * F.col("n"))).alias("weight"))


def weighted(df: DataFrame, label: str) -> DataFrame:
    """Rows with their class's weight; the few classes are broadcast by their size."""
    return df.join(class_weights(df, label).select(label, "weight"), label)


def scale_pos_weight(df: DataFrame, label: str) -> DataFrame:
    """Negatives for each positive."""
    pos = F.count_if(F.col(label) == 1)
    return df.agg(pos.alias("positives"), F.count_if(F.col(label) == 0).alias("negatives")).withColumn("scale", F.when(F.col("positives") > 0, F.col("negatives") / F.col("positives")).otherwise(1.0))


def band(score: Column) -> Column:
    """Severity of an attack probability."""
    return F.when(score >= 0.5, "critical").when(score >= 0.3, "high").when(score >= 0.1, "medium").otherwise("low")


def chronological_split(df: DataFrame, order: list[str], key: str | None = None) -> DataFrame:
    """70 / 15 / 15 by time, cut at int(0.7 n) and int(0.85 n), over all rows or within each `key`.

    Rows are sorted by ranges of (key, order), so neither the whole table nor a large key is one task.
    """
    return _split(_within(df, key, [F.col(c) for c in order]))


def _within(df: DataFrame, key: str | None, order: list[Column]) -> DataFrame:
    """`df` with _p, a row's place within its key from 0, and _n, the key's rows."""
    if key is None:
        return placed(df, order).withColumnRenamed("_p_all", "_n")
    counts = df.groupBy(key).agg(F.count("*").alias("_n"), F.lit(True).alias("_c"))
    first = placed(df, [F.col(key), *order]).drop("_p_all")
    start = first.groupBy(key).agg(F.min("_p").alias("_first"))
    same = start.join(counts, start[key].eqNullSafe(counts[key])).select(start[key].alias("_key"), "_first", "_n")
    out = first.join(same, F.col(key).eqNullSafe(F.col("_key")))
    return out.withColumn("_p", F.col("_p") - F.col("_first")).drop("_key", "_first")


def _split(df: DataFrame) -> DataFrame:
    return df.withColumn("split", F.when(F.col("_p") < F.floor(F.col("_n") * 0.7), "train").when(F.col("_p") < F.floor(F.col("_n") * 0.85), "validation").otherwise("test")).drop("_p", "_n")


def stratified_split(df: DataFrame, label: str, key: str, seed: int = 42) -> DataFrame:
    """70 / 15 / 15 within each class, by a seeded hash of the key; classes below 7 rows are left out."""
    return _split(_within(df, label, [F.xxhash64(F.col(key), F.lit(seed)), F.col(key)]).filter("_n >= 7"))
