"""Queries on network-flow operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize
from ..operators import network as op
from .registry import events, query, table

FAMILIES = {"click": "BENIGN", "view": "BENIGN", "signup": "RECON", "purchase": "EXFIL", "error": "DOS"}
_FAMILY = "CASE event_type WHEN 'click' THEN 'BENIGN' WHEN 'view' THEN 'BENIGN' WHEN 'signup' THEN 'RECON' WHEN 'purchase' THEN 'EXFIL' ELSE 'DOS' END"


@query(f"SELECT {_FAMILY} AS family, count(*) AS n FROM events GROUP BY 1")
def network_family_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels mapped to families; an unknown one would be an error."""
    return events(spark, sf_dir).groupBy(op.map_family(F.col("event_type"), FAMILIES).alias("family")).agg(F.count("*").alias("n"))


@query("WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1) SELECT event_type, n, round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n), 6) AS weight FROM c")
def network_class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balanced class weights."""
    return op.class_weights(events(spark, sf_dir), "event_type").select("event_type", "n", F.round("weight", 6).alias("weight"))


@query("SELECT count(*) FILTER (WHERE toxic = 1) AS positives, count(*) FILTER (WHERE toxic = 0) AS negatives, round(count(*) FILTER (WHERE toxic = 0) / count(*) FILTER (WHERE toxic = 1), 6) AS scale FROM labels")
def network_scale_pos_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives for each positive."""
    return op.scale_pos_weight(table(spark, sf_dir, "labels"), "toxic").withColumn("scale", F.round("scale", 6))


@query("WITH s AS (SELECT event_id, value / max(value) OVER () AS score FROM events) SELECT CASE WHEN score >= 0.5 THEN 'critical' WHEN score >= 0.3 THEN 'high' WHEN score >= 0.1 THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM s GROUP BY 1")
def network_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by severity band."""
    e = events(spark, sf_dir)
    top = e.agg(F.max("value").alias("top"))
    return e.join(F.broadcast(top)).groupBy(op.band(F.col("value") / F.col("top")).alias("band")).agg(F.count("*").alias("n"))


@query("WITH p AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS p, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, CASE WHEN p < floor(n * 0.7::DOUBLE) THEN 'train' WHEN p < floor(n * 0.85::DOUBLE) THEN 'validation' ELSE 'test' END AS split, count(*) AS n_rows FROM p GROUP BY 1, 2")
def network_chronological_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chronological 70 / 15 / 15 within each type."""
    out = op.chronological_split(events(spark, sf_dir), ["us", "event_id"], "event_type")
    return out.groupBy("event_type", "split").agg(F.count("*").alias("n_rows"))


@query("""WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1 HAVING count(*) >= 7) SELECT event_type, 'train' AS split, CAST(floor(n * 0.7::DOUBLE) AS BIGINT) AS n_rows FROM c
UNION ALL SELECT event_type, 'validation', CAST(floor(n * 0.85::DOUBLE) - floor(n * 0.7::DOUBLE) AS BIGINT) FROM c UNION ALL SELECT event_type, 'test', CAST(n - floor(n * 0.85::DOUBLE) AS BIGINT) FROM c""")
def network_stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stratified, seeded split, by its counts; which rows go where is this engine's own."""
    return op.stratified_split(events(spark, sf_dir), "event_type", "event_id").groupBy("event_type", "split").agg(F.count("*").alias("n_rows"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 0.0::DOUBLE ELSE value END AS value_s FROM events")
def network_clean_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names cleaned, infinite and undefined numbers as 0."""
    odd = F.when(F.col("event_type") == "error", F.when(F.col("event_id") % 2 == 0, float("inf")).otherwise(float("nan"))).otherwise(F.col("value"))
    raw = events(spark, sf_dir).select("event_id", odd.alias(" Value/s "))
    return op.clean_frame(raw.withColumnRenamed(" Value/s ", " Value _s"), [" Value _s"]).withColumnRenamed("value__s", "value_s")


@query("SELECT page_id, list_last(string_split(replace(url, '\\', '/'), '/')) AS name FROM pages")
def normalize_basename(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last path segments."""
    return table(spark, sf_dir, "pages").select("page_id", normalize.basename(F.col("url")).alias("name"))


@query("SELECT event_id, k AS plain, k AS hexed, CAST(NULL AS BIGINT) AS bad FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)")
def normalize_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decimal and hexadecimal numbers; others null."""
    e = events(spark, sf_dir)
    return e.select("event_id", normalize.to_int(F.col("k").cast("string")).alias("plain"), normalize.to_int(F.concat(F.lit("0x"), F.hex("k"))).alias("hexed"), normalize.to_int(F.col("event_type")).alias("bad"))


@query("SELECT page_id, round(list_sum(list_transform(list_distinct(c), lambda x: -(len(list_filter(c, lambda y: y = x)) / len(c)) * log2(len(list_filter(c, lambda y: y = x)) / len(c)))), 6) AS bits FROM (SELECT page_id, string_split(url, '') AS c FROM pages)")
def normalize_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character entropy of addresses."""
    return table(spark, sf_dir, "pages").select("page_id", F.round(normalize.entropy(F.col("url")), 6).alias("bits"))
