"""The queries of this subpackage's operators over the tables of a folder, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, drake_kmeans, embedding_dedup, hilbert_search, labelled, license_scan, line_dedup, ngram_join, packing, pitman_yor, quality, token_counts, toxicity, whitening
from .common import remainder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every text; digests of the ids and of the decoded bytes."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = bpe.encode(docs, ranks, pattern=public_tokenizers.PATTERN).drop("text")
    out = bpe.decode(ids.withColumns({"n_tokens": (F.length("ids") / 4).cast("long"), "ids_sha256": F.sha2("ids", 256)}), ranks)
    return out.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_pitman_yor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's log10 probability, learned from the texts that are not held out."""
    out = pitman_yor.score(_table(spark, sf_dir, "documents"), remainder("doc_id", 10) != 0)
    held = (remainder("doc_id", 10) == 0).alias("held_out")
    return out.select("doc_id", held, "n_tokens", "n_known", "train_tokens", "base_score", "score")


def _classified(df: DataFrame, modulus: int, held_out: int) -> DataFrame:
    held = remainder("doc_id", modulus) == held_out
    return df.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; labels of the held-out quarter are not learned from."""
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels")
    model = quality.fit(labelled.sample(docs, labels, "quality", remainder("_id", 4) != 2))
    return _classified(quality.score(docs, model), 4, 2)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences whose notice or text a document holds."""
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; labels of the held-out third are not learned from."""
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels")
    model = toxicity.fit(labelled.sample(docs, labels, "toxic", remainder("_id", 3) != 1))
    return _classified(toxicity.score(docs, model), 3, 1)


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose sets of five-word shingles have a Jaccard similarity of 0.75 or more."""
    out = ngram_join.similar_components(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_shingles", "component_id")


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with a cosine of 0.9 or more, and their components."""
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text, and whether they exceed 512."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = token_counts.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return out.select("doc_id", size.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of at most 1024 tokens."""
    pieces = packing.cut(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    pieces = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(pieces)


def op10_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every vector whose id is divisible by 20."""
    return hilbert_search.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op11_drake_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight clusters of all vectors of 64 components after ten rounds."""
    return drake_kmeans.clusters(_table(spark, sf_dir, "embeddings"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the lines that at least three documents hold, but for the last of these."""
    docs, index = _table(spark, sf_dir, "documents").select("doc_id", "text"), line_dedup.LineIndex(spark)
    index.insert(docs)
    out = index.clean(docs, rows=index.references())
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op13_tsqr_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the 16 first principal axes, scaled to unit variance."""
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe_roundtrip": op1_bpe_roundtrip,
    "op2_pitman_yor_scores": op2_pitman_yor_scores,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_license_scan": op4_license_scan,
    "op5_toxicity": op5_toxicity,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_embedding_near_dedup": op7_embedding_near_dedup,
    "op8_token_counts": op8_token_counts,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_hilbert_neighbours": op10_hilbert_neighbours,
    "op11_drake_kmeans": op11_drake_kmeans,
    "op12_line_dedup": op12_line_dedup,
    "op13_tsqr_whitening": op13_tsqr_whitening,
}

ORACLES: dict[str, str] = {
    "op4_license_scan": license_scan.oracle_sql(),
    "op11_drake_kmeans": drake_kmeans.oracle_sql(),
    "op12_line_dedup": line_dedup.oracle_sql(),
}
