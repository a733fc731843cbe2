"""Composed search: route, retrieve from each provider both ways, fuse, rerank, annotate.

One corpus table holds the documents of all providers; each provider's documents are ranked by
themselves (their own document frequencies and lengths), as if each had an index of its own, in
one pass over all of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.normalize import age_days
from ..operators import nearest, retrieval
from ..sinks import spool

#: Providers in the order in which their hits are ranked one after the other (fixed values).
PROVIDERS = ["attack", "cve", "kev", "d3fend", "yara", "sigma", "playbook", "policy", "threat_report", "historical_incident"]
#: Hits of a provider and side, candidates to rerank.
PER_PROVIDER, CANDIDATES = 5, 15
#: Distance of a document that no vector found.
FAR = 999.0


def corpus_tokens(corpus: DataFrame, text: Column) -> DataFrame:
    """Rows source, document_id, _t (the distinct tokens) of all providers, written."""
    return spool(retrieval.spread(corpus.select("source", "document_id", text.alias("_text"))).select("source", "document_id", retrieval.tokens(F.col("_text")).alias("_t")))


def lexical(queries: DataFrame, made: DataFrame, k: int = PER_PROVIDER) -> DataFrame:
    """Each provider's best documents by BM25 for each query routed to it (query_id, text, providers), of `corpus_tokens`.

    Documents are scored where their tokens lie and a task gives the k best of each query and provider, so a pair of query
    and document is never a row. Pairs are summed by a shuffle only where terms are too many to broadcast, or
    keys of documents repeat or are null, which a task by itself can't tell.
    """
    postings = made.select("source", "document_id", F.explode("_t").alias("term"), F.size("_t").alias("length"))
    sizes = made.groupBy("source").agg(F.count("*").alias("n"), F.avg(F.size("_t")).alias("mean"))
    terms = queries.select("query_id", F.explode("providers").alias("source"), retrieval.tokens(F.col("text")).alias("_t"))
    terms = spool(terms.select("query_id", "source", F.explode("_t").alias("term")))
    few_terms = terms.count() <= retrieval.TERMS
    small = F.broadcast if few_terms else lambda df: df
    few = postings.join(small(terms.select("source", "term").distinct()), ["source", "term"], "left_semi")
    df = few.groupBy("source", "term").agg(F.count("*").alias("df")).join(F.broadcast(sizes), "source")
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weights = terms.join(df.select("source", "term", "mean", idf.alias("idf")), ["source", "term"])
    if few_terms and made.groupBy("source", "document_id").count().filter("count > 1 OR document_id IS NULL").isEmpty():
        scores = retrieval.scanned_by_source(made, weights, "query_id", "document_id", k)
    else:
        weight = (retrieval.K1 + 1) / (1 + retrieval.K1 * (1 - retrieval.B + retrieval.B * F.col("length") / F.col("mean")))
        hits = postings.join(small(weights), ["source", "term"])
        scores = hits.groupBy("query_id", "source", "document_id").agg(F.sum(F.col("idf") * weight).alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id", "source").orderBy(F.desc(F.round("score", 9)), "document_id"))
    return scores.withColumn("_p", place).filter(F.col("_p") <= k)


def dense(queries: DataFrame, corpus: DataFrame, vector: str, k: int = PER_PROVIDER, most: int = nearest.MOST) -> DataFrame:
    """Each provider's nearest documents for each query routed to it (query_id, q, providers), exactly."""
    found = nearest.nearest(queries, corpus, "query_id", "document_id", vector, k, most, group="source")
    return found.withColumnRenamed("rank", "_p")


def _ranked(hits: DataFrame) -> DataFrame:
    """Hits of all providers as one list of each query: provider after provider, in the fixed order."""
    order = F.array_position(F.array(*map(F.lit, PROVIDERS)), F.col("source"))
    turn = F.when(order == 0, len(PROVIDERS) + 1).otherwise(order)
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(turn, "source", "_p"))).drop("_p")


def annotate(hits: DataFrame, now: Column) -> DataFrame:
    """Hits with trust, freshness, citation and address of their documents."""
    some = lambda c: F.when((F.size(c) if c in ("tags", "references") else F.length(c)) > 0, 1.0).otherwise(0.0)
    filled = (some("description") + some("tags") + some("references") + some("version")) / 4
    low = F.transform(F.coalesce("tags", F.array().cast("array<string>")), F.lower)
    gone = F.array_contains(low, "deprecated") | (F.lower(F.coalesce("status", F.lit(""))) == "deprecated")
    fresh = scoring.freshness(age_days(F.col("updated_at"), now), gone)
    first = F.coalesce(F.get("references", F.lit(0)), F.lit(""))
    page = F.concat(F.lit("https://attack.mitre.org/techniques/"), F.col("document_id").cast("string"), F.lit("/"))
    return hits.withColumn("_f", fresh).withColumns({
        "trust_score": scoring.trust(F.col("source"), F.col("confidence"), filled, F.coalesce(F.col("validation_status"), F.lit("validated")) == "validated"),
        "freshness_score": F.col("_f.score"), "freshness_category": F.col("_f.category"), "last_updated": F.coalesce("updated_at", F.lit("")), "provider": F.col("source"),
        "citation": F.concat(F.lit("["), "source", F.lit(":"), F.col("document_id").cast("string"), F.lit("]")),
        "original_url": F.when((first == "") & (F.col("source") == "attack"), page).otherwise(first),
        "similarity_score": F.coalesce("distance", F.lit(FAR)), "bm25_score": F.coalesce("score", F.lit(0.0)),
    }).drop("_f")


#: Fields of a document that need not be there, and what they are then.
FIELDS = {"title": "string", "description": "string", "confidence": "double", "tags": "array<string>", "references": "array<string>", "version": "string", "updated_at": "string", "status": "string", "validation_status": "string"}


def search(queries: DataFrame, corpus: DataFrame, text: Column, vector: str, top: int = 5, now: Column | None = None, enabled: list[str] | None = None, weights: dict[str, float] | None = None, reranker: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The best documents of each query (query_id, text, q), annotated: query_id, rank and the rest.

    `corpus`: source, document_id, `vector` and any of `FIELDS`; `enabled`: providers that may be
    asked (by default those that the corpus has; a query that is routed to none of them asks
    "attack"); `reranker` adds the column `model_score` to candidates (query_id, text, ...).
    """
    if enabled is None:
        # Only these are ever routed to, so others need not be known.
        enabled = [r[0] for r in corpus.filter(F.col("source").isin(PROVIDERS)).select("source").distinct().collect()]
    routed = F.filter(retrieval.route(F.col("text")), lambda p: p.isin(enabled))
    asked = spool(queries.withColumn("providers", F.when(F.size(routed) > 0, routed).otherwise(F.array(F.lit("attack")))))
    docs = corpus.withColumns({c: F.lit(None).cast(kind) for c, kind in FIELDS.items() if c not in corpus.columns})
    docs = docs.withColumn("confidence", F.coalesce("confidence", F.lit(1.0)))
    keys = ["source", "document_id"]
    near, words = (spool(_ranked(h)) for h in (dense(asked, docs, vector), lexical(asked, corpus_tokens(docs, text))))
    # Of the corpus only the documents that were found go on, so no other text meets a hit.
    hits = spool(near.select(keys).union(words.select(keys)).distinct())
    docs = spool(docs.select(*keys, *FIELDS).join(F.broadcast(hits) if hits.count() <= retrieval.TERMS else hits, keys, "left_semi"))
    near, words = (h.join(docs.select(*keys, "confidence"), keys) for h in (near, words))
    fused = retrieval.fuse(near, words, ["query_id", *keys], weights)
    best = retrieval.order_fused(fused, "query_id", "document_id", CANDIDATES)
    if reranker is not None:
        scored = retrieval.rerank(reranker(best.join(docs.select(*keys, *[c for c in FIELDS if c != "confidence"]), keys).join(asked.select("query_id", "text"), "query_id")), "query_id", "model_score")
        best = scored.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rerank"), "place"))).select(*best.columns, "rerank")
    best = best.filter(F.col("place") <= top).withColumnRenamed("place", "rank")
    return annotate(best.join(docs.select(*keys, *FIELDS), keys), F.current_timestamp() if now is None else now)


def explanation() -> Column:
    """A hit as a line of text."""
    return F.format_string("Provider '%s' matched [%s] %s (Score: %.4f, Method: %s)", F.col("source"), F.col("document_id").cast("string"), F.coalesce("title", F.lit("")), F.col("similarity_score"), F.col("method"))
