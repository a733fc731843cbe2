"""Queries on retrieval: benchmark passages search the documents, some vectors all vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import retrieval as op
from .registry import query, table

_STOP = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in op.STOP_WORDS) + "]"
_STEM = """CASE WHEN length(w) <= 4 THEN w WHEN ends_with(w, 'ing') THEN w[:-4] WHEN ends_with(w, 'edly') THEN w[:-5] WHEN ends_with(w, 'ed') THEN w[:-3]
WHEN ends_with(w, 'es') AND NOT (ends_with(w, 'aes') OR ends_with(w, 'ees') OR ends_with(w, 'oes')) THEN w[:-3] WHEN ends_with(w, 's') AND NOT (ends_with(w, 'ss') OR ends_with(w, 'us') OR ends_with(w, 'is')) THEN w[:-2] ELSE w END"""


def tokens_sql(name: str, source: str, id: str) -> str:
    """CTEs that end in `name` (id, t: the distinct tokens): identifiers whole, then stems."""
    steps = [f"{name}0 AS (SELECT {id}, lower(coalesce(text, '')) AS x, [] AS kept FROM {source})"]
    for k, p in enumerate(op.IDENTIFIERS):
        steps.append(f"{name}{k + 1} AS (SELECT {id}, regexp_replace(x, '{p}', ' ', 'g') AS x, list_concat(kept, regexp_extract_all(x, '{p}')) AS kept FROM {name}{k})")
    words = "list_filter(string_split_regex(regexp_replace(x, '[^a-zA-Z0-9\\s]', ' ', 'g'), '\\s+'), lambda w: w != '' AND NOT list_contains(" + _STOP + ", w))"
    steps.append(f"{name} AS (SELECT {id}, list_distinct(list_concat(kept, list_transform({words}, lambda w: {_STEM}))) AS t FROM {name}{len(op.IDENTIFIERS)})")
    return ", ".join(steps)


_BM = f"""{tokens_sql("d", "documents", "doc_id")}, {tokens_sql("b", "benchmark", "item_id")}, p AS (SELECT doc_id, unnest(t) AS term, len(t) AS length FROM d), s AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM d),
q AS (SELECT item_id, unnest(t) AS term FROM b), f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
h AS (SELECT item_id, doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * length / mean))) AS score FROM q JOIN p USING (term) JOIN f USING (term), s GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM h QUALIFY rank <= 5)"""


def _bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 of passages against the index of whole documents."""
    q = table(spark, sf_dir, "benchmark").select("item_id", F.explode(op.tokens(F.col("text"))).alias("term"))
    return op.bm25(q, *op.index(table(spark, sf_dir, "documents"), "doc_id", "text"), "item_id", "doc_id", 5)


@query(f"WITH {_BM} SELECT item_id, doc_id, CAST(rank AS INT) AS rank, round(score, 6) AS score FROM r")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best five documents of each passage by BM25."""
    return _bm25(spark, sf_dir).select("item_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@query(f"WITH {tokens_sql('b', 'benchmark', 'item_id')} SELECT item_id, list_sort(t) AS tokens FROM b")
def tokenize_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tokens of each passage: identifiers and stems."""
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_sort(op.tokens(F.col("text"))).alias("tokens"))


@query(f"WITH {tokens_sql('d', 'documents', 'doc_id')}, c AS (SELECT doc_id, len(t) AS length FROM d WHERE doc_id % 3 != 0) SELECT count(*) AS documents, CAST(sum(length) AS BIGINT) AS postings FROM c")
def index_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of which parts were added, replaced and removed."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    old = d.withColumn("text", F.when(F.col("doc_id") % 2 == 0, "old words here").otherwise(F.col("text"))).filter("doc_id % 5 != 1")
    postings, lengths = op.index(old, "doc_id", "text")
    postings, lengths = op.update_index(postings, lengths, d.filter("doc_id % 2 = 0 or doc_id % 5 = 1"), d.filter("doc_id % 3 = 0").select("doc_id"), "doc_id", "text")
    return lengths.agg(F.count("*").alias("documents")).join(postings.agg(F.count("*").alias("postings")))


_KNN = "q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 20 = 0), k AS (SELECT qid, vec_id, list_sum(list_transform(range(1, 65), lambda i: (q[i] - e[i]) * (q[i] - e[i]))) AS d FROM q, (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) v)"


@query(f"WITH {_KNN} SELECT qid, vec_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(d, 9), vec_id) AS INT) AS rank, round(d, 6) AS distance FROM k QUALIFY rank <= 10")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact nearest ten of every vector whose id is divisible by 20."""
    v = table(spark, sf_dir, "embeddings")
    q = v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    return op.dense(q, v.select("vec_id", "embedding"), "qid", "vec_id", "embedding", 10).select("qid", "vec_id", "rank", F.round("distance", 6).alias("distance"))


_SIDE = """v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), z AS (SELECT item_id, doc_id, list_sum(list_transform(range(1, 65), lambda i: (a.e[i] - c.e[i]) * (a.e[i] - c.e[i]))) AS distance FROM benchmark JOIN v a ON a.vec_id = item_id, documents JOIN v c ON c.vec_id = doc_id),
y AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY distance, doc_id) AS rank FROM z QUALIFY rank <= 5)"""


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five documents nearest to each passage, by the vectors of the same numbers."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("_v"), "embedding")
    q = table(spark, sf_dir, "benchmark").join(v, F.col("item_id") == F.col("_v")).select("item_id", F.col("embedding").alias("q"))
    d = table(spark, sf_dir, "documents").select("doc_id").join(v, F.col("doc_id") == F.col("_v")).select("doc_id", "embedding")
    return op.dense(q, d, "item_id", "doc_id", "embedding", 5)


@query(f"""WITH {_BM}, {_SIDE}, j AS (SELECT coalesce(r.item_id, y.item_id) AS item_id, coalesce(r.doc_id, y.doc_id) AS doc_id, r.rank AS ra, y.rank AS rb FROM r FULL JOIN y ON r.item_id = y.item_id AND r.doc_id = y.doc_id)
SELECT item_id, doc_id, round(coalesce(1.0 / (60 + rb), 0) + coalesce(0.8 / (60 + ra), 0), 9)::DOUBLE AS rrf, CASE WHEN ra IS NOT NULL AND rb IS NOT NULL THEN 'hybrid' WHEN rb IS NOT NULL THEN 'dense' ELSE 'lexical' END AS method FROM j""")
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical and dense ranking of each passage, fused."""
    f = op.fuse(_dense(spark, sf_dir), _bm25(spark, sf_dir), ["item_id", "doc_id"])
    return f.select("item_id", "doc_id", F.round("rrf", 9).alias("rrf"), "method")


#: Providers of a lower-case text t.
ROUTE_SQL = """list_filter([CASE WHEN contains(t, 'cve') OR contains(t, 'vulnerability') OR contains(t, 'exploit') THEN 'cve' END, CASE WHEN contains(t, 'cve') OR contains(t, 'vulnerability') OR contains(t, 'exploit') THEN 'kev' END,
CASE WHEN contains(t, 'mitigat') OR contains(t, 'defend') OR contains(t, 'prevent') OR contains(t, 'd3fend') THEN 'd3fend' END, CASE WHEN contains(t, 'yara') OR contains(t, 'signature') THEN 'yara' END, CASE WHEN contains(t, 'sigma') OR contains(t, 'log') OR contains(t, 'detect') THEN 'sigma' END,
CASE WHEN contains(t, 'playbook') OR contains(t, 'remediat') OR contains(t, 'containment') THEN 'playbook' END, CASE WHEN contains(t, 'policy') OR contains(t, 'corporate') OR contains(t, 'compliance') THEN 'policy' END, CASE WHEN contains(t, 'report') OR contains(t, 'intel') OR contains(t, 'actor') THEN 'threat_report' END,
CASE WHEN contains(t, 'past') OR contains(t, 'history') OR contains(t, 'previous') OR contains(t, 'incident') THEN 'historical_incident' END,
CASE WHEN NOT regexp_matches(t, 'cve|vulnerability|exploit|mitigat|defend|prevent|yara|signature|sigma|log|detect|playbook|remediat|containment|policy|corporate|compliance|report|intel|actor|past|history|previous|incident') OR regexp_matches(t, 'technique|t1|ssh|power|login|malicious|attack') THEN 'attack' END], lambda x: x IS NOT NULL)"""


@query(f"SELECT conv_id, turn, {ROUTE_SQL} AS providers FROM (SELECT *, lower(coalesce(text, '')) AS t FROM conversations)")
def route_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each message would be looked up."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", op.route(F.col("text")).alias("providers"))


@query("SELECT doc_id FROM documents WHERE lang IN ('de', 'fr') AND source = 'src3'")
def metadata_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that meet filters on their metadata."""
    d = table(spark, sf_dir, "documents")
    return d.filter(op.matches(d, {"lang": ["de", "fr"], "source": "src3"})).select("doc_id")


@query(f"WITH {_BM}, m AS (SELECT item_id, doc_id, score, min(score) OVER (PARTITION BY item_id) AS lo, max(score) OVER (PARTITION BY item_id) AS hi FROM r) SELECT item_id, doc_id, round(CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1 END, 5) AS rerank FROM m")
def rerank_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores normalised within each query, as after a reranker."""
    r = _bm25(spark, sf_dir).withColumn("rrf", F.col("score"))
    return op.rerank(r, "item_id", "score").select("item_id", "doc_id", F.round("rerank", 5).alias("rerank"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'new' ELSE lang END AS lang FROM documents WHERE doc_id % 7 != 0 UNION ALL SELECT -1, 'new'")
def document_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents changed, added and removed."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    changes = d.filter("doc_id % 5 = 0").select("doc_id", F.lit("new").alias("lang")).union(spark.range(1).select(F.lit(-1).cast("long"), F.lit("new")))
    return op.remove(op.upsert(d, changes, ["doc_id"]), d.filter("doc_id % 7 = 0"), ["doc_id"])
