"""Queries on search, memory and contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import memory
from ..plans import context, search
from .registry import query, table
from .retrieval import ROUTE_SQL, tokens_sql

_SOURCES = {"src0": "attack", "src1": "sigma", "src2": "playbook", "src3": "policy"}


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as those of providers, with the vectors of the same numbers."""
    d, v = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    source = F.lit("historical_incident")
    for k, p in _SOURCES.items():
        source = F.when(F.col("source") == k, p).otherwise(source)
    vectors = v.select(F.col("vec_id").alias("_v"), F.col("embedding").alias("vector"))
    docs = d.select(source.alias("source"), F.col("doc_id").alias("document_id"), F.col("lang").alias("title"), F.col("text").alias("description"), F.array("lang").alias("tags"), "text")
    return docs.join(vectors, F.col("document_id") == F.col("_v")).drop("_v")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("_v"), F.col("embedding").alias("q"))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text").join(v, F.col("query_id") == F.col("_v")).drop("_v")


_CASE = "CASE source " + " ".join(f"WHEN '{k}' THEN '{p}'" for k, p in _SOURCES.items()) + " ELSE 'historical_incident' END"
_ORDER = "[" + ", ".join(f"'{p}'" for p in search.PROVIDERS) + "]"
_DISTANCE = "list_sum(list_transform(range(1, 65), lambda i: (v.e[i] - u.e[i]) * (v.e[i] - u.e[i])))"
_SEARCH = f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), c AS (SELECT {_CASE} AS source, doc_id, lang, text, e FROM documents JOIN e ON vec_id = doc_id), {tokens_sql("d", "c", "doc_id")},
x AS (SELECT item_id, text, lower(coalesce(text, '')) AS t, e FROM benchmark JOIN e ON vec_id = item_id), {tokens_sql("b", "x", "item_id")},
w AS (SELECT item_id, list_filter({ROUTE_SQL}, lambda p: list_contains(have, p)) AS ps FROM x, (SELECT list(DISTINCT source) AS have FROM c)), a AS (SELECT item_id, unnest(CASE WHEN len(ps) > 0 THEN ps ELSE ['attack'] END) AS source FROM w),
z AS (SELECT a.item_id, a.source, doc_id, {_DISTANCE} AS distance FROM a JOIN x u ON u.item_id = a.item_id JOIN c v ON v.source = a.source),
y AS (SELECT *, row_number() OVER (PARTITION BY item_id, source ORDER BY distance, doc_id) AS p FROM z QUALIFY p <= 5),
p AS (SELECT source, doc_id, unnest(d.t) AS term, len(d.t) AS length FROM d JOIN c USING (doc_id)), s AS (SELECT source, count(*) AS n, avg(len(d.t)) AS mean FROM d JOIN c USING (doc_id) GROUP BY 1),
f AS (SELECT source, term, count(*) AS df FROM p GROUP BY 1, 2), q AS (SELECT item_id, source, unnest(b.t) AS term FROM b JOIN a USING (item_id)),
h AS (SELECT item_id, source, doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * length / mean))) AS score FROM q JOIN p USING (source, term) JOIN f USING (source, term) JOIN s USING (source) GROUP BY 1, 2, 3),
l AS (SELECT *, row_number() OVER (PARTITION BY item_id, source ORDER BY round(score, 9) DESC, doc_id) AS p FROM h QUALIFY p <= 5),
rd AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY list_position({_ORDER}, source), p) AS rank FROM y), rl AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY list_position({_ORDER}, source), p) AS rank FROM l),
m AS (SELECT coalesce(rd.item_id, rl.item_id) AS item_id, coalesce(rd.source, rl.source) AS source, coalesce(rd.doc_id, rl.doc_id) AS doc_id, rd.rank AS a, rl.rank AS b, distance, score,
 coalesce(1.0::DOUBLE / (60 + rd.rank), 0) + coalesce(0.8::DOUBLE / (60 + rl.rank), 0) AS rrf FROM rd FULL JOIN rl ON rd.item_id = rl.item_id AND rd.source = rl.source AND rd.doc_id = rl.doc_id),
o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rrf DESC, coalesce(distance, 999), coalesce(score, 0) DESC, doc_id DESC) AS place FROM m QUALIFY place <= 5)
SELECT item_id AS query_id, CAST(place AS INT) AS rank, o.source, o.doc_id AS document_id, round(rrf, 9) AS rrf, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 'hybrid' WHEN a IS NOT NULL THEN 'dense' ELSE 'lexical' END AS method,
round(least(1, CASE o.source WHEN 'attack' THEN 1.0 WHEN 'sigma' THEN 0.8 ELSE 0.95 END + 0.2 + 0.1 * ((CASE WHEN length(text) > 0 THEN 1 ELSE 0 END + 1) / 4))::DOUBLE, 4) AS trust_score, 'fresh' AS freshness_category, '[' || o.source || ':' || o.doc_id || ']' AS citation
FROM o JOIN c ON c.doc_id = o.doc_id"""


@query(_SEARCH)
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best documents of all providers for each passage."""
    out = search.search(_asked(spark, sf_dir), _corpus(spark, sf_dir), F.col("text"), "vector", now=F.lit("2024-06-01").cast("timestamp"))
    return out.select("query_id", "rank", "source", "document_id", F.round("rrf", 9).alias("rrf"), "method", "trust_score", "freshness_category", "citation")


def _incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    return d.select(
        i.alias("incident_id"), F.concat(F.lit("threat "), "lang").alias("resolved_threat"), F.col("text").alias("attack_summary"), F.array(F.upper("lang"), "source").alias("tags"), (i % 100 / 100).alias("unified_threat_score"),
        F.when(i % 3 == 0, F.array(F.lit("t1059"))).alias("attack_techniques"), F.when(i % 2 == 0, F.array(F.lit("G1"), F.lit("G2"))).alias("threat_groups"), F.array(F.lit("a"), F.lit("b")).alias("timeline"), F.when(i % 5 == 0, 0.5).alias("confidence"),
    )


@query("""SELECT doc_id AS incident_id, 'threat ' || lang AS title, CASE WHEN doc_id % 2 = 0 THEN 'G1, G2' ELSE 'Unknown' END AS threat_actor, 'a | b' AS timeline_summary, CASE WHEN doc_id % 5 = 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS confidence,
'Resolved' AS containment_status, 'Historical Incident Recall: ' || doc_id AS citation, 'bm25_search' AS relationship_source FROM documents WHERE lang IN ('de', 'fr') AND doc_id % 100 / 100::DOUBLE >= 0.3 AND doc_id % 3 = 0""")
def incident_memory_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Past incidents that meet filters, in the standard schema."""
    few = memory.complete(_incidents(spark, sf_dir)).filter(memory.meets(["DE", "Fr"], 0.3, "T1059"))
    out = memory.standard(few, F.lit(memory.LEXICAL))
    return out.select("incident_id", "title", "threat_actor", "timeline_summary", "confidence", "containment_status", "citation", "relationship_source")


@query("""WITH i AS (SELECT doc_id, lang, 't' || doc_id AS ts FROM documents) SELECT doc_id AS incident_id, CASE WHEN doc_id % 4 = 0 THEN 'new' ELSE lang END AS resolved_threat, ts AS timestamp FROM i WHERE doc_id % 7 != 0 UNION ALL SELECT -1, 'added', 'now'""")
def incident_memory_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents inserted, updated (keeping their time) and deleted."""
    i = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("incident_id"), F.col("lang").alias("resolved_threat"), F.concat(F.lit("t"), F.col("doc_id").cast("string")).alias("timestamp"))
    changed = i.filter("incident_id % 4 = 0").select("incident_id", F.lit("new").alias("resolved_threat")).unionByName(spark.range(1).select(F.lit(-5).cast("long").alias("incident_id"), F.lit("nobody").alias("resolved_threat")))
    added = spark.range(1).select(F.lit(-1).cast("long").alias("incident_id"), F.lit("added").alias("resolved_threat"), F.lit("now").alias("timestamp"))
    out = memory.insert(memory.delete(memory.update(i, changed), i.filter("incident_id % 7 = 0")), added, F.current_timestamp())
    return out.select("incident_id", "resolved_threat", "timestamp")


_STORED = "SELECT doc_id, doc_id % 100 / 100::DOUBLE AS s, CASE WHEN doc_id % 5 = 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS sure, e, concat_ws(' ', 'threat ' || lang, text, CASE WHEN doc_id % 3 = 0 THEN 't1059' ELSE '' END, upper(lang) || ' ' || source) AS text FROM documents JOIN e ON vec_id = doc_id"


@query(f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), c AS ({_STORED}), {tokens_sql("d", "c", "doc_id")}, x AS (SELECT item_id, text, e FROM benchmark JOIN e ON vec_id = item_id), {tokens_sql("b", "x", "item_id")},
z AS (SELECT item_id, doc_id, {_DISTANCE} AS distance FROM x u, c v WHERE s >= 0.5), y AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY distance, doc_id) AS rank FROM z QUALIFY rank <= 3),
p AS (SELECT doc_id, unnest(t) AS term, len(t) AS length FROM d), n AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM d), f AS (SELECT term, count(*) AS df FROM p GROUP BY 1), q AS (SELECT item_id, unnest(t) AS term FROM b),
h AS (SELECT item_id, p.doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * length / mean))) AS score FROM q JOIN p USING (term) JOIN f USING (term) JOIN c ON c.doc_id = p.doc_id, n WHERE s >= 0.5 GROUP BY 1, 2),
l AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM h QUALIFY rank <= 3),
m AS (SELECT coalesce(y.item_id, l.item_id) AS item_id, coalesce(y.doc_id, l.doc_id) AS doc_id, y.rank AS a, l.rank AS b, distance, score FROM y FULL JOIN l ON y.item_id = l.item_id AND y.doc_id = l.doc_id),
r AS (SELECT m.*, coalesce(1.0::DOUBLE * sure / (60 + a), 0) + coalesce(0.8::DOUBLE * sure / (60 + b), 0) AS rrf FROM m JOIN c USING (doc_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rrf DESC, coalesce(distance, 999), coalesce(score, 0) DESC, doc_id DESC) AS place FROM r QUALIFY place <= 3)
SELECT item_id AS query_id, CAST(place AS INT) AS rank, doc_id AS incident_id, round(rrf, 9) AS rrf, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 'hybrid' WHEN a IS NOT NULL THEN 'dense' ELSE 'lexical' END AS method, 'Historical Incident Recall: ' || doc_id AS citation FROM o""")
def incident_memory_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best past incidents for each passage among those above a score."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("_v"), F.col("embedding").alias("vector"))
    i = _incidents(spark, sf_dir).join(v, F.col("incident_id") == F.col("_v")).drop("_v")
    out = memory.search(_asked(spark, sf_dir), i, "vector", 3, memory.meets(least_score=0.5))
    return out.select("query_id", "rank", "incident_id", F.round("rrf", 9).alias("rrf"), "method", "citation")


def _contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    id = lambda p, x: F.concat(F.lit(p), F.col(x).cast("string"))
    k = F.col("c_custkey")
    kind = F.element_at(F.array(*map(F.lit, ["NETWORK", "IDENTITY", "ENDPOINT", "OT"])), (k % 4 + 1).cast("int"))
    edges = c.select(id("user:n", "c_nationkey").alias("src"), id("host:c", "c_custkey").alias("dst"), F.lit("has").alias("type"), k.cast("long").alias("us"), (k % 100 / 100).alias("risk"), (0.5 + k % 5 / 10).alias("confidence"), kind.alias("source_detector"))
    edges = edges.unionByName(n.select(id("plc:r", "n_regionkey").alias("src"), id("user:n", "n_nationkey").alias("dst"), F.lit("has").alias("type"), F.col("n_nationkey").cast("long").alias("us"), F.lit(0.0).alias("risk"), F.lit(1.0).alias("confidence"), F.lit("NETWORK").alias("source_detector")))
    nodes = edges.select(F.col("src").alias("node_id")).union(edges.select("dst")).distinct().select("node_id", F.split("node_id", ":")[0].alias("type"), F.lit(0.25).alias("risk"), F.lit("LOW").alias("severity"))
    asked = n.select(id("user:n", "n_nationkey").alias("entity")).unionByName(spark.range(1).select(F.lit("user:zz").alias("entity")))
    return context.build(nodes, edges, asked)


@query("""WITH e AS (SELECT 'user:n' || c_nationkey AS src, 'host:c' || c_custkey AS dst, CAST(c_custkey AS BIGINT) AS us, c_custkey % 100 / 100::DOUBLE AS risk, 0.5 + c_custkey % 5 / 10::DOUBLE AS conf, c_custkey % 4 AS d FROM customer
 UNION ALL SELECT 'plc:r' || n_regionkey, 'user:n' || n_nationkey, CAST(n_nationkey AS BIGINT), 0, 1, 0 FROM nation),
u AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), s AS (SELECT 'user:n' || n_nationkey AS entity FROM nation),
w AS (SELECT entity, entity AS node, 0 AS depth FROM s UNION ALL SELECT entity, b, 1 FROM s JOIN u ON a = entity UNION ALL SELECT DISTINCT entity, y.b, 2 FROM s JOIN u x ON x.a = entity JOIN u y ON y.a = x.b),
m AS (SELECT entity, node, min(depth) AS depth FROM w GROUP BY 1, 2), t AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY entity ORDER BY depth, node) <= 50),
f AS (SELECT t.entity, e.* FROM e JOIN t ON t.node = e.src JOIN t v ON v.node = e.dst AND v.entity = t.entity QUALIFY row_number() OVER (PARTITION BY t.entity ORDER BY us, src, dst) <= 100),
g AS (SELECT entity, count(*) AS events, avg(conf) AS conf, max(CASE WHEN d = 0 THEN risk END) AS network, max(CASE WHEN d = 3 THEN risk END) AS ot, (max(us) - min(us)) / 60000000 AS activity FROM f GROUP BY 1)
SELECT s.entity, true AS found, (SELECT count(*) - 1 FROM t WHERE t.entity = s.entity) AS related, events, CASE WHEN conf < 0.5 THEN 'Low' WHEN conf < 0.8 THEN 'Medium' ELSE 'High' END AS confidence_summary, round(network, 6) AS network_score, round(coalesce(ot, 0), 6) AS ot_score, round(activity, 9) AS temporal_activity
FROM s JOIN g USING (entity) UNION ALL SELECT 'user:zz', false, 0, 0, 'N/A (No events)', 0, 0, 0""")
def context_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts of all nations, and of an entity that is not there."""
    c = _contexts(spark, sf_dir)
    n = F.when(F.col("related_events").isNull(), 0).otherwise(F.size("related_events")).cast("long")
    return c.select("entity", "found", F.size("related_entities").cast("long").alias("related"), n.alias("events"), "confidence_summary", F.round("network_score", 6).alias("network_score"), F.round("ot_score", 6).alias("ot_score"), F.round("temporal_activity", 9).alias("temporal_activity"))


@query("SELECT 'user:n' || n_nationkey AS entity, true AS titled, true AS whole FROM nation UNION ALL SELECT 'user:zz', true, false")
def context_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts rendered: whether title and timeline are there (texts are tested on examples)."""
    m = _contexts(spark, sf_dir).select("entity", context.markdown().alias("m"))
    return m.select("entity", F.col("m").startswith(F.concat(F.lit("# Correlation Security Context: "), "entity")).alias("titled"), (F.col("m").contains("1. **[") & ~F.col("m").contains("No timeline")).alias("whole"))
