"""Queries on graph operators: customers, orders' priorities and nations make the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as op
from .registry import EVENTS_SQL, events, query, table

_ROWS = f"""{EVENTS_SQL}, top AS (SELECT max(value) AS t FROM e),
v AS (SELECT CASE event_type WHEN 'error' THEN 'ENDPOINT' WHEN 'click' THEN 'NETWORK' WHEN 'view' THEN 'IDENTITY' WHEN 'signup' THEN 'OT' END AS detector, 'e' || user_id AS entity, 't' || k AS target, value / t AS risk, us,
 CASE WHEN k < 25 THEN 'LOW' WHEN k < 75 THEN 'HIGH' ELSE 'CRITICAL' END AS severity, CASE WHEN k % 2 = 0 THEN 'FV' ELSE 'T' END || k AS variable FROM e, top WHERE event_type != 'purchase'),
n AS (SELECT CASE detector WHEN 'IDENTITY' THEN 'user:' WHEN 'OT' THEN 'plc:' ELSE 'host:' END || entity AS node_id, risk, severity, us FROM v
 UNION ALL SELECT CASE WHEN detector IN ('NETWORK', 'IDENTITY') THEN 'host:' || target WHEN detector = 'ENDPOINT' THEN 'process:' || target WHEN variable LIKE 'FV%' THEN 'actuator:' || variable ELSE 'sensor:' || variable END, CASE WHEN detector IN ('NETWORK', 'IDENTITY') THEN risk * 0.5 ELSE risk END, severity, us FROM v)"""


def evidence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as evidence."""
    e = events(spark, sf_dir)
    top = e.agg(F.max("value").alias("t"))
    kind, k = F.col("event_type"), F.col("k")
    detector = F.when(kind == "error", "ENDPOINT").when(kind == "click", "NETWORK").when(kind == "view", "IDENTITY").when(kind == "signup", "OT")
    severity = F.when(k < 25, "LOW").when(k < 75, "HIGH").otherwise("CRITICAL")
    ks = k.cast("string")
    return e.join(F.broadcast(top)).select(detector.alias("detector"), F.concat(F.lit("e"), F.col("user_id").cast("string")).alias("entity"), F.concat(F.lit("t"), ks).alias("target"), F.concat(F.lit("t"), ks).alias("process"), F.concat(F.when(k % 2 == 0, "FV").otherwise("T"), ks).alias("variable"), (F.col("value") / F.col("t")).alias("risk_score"), F.lit(0.9).alias("confidence"), severity.alias("severity"), "us")


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.extract(evidence_rows(spark, sf_dir))


@query(f"WITH {_ROWS} SELECT node_id, round(max(risk), 6) AS risk, CASE max(CASE severity WHEN 'LOW' THEN 1 WHEN 'HIGH' THEN 2 ELSE 3 END) WHEN 1 THEN 'LOW' WHEN 2 THEN 'HIGH' ELSE 'CRITICAL' END AS severity, min(us) AS first_seen, max(us) AS last_seen, count(*) AS observations FROM n GROUP BY node_id")
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes merged from evidence."""
    n = op.merge_nodes(_rows(spark, sf_dir))
    return n.select("node_id", F.round("risk", 6).alias("risk"), "severity", "first_seen", "last_seen", "observations")


@query(f"""WITH {_ROWS} SELECT CASE detector WHEN 'IDENTITY' THEN 'user:' WHEN 'OT' THEN 'plc:' ELSE 'host:' END || entity AS src,
 CASE WHEN detector IN ('NETWORK', 'IDENTITY') THEN 'host:' || target WHEN detector = 'ENDPOINT' THEN 'process:' || target WHEN variable LIKE 'FV%' THEN 'actuator:' || variable ELSE 'sensor:' || variable END AS dst, count(*) AS occurrence_count, min(us) AS first_seen, max(us) AS last_seen, min(detector) AS source_detector FROM v GROUP BY 1, 2""")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges merged from evidence."""
    return op.merge_edges(_rows(spark, sf_dir)).select("src", "dst", "occurrence_count", "first_seen", "last_seen", "source_detector")


_G = "g AS (SELECT 'n' || c_nationkey AS src, 'c' || c_custkey AS dst FROM customer UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation)"
_V = f"{_G}, v AS (SELECT DISTINCT unnest([src, dst]) AS node_id FROM g)"


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges: regions to nations to all their customers."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    id = lambda p, x: F.concat(F.lit(p), F.col(x).cast("string"))
    edges = c.select(id("n", "c_nationkey").alias("src"), id("c", "c_custkey").alias("dst")).unionByName(n.select(id("r", "n_regionkey").alias("src"), id("n", "n_nationkey").alias("dst")))
    nodes = edges.select(F.col("src").alias("node_id")).union(edges.select("dst")).distinct()
    return nodes, edges


@query(f"WITH {_V}, d AS (SELECT x AS node_id, count(*) AS degree FROM (SELECT unnest([src, dst]) AS x FROM g) GROUP BY 1) SELECT node_id, degree, round(degree / ((SELECT count(*) FROM v) - 1), 9) AS centrality FROM d")
def graph_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees and degree centrality."""
    return op.degrees(*_graph(spark, sf_dir)).select("node_id", "degree", F.round("centrality", 9).alias("centrality"))


@query(f"WITH {_ROWS}, m AS (SELECT node_id, max(risk) AS r FROM n GROUP BY 1) SELECT CASE WHEN r >= 0.8 THEN 'critical' WHEN r >= 0.5 THEN 'high' WHEN r >= 0.2 THEN 'medium' ELSE 'low' END AS bin, count(*) AS n FROM m GROUP BY 1")
def graph_risk_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes by risk."""
    return op.risk_bins(op.merge_nodes(_rows(spark, sf_dir)))


@query(f"WITH {_G} SELECT dst AS node_id FROM g WHERE src = 'n3' UNION SELECT src FROM g WHERE dst = 'n3'")
def graph_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of a node."""
    return op.neighbours(_graph(spark, sf_dir)[1], F.lit("n3"))


_U = f"{_G}, u AS (SELECT src AS a, dst AS b FROM g UNION SELECT dst, src FROM g)"


@query(f"WITH RECURSIVE {_U}, w AS (SELECT 'n3' AS node_id, 0 AS depth UNION SELECT b, depth + 1 FROM w JOIN u ON a = node_id WHERE depth < 2) SELECT node_id, min(depth) AS depth FROM w GROUP BY node_id")
def graph_ego(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes within two steps."""
    _, edges = _graph(spark, sf_dir)
    return op.ego(edges, spark.range(1).select(F.lit("n3").alias("node_id")), 2)


@query(f"WITH RECURSIVE {_U}, w AS (SELECT 'c1' AS node_id, 0 AS len UNION SELECT b, len + 1 FROM w JOIN u ON a = node_id WHERE len < 6) SELECT node_id, min(len) AS length FROM w GROUP BY node_id")
def graph_shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of shortest paths from a node."""
    _, edges = _graph(spark, sf_dir)
    return op.shortest_paths(edges, spark.range(1).select(F.lit("c1").alias("node_id"))).select("node_id", "length")


@query(f"WITH RECURSIVE {_U}, w AS (SELECT node_id, node_id AS component FROM (SELECT DISTINCT a AS node_id FROM u) UNION SELECT b, component FROM w JOIN u ON a = node_id) SELECT node_id, min(component) AS component FROM w GROUP BY node_id")
def graph_wcc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weakly connected components."""
    return op.components(*_graph(spark, sf_dir))


@query(f"""WITH RECURSIVE {_V}, o AS (SELECT src, count(*) AS out FROM (SELECT DISTINCT src, dst FROM g) GROUP BY src), n AS (SELECT count(*) AS n FROM v),
l AS (SELECT DISTINCT g.src, g.dst, o.out FROM g JOIN o ON o.src = g.src),
p AS (SELECT 0 AS i, node_id, 1.0::DOUBLE / n AS rank FROM v, n
 UNION ALL SELECT p.i + 1, p.node_id, 0.15::DOUBLE / n.n + 0.85::DOUBLE * (coalesce((SELECT sum(q.rank / l.out) FROM p q JOIN l ON l.src = q.node_id WHERE l.dst = p.node_id), 0) + (SELECT sum(q.rank) FROM p q WHERE q.node_id NOT IN (SELECT src FROM o)) / n.n) FROM p, n WHERE p.i < 20)
SELECT node_id, round(rank, 9) AS rank FROM p WHERE i = 20""")
def graph_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PageRank, converged far beyond the digits shown."""
    return op.pagerank(*_graph(spark, sf_dir), tolerance=1e-13).select("node_id", F.round("rank", 9).alias("rank"))


@query(f"""WITH RECURSIVE {_V}, e AS (SELECT DISTINCT src, dst FROM g), n AS (SELECT count(*) AS n FROM v),
p AS (SELECT src AS s, dst AS t, 1 AS len FROM e UNION ALL SELECT s, dst, len + 1 FROM p JOIN e ON src = t),
d AS (SELECT s, t, min(len) AS len FROM p GROUP BY 1, 2), k AS (SELECT d.s, d.t, d.len, count(*) AS paths FROM d JOIN p ON p.s = d.s AND p.t = d.t AND p.len = d.len GROUP BY 1, 2, 3),
b AS (SELECT x.t AS node_id, sum(x.paths * y.paths / z.paths) AS b FROM k x JOIN k y ON y.s = x.t JOIN k z ON z.s = x.s AND z.t = y.t AND z.len = x.len + y.len WHERE x.s != y.t GROUP BY 1),
c AS (SELECT t AS node_id, count(*) AS r, sum(len) AS f FROM d GROUP BY 1)
SELECT node_id, round(coalesce(b, 0) / ((n - 1) * (n - 2)), 12) AS betweenness, round(coalesce(r / f * r / (n - 1), 0), 12) AS closeness FROM v LEFT JOIN b USING (node_id) LEFT JOIN c USING (node_id), n""")
def graph_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Betweenness and closeness of all nodes."""
    c = op.centrality(*_graph(spark, sf_dir))
    return c.select("node_id", F.round("betweenness", 12).alias("betweenness"), F.round("closeness", 12).alias("closeness"))


@query()
def graph_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of all nodes by modularity (tested against a greedy search on small graphs)."""
    return op.communities(*_graph(spark, sf_dir)).select("community", "node_id")


@query(f"WITH {_V} SELECT 'orphan edge' AS problem, count(*) AS n FROM g WHERE dst LIKE 'c%0' OR src LIKE 'c%0' UNION ALL SELECT 'unknown type', (SELECT count(*) FROM v WHERE node_id LIKE 'r%') UNION ALL SELECT 'missing time', (SELECT count(*) FROM v WHERE node_id LIKE 'n%')")
def graph_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with a graph of which parts were taken away."""
    nodes, edges = _graph(spark, sf_dir)
    kept = nodes.withColumns({"type": F.substring("node_id", 1, 1), "first_seen": F.when(~F.col("node_id").startswith("n"), 1), "last_seen": F.lit(1)})
    out = op.validate(kept.filter("node_id not like 'c%0'"), edges, ["n", "c"])
    return out


@query(f"WITH {_G} SELECT src, dst FROM g WHERE src != 'n3' AND dst != 'n3'")
def graph_remove_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges after a node's removal."""
    _, edges = _graph(spark, sf_dir)
    return op.remove_nodes(edges, spark.range(1).select(F.lit("n3").alias("node_id")))


@query(f"WITH {_V} SELECT node_id, substr(node_id, 1, 1) = 'r' AS created FROM v")
def graph_autocreate_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that only edges name."""
    nodes, edges = _graph(spark, sf_dir)
    known = nodes.filter(~F.col("node_id").startswith("r")).withColumn("type", F.lit("known"))
    return op.complete_nodes(known, edges).select("node_id", (F.col("type") != "known").alias("created"))


@query(f"WITH RECURSIVE {_G}, w AS (SELECT src AS start, dst AS spot FROM g WHERE src LIKE 'r%' UNION SELECT start, dst FROM w JOIN g ON src = spot) SELECT start AS node_id, count(*) AS reachable FROM w GROUP BY start")
def graph_blast_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many nodes each region reaches."""
    nodes, edges = _graph(spark, sf_dir)
    return op.blast_radius(edges, nodes.filter(F.col("node_id").startswith("r")))


@query(f"""WITH {_G}, s AS (SELECT src AS a, dst AS b FROM g UNION ALL SELECT dst, src FROM g), o AS (SELECT DISTINCT b, 1 AS depth FROM s WHERE a = 'n3'), t AS (SELECT DISTINCT s.b, 2 AS depth FROM o JOIN s ON s.a = o.b WHERE s.b != 'n3')
SELECT b AS node, min(depth) AS depth FROM (SELECT * FROM o UNION ALL SELECT * FROM t) GROUP BY b""")
def graph_attack_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two steps through a knowledge graph, both ways."""
    _, edges = _graph(spark, sf_dir)
    out = op.attack_neighbourhood(edges.withColumn("relation", F.lit("uses")), spark.range(1).select(F.lit("n3").alias("node_id")))
    return out.select("node", "depth")


@query(f"WITH {_ROWS}, m AS (SELECT node_id, max(risk) AS risk FROM n GROUP BY 1) SELECT node_id, round(risk, 6) AS risk FROM m WHERE risk >= 0.5")
def graph_high_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes from a risk on, highest first."""
    return op.by_risk(op.merge_nodes(_rows(spark, sf_dir)), 0.5).select("node_id", F.round("risk", 6).alias("risk"))


@query(f"WITH {_ROWS}, m AS (SELECT node_id, max(us) AS last_seen FROM n GROUP BY 1), t AS (SELECT max(last_seen) AS now FROM m) SELECT node_id, last_seen FROM m, t WHERE last_seen >= now - 86400000000")
def graph_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes seen in the last day of the data."""
    rows = _rows(spark, sf_dir)
    nodes, edges = op.merge_nodes(rows), op.merge_edges(rows)
    now = nodes.agg(F.max("last_seen").alias("now"))
    found = op.recent(nodes.join(F.broadcast(now)), edges.join(F.broadcast(now)), F.col("now"), 1440)
    return found.filter("kind = 'node'").select(F.col("id").alias("node_id"), "last_seen")


@query(f"""WITH {_ROWS}, g AS (SELECT CASE detector WHEN 'IDENTITY' THEN 'user:' WHEN 'OT' THEN 'plc:' ELSE 'host:' END || entity AS src,
 CASE WHEN detector IN ('NETWORK', 'IDENTITY') THEN 'host:' || target WHEN detector = 'ENDPOINT' THEN 'process:' || target WHEN variable LIKE 'FV%' THEN 'actuator:' || variable ELSE 'sensor:' || variable END AS dst, min(detector) AS d FROM v GROUP BY 1, 2)
SELECT src, dst FROM g WHERE d = 'IDENTITY'""")
def graph_by_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that one detector established."""
    return op.by_detector(op.merge_edges(_rows(spark, sf_dir)), "identity").select("src", "dst")


@query(f"WITH {_V} SELECT node_id FROM v WHERE node_id LIKE 'n%'")
def graph_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of one type."""
    nodes, _ = _graph(spark, sf_dir)
    return op.by_type(nodes.withColumn("type", F.substring("node_id", 1, 1)), "N").select("node_id")


@query(f"WITH RECURSIVE {_U}, w AS (SELECT 'r1' AS node_id, 0 AS depth UNION SELECT b, depth + 1 FROM w JOIN u ON a = node_id WHERE depth < 1), s AS (SELECT DISTINCT node_id FROM w) SELECT src || ' --[has]--> ' || dst AS description FROM g WHERE src IN (SELECT node_id FROM s) AND dst IN (SELECT node_id FROM s)")
def graph_attack_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the edges around a node."""
    nodes, edges = _graph(spark, sf_dir)
    told = edges.withColumns({"type": F.lit("has"), "last_seen": F.lit(0), "risk": F.lit(0.0)})
    return op.attack_chain(nodes, told, spark.range(1).select(F.lit("r1").alias("node_id")), 1)[1].select("description")


@query(f"WITH {_V}, c AS (SELECT node_id AS id, ascii(substr(node_id, 1, 1)) AS criticality FROM v), s AS (SELECT * FROM c ORDER BY id LIMIT 80), l AS (SELECT DISTINCT src, dst FROM g ORDER BY src, dst LIMIT 140) SELECT 'edge' AS part, src || '>' || dst AS what FROM l WHERE src IN (SELECT id FROM s) AND dst IN (SELECT id FROM s) UNION ALL SELECT 'path', id FROM (SELECT id FROM s ORDER BY criticality DESC, id LIMIT 3) UNION ALL SELECT 'node', id FROM s")
def dashboard_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a dashboard draws of a graph (the view's own limits)."""
    nodes, edges = _graph(spark, sf_dir)
    shown, links, path = op.topology(nodes.select(F.col("node_id").alias("id"), F.ascii(F.substring("node_id", 1, 1)).alias("criticality")), edges)
    part = lambda df, name, x: df.select(F.lit(name).alias("part"), x.alias("what"))
    return part(links, "edge", F.concat("src", F.lit(">"), "dst")).unionByName(part(path, "path", F.col("id"))).unionByName(part(shown, "node", F.col("id")))


@query(f"""WITH {_G}, s AS (SELECT src AS a, dst AS b, 'uses' AS relation FROM g UNION ALL SELECT dst, src, 'reverse-uses' FROM g),
o AS (SELECT b, 1 AS depth, relation, 'n3>' || b AS path FROM s WHERE a = 'n3'), t AS (SELECT s.b, 2 AS depth, s.relation, o.path || '>' || s.b AS path FROM o JOIN s ON s.a = o.b WHERE s.b != 'n3'),
w AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY depth, path, relation) AS p FROM (SELECT * FROM o UNION ALL SELECT * FROM t) QUALIFY p = 1),
k AS (SELECT *, CASE substr(b, 1, 1) WHEN 'c' THEN 'software' WHEN 'r' THEN 'groups' ELSE 'campaigns' END AS category FROM w)
SELECT category, count(*) AS n, CAST(sum(depth) AS BIGINT) AS depths, max(relation) AS relation, round(min(greatest(0.1, 1 - 0.2 * depth))::DOUBLE, 2) AS least FROM k GROUP BY category""")
def graph_attack_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A knowledge-graph walk by category, with labels and confidences."""
    nodes, edges = _graph(spark, sf_dir)
    walked = op.attack_neighbourhood(edges.withColumn("relation", F.lit("uses")), spark.range(1).select(F.lit("n3").alias("node_id")))
    first = F.substring("node_id", 1, 1)
    known = nodes.select("node_id", F.col("node_id").alias("external_id"), F.col("node_id").alias("name"), F.when(first == "c", "tool").when(first == "r", "group").otherwise("campaign").alias("type"))
    e = op.categories(walked, known).select("category", F.explode("entities").alias("e"))
    return e.groupBy("category").agg(F.count("*").alias("n"), F.sum("e.depth").alias("depths"), F.max("e.relation").alias("relation"), F.min("e.confidence").alias("least"))


@query(f"WITH {_ROWS} SELECT node_id, round(max(risk), 6) AS risk, CASE max(CASE severity WHEN 'LOW' THEN 1 WHEN 'HIGH' THEN 2 ELSE 3 END) WHEN 1 THEN 'LOW' WHEN 2 THEN 'HIGH' ELSE 'CRITICAL' END AS severity, min(us) AS first_seen, max(us) AS last_seen, count(*) AS observations FROM n GROUP BY node_id")
def graph_nodes_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes merged in two batches of evidence."""
    rows = _rows(spark, sf_dir)
    early = F.pmod(F.xxhash64("us"), F.lit(2)) == 0
    n = op.update_nodes(op.merge_nodes(rows.filter(early)), op.merge_nodes(rows.filter(~early)))
    return n.select("node_id", F.round("risk", 6).alias("risk"), "severity", "first_seen", "last_seen", "observations")


@query(f"""WITH {_ROWS} SELECT CASE detector WHEN 'IDENTITY' THEN 'user:' WHEN 'OT' THEN 'plc:' ELSE 'host:' END || entity AS src,
 CASE WHEN detector IN ('NETWORK', 'IDENTITY') THEN 'host:' || target WHEN detector = 'ENDPOINT' THEN 'process:' || target WHEN variable LIKE 'FV%' THEN 'actuator:' || variable ELSE 'sensor:' || variable END AS dst, count(*) AS occurrence_count, min(us) AS first_seen, max(us) AS last_seen FROM v WHERE detector != 'NETWORK' GROUP BY 1, 2""")
def graph_edges_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges merged in two batches, then some of them removed."""
    rows = _rows(spark, sf_dir)
    early = F.pmod(F.xxhash64("us"), F.lit(2)) == 0
    e = op.update_edges(op.merge_edges(rows.filter(early)), op.merge_edges(rows.filter(~early)))
    return op.remove_edges(e, e.filter("type = 'connects_to'").select("src", "dst", "type")).select("src", "dst", "occurrence_count", "first_seen", "last_seen")


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'stix' || n_nationkey END AS stix_id FROM nation")
def attack_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits joined to the knowledge graph by technique, whatever its case."""
    from ..operators.retrieval import attack_lookup as lookup

    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey").cast("string")
    nodes = n.filter("n_nationkey % 2 = 0").select(F.concat(F.lit("T"), k).alias("external_id"), F.concat(F.lit("stix"), k).alias("node_id"), F.col("n_name").alias("name"))
    return lookup(n.select("n_nationkey", F.concat(F.lit("t"), k).alias("technique")), nodes, "technique").select("n_nationkey", "stix_id")
