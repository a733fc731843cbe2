"""Queries that write with a sink, read back with a source, and compare what comes back."""

from __future__ import annotations

import json
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sinks, sources
from ..functions import scoring
from ..operators import endpoint, graph, identity, industrial, network, response, retrieval
from .registry import events, query, table


def _folder(df: DataFrame, name: str) -> str:
    return f"{sinks.shared_dir(df)}/{name}-{uuid.uuid4().hex}"


@query("SELECT user_id, count(*) AS n, CAST(sum(epoch_us(ts) // 1000000) AS BIGINT) AS times FROM events WHERE event_id % 5 != 0 GROUP BY user_id")
def source_events_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headerless authentication lines, some with too few fields, read back."""
    e = events(spark, sf_dir)
    path = _folder(e, "auth")
    time = F.floor(F.col("us") / 1_000_000).cast("string")
    line = F.when(F.col("event_id") % 5 == 0, F.concat_ws(",", time, F.col("user_id").cast("string"))).otherwise(F.concat_ws(",", time, F.col("user_id").cast("string"), F.concat(F.lit("C"), F.col("k").cast("string"))))
    e.select(line.alias("value")).write.option("compression", "bzip2").text(path)
    back = sources.read_events_csv(spark, path)
    return back.groupBy(F.col("user").cast("long").alias("user_id")).agg(F.count("*").alias("n"), F.sum("time").alias("times"))


_STIX = """k AS (SELECT p_partkey AS k, p_partkey % 7 AS m FROM part),
v AS (SELECT k, m, CASE m WHEN 0 THEN 'technique' WHEN 1 THEN 'sub-technique' WHEN 2 THEN 'group' WHEN 3 THEN 'mitigation' WHEN 4 THEN 'tactic' WHEN 5 THEN 'data-source' ELSE 'campaign' END AS type,
 CASE WHEN m = 4 AND (k % 2 = 0 OR k % 5 = 0) THEN 'short' || k WHEN k % 5 = 0 THEN NULL ELSE 'T' || k END AS external_id FROM k)"""


def _bundle(spark: SparkSession, sf_dir: str) -> str:
    """A knowledge bundle of parts: objects of seven types, other references first, links to the part before."""
    n = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    k, m = F.col("k"), F.col("k") % 7
    text = lambda head, x=k: F.concat(F.lit(head), x.cast("string"))
    kinds = ["attack-pattern", "attack-pattern", "intrusion-set", "course-of-action", "x-mitre-tactic", "x-mitre-data-source"]
    kind = F.lit("campaign")
    for i, name in enumerate(kinds):
        kind = F.when(m == i, name).otherwise(kind)
    own = F.when((m != 4) | (k % 2 == 1), F.when(k % 5 != 0, F.struct(F.lit("mitre-attack").alias("source_name"), text("T").alias("external_id"))))
    refs = F.array_compact(F.array(F.struct(F.lit("capec").alias("source_name"), text("CAPEC-").alias("external_id")), own))
    phases = F.when(m < 2, F.array(F.struct(F.lit("impact").alias("phase_name"))))
    node = F.struct(text("o").alias("id"), kind.alias("type"), text("name ").alias("name"), refs.alias("external_references"), (m == 1).alias("x_mitre_is_subtechnique"), F.when(m == 4, text("short")).alias("x_mitre_shortname"), F.when(m < 2, F.array(F.lit("Linux"), F.lit("Windows"))).alias("x_mitre_platforms"), phases.alias("kill_chain_phases"))
    link = F.struct(text("r").alias("id"), F.lit("relationship").alias("type"), F.when(m == 1, "subtechnique-of").otherwise("uses").alias("relationship_type"), text("o").alias("source_ref"), F.when(k % 11 == 0, "nowhere").otherwise(text("o", k - 1)).alias("target_ref"))
    odd = F.struct(text("i").alias("id"), F.when(k % 2 == 0, "identity").alias("type"))
    objects = F.concat(*[F.array(F.to_json(x)) for x in (node, link, odd)])
    path = _folder(n, "stix")
    # Each file is a bundle of 500 parts.
    lines = n.select(F.floor(k / 500).alias("g"), F.explode(objects).alias("o")).groupBy("g").agg(F.concat(F.lit('{"objects": ['), F.array_join(F.collect_list("o"), ", "), F.lit("]}")).alias("value"))
    lines.select("g", "value").repartition("g").write.partitionBy("g").text(path)
    return path


@query(f"""WITH {_STIX} SELECT 'o' || k AS node_id, external_id, 'name ' || k AS name, type, CASE WHEN m < 2 THEN 'Linux,Windows' ELSE '' END AS platforms, CASE WHEN m < 2 THEN 'impact' ELSE '' END AS phases, CASE WHEN k > (SELECT min(k) FROM v) AND k % 11 != 0 THEN 'o' || (k - 1) END AS linked FROM v""")
def source_stix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A knowledge bundle written as JSON and read as nodes, each with the one that it is linked to;
    links to nowhere are left out."""
    nodes, edges = sources.read_stix(spark, _bundle(spark, sf_dir))
    found = nodes.join(edges.select(F.col("src").alias("node_id"), F.col("dst").alias("linked")), "node_id", "left")
    return found.select("node_id", "external_id", "name", "type", F.array_join("platforms", ",").alias("platforms"), F.array_join("phase_names", ",").alias("phases"), "linked")


@query(f"""WITH {_STIX}, s AS (SELECT k AS a, k - 1 AS b, CASE WHEN m = 1 THEN 'subtechnique-of' ELSE 'uses' END AS r FROM v WHERE k > (SELECT min(k) FROM v) AND k % 11 != 0),
u AS (SELECT a, b, r FROM s UNION ALL SELECT b, a, 'reverse-' || r FROM s), w AS (SELECT a AS start, b AS node, 1 AS depth, r FROM u UNION ALL SELECT x.a, y.b, 2, y.r FROM u x JOIN u y ON x.b = y.a AND y.b != x.a),
c AS (SELECT start, node, depth, r, CASE WHEN type = 'group' THEN 'groups' WHEN type = 'mitigation' THEN 'mitigations' WHEN type = 'campaign' THEN 'campaigns' WHEN type = 'tactic' THEN 'tactics' WHEN type = 'sub-technique' THEN 'subtechniques' WHEN type = 'technique' AND r = 'subtechnique-of' THEN 'parent_technique' END AS category, external_id FROM w JOIN v ON v.k = node)
SELECT 'o' || start AS start, category, count(*) AS n, string_agg(coalesce(external_id, '-'), ',' ORDER BY depth, external_id NULLS FIRST, node) AS ids FROM c WHERE category IS NOT NULL GROUP BY 1, 2""")
def stix_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies within two steps of each object of a bundle, by category."""
    nodes, edges = sources.read_stix(spark, _bundle(spark, sf_dir))
    found = graph.categories(graph.attack_neighbourhood(edges, nodes.select("node_id")), nodes)
    return found.select("start", "category", F.size("entities").cast("long").alias("n"), F.array_join(F.transform("entities", lambda x: F.coalesce(x["id"], F.lit("-"))), ",").alias("ids"))


@query("SELECT CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'T' || n_nationkey END AS title, 'T' || n_nationkey AS document_id, CASE WHEN n_nationkey % 3 = 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS confidence, 'unknown' AS entity_type, '1.0' AS version, 0 AS n_tags FROM nation WHERE n_nationkey != 7")
def source_threat_intel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threat intelligence with its defaults; a document without an id is left out."""
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    doc = F.struct(F.when(k != 7, F.concat(F.lit("T"), k.cast("string"))).alias("id"), F.when(k % 2 == 0, F.col("n_name")).alias("name"), F.when(k % 3 == 0, 0.5).alias("confidence"))
    path = _folder(n, "intel")
    n.agg(F.to_json(F.collect_list(doc)).alias("value")).coalesce(1).write.text(path)  # a document of nations
    out = sources.read_threat_intel(spark, path, "cve")
    return out.select("title", "document_id", "confidence", "entity_type", "version", F.size("tags").alias("n_tags"))


@query("SELECT 'nodes' AS part, count(*) AS n, CAST(sum(n_nationkey) AS BIGINT) AS total FROM nation UNION ALL SELECT 'links', count(*), CAST(sum(n_regionkey) AS BIGINT) FROM nation")
def graph_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph exported as node-link JSON and loaded again."""
    n = table(spark, sf_dir, "nation")
    path = _folder(n, "graph")
    sinks.export_node_link(n.select(F.col("n_nationkey").cast("long").alias("id")), n.select(F.col("n_nationkey").alias("source"), F.col("n_regionkey").cast("long").alias("target")), path)
    nodes, links = sources.read_node_link(spark, path)
    return nodes.agg(F.lit("nodes").alias("part"), F.count("*").alias("n"), F.sum("id").alias("total")).unionByName(links.agg(F.lit("links").alias("part"), F.count("*").alias("n"), F.sum("target").alias("total")))


@query("SELECT * FROM (VALUES ('user_id', 'bigint', 'kept'), ('value', 'double', 'changed'), ('event_type', 'string', 'missing')) v(field, kind, state)")
def features_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features written with their contract, and what another frame lacks of it."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("user_id"), "event_type", F.col("value").cast("double").alias("value"))
    contract = sinks.write_features(e, _folder(e, "features"))
    wrong = endpoint.contract_check(e.select("user_id", F.col("value").cast("int").alias("value")), contract)
    state = {f: next((m.split()[0] if m.startswith("missing") else "changed" for m in wrong if f in m), "kept") for f in contract}
    return spark.createDataFrame([(f, k, state[f]) for f, k in contract.items()], "field string, kind string, state string")


@query("SELECT CAST(ts AS DATE)::VARCHAR AS day, count(*) AS n FROM events GROUP BY 1")
def sink_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that no index takes, appended by day and read back."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    path = _folder(e, "daily")

    def unreachable(_df: DataFrame) -> None:
        raise ConnectionError("no index")

    sinks.index_or_append(unreachable, e, path, "ts")
    return spark.read.json(path).groupBy(F.col("date").cast("string").alias("day")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS documents, (SELECT count(*) FROM benchmark WHERE item_id IN (SELECT item_id FROM benchmark)) AS queries FROM documents")
def index_persisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index written, read back, and searched: all documents, and all passages that find something."""
    d, b = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    path = _folder(d, "index")
    sinks.write_index(*retrieval.index(d, "doc_id", "text"), path)
    postings, lengths = sinks.read_index(spark, path)
    found = retrieval.bm25(b.select("item_id", F.explode(retrieval.tokens(F.col("text"))).alias("term")), postings, lengths, "item_id", "doc_id", 1)
    return lengths.agg(F.count("*").alias("documents")).join(found.agg(F.count_distinct("item_id").alias("queries")))


@query("SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2")
def sink_upsert_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upserts appended to a log in two batches; the latest row of each key."""
    e = events(spark, sf_dir).select("user_id", "event_type", "us", "event_id")
    path = _folder(e, "log")
    for part in (0, 1):
        sinks.upsert_log(e.filter(F.col("event_id") % 2 == part), path)
    return sinks.latest(spark.read.parquet(path), ["user_id", "event_type"], ["us", "event_id"]).select("user_id", "event_type", "event_id")


@query("SELECT 'csv' AS format, 3 AS columns, 'ts' IN ('timestamp') AS timed, 'label' AS label_column UNION ALL SELECT 'parquet', 2, false, NULL")
def source_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a folder of data holds, by its files."""
    e = table(spark, sf_dir, "events")
    path = _folder(e, "data")
    few = e.select("event_id", "user_id", F.col("event_type").alias("label"))
    few.coalesce(1).write.option("header", True).option("sep", ";").csv(f"{path}/a")
    few.select("event_id", "user_id").coalesce(1).write.parquet(f"{path}/b")
    m = sources.manifest(spark, path)
    return m.select("format", "columns", F.col("time_column").isNotNull().alias("timed"), "label_column")


@query("WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1), w AS (SELECT event_type, (SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n) AS weight FROM c) SELECT user_id, round(sum(weight), 4) AS weight FROM events JOIN w USING (event_type) GROUP BY user_id")
def network_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows weighted by their class, summed by user."""
    return network.weighted(events(spark, sf_dir), "event_type").groupBy("user_id").agg(F.round(F.sum("weight"), 4).alias("weight"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0.0 WHEN event_id % 3 = 1 THEN 0.0 ELSE value END::DOUBLE AS score, CASE WHEN event_id % 3 != 2 THEN 1.0 ELSE value END::DOUBLE AS confidence, round_even(greatest(0.1, 1 - value / 1000)::DOUBLE, 2) AS dense, round_even(greatest(0.1, 1 - 0.2 * (event_id % 6))::DOUBLE, 2) AS graph FROM events")
def feature_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing and undefined features as their defaults; confidences of dense and graph hits."""
    i = F.col("event_id")
    x = F.when(i % 3 == 0, float("nan")).when(i % 3 == 1, None).otherwise(F.col("value"))
    e = events(spark, sf_dir).withColumns({"a_score": x, "a_confidence": x})
    return e.select("event_id", scoring.clean_feature("a_score").alias("score"), scoring.clean_feature("a_confidence").alias("confidence"), scoring.dense_confidence(F.col("value") / 100).alias("dense"), scoring.graph_confidence(i % 6).alias("graph"))


@query("WITH s AS (SELECT event_id, user_id % 10 / 10::DOUBLE AS a, CASE WHEN event_id % 2 = 0 THEN 0 ELSE 0.5 END::DOUBLE AS p FROM events) SELECT event_id, round(CASE WHEN p > 0 THEN 0.6 * a + 0.4 * p ELSE a END, 6) AS risk, CASE WHEN a >= 0.70 THEN 0.85 ELSE 0.65 END::DOUBLE AS confidence, CASE WHEN user_id % 5 >= 3 THEN 'High' WHEN user_id % 5 >= 1 THEN 'Medium' ELSE 'Low' END AS blast FROM s JOIN events USING (event_id)")
def ot_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk and confidence of industrial scores, and blast levels."""
    a = F.col("user_id") % 10 / 10
    p = F.when(F.col("event_id") % 2 == 0, 0.0).otherwise(0.5)
    return events(spark, sf_dir).select("event_id", F.round(industrial.risk(a, p), 6).alias("risk"), industrial.confidence(industrial.band(a)).alias("confidence"), response.blast_level(F.col("user_id") % 5).alias("blast"))


@query("""WITH f AS (SELECT event_id, event_id % 2 AS enc, event_id % 3 AS lsass, event_id % 12 AS registry, event_id % 7 AS children FROM events)
SELECT event_id, list_filter(list_concat([CASE WHEN enc > 0 THEN 'Encoded command execution observed' END, CASE WHEN lsass > 0 THEN 'LSASS memory access observed' END, CASE WHEN children > 5 THEN 'High process fan-out rate' END, CASE WHEN registry > 10 THEN 'High registry modification rate' END], ['Rule']), lambda x: x IS NOT NULL) AS reasons FROM f""")
def endpoint_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons of windows' features, then matched rules, each once."""
    i = F.col("event_id")
    f = events(spark, sf_dir).select("event_id", (i % 2).alias("encoded_command_flag"), (i % 3).alias("lsass_access_count"), (i % 7).alias("child_process_count"), (i % 12).alias("registry_modification_count"))
    return f.select("event_id", endpoint.reasons(f.columns, F.array(F.lit("Rule"), F.lit("Rule"))).alias("reasons"))


@query("SELECT count(DISTINCT user_id) AS entities, count(DISTINCT event_type) AS metrics, count(DISTINCT (user_id, event_type)) AS baselines FROM events")
def baseline_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many baselines there are."""
    return identity.baseline_counts(events(spark, sf_dir), "user_id", "event_type")


@query("WITH RECURSIVE g AS (SELECT 'n' || n_nationkey AS a, 'r' || n_regionkey AS b FROM nation), u AS (SELECT a, b FROM g UNION SELECT b, a FROM g), w AS (SELECT 'r1' AS node_id, 0 AS depth UNION SELECT b, depth + 1 FROM w JOIN u ON a = node_id WHERE depth < 2) SELECT node_id, min(depth) AS depth FROM w GROUP BY 1 ORDER BY depth, node_id LIMIT 4")
def graph_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four nodes around a region, in breadth-first order (a view's own limit)."""
    n = table(spark, sf_dir, "nation")
    id = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = n.select(id("n", "n_nationkey").alias("src"), id("r", "n_regionkey").alias("dst"))
    return graph.capped(graph.ego(edges, spark.range(1).select(F.lit("r1").alias("node_id")), 2), 4)


#: Settings by default, as a document of JSON, for `settings`.
DEFAULTS = {"graph": {"radius": 2, "nodes": 50}, "threshold": 0.5}


@query("SELECT user_id, count(*) AS n FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) >= 50 GROUP BY user_id")
def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events over the threshold of the settings; without a file these are the defaults."""
    found = sources.load_config("/nowhere/at/all.yaml", DEFAULTS)
    return events(spark, sf_dir).filter(F.col("k") >= 100 * found["threshold"]).groupBy("user_id").agg(F.count("*").alias("n"))


@query("SELECT event_type, CAST(user_id AS VARCHAR) AS user_id, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS ks FROM events GROUP BY 1, 2")
def source_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as members of archives, one a type, in three formats, read back member by member."""
    e = events(spark, sf_dir).select("event_id", "event_type", "user_id", "k")
    root = f"{sinks.shared_dir(e)}/archives-{uuid.uuid4().hex}"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        if not rows:
            return
        store, folder = fs.FileSystem.from_uri(root)
        store.create_dir(folder)
        part = rows[0]["part"]
        with store.open_output_stream(f"{folder}/{part}.zip") as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as archive:
            for kind in sorted({r["event_type"] for r in rows}):
                own = [{"id": r["event_id"], "event": {"type": kind, "user": r["user_id"]}, "k": r["k"]} for r in rows if r["event_type"] == kind]
                if kind == "click":
                    archive.writestr(f"logs/{kind}.csv", "id,event.type,event.user,k\n" + "".join(f"{r['id']},{kind},{r['event']['user']},{r['k']}\n" for r in own))
                elif kind == "view":
                    archive.writestr(f"logs/{kind}.json", json.dumps(own, indent=1))
                else:
                    archive.writestr(f"logs/{kind}.ndjson", "".join(json.dumps(r) + "\n" for r in own))
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64())], ["part"])

    # Archives of about a thousand events, one a task, so no task holds more.
    dealt = e.withColumn("part", F.floor(F.col("event_id") / 1000).cast("long"))
    groups = dealt.groupBy("part").applyInArrow(lambda table: pa.Table.from_batches(pack(iter(table.to_batches()))), "part long")
    groups.count()
    r = F.col("record")
    back = sources.read_archives(spark, root).filter(F.col("path") == F.concat_ws("::", "archive", "member"))
    return back.groupBy(r["event.type"].alias("event_type"), r["event.user"].alias("user_id")).agg(F.count("*").alias("n"), F.sum(r["id"].cast("long")).alias("ids"), F.sum(r["k"].cast("long")).alias("ks"))
