"""Search, contexts, memory, verification, decoys, limits, harness, protocols, sources and sinks on small data."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from arcspan import protocols, sinks, sources, streaming
from arcspan.functions import normalize, scoring
from arcspan.operators import decoys, endpoint, evidence, graph, limits, memory, network, ranks, response, retrieval, verification
from arcspan.plans import context, detection, harness, search


def _one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_running_sums_and_places(spark):
    rows = [(k, k % 7) for k in range(200)]
    df = spark.createDataFrame(rows, "id long, x long")
    got = {r["id"]: (r["s"], r["s_all"]) for r in ranks.running(df, [F.col("x"), F.desc("id")], {"s": F.col("id")}).collect()}
    ordered, total = sorted(rows, key=lambda r: (r[1], -r[0])), 0
    for id, _ in ordered:
        assert got[id] == (total, sum(r[0] for r in rows))
        total += id
    assert ranks.placed(df.filter("false"), [F.col("x")]).count() == 0
    assert {r["_p"] for r in ranks.placed(df, [F.col("x")]).collect()} == set(range(200))


def test_splits_without_and_with_a_key(spark):
    df = spark.createDataFrame([(k, None if k < 20 else "a") for k in range(120)], "id long, g string")
    whole = dict(network.chronological_split(df, ["id"]).groupBy("split").count().collect())
    assert whole == {"train": 84, "validation": 18, "test": 18}
    by = {(r["g"], r["split"]): r["count"] for r in network.chronological_split(df, ["id"], "g").groupBy("g", "split").count().collect()}
    assert by[None, "train"] == 14 and by["a", "train"] == 70 and by["a", "test"] == 15


def test_windows_of_a_busy_key_and_of_null_keys(spark):
    rows = [("h", t) for t in range(0, 3_000_000, 1000)] + [(None, 5), (None, 500_000), ("h", None)]
    out = endpoint.anchored_windows(spark.createDataFrame(rows, "k string, us long"), ["k"], "us", 99_999)
    per = out.filter("k = 'h'").groupBy("window_index").agg(F.count("*").alias("n"), F.min("us").alias("a"), F.max("window_start").alias("s")).orderBy("window_index").collect()
    assert [(r["n"], r["a"], r["s"]) for r in per] == [(100, 100_000 * k, 100_000 * k) for k in range(30)]
    assert sorted(r["window_index"] for r in out.filter("k is null").collect()) == [0, 1] and out.count() == 3002


def test_aliases_skip_nested_nulls(spark):
    flat = sources.flat({"process": {"executable": None, "name": "x.exe"}, "Image": None, "a": {"b": {"c": 1}}})
    assert flat == {"Image": None, "process.name": "x.exe", "a.b.c": "1"}
    get = lambda names, m: _one(spark, normalize.coalesce_alias(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]).cast("map<string,string>"), names))[0]
    assert get(["p.a", "p.b"], {"p.a": None, "p.b": "2"}) == "2" and get(["a", "p.b"], {"a": None, "p.b": "2"}) is None and get(["z"], {"a": "1"}) is None
    assert len(endpoint.ALIASES) == 23


def test_times_and_ages(spark):
    now = F.lit("2024-01-10 00:00:00").cast("timestamp")
    ages = [_one(spark, normalize.age_days(F.lit(x), now))[0] for x in ("2024-01-08T12:00:00Z", "2024-01-08T12:00:00+00:00", "2024-01-08", "soon", None)]
    assert ages == [1, 1, 2, None, None]


def test_evidence_identity(spark):
    base = {"detector": "network", "entity": " h ", "entity_type": "host", "risk_score": 0.5, "confidence": 0.9, "severity": "high"}
    schema = "detector string, entity string, entity_type string, window_start string, window_end string, risk_score double, confidence double, severity string, top_reasons array<string>, metadata map<string,string>, timestamp string"
    rows = [
        {**base}, {**base, "entity": "h", "timestamp": "later"}, {**base, "window_start": ""}, {**base, "top_reasons": ["b", "a"]}, {**base, "top_reasons": ["a", "b"]}, {**base, "top_reasons": ["a|b"]},
        {**base, "risk_score": 0.5000001}, {**base, "metadata": {"x": "1", "a": "2"}}, {**base, "metadata": {"a": "2", "x": "1"}},
    ]
    h = [r["hash"] for r in evidence.evidence_hash(spark.createDataFrame(rows, schema)).collect()]
    assert h[0] == h[1] == h[6] and h[3] == h[4] and h[7] == h[8] and len(set(h)) == 5


def test_class_coercions_and_wrapping(spark):
    df = spark.createDataFrame([("x", "3", None), (None, "bad", "yes")], "user string, auth_count string, off_hours string")
    r = evidence.coerce(df, "IDENTITY").collect()
    assert [(x["user"], x["auth_count"], x["computer_fanout"], x["off_hours"]) for x in r] == [("x", 3, 0, False), ("", 0, 0, True)]
    assert evidence.coerce(spark.range(1), "OT").first()["top_shifted_variables"] == []
    assert [_one(spark, evidence.priority(F.lit(s)))[0] for s in ("critical", "MEDIUM", "info", "?")] == ["CRITICAL", "NORMAL", "LOW", "NORMAL"]
    with pytest.raises(ValueError):
        evidence.serialize_as(["id"], "msgpack")


def test_verification_outcomes(spark):
    s = 1_000_000
    edges = [("host:a", "user:x", "t", 11 * s, 0.3), ("host:b", "user:y", "t", 11 * s, 0.9), ("host:c", "z", "t", 5 * s, 0.9), ("dns:q:d", "w", "t", 12 * s, 0.1)]
    incidents = [(1, "a", ["SUCCESS"]), (2, "b", ["SUCCESS"]), (3, "c", ["SUCCESS"]), (4, "d", ["SUCCESS"]), (5, "a", ["FAILED"]), (6, "nobody", ["SUCCESS"])]
    df = spark.createDataFrame([(i, a, 10 * s, ["block_ip"], st) for i, a, st in incidents], "incident_id long, asset string, start_us long, actions array<string>, statuses array<string>")
    e = spark.createDataFrame(edges, "src string, dst string, type string, us long, risk double")
    got = {r["incident_id"]: r for r in verification.verify(df, e).collect()}
    assert {k: r["state"] for k, r in got.items()} == {1: "PARTIALLY_CONTAINED", 2: "FAILED", 3: "CONTAINED", 4: "PARTIALLY_CONTAINED", 5: "FAILED", 6: "CONTAINED"}
    assert got[1]["attempts"] == 3 and got[2]["attempts"] == 1 and got[2]["backup"] == ["isolate_host"] and got[3]["transitions"][-2:] == ["CONTAINED", "RESOLVED"]
    assert got[5]["reason"] == "Containment action failed to execute"
    late = verification.verify(df, e, delay=3.0, retries=3, interval=5.0, most=10.0)
    assert {r["incident_id"]: r["reason"] for r in late.collect()}[1].startswith("Verification timed out after 13.00s")
    f = {r["metadata"]["incident_id"]: r for r in verification.feedback(verification.verify(df, e), "start_us").collect()}
    assert f["3"]["risk_score"] == 0.0 and f["2"]["severity"] == "CRITICAL" and f["1"]["detector"] == "NETWORK"


def test_dispatch(spark):
    rows = [(1, 0.2, "x"), (2, 0.5, "x"), (3, 0.8, "x"), (4, 0.8, "Domain Controller"), (5, 0.95, "x")]
    df = spark.createDataFrame([(i, s, a, ["isolate_host"], 0) for i, s, a in rows], "incident_id long, score double, asset string, planned array<string>, start_us long")
    edges = spark.createDataFrame([("host:q", "host:p", "t", 5, 0.1)], "src string, dst string, type string, us long, risk double")
    done, fed = detection.dispatch(df, edges)
    got = {int(r["incident_id"]): (r["gate"]["decision"], r["outcome"], r["state"], r["transitions"]) for r in done.collect()}
    assert got[1] == ("ALLOW", "RESOLVED", "RESOLVED", ["INVESTIGATING", "RESOLVED"]) and got[2][2] == "INVESTIGATING" and got[4][2] == "ESCALATED" and got[5][:3] == ("AUTO", "ESCALATED", "ESCALATED")
    assert got[3] == ("AUTO", "RESOLVED", "RESOLVED", ["INVESTIGATING", "CONTAINMENT_IN_PROGRESS", "VERIFICATION_PENDING", "CONTAINED", "RESOLVED"]) and fed.count() == 1


def test_registry_of_actions(spark):
    df = spark.createDataFrame([("1.2.3.4", None, "u", ["block_ip", "isolate_host", "dance"])], "attacker_ip string, asset string, username string, actions array<string>")
    got = df.select(response.standard_actions().outcomes(F.col("actions")).alias("o")).first()["o"]
    assert [(x["action"], x["status"]) for x in got] == [("block_ip", "SUCCESS"), ("isolate_host", "FAILED"), ("dance", "FAILED")] and got[2]["message"] == "Unknown action"


def test_limits(spark):
    s = 1_000_000
    times = [0, 1, 2, 3, 59, 60, 61, 200]
    df = spark.createDataFrame([(k, "a", t * s) for k, t in enumerate(times)] + [(99, None, 0)], "id long, ip string, us long")
    ok = {int(r["id"]): r["accepted"] for r in limits.admitted(df, "ip", "us", "id", 3, 60).collect()}
    assert ok == {0: True, 1: True, 2: True, 3: False, 4: False, 5: True, 6: True, 7: True}
    go = {int(r["id"]): r["released_us"] // s for r in limits.released(df, "ip", "us", "id", 3, 60).collect()}
    assert [go[k] for k in range(8)] == [0, 1, 2, 60, 61, 62, 120, 200]


def test_decoys(spark):
    log = decoys.deploy(spark.createDataFrame([(1, None, None, 0), (2, "credential", "Web Server", 0)], "incident_id long, decoy_type string, placement_node string, us long"))
    ids = {r["incident_id"]: r["decoy_id"] for r in log.collect()}
    assert ids["1"].startswith("DECOY-") and decoys.active(log).count() == 2
    mark = lambda log, i, e, us: log.unionByName(decoys.events(log, spark.createDataFrame([(i, us)], "decoy_id string, us long"), e))
    log = mark(mark(log, ids["2"], "expired", 5), ids["2"], "touched", 9)
    state = {r["incident_id"]: (r["status"], r["target_path"]) for r in decoys.states(log).collect()}
    assert state == {"1": ("active", "db_server_share.txt"), "2": ("touched", "web_server_credentials.txt")}
    assert decoys.due(log, F.lit(30 * 60_000_000)).count() == 1 and decoys.due(log, F.lit(1)).count() == 0
    assert mark(log, "nobody", "touched", 1).count() == log.count()


def test_memory(spark):
    rows = [("I1", "brute force", "ssh logins failed", ["SSH"], 0.9, [1.0, 0.0], "t1"), ("I2", "ransomware", "files were encrypted", ["Ransom"], 0.4, [0.0, 1.0], "t2"), ("I3", "phishing", "mail with ssh key stolen", None, None, [0.9, 0.1], "t3")]
    i = spark.createDataFrame(rows, "incident_id string, resolved_threat string, attack_summary string, tags array<string>, unified_threat_score double, vector array<double>, timestamp string")
    q = spark.createDataFrame([(7, "failed ssh logins", [1.0, 0.0])], "query_id long, text string, q array<double>")
    hits = memory.search(q, i, "vector", 2).orderBy("rank").collect()
    assert [(h["incident_id"], h["method"]) for h in hits] == [("I1", "hybrid"), ("I3", "hybrid")] and hits[0]["citation"] == "Historical Incident Recall: I1" and hits[0]["similarity_score"] == 0.0
    assert [h["incident_id"] for h in memory.search(q, i, "vector", 2, memory.meets(["ransom"])).collect()] == ["I2"]
    assert memory.complete(i).filter(memory.meets(least_score=0.5)).count() == 1
    changed = memory.update(i, spark.createDataFrame([("I2", "new"), ("I9", "no")], "incident_id string, resolved_threat string"))
    assert {(r["incident_id"], r["resolved_threat"], r["timestamp"]) for r in changed.collect()} == {("I1", "brute force", "t1"), ("I2", "new", "t2"), ("I3", "phishing", "t3")}
    new = memory.insert(i, spark.createDataFrame([(None, "x")], "incident_id string, resolved_threat string"), F.lit("2024-01-01").cast("timestamp")).filter("resolved_threat = 'x'").first()
    assert new["incident_id"] == "INC-1704067200" and new["timestamp"].startswith("2024-01-01T00:00:00")
    assert memory.delete(i, i.filter("incident_id = 'I1'")).count() == 2 and memory.search(q.filter("false"), i, "vector").count() == 0


def test_search(spark):
    docs = [("attack", "T1", "Brute Force", "guessing ssh logins", [1.0, 0.0]), ("attack", "T2", "Phishing", "mail lures", [0.0, 1.0]), ("sigma", "S1", "Ssh rule", "failed ssh logins rule", [0.8, 0.2]), ("cve", "C1", "Cve", "ssh logins bug", [1.0, 0.0])]
    c = spark.createDataFrame(docs, "source string, document_id string, title string, description string, vector array<double>")
    q = spark.createDataFrame([(1, "failed ssh logins in the log", [1.0, 0.0])], "query_id long, text string, q array<double>")
    now = F.lit("2024-01-01").cast("timestamp")
    got = search.search(q, c, F.concat_ws(" ", "title", "description"), "vector", now=now).orderBy("rank").collect()
    # The text is routed to sigma ("log") and attack ("ssh", "login"), never to cve.
    assert {r["document_id"] for r in got} == {"T1", "T2", "S1"} and [r["rank"] for r in got] == [1, 2, 3]
    first = got[0]
    assert first["document_id"] == "T1" and first["method"] == "hybrid" and first["citation"] == "[attack:T1]" and first["original_url"].endswith("/techniques/T1/") and first["freshness_category"] == "fresh" and first["trust_score"] == 1.0
    assert abs(first["rrf"] - (1 / 61 + 0.8 / 61)) < 1e-12
    scored = search.search(q, c, F.concat_ws(" ", "title", "description"), "vector", 1, now, reranker=lambda h: h.withColumn("model_score", F.when(F.col("document_id") == "S1", 1.0).otherwise(0.0)))
    assert [r["document_id"] for r in scored.collect()] == ["S1"]
    assert search.search(q.filter("false"), c, F.col("title"), "vector", now=now).count() == 0


def test_context_and_markdown(spark, tmp_path):
    nodes = spark.createDataFrame([("user:a", "user", 0.5, "HIGH"), ("host:b", "host", 0.25, None), ("host:c", "host", 0.0, "LOW"), ("host:d", "host", 0.0, "LOW")], "node_id string, type string, risk double, severity string")
    e = [("user:a", "host:b", "auth", 60_000_000, 0.9, 0.4, "identity"), ("host:b", "host:c", "flow", 180_000_000, 0.2, 0.4, "network"), ("host:c", "host:d", "flow", 240_000_000, 0.2, 0.4, "honeypot")]
    edges = spark.createDataFrame(e, "src string, dst string, type string, us long, risk double, confidence double, source_detector string")
    asked = spark.createDataFrame([("user:a",), ("nobody",)], "entity string")
    out = context.build(nodes, edges, asked)
    got = {r["entity"]: r for r in out.withColumn("md", context.markdown()).collect()}
    a, n = got["user:a"], got["nobody"]
    assert a["related_entities"] == ["host:b", "host:c"] and a["graph_paths"] == [["user:a", "host:b"], ["user:a", "host:b", "host:c"]] and a["confidence_summary"] == "Low" and a["temporal_activity"] == 2.0 and a["honeypot"] == 0
    assert a["risk_summary"] == "User a authenticated, which led to network flow from b to c (unknown)." and a["entities"]["hosts"] == ["b", "c"] and a["identity_score"] == 0.9 and a["diversity"] == 2
    assert "1. **[1970-01-01T00:01:00]** IDENTITY Specialist observed activity on 'user:a' with threat risk score 0.90 (Risk: 0.90, Conf: 0.40)" in a["md"] and "- **[GRAPH]** Entity: host:b | Severity: INFO | Risk Score: 0.25" in a["md"]
    assert not n["found"] and n["confidence_score"] == 0.1 and n["risk_level"] == "LOW" and n["confidence_summary"] == "N/A (No events)" and "No timeline entries recorded." in n["md"]
    context.save(out, str(tmp_path / "c"))
    back = {r["entity"]: r for r in context.load(out, str(tmp_path / "c")).collect()}
    assert back["user:a"]["related_events"] == a["related_events"] and back["user:a"]["unified_threat_score"] == a["unified_threat_score"]
    hits = spark.createDataFrame([("user:a", 1, "I1")], "entity string, rank int, incident_id string")
    assert {r["entity"]: r["m"] for r in context.with_memory(out, hits, "m", ["incident_id"]).collect()}["nobody"] is None
    assert _one(spark, context.narrative(F.array().cast("array<struct<detector:string,src:string,dst:string,family:string,process:string,targets:array<string>,variables:array<string>>>")))[0] == "No suspicious activity detected."


def test_harness(spark):
    df = harness.scenarios(spark, 2000)
    assert df.collect() == harness.scenarios(spark, 2000).collect() and set(df.select("scenario").distinct().toPandas()["scenario"]) == set(harness.SCENARIOS)
    got = {(r["subject"], r["metric"]): r["value"] for r in harness.evaluate(df).collect()}
    assert got["combined", "roc_auc"] > 0.9 and got["combined", "recall"] > 0.8 and 0 < got["policy", "automation"] <= 1 and all(0 <= v <= 1 for v in got.values())
    a = spark.createDataFrame([(["x", "y"], ["y"]), (["y"], ["y"]), (["z"], ["q"])], "p array<string>, a array<string>")
    assert tuple(round(v, 4) for v in harness.attribution(a, F.col("p"), F.col("a")).first()) == (0.3333, 0.6667, 0.6667)


def test_group_shares(spark):
    shares = F.create_map(F.lit("network_score"), F.lit(0.25), F.lit("pagerank"), F.lit(0.25), F.lit("unknown"), F.lit(0.5))
    got = _one(spark, scoring.group_shares(shares))[0]
    assert set(got) == set(scoring.GROUPS) and got["network"] == 0.5 and got["graph"] == 0.5 and got["ot"] == 0


def test_protocols(spark):
    class Loud:
        name, loaded = "NETWORK", False

        def load(self):
            self.loaded = True

        def predict(self, df):
            return df.withColumn("risk_score", F.lit(1.0))

    d = Loud()
    assert isinstance(d, protocols.Detector) and not isinstance(d, protocols.Provider)
    out = protocols.run([d], {"NETWORK": spark.range(2), "OT": spark.range(1)})
    assert d.loaded and out["NETWORK"].count() == 2
    got = []
    p = protocols.Publisher(lambda df: got.append(df.count()))
    rows = [("network", "h", "host", "2024-01-01 00:00:00", 0.5, 0.5, "high"), ("zz", "h", "host", "2024-01-01 00:00:00", 0.5, 0.5, "high")]
    e = spark.createDataFrame(rows, "detector string, entity string, entity_type string, timestamp string, confidence double, risk_score double, severity string")
    assert p.publish(e) == 2 and p.publish_if_valid(e) == 1 and p.publish_batch([e, e]) == 4 and got == [2, 1, 4] and p.refused == [1]
    emb = protocols.Precomputed(spark.createDataFrame([("a", [1.0])], "text string, embedding array<double>"), 1)
    assert [r["v"] for r in emb.embed(spark.createDataFrame([("a",), ("b",)], "t string"), "t", "v").orderBy("t").collect()] == [[1.0], None] and isinstance(emb, protocols.Embedder)


def test_manifest_and_discovery(spark, tmp_path):
    body = "timestamp;x;Attack\n" + "".join(f"2024-01-01;{k:03d};0\n" for k in range(50))
    (tmp_path / "host").mkdir()
    (tmp_path / "a.csv").write_text(body)
    with zipfile.ZipFile(tmp_path / "host" / "b.zip", "w") as z:
        z.writestr("in.csv", body)
        z.writestr("in.bin", "x")
    (tmp_path / "bad.zip").write_bytes(b"nothing")
    spark.range(9).withColumn("time", F.lit(1)).coalesce(1).write.parquet(str(tmp_path / "p"))
    got = {r["file"].rsplit("/", 1)[-1].split("-")[0]: r for r in sources.manifest(spark, str(tmp_path)).collect()}
    assert got["a.csv"]["row_estimate"] in (50, 51) and got["a.csv"]["columns"] == 3 and got["a.csv"]["time_column"] == "timestamp" and got["a.csv"]["label_column"] == "Attack"
    assert got["b.zip::in.csv"]["row_estimate"] in (50, 51) and got["part"]["row_estimate"] == 9 and got["part"]["time_column"] == "time" and len(got) == 3
    assert [r["path"].rsplit("/", 1)[-1] for r in sources.discover_hosts(spark, str(tmp_path)).collect()] == ["b.zip"]


def test_threat_intel_and_rules_of_a_folder(spark, tmp_path):
    from arcspan.operators import sigma

    (tmp_path / "t.json").write_text(json.dumps([{"id": "C1", "name": "n"}, {"name": "without id"}]))
    r = sources.read_threat_intel(spark, str(tmp_path / "t.json"), "cve").collect()
    assert len(r) == 1 and (r[0]["source"], r[0]["title"], r[0]["confidence"], r[0]["tags"]) == ("cve", "n", 1.0, [])
    (tmp_path / "b.yml").write_text("title: b\ndetection:\n  sel:\n    x: 1\n  condition: sel\n")
    (tmp_path / "a.yaml").write_text("title: a\ndetection:\n  sel:\n    x: 1\n  condition: sel\n")
    (tmp_path / "c.yml").write_text("title: [")
    assert [x.title for x in sigma.load_rules(str(tmp_path))] == ["a", "b"]


def test_sinks(spark, tmp_path):
    def breaks(_df):
        raise OSError("down")

    df = spark.createDataFrame([(1, "2024-01-01 10:00:00"), (2, "2024-01-02 10:00:00")], "id long, time string")
    with pytest.warns(UserWarning):
        assert not sinks.index_or_append(breaks, df, str(tmp_path / "daily"), "time")
    assert sorted(p.name for p in (tmp_path / "daily").iterdir() if p.is_dir()) == ["date=2024-01-01", "date=2024-01-02"]
    assert sinks.index_or_append(lambda x: x.count(), df, str(tmp_path / "none"), "time") and not (tmp_path / "none").exists()
    assert [r["id"] for r in sinks.tail(df, ["time"], 1).collect()] == [2]
    made = retrieval.index(spark.createDataFrame([(1, "alpha beta"), (2, "beta")], "id long, text string"), "id", "text")
    sinks.write_index(*made, str(tmp_path / "index"))
    postings, lengths = sinks.read_index(spark, str(tmp_path / "index"))
    q = spark.createDataFrame([(0, "alpha")], "q long, term string")
    assert [r["id"] for r in retrieval.bm25(q, postings, lengths, "q", "id", 3).collect()] == [1] and lengths.count() == 2
    with pytest.raises(ValueError):
        sinks.export_node_link(df, df, str(tmp_path / "g"), 1)
    kept = sinks.spool(df)
    sinks.unspool(kept)
    assert not any((tmp_path).glob("spool-*"))


def test_graph_questions(spark):
    nodes = spark.createDataFrame([("host:a", "host", 0.9, 100_000_000), ("host:b", "HOST", 0.9, 10), ("user:c", "user", 0.2, 10)], "node_id string, type string, risk double, last_seen long")
    edges = spark.createDataFrame([("host:a", "host:b", "t", "NETWORK", 100_000_000, 0.5), ("host:b", "user:c", "t", "IDENTITY", 10, 0.1)], "src string, dst string, type string, source_detector string, last_seen long, risk double")
    assert graph.by_type(nodes, "Host").count() == 2 and [r["node_id"] for r in graph.by_risk(nodes, 0.5).collect()] == ["host:a", "host:b"]
    assert [(r["kind"], r["id"]) for r in graph.recent(nodes, edges, F.lit(100_000_000), 1).collect()] == [("edge", "host:a > host:b (t)"), ("node", "host:a")]
    chain, lines = graph.attack_chain(nodes, edges, nodes.filter("node_id = 'host:a'").select("node_id"), 1)
    assert chain.count() == 2 and [r["description"] for r in lines.collect()] == ["host:a --[t]--> host:b"]
    assert set(graph.indexes(nodes, edges)) == {"risk", "type", "detector", "time"} and graph.indexes(nodes, edges)["time"].count() == 5
    long = spark.createDataFrame([(f"n{k:02d}", f"n{k + 1:02d}") for k in range(30)], "src string, dst string")
    start = spark.createDataFrame([("n00",)], "node_id string")
    assert graph.blast_radius(long, start).first()["reachable"] == 30 and graph.shortest_paths(long, start).agg(F.max("length")).first()[0] == 30


def test_graph_categories(spark):
    nodes = spark.createDataFrame([("p", "T1", "parent", "technique"), ("s", "T1.1", "sub", "sub-technique"), ("m", "M1", "tool", "malware"), ("g", "G1", "gang", "group"), ("t", "T2", "other", "technique")], "node_id string, external_id string, name string, type string")
    edges = spark.createDataFrame([("s", "p", "subtechnique-of"), ("m", "s", "uses"), ("g", "m", "uses"), ("g", "t", "uses")], "src string, dst string, relation string")
    walked = graph.attack_neighbourhood(edges, nodes.filter("node_id = 's'").select("node_id"))
    got = {r["category"]: [(e["id"], e["relation"], e["depth"], e["confidence"]) for e in r["entities"]] for r in graph.categories(walked, nodes).collect()}
    assert got == {"parent_technique": [("T1", "subtechnique-of", 1, 0.8)], "software": [("M1", "reverse-uses", 1, 0.8)], "groups": [("G1", "reverse-uses", 2, 0.6)]}
    hit = retrieval.attack_lookup(spark.createDataFrame([("t1",), ("zz",)], "technique_id string"), nodes, "technique_id")
    assert {r["technique_id"]: r["stix_id"] for r in hit.collect()} == {"t1": "p", "zz": None}


def test_hits_and_filters(spark):
    hits = spark.createDataFrame([("a", 1.0, "x"), ("a", 1.0, "b"), ("b", 2.0, "c")], "id string, d double, t string")
    assert {(r["id"], r["t"]) for r in retrieval.dedup_hits(hits, ["id"], "d").collect()} == {("a", "b"), ("b", "c")}
    df = spark.createDataFrame([(1, ["x", "y"], "n"), (2, None, "n"), (3, ["z"], "status")], "id long, tag array<string>, status string")
    ids = lambda f: [r["id"] for r in df.filter(retrieval.matches(df, f)).collect()]
    assert ids({"tag": "y"}) == [1] and ids({"tag": ["z", "x"]}) == [1, 3] and ids({"status": "n"}) == [1, 2] and ids({"status": ["n"], "tag": "x"}) == [1]


def test_stream_ttl_dedup_drops_its_state(spark, tmp_path):
    s, begin = 1_000_000, 1_700_000_000_000_000
    schema = "key string, us long"
    for k, rows in enumerate([[("a", 0), ("a", 500 * s), ("b", 10 * s)], [("a", 601 * s), ("b", 5000 * s)], [("c", 9000 * s), ("a", 9000 * s)], [("c", 9500 * s)]]):
        spark.createDataFrame([(key, t + begin) for key, t in rows], schema).coalesce(1).write.json(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).json(str(tmp_path / "in"))
    out = streaming.ttl_dedup(stream, "key", "us", late="1 second")
    query = out.writeStream.format("memory").queryName("deduped").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r["key"], (r["us"] - begin) // s) for r in spark.table("deduped").collect()) == [("a", 0), ("a", 601), ("a", 9000), ("b", 10), ("b", 5000), ("c", 9000)]
    counted = streaming.counters(query)
    assert counted["rows"] == 8 and counted["state_rows"] <= 3 and counted["batches"] >= 4


def test_latency(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00",), ("2024-01-01 00:00:01",)], "t string").select(F.col("t").cast("timestamp").alias("w"))
    r = streaming.latency(df, "w", F.lit("2024-01-01 00:00:02").cast("timestamp")).first()
    assert (r["events_published"], r["average_latency"], r["largest_latency"]) == (2, 1500.0, 2000.0)


def test_all_industrial_reasons(spark):
    from arcspan.operators import industrial

    names = {
        "sensor_A_flatline_duration": 46.0, "sensor_B_oscillation_count": 16.0, "sensor_C_rate_of_change": 6.0, "sensor_D_rate_of_change": -6.0, "cross_corr_sensor_E_sensor_F": 0.2,
        "actuator_FCV1_state_changes": 0.0, "actuator_X_state_changes": 0.0, "sensor_G_flatline_duration": 45.0, "cross_corr_sensor_H_sensor_I": 0.0,
    }
    want = [
        "Control loop state locked: actuator FCV1 failed to transition", "Cross-sensor correlation dropped for pair: E_F", "Rapid value decrease observed for sensor: D", "Rapid value increase observed for sensor: C",
        "Sensor flatline detected: A remained constant for 46s", "Unexpected process oscillation detected for sensor: B", "Window deviates strongly from historical normal industrial baseline",
    ]
    df = spark.createDataFrame([(1, n, v, 0.75) for n, v in names.items()] + [(2, n, v, 0.6) for n, v in names.items()], "w long, name string, value double, risk double")
    got = {r["w"]: r["reasons"] for r in industrial.reasons(df, ["w"], "risk").collect()}
    assert got[1] == want and got[2] == want[1:-1]


def test_multiclass_forest(spark):
    from arcspan import models

    df = spark.createDataFrame([(float(k % 3), float(k % 3 * 10 + k % 2), "abc"[k % 3]) for k in range(90)], "x double, y double, label string")
    out = models.fit_multiclass(df, ["x", "y"], "label", trees=5, depth=3).transform(df)
    assert out.filter(F.col("prediction") != F.col("x")).count() == 0


def test_stream_ingest_wraps_first_copies(spark, tmp_path):
    begin = 1_700_000_000_000_000
    row = lambda entity, t, severity="high": {"detector": "network", "entity": entity, "entity_type": "host", "timestamp": "2024-01-01 00:00:00", "confidence": 0.5, "risk_score": 0.5, "severity": severity, "top_reasons": ["r"], "us": begin + t * 1_000_000}
    schema = "detector string, entity string, entity_type string, timestamp string, confidence double, risk_score double, severity string, top_reasons array<string>, us long"
    rows = [row("a", 0), row("a", 5), row("b", 6), row("b", 700, "critical"), {**row("c", 8), "detector": "zz"}]
    spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    query = streaming.ingest(stream, "us").writeStream.format("memory").queryName("wrapped").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.table("wrapped").collect()
    assert sorted((r["entity"], r["priority"], r["status"]) for r in got) == [("a", "HIGH", "PENDING"), ("b", "CRITICAL", "PENDING"), ("b", "HIGH", "PENDING")]
    assert len({r["event_id"] for r in got}) == 3 and all(json.loads(r["payload"])["detector"] == "NETWORK" for r in got)

    class Sub:
        name, condition = "s", F.col("entity") == "a"

        def receive(self, batch):
            self.got = batch.count()

        def health(self):
            return "Healthy"

    sub = Sub()
    assert isinstance(sub, protocols.Subscriber)
    streaming.fan_out(protocols.subscriptions([sub]), lambda n, e: None)(spark.table("wrapped"), 0)
    assert sub.got == 1


def test_capped_and_ordered(spark):
    near = spark.createDataFrame([("b", 1), ("a", 1), ("c", 0)], "node_id string, depth int")
    assert [r["node_id"] for r in graph.capped(near, 2).collect()] == ["c", "a"]
    fused = spark.createDataFrame([(1, "a", 0.5, 1.0, None), (1, "b", 0.5, None, 2.0), (1, "c", 0.9, None, 1.0)], "q long, id string, rrf double, distance double, score double")
    assert [(r["id"], r["place"]) for r in retrieval.order_fused(fused, "q", "id", 2).orderBy("place").collect()] == [("c", 1), ("a", 2)]


class _Cluster:
    """What `shared_dir` asks of a session on a cluster that names no shared folder."""

    def __init__(self, master, folder=None):
        self.sparkContext, self.conf, self.sparkSession = self, self, self
        self.master, self.folder = master, folder

    def get(self, _key, _default=None):
        return self.folder

    def set(self, _key, value):
        self.folder = value


def test_no_machine_local_folder_on_a_cluster():
    for master in ("yarn", "k8s://x", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            sinks.shared_dir(_Cluster(master))
    assert sinks.shared_dir(_Cluster("yarn", "hdfs:///x/")) == "hdfs:///x" and sinks.shared_dir(_Cluster("local[2]")).startswith("file:///")
