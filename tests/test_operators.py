"""Unit cases of the operators, on small inline frames."""

import io
import json
import math
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from arcspan import models, sinks, sources, streaming
from arcspan.functions import normalize, scoring
from arcspan.operators import endpoint, evidence, graph, identity, industrial, ledger, network, response, retrieval, sigma
from arcspan.plans import context


def _one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_user_hour_and_history(spark):
    rows = [(1, t * 1_000_000, k) for t, k in [(1000, 2), (2000, 3), (3000, 4)]]
    h = identity.user_hours(spark.createDataFrame(rows, "user_id long, us long, k long")).first()
    assert (h["auth_count"], h["mean_gap"], h["min_gap"], h["new_computers"]) == (3, 1000.0, 1000.0, 3)
    assert abs(h["fanout_rate"] - 3 / (2000 / 3600)) < 1e-9
    hours = spark.createDataFrame([("u", w, float(x)) for w, x in enumerate([10, 15, 20, 3])], "user string, window_id long, x double")
    z = [r["z"] for r in hours.withColumn("z", identity.history_zscore(F.col("x"))).orderBy("window_id").collect()]
    assert z[:3] == [0, 0, 0] and abs(z[3] - (3 - 15) / math.sqrt(50 / 3)) < 1e-9
    assert identity.user_hours(spark.createDataFrame([], "user_id long, us long, k long")).count() == 0


def test_baseline(spark):
    df = spark.createDataFrame([("e", "m", float(x), k) for k, x in enumerate([2, 4, 4, 4, 5, 5, 7, 9])], "e string, m string, v double, o long")
    b = identity.baseline(df, "e", "m", "v", "o").first()
    assert (b["count"], b["mean"], b["std"], b["last_value"], b["is_established"]) == (8, 5.0, 2.0, 9.0, False)
    d = lambda v, n, m, s: _one(spark, identity.deviation(F.lit(v), F.lit(n), F.lit(m), F.lit(s)))[0]
    assert d(5.0, 2, 5.0, 2.0) is None and d(5.0, 8, 5.0, 0.0) == 0 and d(6.0, 8, 5.0, 0.0) == math.inf and d(11.0, 8, 5.0, 2.0) == 3


def test_normalize_values(spark):
    r = _one(spark, normalize.basename(F.lit("C:\\a/b\\cmd.exe")).alias("b"), normalize.to_int(F.lit("0x1F")).alias("h"), normalize.to_int(F.lit(" 42 ")).alias("i"), normalize.to_int(F.lit("x")).alias("n"), normalize.entropy(F.lit("aabb")).alias("e"), normalize.clip01(F.lit(float("nan"))).alias("c"))
    assert (r["b"], r["h"], r["i"], r["n"], r["e"], r["c"]) == ("cmd.exe", 31, 42, None, 1.0, 0.0)
    assert normalize.clean_name("Flow Bytes/s") == "flow_bytess"


def test_alias_that_is_present_but_null(spark):
    df = spark.createDataFrame([({"Image": None, "process.name": "x"},), ({"foo": "bar"},)], "record map<string,string>")
    rows = endpoint.normalize(df).collect()
    assert rows[0]["process_name"] is None and rows[1]["reason"] == "missing_timestamp"


def test_anchored_windows(spark):
    rows = [("h", t * 1_000_000) for t in (0, 10, 30, 60, 61, 120, 122)]
    out = endpoint.anchored_windows(spark.createDataFrame(rows, "k string, us long"), ["k"], "us", 60_000_000)
    assert [(r["us"] // 1_000_000, r["window_index"]) for r in out.orderBy("us").collect()] == [(0, 0), (10, 0), (30, 0), (60, 0), (61, 1), (120, 1), (122, 2)]


def test_fusion_cases(spark):
    f = lambda s, *levels: tuple(_one(spark, endpoint.fuse(F.lit(s), F.array(*map(F.lit, levels)).cast("array<string>")))[0])
    assert f(0.9, "high") == (0.95, "critical", 0.95) and f(0.8) == (0.8, "medium", 0.75) and f(0.2, "medium") == (0.8, "medium", 0.8) and f(0.2, "low") == (0.5, "low", 0.6) and f(0.2) == (0.2, "low", 0.5)


def test_sigma(spark):
    rule = "title: t\nid: X\nlevel: high\ntags: [attack.t1059]\ndetection:\n  sel:\n    Image|endswith: '\\powershell.exe'\n    CommandLine|contains: [' -enc ', base64]\n  condition: sel\n"
    rules = sigma.parse_rules(rule)
    assert len(rules) == 1 and sigma.parse_rules("title: [") == [] and rules[0].techniques == ["T1059"]
    df = spark.createDataFrame([("C:\\PowerShell.exe", "x -ENC y"), ("C:\\cmd.exe", "x -enc y"), (None, None)], "Image string, CommandLine string")
    assert [len(r["matches"]) for r in sigma.match(df, rules, F.col).collect()] == [1, 0, 0]


def test_sliding_windows_drop_the_tail(spark):
    df = spark.range(79).select(F.lit("t").alias("tag"), F.col("id").alias("idx"))
    counts = industrial.sliding_windows(df, "tag").groupBy("window_id").count().orderBy("window_id").collect()
    assert [tuple(r) for r in counts] == [(0, 60), (1, 60)]


def test_roles(spark):
    df = spark.createDataFrame([(k, k % 2, float(k), 5.0, float(k), k % 3, 0) for k in range(30)], "ts long, P1_FCV int, P1_T double, P1_SP_setpoint double, P1_PID double, mode int, attack int")
    roles = industrial.classify_columns(df, "ts", "attack")
    assert roles == {"ts": "Timestamp", "P1_FCV": "Actuator", "P1_T": "Sensor", "P1_SP_setpoint": "Setpoint", "P1_PID": "Controller", "mode": "Status", "attack": "Label"}


def test_dynamics(spark):
    df = spark.createDataFrame([("a", k, float(x)) for k, x in enumerate([1, 1, 1, 3, 2, 2])], "g string, i long, x double")
    r = industrial.dynamics(df, ["g"], "i", "x").first()
    assert (r["flatline"], r["max_state_duration"], r["state_changes"]) == (2, 3, 2)


def test_unknown_label_is_an_error(spark):
    with pytest.raises(Exception, match="unknown label"):
        spark.range(1).select(network.map_family(F.lit("zz"), {"a": "b"})).collect()


def test_ttl_is_not_renewed(spark):
    df = spark.createDataFrame([("k", t * 1_000_000) for t in (0, 500, 600, 601, 1200, 1300)], "k string, us long")
    kept = [r["us"] // 1_000_000 for r in evidence.ttl_dedup(df, "k", "us").filter("not is_duplicate").orderBy("us").collect()]
    assert kept == [0, 601, 1300]


def test_graph_merge_and_measures(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcde"], "node_id string")
    edges = spark.createDataFrame([("a", "b", "t"), ("b", "c", "t"), ("e", "e", "t")], "src string, dst string, type string")
    assert {r["node_id"]: r["degree"] for r in graph.degrees(nodes, edges).collect()} == {"a": 1, "b": 2, "c": 1, "d": 0, "e": 2}
    assert {r["node_id"]: r["component"] for r in graph.components(nodes, edges).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e"}
    c = {r["node_id"]: r for r in graph.centrality(nodes, edges).collect()}
    assert abs(c["b"]["betweenness"] - 1 / 12) < 1e-12 and abs(c["c"]["closeness"] - (2 / 3) * (2 / 4)) < 1e-12
    ranks = {r["node_id"]: r["rank"] for r in graph.pagerank(nodes, edges).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-6 and ranks["e"] > ranks["c"] > ranks["b"] > ranks["a"]
    paths = {r["node_id"]: r["path"] for r in graph.shortest_paths(edges, nodes.filter("node_id = 'c'")).collect()}
    assert paths == {"c": ["c"], "b": ["c", "b"], "a": ["c", "b", "a"]}
    assert {r["node_id"]: r["community"] for r in graph.communities(nodes, edges).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e"}
    ring = spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string")
    assert graph.blast_radius(ring, nodes.filter("node_id = 'a'")).first()["reachable"] == 2


def test_tokeniser(spark):
    t = set(_one(spark, retrieval.tokens(F.lit("Failed SSH logins for CVE-2023-38606 from 10.0.0.1 and the attackers attempted, T1110.001")))[0])
    assert {"cve-2023-38606", "10.0.0.1", "t1110.001", "ssh", "login", "fail", "attacker", "attempt"} <= t and not t & {"the", "and", "from"}


def test_bm25_and_fusion(spark):
    docs = spark.createDataFrame([("SIG-001", "ssh login attempts"), ("SIG-002", "dns tunnel")], "id string, text string")
    postings, lengths = retrieval.index(docs, "id", "text")
    q = spark.createDataFrame([(1, "ssh login")], "q int, text string").select("q", F.explode(retrieval.tokens(F.col("text"))).alias("term"))
    hit = retrieval.bm25(q, postings, lengths, "q", "id", 5).collect()
    assert [h["id"] for h in hit] == ["SIG-001"]
    assert retrieval.route(F.lit("x")) is not None and _one(spark, retrieval.route(F.lit("Sigma rule to detect attack")))[0] == ["sigma", "attack"]


def test_policy_gate(spark):
    n = F.lit
    g = lambda asset, passes, score, conf, blast, risk: _one(spark, response.policy_gate(n(asset), n("x"), n(passes), n(score), n(conf), n(blast), n(risk)))[0]["decision"]
    assert g("Laptop", True, 0.8, 0.9, "LOW", 80.0) == "AUTO" and g("Domain Controller", True, 0.1, 0.9, "LOW", 1.0) == "ESCALATE"
    assert g("Laptop", False, 0.1, 0.9, "LOW", 1.0) == "ESCALATE" and g("Laptop", True, 0.1, 0.9, "LOW", 1.0) == "ALLOW" and g("Laptop", True, 0.8, 0.9, "High", 80.0) == "ESCALATE"
    assert abs(_one(spark, response.execution_score(n("Isolate Host"), n("Low")))[0] - 0.46) < 1e-12
    assert _one(spark, scoring.risk_level(n(0.75)))[0] == "CRITICAL" and abs(_one(spark, scoring.soften(n(1.0)))[0] - 0.8496) < 1e-4


def test_ledger_detects_tampering(spark):
    df = spark.createDataFrame([(1, k, ledger.canonical({"n": k})) for k in range(5)], "i long, seq long, data string")
    c = ledger.chain(df, "i", "seq", F.col("data"))
    assert ledger.verify(c, "i", "seq").filter("not ok").count() == 0
    bad = c.withColumn("hash", F.when(F.col("seq") == 2, F.sha2(F.lit("x"), 256)).otherwise(F.col("hash")))
    assert {r["seq"] for r in ledger.verify(bad, "i", "seq").filter("not ok").collect()} == {2, 3}


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x;y\n1;2\n")
    assert [tuple(r) for r in sources.read_csv(spark, str(tmp_path / "a.csv")).collect()] == [("1", "2")]
    (tmp_path / "b.jsonl").write_text('{"t": 2}\nbroken\n{"t": 1}\n')
    assert [r["t"] for r in sources.read_jsonl(spark, str(tmp_path / "b.jsonl"), "t long", "t").collect()] == [1, 2]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("e.json", json.dumps([{"a": 1, "b": {"c": "x"}}, {"a": 2}]))
        z.writestr("f.ndjson", '{"a": 3}\nbad\n')
        z.writestr("g.csv", "a\n4\n")
        z.writestr("h.yaml", "- a: 5\n")
        z.writestr("i.txt", "no")
    (tmp_path / "z.zip").write_bytes(data.getvalue())
    got = sources.read_archives(spark, str(tmp_path)).collect()
    assert sorted(r["record"]["a"] for r in got) == ["1", "2", "3", "4", "5"] and any(r["record"].get("b.c") == "x" for r in got)
    (tmp_path / "c.txt").write_text("1,u,c\nbad\n2,u,d,e\n3,v,c\n")
    assert sources.read_events_csv(spark, str(tmp_path / "c.txt")).count() == 2
    bundle = {"objects": [{"type": "attack-pattern", "id": "a", "name": "A"}, {"type": "malware", "id": "m", "name": "M"}, {"type": "identity", "id": "i"}, {"type": "relationship", "id": "r", "relationship_type": "uses", "source_ref": "m", "target_ref": "a"}, {"type": "relationship", "id": "s", "relationship_type": "uses", "source_ref": "m", "target_ref": "gone"}]}
    (tmp_path / "stix.json").write_text(json.dumps(bundle))
    nodes, edges = sources.read_stix(spark, str(tmp_path / "stix.json"))
    assert nodes.count() == 2 and [tuple(r) for r in edges.collect()] == [("m", "a", "uses")]
    ref = lambda source, x: {"source_name": source, "external_id": x}
    objects = [
        {"type": "attack-pattern", "id": "t", "name": "T", "external_references": [ref("mitre-attack", "T1")], "x_mitre_platforms": ["Linux"], "kill_chain_phases": [{"kill_chain_name": "k", "phase_name": "impact"}]},
        {"type": "attack-pattern", "id": "s", "name": "S", "x_mitre_is_subtechnique": True, "external_references": [ref("capec", "CAPEC-1"), ref("mitre-attack", "T1.001")]},
        {"type": "x-mitre-tactic", "id": "c", "name": "C", "x_mitre_shortname": "impact"}, {"type": "x-mitre-data-source", "id": "d", "name": "D"}, {"type": "tool", "id": "x"}, {"type": "tool"}, {"id": "y"},
        *[{"type": "relationship", "id": f"r{a}{b}", "relationship_type": r, "source_ref": a, "target_ref": b} for a, b, r in (("s", "t", "subtechnique-of"), ("t", "c", "in"), ("x", "s", "uses"))],
    ]
    (tmp_path / "types.json").write_text(json.dumps({"objects": objects}))
    nodes, edges = sources.read_stix(spark, str(tmp_path / "types.json"))
    got = {r["node_id"]: (r["type"], r["external_id"], r["platforms"], r["phase_names"]) for r in nodes.collect()}
    assert got == {"t": ("technique", "T1", ["Linux"], ["impact"]), "s": ("sub-technique", "T1.001", [], []), "c": ("tactic", "impact", [], []), "d": ("data-source", None, [], []), "x": ("tool", None, [], [])}
    start = nodes.filter("node_id = 's'").select("node_id")
    found = {r["category"]: [e["id"] for e in r["entities"]] for r in graph.categories(graph.attack_neighbourhood(edges, start), nodes).collect()}
    assert found == {"parent_technique": ["T1"], "tactics": ["impact"], "software": [None]}
    assert sources.load_config(str(tmp_path / "none.yaml"), {"a": {"b": 1}}) == {"a": {"b": 1}}


def test_telemetry_goes_to_its_detector(spark):
    df = spark.createDataFrame([("network", None, [1.0]), ("identity", "u", [2.0]), ("identity", None, [3.0])], "telemetry_type string, entity_id string, data array<double>")
    named = lambda name: lambda rows: rows.withColumn("by", F.lit(name))
    both = {"network": named("n"), "identity": named("i")}
    got = sorted(map(tuple, evidence.dispatch(df, both).collect()))
    assert got == [("u", "", [2.0], "i"), ("unknown-host", "", [1.0], "n"), ("unknown-user", "", [3.0], "i")]
    with pytest.raises(ValueError, match="identity"):
        evidence.dispatch(df, {"network": named("n")})
    with pytest.raises(Exception, match="without data"):
        evidence.dispatch(df.withColumn("data", F.lit(None).cast("array<double>")), both).collect()


def test_context_of_a_hub_is_bounded(spark):
    """The first nodes by depth and id, as without a bound on what is expanded; paths are the smallest."""
    rng = random.Random(0)
    links = [("hub", f"x{i:03d}") for i in range(150)] + [("e1", "hub"), ("e1", "a"), ("e2", "x005"), ("a", "x149"), ("b", "e2"), ("b", "x003")] + [(f"x{rng.randrange(150):03d}", f"y{i}") for i in range(30)]
    edges = spark.createDataFrame([(*l, "t") for l in links], "src string, dst string, type string")
    pairs = {(a, b) for x, y in links for a, b in ((x, y), (y, x))}
    asked = ["e1", "e2", "hub", "y1"]
    got = {}
    for r in context.neighbourhood(edges, spark.createDataFrame([(e,) for e in asked], "entity string"), 3, 12).collect():
        got.setdefault(r["entity"], []).append((r["depth"], r["node_id"], r["path"]))
    for e in asked:
        seen, frontier = {e: (0, [e])}, {e: [e]}
        for depth in (1, 2, 3):
            reached = {}
            for node, path in frontier.items():
                for a, b in pairs:
                    if a == node and b not in seen:
                        reached[b] = min(reached.get(b, [*path, b]), [*path, b])
            frontier = reached
            seen |= {n: (depth, p) for n, p in reached.items()}
        want = sorted((d, n, p) for n, (d, p) in seen.items())[:12]
        assert sorted(got[e]) == want


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.7)], "k long, v string, s double")
    assert sinks.write_features(df, str(tmp_path / "f")) == {"k": "bigint", "v": "string", "s": "double"}
    assert endpoint.contract_check(spark.read.parquet(str(tmp_path / "f")), {"k": "bigint", "z": "double"}) == ["missing z"]
    assert [r["v"] for r in sinks.latest(df, ["k"], ["s"]).collect()] == ["b"]
    nodes, edges = spark.createDataFrame([("a",), ("b",)], "node_id string"), spark.createDataFrame([("a", "b", "t")], "src string, dst string, type string")
    sinks.export_graphml(nodes, edges, str(tmp_path / "g.xml"))
    sinks.export_node_link(nodes, edges, str(tmp_path / "g"))
    n, e = sources.read_node_link(spark, str(tmp_path / "g"))
    assert n.count() == 2 and e.count() == 1 and "<edge" in (tmp_path / "g.xml").read_text()
    assert sinks.report(df, "t").count("\n") == 6


def test_isolation_forest_finds_outliers(spark):
    df = spark.range(500).select("id", F.when(F.col("id") == 7, 100.0).otherwise(F.rand(1)).alias("x"), F.rand(2).alias("y"))
    model = models.fit_isolation_forest(df, ["x", "y"], "id", trees=60, sample=450)
    assert models.score_isolation_forest(df, model).orderBy("raw_score").first()["id"] == 7


def test_fan_out_isolates_failures(spark):
    got, failed = [], []

    def breaks(_batch):
        raise RuntimeError("x")

    each = streaming.fan_out({"bad": (F.lit(True), breaks), "good": (F.col("id") > 3, lambda b: got.append(b.count()))}, lambda name, e: failed.append(name))
    each(spark.range(6), 0)
    assert got == [2] and failed == ["bad"]


def test_walks_reach_the_end_of_a_chain(spark):
    edges = spark.createDataFrame([(f"n{k:02}", f"n{k + 1:02}", "t") for k in range(20)], "src string, dst string, type string")
    start = spark.createDataFrame([("n00",)], "node_id string")
    paths = {r["node_id"]: r["length"] for r in graph.shortest_paths(edges, start).collect()}
    assert paths == {f"n{k:02}": k for k in range(21)}
    assert graph.blast_radius(edges, start).first()["reachable"] == 20


def test_dense_answers_more_queries_than_a_block(spark):
    v = spark.createDataFrame([(k, [float(k), 0.0]) for k in range(30)], "id long, v array<double>")
    q = v.select(F.col("id").alias("qid"), F.col("v").alias("q"))
    got = {(r["qid"], r["rank"]): r["id"] for r in retrieval.dense(q, v, "qid", "id", "v", 2, most=8).collect()}
    assert got == {(k, 1): k for k in range(30)} | {(k, 2): k - 1 if k else 1 for k in range(30)}
