"""Faults that showed on larger tables, each on a small one."""

import zipfile
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import functions as F

from arcspan import sources, streaming
from arcspan.operators import decoys, graph, identity, retrieval
from arcspan.plans import search
from arcspan.queries import QUERIES
from arcspan.streaming import stateful


def test_decoys_share_no_id(spark):
    n = 200_000
    asked = spark.range(n).select(F.col("id").alias("incident_id"), F.lit("credential").alias("decoy_type"), F.lit("File Server").alias("placement_node"), F.lit(0).alias("us"))
    assert decoys.deploy(asked).select("decoy_id").distinct().count() == n


def test_scores_on_a_limit_give_no_reason(spark):
    """Two twos among twenty hours: the last hour lies three deviations off, but for rounding."""
    counts = [2 if h in (2, 19, 20) else 1 for h in range(21)]
    hours = spark.createDataFrame([("u", h, n, n, 1.0, 0.0, 0.0, 0) for h, n in enumerate(counts)], "user string, window_id long, auth_count long, unique_computers long, fanout_rate double, mean_gap double, new_computer_ratio double, off_hours int")
    found = {r["window_id"]: (r["raw_auth_count_zscore"], r["reasons"]) for r in identity.reasons(identity.zscores(hours)).collect()}
    assert found[20][0] > 3 and found[20][1] == []
    assert len(found[19][1]) == 2


def test_centrality_searches_from_nodes_with_links_only(spark, monkeypatch):
    """A root, three nodes under it, many leaves: batches are as many as these four ask for."""
    links = [("r", f"n{i}") for i in range(3)] + [(f"n{i % 3}", f"c{i}") for i in range(300)]
    edges = spark.createDataFrame(links, "src string, dst string")
    nodes = edges.select("src").union(edges.select("dst")).distinct().toDF("node_id")
    calls, plain = [], graph._dependencies
    monkeypatch.setattr(graph, "_dependencies", lambda chosen, links: calls.append(1) or plain(chosen, links))
    got = {r["node_id"]: (r["betweenness"], r["closeness"]) for r in graph.centrality(nodes, edges, pairs=1_000).collect()}
    assert len(calls) == 2 and len(got) == 304
    assert abs(got["n0"][0] - 100 / (303 * 302)) < 1e-12 and got["r"] == (0.0, 0.0)
    assert abs(got["c7"][1] - 2 / 3 * 2 / 303) < 1e-12


def test_one_brand_and_size_is_many_keys(spark, tmp_path):
    prices = [i * 0.9 - 100 for i in range(2_000)]
    spark.createDataFrame([(i, "b", 1, p) for i, p in enumerate([*prices, None])], "p_partkey long, p_brand string, p_size int, p_retailprice double").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    rows = QUERIES["rel_join_range"](spark, str(tmp_path)).withColumn("task", F.spark_partition_id()).collect()
    assert {(r["a_key"], r["b_key"]) for r in rows} == {(i, j) for i in range(2_000) for j in range(i + 1, min(i + 7, 2_000)) if prices[i] < prices[j] < prices[i] + 5}
    assert len({r["task"] for r in rows}) > 1 and len(rows) == len({(r["a_key"], r["b_key"]) for r in rows})


def test_rounds_of_communities_broadcast_nothing(spark, monkeypatch):
    plans, plain = [], graph.spool
    monkeypatch.setattr(graph, "spool", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or plain(df))
    edges = spark.createDataFrame([(f"n{i % 3}", f"c{i}") for i in range(30)], "src string, dst string")
    found = graph.communities(edges.select("src").union(edges.select("dst")).distinct().toDF("node_id"), edges)
    assert found.select("community").distinct().count() == 3
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)


def test_small_members_share_a_task(spark, tmp_path):
    """Two hundred archives of three small members, and a member that is larger than what a task takes of small ones."""
    big = "".join(f'{{"x": "{"y" * 1_000}"}}\n' for _ in range(20_000))
    for i in range(200):
        with zipfile.ZipFile(tmp_path / f"{i}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            for name in ("a.csv", "b.json", "c.ndjson"):
                z.writestr(name, "x\n1\n2\n" if name == "a.csv" else '[{"x": 1}]' if name == "b.json" else '{"x": 1}\n')
            if i == 7:
                z.writestr("big.ndjson", big)
    (tmp_path / "no.zip").write_text("no archive")
    found = sources.read_archives(spark, str(tmp_path)).withColumn("task", F.spark_partition_id()).cache()
    assert found.count() == 800 + 20_000 and found.select("path").distinct().count() == 601
    assert found.rdd.getNumPartitions() < 300
    assert found.filter("member = 'big.ndjson'").select("task").distinct().count() == 1


def test_a_user_is_one_value_of_the_state():
    """Fifty hours of a user in a batch are one write and one timer, not one each."""
    done = []
    value = SimpleNamespace(exists=lambda: False, get=lambda: None, update=lambda v: done.append("write"))
    handle = SimpleNamespace(getValueState=lambda *a: value, registerTimer=lambda t: done.append("timer"))
    p = stateful._Behaviour()
    p.init(handle)
    frame = pd.DataFrame({"hour": range(50), "us": [h * identity.HOUR_US for h in range(50)], "computer": ["a"] * 50})
    (told,) = p.handleInputRows(("u",), iter([frame]), None)
    assert sorted(done) == ["timer", "write"] and len(told) == 50


def test_keys_of_a_bucket_are_one_value_of_the_state(spark, tmp_path):
    """Two hundred keys are as many states as there are buckets; null is a key like any other."""
    keys = [*(f"k{i}" for i in range(200)), None]
    for k, at in enumerate((0, 300, 601)):
        spark.createDataFrame([(key, (at + 1_700_000_000) * 1_000_000 + n) for n, key in enumerate(keys)], "key string, us long").coalesce(1).write.json(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema("key string, us long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).json(str(tmp_path / "in"))
    query = streaming.ttl_dedup(stream, "key", "us", buckets=8).writeStream.format("memory").queryName("bucketed").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted((r["key"] or "", r["us"] // 1_000_000 - 1_700_000_000) for r in spark.table("bucketed").collect())
    assert got == sorted((k or "", t) for k in keys for t in (0, 601))
    assert streaming.counters(query)["state_rows"] <= 8


def test_long_queries_are_scored_by_document(spark, monkeypatch):
    """No row for each pair of query and document; ranks and scores are those of the sum over pairs, also where batches cut a document."""
    docs = spark.range(300).select("id", F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(30)), lambda k: F.concat(F.lit("word"), ((F.col("id") % 60) * 7 + k * k) % 40))).alias("text"))
    postings, lengths = retrieval.index(docs, "id", "text")
    asked = docs.filter("id % 50 = 3").select(F.concat(F.lit("q"), "id").alias("query"), F.explode(retrieval.tokens(F.col("text"))).alias("term"))
    monkeypatch.setattr(retrieval, "LONG", 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = retrieval.bm25(asked, postings, lengths, "query", "id", 4, docs.filter("id % 9 > 0").select("id"))
        got = sorted((r["query"], r["rank"], r["id"], round(r["score"], 9)) for r in found.collect())
        assert "sum(" not in found._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(retrieval, "TERMS", 0)
    want = retrieval.bm25(asked, postings, lengths, "query", "id", 4, docs.filter("id % 9 > 0").select("id"))
    assert got == sorted((r["query"], r["rank"], r["id"], round(r["score"], 9)) for r in want.collect()) and len(got) == 24


def test_provider_search_makes_no_pairs(spark, monkeypatch):
    """No row for each pair of query and document, and only documents that were found meet a hit; ranks and scores are those of
    the sum over pairs, which is left to keys that repeat or are null."""
    source = F.when(F.col("id") % 3 == 0, "sigma").when(F.col("id") % 3 == 1, "attack").otherwise("policy")
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(30)), lambda k: F.concat(F.lit("word"), ((F.col("id") % 60) * 7 + k * k) % 40)))
    docs = spark.range(300).select(source.alias("source"), F.concat(F.lit("d"), "id").alias("document_id"), F.when(F.col("id") % 50 > 0, text).alias("text"), F.array(F.col("id") % 17 + 0.5, F.lit(1.0)).alias("vector"))
    asked = spark.range(12).select((F.col("id") * 25 + 3).alias("id")).select(F.concat(F.lit("q"), "id").alias("query_id"), text.alias("text"), F.array("id", F.lit(1.0)).cast("array<double>").alias("q"))
    routed = asked.withColumn("providers", F.when(F.col("query_id") == "q3", F.array(F.lit("policy"))).otherwise(F.array(F.lit("attack"), F.lit("sigma"), F.lit("nobody"))))
    made = search.corpus_tokens(docs, F.col("text"))
    odd = made.unionByName(made.filter("document_id = 'd4'")).unionByName(made.limit(1).withColumn("document_id", F.lit(None).cast("string")))
    rows = lambda df: sorted((r["query_id"], r["source"], r["_p"], r["document_id"] or "", round(r["score"], 9)) for r in df.collect())
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = search.lexical(routed, made, 4)
        got, by_pair = rows(found), search.lexical(routed, odd, 4)
        assert "sum(" not in plan(found) and "sum(" in plan(by_pair)
        assert search.lexical(routed.filter("false"), made).count() == 0 and search.lexical(routed, made.filter("false")).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    seen, plain = [], search.spool
    monkeypatch.setattr(search, "spool", lambda df: (lambda out: (seen.append((out.columns, out.count())), out)[1])(plain(df)))
    assert search.search(asked, docs, F.col("text"), "vector", 3).count() == 36
    assert [n for columns, n in seen if "description" in columns] and all(n <= 120 for columns, n in seen if "description" in columns)
    monkeypatch.setattr(retrieval, "TERMS", 0)
    assert got == rows(search.lexical(routed, made, 4)) and len(got) == 4 + 11 * 2 * 4
