"""Every registered query against its SQL, on the smallest tables."""

import math
import os
from collections import Counter

import pytest

from arcspan.queries import FLAGSHIP, ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    return None if v is None else str(v)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_registry():
    assert FLAGSHIP in QUERIES and set(ORACLES) <= set(QUERIES)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = Counter(tuple(_plain(r[c]) for c in columns) for r in df.collect())
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = Counter(tuple(_plain(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert got == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", ["graph_centrality", "graph_communities"])
def test_whole_graph(spark, name):
    read = lambda t: spark.read.parquet(f"{SF}/{t}.parquet")
    want = {f"c{r[0]}" for r in read("customer").select("c_custkey").collect()} | {f"n{r[0]}" for r in read("nation").select("n_nationkey").collect()} | {f"r{r[0]}" for r in read("nation").select("n_regionkey").collect()}
    assert {r["node_id"] for r in QUERIES[name](spark, SF).collect()} == want


def test_bm25_uses_all_tokens(spark, tmp_path):
    """Against brute force; the words and identifiers that decide are longer than four letters."""
    docs = ["firewall blocked CVE-2024-12345 again", "firewall resting", "exfiltration from 10.0.0.1 blocked", "the", None]
    asks = ["exfiltration blocked", "cve-2024-12345", "10.0.0.1"]
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(asks)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    terms = [{"firewall", "block", "cve-2024-12345"}, {"firewall", "rest"}, {"exfiltration", "10.0.0.1", "block"}, set(), set()]
    wanted = [{"exfiltration", "block"}, {"cve-2024-12345"}, {"10.0.0.1"}]
    mean, n, want = sum(map(len, terms)) / 5, 5, {}
    for q, words in enumerate(wanted):
        for d, has in enumerate(terms):
            for w in words & has:
                df = sum(w in t for t in terms)
                part = math.log((n - df + 0.5) / (df + 0.5) + 1) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * len(has) / mean))
                want[q, d] = want.get((q, d), 0) + part
    got = {(r["item_id"], r["doc_id"]): r["score"] for r in QUERIES["bm25_topk"](spark, str(tmp_path)).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 2e-6 for k in want)
    assert QUERIES["rerank_normalise"](spark, str(tmp_path)).count() == len(want)


def test_entry_survives_what_the_operators_lack(monkeypatch):
    """Without a library that the training-data operators need, all other queries are still there."""
    import sys

    import __spark_entry__

    for name in [m for m in sys.modules if m.startswith("arcspan.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "public_tokenizers", None)
    assert set(__spark_entry__.queries()) == set(QUERIES) and set(__spark_entry__.oracle_sql()) == set(ORACLES)
