"""Pruned BM25 against scores of all matching postings."""

import math
import random

import pytest
from pyspark.sql import functions as F

from arcspan.operators import retrieval


@pytest.fixture(scope="module")
def corpus(spark):
    """Documents of words by Zipf's law, queries of rare and common ones."""
    rng = random.Random(0)
    words = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    docs = {d: sorted(set(rng.choices(words, weights, k=rng.randrange(2, 60)))) for d in range(1200)}
    docs[5000] = []
    asks = {q: sorted(set(rng.choices(words, weights, k=rng.randrange(1, 9)) + rng.choices(words, k=2))) for q in range(25)} | {90: ["nowhere"], 91: ["w0"], 92: []}
    made = spark.createDataFrame(list(docs.items()), "id long, t array<string>").cache()
    postings = made.select("id", F.explode("t").alias("term"), F.size("t").alias("length"))
    queries = spark.createDataFrame([(q, w) for q, ws in asks.items() for w in ws], "q long, term string")
    return docs, asks, postings, made.select("id", F.size("t").alias("length")), queries


def brute(docs, asks, k, only=None):
    n, mean, df = len(docs), sum(map(len, docs.values())) / len(docs), {}
    for t in docs.values():
        for w in t:
            df[w] = df.get(w, 0) + 1
    out = {}
    for q, ws in asks.items():
        scores = []
        for d, t in docs.items():
            if set(ws) & set(t) and (only is None or d in only):
                scores.append((-round(sum(math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * len(t) / mean)) for w in set(ws) & set(t)), 9), d))
        out |= {(q, r): d for r, (_, d) in enumerate(sorted(scores)[:k], 1)}
    return out


@pytest.mark.parametrize("k, long", [(1, 12), (5, 12), (2000, 12), (5, 0)])
def test_same_rows(corpus, monkeypatch, k, long):
    monkeypatch.setattr(retrieval, "LONG", long)
    docs, asks, postings, lengths, queries = corpus
    got = {(r["q"], r["rank"]): r["id"] for r in retrieval.bm25(queries, postings, lengths, "q", "id", k).collect()}
    assert got == brute(docs, asks, k)


def test_only_some_documents(spark, corpus):
    docs, asks, postings, lengths, queries = corpus
    only = {d for d in docs if d % 7 == 3}
    some = spark.createDataFrame([(d,) for d in only], "id long")
    got = {(r["q"], r["rank"]): r["id"] for r in retrieval.bm25(queries, postings.drop("length"), lengths, "q", "id", 5, some).collect()}
    assert got == brute(docs, asks, 5, only)


def test_few_postings_are_scored(corpus, monkeypatch):
    docs, asks, postings, lengths, queries = corpus
    seen, plain = [], retrieval._scored
    monkeypatch.setattr(retrieval, "_scored", lambda *a: (lambda df: (seen.append(df.count()), df)[1])(plain(*a)))
    retrieval.bm25(queries, postings, lengths, "q", "id", 3).count()
    every = postings.join(queries, "term").count()
    assert len(seen) == 3 and sum(seen) < every / 2
