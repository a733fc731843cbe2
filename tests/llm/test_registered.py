"""The registered queries themselves: names and types of their columns, folds and limits."""

import os
import zlib

import pytest

from arcspan.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")

COLUMNS = {
    "op1_bpe_roundtrip": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op2_pitman_yor_scores": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op3_quality_classifier": "doc_id bigint, held_out boolean, score double, predicted int",
    "op4_license_scan": "doc_id bigint, license string, containment double, first_word bigint",
    "op5_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op6_ngram_jaccard_join": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op7_embedding_near_dedup": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op8_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op9_best_fit_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op10_hilbert_neighbours": "query_id bigint, rank int, vec_id bigint, score double",
    "op11_drake_kmeans": "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string",
    "op12_line_dedup": "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string",
    "op13_tsqr_whitening": "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double",
}
FOLDS = {"op2_pitman_yor_scores": (10, 0), "op3_quality_classifier": (4, 2), "op5_toxicity": (3, 1)}


def test_all_are_there():
    assert list(queries.QUERIES) == list(COLUMNS)


@pytest.mark.parametrize("name", COLUMNS)
def test_registered(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert ", ".join(f"{n} {k}" for n, k in df.dtypes) == COLUMNS[name]
    rows = df.collect()
    read = lambda t: spark.read.parquet(f"{SF}/{t}.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in read("documents").collect()}
    if name == "op10_hilbert_neighbours":
        ids = {r["vec_id"] for r in read("embeddings").collect()}
        assert {r["query_id"] for r in rows} == {v for v in ids if v % 20 == 0} and all(r["vec_id"] != r["query_id"] for r in rows)
    elif name == "op7_embedding_near_dedup":
        assert {r["vec_id"] for r in rows} == {r["vec_id"] for r in read("embeddings").collect()} and all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in rows)
    elif name == "op11_drake_kmeans":
        assert {r["vec_id"] for r in rows} == {r["vec_id"] for r in read("embeddings").collect()} and sum(r["distance"] for r in rows) == rows[0]["inertia"]
    elif name == "op13_tsqr_whitening":
        assert {(r["vec_id"], r["component"]) for r in rows} == {(r["vec_id"], c) for r in read("embeddings").collect() for c in range(1, 17)}
    elif name not in ("op4_license_scan", "op9_best_fit_packing"):
        assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    if name in FOLDS:
        modulus, held = FOLDS[name]
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == held) for r in rows)
    if "predicted" in df.columns:
        assert all(r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in rows)
    if name == "op8_token_counts":
        assert all(r["n_bytes"] == len(texts[r["doc_id"]].encode()) and r["over_limit"] == (r["n_tokens"] > 512) for r in rows)
    if name == "op9_best_fit_packing":
        assert {r["doc_id"] for r in rows} == set(texts) and all(0 < r["length"] <= 1024 for r in rows)
