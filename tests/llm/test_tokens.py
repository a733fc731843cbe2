"""Encoding, counting and packing against the libraries, by fuzzing and on edge cases."""

import random

import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from arcspan.llm import bpe, packing, token_counts

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, out string"


def _texts():
    rng = random.Random(7)
    chars = [chr(c) for c in range(32, 127)] + list("äßéÑœ…—“  　 日本語🙂\n\t\x1c'")
    made = ["".join(rng.choice(chars) for _ in range(rng.choice([1, 5, 40]))) for _ in range(150)]
    return [None, "", " ", "\n\n  x", "a" * 5000, " " * 3000, "don't we'll", "<|endoftext|> and <|endoftext|>", "the the", "the the", *made]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, t, "clash") for k, t in enumerate(_texts())], SCHEMA)


def test_encoding_is_that_of_the_library(spark, docs):
    data = bpe.read_ranks(RANKS)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.parse_ranks(data), special_tokens={})
    rows = bpe.decode(bpe.encode(docs, data, pattern=public_tokenizers.PATTERN), data).collect()
    for r in rows:
        assert bpe.unpack(r["ids"]) == own.encode_ordinary(r["text"] or "")
        assert r["decoded"] == (r["text"] or "").encode()
    assert len(rows) == docs.count() and rows[0]["out"] == "clash"


def test_own_merges_by_brute_force():
    """A small vocabulary, against merging the lowest-ranked neighbours until none is left."""
    rng = random.Random(3)
    ranks = {bytes([c]): k for k, c in enumerate(b"abc")}
    while len(ranks) < 40:
        a, b = rng.choice(list(ranks)), rng.choice(list(ranks))
        if len(a + b) < 7:
            ranks.setdefault(a + b, len(ranks))
    encoder = bpe.Encoder(ranks)
    for _ in range(500):
        text = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 30)))
        parts = [bytes([c]) for c in text]
        while text not in ranks:
            pairs = [(ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if not pairs:
                break
            k = min(pairs)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        want = [ranks[text]] if text in ranks else [ranks[p] for p in parts]
        assert encoder.encode_piece(text) == want


def test_decode_rejects_foreign_ids(spark):
    bad = spark.createDataFrame([(bytearray(bpe.pack([99_999])),)], "ids binary")
    with pytest.raises(Exception, match="vocabulary"):
        bpe.decode(bad, bpe.read_ranks(RANKS)).collect()


def test_counts_are_those_of_the_library(spark, docs):
    own = Tokenizer.from_file(JSON)
    for r in token_counts.token_counts(docs, JSON, out="out").collect():
        assert r["out"] == len(own.encode(r["text"] or "", add_special_tokens=False).ids)


def test_every_character_is_encoded_alike():
    """The fast way's letters, numbers and spaces are the library's."""
    from arcspan.llm import pretoken, vocab

    ids, own = vocab.ids_for(vocab.read_tokenizer(JSON)), Tokenizer.from_file(JSON)
    texts = [f"a{chr(c)} 1{chr(c)}{chr(c)} {chr(c)}b" for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    for text, want in zip(texts, own.encode_batch(texts, add_special_tokens=False)):
        if pretoken.settled(text):
            assert ids(text) == want.ids, repr(text)


@pytest.mark.parametrize("limit", [1024, 64])
def test_packing(spark, docs, limit):
    own = Tokenizer.from_file(JSON)
    rows = packing.pack(packing.cut(docs, JSON, limit=limit), limit).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for d in docs.collect():
        want = own.encode(d["text"] or "", add_special_tokens=False).ids + [2]
        pieces = sorted(by_doc[d["doc_id"]], key=lambda r: r["piece"])
        assert [p["piece"] for p in pieces] == list(range(len(pieces)))
        assert [x for p in pieces for x in bpe.unpack(p["ids"])] == want
        assert all(p["length"] == limit for p in pieces[1:]) and [p["start"] for p in pieces] == [sum(q["length"] for q in pieces[:k]) for k in range(len(pieces))]
    for some in by_sequence.values():
        at = 0
        for r in sorted(some, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= limit
    bins = []  # first-fit decreasing, for comparison
    for x in sorted((r["length"] for r in rows), reverse=True):
        k = next((k for k, b in enumerate(bins) if b + x <= limit), None)
        if k is None:
            bins.append(x)
        else:
            bins[k] += x
    assert len(by_sequence) <= len(bins)


def test_plan_uses_every_piece():
    rng = random.Random(5)
    for _ in range(30):
        counts = {rng.randrange(1, 101): rng.randrange(1, 50) for _ in range(rng.randrange(1, 20))}
        used = {}
        for bin_, times in packing.plan(counts, 100):
            assert sum(bin_) <= 100
            for x in bin_:
                used[x] = used.get(x, 0) + times
        assert used == counts


def test_two_pieces_replace_the_smallest():
    assert packing.plan({60: 1, 30: 1, 21: 1, 19: 1}, 100)[0][0] == [60, 21, 19]


def test_pack_rejects_what_does_not_fit(spark):
    for bad in (0, 65, None):
        with pytest.raises(ValueError):
            packing.pack(spark.createDataFrame([(1, bad)], "doc_id long, length long"), 64)


def test_empty_tables(spark, docs):
    none = docs.filter("false")
    assert bpe.encode(none, bpe.read_ranks(RANKS)).count() == 0
    assert token_counts.token_counts(none, JSON).count() == 0
    assert packing.pack(packing.cut(none, JSON)).count() == 0


def test_long_texts(spark):
    """Texts of a megabyte and more, of words, of one word, and of characters that go to the library."""
    long = ["word and more " * 90_000, "x" * 1_200_000, "é " * 600_000, "\u0378 odd " * 150_000]
    df = spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")
    own, ranks = Tokenizer.from_file(JSON), bpe.read_ranks(RANKS)
    want = {k: own.encode(t, add_special_tokens=False).ids for k, t in enumerate(long)}
    counts = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(df, JSON).collect()}
    assert counts == {k: len(v) for k, v in want.items()}
    back = {r["doc_id"]: bytes(r["decoded"]) for r in bpe.decode(bpe.encode(df, ranks, pattern=public_tokenizers.PATTERN), ranks).collect()}
    assert back == {k: t.encode() for k, t in enumerate(long)}
    pieces = {}
    for r in packing.pack(packing.cut(df, JSON)).collect():
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["length"], r["start"]))
    for k, ids in want.items():
        assert sum(n for _, n, _ in pieces[k]) == len(ids) + 1 and sorted(pieces[k])[0][2] == 0 and len({p for p, _, _ in pieces[k]}) == len(pieces[k])


def test_packing_of_clashing_names_and_repeated_ids(spark):
    df = spark.createDataFrame([(1, "a b", 7, 8), (1, "a b", 7, 8), (None, "c", 7, 8), (2, None, 7, 8)], "doc_id long, text string, sequence_id long, offset long")
    rows = packing.pack(packing.cut(df, JSON)).collect()
    assert sorted((r["doc_id"] or -1) for r in rows) == [-1, 1, 1, 2]
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 4 and len({r["sequence_id"] for r in rows}) == 1


def test_packing_keeps_columns_named_like_its_own(spark):
    names = ["_part", "_row", "_length", "_rank", "_before", "_of", "_n", "c0", "C1", "Offset"]
    df = spark.createDataFrame([(i, 10 + i % 5, *[f"{n}{i}" for n in names]) for i in range(40)], "doc_id long, length long, " + ", ".join(f"`{n}` string" for n in names)).repartition(3)
    out = packing.pack(df, 64)
    assert out.columns == ["doc_id", "length", *names[:-1], "sequence_id", "offset"]
    rows = out.collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(40)) and all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in names[:-1])
    used = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert used.get(r["sequence_id"], 0) == r["offset"] and r["offset"] + r["length"] <= 64
        used[r["sequence_id"]] = r["offset"] + r["length"]
