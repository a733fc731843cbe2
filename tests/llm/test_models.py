"""Classifiers, language model and pipeline: held-out accuracy, exact sums, stages by brute force."""

import collections
import math
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from arcspan.llm import boosting, labelled, pitman_yor, quality, toxicity


def _words(rng, n):
    return " ".join(rng.choice(["the", "river", "stone", "walks", "green", "morning", "letter", "under", "seven", "quiet"]) + str(rng.randrange(40)) for _ in range(n))


def _corpus():
    rng, rows, labels = random.Random(4), [], []
    for k in range(240):
        bad, toxic = k % 5 == 0, k % 7 == 0
        text = "SPAM!! " * 60 if bad else _words(rng, 80)
        if toxic:
            text += " you stupid idiot, vegrum vegral worthless " * 3
        rows.append((k, text, "en", "src", len(text)))
        labels.append((k, 0 if bad else 1, 1 if toxic else 0))
    return rows, labels


@pytest.fixture(scope="module")
def corpus(spark):
    rows, labels = _corpus()
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = boosting.fit(x[:2000], y[:2000])
    assert ((model.probability(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    slow = np.full(1000, model.base)
    for r, row in enumerate(x[2000:]):
        for t in range(len(model.leaf) // 16):
            node = 0
            for _ in range(4):
                node = 2 * node + 1 + (row[model.feature[t * 15 + node]] > model.threshold[t * 15 + node])
            slow[r] += model.leaf[t * 16 + node - 15]
    assert np.allclose(slow, model.margin(x[2000:]))
    assert boosting.fit(np.zeros((0, 2)), np.zeros(0)).probability(np.zeros((2, 2))).tolist() == [0.5, 0.5]


def test_isotonic_is_monotone_and_calibrated():
    x, p = boosting.isotonic(np.array([1.0, 2, 3, 4]), np.array([0, 1, 0, 1]))
    assert (np.diff(p) >= 0).all() and np.interp(2.5, x, p) == 0.5


@pytest.mark.parametrize("module,label,score", [(quality, "quality", quality.score), (toxicity, "toxic", toxicity.score)])
def test_classifiers(spark, corpus, module, label, score):
    docs, labels = corpus
    more = labels.unionByName(spark.createDataFrame([(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int"))
    model = module.fit(labelled.sample(docs, more, label, F.col("_id") % 3 != 1))
    odd = spark.createDataFrame([(1000, None), (1001, ""), (1002, "x" * 200_000)], "doc_id long, text string")
    out = score(docs.select("doc_id", "text").unionByName(odd).withColumn("score", F.lit("clash")), model).join(labels, "doc_id", "left").collect()
    assert len(out) == 243 and all(0 <= r["score"] <= 1 for r in out)
    held = [r for r in out if r["doc_id"] < 240 and r["doc_id"] % 3 == 1]
    assert np.mean([(r["score"] >= 0.7) == (r[label] == 1) for r in held]) > 0.95
    assert score(docs.filter("false"), model).count() == 0
    empty = module.fit(labelled.sample(docs, labels.filter("false"), label))
    assert score(docs.limit(2), empty).count() == 2


def test_toxicity_learns_word_beginnings(spark, corpus):
    docs, labels = corpus
    model = toxicity.fit(labelled.sample(docs, labels, "toxic"))
    assert any(k.startswith("4vegr") for k in model.lexicon)


def test_language_model(spark):
    rng = random.Random(9)
    texts = [None, "", "Unseen wörd", "a a a\tA b"] + ["".join(rng.choice("ab ") + rng.choice(["the ", "of ", "rare" + str(rng.randrange(50)) + " "]) for _ in range(30)) for _ in range(60)]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, h string")
    out = {r["doc_id"]: r for r in pitman_yor.score(df, F.col("doc_id") % 4 != 2, frequent=64).collect()}
    low = [(t or "").translate({c: c + 32 for c in range(65, 91)}).split() for t in texts]
    counts = collections.Counter(w for k, ws in enumerate(low) if k % 4 != 2 for w in ws)
    ends = sum(k % 4 != 2 for k in range(len(texts)))
    n, v = sum(counts.values()) + ends, len(counts) + 1
    for k, ws in enumerate(low):
        want = sum(math.log10(c + 0.1) for c in [*(counts[w] for w in ws), ends]) - (len(ws) + 1) * math.log10(n + 0.1 * (v + 1))
        r = out[k]
        assert abs(r["base_score"] - want) < 1e-6 and r["n_tokens"] == len(ws) + 1 and r["train_tokens"] == n and r["score"] < 0
        assert r["n_known"] == sum(w in counts for w in ws) + 1
    assert pitman_yor.score(df.filter("false"), F.lit(True)).count() == 0
    assert pitman_yor.score(df, F.lit(False)).count() == len(texts)


def test_language_model_sums_to_one():
    rng = np.random.default_rng(1)
    symbols, contexts = 12, 5
    u, w = np.divmod(np.unique(rng.integers(0, symbols * contexts, 30)), symbols)
    c = rng.integers(1, 500, len(u))
    base = rng.random(symbols)
    base /= base.sum()
    t, of = pitman_yor.seat(c, u, base[w], pitman_yor.Seats(0.6, 500), rng, np.zeros(contexts))
    p = np.array([pitman_yor.predictive(0, 0, c[u == k].sum(), of[k], base, 0.6) for k in range(contexts)])
    p[u, w] = pitman_yor.predictive(c, t, np.bincount(u, c)[u], of[u], base[w], 0.6)
    assert np.allclose(p.sum(1), 1) and (p > 0).all() and (t >= 1).all() and (t <= c).all()
    root = pitman_yor.fit_root(np.array([5.4, 0.0, 1.0, 900.0]))
    assert abs(root.sum() - 1) < 1e-9 and (root > 0).all() and root[3] > root[0] > root[1]
    c, words = np.array([1, 2, 5, 40]), np.array([300, 40, 10, 2])
    tail, unknown = pitman_yor.fit_tail(c, words)
    assert abs((tail * words).sum() + unknown - 1) < 1e-9 and (np.diff(tail) > 0).all()


def _customers(counts, base, d, theta, rng, burn, keep):
    """Mean tables of dishes {dish: customers} of one restaurant, by moving one customer after another."""
    tables = {w: [c] for w, c in counts.items()}
    mean = dict.fromkeys(counts, 0.0)
    for sweep in range(burn + keep):
        for w, c in counts.items():
            for _ in range(c):
                sizes = tables[w]
                k = rng.choices(range(len(sizes)), sizes)[0]
                sizes[k] -= 1
                if not sizes[k]:
                    sizes.pop(k)
                new = (theta + d * sum(map(len, tables.values()))) * base[w]
                k = rng.choices(range(len(sizes) + 1), [*(x - d for x in sizes), new])[0]
                if k == len(sizes):
                    sizes.append(1)
                else:
                    sizes[k] += 1
        if sweep >= burn:
            for w in counts:
                mean[w] += len(tables[w]) / keep
    return mean


def test_seating_agrees_with_one_customer_after_another():
    rng, d = random.Random(3), 0.6
    counts, base = {0: 2, 1: 7, 2: 30, 3: 1, 4: 2}, [0.3, 0.05, 0.4, 0.05, 0.2]
    want = _customers(counts, base, d, 1.0, rng, 200, 4000)
    c = np.array(list(counts.values()))
    got, of = pitman_yor.seat(c, np.zeros(5, int), np.array(base), pitman_yor.Seats(d, 30), np.random.default_rng(0), np.zeros(1), (200, 4000))
    assert abs(of[0] - got.sum()) < 1e-9 and np.allclose(got, list(want.values()), rtol=0.03, atol=0.03)


def test_stirling_numbers():
    s = pitman_yor.Seats(0.5, 40_000)
    assert np.allclose(np.exp(s.log[2, :3]), [0.5 * 1.5, 3 * 0.5, 1.0]) and s.sizes[-1] == pitman_yor.LARGEST
    # One dish that its parent gives surely: the Chinese restaurant process itself.
    rng, c = np.random.default_rng(2), 40
    t = np.ones(4000)
    for i in range(1, c):
        t += rng.random(4000) < (1 + 0.5 * t) / (1 + i)
    got = s.draw(np.full(4000, c), np.zeros(4000), np.ones(4000), rng)
    assert abs(got.mean() - t.mean()) / t.mean() < 0.03 and abs(s.draw(np.full(4000, c), 0.0, 1.0, rng).mean() - t.mean()) / t.mean() < 0.03
    # Rows a tenth apart differ little, and in the end not at all.
    means = [s.draw(np.full(20_000, n), 30.0, 0.1, rng).mean() for n in (128, 131, 8_000, 16_384, 65_536)]
    assert abs(means[1] / means[0] - 1) < 0.03 and abs(means[3] / means[2] - 1) < 0.02 and abs(means[4] / means[3] - 1) < 0.02


def _tables_exactly(c, others, base, d):
    """Mean and spread of the number of tables, by the recurrence over all customers."""
    t, now = np.arange(1, c + 1), np.full(c, -np.inf)
    now[0] = 0.0
    for k in range(1, c):
        after = now + np.log(np.maximum(k - t * d, 1e-300))
        after[1:] = np.logaddexp(after[1:], now[:-1])
        now = np.where(t <= k + 1, after, -np.inf)
    log = now + t * np.log(base) + np.cumsum(np.log(pitman_yor.THETA + d * (others + t - 1)))
    p = np.exp(log - log.max())
    mean = (p * t).sum() / p.sum()
    return mean, np.sqrt((p * t * t).sum() / p.sum() - mean**2)


@pytest.mark.parametrize("d", [0.1, 0.5, 0.75, 0.95])
def test_tables_of_large_dishes(d):
    """Draws with rows and without, few tables and thousands, against the recurrence."""
    rng, n = np.random.default_rng(4), 4_000
    s = pitman_yor.Seats(d, 10**7)
    for c, others, base in [(300, 5, 1e-3), (300, 2_000, 0.05), (3_000, 3_000, 0.01), (3_000, 30_000, 0.2), (3_000, 10**6, 0.1)]:
        mean, spread = _tables_exactly(c, others, base, d)
        args = np.full(n, float(c)), np.full(n, float(others)), np.full(n, base)
        for got in (s.draw(args[0].astype(np.int64), *args[1:], rng), s.draw(args[0].astype(np.int64), float(others), base, rng), s._contour(*args, rng, np.arange(n))):
            assert abs(got.mean() - mean) < 0.005 * mean + 5 * spread / n**0.5, (c, others, base)
            assert got.min() >= 1 and got.max() <= c and abs(got.std() - spread) < 0.1 * spread + 0.02
    # More customers than rows tell: the recurrence at 20,000; then the limit, which is negative binomial.
    mean, _ = _tables_exactly(20_000, 20_000, 0.3, d)
    assert abs(s.draw(np.full(n, 20_000), np.full(n, 20_000.0), np.full(n, 0.3), rng).mean() / mean - 1) < 0.01
    for others, base in [(50.0, 0.01), (20_000.0, 0.05)]:
        if d > 0.5:  # where 10^9 customers are near the limit
            limit = 1 + (pitman_yor.THETA / d + others + 1) * base / (1 - base)
            assert abs(s.draw(np.full(n, 10**9), np.full(n, others), np.full(n, base), rng).mean() / limit - 1) < 0.03
    grown = [s.draw(np.full(n, c), np.full(n, 10**5 * 1.0), np.full(n, 0.5), rng).mean() for c in (10**4, 16_384, 16_385, 10**5, 10**6, 10**7)]
    assert all(b > a * 0.997 for a, b in zip(grown, grown[1:])) and abs(grown[2] / grown[1] - 1) < 0.003


def test_tables_of_a_dish_against_one_customer_after_another():
    """A Gibbs run that moves single customers, from few tables and from many, meets the draws."""
    c, others, base, d, rng = 1_500, 5_000, 0.05, 0.75, random.Random(3)
    got = pitman_yor.Seats(d, c).draw(np.full(4_000, c), np.full(4_000, float(others)), np.full(4_000, base), np.random.default_rng(3)).mean()
    for start in (10, 1_000):
        seat, seen = [i % start for i in range(c)], []
        size = {k: seat.count(k) for k in range(start)}
        for sweep in range(200):
            for i in range(c):
                size[seat[i]] -= 1
                if not size[seat[i]]:
                    del size[seat[i]]
                new = (1 + d * (others + len(size))) * base
                if rng.random() * (c - 1 - d * len(size) + new) < new:
                    seat[i] = (sweep, i)
                else:  # another customer's table, unless the share d that each table gives up is met
                    while True:
                        j = rng.randrange(c)
                        if j != i and rng.random() < 1 - d / size[seat[j]]:
                            break
                    seat[i] = seat[j]
                size[seat[i]] = size.get(seat[i], 0) + 1
            seen.append(len(size))
        assert abs(np.mean(seen[80:]) / got - 1) < 0.03


def _bigrams(rng):
    texts = []
    for _ in range(70):
        w, out = 0, []
        for _ in range(rng.randrange(1, 30)):
            w = (w * 3 + rng.choice([1, 1, 1, 2, 5])) % 11
            out.append(f"w{w}")
        texts.append(" ".join(out))
    return texts


@pytest.mark.parametrize("small", [{}, {"HELD": 200, "CHUNK": 200, "CHUNK_TEXTS": 9, "PART": 100}])
def test_language_model_against_one_customer_after_another(spark, monkeypatch, small):
    """Every text's score, against restaurants seated customer by customer."""
    for name, value in small.items():
        monkeypatch.setattr(pitman_yor, name, value)
    rng = random.Random(5)
    texts = _bigrams(rng)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    out = {r["doc_id"]: r for r in pitman_yor.score(df, F.col("doc_id") % 5 != 1).collect()}
    steps = [list(zip(["<", *t.split()], [*t.split(), ">"])) for t in texts]
    pairs = collections.Counter(s for k, ss in enumerate(steps) if k % 5 != 1 for s in ss)
    seen = collections.Counter(w for (_, w), c in pairs.items() for _ in range(c))
    symbols = [*sorted(w for w in seen if w != ">"), "?", ">"]
    n = {w: max(seen[w], 1) for w in symbols}
    d = pitman_yor.discount(np.array(list(pairs.values())))
    base = {w: n[w] / sum(n.values()) for w in symbols}
    of = lambda u: {w: c for (x, w), c in pairs.items() if x == u}
    contexts = sorted({u for u, _ in pairs})
    first = [_customers(of(u), base, d, 1.0, rng, 20, 60) for u in contexts]
    root = dict(zip(symbols, pitman_yor.fit_root(np.array([sum(t.get(w, 0) for t in first) for w in symbols]))))
    tables = {u: _customers(of(u), root, d, 1.0, rng, 20, 60) for u in contexts}
    for k, ss in enumerate(steps):
        want = 0.0
        for u, w in ss:
            c, t = of(u), tables.get(u, {})
            want += math.log10((c.get(w, 0) - d * t.get(w, 0) + (1 + d * sum(t.values())) * root[w]) / (1 + sum(c.values())))
        assert abs(out[k]["score"] - want) < 0.02 * len(ss) + 0.02, (k, out[k]["score"], want)
    scored = spark.createDataFrame([tuple(r) for r in out.values()], ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    held = pitman_yor.perplexity(scored, F.col("doc_id") % 5 == 1)
    assert 1 < held < 11 and math.isnan(pitman_yor.perplexity(scored.filter("false")))


def test_language_model_knows_rare_words_apart(spark):
    """Each word is a symbol in every context, whatever its share: scores are those of a model that knows all by number."""
    texts = _bigrams(random.Random(5))
    df = spark.createDataFrame(list(enumerate([*texts, "w1 new new", "new w1"])), "doc_id long, text string").coalesce(1)
    few, all_ = ({r["doc_id"]: r for r in pitman_yor.score(df, F.col("doc_id") % 5 != 1, frequent=n).collect()} for n in (2, 1 << 20))
    for k, r in all_.items():
        assert abs(few[k]["score"] - r["score"]) < 0.01 * r["n_tokens"] + 0.01, (k, few[k]["score"], r["score"])
        assert abs(few[k]["base_score"] - r["base_score"]) < 1e-9 and few[k]["n_known"] == r["n_known"]


def test_language_model_draws_all_dishes_of_a_number():
    """As many words as there are take part, not some of them: their mean tables spread by the root of their number."""
    seats = pitman_yor.Seats(0.5, 20_000)
    c, words = np.array([2, 50, 20_000]), np.array([1_000_000, 100_000, 3_000])
    got = np.array([seats.draw(c, 5_000.0, 1e-3, np.random.default_rng(k), words) for k in range(6)])
    each = np.array([[x.std() for x in [seats.draw(np.full(2_000, n), 5_000.0, 1e-3, np.random.default_rng(9))]][0] for n in c])
    assert (np.abs(got - got.mean(0)).max(0) < 4 * each / np.sqrt(words)).all() and (got.std(0) > 0).all()


def test_pipeline_stage_by_stage(spark, corpus, tmp_path):
    docs, labels = corpus
    again = docs.filter("doc_id in (1, 2)").withColumn("doc_id", F.col("doc_id") + 500)
    docs = docs.unionByName(again).unionByName(docs.filter("doc_id = 3"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    kept, columns = spark.read.parquet(str(tmp_path / "documents.parquet")), docs.columns
    ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect())
    for name, stage in corpus_pipeline.STAGES[:3]:
        before, kept = ids(kept), stage(spark, kept, str(tmp_path))
        assert kept.columns == columns
        after = ids(kept)
        if name == "toxicity":
            assert set(before) - set(after) == {k for k in before if k < 240 and k % 7 == 0}
        if name == "quality":
            assert set(before) - set(after) == {k for k in before if k < 240 and k % 5 == 0}
        if name == "near duplicates":
            assert after == sorted(set(before) - {501, 502})
    packed = corpus_pipeline.pack(spark, kept, str(tmp_path))
    assert {r[0] for r in packed.select("doc_id").collect()} == set(after)
    assert ids(corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct()) == after
    assert corpus_pipeline.keep_one_of_similar(spark, docs.filter("false"), str(tmp_path)).count() == 0


def test_pipeline_keeps_other_texts_under_a_repeated_id(spark):
    """Only the copies of document 1 go; of a row that is there twice, one stays."""
    text = lambda word: " ".join(f"{word}{k}" for k in range(40))
    rows = [(1, text("a")), (5, text("a")), (5, text("b")), (6, text("c")), (6, text("d")), (7, text("e")), (7, text("e")), (None, text("a")), (8, None), (8, "")]
    kept = corpus_pipeline.keep_one_of_similar(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    got = sorted(((r[0] or 0, r[1] or "") for r in kept.collect()))
    assert got == sorted([(0, text("a")), (1, text("a")), (5, text("b")), (6, text("c")), (6, text("d")), (7, text("e")), (8, "")])


def test_labelled_sample_is_bounded_by_rows(spark):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(50)] + [(2, None), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (None, 1), (3, None)], "doc_id long, quality int")
    got = sorted((r["text"], r["label"]) for r in labelled.sample(docs, labels, "quality").collect())
    assert got == [("", 1), ("text 9", 1)] and labelled.sample(docs, labels, "quality", bound=1).count() == 1


def test_language_model_of_repeated_rows_and_long_texts(spark):
    rows = [(1, "a b a"), (1, "a b a"), (None, "a b"), (2, "word " * 300_000), (3, None)]
    out = pitman_yor.score(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(True)).collect()
    assert len(out) == 5 and all(r["train_tokens"] == 4 + 4 + 3 + 300_001 + 1 for r in out)
    twice = [r for r in out if r["doc_id"] == 1]
    assert len(twice) == 2 and twice[0]["score"] == twice[1]["score"] and next(r for r in out if r["doc_id"] == 2)["n_tokens"] == 300_001


def test_pipeline_keeps_odd_columns_and_rows(spark, corpus, tmp_path):
    _, labels = corpus
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    good = _words(random.Random(1), 80)
    rows = [(1, good, "t", {"a": "b"}, 5), (1, good, "t", {"a": "c"}, 6), (None, good, "t", None, 7), (None, good, "t", None, 8), (2, None, "t", None, 9), (3, " ", "t", None, 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _toxicity string, m map<string,string>, _ROW long")
    for stage in (corpus_pipeline.drop_toxic, corpus_pipeline.keep_good, corpus_pipeline.keep_one_of_similar):
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    kept = corpus_pipeline.keep_one_of_similar(spark, docs, str(tmp_path)).collect()
    assert sorted((r["doc_id"] or -1) for r in kept) == [-1, -1, 1, 2, 3] and all(r["_toxicity"] == "t" for r in kept)
    assert {r["_toxicity"] for r in corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).collect()} == {"t"}


def test_no_machine_local_spool_on_a_cluster():
    from types import SimpleNamespace

    from arcspan.llm.common import shared_dir

    session = lambda master, folder: SimpleNamespace(sparkContext=SimpleNamespace(master=master), conf=SimpleNamespace(get=lambda *_: folder, set=lambda *_: None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(session("yarn", None))
    assert shared_dir(session("yarn", "hdfs:///x/")) == "hdfs:///x" and shared_dir(session("local[2]", None)).startswith("file:///")


def test_language_model_keeps_little_on_disk(spark, monkeypatch):
    """Dealt steps are compressed and come back as they were; tables that nothing reads again are removed."""
    rng = np.random.default_rng(2)
    words, owner = np.sort(rng.integers(0, 2**63, 400).astype(np.uint64))[np.minimum(rng.zipf(1.3, 40_000), 400) - 1], np.sort(rng.integers(0, 50, 40_000)).astype(np.int32)
    known, none = np.unique(words)[::2], (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    rows = pitman_yor._pack(0, words, owner, np.arange(50) % 2, known, none, 3).to_pylist()
    parts = [pitman_yor._Part(((k, r) for r in rows if r["part"] == k), len(known)) for k in range(3)]
    pairs, steps = sum(len(p.c) for p in parts), sum(len(p.own) for p in parts)
    assert steps == 40_050 and sum(p.c.sum() for p in parts) == sum((owner == k).sum() + 1 for k in range(1, 50, 2))
    assert (np.sum([np.bincount(p.own, minlength=50) for p in parts], axis=0) == np.bincount(owner, minlength=50) + 1).all()
    assert sum(len(r[name]) for r in rows for name in ("w0", "w1", "w2", "times", "own")) < 0.7 * (7 * pairs + 2 * steps)
    spools = []

    class Seen(pitman_yor.Spool):
        def __init__(self, spark):
            super().__init__(spark)
            spools.append(self)

    monkeypatch.setattr(pitman_yor, "Spool", Seen)
    df = spark.createDataFrame([(k, f"a b a b rare{k % 20} a b rare{k % 20}") for k in range(60)], "doc_id long, text string")
    assert pitman_yor.score(df, F.lit(True), frequent=16).count() == 60
    assert sorted(int(p.name) for p in Path(spools[0].root.removeprefix("file://")).iterdir()) == [1, 3, 5, 6, 7]
