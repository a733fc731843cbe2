"""Toxicity classifier: gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of lexicon words, weighted and not, how near they stand to a
second-person word, and rates of capitals, punctuation and obfuscated spellings. The lexicon is
a short fixed list and, from a bounded sample of labelled documents (`labelled.SAMPLE`), the words
and word beginnings that are much more frequent in toxic documents; their number is bounded
by `LEXICON`. Sampled documents are seen with a lexicon learned without their own fold, and
the calibration is fitted on out-of-fold margins, so neither sees its own labels. `score` is one
map over all whole texts, without a shuffle. Only the text is an input of a score.

Edge cases: null and empty texts have all features 0 and a score like any other; repeated rows
are scored each; without labelled rows the score is 0.5 everywhere; an empty table gives an
empty table; a column with the output's name is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .boosting import Trees, fit as fit_trees, folds, isotonic
from .common import map_arrow, texts

#: Entries of the learned lexicon at most; toxic documents that an entry needs; least log-odds.
LEXICON, LEAST_DOCS, LEAST_ODDS, FOLDS, NEAR = 4_000, 3, 2.0, 4, 4
#: Insults (fixed values).
SEEDS = frozenset("idiot idiots moron morons stupid loser losers scum trash pathetic worthless disgusting dumb imbecile fool garbage filth jerk clown ugly freak".split())
#: Second-person words of the corpus's languages (fixed values).
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deinen sie ihr euch tu te toi ton ta tes vous votre vos ti tú tus su usted ustedes vosotros".split())
_WORD = re.compile(r"[^\W_](?:[\w@$*!'#%+]*[^\W_])?")
_ODD = re.compile(r"[^\W\d_][@$*#%+!\d]+[^\W\d_]|[@$][^\W\d_]|\d[^\W\d_]{3}")
_PLAIN = str.maketrans("@$013457!|", "asoieastil")


def words_of(text: str) -> list[str]:
    """Lower-case words; a word with digits or signs among its letters is also undone."""
    return [w.translate(_PLAIN).replace("*", "") if not w.isalpha() else w for w in _WORD.findall(text.lower())]


def keys_of(word: str) -> tuple[str, ...]:
    """What the lexicon knows a word by: itself and, if it is longer, its beginnings."""
    n = len(word)
    return ("=" + word, "5" + word[:5], "4" + word[:4]) if n > 5 else ("=" + word, "4" + word[:4]) if n > 4 else ("=" + word,)


def features(text: str, lexicon: dict[str, float]) -> list[float]:
    """The features of one text."""
    raw = text.split()
    words = words_of(text)
    n, size = max(len(words), 1), max(len(text), 1)
    known: dict[str, float] = {}
    for w in set(words):
        weight = max([lexicon.get(k, 0.0) for k in keys_of(w)])
        if weight > 0:
            known[w] = weight
    hits = [(i, known[w]) for i, w in enumerate(words) if w in known] if known else []
    seeds = sum(w in SEEDS for w in words) if SEEDS.intersection(known or words) else 0
    near = 0
    for i, _ in hits:
        near += not SECOND_PERSON.isdisjoint(words[max(0, i - NEAR) : i + NEAR + 1])
    weights = sorted((w for _, w in hits), reverse=True)
    top = weights[:5] + [0.0] * 5
    upper = sum(1 for w in raw if len(w) > 1 and w.isupper())
    second = sum(w in SECOND_PERSON for w in words)
    odd = len(_ODD.findall(text))
    return [
        100 * len(hits) / n, float(np.log1p(len(hits))), 100 * sum(weights) / n, float(np.log1p(sum(weights))), float(len(known)),
        top[0], top[1], top[2], top[4], 100 * seeds / n, float(np.log1p(seeds)), 100 * near / n, float(np.log1p(near)), 100 * second / n,
        upper / max(len(raw), 1), text.count("!") / size, text.count("?") / size,
        (text.count("!!") + text.count("??")) / size, (text.count("*") + text.count("#") + text.count("@") + text.count("$") + text.count("%")) / size,
        100 * odd / n, float(np.log1p(n)),
    ]


@dataclass
class Model:
    """Lexicon weights, trees, and the knots of the calibration."""

    lexicon: dict[str, float]
    trees: Trees
    margin: np.ndarray
    probability: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probabilities of rows of features."""
        if not len(self.margin):
            return self.trees.probability(x)
        return np.clip(np.interp(self.trees.margin(x), self.margin, self.probability), 0, 1)


def _weights(counts: list[tuple[str, np.ndarray, np.ndarray]], totals: np.ndarray, without: int | None) -> dict[str, float]:
    """Lexicon weights from documents by fold (toxic, other), leaving one fold out."""
    use = np.array([k != without for k in range(FOLDS)])
    toxic, other = totals[0][use].sum(), totals[1][use].sum()
    out = {"=" + w: 3.0 for w in SEEDS}
    for key, t, o in counts:
        a, b = t[use].sum(), o[use].sum()
        odds = float(np.log((a + 0.5) / (toxic + 1)) - np.log((b + 0.5) / (other + 1)))
        if a >= LEAST_DOCS and odds >= LEAST_ODDS:
            out[key] = odds
    return out


def fit(sample: DataFrame) -> Model:
    """A model fitted to `labelled.sample`'s rows."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold = folds(batch.column(2).to_numpy(zero_copy_only=False)) if len(batch) else []
            rows = [(k, int(f), y) for x, f, y in zip(texts(batch.column(0)), fold, batch.column(1).to_pylist()) for k in {k for w in set(words_of(x)) for k in keys_of(w)}]
            rows += [("", int(f), y) for f, y in zip(fold, batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind) for j, kind in enumerate((pa.string(), pa.int32(), pa.int32()))], ["key", "fold", "label"])

    by = map_arrow(sample.select("text", "label", "key"), explode, "key string, fold int, label int")
    sums = [F.count_if((F.col("fold") == k) & (F.col("label") == y)).alias(f"n{y}_{k}") for y in (1, 0) for k in range(FOLDS)]
    table = by.groupBy("key").agg(*sums)
    toxic = sum(F.col(f"n1_{k}") for k in range(FOLDS))
    other = sum(F.col(f"n0_{k}") for k in range(FOLDS))
    # Entries that can reach the least log-odds; the total row has the empty key.
    whole = [r for r in table.filter("key = ''").collect()]
    totals = np.array([whole[0][1 : 1 + FOLDS], whole[0][1 + FOLDS :]], float) if whole else np.zeros((2, FOLDS))
    ratio = (toxic + 0.5) / (other + 0.5)
    need = float(np.exp(LEAST_ODDS - 0.7) * (totals[0].sum() + 1) / (totals[1].sum() + 1))
    rows = table.filter((F.col("key") != "") & (toxic >= LEAST_DOCS) & (ratio >= need)).orderBy((toxic * F.log(1 + ratio)).desc(), "key").limit(LEXICON).collect()
    counts = [(r[0], np.array(r[1 : 1 + FOLDS], float), np.array(r[1 + FOLDS :], float)) for r in rows]
    lexicons = [_weights(counts, totals, k) for k in range(FOLDS)]
    shared = sample.sparkSession.sparkContext.broadcast(lexicons)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold = folds(batch.column(2).to_numpy(zero_copy_only=False)) if len(batch) else []
            made = [features(x, shared.value[f]) for x, f in zip(texts(batch.column(0)), fold)]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.list_(pa.float64())), batch.column(1), batch.column(2)], ["features", "label", "key"])

    got = map_arrow(sample.select("text", "label", "key"), run, "features array<double>, label int, key long").toPandas().sort_values(["key", "label"], kind="stable")
    if not len(got):
        return Model(_weights(counts, totals, None), fit_trees(np.zeros((0, 1)), np.zeros(0)), np.zeros(0), np.zeros(0))
    x, y, fold = np.array(got["features"].tolist()), got["label"].to_numpy().astype(float), folds(got["key"].to_numpy())
    margin = np.zeros(len(y))
    for k in range(FOLDS):
        if (fold == k).any():
            margin[fold == k] = fit_trees(x[fold != k], y[fold != k], depth=3).margin(x[fold == k])
    return Model(_weights(counts, totals, None), fit_trees(x, y, depth=3), *isotonic(margin, y))


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """`df` with the calibrated probability of label 1 in the column `out`."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in df.schema.fields if f.name != out]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            at = batch.schema.get_field_index
            made = [features(x, model.lexicon) for x in texts(batch.column(at(text)))]
            p = model.score(np.array(made)) if made else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(at(n)) for n in names), pa.array(p, pa.float64())], [*names, out])

    return map_arrow(df, run, T.StructType([*kept, T.StructField(out, T.DoubleType())]))
