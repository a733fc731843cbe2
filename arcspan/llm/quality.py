"""Quality classifier: gradient-boosted trees over statistics of a document.

`fit` takes a bounded sample of labelled documents (see `labelled.SAMPLE`), computes their
statistics on the executors and fits the trees on the driver. `score` computes the same
statistics of every whole text and walks the flattened trees, batch by batch: one map, no
shuffle. Only the text is an input of a score.

Edge cases: null and empty texts have all statistics 0 and a score like any other; repeated rows
are scored each; without labelled rows the score is 0.5 everywhere; an empty table gives an
empty table; a column with the output's name is replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .boosting import Trees, fit as fit_trees
from .common import map_arrow, texts

#: Punctuation whose share is a statistic each (fixed values).
MARKS = "!?.,;:|#$%*&@<>{}[]()=_~^\\/\"'-+"
_UPPER = np.zeros(256)
_UPPER[65:91] = 1
_LOWER = np.zeros(256)
_LOWER[97:123] = 1
_DIGIT = np.zeros(256)
_DIGIT[48:58] = 1
_HIGH = np.zeros(256)
_HIGH[128:] = 1
_CLASSES = np.stack([_UPPER, _LOWER, _DIGIT, _HIGH, *(np.eye(256)[ord(c)] for c in MARKS), np.eye(256)[32], np.eye(256)[10]], 1)


def statistics(text: str) -> list[float]:
    """The statistics of one text."""
    words, data = text.split(), text.encode("utf-8", "replace")
    n, size = max(len(words), 1), max(len(data), 1)
    bytes_ = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    shares = (bytes_ @ _CLASSES / size).tolist()
    present = bytes_[bytes_ > 0] / size
    counts = Counter(words)
    common = counts.most_common(3)
    once = sum(1 for c in counts.values() if c == 1)
    pairs = len(set(zip(words, words[1:])))
    lines = [x for x in text.split("\n") if x.strip()]
    n_lines = max(len(lines), 1)
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    upper = sum(map(str.isupper, words))
    plain = sum(map(str.isalpha, words))
    return [
        float(np.log1p(len(words))), float(np.log1p(len(data))), float(lengths.mean()), float(lengths.std()), float(lengths.max()),
        len(counts) / n, once / n, common[0][1] / n if common else 0.0, sum(c for _, c in common) / n, pairs / n, repeats / n,
        upper / n, plain / n, len(lines) / n, len(set(lines)) / n_lines, float(np.log1p(len(lines))), len(text) / size,
        float(-(present * np.log2(present)).sum()) if len(data) else 0.0, *shares,
    ]


def fit(sample: DataFrame, features: Callable[[str], list[float]] = statistics) -> Trees:
    """Trees fitted to `labelled.sample`'s rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [features(x) for x in texts(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.list_(pa.float64())), batch.column(1), batch.column(2)], ["features", "label", "key"])

    rows = map_arrow(sample.select("text", "label", "key"), run, "features array<double>, label int, key long").toPandas()
    rows = rows.sort_values(["key", "label"], kind="stable")  # the same trees however rows were dealt
    if not len(rows):
        return fit_trees(np.zeros((0, 1)), np.zeros(0))
    return fit_trees(np.array(rows["features"].tolist()), rows["label"].to_numpy().astype(float))


def score(df: DataFrame, model: Trees, text: str = "text", out: str = "score") -> DataFrame:
    """`df` with the probability of label 1 in the column `out`."""
    kept = [f for f in df.schema.fields if f.name != out]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index
            made = [statistics(x) for x in texts(batch.column(at(text)))]
            p = model.probability(np.array(made)) if made else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(at(n)) for n in names), pa.array(p, pa.float64())], [*names, out])

    return map_arrow(df, run, T.StructType([*kept, T.StructField(out, T.DoubleType())]))
