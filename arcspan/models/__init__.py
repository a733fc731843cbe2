"""Models: an isolation forest, and gradient boosting by the built-in library."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship


@dataclass
class IsolationForest:
    """Trees in flat arrays: feature (-1 in leaves), threshold, children, path length of leaves."""

    columns: list[str]
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    size: int


def _average_path(n: float) -> float:
    """Mean path length of an unsuccessful search among n points."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def fit_isolation_forest(df: DataFrame, columns: list[str], key: str, trees: int = 100, sample: int = 256, seed: int = 42) -> IsolationForest:
    """A forest on samples of `sample` rows for each tree, drawn by hash of the key: trees * sample
    rows at most come to the driver."""
    bound = trees * sample
    rows = df.select(key, *columns).orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(bound).select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns]).toPandas().to_numpy()
    rng, out = np.random.default_rng(seed), []
    n = min(sample, len(rows))
    limit = int(np.ceil(np.log2(max(n, 2))))
    for _ in range(trees if n else 0):
        x = rows[rng.choice(len(rows), n, replace=False)]
        feature, threshold, left, right, length = [], [], [], [], []

        def grow(part: np.ndarray, depth: int) -> int:
            at = len(feature)
            for a, v in ((feature, -1), (threshold, 0.0), (left, -1), (right, -1), (length, depth + _average_path(len(part)))):
                a.append(v)
            low, high = (part.min(0), part.max(0)) if len(part) else (np.zeros(0), np.zeros(0))
            some = np.flatnonzero(high > low)
            if depth < limit and len(part) > 1 and len(some):
                j = int(rng.choice(some))
                cut = rng.uniform(low[j], high[j])
                feature[at], threshold[at] = j, cut
                left[at] = grow(part[part[:, j] < cut], depth + 1)
                right[at] = grow(part[part[:, j] >= cut], depth + 1)
            return at

        grow(x, 0)
        out.append(tuple(np.array(a) for a in (feature, threshold, left, right, length)))
    return IsolationForest(columns, out, n)


def score_isolation_forest(df: DataFrame, model: IsolationForest, out: str = "raw_score") -> DataFrame:
    """`df` with the anomaly score, negated: lower is more anomalous, as detectors expect."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(columns: pd.DataFrame) -> pd.Series:
        m, x = shared.value, columns.fillna(0.0).to_numpy(dtype=float)
        total = np.zeros(len(x))
        for feature, threshold, left, right, length in m.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                f = feature[at]
                go = f >= 0
                if not go.any():
                    break
                rows = np.flatnonzero(go)
                at[rows] = np.where(x[rows, f[rows]] < threshold[at[rows]], left[at[rows]], right[at[rows]])
            total += length[at]
        scale = _average_path(m.size) * max(len(m.trees), 1)
        return pd.Series(-np.power(2.0, -total / scale) if scale else np.zeros(len(x)))

    return df.withColumn(out, score(F.struct(*[F.col(c).cast("double").alias(c) for c in model.columns])))


def fit_boosted(df: DataFrame, columns: list[str], label: str, weight: str | None = None, rounds: int = 20, depth: int = 4, seed: int = 42):
    """Gradient-boosted trees for two classes, distributed, by `pyspark.ml`; returns the pipeline model."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    assemble = VectorAssembler(inputCols=columns, outputCol="_features", handleInvalid="keep")
    trees = GBTClassifier(featuresCol="_features", labelCol=label, maxIter=rounds, maxDepth=depth, seed=seed)
    return Pipeline(stages=[assemble, trees.setWeightCol(weight) if weight else trees]).fit(df)


def fit_multiclass(df: DataFrame, columns: list[str], label: str, trees: int = 50, depth: int = 8, seed: int = 42):
    """A random forest for several classes, distributed, by `pyspark.ml`."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    index = StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc")
    assemble = VectorAssembler(inputCols=columns, outputCol="_features", handleInvalid="keep")
    return Pipeline(stages=[index, assemble, RandomForestClassifier(featuresCol="_features", labelCol="_label", numTrees=trees, maxDepth=depth, seed=seed)]).fit(df)

