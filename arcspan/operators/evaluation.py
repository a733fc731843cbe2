"""Evaluation: confusion metrics, ROC and PR areas, sweeps, ranking metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import running


def confusion(df: DataFrame, truth: Column, predicted: Column, keys: list[str] | None = None) -> DataFrame:
    """Counts and rates of a binary decision, by `keys` if given; undefined rates are 0."""
    c = lambda a, b: F.count_if((truth == a) & (predicted == b))
    out = df.groupBy(*(keys or [])).agg(c(1, 1).alias("tp"), c(0, 1).alias("fp"), c(0, 0).alias("tn"), c(1, 0).alias("fn"))
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = out.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "fpr": ratio(fp, fp + tn), "accuracy": ratio(tp + tn, tp + fp + tn + fn)})
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", ratio(2 * p * r, p + r))


def _by_score(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Positives and rows of each distinct score: ties are one step of a curve."""
    return df.filter(F.col(truth).isNotNull() & F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.sum(F.col(truth).cast("long")).alias("p"), F.count("*").alias("n"))


def roc_auc(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Area under the ROC curve: the chance that a positive scores above a negative, ties half.

    Rows are first combined by score, so the running sum passes over distinct scores only, and
    those are sorted by ranges.
    """
    steps = _by_score(df, truth, score).withColumn("neg", F.col("n") - F.col("p"))
    won = running(steps, [F.col("s")], {"below": F.col("neg")}).withColumn("w", F.col("p") * (F.col("below") + F.col("neg") / 2))
    return won.agg((F.sum("w") / (F.sum("p") * F.sum("neg"))).alias("roc_auc"))


def average_precision(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Average precision (steps) and the trapezoid area under the precision-recall curve."""
    curve = running(_by_score(df, truth, score), [F.desc("s")], {"tp": F.col("p"), "seen": F.col("n")})
    precision = (F.col("tp") + F.col("p")) / (F.col("seen") + F.col("n"))
    last = F.when(F.col("seen") > 0, F.col("tp") / F.col("seen")).otherwise(1.0)
    curve = curve.withColumns({"pr": precision, "step": F.col("p") / F.col("tp_all"), "last": last})
    return curve.agg(F.sum(F.col("step") * F.col("pr")).alias("average_precision"), F.sum(F.col("step") * (F.col("pr") + F.col("last")) / 2).alias("pr_auc"))


def sweep(df: DataFrame, truth: str, score: str, thresholds: list[float]) -> DataFrame:
    """Confusion metrics at each threshold, in one aggregation."""
    long = df.select(F.col(truth).alias("t"), F.col(score).alias("s"), F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    return confusion(long, F.col("t"), (F.col("s") >= F.col("threshold")).cast("int"), ["threshold"])


def top_matches(predicted: Column, actual: Column, k: int) -> Column:
    """Whether any of the first k predictions is among the actual ones."""
    return F.arrays_overlap(F.slice(predicted, 1, k), actual)


def ranking(df: DataFrame, query: str, rank: str, relevant: str, k: int) -> DataFrame:
    """Precision and recall at k, reciprocal rank and NDCG at k of each query."""
    r, rel = F.col(rank), F.col(relevant).cast("int")
    total = F.sum(rel)
    hits = F.sum(F.when(r <= k, rel).otherwise(0))
    dcg = F.sum(F.when(r <= k, rel / F.log2(r + 1)).otherwise(0.0))
    out = df.groupBy(query).agg((hits / k).alias("precision"), F.when(total > 0, hits / total).otherwise(0.0).alias("recall"), F.coalesce(1 / F.min(F.when(rel == 1, r)), F.lit(0.0)).alias("mrr"), dcg.alias("_dcg"), total.alias("_t"))
    ideal = F.aggregate(F.when(F.col("_t") > 0, F.sequence(F.lit(1), F.least(F.col("_t"), F.lit(k)).cast("int"))).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    return out.withColumn("ndcg", F.when(ideal > 0, F.col("_dcg") / ideal).otherwise(0.0)).drop("_dcg", "_t")


def roll_up(df: DataFrame, status: str) -> DataFrame:
    """Counts by status and the share of automatic decisions."""
    s = F.col(status)
    return df.agg(F.count("*").alias("total"), F.count_if(s == "AUTO").alias("auto"), F.count_if(s == "ESCALATE").alias("escalated"), F.avg((s == "AUTO").cast("double")).alias("automation_rate"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int = 10) -> DataFrame:
    """Counts over equal bins, the last one closed; what lies outside is left out."""
    x = F.col(value)
    place = F.least(F.floor((x - low) / ((high - low) / bins)), F.lit(bins - 1))
    return df.filter((x >= low) & (x <= high)).groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def value_counts(df: DataFrame, column: str, n: int) -> DataFrame:
    """The n most frequent values, ties by value."""
    return df.groupBy(column).agg(F.count("*").alias("count")).orderBy(F.desc("count"), column).limit(n)
