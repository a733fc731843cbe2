"""Scenarios with known truth, and an evaluation of detectors, attribution and automation on them.

Scenarios are seeded by a hash of their number, so they are the same on any cluster; they are not
those of another generator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import evaluation, response

#: Kinds of scenario: share, whether malicious, and each detector's usual score (fixed values).
SCENARIOS = {
    "benign": (0.40, 0, {"network": 0.10, "identity": 0.10, "endpoint": 0.10, "ot": 0.05}),
    "noisy": (0.10, 0, {"network": 0.45, "identity": 0.30, "endpoint": 0.20, "ot": 0.10}),
    "brute_force": (0.15, 1, {"network": 0.60, "identity": 0.90, "endpoint": 0.20, "ot": 0.05}),
    "malware": (0.15, 1, {"network": 0.50, "identity": 0.30, "endpoint": 0.95, "ot": 0.10}),
    "lateral_movement": (0.10, 1, {"network": 0.80, "identity": 0.75, "endpoint": 0.60, "ot": 0.10}),
    "ot_attack": (0.10, 1, {"network": 0.40, "identity": 0.20, "endpoint": 0.30, "ot": 0.95}),
}


def scenarios(spark: SparkSession, n: int, seed: int = 42, spread: float = 0.15, missing: float = 0.1) -> DataFrame:
    """`n` rows: id, scenario, truth, each detector's score (null with a chance of `missing`) and
    confidence, honeypot, diversity."""
    uniform = lambda *salt: F.pmod(F.xxhash64("id", F.lit(seed), *map(F.lit, salt)), F.lit(1_000_003)) / 1_000_003.0
    u, upto, kind = uniform("kind"), 0.0, F.lit("benign")
    for name, (share, _, _) in SCENARIOS.items():
        kind = F.when(u >= upto, F.lit(name)).otherwise(kind)
        upto += share
    df = spark.range(n).withColumn("scenario", kind)
    truth = F.lit(0)
    for name, (_, bad, _) in SCENARIOS.items():
        truth = F.when(F.col("scenario") == name, bad).otherwise(truth)
    df = df.withColumn("truth", truth)
    for d in scoring.WEIGHTS:
        centre = F.lit(0.0)
        for name, (_, _, scores) in SCENARIOS.items():
            centre = F.when(F.col("scenario") == name, scores[d]).otherwise(centre)
        x = centre + (uniform(d, "x") - 0.5) * 2 * spread
        df = df.withColumn(f"{d}_score", F.when(uniform(d, "missing") >= missing, F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))))
        df = df.withColumn(f"{d}_confidence", 0.6 + 0.4 * uniform(d, "c"))
    active = sum((F.coalesce(F.col(f"{d}_score"), F.lit(0.0)) > 0.3).cast("int") for d in scoring.WEIGHTS)
    return df.withColumns({"honeypot": ((F.col("truth") == 1) & (uniform("honeypot") < 0.05)).cast("int"), "diversity": active})


def evaluate(df: DataFrame, threshold: float = 0.5, cuts: dict[str, float] | None = None) -> DataFrame:
    """Rows subject, metric, value: each detector's and the combined score's rates and areas, and how
    many malicious cases the policy answers by itself.

    `df`: the columns of `scenarios`; all detectors are counted in one pass (long form).
    """
    score = scoring.meta_score(F.col("diversity"), F.col("honeypot"))
    whole = df.withColumn("_m", score)
    subjects = [F.struct(F.lit(d).alias("subject"), F.coalesce(F.col(f"{d}_score"), F.lit(0.0)).alias("score"), F.lit((cuts or {}).get(d, threshold)).alias("cut")) for d in scoring.WEIGHTS]
    subjects.append(F.struct(F.lit("combined").alias("subject"), F.col("_m.score").alias("score"), F.lit(threshold).alias("cut")))
    long = whole.select("truth", F.explode(F.array(*subjects)).alias("s")).select("truth", "s.*")
    rates = evaluation.confusion(long, F.col("truth"), (F.col("score") >= F.col("cut")).cast("int"), ["subject"])
    names = ["precision", "recall", "fpr", "accuracy", "f1"]
    out = rates.select("subject", F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])).alias("x")).select("subject", "x.*")
    for d in [*scoring.WEIGHTS, "combined"]:
        area = evaluation.roc_auc(long.filter(F.col("subject") == d), "truth", "score")
        out = out.unionByName(area.select(F.lit(d).alias("subject"), F.lit("roc_auc").alias("metric"), F.col("roc_auc").alias("value")))
    gate = response.policy_gate(F.lit("Laptop"), F.lit(None).cast("string"), F.lit(True), F.col("_m.score"), F.col("_m.confidence"), F.lit("LOW"), F.col("_m.score") * 100)
    bad = whole.filter("truth = 1").agg(F.avg((gate["decision"] == "AUTO").cast("double")).alias("value"))
    return out.unionByName(bad.select(F.lit("policy").alias("subject"), F.lit("automation").alias("metric"), "value"))


def attribution(df: DataFrame, predicted: Column, actual: Column, ks: tuple[int, ...] = (1, 3)) -> DataFrame:
    """The shares of cases whose first k predictions, or any, hold an actual one."""
    made = [F.avg(evaluation.top_matches(predicted, actual, k).cast("double")).alias(f"top{k}") for k in ks]
    return df.agg(*made, F.avg(F.arrays_overlap(predicted, actual).cast("double")).alias("any"))
