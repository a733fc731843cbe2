"""Authentication behaviour: user-hour windows, leakage-free history z-scores, reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sinks import spool
from . import series

HOUR_US = 3_600_000_000
#: Windows of history that a z-score needs; the least deviation that counts; the clip.
LEAST_HISTORY, LEAST_STD, CLIP = 3, 1e-4, 10.0


def user_hours(df: DataFrame, user: str = "user_id", us: str = "us", computer: str = "k") -> DataFrame:
    """One row per user and active hour: volumes, fan-out, gaps and the share of new computers.

    A computer is new in the first hour that its user reaches it, found by a window over (user,
    computer) and no self-join. Gaps are 0 with fewer than two events. Rows with a null user or
    time are left out; null computers count as none.
    """
    u = F.col(us)
    rows = df.filter(F.col(user).isNotNull() & u.isNotNull()).select(F.col(user).alias("user"), u.alias("us"), F.col(computer).alias("computer"), F.floor(u / HOUR_US).alias("window_id"))
    first = F.min("window_id").over(Window.partitionBy("user", "computer"))
    rows = rows.withColumn("new", F.when(first == F.col("window_id"), F.col("computer"))).withColumn("gap", (F.col("us") - F.lag("us").over(Window.partitionBy("user", "window_id").orderBy("us"))))
    span = F.max("us") - F.min("us")
    n = F.count("*")
    out = rows.groupBy("user", "window_id").agg(
        n.alias("auth_count"),
        F.countDistinct("computer").alias("unique_computers"),
        F.countDistinct("new").alias("new_computers"),
        (span / HOUR_US).alias("active_hours"),
        F.when(n > 1, span / (n - 1) / 1e6).otherwise(0.0).alias("mean_gap"),
        F.coalesce(F.min("gap") / 1e6, F.lit(0.0)).alias("min_gap"),
        F.coalesce(F.max("gap") / 1e6, F.lit(0.0)).alias("max_gap"),
    )
    uniq = F.col("unique_computers")
    hour = F.pmod(F.col("window_id"), F.lit(24))
    return out.withColumns({
        "fanout_rate": uniq / F.greatest(F.col("active_hours"), F.lit(0.001)),
        "new_computer_ratio": F.when(uniq > 0, F.col("new_computers") / uniq).otherwise(0.0),
        "hour": hour.cast("int"),
        "off_hours": ((hour < 8) | (hour > 20)).cast("int"),  # hour 20 itself is within hours
        "has_gap": (F.col("auth_count") >= 2).cast("int"),
    })


def history_zscore(value: Column, user: str = "user", order: str = "window_id") -> Column:
    """How far a value lies from the user's earlier windows, in their population deviations.

    The current window is excluded; nulls among the earlier ones don't count; with fewer than three
    of them, or next to no deviation, the score is 0.
    """
    before = Window.partitionBy(user).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    n, mean, std = F.count(value).over(before), F.avg(value).over(before), F.stddev_pop(value).over(before)
    return F.when((n < LEAST_HISTORY) | (std < LEAST_STD) | std.isNull(), 0.0).otherwise((value - mean) / std)


def zscores(hours: DataFrame) -> DataFrame:
    """`user_hours` with raw and clipped z-scores; gap history has windows of two events or more."""
    values = {
        "auth_count": F.col("auth_count").cast("double"),
        "unique_computers": F.col("unique_computers").cast("double"),
        "fanout_rate": F.col("fanout_rate"),
        "mean_auth_gap": F.when(F.col("auth_count") >= 2, F.col("mean_gap")),
    }
    out = hours
    for name, value in values.items():
        raw = F.coalesce(history_zscore(value), F.lit(0.0))
        out = out.withColumn(f"raw_{name}_zscore", raw)
    for name in values:
        out = out.withColumn(f"{name}_zscore", F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), F.col(f"raw_{name}_zscore"))))
    return out


def temporal_split(hours: DataFrame, share: float = 0.8, order: str = "window_id") -> DataFrame:
    """`hours` with split: train up to the window at `share` of the distinct windows, then test.

    The hours are written once; the cut-off is one aggregate over them (distinct windows are as many
    as the data has hours) and one row, joined by broadcast.
    """
    hours = spool(hours)
    windows = F.array_sort(F.collect_set(order))
    cut = hours.agg(F.element_at(windows, F.greatest(F.floor(F.size(windows) * share), F.lit(1)).cast("int")).alias("_cut"))
    return hours.join(F.broadcast(cut)).withColumn("split", F.when(F.col(order) <= F.col("_cut"), "train").otherwise("test")).drop("_cut")


def reasons(row: DataFrame) -> DataFrame:
    """`row` (with `zscores`' columns) and the list of reasons that it stands out.

    Scores are compared to nine digits, as in `masks`: one that lies on a limit is not above it.
    """
    z = lambda name: F.round(F.col(f"raw_{name}_zscore"), 9)
    above = lambda text, x: F.format_string(text, x)
    rules = [
        F.when(F.col("new_computer_ratio") > 0.5, above("%.1f%% of accessed computers are new for this user", F.col("new_computer_ratio") * 100)),
        F.when(z("auth_count") > 3, above("authentication volume is %.1f standard deviations above user baseline", z("auth_count"))),
        F.when(z("unique_computers") > 3, above("computer traversal is %.1f standard deviations above user baseline", z("unique_computers"))),
        F.when(F.col("off_hours") == 1, F.lit("activity occurred outside configured normal hours")),
        F.when(F.col("fanout_rate") > 10, above("high host traversal velocity: %.1f computers/hour", F.col("fanout_rate"))),
        F.when(z("mean_auth_gap") > 3, above("authentication timing gap is %.1f standard deviations above user baseline", z("mean_auth_gap"))).when(
            z("mean_auth_gap") < -3, above("authentication timing gap is %.1f standard deviations below user baseline", F.abs(z("mean_auth_gap")))
        ),
        F.when(z("fanout_rate") > 3, above("host traversal velocity is %.1f standard deviations above user baseline", z("fanout_rate"))),
    ]
    return row.withColumn("reasons", F.array_compact(F.array(*rules)))


def anomaly_score(raw: str, low: str | float, high: str | float) -> Column:
    """A model's raw score turned to 0..1, larger for more anomalous; 0 if there is no range."""
    lo, hi = (F.col(x) if isinstance(x, str) else F.lit(x) for x in (low, high))
    return F.when(hi > lo, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (hi - F.col(raw)) / (hi - lo)))).otherwise(0.0)


def baseline(df: DataFrame, entity: str, metric: str, value: str, order: str) -> DataFrame:
    """Count, mean, sum of squared deviations, population deviation and last value of each entity's metric."""
    x = F.col(value)
    out = df.filter(x.isNotNull()).groupBy(entity, metric).agg(F.count(x).alias("count"), F.avg(x).alias("mean"), F.var_pop(x).alias("_v"), F.max_by(x, F.col(order)).alias("last_value"))
    return out.withColumns({"m2": F.col("_v") * F.col("count"), "std": F.sqrt("_v"), "is_established": F.col("count") >= 10}).drop("_v")


def deviation(value: Column, count: Column, mean: Column, std: Column) -> Column:
    """Deviations from a baseline: null below three observations; without spread 0 or infinite."""
    flat = F.when(value == mean, 0.0).otherwise(F.lit(float("inf")))
    return F.when(count < 3, None).when(std == 0, flat).otherwise(F.abs(value - mean) / std)


def reset_baselines(df: DataFrame, gone: DataFrame, entity: str) -> DataFrame:
    """Observations, or baselines, without those of the entities named."""
    return df.join(gone.select(entity).distinct(), entity, "left_anti")


def baseline_counts(df: DataFrame, entity: str, metric: str) -> DataFrame:
    """How many entities, metrics and baselines there are."""
    return df.agg(F.count_distinct(entity).alias("entities"), F.count_distinct(metric).alias("metrics"), F.count_distinct(entity, metric).alias("baselines"))


def masks(scored: DataFrame) -> DataFrame:
    """`zscores` rows with service_like, low_activity and strong_deviation.

    Like a service account: as busy as the busiest hundredth of hours, yet close to its own history and
    with few new computers. Low activity: nothing that could stand out. Strong deviation: far above the
    user's history, or many new computers among several or out of hours. Scores are compared to nine
    digits, so one that lies on a limit is on the same side whatever the order of sums.
    """
    busy = series.percentiles(scored.select(F.lit(0).alias("_all"), "auth_count"), ["_all"], "auth_count", [0.99]).select(F.col("p")[0].alias("_busy"))  # one row
    z = lambda name: F.abs(F.round(F.col(f"{name}_zscore"), 9))
    far = F.lit(False)
    for name in ("auth_count", "unique_computers", "fanout_rate"):
        far = far | (F.round(F.col(f"raw_{name}_zscore"), 9) >= 5.0)
    new, computers, off = F.col("new_computer_ratio"), F.col("unique_computers"), F.col("off_hours") == 1
    return scored.join(F.broadcast(busy)).withColumns({
        "service_like": (F.col("auth_count") >= F.col("_busy")) & (z("auth_count") < 2) & (z("unique_computers") < 2) & (new < 0.2),
        "low_activity": (F.col("auth_count") <= 2) & (computers <= 2) & (new == 0.0) & ~off,
        "strong_deviation": far | ((new >= 0.5) & (computers >= 5)) | (off & (new >= 0.5)),
    }).drop("_busy")
