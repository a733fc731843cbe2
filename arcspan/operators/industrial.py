"""Industrial time series: column roles, sliding windows, statistics, integrity, calibration.

Series are in long form: one row per tag and time, with `idx` numbering a tag's rows from 0.
Standard deviations are sample ones, as are covariances; the calibrator's is of the population.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sinks import spool
from . import series

LENGTH, STRIDE = 60, 10
# Parts of column names that tell a role.
ACTUATOR = ["fcv", "vlv", "valve", "pump", "state", "status_flag", "pmp", "sv"]
SETPOINT = ["setpoint", "_sp", "set_point", "ref"]
CONTROLLER = ["ctrl", "pid", "mv", "_op", "control"]


def classify_columns(df: DataFrame, time: str, label: str | None) -> dict[str, str]:
    """Each column's role, from its name, type and number of distinct values (one pass over all)."""
    types = dict(df.dtypes)
    found = df.agg(*[F.count_distinct(F.col(c)).alias(c) for c in df.columns]).first().asDict()
    out = {}
    for c, kind in types.items():
        name, n = c.lower(), found[c]
        numeric, floating = kind in ("int", "bigint", "smallint", "tinyint", "float", "double") or kind.startswith("decimal"), kind in ("float", "double")
        if c == time:
            out[c] = "Timestamp"
        elif c == label:
            out[c] = "Label"
        elif n == 0:
            out[c] = "Unknown"
        elif n == 2 or any(k in name for k in ACTUATOR):
            out[c] = "Actuator"
        elif any(k in name for k in SETPOINT):
            out[c] = "Setpoint"
        elif any(k in name for k in CONTROLLER):
            out[c] = "Controller"
        elif n <= 10 and not floating:
            out[c] = "Status"
        else:
            out[c] = "Sensor" if numeric else "Unknown"
    return out


def to_long(df: DataFrame, time: str, label: str | None, roles: dict[str, str] | None = None) -> DataFrame:
    """A wide frame as rows (ts, role, tag, value, attack); roles name the tags' prefixes."""
    roles = roles or classify_columns(df, time, label)
    few = {c: r for c, r in roles.items() if r in ("Sensor", "Actuator", "Setpoint", "Controller", "Status")}
    made = [F.struct(F.lit(r).alias("role"), F.lit(f"{r.lower()}_{c}").alias("tag"), F.col(c).cast("double").alias("value")) for c, r in few.items()]
    attack = F.coalesce(F.col(label).cast("int"), F.lit(0)) if label else F.lit(0)
    return df.select(F.col(time).alias("ts"), attack.alias("attack"), F.explode(F.array(*made)).alias("x")).select("ts", "attack", "x.*")


def limit_tags(roles: dict[str, str], sensors: int = 15, actuators: int = 8, controllers: int = 8) -> dict[str, str]:
    """At most so many columns of each role, in column order, when the plan is made."""
    most, seen, out = {"Sensor": sensors, "Actuator": actuators, "Controller": controllers}, {}, {}
    for c, r in roles.items():
        seen[r] = seen.get(r, 0) + 1
        if seen[r] <= most.get(r, 1 << 30):
            out[c] = r
    return out


def index_rows(df: DataFrame, tag: str, order: list[str]) -> DataFrame:
    """`df` with idx: a tag's rows by time, from 0; a tag's rows are numbered in many tasks."""
    return series.numbered(df, [tag], order, "idx")


def sliding_windows(df: DataFrame, tag: str, length: int = LENGTH, stride: int = STRIDE) -> DataFrame:
    """A row for each window that a row is in: exactly `length` rows, one every `stride`; what is
    left at a tag's end is dropped. Only the columns given are repeated (length / stride times)."""
    # The number of a tag's rows comes by a join on their counts: no tag is gathered for it.
    total = df.groupBy(F.col(tag).alias("_tag")).agg(F.count("*").alias("_total"))
    first = F.greatest(F.ceil((F.col("idx") - length + 1) / stride), F.lit(0))
    last = F.least(F.floor(F.col("idx") / stride), F.floor((F.col("_total") - length) / stride))
    windows = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<long>"))
    out = df.join(total, F.col(tag).eqNullSafe(F.col("_tag")))
    return out.select(*df.columns, F.explode(windows).alias("window_id"))


def describe(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Location, spread, quartiles and energy of each group's values."""
    x = F.col(value)
    out = df.groupBy(*keys).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.var_samp(x).alias("variance"), F.min(x).alias("low"), F.max(x).alias("high"),
        F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"), F.sum(x * x).alias("energy"),
    )
    q = F.col("_q")
    return out.withColumns({
        "range": F.col("high") - F.col("low"), "p25": q[0], "median": q[1], "p75": q[2], "iqr": q[2] - q[0],
        "cv": F.when(F.abs("mean") > 1e-9, F.col("std") / F.col("mean")).otherwise(0.0),
    }).drop("_q")


def dynamics(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Differences, crossings, runs and oscillations of each group's series.

    zero_crossings counts changes of the sign about the mean, with 0 a sign of its own;
    flatline is the longest run of zero differences, max_state_duration one more.
    The series are scanned in segments, so one of any length is spread over many tasks.
    """
    parts = series.cut(df.select(*keys, order, value), keys, [order])
    x, at = F.col(value), series.along([order])
    whole = parts.groupBy(series.KEY).agg(
        F.avg(x).alias("_mean"), F.coalesce(F.var_samp(x), F.lit(0.0)).alias("variance"), F.count("*").alias("_n"),
        (F.max_by(value, order) - F.min_by(value, order)).alias("_moved"), *[F.first(k).alias(k) for k in keys],
    )
    rows = series.with_halo(parts, [order], 2).join(whole.select(series.KEY, "_mean"), series.KEY)
    rows = rows.withColumns({"_d": x - F.lag(x).over(at), "_s": F.signum(x - F.col("_mean"))})
    rows = rows.withColumns({
        "_cross": (F.col("_s") != F.lag("_s").over(at)).cast("int"),
        "_turn": F.when(F.lag("_d").over(at).isNotNull(), (F.signum("_d") != F.signum(F.lag("_d").over(at))).cast("int")),
    })
    d = F.col("_d")
    sums = {"_abs": F.abs(d), "_ds": d.isNotNull().cast("int"), "_crosses": F.col("_cross"), "_turns": F.col("_turn"), "_moves": F.coalesce(d != 0, F.lit(False)).cast("int")}
    found = series.runs(rows.filter(f"{series.HALO} = 0"), [order], d == 0, sums).join(whole, series.KEY)
    return found.select(
        *keys, F.when(F.col("_ds") > 0, F.col("_abs") / F.col("_ds")).otherwise(0.0).alias("diff_abs_mean"), (F.col("_moved") / F.col("_n")).alias("rate_of_change"),
        F.coalesce("_crosses", F.lit(0)).alias("zero_crossings"), F.col("longest").alias("flatline"), (F.col("longest") + 1).alias("max_state_duration"),
        F.coalesce("_turns", F.lit(0)).alias("oscillations"), F.col("_moves").alias("state_changes"), (F.col("_moves") / F.col("_n")).alias("transition_rate"), "variance",
    )


#: Features of a role's tags that `dynamics` gives, and their names there (fixed values).
OF_CONTROLLERS = {"variance": "variance", "state_changes": "change_count"}


def controller(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Variance and number of changes of each group's series."""
    return dynamics(df, keys, order, value).select(*keys, *[F.col(a).alias(b) for a, b in OF_CONTROLLERS.items()])


def correlated_pairs(df: DataFrame, columns: list[str], least: float = 0.85, top: int = 10, most: int = 30) -> DataFrame:
    """The `top` pairs among the first `most` columns whose correlation reaches `least` in either
    direction: variable_1, variable_2, correlation (absolute), in one pass; ties by name."""
    few = columns[:most]
    pairs = [(a, b) for k, a in enumerate(few) for b in few[k + 1 :]]
    if not pairs:
        return df.sparkSession.createDataFrame([], "variable_1 string, variable_2 string, correlation double")
    one = df.agg(*[F.corr(F.col(a), F.col(b)).alias(f"_{k}") for k, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("variable_1"), F.lit(b).alias("variable_2"), F.abs(F.col(f"_{k}")).alias("correlation")) for k, (a, b) in enumerate(pairs)])
    long = one.select(F.explode(rows).alias("x")).select("x.*")
    return long.filter(~F.isnan("correlation") & (F.col("correlation") >= least)).orderBy(F.desc("correlation"), "variable_1", "variable_2").limit(top)


def histogram_entropy(df: DataFrame, keys: list[str], value: str, bins: int = 10) -> DataFrame:
    """Entropy in bits over equal bins of each group's range, the last one closed; constant series 0."""
    own = Window.partitionBy(*keys)
    x, low, high = F.col(value), F.min(value).over(own), F.max(value).over(own)
    rows = df.filter(x.isNotNull()).withColumns({"_lo": low, "_hi": high})
    place = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((x - F.col("_lo")) / ((F.col("_hi") - F.col("_lo")) / bins)), F.lit(bins - 1))).otherwise(0)
    counts = rows.groupBy(*keys, place.alias("_bin")).agg(F.count("*").alias("_n"))
    share = F.col("_n") / F.sum("_n").over(own)
    return counts.withColumn("_p", share).groupBy(*keys).agg((-F.sum(F.col("_p") * F.log2("_p"))).alias("entropy")).withColumn("entropy", F.abs("entropy"))


def pairwise(df: DataFrame, keys: list[str], columns: list[str], most: int = 6) -> DataFrame:
    """Correlation and covariance of each pair of the first columns, in one aggregation; undefined as 0."""
    few = columns[:most]
    made = []
    for k, a in enumerate(few):
        for b in few[k + 1 :]:
            made += [F.nanvl(F.coalesce(F.corr(a, b), F.lit(0.0)), F.lit(0.0)).alias(f"corr_{a}_{b}"), F.coalesce(F.covar_samp(a, b), F.lit(0.0)).alias(f"cov_{a}_{b}")]
    return df.groupBy(*keys).agg(*made)


def integrity(df: DataFrame, tag: str, us: str) -> DataFrame:
    """A series' order: duplicates, median interval, gaps over 1.5 times it, missing rows."""
    parts = series.with_halo(series.cut(df.select(tag, us), [tag], [us]), [us], 1)
    steps = parts.withColumn("_gap", F.col(us) - F.lag(us).over(series.along([us]))).filter(f"{series.HALO} = 0")
    # Gaps repeat, so they are counted before they are ranked or compared.
    gaps = spool(steps.groupBy(tag, "_gap").agg(F.count("*").alias("_c")))
    typical = series.percentiles(gaps.withColumn("_gap", F.when(F.col("_gap") > 0, F.col("_gap"))), [tag], "_gap", [0.5], "_c").select(tag, F.col("p")[0].alias("interval"))
    facts = df.groupBy(tag).agg(F.count("*").alias("n"), F.count_distinct(us).alias("distinct"), (F.max(us) - F.min(us)).alias("span"))
    wide = gaps.join(typical.withColumnRenamed(tag, "_t"), F.col(tag).eqNullSafe(F.col("_t"))).groupBy(tag, "interval").agg(F.sum(F.when(F.col("_gap") > 1.5 * F.col("interval"), F.col("_c")).otherwise(0)).alias("gaps"))
    expected = F.floor(F.col("span") / F.col("interval")) + 1
    out = facts.join(wide.withColumnRenamed(tag, "_t"), F.col(tag).eqNullSafe(F.col("_t")))
    return out.select(tag, "n", (F.col("n") - F.col("distinct")).alias("duplicates"), "interval", "gaps", F.greatest(expected - F.col("distinct"), F.lit(0)).alias("missing"))


def missing_profile(df: DataFrame, tag: str, order: str, value: str) -> DataFrame:
    """Share of nulls, longest run of them, distinct values, constant (1) and near-constant (5)."""
    parts = series.cut(df.select(tag, order, value), [tag], [order])
    longest = series.runs(parts, [order], F.col(value).isNull()).withColumnRenamed("longest", "longest_missing")
    out = parts.groupBy(series.KEY, tag).agg(F.avg(F.col(value).isNull().cast("double")).alias("missing_share"), F.count_distinct(value).alias("distinct"))
    return out.join(longest, series.KEY).drop(series.KEY).withColumns({"constant": F.col("distinct") <= 1, "near_constant": F.col("distinct") <= 5})


def percentiles(df: DataFrame, tag: str, value: str, at: tuple[float, ...] = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)) -> DataFrame:
    """Exact percentiles of each tag, ranked over many tasks."""
    return series.percentiles(df, [tag], value, list(at))


def top_shifts(shifts: DataFrame, tag: str, top: int = 30) -> DataFrame:
    """The tags of `shift` that moved most (a report of `top`)."""
    return shifts.orderBy(F.desc("normalised_shift"), tag).limit(top)


def shift(df: DataFrame, tag: str, value: str, attack: str) -> DataFrame:
    """How far attack rows lie from normal ones: by mean, by normal deviation, ratio of deviations."""
    x, bad = F.col(value), F.col(attack) == 1
    out = df.groupBy(tag).agg(F.avg(F.when(bad, x)).alias("ma"), F.avg(F.when(~bad, x)).alias("mn"), F.stddev_samp(F.when(bad, x)).alias("sa"), F.stddev_samp(F.when(~bad, x)).alias("sn"))
    away = F.abs(F.col("ma") - F.col("mn"))
    return out.select(tag, away.alias("mean_shift"), (away / (F.col("sn") + 1e-6)).alias("normalised_shift"), (F.col("sa") / (F.col("sn") + 1e-6)).alias("std_ratio"))


def calibrate(raw: Column, mean: Column, std: Column) -> Column:
    """An isolation score as 0..1: the logistic function of its deviation, larger for more anomalous."""
    z = F.when(std > 0, (-raw - mean) / std).otherwise(0.0)
    return 1 / (1 + F.exp(-z))


def band(score: Column) -> Column:
    """Severity of a calibrated score."""
    return F.when(score >= 0.85, "CRITICAL").when(score >= 0.70, "HIGH").when(score >= 0.45, "MEDIUM").otherwise("LOW")


def risk(anomaly: Column, probability: Column) -> Column:
    """Anomaly and attack probability combined, or the anomaly alone."""
    return F.when(probability > 0, 0.6 * anomaly + 0.4 * probability).otherwise(anomaly)


def confidence(severity: Column) -> Column:
    """Confidence in a severity."""
    return F.when(severity.isin("HIGH", "CRITICAL"), 0.85).otherwise(0.65)


def shifted_variables(features: DataFrame, keys: list[str], baselines: DataFrame, top: int = 5) -> DataFrame:
    """The tags that lie farthest from their baseline; without one, those of the widest range.

    `features`: keys, tag, mean, range; `baselines`: tag, base_mean, base_std (one row per tag).
    """
    joined = features.join(baselines, "tag", "left")
    std = F.when(F.col("base_std") > 0, F.col("base_std")).otherwise(1.0)
    away = F.coalesce(F.abs(F.col("mean") - F.col("base_mean")) / std, F.abs("range"))
    ordered = F.array_sort(F.collect_list(F.struct((-away).alias("d"), "tag")))
    return joined.groupBy(*keys).agg(F.transform(F.slice(ordered, 1, top), lambda x: x["tag"]).alias("shifted"))


def reasons(features: DataFrame, keys: list[str], risk_score: str) -> DataFrame:
    """Reasons from long features (name, value): each at most once, then the overall one."""
    n, v = F.col("name"), F.col("value")
    bare = lambda end: F.regexp_replace(F.regexp_replace(n, f"{end}$", ""), "(sensor|actuator)_", "")
    text = (
        F.when(n.endswith("_flatline_duration") & (v > 45), F.concat(F.lit("Sensor flatline detected: "), bare("_flatline_duration"), F.lit(" remained constant for "), v.cast("int").cast("string"), F.lit("s")))
        .when(n.endswith("_oscillation_count") & (v > 15), F.concat(F.lit("Unexpected process oscillation detected for sensor: "), bare("_oscillation_count")))
        .when(n.endswith("_rate_of_change") & (v > 5), F.concat(F.lit("Rapid value increase observed for sensor: "), bare("_rate_of_change")))
        .when(n.endswith("_rate_of_change") & (v < -5), F.concat(F.lit("Rapid value decrease observed for sensor: "), bare("_rate_of_change")))
        .when(n.startswith("cross_corr_") & (v < 0.35) & (v != 0), F.concat(F.lit("Cross-sensor correlation dropped for pair: "), F.regexp_replace(n, "cross_corr_|sensor_", "")))
        .when(n.endswith("_state_changes") & (v == 0) & (F.col(risk_score) >= 0.70) & F.lower(n).contains("fcv"), F.concat(F.lit("Control loop state locked: actuator "), bare("_state_changes"), F.lit(" failed to transition")))
    )
    out = features.groupBy(*keys).agg(F.array_sort(F.collect_set(text)).alias("reasons"), F.max(risk_score).alias("_r"))
    whole = F.when(F.col("_r") >= 0.75, F.array(F.lit("Window deviates strongly from historical normal industrial baseline"))).otherwise(F.array().cast("array<string>"))
    return out.withColumn("reasons", F.concat("reasons", whole)).drop("_r")
