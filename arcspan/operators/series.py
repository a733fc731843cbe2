"""Scans along long series that no task holds as a whole.

A series (the rows of a key in an order) is cut into segments: Spark partitions all rows by ranges
of key and order, so a busy key spreads over many tasks, and the rows of one key in one partition are
a segment. What a scan needs of the rows before its segment comes as a carry: a count, the few last
rows (a halo), or the length of the run that is open. Carries are composed over the segments of a
key, one row each, so at most as many rows as there are partitions meet in one task.

Keys may be null or of any type; they are told apart as JSON. Rows that tie in the order stay
in one segment, in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sinks import spool

KEY, PART, HALO = "_k", "_part", "_halo"
#: Bytes (as planned) up to which a table is not worth a sort by ranges: each series is one segment.
SMALL = 16 << 20


def cut(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """`df` with _k (its keys as JSON) and _part (its segment's number), written unless it is small."""
    keyed = df.withColumn(KEY, F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}))
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= SMALL:
        keyed = keyed.withColumn(PART, F.lit(0))
        keyed.whole = True  # nothing is carried
        return keyed
    return spool(keyed.repartitionByRange(KEY, *order).withColumn(PART, F.spark_partition_id()))


def _within() -> Window:
    return Window.partitionBy(KEY, PART)


def before(segments: DataFrame, value: str) -> DataFrame:
    """Of segments (_k, _part, value), the sum of `value` over the segments of the key before each."""
    earlier = Window.partitionBy(KEY).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    return segments.withColumn(value, F.coalesce(F.sum(value).over(earlier), F.lit(0)))


def running(segmented: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """`segmented` with `name`: the sum of `value` over the rows of the key before this one."""
    rows = segmented.withColumn("_w", value)
    if getattr(segmented, "whole", False):
        return _sum_before(rows, order, name).drop("_w")
    offsets = before(rows.groupBy(KEY, PART).agg(F.sum("_w").alias("_o")), "_o")
    return _sum_before(rows, order, "_own").join(offsets, [KEY, PART]).withColumn(name, F.col("_o") + F.col("_own")).drop("_o", "_own", "_w")


def _sum_before(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """The sum of _w over the rows of the segment before each."""
    earlier = _within().orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.coalesce(F.sum("_w").over(earlier), F.lit(0)))


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """`df` with `name`: the place of each row in its series, from 0."""
    return running(cut(df, keys, order), order, F.lit(1).cast("long"), name).select(*df.columns, name)


def with_halo(segmented: DataFrame, order: list[str], rows: int) -> DataFrame:
    """`segmented` with the `rows` rows before each segment repeated in it, marked by _halo = 1.

    Windows over `along` then see what is up to `rows` rows back, whatever segment it is in.
    """
    if getattr(segmented, "whole", False):
        out = segmented.withColumn(HALO, F.lit(0))
        out.whole = True
        return out
    back = F.row_number().over(_within().orderBy(*[F.desc(c) for c in order]))
    last = segmented.withColumn("_b", back).filter(F.col("_b") <= rows).drop("_b")
    # Each segment has one row here at least and `rows` at most.
    last = last.withColumn("_n", F.row_number().over(Window.partitionBy(KEY).orderBy(PART, *order)))
    starts = last.groupBy(KEY, PART).agg((F.min("_n") - 1).alias("_at")).withColumnRenamed(PART, "_to")
    needed = last.withColumn("_at", F.explode(F.sequence("_n", F.col("_n") + rows - 1))).join(starts, [KEY, "_at"])
    needed = needed.select(*[F.col("_to").alias(PART) if c == PART else F.col(c) for c in segmented.columns])
    return segmented.withColumn(HALO, F.lit(0)).unionByName(needed.withColumn(HALO, F.lit(1)))


def along(order: list[str]) -> Window:
    """The window of a segment and its halo, in order."""
    return _within().orderBy(F.desc(HALO), *order)


def runs(rows: DataFrame, order: list[str], flag: Column, sums: dict[str, Column] | None = None) -> DataFrame:
    """The longest run of rows of a key in which `flag` holds: _k, longest, and the `sums` over all rows.

    `rows` are segments without a halo. Of each segment what counts is its longest run, the runs that touch
    its ends and whether it is one run as a whole; these compose to the runs across segments.
    """
    holds = F.coalesce(flag, F.lit(False))
    sums = sums or {}
    breaks = F.sum(F.when(holds, 0).otherwise(1)).over(_within().orderBy(*order))
    one = rows.select(KEY, PART, holds.alias("_f"), *[x.alias(n) for n, x in sums.items()], breaks.alias("_r"))
    one = one.groupBy(KEY, PART, "_r").agg(F.count_if("_f").alias("_len"), *[F.sum(n).alias(n) for n in sums])
    segments = one.groupBy(KEY, PART).agg(
        F.max("_len").alias("_inner"), F.max_by("_len", "_r").alias("_suffix"), F.sum(F.when(F.col("_r") == 0, F.col("_len")).otherwise(0)).alias("_prefix"),
        (F.max("_r") == 0).alias("_whole"), *[F.sum(n).alias(n) for n in sums],
    )
    by = Window.partitionBy(KEY).orderBy(PART)
    # A run that is open at a segment's end began in the last segment that is not one run.
    segments = segments.withColumn("_g", F.sum(F.when(F.col("_whole"), 0).otherwise(1)).over(by))
    open_ = F.sum(F.when(F.col("_whole"), F.col("_inner")).otherwise(F.col("_suffix"))).over(Window.partitionBy(KEY, "_g").orderBy(PART))
    segments = segments.withColumn("_open", open_).withColumn("_carry", F.coalesce(F.lag("_open").over(by), F.lit(0)))
    longest = F.max(F.greatest("_inner", F.col("_carry") + F.col("_prefix"))).alias("longest")
    return segments.groupBy(KEY).agg(longest, *[F.sum(n).alias(n) for n in sums])


def percentiles(df: DataFrame, keys: list[str], value: str, at: list[float], weight: str | None = None) -> DataFrame:
    """Exact percentiles of each group, interpolated between ranks: the keys and p (array<double>, null
    without values). With `weight` a row stands for so many equal values.

    Equal values are counted first; the distinct ones are ranked by a running sum of their counts
    over segments, and those at the wanted ranks are picked, so no task holds a group's values.
    """
    times = F.count(value) if weight is None else F.sum(F.when(F.col(value).isNotNull(), F.col(weight)).otherwise(0))
    counted = df.groupBy(*keys, F.col(value).alias("_v")).agg(times.alias("_c"))
    segmented = cut(counted, keys, ["_v"])
    ranked = running(segmented, ["_v"], F.col("_c"), "_low")
    totals = segmented.groupBy(KEY).agg(F.sum("_c").alias("_n"))
    ranked = ranked.join(totals, KEY)
    place = [(F.col("_n") - 1) * p for p in at]
    pick = lambda r: F.max(F.when((F.col("_low") <= r) & (r < F.col("_low") + F.col("_c")), F.col("_v").cast("double")))
    chosen = [x for k, p in enumerate(place) for x in (pick(F.floor(p)).alias(f"_a{k}"), pick(F.ceil(p)).alias(f"_b{k}"))]
    found = ranked.groupBy(KEY, "_n").agg(*[F.first(k).alias(k) for k in keys], *chosen)

    def between(k: int) -> Column:
        pos, low, high = place[k], F.col(f"_a{k}"), F.col(f"_b{k}")
        return F.when(F.floor(pos) == F.ceil(pos), low).when(low == high, low).otherwise((F.ceil(pos) - pos) * low + (pos - F.floor(pos)) * high)

    some = F.array(*[between(k) for k in range(len(at))])
    return found.select(*keys, F.when(F.col("_n") > 0, some).alias("p"))
