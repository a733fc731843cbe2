"""Order statistics over a whole table without a one-task sort.

Rows are range-partitioned by the order and written once; each partition's totals (one row a
partition) are summed from the first on, and every row adds what its own partition holds before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sinks import spool


def running(df: DataFrame, order: list[Column], values: dict[str, Column]) -> DataFrame:
    """`df` with, for each name of `values`, the sum over all rows before this one in `order` and the
    sum over all rows (name_all). Rows that tie in `order` come in any order."""
    names = list(values)
    cut = spool(df.withColumns(values).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    totals = cut.groupBy("_part").agg(*[F.sum(n).alias(f"_t_{n}") for n in names])
    # One row for each partition of the sort: the only thing that is ordered in one task.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    offsets = totals.select("_part", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in names], *[F.sum(f"_t_{n}").over(every).alias(f"{n}_all") for n in names])
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = cut.withColumns({f"_b_{n}": F.coalesce(F.sum(n).over(within), F.lit(0)) for n in names}).join(F.broadcast(offsets), "_part")
    return out.withColumns({n: F.col(f"_o_{n}") + F.col(f"_b_{n}") for n in names}).drop("_part", *[f"_{k}_{n}" for n in names for k in "ob"])


def placed(df: DataFrame, order: list[Column]) -> DataFrame:
    """`df` with _p, each row's place in the order from 0, and _p_all, the number of rows."""
    return running(df, order, {"_p": F.lit(1).cast("long")})
