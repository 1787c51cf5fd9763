"""Ranks over very many values: counts, range-sorted, with running sums and the sums of the ranges before."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from iolens.runtime import written


def cumulative(rows: DataFrame, groups: list[str], value: str) -> DataFrame:
    """groups, value, n (how often), upto (values of the group at most as large), whole (values of the group); nulls don't count."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("n"))
    counts = written(counts, "counts")  # range partitioning reads its input twice
    spread = counts.repartitionByRange(*groups, value).sortWithinPartitions(*groups, value)
    spread = written(spread.withColumn("part", F.spark_partition_id()), "ranges")  # every later step sees the same partitions
    sums = spread.groupBy(*groups, "part").agg(F.sum("n").alias("s"))  # a row per group and range it lies in
    w = Window.partitionBy(*groups)
    before = F.coalesce(F.sum("s").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*groups, "part", before.alias("base"), F.sum("s").over(w).alias("whole"))
    run = F.sum("n").over(Window.partitionBy("part", *groups).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    on = reduce(lambda a, b: a & b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*groups, "part"]])
    return spread.withColumn("run", run).alias("a").join(sums.alias("b"), on).select(*[f"a.{c}" for c in [*groups, value, "n"]], (F.col("a.run") + F.col("b.base")).alias("upto"), "b.whole")


def percentiles(rows: DataFrame, group: str, value: str, points: list[float]) -> DataFrame:
    """group, at: the percentiles (0 to 1) of the group's values by linear interpolation, as an array of doubles."""
    cum = cumulative(rows, [group], value)

    def nth(place: str) -> Column:
        return F.min(F.when(F.col("upto") > F.expr(place), F.col(value).cast("double")))

    picks = [x for i, p in enumerate(points) for x in (nth(f"floor((whole - 1) * {p}D)").alias(f"l{i}"), nth(f"ceil((whole - 1) * {p}D)").alias(f"h{i}"))]
    found = cum.groupBy(group).agg(F.max("whole").alias("whole"), *picks)

    def between(i: int, p: float) -> Column:
        at = f"((whole - 1) * {p}D)"
        return F.expr(f"if(l{i} = h{i}, l{i}, l{i} * (ceil({at}) - {at}) + h{i} * ({at} - floor({at})))")

    return found.select(group, F.array(*[between(i, p) for i, p in enumerate(points)]).alias("at"))
