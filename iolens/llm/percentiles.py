"""Percentiles per group over very many numeric values, exact and mergeable.

Method: cumulative frequencies. Rows reduce to (group, value) counts, which
add up across partitions and days; the counts are range-sorted by group and
value, running sums within each range partition get the sums of the partitions
before as offset, and the first value reaching a target rank is picked. The
error is zero; a hot group spreads over as many range partitions as its
distinct values need, and a hot value is one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from iolens.runtime import written


def value_counts(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """groups, value, cnt: the mergeable partial result. Rows with null value don't count."""
    return df.where(F.col(value).isNotNull()).groupBy(*groups, F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("cnt"))


def merged(parts: list[DataFrame], groups: list[str]) -> DataFrame:
    """Partial results of separate days, partitions or finer groups as one."""
    return reduce(DataFrame.unionByName, parts).groupBy(*groups, "value").agg(F.sum("cnt").alias("cnt"))


def percentiles(counts: DataFrame, groups: list[str], percents: tuple[int, ...]) -> DataFrame:
    """groups, n, p<percent>: the first value whose cumulative count reaches percent % of n (nearest rank).

    counts: as from value_counts. Null group keys form groups of their own;
    groups without values don't appear; ties count as often as they occur.
    """
    counts = written(counts.select(*groups, "value", "cnt"), "counts")  # range partitioning reads its input twice
    spread = counts.repartitionByRange(*groups, "value").sortWithinPartitions(*groups, "value")
    # written, so that every later step sees the same partitions
    spread = written(spread.withColumn("part", F.spark_partition_id()), "ranges")
    within = Window.partitionBy("part", *groups).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    sums = spread.groupBy(*groups, "part").agg(F.sum("cnt").alias("s"))  # a row per group and partition it lies in
    w = Window.partitionBy(*groups)
    sums = sums.select(*groups, "part", F.coalesce(F.sum("s").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.sum("s").over(w).alias("n"))
    on = reduce(lambda a, b: a & b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*groups, "part"]])
    cum = spread.withColumn("run", F.sum("cnt").over(within)).alias("a").join(sums.alias("b"), on).select("a.*", "b.n", (F.col("a.run") + F.col("b.base")).alias("cum"))
    picks = [F.min(F.when(F.col("cum") >= F.expr(f"({p} * n + 99) div 100"), F.col("value"))).alias(f"p{p}") for p in percents]
    return cum.groupBy(*groups).agg(F.max("n").alias("n"), *picks)
