"""Per-key counts, sums and exact quantiles when a few keys hold most records.

Method: distributed exact selection. Records are melted to (field, key, value)
and reduced, before any shuffle, to histograms whose counts merge by addition;
the shuffle key holds the histogram bucket besides the key, so a hot key's rows
never meet in one task. A quantile's rank points into one bucket; the values of
that bucket alone are split again into equal-width buckets until the bucket
holds one value. A window only ever runs over the buckets of one key, whose
number is bounded (about 2 * 64 * STEPS at first, SPLITS later).

The ranges still open are sent to the rows, which are filtered where they lie.
Only keys above a limit take part in that: the limit is the number of values
over BROADCAST_ROWS, so that at most BROADCAST_ROWS keys lie above it, at any
size of the data. The buckets of the other keys are split into single values at
once, by a shuffle whose groups hold at most `limit` rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from iolens import runtime
from iolens.runtime import written

#: Buckets per power of two in the first histogram.
STEPS = 16
#: Equal-width buckets of every later split.
SPLITS = 1024
KEY = ["field_name", "key_value"]
RANGE = [*KEY, "code", "lo", "hi"]


def _code(v: Column) -> Column:
    """A non-decreasing code of a bigint: STEPS buckets per power of two, on both sides of 0."""
    size = F.floor(F.log2(F.abs(v.cast("double")) + 1) * STEPS)
    return F.when(v >= 0, size).otherwise(-size - 1)


def _melt(df: DataFrame, fields: dict[str, Column], value: str) -> DataFrame:
    pairs = [F.struct(F.lit(n).alias("field_name"), c.alias("key_value")) for n, c in fields.items()]
    v = F.col(value).cast("bigint")
    return df.select(F.explode(F.array(*pairs)).alias("_p"), v.alias("v")).select("_p.*", "v", _code(F.col("v")).alias("code"))


def _same(a: str, b: str, *more: str) -> Column:
    """Equality of the keys of two sides; null equals null."""
    return F.expr(" and ".join([f"{a}.field_name = {b}.field_name", f"{a}.key_value <=> {b}.key_value", *(f"{a}.{c} = {b}.{c}" for c in more)]))


def _histograms(data: DataFrame) -> DataFrame:
    total = F.sum(F.col("v").cast("decimal(38,0)")).alias("total")
    return data.groupBy(*KEY, "code").agg(F.count(F.lit(1)).alias("n"), total, F.min("v").alias("lo"), F.max("v").alias("hi"))


def histograms(df: DataFrame, fields: dict[str, Column], value: str) -> DataFrame:
    """field_name, key_value, code, n, total, lo, hi: the mergeable first histograms; code is null for rows without value."""
    return _histograms(_melt(df, fields, value))


def key_totals(cells: DataFrame) -> DataFrame:
    """field_name, key_value, n, n_values, total of histograms."""
    values = F.sum(F.when(F.col("code").isNotNull(), F.col("n")))
    return cells.groupBy(*KEY).agg(F.sum("n").alias("n"), F.coalesce(values, F.lit(0)).alias("n_values"), F.sum("total").alias("total"))


def _narrowed(parts: DataFrame, at: list[str], order: str, spots: DataFrame) -> DataFrame:
    """The part (with n, lo2, hi2) of each range in which a rank lies, and the rank within it."""
    cum = F.sum("n").over(Window.partitionBy(*at).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    parts = parts.withColumn("cum", cum)
    on = _same("s", "t", *[c for c in at if c not in KEY]) & F.expr("s.cum >= t.rank and s.cum - s.n < t.rank")
    return parts.alias("s").join(spots.alias("t"), on).select(
        *[f"t.{k}" for k in KEY], "t.percent", F.col("s.code"), F.col("s.lo2").alias("lo"), F.col("s.hi2").alias("hi"), F.expr("t.rank - (s.cum - s.n)").alias("rank"), "t.big"
    )


def keyed_stats(df: DataFrame, fields: dict[str, Column], value: str, percents: tuple[int, ...] = (50, 95)) -> DataFrame:
    """Count, sum and exact percentiles of `value` per key of every field.

    df: one row per record (any further columns are ignored). fields: name of
    the field to its key expression. Result: field_name, key_value, n (records,
    including those without value), n_values, total (a decimal, so that it can't
    overflow), and p<percent> for each
    percent: the first value whose cumulative count reaches percent % of
    n_values (nearest rank). Null keys form a key of their own; a key without
    values has null total and percentiles; an empty df gives no rows. Ties and
    repeated values count as often as they occur.
    """
    data = _melt(df, fields, value)
    cells = written(_histograms(data), "cells")
    totals = key_totals(cells)
    limit = -(-(cells.where("code is not null").agg(F.sum("n").alias("n")).first()["n"] or 0) // max(1, runtime.BROADCAST_ROWS))
    big = F.col("n_values") > limit
    ranked = totals.where("n_values > 0").select(*KEY, F.explode(F.array(*[F.lit(p) for p in percents])).alias("percent"), "n_values", big.alias("big"))
    ranked = ranked.withColumn("rank", F.expr("(percent * n_values + 99) div 100"))
    # the first histogram: the bucket in which each rank lies
    first = cells.where("code is not null").select(*KEY, "code", "n", F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    spots = written(_narrowed(first, KEY, "code", ranked), "spots")
    hot = F.broadcast(totals.where(big).select(*KEY))  # at most BROADCAST_ROWS keys
    rest = data.where("v is not null").alias("d").join(hot.alias("h"), _same("d", "h"), "left_anti")
    small = spots.where("not big and lo < hi")
    there = rest.alias("d").join(small.select(*RANGE).distinct().alias("r"), _same("d", "r", "code")).select("r.*", "d.v")
    values = there.groupBy(*RANGE, "v").agg(F.count(F.lit(1)).alias("n")).withColumns({"lo2": F.col("v"), "hi2": F.col("v")})
    found = [spots.where("lo = hi"), _narrowed(values, RANGE, "v", small)]
    spots = spots.where("big and lo < hi")
    while (n := spots.count()) > 0:  # a range is narrower by SPLITS in every round
        assert n <= len(percents) * runtime.BROADCAST_ROWS
        ranges = F.broadcast(spots.select(*RANGE).distinct())
        there = data.where("v is not null").alias("d").join(ranges.alias("r"), _same("d", "r", "code") & F.expr("d.v between r.lo and r.hi"))
        there = there.select("r.*", "d.v", F.expr(f"(d.v - r.lo) div ((r.hi - r.lo) div {SPLITS} + 1)").alias("sub"))
        split = there.groupBy(*RANGE, "sub").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo2"), F.max("v").alias("hi2"))
        narrower = written(_narrowed(split, RANGE, "sub", spots), "spots")
        found.append(narrower.where("lo = hi"))
        spots = narrower.where("lo < hi")
    picks = [F.max(F.when(F.col("percent") == p, F.col("lo"))).alias(f"p{p}") for p in percents]
    quantiles = reduce(DataFrame.unionByName, found).groupBy(*KEY).agg(*picks)
    return totals.alias("a").join(quantiles.alias("b"), _same("a", "b"), "left").select("a.*", *[f"b.p{p}" for p in percents])


def heavy_keys(totals: DataFrame, share: float = 0.05) -> DataFrame:
    """Keys (not null) of key_totals or keyed_stats holding at least `share` of all records of their field."""
    counts = written(totals.select(*KEY, "n"), "counts")  # read twice
    whole = counts.groupBy("field_name").agg(F.sum("n").alias("_all"))  # one row per field
    return counts.join(F.broadcast(whole), "field_name").where(F.col("key_value").isNotNull() & (F.col("n") >= F.col("_all") * share)).drop("_all")
