"""Counter profiles: standard form, coalescing, expansion and reconciliation with traces."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from iolens import schema as S
from iolens.operators import normalize as N

#: Width of a counter bucket in µs.
BUCKET = 5 * S.TICKS


def standard(raw: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Counter rows in the schema of profiles.

    raw: cat, name, pid, tid, ts, file_hash, host_hash, file_name, host_name,
    epoch, step, and the counters dft_cnt, dur, dur_{sum,min,max}, ret,
    ret_{sum,min,max}, offset_{min,max}; absent columns count as null. The
    bucket starts at ts; sizes exist for reads and writes alone.
    """
    have = set(raw.columns)
    col = lambda n, t="bigint": F.col(n).cast(t) if n in have else F.lit(None).cast(t)
    io_cat = N.io_category("lower(trim(name))")
    moved = F.when(io_cat.isin(S.READ, S.WRITE), F.coalesce(col("ret_sum"), col("ret")))
    sized = lambda c: F.when(io_cat.isin(S.READ, S.WRITE), c)
    start = col("ts")
    out = {
        "cat": N.path_category("lower(trim(cat))", "file_name" if "file_name" in have else "cast(null as string)"),
        "func_name": F.col("name"),
        "pid": col("pid"), "tid": col("tid"), "epoch": col("epoch"), "step": col("step"),
        "file_hash": col("file_hash", "string"), "host_hash": col("host_hash", "string"), "file_name": col("file_name", "string"), "host_name": col("host_name", "string"),
        "proc_name": N.proc_name(col("host_name", "string"), col("host_hash", "string"), col("pid"), col("tid")),
        "io_cat": io_cat, "acc_pat": F.lit(0).cast("tinyint"),
        "count": F.coalesce(col("dft_cnt"), F.lit(1).cast("bigint")),
        "time": F.coalesce(col("dur_sum"), col("dur"), F.lit(0).cast("bigint")),
        "size": F.when(moved > 0, moved),
        "time_min": F.coalesce(col("dur_min"), col("dur")), "time_max": F.coalesce(col("dur_max"), col("dur")),
        "size_min": sized(F.coalesce(col("ret_min"), col("ret"))), "size_max": sized(F.coalesce(col("ret_max"), col("ret"))),
        "offset_min": F.coalesce(col("offset_min"), col("offset")), "offset_max": F.coalesce(col("offset_max"), col("offset")),
        "time_range": N.floor_div(start, bucket).cast("bigint"), "time_start": start, "time_end": start + bucket,
    }
    return raw.select(*[c.alias(n) for n, c in out.items()])


def coalesced(profiles: DataFrame) -> DataFrame:
    """One row per identity (nulls equal): sums of count, time and size, min of minima, max of maxima; size 0 is null."""
    sums = [F.sum(c).alias(c) for c in ("count", "time")] + [N.not_zero(F.sum("size")).alias("size")]
    stats = [(F.min if c.endswith("_min") else F.max)(c).alias(c) for c in S.PROFILE_STATS]
    return profiles.groupBy(*S.PROFILE_IDENTITY).agg(*sums, *stats)


def expansion(width: int, bucket: int = BUCKET) -> int:
    """Pieces per profile row at a granularity of `width` µs; raises unless one width divides the other."""
    if bucket % width == 0:
        return bucket // width
    if width % bucket == 0:
        return 1
    raise ValueError(f"a granularity of {width} µs must evenly divide, or be a multiple of, the profiles' {bucket} µs")


def expanded(profiles: DataFrame, width: int, distribution: str = "uniform", bucket: int = BUCKET) -> DataFrame:
    """Profiles on buckets of `width` µs.

    Each row becomes `expansion` rows. uniform: equal shares of time; weighted:
    shares on a line from time_min to time_max (equal where both are 0 or
    null). Counts are conserved: the first rows take the remainder; sizes are
    cut to whole bytes. Minima and maxima are carried along. time is double µs.
    """
    if distribution not in ("uniform", "weighted"):
        raise ValueError(f"unknown distribution {distribution!r}")
    n = expansion(width, bucket)
    if n == 1:
        return profiles.withColumns({"time": F.col("time").cast("double"), "time_range": N.floor_div(F.col("time_start"), width).cast("bigint")})
    rows = profiles.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    k = F.col("_k")
    share: Column = F.lit(1.0 / n)
    if distribution == "weighted":
        lo, hi = F.coalesce("time_min", F.lit(0)), F.coalesce("time_max", F.lit(0))
        ramp, whole = lo + (hi - lo) * k / (n - 1), (lo + hi) * n / 2
        share = F.when(whole > 0, ramp / whole).otherwise(share)
    start = F.col("time_start") + k * width
    return rows.withColumns(
        {
            "time": F.col("time") * share,
            "count": F.expr(f"count div {n} + if(_k < count % {n}, 1, 0)"),
            "size": F.expr(f"size div {n}"),
            "time_start": start,
            "time_end": start + width,
            "time_range": N.floor_div(start, width).cast("bigint"),
        }
    ).drop("_k")


def reconciled(traces_hlm: DataFrame, profile_hlm: DataFrame, keys: list[str], parity: bool = False) -> DataFrame:
    """Traces, and of the profiles those whose key no trace has; keys compare null = null.

    parity: only the additive measures survive; else the support columns too.
    """
    on = reduce(lambda a, b: a & b, [F.col(f"p.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys])
    only = profile_hlm.alias("p").join(traces_hlm.select(*keys).dropDuplicates().alias("t"), on, "left_anti")
    both = traces_hlm.unionByName(only, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in keys]
    if parity:
        rest = [c for c in rest if not c.endswith("_sq") and "_call_" not in c]
    how = lambda c: F.min if c.endswith("_min") else F.max if c.endswith("_max") else F.sum
    return both.groupBy(*keys).agg(*[N.not_zero(how(c)(c)).alias(c) for c in rest])
