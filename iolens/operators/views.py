"""The chain of grouped relations: events, high-level metrics, main view, views, flat view.

One aggregate per step: every layer and derived metric is a conditional sum, so
a view needs no filter, group-by and join per layer. Inputs of sums are whole
numbers; ratios are made once per row.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from iolens import schema as S
from iolens.functions.ranks import percentiles
from iolens.operators import normalize as N
from iolens.presets import Layer, Preset

DETAIL = ["cat", "io_cat", "acc_pat", "func_name"]
#: Expressions are given as SQL text: a wide view has hundreds, and each text is one call to the JVM.
_SQUARE = "cast({0} as decimal(38,0)) * {0}"


@dataclass(frozen=True)
class Metric:
    """A family of columns: <layer>[_<derived>]_<base>."""

    prefix: str
    where: str | None
    sized: bool

    def col(self, base: str) -> str:
        return f"{self.prefix}_{base}"


def metrics(preset: Preset, derived: bool = True) -> list[Metric]:
    out = []
    for x in preset.layers:
        out.append(Metric(x.name, x.where, x.sized))
        for name, where in (x.derived if derived else {}).items():
            both = f"({x.where}) and ({where})" if x.where else where
            out.append(Metric(f"{x.name}_{name}", both, x.sized and name in x.sized_derived))
    return out


def hlm(traces: DataFrame, view_types: list[str]) -> DataFrame:
    """High-level metrics: the finest grain of analysis. Rows with a null key are left out; 0 becomes null."""
    keys = hlm_keys(view_types)
    sums = {c: f"sum({c})" for c in ("time", "count", "size")}
    edges = [None, *S.SIZE_EDGES, None]
    for n, lo, hi in zip(S.SIZE_BINS, edges, edges[1:], strict=False):
        inside = " and ".join([f"size > {lo}"] * (lo is not None) + [f"size <= {hi}L"] * (hi is not None))
        sums[f"size_bin_{n}"] = f"count_if({inside})"
    for m in ("time", "size"):
        sums |= {f"{m}_sq": f"sum({_SQUARE.format(m)})", f"{m}_call_min": f"min({m})", f"{m}_call_max": f"max({m})"}
    return traces.where(" and ".join(f"{k} is not null" for k in keys)).groupBy(*keys).agg(*[F.expr(f"nullif({e}, 0) as {n}") for n, e in sums.items()])


def hlm_keys(view_types: list[str]) -> list[str]:
    return list(dict.fromkeys([*with_proc(view_types), *DETAIL]))


def with_proc(view_types: list[str]) -> list[str]:
    return sorted({*view_types, "proc_name"})


def main_view(detail: DataFrame, view_types: list[str], which: list[Metric], bins: bool = False, calls: bool = False) -> DataFrame:
    """Per view types: <prefix>_time, _count, _size and their ratios _bw, _ops, _intensity.

    A row stays if one of the metrics has events in it. Time is in µs; ratios
    are per second. bins and calls add size bins and call statistics.
    """
    aggs: list[Column] = []
    for m in which:
        add = lambda how, c, m=m: aggs.append(F.expr(f"nullif({how}({f'case when {m.where} then {c} end' if m.where else c}), 0) as {m.col(c)}"))
        for c in ["time", "count", *["size", *[f"size_bin_{n}" for n in S.SIZE_BINS] * bins] * m.sized]:
            add("sum", c)
        for base in ("time", "size")[: 1 + m.sized] if calls else ():
            add("sum", f"{base}_sq")
            add("min", f"{base}_call_min")
            add("max", f"{base}_call_max")
    rows = detail.groupBy(*with_proc(view_types)).agg(*aggs)
    rows = rows.where(f"coalesce({', '.join(m.col('count') for m in which)}, null) is not null")
    ratios = {}
    for m in which:
        t, n, z = m.col("time"), m.col("count"), m.col("size")
        ratios[m.col("ops")] = F.expr(f"try_divide({n}, {t} / {S.TICKS})")
        if m.sized:
            size = f"(case when {z} > 0 then {z} end)"
            ratios |= {z: F.expr(size), m.col("bw"): F.expr(f"try_divide({size}, {t} / {S.TICKS})"), m.col("intensity"): F.expr(f"try_divide({n}, {size})")}
    return rows.withColumns(ratios)


def _bases(m: Metric) -> list[str]:
    return ["time", "count", "ops", *["size", "bw", "intensity"] * m.sized]


def view(main: DataFrame, by: str, which: list[Metric], bins: bool = False, calls: bool = False, zero_fill: bool = False, stats: bool = True) -> DataFrame:
    """One row per value of `by`: sums, and minimum, maximum, mean and standard deviation over processes.

    Times are in seconds. Processes without events of a metric don't count in
    its statistics, unless zero_fill.
    """
    proc = [by, "proc_name"] if by != "proc_name" else [by]
    inner, outer = [], []
    hows = {"sum": "sum", **({"proc_min": "min", "proc_max": "max", "proc_mean": "avg", "proc_std": "stddev_samp"} if stats else {})}
    for m in which:
        for b in _bases(m):
            c = m.col(b)
            inner.append(f"coalesce(sum({c}), 0) as {c}" if zero_fill else f"sum({c}) as {c}")
            scaled = "nullif({} / %d, 0)" % S.TICKS if b == "time" else "{}"
            outer += [f"{scaled.format(f'{how}({c})')} as {c}_{name}" for name, how in hows.items()]
        for c in [m.col(f"size_bin_{n}") for n in S.SIZE_BINS] if bins and m.sized else ():
            inner.append(f"sum({c}) as {c}")
            outer.append(f"nullif(sum({c}), 0) as {c}")
        for base in ("time", "size")[: 1 + m.sized] if calls else ():
            for suffix, how in (("sq", "sum"), ("call_min", "min"), ("call_max", "max")):
                for level in (inner, outer):
                    level.append(f"{how}({m.col(f'{base}_{suffix}')}) as {m.col(f'{base}_{suffix}')}")
    out = main.groupBy(*proc).agg(*map(F.expr, inner)).groupBy(by).agg(*map(F.expr, outer))
    for m in which if calls else ():
        for base in ("time", "size")[: 1 + m.sized]:
            out = call_stats(out, m, base)
    return out


def call_stats(df: DataFrame, m: Metric, base: str) -> DataFrame:
    """<base>_call_mean and _call_std (population) from sums and sums of squares; bounds of time in seconds."""
    scale = S.TICKS if base == "time" else 1
    n, total, sq = F.col(m.col("count_sum")), F.col(m.col(f"{base}_sum")) * scale, F.col(m.col(f"{base}_sq"))
    mean = F.try_divide(total, n)
    spread = F.try_divide(sq.cast("double"), n) - mean * mean
    out = {m.col(f"{base}_call_mean"): mean / scale, m.col(f"{base}_call_std"): F.when(spread.isNotNull(), F.sqrt(F.greatest(spread, F.lit(0.0)))) / scale}
    out |= {m.col(f"{base}_call_{x}"): F.col(m.col(f"{base}_call_{x}")) / scale for x in ("min", "max")}
    return df.withColumns(out).drop(m.col(f"{base}_sq"))


def unique_counts(traces: DataFrame, by: str, layers: tuple[Layer, ...], what: str) -> DataFrame:
    """by, <layer>_<what>_nunique: exact distinct values per layer, 0 for none.

    Two plain aggregates: values meet per (by, value) with a flag per layer,
    and flags are summed; no sets are built.
    """
    flag = lambda x: F.max(F.expr(f"cast(coalesce({x.where or 'true'}, false) as int)"))
    pairs = traces.dropna(subset=[by]).groupBy(by, F.col(what).alias("_v")).agg(*[flag(x).alias(x.name) for x in layers])
    known = F.col("_v").isNotNull()
    return pairs.groupBy(by).agg(*[F.sum(F.when(known, F.col(x.name)).otherwise(0)).cast("bigint").alias(f"{x.name}_{what}_nunique") for x in layers])


def unique_values(traces: DataFrame, by: str, what: str) -> DataFrame:
    """by, <what>_set: the distinct values without nulls, in order; for keys whose sets are small (sets unite with united_sets)."""
    pairs = traces.dropna(subset=[by]).select(by, what).distinct()
    return pairs.groupBy(by).agg(F.array_sort(F.collect_list(what)).alias(f"{what}_set"))


def united_sets(sets: DataFrame, by: str, column: str) -> DataFrame:
    """Unions of set-valued columns per `by`; a null set counts as empty. Values are reduced to distinct ones before they meet."""
    pairs = sets.select(by, F.explode_outer(column).alias("_v")).distinct()
    return pairs.groupBy(by).agg(F.array_sort(F.collect_list("_v")).alias(column))


def flat_view(detail: DataFrame, view_types: list[str], by: str, preset: Preset, derived: bool = True, stats: bool = True) -> DataFrame:
    """The wide view of all layers, in one aggregate per level."""
    which = metrics(preset, derived)
    return view(main_view(detail, view_types, which), by, which, stats=stats)


def flat_view_by_layer(detail: DataFrame, view_types: list[str], by: str, preset: Preset, derived: bool = True, stats: bool = True) -> DataFrame:
    """The same with one view per layer and full outer joins; for comparison."""
    parts = [flat_view(detail, view_types, by, preset.only(x), derived, stats) for x in preset.names]
    return reduce(lambda a, b: a.join(b, by, "full_outer"), parts)


def drill_down(main: DataFrame, kept: DataFrame, by: str) -> DataFrame:
    """Rows of the main view whose `by` survived in a parent view."""
    return main.join(kept.select(by).distinct(), by, "left_semi")


def logical_view(main: DataFrame, parent: str, name: str, which: list[Metric]) -> DataFrame:
    """A view by a key derived from the parent key: file_dir, file_pattern, host_name, proc_id or thread_id."""
    derive = {
        "file_dir": N.file_dir, "file_pattern": N.file_pattern, "host_name": lambda c: N.name_part(c, 1), "proc_id": lambda c: N.name_part(c, 2), "thread_id": lambda c: N.name_part(c, 3),
    }
    return view(main.withColumn(name, derive[name](F.col(parent))).where(F.col(name).isNotNull()), name, which)


def quantile_stats(df: DataFrame, by: str, value: str, low: int, high: int) -> DataFrame:
    """by, mean, std (population), n of the values between two percentiles (linear interpolation), without nulls and zeros.

    The percentiles come from range-sorted counts, so a group's values never
    meet in one buffer.
    """
    rows = df.where(F.col(value) != 0)
    bounds = percentiles(rows.select(by, value), by, value, [low / 100, high / 100]).withColumnRenamed("at", "_b")
    kept = rows.join(bounds, by).where(F.col(value).between(F.col("_b")[0], F.col("_b")[1]))
    return kept.groupBy(by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(F.lit(1)).alias("n"))


#: The percentile pairs of quantile statistics.
QUANTILE_PAIRS = ((1, 99), (5, 95), (10, 90), (25, 75))


def quantile_pairs(df: DataFrame, by: str, value: str) -> DataFrame:
    """by, low, high, mean, std, n: quantile_stats of every pair, from one array of percentiles and one join."""
    rows = df.where(F.col(value) != 0)
    points = sorted({p for pair in QUANTILE_PAIRS for p in pair})
    bounds = percentiles(rows.select(by, value), by, value, [p / 100 for p in points]).withColumnRenamed("at", "_b")
    pair = lambda lo, hi: F.struct(F.lit(lo).alias("low"), F.lit(hi).alias("high"), F.col("_b")[points.index(lo)].alias("lo"), F.col("_b")[points.index(hi)].alias("hi"))
    bounds = bounds.select(by, F.array(*[pair(*p) for p in QUANTILE_PAIRS]).alias("_p"))
    kept = rows.select(by, value).join(bounds, by).select(by, value, F.explode("_p").alias("_p")).where(F.col(value).between(F.col("_p.lo"), F.col("_p.hi")))
    return kept.groupBy(by, F.col("_p.low").alias("low"), F.col("_p.high").alias("high")).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(F.lit(1)).alias("n"))


def split_quantiles(view: DataFrame) -> DataFrame:
    """Columns <metric>_q<low>_q<high>_stats (array of mean, std, count) as three columns each."""
    stats = [c for c in view.columns if c.endswith("_stats") and "_q" in c]
    parts = {f"{c.removesuffix('_stats')}_{n}": F.get(F.col(c), F.lit(i)).cast(t) for c in stats for i, (n, t) in enumerate((("mean", "double"), ("std", "double"), ("count", "bigint")))}
    return view.withColumns(parts).drop(*stats) if stats else view


def exceeding_time(detail: DataFrame, by: list[str], width: int) -> DataFrame:
    """One row: the longest time (µs) of one group of high-level metrics, and whether it exceeds the bucket width."""
    most = F.max("t")
    return detail.groupBy(*by).agg(F.sum("time").alias("t")).agg(most.alias("most"), F.coalesce(most > width, F.lit(False)).alias("exceeds"))
