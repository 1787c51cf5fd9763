"""Ratios over whole views: shares of totals, slopes, relations between layers, severities.

Totals come from an aggregate of one row, and ranks from range partitions, so a
view with very many rows (files, processes) never goes through one task. A view
is read more than once here; write it first where it is costly to make.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from iolens.functions.ranks import cumulative
from iolens.presets import Preset


def with_totals(view: DataFrame, cols: list[str]) -> DataFrame:
    """Adds _t, a struct of the columns' sums over the whole view: one row, sent to every task."""
    row = view.agg(F.struct(*[F.sum(c).alias(c) for c in cols]).alias("_t")).withColumn("_one", F.lit(1))
    return view.withColumn("_one", F.lit(1)).join(F.broadcast(row), "_one").drop("_one")


def with_shares(view: DataFrame, outs: dict[str, str]) -> DataFrame:
    """Adds out = column / its total for each out: column; null where the total isn't above 0."""
    if not outs:
        return view
    total = lambda c: F.col("_t")[c]
    view = with_totals(view, list(dict.fromkeys(outs.values())))
    return view.withColumns({o: F.when(total(c) > 0, F.col(c) / total(c)) for o, c in outs.items()}).drop("_t")


def with_percentile_ranks(view: DataFrame, by: str, outs: dict[str, str]) -> DataFrame:
    """Adds out = average rank of the column's value over its number of values, null for null, for each out: column.

    Values reduce to counts, which are range-sorted; running sums within a
    range get the sums of the ranges before.
    """
    cells = view.select(by, F.explode(F.array(*[F.struct(F.lit(o).alias("o"), F.col(c).cast("double").alias("v")) for o, c in outs.items()])).alias("_p"))
    cells = cells.select(by, "_p.o", "_p.v").where("v is not null")
    cum = cumulative(cells, ["o"], "v")
    ranks = cum.select("o", "v", ((F.col("upto") - (F.col("n") - 1) / 2) / F.col("whole")).alias("rank"))
    wide = cells.join(ranks, ["o", "v"]).groupBy(by).agg(*[F.max(F.when(F.col("o") == o, F.col("rank"))).alias(o) for o in outs])
    return view.join(wide, by, "left")


def shares(view: DataFrame, prefixes: list[str], by: str, sized: list[str], ranks: bool = True) -> DataFrame:
    """count_frac_total, time and size shares by process and by call, ops_slope and ops_percentile for each prefix."""
    proc = "sum" if by == "proc_name" else "proc_max"
    outs = {}
    for p in prefixes:
        outs[f"{p}_count_frac_total"] = f"{p}_count_sum"
        for base in ["time", *["size"] * (p in sized)]:
            outs[f"{p}_{base}_proc_frac_total"] = f"{p}_{base}_{proc}"
            outs[f"{p}_{base}_call_frac_total"] = f"{p}_{base}_sum"
    view = with_shares(view, outs)
    view = view.withColumns({f"{p}_ops_slope": F.try_divide(f"{p}_time_proc_frac_total", f"{p}_count_frac_total") for p in prefixes})
    return with_percentile_ranks(view, by, {f"{p}_ops_percentile": f"{p}_ops_slope" for p in prefixes}) if ranks else view


def not_below_zero(value: Column) -> Column:
    """max(value, 0), null for null."""
    return F.when(value.isNotNull(), F.greatest(value, F.lit(0.0)))


def across_layers(view: DataFrame, preset: Preset, by: str, derived: bool = False) -> DataFrame:
    """Relations between layers, for the process and the call track.

    <layer>_time_<track>_frac_<boundary>, overhead o_<layer> (time beyond that
    of its children) with shares of boundary, self and total, <child>_..._frac_parent,
    shares of derived metrics, and u_<layer>: time of asynchronous layers not
    covered by compute. Layers without columns count as null.
    """
    have = set(view.columns)
    edge = preset.boundary
    names = set(preset.names)
    first: dict[str, Column] = {}  # plain ratios and new times
    outs: dict[str, str] = {}  # shares of totals
    guarded: dict[str, tuple[str, Column]] = {}  # ratios that need a layer with time
    for track, suffix in (("proc", "time_sum" if by == "proc_name" else "time_proc_max"), ("call", "time_sum")):
        time = lambda x, s=suffix: F.col(f"{x}_{s}") if f"{x}_{s}" in have else F.lit(None).cast("double")
        for x in preset.layers:
            own = time(x.name)
            first[f"{x.name}_time_{track}_frac_{edge}"] = F.try_divide(own, time(edge))
            children = preset.children(x.name)
            if children:
                below = sum((F.coalesce(time(c), F.lit(0.0)) for c in children), F.lit(0.0))
                over = not_below_zero(own - below)
                first[f"o_{x.name}_{suffix}"] = over
                first[f"o_{x.name}_time_{track}_frac_{edge}"] = F.try_divide(over, time(edge))
                first[f"o_{x.name}_time_{track}_frac_self"] = F.try_divide(over, own)
                outs[f"o_{x.name}_time_{track}_frac_total"] = f"o_{x.name}_{suffix}"
                for c in children:
                    if f"{x.name}_{suffix}" in have:
                        guarded[f"{c}_time_{track}_frac_parent"] = (f"{x.name}_{suffix}", F.try_divide(time(c), own))
            for d in x.derived if derived else ():
                part = f"{x.name}_{d}"
                first[f"{part}_time_{track}_frac_{edge}"] = F.try_divide(time(part), time(edge))
                first[f"{part}_time_{track}_frac_parent"] = F.try_divide(time(part), own)
                if f"{part}_{suffix}" in have:
                    outs[f"{part}_time_{track}_frac_total"] = f"{part}_{suffix}"
        for a in preset.async_layers if "compute" in names else ():
            rest = not_below_zero(time(a) - F.coalesce(time("compute"), F.lit(0.0)))
            first[f"u_{a}_{suffix}"] = rest
            first[f"u_{a}_time_{track}_frac_self"] = F.try_divide(rest, time(a))
            first[f"u_{a}_time_{track}_frac_{edge}"] = F.try_divide(rest, time(edge))
            outs[f"u_{a}_time_{track}_frac_total"] = f"u_{a}_{suffix}"
            parent = preset.layer(a).parent
            if parent:
                first[f"u_{a}_time_{track}_frac_parent"] = F.try_divide(rest, time(parent))
    items = list(first.items())
    for i in range(0, len(items), 200):  # narrower selects stay in generated code
        view = view.withColumns(dict(items[i : i + 200]))
    view = with_shares(view, outs)
    if guarded:
        view = with_totals(view, list(dict.fromkeys(c for c, _ in guarded.values())))
        view = view.withColumns({o: F.when(F.col("_t")[c] > 0, v) for o, (c, v) in guarded.items()}).drop("_t")
    return view


def slope_severity(slope: Column) -> Column:
    """0 at 45 degrees and below, 1 at 90."""
    angle = (F.degrees(F.atan(slope)) - 45.0) / 45.0
    return F.when(slope.isNotNull() & ~F.isnan(slope), F.least(F.greatest(angle, F.lit(0.0)), F.lit(1.0)))


def severity_label(score: Column) -> Column:
    # The lower bounds of the labels.
    return F.when(score >= 0.85, "critical").when(score >= 0.60, "high").when(score >= 0.30, "medium").when(score > 0, "low").otherwise("none")


def metric_score(name: str, c: Column, boundary: float | None = None) -> Column:
    """A score in [0, 1] by what the name tells: shares as they are, utilisations inverted, slopes by angle.

    With a boundary, the share of it; mean bandwidths are inverted.
    """
    clip = lambda v: F.when(v.isNotNull() & ~F.isnan(v), F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)))
    c = c.cast("double")
    if boundary is not None:
        share = F.try_divide(c, F.lit(float(boundary)))
        return clip(1 - share if "bw_mean" in name else share)
    if name.endswith(("_pct", "_per")):
        return clip(c)
    if name.endswith("_util"):
        return clip(1 - c)
    return slope_severity(c) if name.endswith("_slope") else clip(c)


def with_scores(view: DataFrame, boundaries: dict[str, float] | None = None) -> DataFrame:
    """Adds <metric>_score for every column whose name or boundary tells how to score it."""
    named = {c: None for c in view.columns if c.endswith(("_pct", "_per", "_util", "_slope")) and not c.startswith("d_")}
    wanted = named | {c: b for c, b in (boundaries or {}).items() if c in view.columns}
    return view.withColumns({f"{c}_score": metric_score(c, F.col(c), b) for c, b in wanted.items()}) if wanted else view


def busy_time(spans: DataFrame, by: list[str]) -> DataFrame:
    """by, busy: the length of the union of [time_start, time_end) per group, from merged periods."""
    from iolens.operators import intervals

    rows = spans.where("time_start is not null and time_end >= time_start").select(*by, F.col("time_start").alias("start"), F.col("time_end").alias("stop"))
    found = intervals.periods(intervals.chunk_periods(rows, by), by)
    return found.groupBy(*by).agg(F.sum(F.col("stop") - F.col("start")).cast("bigint").alias("busy"))
