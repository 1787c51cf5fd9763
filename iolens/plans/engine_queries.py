"""Queries of the analysis engine's own operators over the trace tables, and their SQL.

Times are whole µs where a query compares sums; doubles are rounded in both.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from iolens import facts as K
from iolens import schema as S
from iolens import summary as U
from iolens.functions import expressions, metrics
from iolens.operators import normalize as N
from iolens.operators import profiles as P
from iolens.operators import system as Y
from iolens.operators import views as V
from iolens.plans.engine_sql import SQL  # noqa: F401
from iolens.presets import AI, DLIO, POSIX, categories, detect, discovered
from iolens.rulepacks import PACKS
from iolens.runtime import fresh_dir, records, table, written
from iolens.sources import tables as T
from iolens.sources.trace import parse_lines
from iolens.streaming import stream

HOUR = 3600 * S.TICKS
CORE = AI.only("epoch", "compute", "fetch_data", "checkpoint", "data_loader", "reader", "posix", "reader_posix")


def r(c: Column | str, n: int = 6) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.rint(c * float(10**n)) / float(10**n)


def rounded(df: DataFrame, n: int = 6) -> DataFrame:
    by = float(10**n)
    return df.selectExpr(*[f"rint(`{c}` * {by}D) / {by}D as `{c}`" if t == "double" else f"`{c}`" for c, t in df.dtypes])


def _hlm(spark: SparkSession, d: str, views: list[str] | None = None) -> DataFrame:
    views = views or ["time_range"]
    return V.hlm(T.traces(spark, d, HOUR, spare=tuple(c for c in T.SPARE if c in views)), views)


def _view(spark: SparkSession, d: str, by: str, preset=POSIX, derived: bool = True, keep: bool = False) -> DataFrame:
    view = V.flat_view(_hlm(spark, d, [by]), [by], by, preset, derived)
    return written(view, "view") if keep else view


# ---- rows ----


def scan_events(spark, d):
    return T.traces(spark, d, HOUR).select("cat", "func_name", "pid", "tid", "time_start", "time", "size", "file_name", "proc_name", F.col("io_cat").cast("int").alias("io_cat"), "time_range", "time_end")


def scan_payloads(spark, d):
    lines = table(spark, d, "trace_files").select(F.explode(F.split("payload", "\n")).alias("value"))
    return parse_lines(lines).groupBy("ph", F.lower("cat").alias("cat")).agg(F.count(F.lit(1)).alias("n"), F.sum("args.ret").alias("ret"), F.count("args.hhash").alias("hosts"))


def raw_page(spark, d):
    return T.raw_events(spark, d, ["event_id", "cat", "name", "ts", "dur"]).orderBy("ts", "event_id").offset(200).limit(100)


def io_category(spark, d):
    rows = T.raw_events(spark, d, ["event_id", "name"])
    return rows.groupBy("name").agg(F.count(F.lit(1)).alias("n")).withColumn("io_cat", N.io_category("name").cast("int"))


def proc_names(spark, d):
    return T.traces(spark, d, HOUR).groupBy("proc_name").agg(F.count(F.lit(1)).alias("n"))


def posix_category(spark, d):
    return T.traces(spark, d, HOUR).groupBy("cat").agg(F.count(F.lit(1)).alias("n"))


def size_bins(spark, d):
    bins = N.size_bins(F.col("size"))
    t = T.traces(spark, d, HOUR).select("func_name", *bins)
    return t.groupBy("func_name").agg(*[F.sum(c).alias(c) for c in t.columns[1:]])


def time_buckets(spark, d):
    return T.traces(spark, d, HOUR).groupBy("time_range").agg(F.sum("count").alias("count"), F.sum("time").alias("time"), F.min("time_start").alias("first_ts"))


def ignore_filter(spark, d):
    rows = T.raw_events(spark, d, ["event_id", "name", "file_name"])
    keep = N.wanted("file_name", "name")
    return rows.groupBy("name").agg(F.count_if(keep).alias("kept"), F.count_if(~keep).alias("dropped"))


def layer_filter(spark, d):
    t = T.traces(spark, d, HOUR)
    return t.agg(*[F.count_if(F.expr(x.where)).alias(x.name) for x in AI.layers])


def logical_keys(spark, d):
    t = T.traces(spark, d, HOUR).where("file_name is not null")
    return t.groupBy(N.file_dir(F.col("file_name")).alias("file_dir"), N.file_pattern(F.col("file_name")).alias("file_pattern")).agg(F.count(F.lit(1)).alias("n"))


# ---- joins ----


def hash_lookup_join(spark, d):
    rows = records(table(spark, d, "trace_events"), "event_id", {"file_hash": F.col("file_hash"), "host_hash": F.col("host_hash"), "dur": F.col("dur")})
    meta = table(spark, d, "trace_metadata")
    pick = lambda kind: meta.where(F.col("name") == kind).select(F.col("arg_value").alias("hash"), F.col("arg_name").alias("value"))
    got = N.attach_names(rows, pick("FH"), pick("HH"))
    return got.groupBy("host_name").agg(F.count(F.lit(1)).alias("n"), F.count("file_name").alias("named"), F.count_distinct("file_name").alias("files"))


def semi_drilldown(spark, d):
    views = ["file_name", "time_range"]
    which = V.metrics(POSIX, False)
    main = V.main_view(_hlm(spark, d, views), views, which)
    busy = V.view(main, "time_range", which, stats=False).where("posix_count_sum >= 100")
    kept = V.drill_down(main, busy, "time_range")
    return kept.groupBy("file_name").agg(F.sum("posix_count").alias("count"), F.sum("posix_time").alias("time"))


def _is_epoch() -> Column:
    return F.expr(AI.layer("epoch").where)


def epoch_interval_join(spark, d):
    t = T.traces(spark, d, HOUR)
    got = N.assign_epochs(t, N.epochs(t, _is_epoch()))
    return got.groupBy("pid", "epoch").agg(F.count(F.lit(1)).alias("n"), F.sum("time").alias("time"))


def asof_steps(spark, d):
    t = T.traces(spark, d, HOUR)
    got = N.assign_steps(t, F.expr("cat = 'data_loader' and func_name = 'loop.iter'"))
    return got.groupBy("pid", "step").agg(F.count(F.lit(1)).alias("n"), F.min("time_start").alias("first_ts"))


def _both(spark, d):
    views = ["time_range"]
    t = T.traces(spark, d, HOUR, 0)
    p = P.expanded(T.profiles(spark, d), HOUR).withColumn("time", F.col("time").cast("bigint"))
    return P.reconciled(V.hlm(t, views), V.hlm(p, views), V.hlm_keys(views))


def reconcile_anti_join(spark, d):
    return _both(spark, d).groupBy("cat", "func_name").agg(F.sum("count").alias("count"), F.sum("time").alias("time"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))


def union_distinct_keys(spark, d):
    views = ["time_range"]
    keys = V.hlm_keys(views)
    t = V.hlm(T.traces(spark, d, HOUR, 0), views).select(*keys)
    p = V.hlm(P.expanded(T.profiles(spark, d), HOUR).withColumn("time", F.col("time").cast("bigint")), views).select(*keys)
    return t.unionByName(p).dropDuplicates().groupBy("cat", "func_name").agg(F.count(F.lit(1)).alias("n"))


def flat_outer_join(spark, d):
    few = AI.only("compute", "reader", "checkpoint", "posix")
    got = V.flat_view_by_layer(_hlm(spark, d), ["time_range"], "time_range", few, derived=False, stats=False)
    return got.select("time_range", *[F.col(f"{x}_count_sum") for x in few.names], *[r(f"{x}_time_sum").alias(f"{x}_time_sum") for x in few.names])


def system_left_join(spark, d):
    view = V.view(V.main_view(_hlm(spark, d), ["time_range"], V.metrics(POSIX, False)), "time_range", V.metrics(POSIX, False), stats=False)
    origin = N.least_bucket(table(spark, d, "trace_events"), "ts", HOUR)
    got = Y.onto_view(view, T.system(spark, d, HOUR, origin))
    return rounded(got.select("time_range", "posix_count_sum", *[c for c in got.columns if c.startswith("sys_")]), 4)


# ---- aggregates ----


def hlm(spark, d):
    h = _hlm(spark, d)
    sums = ["time", "count", "size", *[f"size_bin_{n}" for n in S.SIZE_BINS], "time_call_min", "time_call_max", "size_call_min", "size_call_max"]
    return h.select("time_range", "proc_name", "cat", F.col("io_cat").cast("int").alias("io_cat"), "func_name", *sums, F.col("time_sq").cast("bigint").alias("time_sq"))


def main_view(spark, d):
    m = V.main_view(_hlm(spark, d), ["time_range"], V.metrics(POSIX))
    keep = ["posix_time", "posix_count", "posix_size", "posix_read_size", "posix_write_size", "posix_metadata_time", "posix_open_count", "posix_close_count", "posix_stat_count", "posix_sync_time"]
    return m.select("time_range", "proc_name", *keep, r("posix_bw", 2).alias("posix_bw"), r("posix_ops", 4).alias("posix_ops"), r("posix_intensity", 9).alias("posix_intensity"))


def derived_metrics(spark, d):
    which = V.metrics(AI.only("data_loader", "reader", "posix"))
    m = V.main_view(_hlm(spark, d), ["time_range"], which)
    return m.agg(*[F.sum(x.col(b)).alias(x.col(b)) for x in which for b in ("count", "time")])


def _stats(df: DataFrame, by: str, prefixes: list[str], bases=("time", "count")) -> DataFrame:
    """Times, counts and sizes of some prefixes (metadata moves no bytes)."""
    cols = [c for p in prefixes for b in bases if (p, b) != ("posix_metadata", "size") for c in [f"{p}_{b}_sum", *[f"{p}_{b}_proc_{s}" for s in ("min", "max", "mean", "std")]]]
    return rounded(df.selectExpr(by, *[f"cast({c} as double) as {c}" for c in cols]))


VIEW_PREFIXES = ["posix", "posix_read", "posix_metadata"]


def view_time_range(spark, d):
    return _stats(_view(spark, d, "time_range"), "time_range", VIEW_PREFIXES)


def view_proc_name(spark, d):
    return _stats(_view(spark, d, "proc_name"), "proc_name", VIEW_PREFIXES)


def view_file_name(spark, d):
    return _stats(_view(spark, d, "file_name"), "file_name", VIEW_PREFIXES, ("time", "count", "size"))


def view_posix_prefixes(spark, d):
    """Statistics of every posix prefix, sizes where a prefix has them."""
    which = V.metrics(POSIX)
    v = _view(spark, d, "time_range")
    cols = [f"{m.col(b)}_{x}" for m in which for b in ("time", "count", *["size"] * m.sized) for x in ("sum", "proc_min", "proc_max", "proc_mean", "proc_std")]
    return rounded(v.select("time_range", *[F.col(c).cast("double").alias(c) for c in cols]))


def view_ratios(spark, d):
    v = _view(spark, d, "time_range")
    return v.select("time_range", r("posix_read_bw_sum", 0).alias("posix_read_bw_sum"), r("posix_ops_sum", 2).alias("posix_ops_sum"), r("posix_ops_proc_max", 4).alias("posix_ops_proc_max"), r("posix_read_intensity_proc_mean", 9).alias("posix_read_intensity_proc_mean"))


def _logical(spark, d, parent: str, name: str) -> DataFrame:
    which = V.metrics(POSIX, False)
    return _stats(V.logical_view(V.main_view(_hlm(spark, d, [parent]), [parent], which), parent, name, which), name, ["posix"])


def logical_file_dir(spark, d):
    return _logical(spark, d, "file_name", "file_dir")


def logical_file_pattern(spark, d):
    return _logical(spark, d, "file_name", "file_pattern")


def logical_host(spark, d):
    return _logical(spark, d, "proc_name", "host_name")


def nunique(spark, d):
    t = T.traces(spark, d, HOUR)
    few = AI.only("posix", "reader_posix", "compute").layers
    return V.unique_counts(t, "time_range", few, "file_name").join(V.unique_counts(t, "time_range", few, "proc_name"), "time_range")


def quantile_stats(spark, d):
    got = V.quantile_stats(T.traces(spark, d, HOUR), "func_name", "time", 5, 95)
    return got.select("func_name", r("mean", 4).alias("mean"), r("std", 2).alias("std"), "n")


def quantile_pairs(spark, d):
    got = V.quantile_pairs(T.traces(spark, d, HOUR), "func_name", "time")
    return got.select("func_name", "low", "high", r("mean", 4).alias("mean"), r("std", 2).alias("std"), "n")


def interval_union(spark, d):
    return metrics.busy_time(T.traces(spark, d, HOUR).where("time > 0"), ["cat"])


def coalesce_profiles(spark, d):
    p = T.profiles(spark, d)
    return p.select("cat", "func_name", "pid", "tid", "time_start", "host_hash", "count", "time", "size", "time_min", "time_max", "size_min", "size_max")


def _expanded(spark, d, how):
    p = P.expanded(T.profiles(spark, d), S.TICKS, how)
    return p.groupBy("cat", "time_range").agg(F.sum("count").alias("count"), F.sum("size").alias("size"), r(F.sum("time"), 3).alias("time"))


def expand_profiles_uniform(spark, d):
    return _expanded(spark, d, "uniform")


def expand_profiles_weighted(spark, d):
    return _expanded(spark, d, "weighted")


def system_metrics(spark, d):
    return rounded(T.system(spark, d, HOUR), 4)


def slice_durations(spark, d):
    got = N.sliced(T.traces(spark, d, HOUR), 1000)
    return got.groupBy("cat").agg(F.count(F.lit(1)).alias("n"), F.sum("time").alias("time"), r(F.sum("count"), 3).alias("count"), F.max("time_start").alias("last_ts"))


def raw_stats(spark, d):
    got = U.raw_stats(T.traces(spark, d, HOUR, spare=("file_hash",)), T.profiles(spark, d))
    return rounded(got)


def layer_summary(spark, d):
    v = metrics.across_layers(_view(spark, d, "time_range", CORE, False, True), CORE, "time_range")
    return rounded(U.layer_summary(v, "time_range", CORE).select("layer", "time", "count", "size", "u_time", "u_count", "overlap"), 4)


def call_stats(spark, d):
    which = V.metrics(POSIX.only("posix"), False)
    v = V.view(V.main_view(_hlm(spark, d), ["time_range"], which, calls=True), "time_range", which, calls=True, stats=False)
    return rounded(v.select("time_range", *[f"posix_time_call_{s}" for s in ("min", "max", "mean", "std")], r("posix_size_call_mean", 3).alias("posix_size_call_mean")))


# ---- whole-view ratios ----


def _shares(spark, d, ranks=True):
    return metrics.shares(_view(spark, d, "time_range", keep=True), ["posix", "posix_read", "posix_metadata"], "time_range", ["posix", "posix_read"], ranks)


def frac_total(spark, d):
    v = _shares(spark, d, False)
    return rounded(v.select("time_range", *[f"{p}_{x}" for p in ("posix", "posix_read", "posix_metadata") for x in ("count_frac_total", "time_proc_frac_total", "time_call_frac_total")], "posix_size_call_frac_total"), 9)


def ops_slope_percentile(spark, d):
    return rounded(_shares(spark, d).select("time_range", "posix_ops_slope", "posix_ops_percentile", "posix_read_ops_slope", "posix_read_ops_percentile"))


def _cross(spark, d):
    preset = replace(CORE, boundary="epoch")
    return metrics.across_layers(_view(spark, d, "time_range", preset, False, True), preset, "time_range")


def boundary_parent_frac(spark, d):
    v = _cross(spark, d)
    return rounded(v.select("time_range", *[f"{x}_time_{t}_frac_epoch" for x in ("compute", "reader", "posix") for t in ("proc", "call")], *[f"{x}_time_{t}_frac_parent" for x in ("compute", "checkpoint", "reader", "reader_posix") for t in ("proc", "call")]))


def derived_frac(spark, d):
    """Shares of every derived metric of the whole ai preset: of epoch, of its layer and of the total."""
    preset = replace(AI, boundary="epoch")
    v = metrics.across_layers(_view(spark, d, "time_range", preset, True, True), preset, "time_range", True)
    return rounded(v.select("time_range", *[f"{x.name}_{m}_time_{t}_frac_{of}" for x in AI.layers for m in x.derived for t in ("proc", "call") for of in ("epoch", "parent", "total")]))


def overhead(spark, d):
    v = _cross(spark, d)
    return rounded(v.select("time_range", *[c for x in ("epoch", "data_loader", "reader") for c in (f"o_{x}_time_proc_max", f"o_{x}_time_sum", f"o_{x}_time_call_frac_self", f"o_{x}_time_call_frac_total")]))


def unoverlapped(spark, d):
    v = _cross(spark, d)
    return rounded(v.select("time_range", *[c for x in ("posix", "reader") for c in (f"u_{x}_time_proc_max", f"u_{x}_time_sum", f"u_{x}_time_call_frac_self", f"u_{x}_time_call_frac_total")]))


def slope_severity(spark, d):
    v = _shares(spark, d, False)
    sev = metrics.slope_severity(F.col("posix_ops_slope"))
    return v.select("time_range", r(sev).alias("severity"), metrics.severity_label(r(sev)).alias("label"))


def additional_metrics(spark, d):
    formulas = {"read_share": "posix_read_time_sum / posix_time_sum", "guarded": "posix_sync_count_sum / max(posix_sync_time_sum, {epsilon})", "meta_over": "clip01(fillna0(posix_metadata_time_sum) / posix_time_sum) if posix_count_sum > 10 else 0"}
    v = expressions.additional_metrics(_view(spark, d, "time_range"), formulas)
    return rounded(v.select("time_range", *formulas), 4)


def topk_entities(spark, d):
    v = _view(spark, d, "file_name", derived=False)
    order = Window.partitionBy("file_dir").orderBy(F.desc("posix_count_sum"), "file_name")
    v = v.withColumn("file_dir", N.file_dir(F.col("file_name"))).withColumn("rank", F.row_number().over(order))
    return v.where("rank <= 3").select("file_dir", "file_name", F.col("posix_count_sum").alias("count"), F.col("rank").cast("bigint").alias("rank"))


# ---- facts ----

RULES = [
    K.build_rule({"id": "q.meta", "fact_type": "metadata_heavy", "scope_layer": "posix", "required_metrics": ["posix_metadata_time_sum"], "derived_metrics": {"share": "fillna0(posix_metadata_time_sum) / posix_time_sum"}, "when": "share > 0.4 and posix_count_sum > 5", "severity_score": "share", "confidence": 0.8, "opportunity_tags": ["fewer_opens"]}),
    K.build_rule({"id": "q.read", "fact_type": "read_heavy", "scope_layer": "posix", "when": "posix_read_time_sum / posix_time_sum > 0.5", "severity_score": "posix_read_time_sum / posix_time_sum", "opportunity_tags": ["prefetch"], "suppresses_tags": ["idle"]}),
]


def _fact_rows(f: DataFrame) -> DataFrame:
    return f.select("fact_id", "fact_type", "scope.entity", "window.time_bucket", "window.t0_ns", "window.t1_ns", r("severity.score").alias("score"), "severity.label", "confidence", F.get("opportunity_tags", F.lit(0)).alias("tag"))


def rule_facts_detail(spark, d):
    return _fact_rows(K.rule_facts(_view(spark, d, "time_range", keep=True), ["time_range"], RULES, "run", "detail", HOUR))


def rule_facts_aggregate(spark, d):
    f = K.rule_facts(_view(spark, d, "proc_name", keep=True), ["proc_name"], RULES, "run", "aggregate", HOUR)
    m = F.col("evidence.metrics")
    return f.select("fact_id", "fact_type", m["affected_count"].cast("bigint").alias("affected"), m["total_count"].cast("bigint").alias("whole"), r("severity.score").alias("score"), "severity.label", F.array_join(F.transform("evidence.top_k", lambda x: x["entity"]), "|").alias("worst"))


def metric_facts(spark, d):
    return _fact_rows(K.slope_facts(_shares(spark, d, False), ["time_range"], ["posix"], "run", "detail"))


def fact_ids(spark, d):
    return rule_facts_detail(spark, d).select("fact_id").distinct()


def facts_summary(spark, d):
    s = K.summary(K.rule_facts(_view(spark, d, "time_range", keep=True), ["time_range"], RULES, "run", "detail", HOUR))
    return s.select("fact_type", "view_type", "n", r("peak").alias("peak"), "label", F.array_join("tags", ",").alias("tags"))


#: The layers that the named packs look at.
PACKED = replace(AI.only("epoch", "compute", "fetch_data", "comm", "reader", "posix", "reader_posix"), boundary="epoch")


def pack_facts(spark, d):
    """Facts of every named pack over the view by epoch; rules whose metrics that view lacks give none."""
    v = metrics.across_layers(_view(spark, d, "epoch", PACKED, True, True), PACKED, "epoch", True)
    v = written(v, "packed")  # read by every rule
    out = []
    for name in PACKS:
        f = K.rule_facts(v, ["epoch"], K.load_rules(name), "run")
        if f is not None:
            out.append(f.select(F.lit(name).alias("pack"), "provenance.rule_id", "fact_type", "window.epoch", r("severity.score").alias("score"), "severity.label"))
    return reduce(DataFrame.unionByName, out)


# ---- presets and streams ----


def _by_layer(spark, d, by):
    """All 14 layers of the ai preset."""
    v = _view(spark, d, by, AI, False)
    return rounded(v.selectExpr(by, *[f"cast({x}_{c} as double) as {x}_{c}" for x in AI.names for c in ("time_sum", "time_proc_max", "time_proc_mean", "count_sum")]))


def view_ai_time_range(spark, d):
    return _by_layer(spark, d, "time_range")


def view_ai_proc_name(spark, d):
    return _by_layer(spark, d, "proc_name")


def layer_filter_dlio(spark, d):
    return T.traces(spark, d, HOUR).agg(*[F.count_if(F.expr(x.where)).alias(x.name) for x in DLIO.layers])


def preset_detected(spark, d):
    return spark.createDataFrame([(detect(categories(T.traces(spark, d, HOUR))).name,)], "preset string")


def logical_proc_id(spark, d):
    return _logical(spark, d, "proc_name", "proc_id")


def logical_thread_id(spark, d):
    return _logical(spark, d, "proc_name", "thread_id")


def _layer_counts(spark: SparkSession, d: str, root: bool) -> DataFrame:
    t = T.traces(spark, d, HOUR)
    forest = discovered(categories(t))
    got = t.agg(*[F.count_if(F.expr(x.where or "true")).alias(x.name) for x in forest.layers if x.where or root])
    return got.select(F.explode(F.array(*[F.struct(F.lit(c).alias("layer"), F.col(c).alias("n")) for c in got.columns])).alias("p")).select("p.*")


def auto_layers(spark, d):
    return _layer_counts(spark, d, False)


def auto_layers_root(spark, d):
    """auto_layers and the root layer app, which also holds events without category."""
    return _layer_counts(spark, d, True)


def stream_tumbling(spark, d):
    """trace_events as a stream of files, tumbling hours per category."""
    source = table(spark, d, "trace_events")
    events = spark.readStream.schema(source.schema).parquet(f"{d}/trace_events.parquet*")
    rows = stream.with_event_time(events.where("ts is not null"))
    got = stream.tumbling(rows, 3600, late="60 days")  # records arrive days after their time
    return stream.run_available(got, ["window_start", "cat"], fresh_dir(spark, "stream"), "update")


_ALL = [
    scan_events, scan_payloads, raw_page, io_category, proc_names, posix_category, size_bins, time_buckets, ignore_filter, layer_filter, logical_keys, hash_lookup_join,
    semi_drilldown, epoch_interval_join, asof_steps, reconcile_anti_join, union_distinct_keys, flat_outer_join, system_left_join, hlm, main_view, derived_metrics, view_time_range,
    view_proc_name, view_file_name, view_posix_prefixes, view_ratios, logical_file_dir, logical_file_pattern, logical_host, nunique, quantile_stats, quantile_pairs, interval_union, coalesce_profiles,
    expand_profiles_uniform, expand_profiles_weighted, system_metrics, slice_durations, raw_stats, layer_summary, call_stats, frac_total, ops_slope_percentile,
    boundary_parent_frac, derived_frac, overhead, unoverlapped, slope_severity, additional_metrics, topk_entities, rule_facts_detail, rule_facts_aggregate, metric_facts, fact_ids, facts_summary,
    auto_layers, auto_layers_root, stream_tumbling, pack_facts, view_ai_time_range, view_ai_proc_name, layer_filter_dlio, preset_detected, logical_proc_id, logical_thread_id,
]
QUERIES = {f.__name__: f for f in _ALL}
