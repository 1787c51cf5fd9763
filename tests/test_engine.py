import gzip
import json
import math
import os

import pytest
from pyspark.sql import functions as F

from iolens import api, cli, facts, presets, sinks, summary
from iolens.functions import expressions as E
from iolens.functions import metrics as M
from iolens.operators import normalize as N
from iolens.operators import profiles as P
from iolens.operators import system as Y
from iolens.operators import views as V
from iolens.plans import engine_queries as Q
from iolens.sources import trace as R

from .conftest import rows

SECOND = 1_000_000
SMALL = "/root/testdata/sf0.001"


def record(ph, name, cat, ts=0, dur=None, /, pid=1, tid=1, **args):
    return {"ph": ph, "name": name, "cat": cat, "ts": ts, "dur": dur, "pid": pid, "tid": tid, "args": {"hhash": "h1"} | args}


HYBRID = [
    record("M", "HH", "tracer", name="hostA", value="h1"),
    record("M", "FH", "tracer", name="/scratch/data/x.bin", value="f1"),
    record("X", "read", "POSIX", 6_000_123, 200, fhash="f1", ret=4096, offset=0),
    record("C", "open64", "POSIX", 10_000_000, fhash="f1", dft_cnt=3, dur_sum=300),
]


def write(folder, records, name="a.pfw.gz"):
    text = "[\n" + "\n".join(json.dumps(r) + "," for r in records) + '\n{"broken": \n\n]\n'
    opener = gzip.open if name.endswith(".gz") else open
    with opener(folder / name, "wt") as f:
        f.write(text)
    return str(folder)


def read(spark, folder, records, granularity=5.0):
    return R.read_trace(spark, write(folder, records), granularity)


def test_hybrid_trace_in_normal_form(spark, tmp_path):
    got = read(spark, tmp_path, HYBRID)
    assert rows(got.traces, "cat", "func_name", "count", "time", "size", "time_range", "proc_name", "file_name") == [("posix_reader", "read", 1, 200, 4096, 0, "app#hostA#1#1", "/scratch/data/x.bin")]
    assert rows(got.profiles, "count", "time", "size", "time_start", "time_range") == [(3, 300, None, 10_000_000, 1)]
    assert rows(summary.raw_stats(got.traces, got.profiles), "trace_event_count", "profile_event_count", "total_event_count") == [(1, 3, 4)]


def test_trace_without_profiles_or_host_name(spark, tmp_path):
    got = read(spark, tmp_path, HYBRID[2:3])
    assert got.profiles is None and got.system is None
    assert rows(got.traces, "host_name", "proc_name") == [(None, "app#h1#1#1")]


def test_files_are_listed_flat_and_missing_ones_raise(tmp_path):
    (tmp_path / "sub").mkdir()
    write(tmp_path / "sub", HYBRID)
    with pytest.raises(FileNotFoundError):
        R.list_trace_files(str(tmp_path))
    write(tmp_path, HYBRID, "b.pfw")
    assert [f[-5:] for f in R.list_trace_files(str(tmp_path))] == ["b.pfw"]
    (tmp_path / "manifest.json").write_text(json.dumps({"groups": {"g": ["sub/a.pfw.gz"]}}))
    assert R.list_trace_files(str(tmp_path), ["g"]) == [str(tmp_path / "sub/a.pfw.gz")]


def test_pages_filter_and_unique(spark, tmp_path):
    raw = R.RawTraces(R.read_raw(spark, R.list_trace_files(write(tmp_path, HYBRID))).where("ph = 'X'"))
    assert raw.filter('cat == "POSIX"').df.count() == 1 and rows(raw.unique("cat")) == [("POSIX",)]
    assert raw.page(0, 5).count() == 1 and raw.page(1, 5).count() == 0 and len(list(raw.pages(1))) == 1


@pytest.mark.parametrize(("size", "name"), [(4096, "0_4kib"), (4097, "4kib_16kib"), (1 << 32, "1gib_4gib"), ((1 << 32) + 1, "4gib_plus"), (None, None)])
def test_size_bins_are_right_closed(spark, size, name):
    df = spark.createDataFrame([(size,)], "size bigint").select(*N.size_bins(F.col("size")))
    assert [c.removeprefix("size_bin_") for c, v in df.first().asDict().items() if v] == ([name] if name else [])


def test_ignored_paths_and_functions(spark):
    df = spark.createDataFrame([("/proc/1", "read"), (None, "read"), ("/a", "TorchDataset.__init__"), ("/a", "x.save_state"), ("/a", None)], "f string, n string")
    assert [r[0] for r in df.select(N.wanted("f", "n")).collect()] == [False, True, False, False, True]


def test_path_category_and_dirs(spark):
    df = spark.createDataFrame([("posix", "/lustre/data/x1"), ("compute", "/data/x"), ("stdio", None), ("posix", "/x")], "c string, f string")
    got = df.select(N.path_category("c", "f"), N.file_dir(F.col("f")), N.file_pattern(F.col("f"))).collect()
    assert [tuple(r) for r in got] == [("posix_reader_lustre", "/lustre/data", "/lustre/data/x[0-9]"), ("compute", "/data", "/data/x"), ("stdio", None, None), ("posix", "/", "/x")]


TRACE = "pid bigint, cat string, func_name string, time_start bigint, time_end bigint, time bigint, count bigint, size bigint"


def test_epochs_last_match_wins_and_half_open(spark):
    t = spark.createDataFrame([(1, "pipeline", "epoch", 0, 100, 100, 1, None), (1, "pipeline", "epoch", 50, 10**9, 10**9, 1, None), (2, "x", "y", 60, 61, 1, 1, None), *[(1, "x", "y", s, s, 0, 1, None) for s in (10, 50, 99, 100, 10**9 - 1, 10**9)]], TRACE)
    got = N.assign_epochs(t, N.epochs(t, F.expr("func_name = 'epoch'"))).where("cat = 'x'")
    assert rows(got, "pid", "time_start", "epoch") == [(1, 10, 1), (1, 50, 2), (1, 99, 2), (1, 100, 2), (1, 10**9 - 1, 2), (1, 10**9, None), (2, 60, None)]


def test_steps_carry_over_chunks(spark):
    t = spark.createDataFrame([(1, "m", "step", s, s, 0, 1, None) for s in (5, 95)] + [(1, "x", "y", s, s, 0, 1, None) for s in (1, 5, 50, 200)], TRACE)
    got = N.assign_steps(t, F.expr("func_name = 'step'"), chunk=10).where("cat = 'x'")
    assert rows(got, "time_start", "step") == [(1, None), (5, 1), (50, 1), (200, 2)]


def test_slices_conserve_time_and_count(spark):
    t = spark.createDataFrame([(1, "c", "f", 0, 0, 2_500_000, 1, 10), (1, "c", "f", 7, 7, 0, 1, None)], TRACE)
    assert rows(N.sliced(t, SECOND), "time", "time_start") == [(0, 7), (500_000, 2_000_000), (1_000_000, 0), (1_000_000, 1_000_000)]
    assert N.sliced(t, SECOND).agg(F.sum("count")).first()[0] == pytest.approx(2)
    assert N.sliced(t, SECOND, drop_zero=True).count() == 3


def profile(spark, **kw):
    base = {"cat": "posix", "name": "read", "pid": 1, "tid": 1, "ts": 10_000_000, "dft_cnt": 3, "dur_sum": 300, "dur_min": None, "dur_max": None, "ret_sum": None} | kw
    return P.standard(spark.createDataFrame([tuple(base.values())], "cat string, name string, pid bigint, tid bigint, ts bigint, dft_cnt bigint, dur_sum bigint, dur_min bigint, dur_max bigint, ret_sum bigint"))


def test_profile_expansion(spark):
    got = rows(P.expanded(profile(spark), SECOND), "time_start", "count", "time")
    assert [r[1] for r in got] == [1, 1, 1, 0, 0] and sum(r[2] for r in got) == pytest.approx(300) and got[1][0] == 11_000_000
    w = rows(P.expanded(profile(spark, dft_cnt=10, dur_sum=1000, dur_min=10, dur_max=190), SECOND, "weighted"), "time_start", "time")
    assert [r[1] for r in w] == pytest.approx([20, 110, 200, 290, 380])
    for bad in (3_000_000, 7_000_000):
        with pytest.raises(ValueError, match="evenly divide"):
            P.expansion(bad)
    assert P.expansion(10_000_000) == 1 and P.expansion(2_500_000) == 2


def test_profiles_coalesce_with_null_keys(spark):
    two = profile(spark, pid=None, dft_cnt=5, dur_sum=20, dur_min=2, dur_max=6).unionByName(profile(spark, pid=None, dft_cnt=3, dur_sum=9, dur_min=1, dur_max=5))
    assert rows(P.coalesced(two), "count", "time", "time_min", "time_max", "size") == [(8, 29, 1, 6, None)]


def test_reconcile_keeps_only_new_profile_keys_nulls_equal(spark):
    a = spark.createDataFrame([("x", None, 1)], "k string, j string, count bigint")
    b = spark.createDataFrame([("x", None, 5), ("y", None, 7)], "k string, j string, count bigint")
    assert rows(P.reconciled(a, b, ["k", "j"])) == [("x", None, 1), ("y", None, 7)]


def test_system_metrics(spark):
    kinds = "host_hash string, ts bigint, name string, user_pct double, system_pct double, iowait_pct double, idle_pct double, dirty double, cached double, mem_available double"
    df = spark.createDataFrame([("h", 5_000_000, "cpu", 10.0, 1.0, 3.0, 86.0, None, None, None), ("h", 5_000_001, "cpu-0", 1.0, 1.0, 7.0, 1.0, None, None, None), ("h", 5_000_002, "cpu-1", 1.0, 1.0, 2.0, 1.0, None, None, None), ("h", 5_000_003, "memory", None, None, None, None, 0.5, 2.0, 1e6), (None, 1, "cpu", 1.0, 1.0, 1.0, 1.0, None, None, None)], kinds)
    assert rows(Y.system_metrics(df, 5 * SECOND), "host_hash", "time_range", "sys_cpu_user_pct", "sys_cpu_iowait_pct", "sys_core_iowait_pct_max", "sys_core_iowait_pct_p95", "sys_mem_available", "sys_mem_dirty") == [("h", 1, 10.0, 3.0, 7.0, pytest.approx(6.75), 1e6, 0.5)]


# ---- views ----

FULL = "cat string, func_name string, pid bigint, proc_name string, file_name string, time_range bigint, io_cat tinyint, acc_pat tinyint, time bigint, count bigint, size bigint"


def traces(spark):
    return spark.createDataFrame(
        [
            ("posix", "read", 1, "p1", "/a", 0, 1, 0, 2_000_000, 1, 100),
            ("posix", "read", 1, "p1", "/a", 0, 1, 0, 0, 1, None),
            ("posix", "open", 2, "p2", "/b", 0, 3, 0, 1_000_000, 1, None),
            ("compute", "step", 1, "p1", None, 1, 6, 0, 3_000_000, 2, None),
            ("compute", "step", 1, "p1", None, None, 6, 0, 9_000_000, 2, None),
        ],
        FULL,
    )


def test_view_statistics_nulls_and_zeros(spark):
    which = V.metrics(presets.AI.only("posix", "compute"))
    detail = V.hlm(traces(spark), ["time_range"])
    view = V.view(V.main_view(detail, ["time_range"], which, calls=True), "time_range", which, calls=True)
    r = {x["time_range"]: x for x in view.collect()}
    assert set(r) == {0, 1}
    assert (r[0]["posix_time_sum"], r[0]["posix_time_proc_max"], r[0]["posix_time_proc_mean"], r[0]["posix_count_sum"], r[0]["posix_size_sum"]) == (3.0, 2.0, 1.5, 3, 100)
    assert r[0]["posix_read_bw_sum"] == 50 and r[0]["posix_sync_time_sum"] is None and r[0]["compute_time_sum"] is None
    assert r[0]["posix_read_time_call_mean"] == 1.0 and r[0]["posix_read_time_call_std"] == pytest.approx(1.0)
    assert (r[1]["compute_time_sum"], r[1]["posix_time_sum"]) == (3.0, None)
    zero = V.view(V.main_view(detail, ["time_range"], which), "time_range", which, zero_fill=True)
    assert zero.where("time_range = 0").first()["posix_read_time_proc_min"] is None  # 0 is missing after the last level


def test_one_aggregate_equals_joins_by_layer(spark):
    few = presets.AI.only("posix", "compute")
    detail = V.hlm(traces(spark), ["time_range"])
    a, b = (f(detail, ["time_range"], "time_range", few) for f in (V.flat_view, V.flat_view_by_layer))
    cols = sorted(a.columns)
    assert set(cols) == set(b.columns) and rows(a, *cols) == rows(b, *cols)


def test_partitioning_does_not_matter(spark):
    few = presets.POSIX
    got = [rows(V.flat_view(V.hlm(traces(spark).repartition(n), ["time_range"]), ["time_range"], "time_range", few)) for n in (1, 7)]
    assert got[0] == got[1]


def test_unique_counts_drill_down_and_logical_views(spark):
    t = traces(spark)
    assert rows(V.unique_counts(t, "time_range", presets.AI.only("posix", "compute").layers, "file_name")) == [(0, 0, 2), (1, 0, 0)]
    which = V.metrics(presets.POSIX, False)
    main = V.main_view(V.hlm(t, ["file_name"]), ["file_name"], which)
    assert rows(V.drill_down(main, spark.createDataFrame([("/b",)], "file_name string"), "file_name"), "file_name") == [("/b",)]
    assert rows(V.logical_view(main, "file_name", "file_dir", which), "file_dir", "posix_count_sum") == [("/", 3)]


def test_quantile_stats(spark):
    df = spark.createDataFrame([("g", float(v)) for v in [0, 1, 2, 3, 4, 100]] + [("g", None)], "g string, v double")
    assert rows(V.quantile_stats(df, "g", "v", 10, 90)) == [("g", 3.0, pytest.approx(math.sqrt(2 / 3)), 3)]


def test_every_quantile_pair(spark):
    df = spark.createDataFrame([(g, float(v * v % 97)) for g in "gh" for v in range(60 if g == "g" else 5)] + [("g", None), ("i", 0.0)], "g string, v double")
    got = rows(V.quantile_pairs(df, "g", "v"))
    want = [(g, lo, hi, *x) for lo, hi in ((1, 99), (5, 95), (10, 90), (25, 75)) for g, *x in rows(V.quantile_stats(df, "g", "v", lo, hi))]
    assert len(got) == 8 and [(*a[:3], a[5]) for a in got] == sorted((*a[:3], a[5]) for a in want)
    assert [x for a in got for x in a[3:5]] == pytest.approx([x for a in sorted(want) for x in a[3:5]])


def test_shares_slopes_and_ranks(spark):
    kinds = "time_range bigint, a_count_sum bigint, a_time_sum double, a_time_proc_max double"
    view = spark.createDataFrame([(0, 1, 3.0, 3.0), (1, 3, 1.0, 1.0), (2, 1, 3.0, 3.0), (3, None, None, None)], kinds)
    r = {x["time_range"]: x for x in M.shares(view, ["a"], "time_range", []).collect()}
    assert r[0]["a_count_frac_total"] == 0.2 and r[0]["a_ops_slope"] == pytest.approx(3 / 7 / 0.2) and r[3]["a_ops_percentile"] is None
    assert [r[i]["a_ops_percentile"] for i in range(3)] == pytest.approx([2.5 / 3, 1 / 3, 2.5 / 3])
    none = M.shares(spark.createDataFrame([(0, 0, 0.0, 0.0)], kinds), ["a"], "time_range", [], ranks=False).first()
    assert none["a_count_frac_total"] is None and none["a_ops_slope"] is None


def test_across_layers(spark):
    p = presets.Preset("p", tuple(presets.Layer(n, None, q) for n, q in (("a", None), ("b", "a"), ("compute", "a"))), ("b",), "a")
    kinds = "time_range bigint, a_time_sum double, a_time_proc_max double, b_time_sum double, b_time_proc_max double, compute_time_sum double, compute_time_proc_max double"
    view = spark.createDataFrame([(0, 10.0, 8.0, 4.0, 4.0, 3.0, 3.0), (1, 1.0, 1.0, 5.0, 5.0, None, None), (2, None, None, 1.0, 1.0, 2.0, 2.0)], kinds)
    r = {x["time_range"]: x for x in M.across_layers(view, p, "time_range").collect()}
    assert (r[0]["o_a_time_sum"], r[1]["o_a_time_sum"], r[2]["o_a_time_sum"]) == (3.0, 0.0, None)
    assert (r[0]["u_b_time_sum"], r[1]["u_b_time_sum"], r[2]["u_b_time_sum"]) == (1.0, 5.0, 0.0)
    assert r[0]["b_time_proc_frac_parent"] == 0.5 and r[0]["o_a_time_call_frac_total"] == 1.0 and r[2]["b_time_call_frac_a"] is None


@pytest.mark.parametrize(("slope", "severity"), [(1.0, 0.0), (math.tan(math.radians(67.5)), 0.5), (1e9, 1.0), (0.1, 0.0), (None, None)])
def test_slope_severity(spark, slope, severity):
    got = spark.createDataFrame([(slope,)], "s double").select(M.slope_severity(F.col("s"))).first()[0]
    assert got == (None if severity is None else pytest.approx(severity, abs=1e-6))


# ---- presets ----


def test_discovered_layers_nest(spark):
    forest = presets.discovered(["ai.data.io", "ai.compute", "compute", "app", "posix"])
    assert forest.names == ["app", "ai", "ai_compute", "ai_data", "ai_data_io", "app_2", "compute", "posix"]
    assert forest.layer("ai_data_io").parent == "ai_data" and forest.layer("posix").sized
    df = spark.createDataFrame([("ai.data.io",), ("ai",), ("aix",)], "cat string")
    assert df.where(forest.layer("ai").where).count() == 2


@pytest.mark.parametrize(("cats", "name"), [({"pipeline"}, "ai"), ({"reader"}, "dlio"), ({"stdio", "x"}, "posix"), ({"mpi"}, "auto"), (set(), "auto")])
def test_detection(cats, name):
    assert presets.detect(sorted(cats)).name == name and presets.detect(sorted(cats), "posix").name == "posix"


# ---- expressions and facts ----


@pytest.mark.parametrize(
    ("text", "value"),
    [("a / z", None), ("max(a, n)", 3.0), ("max(a)", 3.0), ("a > 1 and not b > 5", True), ("clip01(a / b)", 0.75), ("fillna0(n) + 1", 1.0), ("math.sqrt(b) if a > 0 else 0", 2.0), ("(a > 1) & (b < 5) | False", True), ("1 < a < 4", True), ("a ** 2 % 4 - -1", 2.0)],
)
def test_expressions(spark, text, value):
    df = spark.createDataFrame([(3.0, 4.0, 0.0, None)], "a double, b double, z double, n double")
    assert df.select(E.compile_expression(text, set(df.columns))).first()[0] == value


@pytest.mark.parametrize("text", ["__import__('os')", "a.b", "unknown + 1", "[1]", "open('x')", "a if", "(lambda: 1)()"])
def test_expressions_outside_the_whitelist(text):
    with pytest.raises(E.ExpressionError):
        E.compile_expression(text, {"a"})


def test_column_aggregates_and_names(spark):
    df = spark.createDataFrame([(1.0,), (4.0,)], "a double")
    rule = facts.build_rule({"id": "r", "fact_type": "t", "when": "max(a) > 3", "severity_score": "a / max(a)"})
    count = lambda how: facts.rule_facts(df.withColumn("k", F.col("a")), ["k"], [rule], emit_mode="detail", aggregates=how).count()
    assert (count("rowwise"), count("column")) == (1, 2)
    assert E.identifiers("x / max(y, math.pi)") == ["x", "y"] and E.denominators("a / (b + c)") == ["b", "c"]
    assert E.mixes_time_aggregates("p_time_sum / p_time_proc_max")


def file_view(spark):
    return spark.createDataFrame([("/a", 0.9), ("/b", 0.8), ("/c", 0.7), ("/d", 0.3), ("/e", 0.1), ("/f", None)], "file_name string, s double")


def test_aggregate_facts(spark):
    rule = facts.build_rule({"id": "r", "fact_type": "t", "when": "s > 0.5", "severity_score": "s * 2", "required_metrics": ["s"], "opportunity_tags": ["x"]})
    r = facts.rule_facts(file_view(spark), ["file_name"], [rule], "run").first()
    assert r["evidence"]["metrics"] == {"affected_count": 3.0, "total_count": 6.0, "affected_fraction": 0.5}
    assert [(t["entity"], t["metrics"]) for t in r["evidence"]["top_k"]] == [("/a", {"s": 0.9}), ("/b", {"s": 0.8}), ("/c", {"s": 0.7})]
    assert (r["severity"]["score"], r["severity"]["label"], r["confidence"], r["scope"]["entity"]) == (1.0, "critical", 1.0, None)
    none = facts.build_rule({"id": "r", "fact_type": "t", "when": "s > 5", "severity_score": "s"})
    assert facts.rule_facts(file_view(spark), ["file_name"], [none]).count() == 0
    assert facts.rule_facts(file_view(spark), ["file_name"], [facts.build_rule({"id": "r", "fact_type": "t", "when": "gone > 1", "severity_score": "1"})]) is None


def test_temporal_facts_carry_their_place(spark):
    view = spark.createDataFrame([(1, 0.9), (2, 0.95)], "time_range bigint, s double")
    rule = facts.build_rule({"id": "r", "fact_type": "t", "when": "s > 0", "severity_score": "s"})
    got = sorted(facts.rule_facts(view, ["time_range"], [rule], granularity=10 * SECOND).collect(), key=lambda r: r["window"]["time_bucket"])
    assert [(r["window"]["t0_ns"], r["window"]["t1_ns"], r["scope"]["entity"]) for r in got] == [(10**10, 2 * 10**10, None), (2 * 10**10, 3 * 10**10, None)]
    assert len({r["fact_id"] for r in got}) == 2 and got[0]["fact_id"].startswith("af_")
    env = facts.envelope(facts.rule_facts(view, ["time_range"], [rule]), {"run_id": None})
    assert env["fact_count_by_view"] == {"time_range": 2} and json.dumps(env)
    assert rows(facts.summary(facts.rule_facts(view, ["time_range"], [rule])), "fact_type", "n", "label") == [("t", 2, "critical")]


def test_slope_facts(spark):
    view = spark.createDataFrame([("a", 1.0, 1e9), ("b", math.tan(math.radians(67.5)), None)], "proc_name string, posix_ops_slope double, reader_posix_read_ops_slope double")
    got = facts.slope_facts(view, ["proc_name"], ["reader", "posix", "reader_posix"], emit_mode="detail").collect()
    assert sorted((r["fact_type"], r["scope"]["layer"], r["scope"]["entity"]) for r in got) == [("posix_ops_slope", "posix", "b"), ("read_slope", "reader_posix", "a")]


def test_rules_are_checked():
    bad = {"id": "r", "fact_type": "t", "when": "a_time_sum > a_time_max", "severity_score": "1"}
    with pytest.raises(ValueError, match="mixes"):
        facts.build_rule(bad)
    assert facts.build_rule(bad | {"allow_mixed": True}) and facts.load_rules("io")[0].priority == 20
    with pytest.raises(ValueError, match="emit_mode"):
        facts.build_rule({"id": "r", "fact_type": "t", "when": "1 > 0", "severity_score": "1", "emit_mode": "x"})


# ---- end to end ----


def test_analysis_outputs_and_checkpoints(spark, tmp_path):
    events = [record("M", "HH", "tracer", name="hostA", value="h1")]
    events += [record("X", n, c, 1_000_000 + i * 400_000, 100_000, tid=1 + i % 2, ret=1000) for i, (n, c) in enumerate([("read", "POSIX"), ("open", "POSIX"), ("send", "MPI"), ("start", "tracer")] * 3)]
    (tmp_path / "t").mkdir()
    request = api.Request(write(tmp_path / "t", events), ["time_range", "proc_name"], preset="auto", derived=False, facts="rule", checkpoint_dir=str(tmp_path / "keep"), emit_mode="detail")
    result = api.analyze(spark, request)
    assert result.layers == ["app", "mpi", "posix"]
    view = result.get_flat_view("time_range")
    assert view.agg(F.sum("app_count_sum")).first()[0] == 12 and view.agg(F.sum("mpi_count_sum")).first()[0] == 3
    assert view.columns[1:] == sorted(view.columns[1:]) and "posix_file_name_nunique" in view.columns
    sinks.to_files(result, str(tmp_path / "out"))
    assert (tmp_path / "out/facts.jsonl").read_text().count("\n") == 1 and spark.read.parquet(str(tmp_path / "out/detail_view_proc_name.parquet")).count() == 2
    assert json.loads(sinks.to_json(result))["raw_stats"]["trace_event_count"] == 12
    sinks.to_sqlite(result, str(tmp_path / "s.db"))
    again = api.analyze(spark, request)
    assert rows(again.get_hlm(), "cat", "count") == rows(result.get_hlm(), "cat", "count")


def test_checkpoints_notice_changed_files_and_refuse_bare_frames(spark, tmp_path):
    def events(n):
        return [record("X", "read", "POSIX", 1_000_000 + i * 1000, 10, ret=1) for i in range(n)]

    (tmp_path / "t").mkdir()
    request = api.Request(write(tmp_path / "t", events(5), "a.pfw"), derived=False, checkpoint_dir=str(tmp_path / "keep"))
    count = lambda: api.analyze(spark, request).get_hlm().agg(F.sum("count")).first()[0]
    assert [count(), count()] == [5, 5]
    write(tmp_path / "t", events(9), "a.pfw")
    assert count() == 9
    write(tmp_path / "t", events(2), "b.pfw")
    assert count() == 11
    data = R.read_trace(spark, str(tmp_path / "t"))
    with pytest.raises(ValueError, match="bare frames"):
        api.analyze_frames(data, request)


def test_a_source_of_ones_own(spark, tmp_path):
    class Mine:
        def read(self, spark, request):
            return read(spark, tmp_path, HYBRID, request.time_granularity), None

        def state(self, spark, request):
            return "v1"

    result = api.analyze(spark, api.Request(time_granularity=5.0, derived=False, checkpoint_dir=str(tmp_path / "keep")), Mine())
    assert result.raw_stats().first()["total_event_count"] == 4 and result.get_hlm().count() == 2


def test_additional_metrics_and_transfer_sizes_in_outputs(spark, tmp_path):
    import io

    events = [record("X", "read", "POSIX", 1_000_000 + i * 1_500_000, 100_000, ret=2**20) for i in range(4)]
    request = api.Request(write(tmp_path, events), derived=False, additional_metrics={"moved_mb": "posix_size_sum", "odd": "posix_size_sum / (posix_count_sum - posix_count_sum)"}, facts="rule", rule_file="posix", emit_mode="detail")
    result = api.analyze(spark, request)
    data = json.loads(sinks.to_json(result))["views"]["time_range"]
    got = data["additional_metrics"]
    assert got["moved_mb"]["unit"] == "MB" and got["moved_mb"]["n"] >= 3 and got["moved_mb"]["max"] >= 1 and got["odd"] == {"unit": "-", "n": 0, "min": None, "mean": None, "max": None}
    layer = next(x for x in data["summary"] if x["layer"] == "posix")
    assert layer["transfer_size"] == 2**20 and layer["u_size"] is None
    sinks.to_console(result, out := io.StringIO())
    assert "metric moved_mb [MB]" in out.getvalue() and "metric odd [-]: 0, -" in out.getvalue()
    env = result.to_fact_envelope()
    assert env["context"]["total_event_count"] == 4 and env["context"]["window_type_counts"] == env["fact_count_by_view"] and len(env["facts"]) == sum(env["fact_count_by_view"].values())
    sinks.to_files(result, str(tmp_path / "out"))
    sinks.to_files(result, str(tmp_path / "out"))
    lines = (tmp_path / "out/facts.jsonl").read_text().splitlines()
    assert len(lines) == 2 and json.loads(lines[1]) == env


def test_filters_keep_quotes_inside_values(spark):
    df = spark.createDataFrame([('a"b', 1), ("a'b", 2)], "cat string, ts bigint")
    raw = R.RawTraces(df)
    assert rows(raw.filter("cat == 'a\"b' and ts < 5").df) == [('a"b', 1)]
    assert rows(raw.filter('cat == "a\'b"').df) == [("a'b", 2)]
    assert raw.filter("cat LIKE 'a%' AND ts BETWEEN 1 AND 2").df.count() == 2


def test_sets_and_their_unions(spark):
    t = spark.createDataFrame([("k", "d1", "b"), ("k", "d1", "a"), ("k", "d1", None), ("k", "d2", "a"), ("l", "d2", None), (None, "d1", "z")], "g string, day string, v string")
    per_day = V.unique_values(t.selectExpr("concat(g, day) as gd", "g", "v"), "gd", "v")
    assert rows(per_day) == [("kd1", ["a", "b"]), ("kd2", ["a"]), ("ld2", [])]
    assert rows(V.united_sets(per_day.selectExpr("left(gd, 1) as g", "v_set"), "g", "v_set")) == [("k", ["a", "b"]), ("l", [])]


def test_percentiles_equal_interpolated_ones(spark):
    from iolens.functions import ranks

    df = spark.createDataFrame([("a", x) for x in [5, 1, 1, 9, 12, 12, 40]] + [("b", 3), ("c", None), (None, 7), (None, 8)], "g string, v bigint")
    points = [0.0, 0.05, 0.5, 0.95, 1.0]
    want = {r["g"]: r["p"] for r in df.where("v is not null").groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, points))).alias("p")).collect()}
    assert {r["g"]: r["at"] for r in ranks.percentiles(df, "g", "v", points).collect()} == want
    assert ranks.percentiles(df.where("false"), "g", "v", points).count() == 0


def test_process_parts_ids_scores_and_quantile_columns(spark):
    df = spark.createDataFrame([("app#h#7#3",), ("sim#n1#12",), (None,)], "p string")
    parts = df.select(*[c.alias(n) for n, c in N.process_parts(F.col("p")).items()])
    assert [tuple(r) for r in parts.collect()] == [("app", "h", "7", None, "3"), ("sim", "n1", None, "12", None), (None,) * 5]
    ids = [r[0] for r in df.select(N.stable_id(F.lit("a"), F.col("p"))).collect()]
    import hashlib

    assert ids == [int(hashlib.md5(f"a_{p}".encode()).hexdigest()[:15], 16) for p in ("app#h#7#3", "sim#n1#12", None)]
    view = spark.createDataFrame([(0.3, 1.5, 1e9, 200.0, 50.0), (None, 0.2, None, None, 400.0)], "a_pct double, b_util double, c_ops_slope double, d_bw_mean double, e_count double")
    got = M.with_scores(view, {"d_bw_mean": 400.0, "e_count": 100.0, "gone": 1.0}).collect()
    assert [got[0][f"{c}_score"] for c in ("a_pct", "b_util", "d_bw_mean", "e_count")] == [0.3, 0.0, 0.5, 0.5] and got[0]["c_ops_slope_score"] > 0.99
    assert [got[1][f"{c}_score"] for c in ("a_pct", "b_util", "c_ops_slope", "d_bw_mean", "e_count")] == [None, 0.8, None, None, 1.0]
    q = spark.createDataFrame([([2.0, 0.5, 4.0], 1), (None, 2)], "time_q1_q99_stats array<double>, k int")
    assert rows(V.split_quantiles(q), "k", "time_q1_q99_mean", "time_q1_q99_std", "time_q1_q99_count") == [(1, 2.0, 0.5, 4), (2, None, None, None)]
    h = spark.createDataFrame([("a", 5), ("a", 7), ("b", None)], "g string, time bigint")
    assert rows(V.exceeding_time(h, ["g"], 10)) == [(12, True)] and rows(V.exceeding_time(h.where("false"), ["g"], 10)) == [(None, False)]


def test_every_named_pack_compiles_over_its_view(spark):
    from iolens.rulepacks import PACKS

    assert {n: len(facts.load_rules(n)) for n in PACKS} == {"posix": 5, "dlio": 13, "dlio-all": 11, "dlio-app": 4, "dlio-global": 4, "dlio-posix-corona": 8, "dlio-posix-lustre3": 8, "stormer": 11}
    values = {"fetch_data_time_proc_max": 8.0, "compute_time_proc_max": 2.0, "reader_open_time_proc_max": 0.0, "reader_posix_time_proc_max": 7.0, "comm_time_proc_max": 9.0, "data_loader_proc_name_nunique": 4.0}
    values |= {f"{x}_{op}_time_proc_frac_parent": 0.95 for x in ("posix", "reader_posix") for op in ("read", "write", "metadata", "data")}
    values |= {f"{x}_{op}_{m}": 100.0 * (1 + (op == "read")) for x in ("posix", "reader_posix") for op in ("read", "write") for m in ("size_proc_mean", "count_sum", "size_sum")}
    values |= {"reader_posix_read_bw_proc_mean": 1e6, "reader_posix_read_bw_proc_max": 170e6, "reader_posix_metadata_time_proc_max": 6.0, "reader_posix_read_time_call_mean": 3.0, "reader_posix_read_time_call_min": 0.1}
    found = {}
    for view in ("epoch", "host_hash", "proc_name"):
        rows_ = [("1", *values.values()), ("2", *[v * 3 if k == "fetch_data_time_proc_max" else v for k, v in values.items()])]
        df = spark.createDataFrame(rows_, f"{view} string, " + ", ".join(f"{k} double" for k in values))
        for name in PACKS:
            got = facts.rule_facts(df, [view], facts.load_rules(name), "r", "detail", aggregates="column")
            found.setdefault(name, set()).update(r["fact_type"] for r in (got.collect() if got is not None else ()))
    assert found["posix"] == {"small_read_dominance", "small_write_dominance", "metadata_dominance", "operation_imbalance", "size_imbalance"}
    assert {"fetch_pressure", "read_pressure", "read_contention", "bw_saturation", "fetch_rank_imbalance"} <= found["dlio"] and "compute_dominance" not in found["dlio"]
    assert "comm_dominance" in found["stormer"] and "reader_bw_pressure" in found["dlio-posix-lustre3"] and {"reader_metadata_heavy", "reader_metadata_contention"} <= found["dlio-posix-corona"]
    assert "fetch_pressure" in found["dlio-global"] and "fetch_rank_imbalance" in found["dlio-app"]


def test_counts_do_not_depend_on_granularity(spark, tmp_path):
    path = write(tmp_path, [record("X", "read", "POSIX", 1000 + i * 700_000, 10, ret=1) for i in range(20)])
    got = [api.analyze(spark, api.Request(path, time_granularity=g, derived=False)).get_main_view().agg(F.sum("posix_count")).first()[0] for g in (1.0, 10.0, 5.0)]
    assert got == [20, 20, 20]


def test_command_line():
    request, output, path = cli.parse(["trace_path=/x", "view_types=time_range,file_name", "time_granularity=2", "time_sliced=true", "output=json", "output_path=/y"])
    assert (request.view_types, request.time_granularity, request.time_sliced, output, path) == (["time_range", "file_name"], 2.0, True, "json", "/y")
    with pytest.raises(SystemExit):
        cli.parse(["nonsense=1"])


def test_streams_equal_batch(spark, tmp_path):
    from iolens.streaming import stream

    (tmp_path / "in").mkdir()
    events = [record("X", "read", "POSIX", i * 1_000_000, 5, pid=i % 2) for i in range(12)]
    write(tmp_path / "in", events[:6], "a.pfw")
    write(tmp_path / "in", events[6:], "b.pfw")
    live = stream.read_stream(spark, str(tmp_path / "in"), per_trigger=1)
    got = stream.run_available(stream.tumbling(live, 5), ["window_start", "cat"], str(tmp_path / "c1"), "update")
    assert rows(got) == [(0, "posix", 5, 25), (5_000_000, "posix", 5, 25), (10_000_000, "posix", 2, 10)]
    epochs = stream.run_available(stream.epoch_state(stream.read_stream(spark, str(tmp_path / "in"), per_trigger=1), "name = 'read'"), ["pid", "epoch"], str(tmp_path / "c2"))
    assert sorted(r["epoch"] for r in epochs.where("pid = 1").collect()) == [1, 2, 3, 4, 5, 6]
    seen = []
    stream.for_each_window(stream.read_stream(spark, str(tmp_path / "in")), lambda df, i: seen.append(df.count()), str(tmp_path / "c3")).awaitTermination()
    assert sum(seen) == 12
    stream.for_each_window(stream.read_stream(spark, str(tmp_path / "in"), per_trigger=1), stream.batches_to_files(str(tmp_path / "kept")), str(tmp_path / "c5")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "kept")).groupBy("batch").count().count() == 2 and spark.read.parquet(str(tmp_path / "kept")).count() == 12
    s = stream.run_available(stream.sessions(stream.read_stream(spark, str(tmp_path / "in")), "3 seconds"), ["start", "stop", "pid"], str(tmp_path / "c4"), "complete")
    assert rows(s, "pid", "count") == [(0, 6), (1, 6)]


@pytest.mark.skipif(not os.path.exists(SMALL), reason="no test data")
def test_queries_hold_every_derived_metric_and_prefix(spark):
    got = Q.derived_frac(spark, SMALL)
    want = {f"{x.name}_{m}_time_{t}_frac_{of}" for x in presets.AI.layers for m in x.derived for t in ("proc", "call") for of in ("epoch", "parent", "total")}
    assert set(got.columns) == want | {"time_range"}
    assert got.agg(F.sum("posix_read_time_call_frac_total")).first()[0] == pytest.approx(1, abs=1e-4)
    view = Q.view_posix_prefixes(spark, SMALL)
    assert {f"{m.prefix}_time_sum" for m in V.metrics(presets.POSIX)} <= set(view.columns) and view.count() > 0


@pytest.mark.skipif(not os.path.exists(SMALL), reason="no test data")
def test_root_layer_is_counted(spark):
    n = dict(rows(Q.auto_layers_root(spark, SMALL)))
    assert n.pop("app") == Q.scan_events(spark, SMALL).count()
    assert n == dict(rows(Q.auto_layers(spark, SMALL)))
