"""SQL of the engine's queries, made from the same layer definitions."""

from __future__ import annotations

import re

from iolens import schema as S
from iolens.operators.views import Metric, metrics
from iolens.presets import AI, DLIO, POSIX, Preset
from iolens.rulepacks import PACKS

HOUR = 3600 * S.TICKS
_CORE = ("epoch", "compute", "fetch_data", "checkpoint", "data_loader", "reader", "posix", "reader_posix")
CORE = AI.only(*_CORE)


def _list(names: list[str]) -> str:
    return ", ".join(f"'{n}'" for n in names)


def duck(predicate: str | None) -> str:
    """A layer predicate in DuckDB's words."""
    return re.sub(r"(\w+) rlike ('[^']*')", r"regexp_matches(\1, \2)", predicate or "true")


_IO_CAT = "CASE " + " ".join(f"WHEN func_name IN ({_list(v)}) THEN {k}" for k, v in S.IO_FUNCTIONS.items()) + " ELSE 6 END"
_KEEP = f"""(file_name IS NULL OR NOT regexp_matches(file_name, '{"|".join(S.IGNORED_PATHS)}')) AND
  (func_name IS NULL OR NOT (func_name IN ({_list(S.IGNORED_FUNCTIONS)}) OR regexp_matches(func_name, '{"|".join(S.IGNORED_FUNCTION_PATTERNS)}')))"""
_MARKS = " || ".join(f"CASE WHEN regexp_matches(cat, 'posix|stdio') AND file_name IS NOT NULL AND contains(file_name, '{p}') THEN '{m}' ELSE '' END" for p, m in S.PATH_SUFFIXES)
ORIGIN = f"(SELECT min(ts) // {HOUR} * {HOUR} FROM trace_events)"
_PROC = "'app#' || coalesce(host_name, host_hash, 'unknown') || '#' || pid || '#' || tid"


def even(sql: str) -> str:
    """round(x, n) as round_even(x * 10**n, 0) / 10**n, the same steps as in the queries."""
    while m := re.search(r"(?<![a-z_])round\(", sql):
        depth, cut, i = 1, 0, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            cut = i if depth == 1 and sql[i] == "," else cut
            i += 1
        n = float(10 ** int(sql[cut + 1 : i - 1]))
        sql = f"{sql[: m.start()]}(round_even(({sql[m.end() : cut]}) * {n}, 0) / {n}){sql[i:]}"
    return sql


def traces(origin: str = ORIGIN) -> str:
    """CTEs raw0 (records), raw1 (with io_cat) and t (normalized traces)."""
    return f"""raw0 AS (SELECT DISTINCT event_id, lower(trim(cat)) AS cat, lower(trim(name)) AS func_name, pid, tid, file_hash, host_hash, file_name, host_name,
      epoch, CASE WHEN dur >= 0 THEN dur END AS time, size AS ret, ts AS time_start FROM trace_events WHERE ts IS NOT NULL),
    raw1 AS (SELECT *, {_IO_CAT} AS io_cat FROM raw0 WHERE {_KEEP}),
    t AS (SELECT event_id, cat || {_MARKS} AS cat, func_name, pid, tid, epoch, file_hash, host_hash, file_name, io_cat, time, time_start,
      CASE WHEN io_cat IN (1, 2) AND ret > 0 THEN ret END AS size, {_PROC} AS proc_name, time_start + coalesce(time, 0) AS time_end,
      (time_start - {origin}) // {HOUR} AS time_range, 1 AS count FROM raw1)"""


_EDGES = [None, *S.SIZE_EDGES, None]
_BINS = {
    n: " AND ".join(["size IS NOT NULL"] + ([f"size > {lo}"] if lo is not None else []) + ([f"size <= {hi}"] if hi is not None else []))
    for n, lo, hi in zip(S.SIZE_BINS, _EDGES, _EDGES[1:], strict=False)
}


def hlm(views: list[str], source: str = "t", name: str = "h") -> str:
    keys = ", ".join(dict.fromkeys([*sorted({*views, "proc_name"}), "cat", "io_cat", "func_name"]))
    alive = " AND ".join(f"{k} IS NOT NULL" for k in keys.split(", "))
    bins = ", ".join(f"nullif(count(CASE WHEN {c} THEN 1 END), 0) AS size_bin_{n}" for n, c in _BINS.items())
    return f"""{name} AS (SELECT {keys}, CAST(nullif(sum(time), 0) AS BIGINT) AS time, CAST(nullif(sum(count), 0) AS BIGINT) AS count, CAST(nullif(sum(size), 0) AS BIGINT) AS size, {bins},
      nullif(min(time), 0) AS time_call_min, nullif(max(time), 0) AS time_call_max, nullif(min(size), 0) AS size_call_min, nullif(max(size), 0) AS size_call_max,
      CAST(nullif(sum(CAST(time AS HUGEINT) * time), 0) AS HUGEINT) AS time_sq, CAST(nullif(sum(CAST(size AS HUGEINT) * size), 0) AS HUGEINT) AS size_sq
      FROM {source} WHERE {alive} GROUP BY {keys})"""


def main(views: list[str], which: list[Metric], calls: bool = False) -> str:
    keys = ", ".join(sorted({*views, "proc_name"}))
    cols, ratios = [], []
    for m in which:
        pick = lambda c, m=m: f"CASE WHEN {duck(m.where)} THEN {c} END"
        cols += [f"CAST(nullif(sum({pick(b)}), 0) AS BIGINT) AS {m.col(b)}" for b in ["time", "count", *["size"] * m.sized]]
        seconds = f"nullif({m.col('time')} / 1000000.0, 0)"
        ratios.append(f"CAST({m.col('count')} AS DOUBLE) / {seconds} AS {m.col('ops')}")
        if m.sized:
            ratios += [f"CAST({m.col('size')} AS DOUBLE) / {seconds} AS {m.col('bw')}", f"CAST({m.col('count')} AS DOUBLE) / {m.col('size')} AS {m.col('intensity')}"]
        if calls:
            cols += [f"{how}({pick(f'{b}_{s}')}) AS {m.col(f'{b}_{s}')}" for b in ["time", *["size"] * m.sized] for s, how in (("sq", "sum"), ("call_min", "min"), ("call_max", "max"))]
    some = ", ".join(m.col("count") for m in which)
    return f"m0 AS (SELECT {keys}, {', '.join(cols)} FROM h GROUP BY {keys}), m AS (SELECT *, {', '.join(ratios)} FROM m0 WHERE coalesce({some}) IS NOT NULL)"


def view(by: str, which: list[Metric], source: str = "m", name: str = "v") -> str:
    """CTEs <name>0 (per process) and <name>: sums and statistics; times in seconds."""
    bases = [m.col(b) for m in which for b in ["time", "count", "ops", *["size", "bw", "intensity"] * m.sized]]
    keys = ", ".join(dict.fromkeys([by, "proc_name"]))
    inner = ", ".join(f"sum({c}) AS {c}" for c in bases)
    stats = []
    for c in bases:
        scale = " / 1000000.0" if c.endswith("_time") else ""
        stats += [f"nullif({how}({c}){scale}, 0) AS {c}_{s}" if scale else f"{how}({c}) AS {c}_{s}" for s, how in (("sum", "sum"), ("proc_min", "min"), ("proc_max", "max"), ("proc_mean", "avg"), ("proc_std", "stddev_samp"))]
    return f"{name}0 AS (SELECT {keys}, {inner} FROM {source} GROUP BY {keys}), {name} AS (SELECT {by}, {', '.join(stats)} FROM {name}0 GROUP BY {by})"


def upto_view(by: str, preset: Preset = POSIX, derived: bool = True) -> str:
    which = metrics(preset, derived)
    return f"WITH {traces()}, {hlm([by])}, {main([by], which)}, {view(by, which)}"


def _stats(by: str, prefixes: list[str], bases: tuple[str, ...] = ("time", "count")) -> str:
    cols = [c for p in prefixes for b in bases if (p, b) != ("posix_metadata", "size") for c in [f"{p}_{b}_sum", *[f"{p}_{b}_proc_{s}" for s in ("min", "max", "mean", "std")]]]
    return f"SELECT {by}, " + ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in cols) + " FROM v"


_THREE = ["posix", "posix_read", "posix_metadata"]
_DIR = "regexp_replace(regexp_extract({0}, '^(.*/)[^/]*$', 1), '^(.*[^/])/+$', '\\1')"
_PATTERN = "regexp_replace({0}, '[0-9]+', '[0-9]', 'g')"


def _logical(parent: str, name: str, expression: str) -> str:
    which = metrics(POSIX, False)
    return f"""WITH {traces()}, {hlm([parent])}, {main([parent], which)}, d AS (SELECT *, {expression} AS {name} FROM m), d1 AS (SELECT * FROM d WHERE {name} IS NOT NULL),
      {view(name, which, "d1")} {_stats(name, ["posix"])}"""


def _share(c: str) -> str:
    return f"CASE WHEN sum({c}) OVER () > 0 THEN {c} / sum({c}) OVER () END"


def _shares() -> str:
    cols = []
    for p in _THREE:
        cols += [f"{_share(f'{p}_count_sum')} AS {p}_count_frac_total", f"{_share(f'{p}_time_proc_max')} AS {p}_time_proc_frac_total", f"{_share(f'{p}_time_sum')} AS {p}_time_call_frac_total"]
    cols.append(f"{_share('posix_size_sum')} AS posix_size_call_frac_total")
    slopes = ", ".join(f"{p}_time_proc_frac_total / nullif({p}_count_frac_total, 0) AS {p}_ops_slope" for p in _THREE)
    return f"{upto_view('time_range')}, w AS (SELECT time_range, {', '.join(cols)} FROM v), s AS (SELECT *, {slopes} FROM w)"


def _rank(c: str) -> str:
    return f"CASE WHEN {c} IS NOT NULL THEN (rank() OVER (PARTITION BY {c} IS NULL ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0) / count({c}) OVER () END"


_SEV = "CASE WHEN {0} IS NOT NULL THEN least(greatest((degrees(atan({0})) - 45) / 45, 0), 1) END"
_LABEL = "CASE WHEN {0} >= 0.85 THEN 'critical' WHEN {0} >= 0.6 THEN 'high' WHEN {0} >= 0.3 THEN 'medium' WHEN {0} > 0 THEN 'low' ELSE 'none' END"


def _rounded(cols: list[str], n: int = 6, key: str = "time_range", source: str = "v") -> str:
    return f"SELECT {key}, " + ", ".join(f"round(CAST({c} AS DOUBLE), {n}) AS {c.split(' AS ')[-1]}" if " AS " not in c else f"round(CAST({c.split(' AS ')[0]} AS DOUBLE), {n}) AS {c.split(' AS ')[1]}" for c in cols) + f" FROM {source}"


def _over(own: str, children: list[str], suffix: str) -> str:
    below = " + ".join(f"coalesce({c}_{suffix}, 0)" for c in children)
    return f"CASE WHEN {own}_{suffix} IS NOT NULL THEN greatest({own}_{suffix} - ({below}), 0) END"


def _derived_frac() -> str:
    of = lambda p, x, s: (("epoch", f"{p}_{s} / nullif(epoch_{s}, 0)"), ("parent", f"{p}_{s} / nullif({x}_{s}, 0)"), ("total", _share(f"{p}_{s}")))
    tracks = (("proc", "time_proc_max"), ("call", "time_sum"))
    return _rounded([f"{e} AS {x.name}_{m}_time_{t}_frac_{n}" for x in AI.layers for m in x.derived for t, s in tracks for n, e in of(f"{x.name}_{m}", x.name, s)])


def _overhead() -> str:
    cols = []
    for x in ("epoch", "data_loader", "reader"):
        children = CORE.children(x)
        call = _over(x, children, "time_sum")
        cols += [f"{_over(x, children, 'time_proc_max')} AS o_{x}_time_proc_max", f"{call} AS o_{x}_time_sum", f"({call}) / nullif({x}_time_sum, 0) AS o_{x}_time_call_frac_self"]
    w = f"w AS (SELECT time_range, {', '.join(cols)} FROM v)"
    out = [c for x in ("epoch", "data_loader", "reader") for c in (f"o_{x}_time_proc_max", f"o_{x}_time_sum", f"o_{x}_time_call_frac_self", f"{_share(f'o_{x}_time_sum')} AS o_{x}_time_call_frac_total")]
    return f"{upto_view('time_range', CORE, False)}, {w} {_rounded(out, source='w')}"


def _unoverlapped(select: str) -> str:
    cols = ["*"]
    for x in ("posix", "reader", "data_loader", "reader_posix"):
        for s in ("time_proc_max", "time_sum"):
            cols.append(f"CASE WHEN {x}_{s} IS NOT NULL THEN greatest({x}_{s} - coalesce(compute_{s}, 0), 0) END AS u_{x}_{s}")
    return f"{upto_view('time_range', CORE, False)}, w AS (SELECT {', '.join(cols)} FROM v) {select}"


_U = [c for x in ("posix", "reader") for c in (f"u_{x}_time_proc_max", f"u_{x}_time_sum", f"u_{x}_time_sum / nullif({x}_time_sum, 0) AS u_{x}_time_call_frac_self", f"{_share(f'u_{x}_time_sum')} AS u_{x}_time_call_frac_total")]


def _layer_row(x: str) -> str:
    size = f"CAST(sum({x}_size_sum) AS DOUBLE)" if CORE.layer(x).sized else "CAST(NULL AS DOUBLE)"
    u = f"u_{x}_time_proc_max" if x in CORE.async_layers else "CAST(NULL AS DOUBLE)"
    time = f"sum({x}_time_proc_max)"
    un = f"sum(CASE WHEN {u} > 0 THEN {u} END)"
    return f"""SELECT '{x}' AS layer, round({time}, 4) AS time, CAST(coalesce(sum({x}_count_sum), 0) AS BIGINT) AS count, round({size}, 4) AS size, round({un}, 4) AS u_time,
      CAST(sum(CASE WHEN {u} > 0 THEN {x}_count_sum END) AS BIGINT) AS u_count, round(CASE WHEN {un} IS NOT NULL THEN greatest(1 - {un} / nullif({time}, 0), 0) END, 4) AS overlap FROM w"""


_OK = lambda c: f"CASE WHEN {c} >= 0 THEN {c} END"
_SIZED = "io_cat IN (1, 2)"
PROFILES = f"""c0 AS (SELECT DISTINCT reading_id, lower(trim(cat)) AS cat, lower(trim(name)) AS func_name, pid, tid, host_hash, CAST(floor(ts / 5000000) AS BIGINT) * 5000000 AS time_start,
      coalesce(dft_cnt, 1) AS n, coalesce({_OK("dur")}, 0) AS d, {_OK("dur_min")} AS dmin, {_OK("dur_max")} AS dmax, {_OK("size")} AS s, {_OK("size_min")} AS smin, {_OK("size_max")} AS smax
      FROM counter_samples WHERE ts IS NOT NULL),
    c1 AS (SELECT *, {_IO_CAT} AS io_cat FROM c0),
    p AS (SELECT cat, func_name, pid, tid, time_start, host_hash, io_cat, CAST(sum(n) AS BIGINT) AS count, CAST(sum(d) AS BIGINT) AS time,
      CAST(nullif(sum(CASE WHEN {_SIZED} AND s > 0 THEN s END), 0) AS BIGINT) AS size, min(dmin) AS time_min, max(dmax) AS time_max,
      min(CASE WHEN {_SIZED} THEN smin END) AS size_min, max(CASE WHEN {_SIZED} THEN smax END) AS size_max FROM c1 GROUP BY cat, func_name, pid, tid, time_start, host_hash, io_cat)"""
_P_HOURS = f"""pt AS (SELECT cat, func_name, io_cat, 'app#' || coalesce(host_hash, 'unknown') || coalesce('#' || pid, '') || coalesce('#' || tid, '') AS proc_name, time_start // {HOUR} AS time_range, count, time, size FROM p)"""


def _both(select: str) -> str:
    keys = ["proc_name", "time_range", "cat", "io_cat", "func_name"]
    same = " AND ".join(f"x.{k} IS NOT DISTINCT FROM y.{k}" for k in keys)
    return f"WITH {traces('0')}, {hlm(['time_range'])}, {PROFILES}, {_P_HOURS}, {hlm(['time_range'], 'pt', 'g')}, o AS (SELECT * FROM g x WHERE NOT EXISTS (SELECT 1 FROM h y WHERE {same})) {select}"


def _expanded(time: str) -> str:
    return f"""WITH {PROFILES}, k AS (SELECT *, unnest(range(5)) AS k FROM p)
      SELECT cat, (time_start + k * 1000000) // 1000000 AS time_range, CAST(sum(count // 5 + CASE WHEN k < count % 5 THEN 1 ELSE 0 END) AS BIGINT) AS count,
      CAST(sum(size // 5) AS BIGINT) AS size, round(sum({time}), 3) AS time FROM k GROUP BY ALL"""


_RAMP = "(coalesce(time_min, 0) + (coalesce(time_max, 0) - coalesce(time_min, 0)) * k / 4.0)"
_RAMPS = "((coalesce(time_min, 0) + coalesce(time_max, 0)) * 5 / 2.0)"


def system(origin: str = "0") -> str:
    cpu = lambda c: f"avg(CASE WHEN name = 'cpu' THEN {c} END)"
    mem = lambda c: f"avg(CASE WHEN name = 'memory' THEN {c} END)"
    core = "CASE WHEN starts_with(name, 'cpu-') THEN iowait_pct END"
    return f"""y0 AS (SELECT DISTINCT sample_id, name, host_hash, ts, user_pct, system_pct, iowait_pct, idle_pct, mem_available, cached, dirty FROM system_samples),
      y AS (SELECT host_hash, CAST(floor((ts - {origin}) / {HOUR}) AS BIGINT) AS time_range, {cpu("iowait_pct")} AS sys_cpu_iowait_pct, {cpu("user_pct")} AS sys_cpu_user_pct,
      {cpu("system_pct")} AS sys_cpu_system_pct, {cpu("idle_pct")} AS sys_cpu_idle_pct, max({core}) AS sys_core_iowait_pct_max, quantile_cont({core}, 0.95) AS sys_core_iowait_pct_p95,
      {mem("dirty")} AS sys_mem_dirty, {mem("cached")} AS sys_mem_cached, {mem("mem_available")} AS sys_mem_available
      FROM y0 WHERE host_hash IS NOT NULL AND ts IS NOT NULL AND (name IN ('cpu', 'memory') OR starts_with(name, 'cpu-')) GROUP BY ALL)"""


_SYS = ["sys_cpu_iowait_pct", "sys_cpu_user_pct", "sys_cpu_system_pct", "sys_cpu_idle_pct", "sys_core_iowait_pct_max", "sys_core_iowait_pct_p95", "sys_mem_dirty", "sys_mem_cached", "sys_mem_available"]


def _facts(by: str) -> str:
    """CTE f: matches of both rules with severity; the order of columns is that of the rules."""
    share, read = "coalesce(posix_metadata_time_sum, 0) / nullif(posix_time_sum, 0)", "posix_read_time_sum / nullif(posix_time_sum, 0)"
    return f"""{upto_view(by)}, f AS (
      SELECT {by} AS spot, 'metadata_heavy' AS fact_type, {share} AS sev, CAST(0.8 AS DOUBLE) AS confidence, 'fewer_opens' AS tag FROM v WHERE {share} > 0.4 AND posix_count_sum > 5
      UNION ALL SELECT {by}, 'read_heavy', {read}, CAST(1.0 AS DOUBLE), 'prefetch' FROM v WHERE {read} > 0.5)"""


def _fact_id(t0: str, t1: str, view: str, kind: str = "fact_type") -> str:
    return f"'af_' || substr(md5('analysisfact.v1:' || {kind} || ':run:{view}:None:None:' || {t0} || ':' || {t1} || ':posix:None:all'), 1, 12)"


_T0, _T1 = f"(spot * {HOUR * 1000})", f"((spot + 1) * {HOUR * 1000})"
_EPOCHS = f"""ep AS (SELECT pid, time_start AS start, time_end AS stop, row_number() OVER (PARTITION BY pid ORDER BY time_start, time_end) AS no
      FROM (SELECT DISTINCT pid, time_start, time_end FROM t WHERE {duck(AI.layer("epoch").where)}))"""

def rule_sql(text: str) -> str:
    """A rule's expression in SQL: division by 0 and null give null; max and min of one argument are that argument."""
    import ast

    ops = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">=", ast.Eq: "="}

    def sql(n: ast.expr) -> str:
        match n:
            case ast.Constant():
                return f"CAST({n.value!r} AS DOUBLE)"
            case ast.Name():
                return n.id
            case ast.BinOp(op=ast.Div()):
                return f"(CAST({sql(n.left)} AS DOUBLE) / nullif({sql(n.right)}, 0))"
            case ast.BinOp():
                return f"({sql(n.left)} {ops[type(n.op)]} {sql(n.right)})"
            case ast.BoolOp():
                return "(" + (" AND " if isinstance(n.op, ast.And) else " OR ").join(map(sql, n.values)) + ")"
            case ast.Compare():
                return f"({sql(n.left)} {ops[type(n.ops[0])]} {sql(n.comparators[0])})"
        args = [sql(a) for a in n.args]
        match n.func.id:
            case "max" | "min" if len(args) > 1:
                return f"{'greatest' if n.func.id == 'max' else 'least'}({', '.join(args)})"
            case "fillna0":
                return f"coalesce({args[0]}, 0)"
            case "abs":
                return f"abs({args[0]})"
            case "clip01":
                return f"CASE WHEN {args[0]} IS NOT NULL THEN least(greatest({args[0]}, 0), 1) END"
        return args[0]

    return sql(ast.parse(text, mode="eval").body)


def _packs(preset: Preset) -> str:
    """The facts of every rule whose metrics the view by epoch has."""
    which = metrics(preset)
    have = {f"{m.col(b)}_{s}" for m in which for b in ["time", "count", "ops", *["size", "bw", "intensity"] * m.sized] for s in ("sum", "proc_min", "proc_max", "proc_mean", "proc_std")}
    shares = {f"{x.name}_{m}_time_proc_frac_parent": f"{x.name}_{m}_time_proc_max / nullif({x.name}_time_proc_max, 0)" for x in preset.layers for m in x.derived}
    rows = []
    for name, rules in PACKS.items():
        for q in rules:
            if q["view_types"] != ["epoch"] or not set(q["required_metrics"]) <= have | set(shares):
                continue
            source = "v2"
            for c, text in q["derived_metrics"].items():
                source = f"(SELECT *, {rule_sql(text)} AS {c} FROM {source})"
            score = f"round(coalesce({rule_sql('clip01(' + q['severity_score'] + ')')}, 0), 6)"
            rows.append(f"SELECT '{name}' AS pack, '{q['id']}' AS rule_id, '{q['fact_type']}' AS fact_type, epoch, {score} AS score FROM {source} WHERE {rule_sql(q['when'])}")
    return f"{upto_view('epoch', preset)}, v2 AS (SELECT *, {', '.join(f'{e} AS {c}' for c, e in shares.items())} FROM v), f AS ({' UNION ALL '.join(rows)}) SELECT *, {_LABEL.format('score')} AS label FROM f"


def _layers(by: str, preset: Preset) -> str:
    cols = [f"round(CAST({x}_{c} AS DOUBLE), 6) AS {x}_{c}" for x in preset.names for c in ("time_sum", "time_proc_max", "time_proc_mean", "count_sum")]
    return f"{upto_view(by, preset, False)} SELECT {by}, {', '.join(cols)} FROM v"


_HAS = lambda cats: f"bool_or(cat IN ({_list(cats)}))"
_LINES = """l AS (SELECT rtrim(trim(replace(unnest(string_split(payload, chr(10))), chr(13), ' ')), ', ') AS j FROM trace_files),
      j AS (SELECT j FROM l WHERE j LIKE '{%}' AND json_valid(j))"""

SQL = {
    "scan_events": f"WITH {traces()} SELECT cat, func_name, pid, tid, time_start, time, size, file_name, proc_name, io_cat, time_range, time_end FROM t",
    "scan_payloads": f"WITH {_LINES} SELECT j->>'ph' AS ph, lower(j->>'cat') AS cat, count(*) AS n, CAST(sum(CAST(j->'args'->>'ret' AS BIGINT)) AS BIGINT) AS ret, count(j->'args'->>'hhash') AS hosts FROM j GROUP BY ALL",
    "raw_page": "SELECT DISTINCT event_id, lower(trim(cat)) AS cat, lower(trim(name)) AS name, ts, CASE WHEN dur >= 0 THEN dur END AS dur FROM trace_events WHERE ts IS NOT NULL ORDER BY ts, event_id LIMIT 100 OFFSET 200",
    "io_category": f"WITH {traces()}, n AS (SELECT func_name, count(*) AS n FROM raw0 GROUP BY ALL) SELECT func_name AS name, n, {_IO_CAT} AS io_cat FROM n",
    "proc_names": f"WITH {traces()} SELECT proc_name, count(*) AS n FROM t GROUP BY ALL",
    "posix_category": f"WITH {traces()} SELECT cat, count(*) AS n FROM t GROUP BY ALL",
    "size_bins": f"WITH {traces()} SELECT func_name, {', '.join(f'count(CASE WHEN {c} THEN 1 END) AS size_bin_{n}' for n, c in _BINS.items())} FROM t GROUP BY ALL",
    "time_buckets": f"WITH {traces()} SELECT time_range, count(*) AS count, CAST(sum(time) AS BIGINT) AS time, min(time_start) AS first_ts FROM t GROUP BY ALL",
    "ignore_filter": f"WITH {traces()} SELECT func_name AS name, count(CASE WHEN {_KEEP} THEN 1 END) AS kept, count(CASE WHEN NOT ({_KEEP}) THEN 1 END) AS dropped FROM raw0 GROUP BY ALL",
    "layer_filter": f"WITH {traces()} SELECT {', '.join(f'count(CASE WHEN {duck(x.where)} THEN 1 END) AS {x.name}' for x in AI.layers)} FROM t",
    "logical_keys": f"WITH {traces()} SELECT {_DIR.format('file_name')} AS file_dir, {_PATTERN.format('file_name')} AS file_pattern, count(*) AS n FROM t WHERE file_name IS NOT NULL GROUP BY ALL",
    "hash_lookup_join": """WITH e AS (SELECT DISTINCT event_id, file_hash, host_hash FROM trace_events),
      f AS (SELECT arg_value AS h, min(arg_name) AS v FROM trace_metadata WHERE name = 'FH' GROUP BY 1), o AS (SELECT arg_value AS h, min(arg_name) AS v FROM trace_metadata WHERE name = 'HH' GROUP BY 1)
      SELECT o.v AS host_name, count(*) AS n, count(f.v) AS named, count(DISTINCT f.v) AS files FROM e LEFT JOIN f ON e.file_hash = f.h LEFT JOIN o ON e.host_hash = o.h GROUP BY 1""",
    "semi_drilldown": f"""WITH {traces()}, {hlm(["file_name", "time_range"])}, {main(["file_name", "time_range"], metrics(POSIX, False))},
      b AS (SELECT time_range FROM m GROUP BY 1 HAVING sum(posix_count) >= 100)
      SELECT file_name, CAST(sum(posix_count) AS BIGINT) AS count, CAST(sum(posix_time) AS BIGINT) AS time FROM m WHERE time_range IN (SELECT time_range FROM b) GROUP BY 1""",
    "epoch_interval_join": f"""WITH {traces()}, {_EPOCHS}, a AS (SELECT t.event_id, t.pid, t.time, max(no) AS epoch FROM t LEFT JOIN ep ON t.pid = ep.pid AND t.time_start >= ep.start AND t.time_start < ep.stop GROUP BY ALL)
      SELECT pid, epoch, count(*) AS n, CAST(sum(time) AS BIGINT) AS time FROM a GROUP BY ALL""",
    "asof_steps": f"""WITH {traces()}, s AS (SELECT pid, time_start, row_number() OVER (PARTITION BY pid ORDER BY time_start) AS step FROM (SELECT DISTINCT pid, time_start FROM t WHERE cat = 'data_loader' AND func_name = 'loop.iter'))
      SELECT t.pid, s.step, count(*) AS n, min(t.time_start) AS first_ts FROM t ASOF LEFT JOIN s ON t.pid = s.pid AND t.time_start >= s.time_start GROUP BY ALL""",
    "reconcile_anti_join": _both("SELECT cat, func_name, CAST(sum(count) AS BIGINT) AS count, CAST(sum(time) AS BIGINT) AS time, CAST(sum(size) AS BIGINT) AS size, count(*) AS n FROM (SELECT * FROM h UNION ALL BY NAME SELECT * FROM o) GROUP BY 1, 2"),
    "union_distinct_keys": _both("SELECT cat, func_name, count(*) AS n FROM (SELECT time_range, proc_name, cat, io_cat, func_name FROM h UNION SELECT time_range, proc_name, cat, io_cat, func_name FROM g) GROUP BY 1, 2"),
    "flat_outer_join": f"{upto_view('time_range', AI.only('compute', 'reader', 'checkpoint', 'posix'), False)} SELECT time_range, {', '.join(f'CAST({x}_count_sum AS BIGINT) AS {x}_count_sum, round({x}_time_sum, 6) AS {x}_time_sum' for x in ('compute', 'reader', 'checkpoint', 'posix'))} FROM v",
    "system_left_join": f"""{upto_view("time_range", POSIX, False)}, {system(ORIGIN)}, z AS (SELECT time_range, {", ".join(f"{'max' if c.endswith('_max') else 'avg'}({c}) AS {c}" for c in _SYS)} FROM y GROUP BY 1)
      SELECT v.time_range, CAST(posix_count_sum AS BIGINT) AS posix_count_sum, {", ".join(f"round({c}, 4) AS {c}" for c in _SYS)} FROM v LEFT JOIN z ON v.time_range = z.time_range""",
    "hlm": f"WITH {traces()}, {hlm(['time_range'])} SELECT * EXCLUDE (size_sq, time_sq), CAST(time_sq AS BIGINT) AS time_sq FROM h",
    "main_view": f"""WITH {traces()}, {hlm(["time_range"])}, {main(["time_range"], metrics(POSIX))} SELECT time_range, proc_name, posix_time, posix_count, posix_size, posix_read_size, posix_write_size, posix_metadata_time,
      posix_open_count, posix_close_count, posix_stat_count, posix_sync_time, round(posix_bw, 2) AS posix_bw, round(posix_ops, 4) AS posix_ops, round(posix_intensity, 9) AS posix_intensity FROM m""",
    "derived_metrics": f"WITH {traces()}, {hlm(['time_range'])}, {main(['time_range'], metrics(AI.only('data_loader', 'reader', 'posix')))} SELECT {', '.join(f'CAST(sum({x.col(b)}) AS BIGINT) AS {x.col(b)}' for x in metrics(AI.only('data_loader', 'reader', 'posix')) for b in ('count', 'time'))} FROM m",
    "view_time_range": f"{upto_view('time_range')} {_stats('time_range', _THREE)}",
    "view_posix_prefixes": f"{upto_view('time_range')} {_rounded([f'{m.col(b)}_{x}' for m in metrics(POSIX) for b in ('time', 'count', *['size'] * m.sized) for x in ('sum', 'proc_min', 'proc_max', 'proc_mean', 'proc_std')])}",
    "view_proc_name": f"{upto_view('proc_name')} {_stats('proc_name', _THREE)}",
    "view_file_name": f"{upto_view('file_name')} {_stats('file_name', _THREE, ('time', 'count', 'size'))}",
    "view_ratios": f"{upto_view('time_range')} SELECT time_range, round(posix_read_bw_sum, 0) AS posix_read_bw_sum, round(posix_ops_sum, 2) AS posix_ops_sum, round(posix_ops_proc_max, 4) AS posix_ops_proc_max, round(posix_read_intensity_proc_mean, 9) AS posix_read_intensity_proc_mean FROM v",
    "logical_file_dir": _logical("file_name", "file_dir", _DIR.format("file_name")),
    "logical_file_pattern": _logical("file_name", "file_pattern", _PATTERN.format("file_name")),
    "logical_host": _logical("proc_name", "host_name", "string_split(proc_name, '#')[2]"),
    "nunique": f"WITH {traces()} SELECT time_range, " + ", ".join(f"count(DISTINCT CASE WHEN {duck(AI.layer(x).where)} THEN {w} END) AS {x}_{w}_nunique" for w in ("file_name", "proc_name") for x in ("posix", "reader_posix", "compute")) + " FROM t GROUP BY 1",
    "quantile_stats": f"""WITH {traces()}, x AS (SELECT func_name, CAST(time AS DOUBLE) AS time FROM t WHERE time != 0), b AS (SELECT func_name, quantile_cont(time, 0.05) AS lo, quantile_cont(time, 0.95) AS hi FROM x GROUP BY 1)
      SELECT func_name, round(avg(time), 4) AS mean, round(stddev_pop(time), 2) AS std, count(*) AS n FROM x JOIN b USING (func_name) WHERE time BETWEEN lo AND hi GROUP BY 1""",
    "quantile_pairs": f"""WITH {traces()}, x AS (SELECT func_name, CAST(time AS DOUBLE) AS time FROM t WHERE time != 0), q AS (SELECT unnest([1, 5, 10, 25]) AS low, unnest([99, 95, 90, 75]) AS high),
      b AS (SELECT func_name, unnest([1, 5, 10, 25]) AS low, unnest(quantile_cont(time, [0.01, 0.05, 0.1, 0.25])) AS lo, unnest(quantile_cont(time, [0.99, 0.95, 0.9, 0.75])) AS hi FROM x GROUP BY func_name)
      SELECT func_name, low, high, round(avg(time), 4) AS mean, round(stddev_pop(time), 2) AS std, count(*) AS n FROM x JOIN b USING (func_name) JOIN q USING (low) WHERE time BETWEEN lo AND hi GROUP BY 1, 2, 3""",
    "interval_union": f"""WITH {traces()}, x AS (SELECT cat, time_start AS a, time_end AS b, max(time_end) OVER (PARTITION BY cat ORDER BY time_start, time_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM t WHERE time > 0)
      SELECT cat, CAST(sum(greatest(b - greatest(a, coalesce(reach, a)), 0)) AS BIGINT) AS busy FROM x GROUP BY 1""",
    "coalesce_profiles": f"WITH {PROFILES} SELECT cat, func_name, pid, tid, time_start, host_hash, count, time, size, time_min, time_max, size_min, size_max FROM p",
    "expand_profiles_uniform": _expanded("time / 5.0"),
    "expand_profiles_weighted": _expanded(f"CASE WHEN {_RAMPS} > 0 THEN time * {_RAMP} / {_RAMPS} ELSE time / 5.0 END"),
    "system_metrics": f"WITH {system()} SELECT host_hash, time_range, {', '.join(f'round({c}, 4) AS {c}' for c in _SYS)} FROM y",
    "slice_durations": f"""WITH {traces()}, n AS (SELECT *, greatest(CAST(ceil(coalesce(time, 0) / 1000.0) AS BIGINT), 1) AS pieces FROM t), k AS (SELECT *, unnest(range(pieces)) AS k FROM n)
      SELECT cat, count(*) AS n, CAST(sum(CASE WHEN time IS NULL THEN 1000 ELSE least(time - k * 1000, 1000) END) AS BIGINT) AS time, round(sum(1.0 / pieces), 3) AS count, max(time_start + k * 1000) AS last_ts FROM k GROUP BY 1""",
    "raw_stats": f"""WITH {traces()}, {PROFILES} SELECT round((max(time_end) - min(time_start)) / 1000000.0, 6) AS job_time, count(*) AS trace_event_count, count(DISTINCT coalesce(file_hash, file_name)) AS unique_file_count,
      count(DISTINCT host_hash) AS unique_host_count, count(DISTINCT pid) AS unique_process_count, CAST((SELECT coalesce(sum(count), 0) FROM p) AS BIGINT) AS profile_event_count,
      CAST(count(*) + (SELECT coalesce(sum(count), 0) FROM p) AS BIGINT) AS total_event_count FROM t""",
    "layer_summary": _unoverlapped(" UNION ALL ".join(map(_layer_row, _CORE))),
    "call_stats": f"""WITH {traces()}, {hlm(["time_range"])}, {main(["time_range"], metrics(POSIX, False), True)},
      x AS (SELECT time_range, sum(posix_count) AS n, sum(posix_time) AS s, sum(posix_time_sq) AS q, min(posix_time_call_min) AS lo, max(posix_time_call_max) AS hi, sum(posix_size) AS z FROM m GROUP BY 1)
      SELECT time_range, round(lo / 1000000.0, 6) AS posix_time_call_min, round(hi / 1000000.0, 6) AS posix_time_call_max, round(s / n / 1000000.0, 6) AS posix_time_call_mean,
      round(sqrt(greatest(CAST(q AS DOUBLE) / n - (s / n) * (s / n), 0)) / 1000000.0, 6) AS posix_time_call_std, round(round(z / n, 3), 6) AS posix_size_call_mean FROM x""",
    "frac_total": f"{_shares()} {_rounded([*[f'{p}_{x}' for p in _THREE for x in ('count_frac_total', 'time_proc_frac_total', 'time_call_frac_total')], 'posix_size_call_frac_total'], 9, source='w')}",
    "ops_slope_percentile": f"{_shares()} {_rounded(['posix_ops_slope', f'{_rank("posix_ops_slope")} AS posix_ops_percentile', 'posix_read_ops_slope', f'{_rank("posix_read_ops_slope")} AS posix_read_ops_percentile'], source='s')}",
    "derived_frac": f"{upto_view('time_range', AI)} {_derived_frac()}",
    "boundary_parent_frac": f"{upto_view('time_range', CORE, False)} " + _rounded(
        [f"{x}_{s} / nullif(epoch_{s}, 0) AS {x}_time_{t}_frac_epoch" for x in ("compute", "reader", "posix") for t, s in (("proc", "time_proc_max"), ("call", "time_sum"))]
        + [f"CASE WHEN sum({CORE.layer(x).parent}_{s}) OVER () > 0 THEN {x}_{s} / nullif({CORE.layer(x).parent}_{s}, 0) END AS {x}_time_{t}_frac_parent" for x in ("compute", "checkpoint", "reader", "reader_posix") for t, s in (("proc", "time_proc_max"), ("call", "time_sum"))]
    ),
    "overhead": _overhead(),
    "unoverlapped": _unoverlapped(_rounded(_U, source="w")),
    "slope_severity": f"{_shares()}, x AS (SELECT time_range, round({_SEV.format('posix_ops_slope')}, 6) AS severity FROM s) SELECT time_range, severity, {_LABEL.format('severity')} AS label FROM x",
    "additional_metrics": f"""{upto_view("time_range")} SELECT time_range, round(CASE WHEN coalesce(posix_time_sum, 0) != 0 THEN posix_read_time_sum / posix_time_sum END, 4) AS read_share,
      round(CASE WHEN coalesce(posix_sync_time_sum, 0) != 0 THEN posix_sync_count_sum / greatest(posix_sync_time_sum, 1e-9) END, 4) AS guarded,
      round(CASE WHEN coalesce(posix_time_sum, 0) != 0 THEN CASE WHEN posix_count_sum > 10 THEN least(greatest(coalesce(posix_metadata_time_sum, 0) / posix_time_sum, 0), 1) ELSE 0 END END, 4) AS meta_over FROM v""",
    "topk_entities": f"""{upto_view("file_name", POSIX, False)}, x AS (SELECT {_DIR.format("file_name")} AS file_dir, file_name, CAST(posix_count_sum AS BIGINT) AS count FROM v),
      y AS (SELECT *, row_number() OVER (PARTITION BY file_dir ORDER BY count DESC, file_name) AS rank FROM x) SELECT * FROM y WHERE rank <= 3""",
    "rule_facts_detail": f"{_facts('time_range')} SELECT {_fact_id(_T0, _T1, 'time_range')} AS fact_id, fact_type, CAST(NULL AS VARCHAR) AS entity, spot AS time_bucket, {_T0} AS t0_ns, {_T1} AS t1_ns, round(sev, 6) AS score, {_LABEL.format('sev')} AS label, confidence, tag FROM f",
    "rule_facts_aggregate": f"""{_facts("proc_name")}, k AS (SELECT *, row_number() OVER (PARTITION BY fact_type ORDER BY sev DESC, spot) AS rn FROM f)
      SELECT {_fact_id("'None'", "'None'", "proc_name")} AS fact_id, fact_type, count(*) AS affected, (SELECT count(*) FROM v) AS whole, round(max(sev), 6) AS score, {_LABEL.format("max(sev)")} AS label,
      string_agg(CASE WHEN rn <= 5 THEN spot END, '|' ORDER BY rn) AS worst FROM k GROUP BY fact_type""",
    "metric_facts": f"""{_shares()}, x AS ({" UNION ALL ".join(f"SELECT time_range AS spot, '{n}' AS fact_type, {_SEV.format(f'{p}_ops_slope')} AS sev FROM s" for p, n in (("posix", "posix_ops_slope"), ("posix_read", "read_slope"), ("posix_metadata", "metadata_slope")))})
      SELECT {_fact_id("'None'", "'None'", "time_range")} AS fact_id, fact_type, CAST(NULL AS VARCHAR) AS entity, spot AS time_bucket, CAST(NULL AS BIGINT) AS t0_ns, CAST(NULL AS BIGINT) AS t1_ns, round(sev, 6) AS score, {_LABEL.format("sev")} AS label, CAST(1.0 AS DOUBLE) AS confidence, CAST(NULL AS VARCHAR) AS tag FROM x WHERE sev >= 0.3""",
    "fact_ids": f"{_facts('time_range')} SELECT DISTINCT {_fact_id(_T0, _T1, 'time_range')} AS fact_id FROM f",
    "facts_summary": f"{_facts('time_range')} SELECT fact_type, 'time_range' AS view_type, count(*) AS n, round(max(sev), 6) AS peak, {_LABEL.format('max(sev)')} AS label, min(tag) AS tags FROM f GROUP BY fact_type",
    "pack_facts": _packs(AI.only("epoch", "compute", "fetch_data", "comm", "reader", "posix", "reader_posix")),
    "view_ai_time_range": _layers("time_range", AI),
    "view_ai_proc_name": _layers("proc_name", AI),
    "layer_filter_dlio": f"WITH {traces()} SELECT {', '.join(f'count(CASE WHEN {duck(x.where)} THEN 1 END) AS {x.name}' for x in DLIO.layers)} FROM t",
    "preset_detected": f"""WITH {traces()} SELECT CASE WHEN {_HAS(["ai_root", "pipeline"])} THEN 'ai' WHEN {_HAS(["reader", "data_loader", "checkpoint", "ai_framework", "dlio_benchmark"])} THEN 'dlio'
      WHEN {_HAS(["posix", "stdio"])} THEN 'posix' ELSE 'auto' END AS preset FROM t""",
    "logical_proc_id": _logical("proc_name", "proc_id", "string_split(proc_name, '#')[3]"),
    "logical_thread_id": _logical("proc_name", "thread_id", "string_split(proc_name, '#')[4]"),
    "auto_layers": f"WITH {traces()} SELECT trim(regexp_replace(cat, '[^0-9a-z]+', '_', 'g'), '_') AS layer, count(*) AS n FROM t WHERE cat IS NOT NULL AND cat != '' GROUP BY ALL",
    "auto_layers_root": f"""WITH {traces()} SELECT trim(regexp_replace(cat, '[^0-9a-z]+', '_', 'g'), '_') AS layer, count(*) AS n FROM t WHERE cat IS NOT NULL AND cat != '' GROUP BY ALL
      UNION ALL SELECT 'app', count(*) FROM t""",
    "stream_tumbling": f"SELECT ts // {HOUR} * {HOUR} AS window_start, lower(trim(cat)) AS cat, count(*) AS count, CAST(sum(dur) AS BIGINT) AS time FROM trace_events WHERE ph = 'X' AND ts IS NOT NULL GROUP BY ALL",
}
SQL = {k: even(v) for k, v in SQL.items()}
