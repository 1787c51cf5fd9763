"""Named packs of rules, composed of families.

A family is a function of the layer it looks at; a pack is a list of families.
"""

from __future__ import annotations

MIB = 1 << 20
# What facts advise or rule out.
READERS, PREFETCH, CONTENTION, SMALL, META, BALANCE, RANKS = ["reader_parallelism"], ["dataloader_prefetch"], ["reader_contention"], ["small_io_reduction"], ["metadata_reduction"], ["read_write_rebalancing"], ["rank_balance", "shard_repartition"]


def ramp(x: str, low: float, width: float) -> str:
    """0 up to `low`, 1 from `low + width`."""
    return f"clip01(({x} - {low}) / {width})"


def ratio(a: str, b: str) -> str:
    return f"fillna0({a}) / max({b}, 1e-9)"


def _rule(name: str, priority: int, when: str, severity: str, tags: list[str], *, view: str = "epoch", needs: tuple[str, ...] = (), derived: dict[str, str] | None = None, no: list[str] | None = None, layer: str | None = None, kind: str | None = None, emit: str = "detail") -> dict:
    return {
        "id": name, "fact_type": kind or name.rpartition(".")[2], "priority": priority, "view_types": [view], "scope_layer": layer, "required_metrics": list(needs), "derived_metrics": derived or {},
        "when": when, "severity_score": severity, "confidence": 0.8, "emit_mode": emit, "opportunity_tags": tags, "suppresses_tags": no or [], "rule_version": "1.0.0",
    }


def _loads(fetch: str) -> dict[str, str]:
    """Shares of fetching and computing in the time of both."""
    both = f"fillna0({fetch}_time_proc_max) + fillna0(compute_time_proc_max)"
    return {"fetch_frac": ratio(f"{fetch}_time_proc_max", both), "compute_frac": ratio("compute_time_proc_max", both)}


def fetching(p: str, fetch: str = "fetch_data", view: str = "epoch", priority: int = 100, severity: tuple[float, float] = (0.10, 0.25)) -> dict:
    return _rule(f"{p}.fetch_pressure", priority, "fetch_frac >= 0.20 and compute_frac < 0.85", ramp("fetch_frac", *severity), PREFETCH + READERS, view=view, needs=(f"{fetch}_time_proc_max", "compute_time_proc_max"), derived=_loads(fetch))


def opening(p: str, fetch: str = "fetch_data", view: str = "epoch", priority: int = 98, width: float = 0.50) -> dict:
    derived = _loads(fetch) | {"open_ratio": ratio("reader_open_time_proc_max", "fillna0(compute_time_proc_max)")}
    return _rule(f"{p}.open_pressure", priority, "open_ratio > 1.05 and compute_frac < 0.85", ramp("open_ratio", 1.0, width), READERS, view=view, needs=("reader_open_time_proc_max", "compute_time_proc_max", f"{fetch}_time_proc_max"), derived=derived)


def reading(p: str, fetch: str = "fetch_data") -> dict:
    derived = _loads(fetch) | {"read_ratio": ratio("reader_posix_time_proc_max", "fillna0(compute_time_proc_max)"), "opened": "fillna0(reader_open_time_proc_max)"}
    return _rule(f"{p}.read_pressure", 97, "read_ratio > 1.5 and opened == 0 and compute_frac < 0.85", ramp("read_ratio", 1.0, 2.0), READERS, needs=("reader_posix_time_proc_max", "reader_open_time_proc_max", "compute_time_proc_max", f"{fetch}_time_proc_max"), derived=derived)


def computing(p: str, fetch: str = "fetch_data") -> dict:
    return _rule(f"{p}.compute_dominance", 200, "compute_frac >= 0.90 and fetch_frac <= 0.10", ramp("compute_frac", 0.85, 0.20), ["none"], needs=("compute_time_proc_max", f"{fetch}_time_proc_max"), derived=_loads(fetch), no=READERS + PREFETCH)


def crowded(p: str) -> dict:
    return _rule(f"{p}.io_contention", 95, "compute_frac >= 0.70 and fetch_frac < 0.15 and workers > 2", ramp("compute_frac", 0.60, 0.30), CONTENTION, needs=("fetch_data_time_proc_max", "compute_time_proc_max", "data_loader_proc_name_nunique"), derived=_loads("fetch_data") | {"workers": "fillna0(data_loader_proc_name_nunique)"})


def slow_reads(p: str) -> dict:
    spread = {"latency_spread": ratio("reader_posix_read_time_call_mean", "fillna0(reader_posix_read_time_call_min)")}
    return _rule(f"{p}.read_contention", 110, "latency_spread > 10", ramp("latency_spread", 5, 40), CONTENTION, needs=("reader_posix_read_time_call_mean", "reader_posix_read_time_call_min"), derived=spread, no=READERS)


def saturated(p: str, ceiling: float = 171e6) -> dict:
    return _rule(f"{p}.bw_saturation", 112, "bw_share >= 0.80", ramp("bw_share", 0.70, 0.30), [], needs=("reader_posix_read_bw_proc_max",), derived={"bw_share": f"fillna0(reader_posix_read_bw_proc_max) / {ceiling}"}, no=READERS + PREFETCH, layer="reader_posix")


def uneven_ranks(p: str, fetch: str = "fetch_data") -> dict:
    r = {"rank_ratio": f"max({fetch}_time_proc_max) / max(min({fetch}_time_proc_max), 1e-9)"}
    return _rule(f"{p}.fetch_rank_imbalance", 120, "rank_ratio >= 1.5", ramp("rank_ratio", 1.0, 2.5), RANKS, view="proc_name", needs=(f"{fetch}_time_proc_max",), derived=r, emit="aggregate")


def talking(p: str, fetch: str = "fetch_data") -> dict:
    whole = f"fillna0(comm_time_proc_max) + fillna0({fetch}_time_proc_max) + fillna0(compute_time_proc_max)"
    return _rule(f"{p}.comm_dominance", 150, "comm_frac >= 0.30", ramp("comm_frac", 0.20, 0.40), ["comm_optimization"], needs=("comm_time_proc_max", "compute_time_proc_max"), derived={"comm_frac": ratio("comm_time_proc_max", whole)}, no=READERS + PREFETCH)


def single_layer(p: str, x: str, writes: bool = True, scope: str | None = None) -> list[dict]:
    """Small transfers, metadata and uneven reads and writes of one I/O layer."""
    out = []
    for n, op in enumerate(("read", "write")[: 1 + writes]):
        share, size = f"{x}_{op}_time_proc_frac_parent", f"{x}_{op}_size_proc_mean"
        severity = f"clip01(0.5 * ({share} - 0.50) / 0.50 + 0.5 * ({MIB} - {size}) / {MIB})"
        out.append(_rule(f"{p}.small_{op}_dominance", 89 - n, f"{share} > 0.50 and {size} < {MIB}", severity, SMALL, needs=(share, size), layer=scope))
    share = f"{x}_metadata_time_proc_frac_parent"
    out.append(_rule(f"{p}.metadata_dominance", 87, f"{share} > 0.50", ramp(share, 0.50, 0.50), META, needs=(share,), layer=scope))
    for n, (base, kind) in enumerate((("count", "operation"), ("size", "size"))):
        r, w = f"{x}_read_{base}_sum", f"{x}_write_{base}_sum"
        gap = {f"{kind}_gap": f"abs(fillna0({r}) - fillna0({w})) / max(min(fillna0({r}), fillna0({w})), 1e-9)"}
        out.append(_rule(f"{p}.{kind}_imbalance", 86 - n, f"{kind}_gap > 0.10", ramp(f"{kind}_gap", 0.10, 0.90), BALANCE, needs=(r, w), derived=gap, layer=scope))
    return out


def metadata_of_readers(p: str, heavy: int, contended: int) -> list[dict]:
    m = {"metadata_ratio": ratio("reader_posix_metadata_time_proc_max", "fillna0(reader_posix_time_proc_max)")}
    needs = ("reader_posix_metadata_time_proc_max", "reader_posix_time_proc_max")
    return [
        _rule(f"{p}.reader_metadata_heavy", heavy, "metadata_ratio > 0.40", ramp("metadata_ratio", 0.30, 0.40), ["none"], needs=needs, derived=m, no=READERS + PREFETCH, layer="reader_posix"),
        _rule(f"{p}.reader_metadata_contention", contended, "metadata_ratio > 0.65", ramp("metadata_ratio", 0.50, 0.40), CONTENTION, needs=needs, derived=m, layer="reader_posix"),
    ]


def below_bandwidth(p: str, least: float) -> dict:
    bw = "reader_posix_read_bw_proc_mean"
    return _rule(f"{p}.reader_bw_pressure", 100, f"{bw} < {least}", f"clip01(({least} - fillna0({bw})) / {least})", READERS, needs=(bw,), layer="reader_posix")


def above_bandwidth(p: str, most: float, width: float) -> dict:
    bw = "reader_posix_read_bw_proc_mean"
    return _rule(f"{p}.reader_bw_saturated", 190, f"{bw} > {most}", ramp(f"fillna0({bw})", most, width), ["none"], needs=(bw,), no=READERS + PREFETCH, layer="reader_posix")


def headroom(p: str, most: float, seconds: float) -> dict:
    data, meta, bw, t = "reader_posix_data_time_proc_frac_parent", "reader_posix_metadata_time_proc_frac_parent", "reader_posix_read_bw_proc_mean", "reader_posix_time_proc_max"
    severity = f"clip01(0.5 * ({most} - fillna0({bw})) / {most} + 0.25 * ({data} - 0.90) / 0.10 + 0.25 * ({t} - {seconds}) / {seconds})"
    return _rule(f"{p}.reader_data_headroom", 100, f"{data} > 0.90 and {meta} < 0.10 and {bw} < {most} and {t} > {seconds}", severity, READERS + PREFETCH, needs=(data, meta, bw, t), layer="reader_posix")


def outliers(p: str) -> list[dict]:
    """Hosts that stand out from the others; the spread needs column aggregates."""
    tail = _loads("fetch_data") | {"tail_spread": "max(fetch_frac) - min(fetch_frac)"}
    opens = {"open_frac": ratio("reader_open_time_proc_max", "fillna0(reader_open_time_proc_max) + fillna0(compute_time_proc_max)"), "tail_ratio": "open_frac / max(min(open_frac), 1e-9)"}
    return [
        _rule(f"{p}.fetch_outlier", 160, "tail_spread >= 0.10 and fetch_frac >= 0.10", ramp("fetch_frac", 0.10, 0.40), PREFETCH + READERS, view="host_hash", needs=("fetch_data_time_proc_max", "compute_time_proc_max"), derived=tail),
        _rule(f"{p}.reader_open_tail_outlier", 155, "tail_ratio > 1.25 and open_frac > 0.10", ramp("tail_ratio", 1.0, 1.50), READERS + META, view="host_hash", needs=("reader_open_time_proc_max", "compute_time_proc_max"), derived=opens),
    ]


def _dlio_common(p: str) -> list[dict]:
    return [fetching(p), opening(p), reading(p), computing(p), crowded(p), *single_layer(f"{p}.reader_posix", "reader_posix", scope="reader_posix"), uneven_ranks(p)]


PACKS: dict[str, list[dict]] = {
    "posix": single_layer("posix", "posix"),
    "dlio": [*_dlio_common("dlio"), slow_reads("dlio"), saturated("dlio")],
    "dlio-all": _dlio_common("dlio"),
    "dlio-app": [fetching("app"), computing("app"), crowded("app"), uneven_ranks("app")],
    "dlio-global": [fetching("dlio.global", view="host_hash", priority=140, severity=(0.20, 0.60)), opening("dlio.global", view="host_hash", priority=130, width=1.50), *outliers("dlio.global")],
    "dlio-posix-corona": [headroom("posix_corona", 600e6, 20), above_bandwidth("posix_corona", 1e9, 800e6), *metadata_of_readers("posix_corona", 200, 195), *single_layer("posix_corona.reader_posix", "reader_posix", False, "reader_posix")],
    "dlio-posix-lustre3": [below_bandwidth("posix_lustre3", 85e6), *metadata_of_readers("posix_lustre3", 200, 190), *single_layer("posix_lustre3.reader_posix", "reader_posix", scope="reader_posix")],
    "stormer": [fetching("stormer"), opening("stormer"), reading("stormer"), computing("stormer"), talking("stormer"), *single_layer("stormer.reader_posix", "reader_posix", scope="reader_posix"), uneven_ranks("stormer")],
}
