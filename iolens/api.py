"""From a request to views, facts and outputs."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field
from functools import cached_property, reduce
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from iolens import facts as K
from iolens import schema as S
from iolens import summary as U
from iolens.functions import expressions, metrics
from iolens.operators import normalize as N
from iolens.operators import profiles as P
from iolens.operators import system as Y
from iolens.operators import views as V
from iolens.presets import Preset, categories, detect, discovered
from iolens.runtime import written
from iolens.sources.trace import RawTraces, TraceFrames, frames, read_raw, trace_statuses


@dataclass
class Request:
    trace_path: str = ""
    view_types: list[str] = field(default_factory=lambda: ["time_range"])
    preset: str | None = None
    time_granularity: float = 1.0
    profile_time_granularity: float = 5.0
    profile_distribution: str = "uniform"
    time_sliced: bool = False
    assign_epochs: bool = False
    trace_groups: list[str] | None = None
    extra_columns: str = ""
    derived: bool = True
    zero_fill: bool = False
    logical_view_types: bool = False
    facts: str | None = None  # rule, metric or None
    rule_file: str = "io"
    emit_mode: str = "aggregate"
    strict_time_semantics: bool = True
    additional_metrics: dict[str, str] = field(default_factory=dict)
    checkpoint_dir: str | None = None
    run_id: str | None = None

    @property
    def width(self) -> int:
        return round(self.time_granularity * S.TICKS)

    def key(self, state: str = "") -> str:
        """A name for checkpoints that differs whenever a parameter or the state of the input does."""
        return hashlib.md5(json.dumps([asdict(self), state], sort_keys=True, default=str).encode()).hexdigest()


class TraceSource(Protocol):
    """Where an analysis gets its events from."""

    def read(self, spark: SparkSession, request: Request) -> tuple[TraceFrames, DataFrame | None]:
        """Normalized frames, and the raw records if there are any."""

    def state(self, spark: SparkSession, request: Request) -> str:
        """A text that differs whenever the input does; names checkpoints."""


class TraceFiles:
    """The request's trace files."""

    def read(self, spark: SparkSession, request: Request) -> tuple[TraceFrames, DataFrame | None]:
        raw = read_raw(spark, sorted(self._files(spark, request)), request.extra_columns)
        return frames(raw, request.width, round(request.profile_time_granularity * S.TICKS)), raw

    def state(self, spark: SparkSession, request: Request) -> str:
        return json.dumps(self._files(spark, request), sort_keys=True)

    def _files(self, spark: SparkSession, request: Request) -> dict[str, tuple[int, int]]:
        return trace_statuses(spark, request.trace_path, request.trace_groups)


class AnalysisResult:
    """Lazy relations of one analysis; every accessor gives a DataFrame."""

    def __init__(self, request: Request, preset: Preset, data: TraceFrames, raw: DataFrame | None = None, state: str | None = None):
        self.request, self.preset, self.data, self._raw, self._state = request, preset, data, raw, state
        self.view_types = list(request.view_types)
        self._flat: dict[str, DataFrame] = {}

    @property
    def traces(self) -> RawTraces:
        return RawTraces(self._raw.where("ph = 'X'") if self._raw is not None else self.data.traces)

    @property
    def aggregated_traces(self) -> DataFrame:
        return self.data.traces

    @property
    def profiles(self) -> DataFrame | None:
        return self.data.profiles

    @property
    def system_metrics(self) -> DataFrame | None:
        return self.data.system

    @cached_property
    def layers(self) -> list[str]:
        return self.preset.names

    @cached_property
    def _hlm(self) -> DataFrame:
        detail = V.hlm(self.data.traces, self.view_types)
        if self.data.profiles is not None:
            own = self.data.profiles.withColumns({"time": F.col("time").cast("bigint")})
            detail = P.reconciled(detail, V.hlm(own, self.view_types), V.hlm_keys(self.view_types))
        return self._kept(detail, "hlm")

    def get_hlm(self) -> DataFrame:
        return self._hlm

    def get_main_view(self, *layers: str) -> DataFrame:
        p = self.preset.only(*layers) if layers else self.preset
        return V.main_view(self._hlm, self.view_types, V.metrics(p, self.request.derived))

    def get_layer_view(self, layer: str, by: str) -> DataFrame:
        p = self.preset.only(layer)
        which = V.metrics(p, self.request.derived)
        return V.view(self.get_main_view(layer), by, which, zero_fill=self.request.zero_fill)

    def get_flat_view(self, by: str) -> DataFrame:
        """The wide view with shares, relations between layers, additional and system metrics; columns in order of name."""
        if by not in self._flat:
            which = V.metrics(self.preset, self.request.derived)
            main = V.main_view(self._hlm, self.view_types, which, bins=True, calls=True)
            view = V.view(main, by, which, bins=True, calls=True, zero_fill=self.request.zero_fill)
            for what in S.VIEW_TYPES:
                if what != by and what in self.data.traces.columns and what != "time_range":
                    named = tuple(x for x in self.preset.layers if what != "file_name" or "posix" in x.name)
                    if named:
                        view = view.join(V.unique_counts(self.data.traces, by, named, what), by, "left")
            view = self._kept(view, f"view_{by}")
            view = metrics.shares(view, [m.prefix for m in which], by, [m.prefix for m in which if m.sized])
            view = metrics.across_layers(view, self.preset, by, self.request.derived)
            view = expressions.additional_metrics(view, self.request.additional_metrics, {"time_interval": str(self.request.time_granularity), "time_metric": "time_sum" if by == "proc_name" else "time_proc_max"})
            if by == "time_range" and self.data.system is not None:
                view = Y.onto_view(view, self.data.system)
            self._flat[by] = view.select(by, *sorted(c for c in view.columns if c != by))
        return self._flat[by]

    def get_logical_view(self, parent: str, name: str) -> DataFrame:
        which = V.metrics(self.preset, self.request.derived)
        return V.logical_view(self.get_main_view(), parent, name, which)

    @cached_property
    def _stats(self) -> DataFrame:
        return self._kept(U.raw_stats(self.data.traces, self.data.profiles), "stats")

    def raw_stats(self) -> DataFrame:
        return self._stats

    def additional_metrics(self, by: str) -> DataFrame:
        """Number, minimum, mean and maximum of the request's additional metrics, in the unit their names tell."""
        view = self.get_flat_view(by)
        return U.metric_summary(view, [m for m in self.request.additional_metrics if m in view.columns])

    def layer_summary(self, by: str) -> DataFrame:
        return U.layer_summary(self.get_flat_view(by), by, self.preset)

    def metric_boundaries(self, by: str) -> DataFrame:
        """The boundary layer's total time in a view."""
        return self.get_flat_view(by).agg(F.sum(f"{self.preset.boundary}_time_sum").alias(self.preset.boundary))

    def get_analysis_facts(self, by: str) -> DataFrame | None:
        r, view = self.request, self.get_flat_view(by)
        if r.facts == "metric":
            return K.slope_facts(view, [by], self.layers, r.run_id, r.emit_mode)
        return K.rule_facts(view, [by], K.load_rules(r.rule_file, r.strict_time_semantics), r.run_id, r.emit_mode, r.width)

    def iter_analysis_facts(self):
        for by in self.view_types:
            found = self.get_analysis_facts(by)
            yield from () if found is None else found.toLocalIterator()

    def all_facts(self) -> DataFrame | None:
        """The facts of every view; None where no rule applies."""
        parts = [f for f in map(self.get_analysis_facts, self.view_types) if f is not None]
        return reduce(DataFrame.unionByName, parts) if parts else None

    def fact_context(self) -> dict:
        r, n = self.request, self.raw_stats().first()["total_event_count"]
        return {"run_id": r.run_id, "layers": self.layers, "view_types": self.view_types, "time_granularity": r.time_granularity, "time_resolution": float(S.TICKS), "total_event_count": n}

    def to_fact_envelope(self) -> dict:
        """The envelope as a dict; for very many facts write it with sinks.to_files, which holds one at a time."""
        return json.loads("".join(K.envelope_text(self.all_facts(), self.fact_context())))

    def _kept(self, df: DataFrame, name: str) -> DataFrame:
        """Written once: as a checkpoint where the request names a folder (_SUCCESS marks a whole one), else to the shared folder."""
        if not self.request.checkpoint_dir:
            return written(df, name)
        path = f"{self.request.checkpoint_dir}/{name}-{self.request.key(f'{self._state} {self.preset}')}"
        spark = df.sparkSession
        jpath = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
            df.write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)


def analyze_frames(data: TraceFrames, request: Request, raw: DataFrame | None = None, state: str | None = None) -> AnalysisResult:
    """The analysis of normalized frames, with the request's slices, epochs, profile buckets and preset.

    Checkpoints need `state`, which tells these frames from any others.
    """
    if request.checkpoint_dir and state is None:
        raise ValueError("checkpoints of bare frames need a state that names their content")
    cats = categories(data.traces, _tracer(raw))
    preset = detect(cats, request.preset)
    if preset.discover:
        preset = discovered(cats) if cats else preset
    t = data.traces
    if request.assign_epochs:
        if "epoch" not in preset.names:
            raise ValueError(f"preset {preset.name} has no epoch layer")
        t = N.assign_epochs(t, N.epochs(t, F.expr(preset.layer("epoch").where)))
    if request.time_sliced:
        t = N.sliced(t, request.width)
    profiles = data.profiles
    if profiles is not None:
        bucket = round(request.profile_time_granularity * S.TICKS)
        profiles = P.expanded(profiles, request.width, request.profile_distribution, bucket)
        profiles = profiles.withColumn("time_range", N.bucket(F.col("time_start"), data.origin, request.width))
    return AnalysisResult(request, preset, TraceFrames(t, profiles, data.system, data.origin, data.width), raw, state)


def _tracer(raw: DataFrame | None) -> set[str]:
    """The tracer's own category: that of its metadata records."""
    if raw is None:
        return set()
    return {r["c"] for r in raw.where("ph = 'M' and cat is not null").select(F.lower("cat").alias("c")).distinct().collect()}


def analyze(spark: SparkSession, request: Request, source: TraceSource | None = None) -> AnalysisResult:
    """Analyzes what the source reads, by default the request's trace files."""
    source = source or TraceFiles()
    data, raw = source.read(spark, request)
    return analyze_frames(data, request, raw, source.state(spark, request) if request.checkpoint_dir else None)
