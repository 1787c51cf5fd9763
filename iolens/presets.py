"""Layer forests: named predicates over events, their parents and derived metrics.

Predicates are SQL over cat (lower case) and func_name, io_cat.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

IO = "cat rlike 'posix|stdio'"

# Derived metrics of I/O layers, and those that carry a size.
IO_DERIVED = {
    "data": "io_cat in (1, 2)",
    "read": "io_cat = 1",
    "write": "io_cat = 2",
    "metadata": "io_cat = 3",
    "close": "io_cat = 3 and func_name like '%close%' and func_name not like '%dir%'",
    "open": "io_cat = 3 and func_name like '%open%' and func_name not like '%dir%'",
    "seek": "io_cat = 3 and func_name like '%seek%'",
    "stat": "io_cat = 3 and func_name like '%stat%'",
    "other": "io_cat = 6",
    "sync": "io_cat = 7",
}
IO_SIZED = ("data", "read", "write")
# Derived metrics of loaders and readers (the dot stands for any character).
LOADER_DERIVED = {"init": "func_name rlike 'init'", "item": "func_name rlike 'item'"}
READER_DERIVED = {"close": "func_name rlike '.close'", "open": "func_name rlike '.open'", "preprocess": "func_name rlike '.preprocess'", "sample": "func_name rlike '.get_sample'"}


@dataclass(frozen=True)
class Layer:
    name: str
    where: str | None  # None: every event
    parent: str | None = None
    derived: dict[str, str] = field(default_factory=dict)
    sized: bool = False
    #: derived metrics that carry a size
    sized_derived: tuple[str, ...] = ()


@dataclass(frozen=True)
class Preset:
    name: str
    layers: tuple[Layer, ...]
    async_layers: tuple[str, ...] = ()
    #: the layer whose time others are related to
    boundary: str = ""
    discover: bool = False
    additional: dict[str, str] = field(default_factory=dict)

    def layer(self, name: str) -> Layer:
        return next(x for x in self.layers if x.name == name)

    @property
    def names(self) -> list[str]:
        return [x.name for x in self.layers]

    def children(self, name: str) -> list[str]:
        return [x.name for x in self.layers if x.parent == name]

    def only(self, *names: str) -> Preset:
        """The same forest with some of its layers."""
        return replace(self, layers=tuple(x for x in self.layers if x.name in names), async_layers=tuple(a for a in self.async_layers if a in names))


def _io(name: str, where: str = IO, parent: str | None = None) -> Layer:
    return Layer(name, where, parent, IO_DERIVED, True, IO_SIZED)


_ASYNC = ("data_loader", "data_loader_fork", "reader", "reader_posix", "posix")

POSIX = Preset("posix", (_io("posix"),), boundary="posix")
AUTO = Preset("auto", (Layer("app", None),), boundary="app", discover=True)

# The layers of the two training presets.
DLIO = Preset(
    "dlio",
    (
        Layer("app", "func_name in ('DLIOBenchmark.initialize', 'DLIOBenchmark.run')"),
        Layer("training", "func_name = 'DLIOBenchmark.run'", "app"),
        Layer("epoch", "func_name = 'DLIOBenchmark._train'", "training"),
        Layer("compute", "cat = 'ai_framework'", "epoch"),
        Layer("fetch_data", "func_name in ('<module>.iter', 'fetch-data.iter', 'loop.iter')", "epoch"),
        Layer("checkpoint", "cat = 'checkpoint'", "epoch"),
        Layer("data_loader", "cat = 'data_loader' and func_name not in ('loop.iter', 'loop.yield')", "fetch_data", LOADER_DERIVED),
        Layer("data_loader_fork", "cat = 'posix' and func_name = 'fork'", "fetch_data"),
        Layer("reader", "cat = 'reader'", "data_loader", READER_DERIVED),
        _io("posix"),
        _io("reader_posix", f"{IO} and contains(cat, '_reader')", "reader"),
        _io("checkpoint_posix", f"{IO} and contains(cat, '_checkpoint')", "checkpoint"),
    ),
    _ASYNC,
    "app",
)
AI = Preset(
    "ai",
    (
        Layer("app", "func_name = 'ai_root'"),
        Layer("training", "cat = 'pipeline' and func_name = 'train'", "app"),
        Layer("epoch", "cat = 'pipeline' and func_name like 'epoch%'", "training"),
        Layer("compute", "cat = 'compute'", "epoch"),
        Layer("fetch_data", "func_name = 'fetch.iter'", "epoch"),
        Layer("checkpoint", "cat = 'checkpoint'", "epoch"),
        Layer("comm", "cat = 'comm'", "epoch"),
        Layer("device", "cat = 'device'", "epoch"),
        Layer("data_loader", "cat in ('data', 'data_loader', 'dataloader')", "fetch_data", LOADER_DERIVED),
        Layer("data_loader_fork", "cat = 'posix' and func_name = 'fork'", "fetch_data"),
        Layer("reader", "cat = 'reader' or func_name = 'preprocess'", "data_loader", READER_DERIVED),
        _io("posix"),
        _io("reader_posix", f"{IO} and contains(cat, '_reader')", "reader"),
        _io("checkpoint_posix", f"{IO} and contains(cat, '_checkpoint')", "checkpoint"),
    ),
    _ASYNC,
    "app",
)
PRESETS = {p.name: p for p in (POSIX, AUTO, DLIO, AI)}


def categories(traces: DataFrame, tracer: set[str] | None = None) -> list[str]:
    """The distinct categories, lower-cased and sorted, without empty ones and the tracer's own."""
    found = traces.select(F.lower("cat").alias("c")).where("c is not null and c != ''").distinct().collect()  # a row per category
    return sorted({r["c"] for r in found} - (tracer or set()))


def _key(cat: str, taken: set[str]) -> str:
    base = re.sub(r"[^0-9a-z]+", "_", cat).strip("_") or "layer"
    key, n = base, 2
    while key in taken:
        key, n = f"{base}_{n}", n + 1
    taken.add(key)
    return key


def discovered(cats: list[str]) -> Preset:
    """A forest with one layer per category; dots in names make parents, which hold their descendants too."""
    whole = {".".join(c.split(".")[: i + 1]) for c in cats for i in range(c.count(".") + 1)}
    taken = {"app"}
    keys = {c: _key(c, taken) for c in sorted(whole)}
    layers = [Layer("app", None)]
    for c in sorted(whole):
        text = c.replace("'", "\\'")
        parent = keys.get(c.rpartition(".")[0], "app")
        io = c.startswith(("posix", "stdio"))
        layers.append(Layer(keys[c], f"cat = '{text}' or startswith(cat, '{text}.')", parent, IO_DERIVED if io else {}, io, IO_SIZED if io else ()))
    return Preset("auto", tuple(layers), boundary="app", discover=True)


def detect(cats: list[str], chosen: str | None = None) -> Preset:
    """The chosen preset, or the one the categories speak for."""
    if chosen:
        return PRESETS[chosen]
    have = set(cats)
    if have & {"ai_root", "pipeline"}:
        return AI
    if have & {"reader", "data_loader", "checkpoint", "ai_framework", "dlio_benchmark"}:
        return DLIO
    return POSIX if have & {"posix", "stdio"} else AUTO
