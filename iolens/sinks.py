"""Outputs of an analysis: console, JSON, files, CSV and SQLite."""

from __future__ import annotations

import json
import sqlite3
import sys
import warnings
from pathlib import Path

import pyarrow.fs as pafs
from pyspark.errors import PySparkException

from iolens import facts as K
from iolens.api import AnalysisResult


def _summary(result: AnalysisResult, by: str) -> list[dict]:
    return [r.asDict() for r in result.layer_summary(by).collect()]  # a row per layer


def _stats(result: AnalysisResult) -> dict:
    return result.raw_stats().first().asDict()


def _metrics(result: AnalysisResult, by: str) -> list[dict]:
    return [r.asDict() for r in result.additional_metrics(by).orderBy("metric").collect()]  # a row per metric


def to_console(result: AnalysisResult, out=sys.stdout) -> None:
    """Summary, layer breakdown and facts as text tables."""
    print("Summary", *[f"  {k}: {v}" for k, v in _stats(result).items()], sep="\n", file=out)
    for by in result.view_types:
        print(f"Layers by {by}", file=out)
        for r in _summary(result, by):
            print("  " + ", ".join(f"{k} {v:.6g}" if isinstance(v, float) else f"{k} {v}" for k, v in r.items() if v is not None), file=out)
        for m in _metrics(result, by):
            print(f"  metric {m['metric']} [{m['unit']}]: {m['n']}, " + (f"{m['min']:.3f} to {m['max']:.3f}, mean {m['mean']:.3f}" if m["n"] else "-"), file=out)
        if result.request.facts:
            found = result.get_analysis_facts(by)
            for r in K.summary(found).orderBy("fact_type").collect() if found is not None else ():
                print(f"  fact {r['fact_type']}: {r['n']}, peak {r['peak']:.3f} ({r['label']}) {', '.join(r['tags'])}", file=out)


def to_json(result: AnalysisResult, path: str | None = None) -> str:
    """Statistics, per-view summaries and additional metrics, without flat views; no NaN or infinity."""
    views = {by: {"summary": _summary(result, by), "additional_metrics": {m.pop("metric"): m for m in _metrics(result, by)}} for by in result.view_types}
    data = {"schema_version": "1", "raw_stats": _stats(result), "views": views}
    text = json.dumps(data, allow_nan=False, sort_keys=True)
    if path:
        Path(path).write_text(text)
    return text


def to_files(result: AnalysisResult, folder: str) -> None:
    """detail_view_<key>.parquet, raw_stats.json, and one line per envelope in facts.jsonl, appended after the first call.

    The folder may lie on any file system both Spark and pyarrow know. A view
    that fails gives a warning; the others are written.
    """
    fs, root = pafs.FileSystem.from_uri(folder if "://" in folder else str(Path(folder).absolute()))
    fs.create_dir(root)
    with fs.open_output_stream(f"{root}/raw_stats.json") as f:
        f.write(json.dumps(_stats(result)).encode())
    for by in result.view_types:
        try:
            result.get_flat_view(by).write.mode("overwrite").parquet(f"{folder}/detail_view_{by}.parquet")
        except PySparkException as e:
            warnings.warn(f"view {by} wasn't written: {e}", stacklevel=2)
    if result.request.facts:
        before = b""
        if getattr(result, "_emitted", False):
            with fs.open_input_stream(f"{root}/facts.jsonl") as f:
                before = f.read()
        with fs.open_output_stream(f"{root}/facts.jsonl") as f:
            f.write(before)
            for piece in K.envelope_text(result.all_facts(), result.fact_context()):
                f.write(piece.encode())
            f.write(b"\n")
        result._emitted = True


def to_csv(result: AnalysisResult, folder: str) -> None:
    for by in result.view_types:
        result.get_flat_view(by).write.mode("overwrite").option("header", True).csv(f"{folder}/{by}")


def to_sqlite(result: AnalysisResult, path: str) -> None:
    """The layer summaries (a row per layer and view) as a table."""
    rows = [{"view": by} | r for by in result.view_types for r in _summary(result, by)]
    with sqlite3.connect(path) as db:
        names = list(rows[0]) if rows else ["view"]
        db.execute("DROP TABLE IF EXISTS layer_summary")
        db.execute(f"CREATE TABLE layer_summary ({', '.join(names)})")
        db.executemany(f"INSERT INTO layer_summary VALUES ({', '.join('?' * len(names))})", [tuple(r.values()) for r in rows])


SINKS = {"console": to_console, "json": to_json, "file": to_files, "csv": to_csv, "sqlite": to_sqlite}
