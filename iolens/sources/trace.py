"""Trace files: JSON lines, plain or gzipped, read into typed events, profiles and system samples.

Lines are read as text, brackets and broken lines dropped, and the rest parsed
with from_json in the JVM. A gzipped file can't be split, so parallelism is the
number of files; `spread` repartitions after parsing.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from iolens import schema as S
from iolens.functions.expressions import ExpressionError, compile_expression
from iolens.operators import normalize as N
from iolens.operators import profiles as P
from iolens.operators import system as Y


@dataclass
class TraceFrames:
    """Normalized frames; profiles and system are None for traces without such records."""

    traces: DataFrame
    profiles: DataFrame | None
    system: DataFrame | None
    origin: int
    width: int


def _statuses(spark: SparkSession, path: str, pattern: bool = False) -> list:
    """The files at a path or pattern of any file system Hadoop knows, not below it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(p) if pattern else fs.listStatus(p) if fs.exists(p) and fs.getFileStatus(p).isDirectory() else None
    return [s for s in found or [] if s.isFile()]


def _named(status, like: str) -> str:
    """A path as Spark reads it; local ones are named as they were asked for."""
    name = status.getPath().toString()
    return name.removeprefix("file:") if name.startswith("file:") and not like.startswith("file:") else name


def trace_statuses(spark: SparkSession, path: str, groups: list[str] | None = None) -> dict[str, tuple[int, int]]:
    """Size and time of change of each file list_trace_files names."""
    if groups:
        listed = json.loads(spark.read.text(f"{path}/manifest.json", wholetext=True).first()[0])["groups"]
        found = [s for g in groups for f in listed[g] for s in _statuses(spark, f"{path}/{f}", True)]
    else:
        found = [s for s in _statuses(spark, path) if s.getPath().getName().endswith((".pfw", ".pfw.gz"))] or _statuses(spark, path, True)
    if not found:
        raise FileNotFoundError(f"no trace files at {path}")
    return {_named(s, path): (s.getLen(), s.getModificationTime()) for s in found}


def list_trace_files(path: str, groups: list[str] | None = None, spark: SparkSession | None = None) -> list[str]:
    """*.pfw and *.pfw.gz directly in a folder, one file, or a glob, on any file system Hadoop knows; sorted.

    groups: names of manifest.json's groups of files, to which a folder is restricted.
    """
    return sorted(trace_statuses(spark or SparkSession.builder.getOrCreate(), path, groups))


def parse_lines(lines: DataFrame, extra: str = "", column: str = "value") -> DataFrame:
    """Raw records of text lines; brackets, blank and broken lines are dropped, a comma at the end is allowed."""
    text = F.regexp_replace(F.trim(F.regexp_replace(column, "[\\r\\n\\t]+", " ")), ",\\s*$", "")
    whole = lines.withColumn("_t", text).where("_t like '{%}'")
    raw = whole.withColumn("_r", F.from_json("_t", S.raw_schema(extra), {"mode": "PERMISSIVE"})).where("_r is not null and _r.ph is not null")
    return raw.select("_r.*")


def read_raw(spark: SparkSession, files: list[str], extra: str = "", spread: int | None = None) -> DataFrame:
    raw = parse_lines(spark.read.text(files), extra)
    return raw.repartition(spread) if spread else raw


def dictionaries(raw: DataFrame) -> dict[str, DataFrame]:
    """hash, value of the HH (hosts) and FH (files) records, and pid, name, value of PR."""
    meta = raw.where("ph = 'M'")
    pick = lambda kind: meta.where(F.col("name") == kind).select(F.col("args.value").alias("hash"), F.col("args.name").alias("value"))
    return {"hosts": pick("HH"), "files": pick("FH"), "processes": meta.where("name = 'PR'").select("pid", F.col("args.name").alias("name"), F.col("args.value").alias("value"))}


def traces_of(raw: DataFrame, width: int, origin: int) -> DataFrame:
    """Timed events (ph X) in the schema of traces; markers of the tracer itself are left out by the ignore rules."""
    a = "args."
    names = dictionaries(raw)
    x = raw.where("ph = 'X' and ts is not null").select(
        F.lower(F.trim("cat")).alias("cat"), F.col("name").alias("func_name"), "pid", "tid", F.col(a + "epoch").alias("epoch"), F.col(a + "step").alias("step"),
        F.col(a + "fhash").alias("file_hash"), F.col(a + "hhash").alias("host_hash"), F.col("dur").alias("time"), F.col(a + "ret").alias("_ret"), F.col(a + "offset").alias("offset"), F.col("ts").alias("time_start"),
    )
    x = N.attach_names(x, names["files"], names["hosts"])
    x = x.withColumns({"io_cat": N.io_category("func_name")})
    return finished(x.withColumn("size", N.io_size(F.col("io_cat"), F.col("_ret"))), width, origin)


def finished(x: DataFrame, width: int, origin: int) -> DataFrame:
    """Derived columns and filters that every source of traces shares; zero sizes and offsets become null. time_start isn't null."""
    x = x.where(N.wanted("file_name", "func_name"))
    x = x.withColumns({"_host": F.expr("coalesce(host_name, host_hash, 'unknown')"), "cat": N.path_category("cat", "file_name"), "time_range": F.coalesce(N.bucket(F.col("time_start"), origin, width), F.lit(0))})
    made = {"proc_name": "concat_ws('#', 'app', _host, cast(pid as string), cast(tid as string))", "acc_pat": "0", "count": "1", "size": "nullif(size, 0)", "offset": "nullif(offset, 0)", "time_end": "time_start + coalesce(time, 0)"}
    return x.selectExpr(*[f"cast({made.get(c, f'`{c}`')} as {t}) as `{c}`" for c, t in S.TRACE_COLUMNS.items()])


def frames(raw: DataFrame, width: int, profile_bucket: int = P.BUCKET) -> TraceFrames:
    """Splits raw records by kind; one pass finds the origin and which kinds there are."""
    system = F.expr("ph = 'C' and lower(cat) = 'sys'")
    counter = F.expr("ph = 'C' and lower(cat) != 'sys'")
    row = raw.agg(F.min(F.when(F.expr("ph in ('X', 'C') and lower(cat) != 'sys'"), F.col("ts"))).alias("least"), F.count_if(system).alias("sys"), F.count_if(counter).alias("prof"), F.min(F.when(system, F.col("ts"))).alias("sys_least")).first()
    origin = N.aligned_origin(row["least"], width)
    names = dictionaries(raw)
    profiles = None
    if row["prof"]:
        c = raw.where(counter).select("cat", "name", "pid", "tid", "ts", F.col("dur").alias("_top_dur"), *[f"args.{n}" for n in raw.schema["args"].dataType.names if n not in ("name", "value")])
        c = c.withColumns({"file_hash": F.col("fhash"), "host_hash": F.col("hhash"), "dur": F.coalesce("dur", "_top_dur")}).drop("_top_dur")
        c = N.attach_names(c, names["files"], names["hosts"])
        shifted = P.standard(c, profile_bucket)
        profiles = P.coalesced(shifted.withColumn("time_range", N.bucket(F.col("time_start"), N.aligned_origin(row["least"], profile_bucket), profile_bucket)))
    samples = None
    if row["sys"]:
        s = raw.where(system).select("name", "ts", F.col("args.hhash").alias("host_hash"), *[f"args.{c}" for c in Y.CPU.values()], F.col("args.Dirty").alias("dirty"), F.col("args.Cached").alias("cached"), F.col("args.MemAvailable").alias("mem_available"))
        samples = Y.system_metrics(s, width, N.aligned_origin(row["sys_least"], width))
    return TraceFrames(traces_of(raw, width, origin), profiles, samples, origin, width)


def read_trace(spark: SparkSession, path: str, granularity: float = 1.0, groups: list[str] | None = None, extra_columns: str = "", spread: int | None = None, profile_bucket: int = P.BUCKET) -> TraceFrames:
    """Reads trace files; granularity in seconds, extra_columns as DDL of further args."""
    return frames(read_raw(spark, list_trace_files(path, groups, spark), extra_columns, spread), round(granularity * S.TICKS), profile_bucket)


class RawTraces:
    """Lazy access to raw timed events: pages, predicates and distinct values."""

    def __init__(self, df: DataFrame):
        self.df = df

    def filter(self, predicate: str) -> RawTraces:
        """A predicate as in user expressions (==, and, or, not, strings in either quotes), else one of SQL."""
        try:
            return RawTraces(self.df.where(compile_expression(predicate, set(self.df.columns))))
        except ExpressionError:
            return RawTraces(self.df.where(predicate))

    def unique(self, column: str) -> DataFrame:
        return self.df.select(column).where(F.col(column).isNotNull()).distinct()

    def page(self, n: int, size: int = 100, order: tuple[str, ...] = ("ts", "pid", "tid", "id")) -> DataFrame:
        """The n-th page, from 0, in a fixed order."""
        return self.df.orderBy(*[c for c in order if c in self.df.columns]).offset(n * size).limit(size)

    def pages(self, size: int = 100):
        """All rows, page by page, without holding them all."""
        held = []
        for r in self.df.toLocalIterator():
            held.append(r)
            if len(held) == size:
                yield held
                held = []
        if held:
            yield held
