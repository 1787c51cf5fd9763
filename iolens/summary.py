"""Scalar statistics and layer summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from iolens import schema as S
from iolens.presets import Preset


def raw_stats(traces: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """One row: job_time in seconds, event counts, distinct files, hosts and processes (pids).

    A file counts by its hash, so that files without a dictionary row count too, else by its name.
    """
    t = traces.agg(
        ((F.max("time_end") - F.min("time_start")) / S.TICKS).alias("job_time"), F.coalesce(F.sum("count"), F.lit(0)).cast("bigint").alias("trace_event_count"),
        F.count_distinct(F.coalesce("file_hash", "file_name")).alias("unique_file_count"), F.count_distinct("host_hash").alias("unique_host_count"), F.count_distinct("pid").alias("unique_process_count"),
    )
    n = profiles.agg(F.coalesce(F.sum("count"), F.lit(0)).cast("bigint").alias("n")).scalar() if profiles is not None else F.lit(0).cast("bigint")
    return t.withColumn("profile_event_count", n).withColumn("total_event_count", F.col("trace_event_count") + F.col("profile_event_count"))


def layer_summary(view: DataFrame, by: str, preset: Preset) -> DataFrame:
    """A row per layer: time, count, size, ops, bandwidth, mean transfer size, and time, count and size that aren't covered by compute.

    Time is the maximum over processes in a process view, else the sum of the
    buckets' longest processes.
    """
    have = set(view.columns)
    proc = by == "proc_name"
    track = "time_sum" if proc else "time_proc_max"
    aggs, rows = [], []
    for x in preset.names:
        c = lambda n: F.col(n) if n in have else F.lit(None).cast("double")
        u = c(f"u_{x}_{track}")
        time = (F.max if proc else F.sum)(c(f"{x}_{track}"))
        size = F.sum(c(f"{x}_size_sum"))
        u_time = (F.max if proc else F.sum)(F.when(u > 0, u))
        aggs.append(
            F.struct(
                F.lit(x).alias("layer"), time.alias("time"), F.coalesce(F.sum(c(f"{x}_count_sum")), F.lit(0)).cast("bigint").alias("count"), size.cast("double").alias("size"),
                F.coalesce(F.max(c(f"{x}_file_name_nunique")), F.lit(0)).cast("bigint").alias("num_files"), F.coalesce(F.max(c(f"{x}_proc_name_nunique")), F.lit(0)).cast("bigint").alias("num_processes"),
                u_time.alias("u_time"), F.sum(F.when(u > 0, c(f"{x}_count_sum"))).cast("bigint").alias("u_count"),
                F.sum(F.when(u > 0, c(f"{x}_size_sum"))).cast("double").alias("u_size"),
            ).alias(f"_{len(rows)}")
        )
        rows.append(f"_{len(rows)}")
    out = view.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    overlap = F.when(F.col("u_time").isNotNull(), F.greatest(1 - F.try_divide("u_time", "time"), F.lit(0.0)))
    return out.withColumns({"ops": F.try_divide("count", "time"), "bandwidth": F.try_divide("size", "time"), "transfer_size": F.try_divide("size", "count"), "overlap": overlap})


# What the end of a metric's name tells about its unit, and the divisor.
UNITS = {"_gbps": ("GB/s", 1 << 30), "_mbps": ("MB/s", 1 << 20), "_gb": ("GB", 1 << 30), "_mb": ("MB", 1 << 20)}


def metric_summary(view: DataFrame, columns: list[str]) -> DataFrame:
    """A row per column: unit, and number, minimum, mean and maximum of its finite values in that unit."""
    unit = {c: next((u for end, u in UNITS.items() if c.lower().endswith(end)), ("-", 1)) for c in columns}
    if not columns:
        return view.sparkSession.createDataFrame([], "metric string, unit string, n bigint, min double, mean double, max double")
    each = [F.struct(F.lit(c).alias("metric"), F.lit(u).alias("unit"), (F.col(c).cast("double") / by).alias("v")) for c, (u, by) in unit.items()]
    cells = view.select(F.explode(F.array(*each)).alias("p")).select("p.metric", "p.unit", F.expr("if(isnan(p.v) or abs(p.v) = double('infinity'), null, p.v)").alias("v"))
    return cells.groupBy("metric", "unit").agg(F.count("v").alias("n"), F.min("v").alias("min"), F.avg("v").alias("mean"), F.max("v").alias("max"))
