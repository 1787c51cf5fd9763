"""System metrics per host and time bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from iolens.operators import normalize as N

CPU = {"sys_cpu_iowait_pct": "iowait_pct", "sys_cpu_user_pct": "user_pct", "sys_cpu_system_pct": "system_pct", "sys_cpu_idle_pct": "idle_pct"}
MEMORY = {"sys_mem_dirty": "dirty", "sys_mem_cached": "cached", "sys_mem_available": "mem_available"}


def system_metrics(samples: DataFrame, width: int, origin: int = 0) -> DataFrame:
    """host_hash, time_range and nine statistics, in one aggregate.

    samples: host_hash, ts, name (cpu, cpu-<n>, memory) and the percentages and
    memory columns. Samples without host or ts are left out. The p95 of one
    host's cores within one bucket is exact; its values are a bucket's samples.
    """
    cpu, core, memory = F.col("name") == "cpu", F.col("name").startswith("cpu-"), F.col("name") == "memory"
    means = [F.avg(F.when(cpu, F.col(c))).alias(n) for n, c in CPU.items()]
    cores = [F.max(F.when(core, F.col("iowait_pct"))).alias("sys_core_iowait_pct_max"), F.percentile(F.when(core, F.col("iowait_pct")), 0.95).alias("sys_core_iowait_pct_p95")]
    means += cores + [F.avg(F.when(memory, F.col(c))).alias(n) for n, c in MEMORY.items()]
    rows = samples.where("host_hash is not null and ts is not null").withColumn("time_range", N.bucket(F.col("ts"), origin, width))
    return rows.where(cpu | core | memory).groupBy("host_hash", "time_range").agg(*means)


def onto_view(view: DataFrame, system: DataFrame, fan_out: bool = False) -> DataFrame:
    """Joins system metrics to a time_range view; hosts are averaged (maximum for *_max) unless fan_out."""
    if not fan_out:
        names = [c for c in system.columns if c.startswith("sys_")]
        system = system.groupBy("time_range").agg(*[(F.max if c.endswith("_max") else F.avg)(c).alias(c) for c in names])
    return view.join(system, "time_range", "left")
