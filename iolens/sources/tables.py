"""Columnar tables of trace records as normalized frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from iolens import schema as S
from iolens.operators import normalize as N
from iolens.operators import profiles as P
from iolens.operators import system as Y
from iolens.runtime import normal_form, records, table
from iolens.sources.trace import finished

DAY = 86_400 * S.TICKS


def raw_events(spark: SparkSession, d: str, columns: list[str]) -> DataFrame:
    """Records of trace_events with ts, copies counted once; cat and name in normal form, durations below 0 null."""
    special = {"cat": normal_form(F.col("cat")), "name": normal_form(F.col("name")), "dur": F.when(F.col("dur") >= 0, F.col("dur"))}
    cols = {c: special.get(c, F.col(c)) for c in columns}
    return records(table(spark, d, "trace_events").where("ts is not null"), "event_id", cols)


#: Columns of trace_events besides those that every view needs, by their name in traces.
SPARE = {"epoch": "epoch", "step": "step", "file_hash": "file_hash", "offset": "file_offset"}


def traces(spark: SparkSession, d: str, width: int = 3600 * S.TICKS, origin: int | Column | None = None, spare: tuple[str, ...] = ()) -> DataFrame:
    """trace_events in the schema of traces; columns of SPARE that aren't named are null, and neither read nor compared."""
    names = "event_id cat name pid tid host_hash file_name host_name dur size ts".split()
    x = raw_events(spark, d, [*names, *(SPARE[c] for c in spare)])
    if origin is None:
        origin = N.least_bucket(table(spark, d, "trace_events"), "ts", width)
    x = x.withColumnsRenamed({"name": "func_name", "dur": "time", "ts": "time_start", "file_offset": "offset"})
    x = x.withColumn("io_cat", N.io_category("func_name")).withColumns({"size": N.io_size(F.col("io_cat"), F.col("size"))} | {c: F.lit(None).cast(S.TRACE_COLUMNS[c]) for c in SPARE if c not in spare})
    return finished(x, width, origin)


def profiles(spark: SparkSession, d: str, bucket: int = P.BUCKET) -> DataFrame:
    """counter_samples as coalesced profiles; readings start at their bucket, negative values are null."""
    ok = lambda c: F.when(F.col(c) >= 0, F.col(c))
    start = N.floor_div(F.col("ts"), bucket) * bucket
    cols = {"cat": normal_form(F.col("cat")), "name": normal_form(F.col("name")), "pid": F.col("pid"), "tid": F.col("tid"), "host_hash": F.col("host_hash"), "ts": start, "dft_cnt": F.col("dft_cnt")}
    cols |= {"dur_sum": ok("dur"), "dur_min": ok("dur_min"), "dur_max": ok("dur_max"), "ret_sum": ok("size"), "ret_min": ok("size_min"), "ret_max": ok("size_max")}
    raw = records(table(spark, d, "counter_samples").where("ts is not null"), "reading_id", cols)
    return P.coalesced(P.standard(raw, bucket))


def system(spark: SparkSession, d: str, width: int, origin: int | Column = 0) -> DataFrame:
    names = ["name", "host_hash", "ts", *Y.CPU.values(), *Y.MEMORY.values()]
    raw = records(table(spark, d, "system_samples"), "sample_id", {c: F.col(c) for c in names})
    return Y.system_metrics(raw, width, origin)
