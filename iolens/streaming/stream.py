"""Structured Streaming over chunks of trace files; results equal those of a batch over the same lines."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from iolens.sources.trace import parse_lines


def read_stream(spark: SparkSession, path: str, extra: str = "", per_trigger: int = 1000) -> DataFrame:
    """Raw records of files as they appear in a folder, with event_time from ts."""
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", per_trigger).load(path)
    return with_event_time(parse_lines(lines, extra))


def with_event_time(raw: DataFrame) -> DataFrame:
    return raw.withColumn("event_time", F.timestamp_micros("ts"))


def tumbling(events: DataFrame, seconds: float, late: str = "10 minutes", slide: float | None = None) -> DataFrame:
    """Per window and category: count, time in µs, bytes returned. slide makes windows overlap; events later than `late` are dropped."""
    width = f"{round(seconds * 1000)} milliseconds"
    w = F.window("event_time", width, f"{round(slide * 1000)} milliseconds") if slide else F.window("event_time", width)
    rows = events.where("ph = 'X' and ts is not null").withWatermark("event_time", late)
    got = rows.groupBy(w, F.lower(F.trim("cat")).alias("cat")).agg(F.count(F.lit(1)).alias("count"), F.sum("dur").alias("time"))
    return got.select(F.unix_micros("window.start").alias("window_start"), "cat", "count", "time")


def sessions(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """Per process, stretches of activity without a pause of `gap`."""
    rows = events.where("ph = 'X' and ts is not null").withWatermark("event_time", late)
    got = rows.groupBy(F.session_window("event_time", gap), "pid").agg(F.count(F.lit(1)).alias("count"))
    return got.select(F.unix_micros("session_window.start").alias("start"), F.unix_micros("session_window.end").alias("stop"), "pid", "count")


def epoch_state(events: DataFrame, is_epoch: str) -> DataFrame:
    """Stateful numbering of epoch marks per pid across micro-batches: pid, epoch, time_start.

    Numbers are given in order of arrival, and by time within a micro-batch; a
    mark that arrives in a later batch than its successors gets a later number.
    """
    marks = events.where("ph = 'X' and ts is not null").where(is_epoch).select("pid", "ts")

    def number(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        for pdf in frames:
            ts = pdf["ts"].sort_values()
            yield pd.DataFrame({"pid": key[0], "epoch": range(n + 1, n + 1 + len(ts)), "time_start": ts.to_numpy()})
            n += len(ts)
        state.update((n,))

    return marks.groupBy("pid").applyInPandasWithState(number, "pid bigint, epoch bigint, time_start bigint", "n bigint", "append", GroupStateTimeout.NoTimeout)


def for_each_window(events: DataFrame, emit: Callable[[DataFrame, int], None], checkpoint: str):
    """Hands every micro-batch to `emit` (for example an appending file output)."""
    return events.writeStream.foreachBatch(emit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def batches_to_files(folder: str) -> Callable[[DataFrame, int], None]:
    """For for_each_window: appends every micro-batch as Parquet files in batch=<n>; a batch that runs again replaces its own."""

    def write(rows: DataFrame, no: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/batch={no}")

    return write


def run_available(df: DataFrame, keys: list[str], folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over everything there is; returns what it wrote: all rows (append), the last per key (update) or the last batch (complete).

    The result lies below `folder`, never in the driver.
    """
    spark, schema = df.sparkSession, T.StructType([*df.schema.fields, T.StructField("batch", T.LongType())])

    q = df.writeStream.foreachBatch(batches_to_files(f"{folder}/rows")).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/rows")
    there = root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root)  # an empty source has no batch
    got = spark.read.schema(schema).parquet(f"{folder}/rows") if there else spark.createDataFrame([], schema)
    if mode == "append":
        return got.drop("batch")
    if mode == "complete":
        return got.where(F.col("batch") == got.agg(F.max("batch")).scalar()).drop("batch")
    last = F.max_by(F.struct(*[c for c in df.columns if c not in keys]), "batch").alias("r")
    return got.groupBy(*keys).agg(last).select(*keys, "r.*")
