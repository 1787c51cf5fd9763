"""Row-level operators: derivations, filters and lookups on normalized traces.

Every function takes and returns DataFrames or Columns and stays in the JVM.
Times are whole microseconds inside; they are divided once, at projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from iolens import schema as S


def _quoted(names: list[str]) -> str:
    return ", ".join("'" + n.replace("\\", "\\\\").replace("'", "\\'") + "'" for n in names)


def io_category(func: str) -> Column:
    """The category of a column of function names; OTHER for unknown and null names. One text: hash look-ups in generated code."""
    cases = " ".join(f"when {func} in ({_quoted(names)}) then {cat}" for cat, names in S.IO_FUNCTIONS.items())
    return F.expr(f"cast(case {cases} else {S.OTHER} end as tinyint)")


def io_size(io_cat: Column, ret: Column) -> Column:
    """The bytes moved by reads and writes that returned more than 0, else null."""
    return F.when(io_cat.isin(S.READ, S.WRITE) & (ret > 0), ret)


def proc_name(host: Column, host_hash: Column, pid: Column, tid: Column) -> Column:
    """app#<host>#<pid>#<tid>."""
    return F.concat_ws("#", F.lit("app"), F.coalesce(host, host_hash, F.lit("unknown")), pid.cast("string"), tid.cast("string"))


def path_category(cat: str, file_name: str) -> Column:
    """Adds what the path tells to the category of posix and stdio events."""
    marks = ", ".join(f"if(contains({file_name}, '{part}'), '{mark}', '')" for part, mark in S.PATH_SUFFIXES)
    return F.expr(f"if((contains({cat}, 'posix') or contains({cat}, 'stdio')) and {file_name} is not null, concat({cat}, {marks}), {cat})")


def wanted(file_name: str, func: str) -> Column:
    """False for events on ignored paths or of ignored functions; null paths and names pass."""
    paths = " or ".join(f"contains({file_name}, '{p}')" for p in S.IGNORED_PATHS)
    patterns = "|".join(S.IGNORED_FUNCTION_PATTERNS)
    return F.expr(f"not coalesce({paths}, false) and not coalesce({func} in ({_quoted(S.IGNORED_FUNCTIONS)}) or {func} rlike '{patterns}', false)")


def not_zero(c: Column) -> Column:
    return F.nullif(c, F.lit(0))


def floor_div(c: Column, width: int) -> Column:
    """Whole-number floor, also for negative values (div rounds to 0)."""
    return F.call_function("div", c - F.pmod(c, F.lit(width)), F.lit(width))


def bucket(ts: Column, origin: int | Column, width: int) -> Column:
    return floor_div(ts - F.lit(origin), width).cast("bigint")


def aligned_origin(least: int | None, width: int) -> int:
    """The start of the bucket that holds the first event."""
    return (least or 0) // width * width


def least_bucket(rows: DataFrame, ts: str, width: int) -> Column:
    """aligned_origin of a column as a scalar subquery, so that no job runs before the plan does."""
    return F.coalesce(rows.agg((F.min(ts) - F.pmod(F.min(ts), F.lit(width))).alias("o")).scalar(), F.lit(0))


def with_time_range(traces: DataFrame, width: int, origin: int | Column | None = None) -> DataFrame:
    """time_range: the bucket of time_start, counted from the first event's bucket."""
    if origin is None:
        origin = least_bucket(traces, "time_start", width)
    return traces.withColumn("time_range", bucket(F.col("time_start"), origin, width))


def size_bins(size: Column) -> list[Column]:
    """Twelve 0/1 columns size_bin_*; right-closed, none for null."""
    edges = [None, *S.SIZE_EDGES, None]
    out = []
    for name, lo, hi in zip(S.SIZE_BINS, edges, edges[1:], strict=False):
        inside = F.lit(True) if lo is None else size > lo
        if hi is not None:
            inside = inside & (size <= hi)
        out.append(F.coalesce(inside & size.isNotNull(), F.lit(False)).cast("int").alias(f"size_bin_{name}"))
    return out


def file_dir(c: Column) -> Column:
    """The directory of a path: / for files at the root, empty without any /."""
    head = F.regexp_replace(F.regexp_extract(c, "^(.*/)[^/]*$", 1), "^(.*[^/])/+$", "$1")
    return F.when(c.isNotNull(), head)


def file_pattern(c: Column) -> Column:
    """Runs of digits replaced by [0-9]."""
    return F.regexp_replace(c, "[0-9]+", "[0-9]")


def name_part(proc: Column, i: int) -> Column:
    """The i-th part of a process name (1 host, 2 process, 3 thread); null when there is none."""
    return F.get(F.split(proc, "#"), F.lit(i))


def process_parts(proc: Column) -> dict[str, Column]:
    """app_name, host_name, proc_id, rank and thread_id of process names: app#host#process#thread, else name#host#rank."""
    own = name_part(proc, 0) == "app"
    parts = {"app_name": name_part(proc, 0), "host_name": name_part(proc, 1), "proc_id": F.when(own, name_part(proc, 2)), "rank": F.when(~own, name_part(proc, 2))}
    return parts | {"thread_id": F.when(own, name_part(proc, 3))}


def stable_id(*parts: Column) -> Column:
    """A bigint of 60 bits that depends on the parts' text alone; the same on every machine."""
    text = F.concat_ws("_", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def attach_names(events: DataFrame, files: DataFrame | None, hosts: DataFrame | None) -> DataFrame:
    """Looks up file and host names by hash; rows without an entry keep null.

    files and hosts: (hash, value). A hash written by many processes is reduced
    to one row first, so that no event is repeated. The dictionaries grow with
    the files, so the join strategy is left to the optimizer.
    """
    for names, key, out in ((files, "file_hash", "file_name"), (hosts, "host_hash", "host_name")):
        if names is not None:
            one = names.where("hash is not null").groupBy(F.col("hash").alias(key)).agg(F.min("value").alias(out))
            events = events.drop(out).join(one, key, "left")
    return events


def epochs(traces: DataFrame, is_epoch: Column) -> DataFrame:
    """pid, no, start, stop of the epoch spans, numbered per pid in order of start."""
    w = Window.partitionBy("pid").orderBy("time_start", "time_end")
    spans = traces.where(is_epoch).select("pid", "time_start", "time_end").distinct()
    return spans.select("pid", F.row_number().over(w).cast("bigint").alias("no"), F.col("time_start").alias("start"), F.col("time_end").alias("stop"))


#: Width of the time slots in which intervals are looked up: 2**26 µs, about 67 s.
SLOT = 26


def assign_epochs(traces: DataFrame, spans: DataFrame) -> DataFrame:
    """epoch: the last epoch of the event's pid whose [start, stop) holds its start, else null.

    An interval join by equality of (pid, time slot): every span is entered in
    the slots it covers, every event asks its own slot; events matching several
    spans take the highest number.
    """
    slots = spans.where("start < stop").withColumn("slot", F.explode(F.expr(f"sequence(shiftright(start, {SLOT}), shiftright(stop - 1, {SLOT}))")))
    # one row per slot, so an event meets one row at most
    slots = slots.groupBy("pid", "slot").agg(F.collect_list(F.struct("no", "start", "stop")).alias("spans"))
    keyed = traces.drop("epoch").withColumn("_slot", F.shiftright("time_start", SLOT))
    joined = keyed.alias("t").join(slots.alias("s"), F.expr("t.pid = s.pid and t._slot = s.slot"), "left")
    last = F.expr("array_max(transform(filter(s.spans, x -> t.time_start >= x.start and t.time_start < x.stop), x -> x.no))")
    return joined.select("t.*", last.alias("epoch")).drop("_slot")


def assign_steps(traces: DataFrame, is_step: Column, chunk: int = 3_600_000_000) -> DataFrame:
    """step: the number of the last step mark of the event's pid at or before its start, else null.

    As-of lookup without one task per pid: marks and events meet per (pid,
    chunk of time), and each chunk gets the last mark of the chunks before.
    """
    w = Window.partitionBy("pid").orderBy("time_start")
    marks = traces.where(is_step).select("pid", "time_start").distinct()
    marks = marks.select("pid", "time_start", F.row_number().over(w).cast("bigint").alias("step"))
    part = F.floor(F.col("time_start") / chunk)
    rows = traces.drop("step").withColumns({"_c": part, "step": F.lit(None).cast("bigint"), "_kind": F.lit(2)})
    own = marks.withColumns({"_c": part, "_kind": F.lit(1)})
    last = marks.groupBy("pid", part.alias("_c")).agg(F.max("step").alias("step"))
    places = traces.select("pid", part.alias("_c")).distinct().join(last, ["pid", "_c"], "left")
    before = Window.partitionBy("pid").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    carry = places.select("pid", "_c", F.max("step").over(before).alias("step")).withColumn("_kind", F.lit(0))
    every = rows.unionByName(own, allowMissingColumns=True).unionByName(carry, allowMissingColumns=True)
    upto = Window.partitionBy("pid", "_c").orderBy(F.when(F.col("_kind") == 0, None).otherwise(F.col("time_start")).asc_nulls_first(), "_kind").rowsBetween(Window.unboundedPreceding, 0)
    return every.withColumn("step", F.last("step", ignorenulls=True).over(upto)).where("_kind = 2").drop("_c", "_kind")


def sliced(traces: DataFrame, width: int, drop_zero: bool = False) -> DataFrame:
    """Splits every event into pieces of at most `width` µs.

    The last piece holds the rest; count and size are divided by the number of
    pieces (double); time_start moves with the piece, time_end stays. Events of
    no duration stay whole, or are dropped with drop_zero.
    """
    n = F.greatest(F.ceil(F.coalesce("time", F.lit(0)) / width), F.lit(1)).cast("bigint")
    rows = traces.where("time > 0") if drop_zero else traces
    rows = rows.withColumn("_n", n).withColumn("_k", F.explode(F.expr("sequence(0L, _n - 1)")))
    rest = F.col("time") - F.col("_k") * width
    return rows.withColumns(
        {
            "time": F.least(rest, F.lit(width)),
            "time_start": F.col("time_start") + F.col("_k") * width,
            "count": F.col("count") / F.col("_n"),
            "size": F.col("size") / F.col("_n"),
        }
    ).withColumn("time_range", floor_div(F.col("time_start"), width).cast("bigint")).drop("_n", "_k")
