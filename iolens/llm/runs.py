"""Runs of consecutive like events, each collapsed into one event.

Method: boundary interval lookup. Events are range-sorted by entity, time and
id, so a chunk (one task's stretch) may hold many entities or a part of one;
chunks have like sizes however skewed the entities are. In each chunk the
positions where a run starts are gathered into a sorted array, events find
their run by binary search, and runs aggregate. Only the first and the last run
of every chunk can continue in a neighbour; these few are joined afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from iolens.functions.arrow import changes
from iolens.runtime import written


def _collapse(entity: list[str], like: list[str], out: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        prev: pa.Table | None = None  # the last row seen
        held: dict | None = None  # the run not yet closed
        head = True
        for batch in batches:
            if not batch.num_rows:
                continue
            tab = pa.Table.from_batches([batch])
            if prev is not None:
                tab = pa.concat_tables([prev, tab]).combine_chunks()
            # copies lie next to each other
            same = np.ones(tab.num_rows - 1, bool)
            for c in [*entity, "ts", "id"]:
                same &= ~changes(tab[c])
            known = np.asarray(pc.is_valid(tab["id"]))
            fresh = np.r_[True, ~(same & known[1:])]
            tab = tab.filter(pa.array(fresh))
            new = np.zeros(tab.num_rows - 1, bool)
            for c in [*entity, *like]:
                new |= changes(tab[c])
            prev = tab.slice(tab.num_rows - 1)
            if held is not None or not head:
                tab = tab.slice(1)  # the row before is in the held run
            else:
                new = np.r_[True, new]
            if not tab.num_rows:
                continue
            starts = np.flatnonzero(new)
            where = np.searchsorted(starts, np.arange(tab.num_rows), "right")  # 0: the held run goes on
            n = np.bincount(where, minlength=len(starts) + 1)
            stop = np.asarray(tab["stop"])
            lead = int(starts[0]) if len(starts) else tab.num_rows
            if lead:
                held["n"] += int(n[0])
                held["stop"] = max(held["stop"], int(stop[:lead].max()))
                held["last_ts"] = tab["ts"][lead - 1].as_py()
            if not len(starts):
                continue
            rows = []
            if held is not None:
                rows.append(held)
            first = tab.select([*entity, *like, "id", "ts"]).take(pa.array(starts))
            top = np.maximum.reduceat(stop, starts)
            ends = np.r_[starts[1:], tab.num_rows] - 1
            runs = first.rename_columns([*entity, *like, "first_id", "first_ts"]).append_column("n", pa.array(n[1:], pa.int64())).append_column("stop", pa.array(top, pa.int64())).append_column("last_ts", tab["ts"].take(pa.array(ends)))
            for r in rows:
                yield pa.RecordBatch.from_pylist([r | {"part": part, "head": head, "tail": False}], out)
                head = False
            if len(starts) > 1:
                done = runs.slice(0, len(starts) - 1)
                flags = np.zeros(len(done), bool)
                flags[0] = head
                head = False
                done = done.append_column("part", pa.array(np.full(len(done), part), pa.int32())).append_column("head", pa.array(flags)).append_column("tail", pa.array(np.zeros(len(done), bool)))
                yield from done.select(out.names).cast(out).combine_chunks().to_batches()
            held = runs.slice(len(starts) - 1).to_pylist()[0]
        if held is not None:
            yield pa.RecordBatch.from_pylist([held | {"part": part, "head": head, "tail": True}], out)

    return run


def collapse_runs(events: DataFrame, entity: list[str], like: dict[str, Column], order: str = "event_id") -> DataFrame:
    """One row per run: entity, the `like` columns, first_id, first_ts, last_ts, n, duration.

    events: entity, ts, te, dur (bigint), order (an id; rows with the same
    entity, ts and id are copies and count once, rows with null id are no
    copies). A run is a maximal stretch of consecutive events of one entity, by
    ts and id, equal in all `like` columns, null equal to null. Rows without ts
    are left out. Duration: from the first ts to the latest end (te, else ts +
    dur where dur > 0, else ts).
    """
    stop = F.greatest("ts", F.coalesce("te", F.expr("try_add(ts, greatest(dur, 0))"), "ts"))
    rows = events.where("ts is not null").select(*entity, "ts", F.col(order).alias("id"), stop.alias("stop"), *[c.alias(n) for n, c in like.items()])
    keys = [*entity, "ts", "id"]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    out = {n: kinds[n] for n in [*entity, *like]} | {"first_id": kinds["id"], "first_ts": "bigint", "last_ts": "bigint", "n": "bigint", "stop": "bigint", "part": "int", "head": "boolean", "tail": "boolean"}
    schema = pa.schema([(n, pa.bool_() if t == "boolean" else arrow[t]) for n, t in out.items()])
    spread = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    runs = written(spread.mapInArrow(_collapse(entity, list(like), schema), ", ".join(f"{n} {t}" for n, t in out.items())), "runs")
    inner = runs.where("not head and not tail").drop("part", "head", "tail")
    # at most two rows a chunk: joined where the last run of one goes on in the next
    w = Window.partitionBy(*entity).orderBy("first_ts", "first_id", "part")
    goes_on = F.col("head") & F.coalesce(F.lag("tail").over(w), F.lit(False))
    for c in like:
        goes_on &= F.col(c).eqNullSafe(F.lag(c).over(w))
    edge = runs.where("head or tail").withColumn("no", (~goes_on).cast("int"))
    edge = edge.withColumn("no", F.sum("no").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    joined = edge.groupBy(*entity, *like, "no").agg(F.min(F.struct("first_ts", "first_id")).alias("f"), F.max("last_ts").alias("last_ts"), F.sum("n").alias("n"), F.max("stop").alias("stop"))
    joined = joined.select(*entity, *like, "f.first_id", "f.first_ts", "last_ts", "n", "stop")
    return inner.unionByName(joined).withColumn("duration", F.col("stop") - F.col("first_ts")).drop("stop")
