"""Continuous periods of overlapping integer intervals, and the gaps between them.

Method: canonical dyadic blocks. Time is cut into chunks of 2**top units, and a
span into pieces: its part in the first and in the last chunk, and the whole
chunks between as a range of chunks, cut in the same way into chunks of
2**STEP of them, and so on; a span of any length has a few pieces, so one very
long span changes nothing for others. Pieces are shuffled once, by entity and
chunk, so one entity spreads over many tasks. In a task every piece is
decomposed into its canonical blocks (at most two a level), blocks covered by
an ancestor are removed, sibling pairs merge upward, and adjacent blocks
coalesce (vectorised, over many chunks at once, in bounded memory). Across
chunks only each chunk's first start and last stop and the long periods are
compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from iolens.functions.arrow import starts
from iolens.runtime import written

#: Pieces a task merges at once.
ROWS = 200_000
#: A chunk is 2**30 µs, about 18 minutes.
TOP = 30
#: A chunk of a coarser tier holds 2**STEP chunks of the tier below.
STEP = 10
#: Tasks over which the pieces of a coarser chunk are spread.
SALTS = 16


def _unit(tier: np.ndarray | int, top: int):
    """The level of a tier's unit: 0 (a µs), then that of the chunks of the tier below."""
    return (tier > 0) * (top + STEP * (tier - 1))


def _pieces(spans: DataFrame, keys: list[str], top: int) -> DataFrame:
    """keys, tier, chunk, salt, a, b: [a, b) in units of the tier, from the chunk's start; a = b is a point."""
    lo, hi = "start", "stop"
    out = []
    rows = spans.select(*keys, "start", "stop")
    for k in range(2 + (63 - top) // STEP):
        s = STEP if k else top
        rows = rows.withColumns({f"c{k}": F.expr(f"shiftright({lo}, {s})"), f"d{k}": F.expr(f"shiftright({hi}, {s})")})
        rows = rows.withColumns({f"a{k}": F.expr(f"{lo} - shiftleft(c{k}, {s})"), f"b{k}": F.expr(f"{hi} - shiftleft(d{k}, {s})")})
        make = lambda when, c, a, b, k=k: f"if({when}, struct({k} as tier, {c} as chunk, {a} as a, {b} as b), null)"
        out += [make(f"c{k} = d{k}", f"c{k}", f"a{k}", f"b{k}"), make(f"c{k} < d{k} and a{k} > 0", f"c{k}", f"a{k}", f"{1 << s}L"), make(f"c{k} < d{k} and b{k} > 0", f"d{k}", "0L", f"b{k}")]
        first = f"c{k} + if(a{k} > 0, 1, 0)"
        rows = rows.withColumns({f"x{k}": F.expr(f"if({first} < d{k}, {first}, null)"), f"y{k}": F.expr(f"if({first} < d{k}, d{k}, null)")})
        lo, hi = f"x{k}", f"y{k}"
    every = f"if(c0 = d0, array({out[0]}), filter(array({', '.join(out)}), p -> p is not null))"  # most spans lie in one chunk
    rows = rows.select(*keys, F.explode(F.expr(every)).alias("p")).select(*keys, "p.*")
    return rows.withColumn("salt", F.expr(f"if(tier > 0, cast(pmod(xxhash64(a, b), {SALTS}) as int), 0)"))


def _blocks(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The canonical blocks of all [lo, hi), as position * 64 + (63 - level), sorted: of equal positions the largest first."""
    out = []
    for level in range(TOP + 32):
        some = lo < hi
        lo, hi = lo[some], hi[some]
        if not len(lo):
            break
        size = np.int64(1) << level
        left = (lo >> level) & 1 == 1
        out.append(lo[left] * 64 + (63 - level))
        lo = lo + left * size
        right = ((hi >> level) & 1 == 1) & (lo < hi)
        hi = hi - right * size
        out.append(hi[right] * 64 + (63 - level))
    return np.sort(np.concatenate(out)) if out else np.empty(0, np.int64)


def _coalesced(lo: np.ndarray, hi: np.ndarray, points: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the maximal periods; groups lie 2**width apart and never join."""
    key = _blocks(lo, hi)
    pos, lev = key >> 6, 63 - (key & 63)
    # blocks are nested or disjoint: one is covered if an earlier one, at most as far left, ends no earlier
    end = pos + (np.int64(1) << lev)
    keep = np.ones(len(pos), bool)
    keep[1:] = end[1:] > np.maximum.accumulate(end)[:-1]
    pos, lev = pos[keep], lev[keep]
    # sibling pairs merge upward
    by_level = np.argsort(lev, kind="stable")
    pos, cuts = pos[by_level], np.searchsorted(lev[by_level], np.arange(width + 2))
    done, size, up = [], [], np.empty(0, np.int64)
    for level in range(width + 1):
        own = pos[cuts[level] : cuts[level + 1]] >> level
        here = np.union1d(own, up) if len(up) else own
        left = np.zeros(len(here), bool)
        if level < width and len(here) > 1:
            left[:-1] = (here[:-1] % 2 == 0) & (here[1:] == here[:-1] + 1)
        right = np.zeros(len(here), bool)
        right[1:] = left[:-1]
        stays = here[~(left | right)]
        done.append(stays << level)
        size.append(np.full(len(stays), np.int64(1) << level))
        up = here[left] >> 1
    start = np.concatenate([*done, points])
    stop = np.concatenate([*(d + s for d, s in zip(done, size, strict=True)), points])
    # adjacent blocks coalesce; points stay where nothing touches them
    order = np.lexsort((-stop, start))
    start, stop = start[order], stop[order]
    group = start >> width
    reach = np.maximum.accumulate(stop)
    opens = np.ones(len(start), bool)
    opens[1:] = (start[1:] > reach[:-1]) | (group[1:] != group[:-1])
    at = np.flatnonzero(opens)
    return start[at], reach[np.r_[at[1:], len(start)] - 1] if len(at) else at


def _merge(keys: list[str], top: int, out: pa.Schema):
    """Over pieces sorted by keys, chunk and a: the periods of each chunk."""
    width = max(top, STEP) + 1  # room for a point at the end of a chunk
    group_by = [*keys, "tier", "chunk", "salt"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        before: int | None = None  # the stop of the period before the one carried over

        def emit(tab: pa.Table, last: bool) -> tuple[pa.Table, pa.Table]:
            """Periods that no later piece can reach, and the last one of the last chunk as a piece."""
            nonlocal before
            first = starts(tab, group_by)
            group = np.repeat(np.arange(len(first), dtype=np.int64), np.diff(np.r_[first, tab.num_rows]))
            a, b = (tab[c].to_numpy().astype(np.int64) + (group << width) for c in "ab")
            start, stop = _coalesced(a[a < b], b[a < b], a[a == b], width)
            g = start >> width
            heads = np.r_[True, g[1:] != g[:-1]]
            prev = np.r_[0, stop[:-1]]
            no_prev = heads.copy()
            if before is not None:
                prev[0], no_prev[0] = before, False
            origin = g << width
            start, stop, prev = start - origin, stop - origin, prev - origin
            n = len(start) if last else len(start) - 1
            tier, chunk = (tab[c].to_numpy().astype(np.int64)[first] for c in ("tier", "chunk"))
            unit = _unit(tier, top)[g]
            base = (chunk << np.where(tier > 0, STEP, top))[g]
            done = tab.select([*keys, "tier", "chunk"]).take(pa.array(first[g[:n]]))
            for name, v, null in (("start", start, None), ("stop", stop, None), ("before", prev, no_prev)):
                done = done.append_column(name, pa.array((v + base << unit)[:n], pa.int64(), mask=None if null is None else null[:n]))
            rest = tab.slice(0, 0)
            if not last:
                before = None if no_prev[-1] else int(prev[-1])
                one = tab.slice(int(first[g[-1]]), 1)
                for c, v in (("a", start[-1]), ("b", stop[-1])):
                    one = one.set_column(one.schema.get_field_index(c), c, pa.array([v], one.schema.field(c).type))
                rest = one
            return done.select(out.names).cast(out), rest

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < ROWS:
                continue
            done, rest = emit(pa.Table.from_batches(held).combine_chunks(), False)
            yield from done.combine_chunks().to_batches()
            held, size = rest.combine_chunks().to_batches(), 1
        if size:
            yield from emit(pa.Table.from_batches(held).combine_chunks(), True)[0].combine_chunks().to_batches()

    return run


def chunk_periods(spans: DataFrame, keys: list[str], top: int = TOP) -> DataFrame:
    """Periods per keys and chunk of time, with the stop of the period before in the same chunk.

    spans: keys, start, stop (bigint, start <= stop, no nulls in start and stop;
    nulls in keys form keys of their own; further columns are ignored). Result:
    keys, tier (0, or more for whole chunks within long spans), chunk, start,
    stop, before, top. Written once to the shared folder, as it is used more
    than once. periods and gaps take it.
    """
    pieces = _pieces(spans, keys, top)
    order = [*keys, "tier", "chunk", "salt"]
    types = {f.name: f.dataType.simpleString() for f in spans.schema if f.name in keys}
    kinds = {k: types[k] for k in keys} | {"tier": "int", "chunk": "bigint", "start": "bigint", "stop": "bigint", "before": "bigint"}
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    merge = _merge(keys, top, pa.schema([(k, arrow[t]) for k, t in kinds.items()]))
    done = pieces.repartition(*order).sortWithinPartitions(*order, "a").mapInArrow(merge, ", ".join(f"`{k}` {t}" for k, t in kinds.items()))
    return written(done.withColumn("top", F.lit(top)), "periods")


def _ordered(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("start", F.col("stop").desc(), F.col("tier").desc())


def _earlier(what: Column, keys: list[str]) -> Column:
    return F.max(what).over(_ordered(keys).rowsBetween(Window.unboundedPreceding, -1))


def _chunk_ends(found: DataFrame, keys: list[str]) -> DataFrame:
    """A row per chunk of time with its first start and last stop, and the long periods; covered: all of the chunk lies in one of those."""
    fine = found.where("tier = 0").groupBy(*keys, "chunk", "top").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).withColumn("tier", F.lit(0))
    rows = fine.unionByName(found.where("tier > 0").select(*keys, "chunk", "top", "start", "stop", "tier"))
    rows = rows.withColumns({"reach": _earlier(F.col("stop"), keys), "long": _earlier(F.when(F.col("tier") > 0, F.col("stop")), keys)})
    return rows.withColumn("covered", F.expr("tier = 0 and coalesce(long >= shiftleft(chunk + 1, top), false)"))


def _uncovered(fine: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    gone = _chunk_ends(found, keys).where("covered").select(*keys, "chunk")
    same = F.expr(" and ".join([f"a.`{k}` <=> b.`{k}`" for k in keys] + ["a.chunk = b.chunk"]))
    return fine.alias("a").join(gone.alias("b"), same, "left_anti")


def gaps(found: DataFrame, keys: list[str]) -> DataFrame:
    """keys, gap_ts, gap_te: stretches of more than zero length between periods of chunk_periods."""
    inner = _uncovered(found.where("tier = 0 and before is not null"), found, keys).select(*keys, F.col("before").alias("gap_ts"), F.col("start").alias("gap_te"))
    outer = _chunk_ends(found, keys).select(*keys, F.col("reach").alias("gap_ts"), F.col("start").alias("gap_te")).where("gap_ts < gap_te")
    return inner.unionByName(outer)


def periods(found: DataFrame, keys: list[str]) -> DataFrame:
    """keys, start, stop of the maximal continuous periods; those at the edge of a chunk are joined."""
    edge = F.expr("tier > 0 or start = shiftleft(chunk, top) or stop >= shiftleft(chunk + 1, top)")
    inner = _uncovered(found.where(~edge), found, keys).select(*keys, "start", "stop")
    # at most two rows a chunk, and the long periods
    part = found.where(edge).withColumn("opens", F.coalesce((F.col("start") > _earlier(F.col("stop"), keys)).cast("int"), F.lit(1)))
    part = part.withColumn("no", F.sum("opens").over(_ordered(keys).rowsBetween(Window.unboundedPreceding, 0)))
    return inner.unionByName(part.groupBy(*keys, "no").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("no"))
