"""Irregular counter readings onto a regular grid.

Method: for cumulative counters, resets are detected (a reading below the one
before starts again from 0), consecutive readings are differenced, and each
increment is distributed over the grid cells it spans in proportion to the
overlap; cells between a source's first and last reading without a reading are
marked. A reading gives stretches of cells (its own, those since the reading
before, those an increment spans); a stretch is cut into pieces of at most
PIECE cells, which are shuffled by source and place and only then become cells,
so that one wrong time costs no task more than it can hold. Readings are handled in chunks of time: a window only ever runs over
one source's readings within one chunk, and the last reading of earlier chunks
comes in as a row of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells per chunk.
CHUNK = 64
#: 2**PIECE cells at most come from one row at once.
PIECE = 12

_CELL = "({0} div {1} - if({0} % {1} < 0, 1, 0))"


def _pieces(df: DataFrame) -> DataFrame:
    """Rows with first <= last as pieces, with _at (the piece's place), first and last cut to it; no row makes a long array."""
    wide = 2 * PIECE
    df = df.where("first <= last").withColumn("_w", F.explode(F.expr(f"sequence(shiftright(first, {wide}), shiftright(last, {wide}))")))
    lo, hi = f"greatest(first, shiftleft(_w, {wide}))", f"least(last, shiftleft(_w, {wide}) + {2**wide - 1}L)"
    df = df.withColumn("_at", F.explode(F.expr(f"sequence(shiftright({lo}, {PIECE}), shiftright({hi}, {PIECE}))"))).drop("_w")
    return df.withColumns({"first": F.expr(f"greatest(first, shiftleft(_at, {PIECE}))"), "last": F.expr(f"least(last, shiftleft(_at, {PIECE}) + {2**PIECE - 1}L)")})


def _share(step: int) -> str:
    """The whole-number part of inc for cell c of (t0, t1], by its overlap; parts add up to inc."""
    wide = lambda x: f"cast({x} as decimal(19,0))"
    upto = f"(greatest(0, {wide('least(t1, {})')} - {wide('t0')}) * {wide('inc')} div ({wide('t1')} - {wide('t0')}))"
    return f"if(t1 = t0, inc, {upto.format(f'(c + 1) * {step}L')} - {upto.format(f'c * {step}L')})"


def to_grid(readings: DataFrame, source: str, step: int, measures: list[str], order: str) -> DataFrame:
    """A row per source and grid cell from its first to its last usable reading.

    readings: source, order (an id breaking ties of ts), ts and the measures,
    all bigint, a row per record. A reading is usable if ts is not null and one
    measure at least is not null and not negative; such a value of a measure
    counts, others are as if absent. Result: source, period_no (floor(ts /
    step)), n_readings, <measure>_inc (whole-number increments that add up to
    the counter's increase; null where no two valid readings span the cell) and
    missing (no usable reading in the cell). A null source is one of its own;
    readings at equal ts follow each other by `order`; no usable readings, no rows.
    """
    ok = {m: F.col(m) >= 0 for m in measures}
    usable = readings.select(source, F.col(order).alias("id"), "ts", *[F.when(ok[m], F.col(m)).alias(m) for m in measures]).where("ts is not null").where(F.coalesce(*[F.col(m) for m in measures]).isNotNull())
    usable = usable.withColumns({"period_no": F.expr(_CELL.format("ts", step))})
    usable = usable.withColumn("chunk", F.floor(F.col("period_no") / CHUNK))
    pairs = {"q_any": F.struct("ts", "id", F.lit(0).cast("bigint").alias("v"))}
    pairs |= {f"q_{m}": F.when(F.col(m).isNotNull(), F.struct("ts", "id", F.col(m).alias("v"))) for m in measures}
    last = usable.groupBy(source, "chunk").agg(*[F.max(p).alias(n) for n, p in pairs.items()])
    before = Window.partitionBy(source).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)  # a row per chunk of time
    carry = last.select(source, "chunk", *[F.last(n, ignorenulls=True).over(before).alias(n) for n in pairs]).withColumns({"carried": F.lit(1)})
    rows = usable.withColumns(pairs | {"carried": F.lit(0)}).unionByName(carry, allowMissingColumns=True)
    prior = Window.partitionBy(source, "chunk").orderBy(F.desc("carried"), "ts", "id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("*", *[F.last(n, ignorenulls=True).over(prior).alias(f"p_{n}") for n in pairs]).where("carried = 0")
    made = lambda k, n, first, last, t0="null", inc="null": f"struct({k} as k, {n} as n, {first} as first, {last} as last, cast({t0} as bigint) as t0, ts as t1, cast({inc} as bigint) as inc)"
    stretches = [made(0, 1, "period_no", "period_no"), made(0, 0, _CELL.format("p_q_any.ts", step) + " + 1", "period_no - 1")]
    for k, m in enumerate(measures, 1):
        t0, v = f"p_q_{m}.ts", f"p_q_{m}.v"
        inc = f"if({m} < {v}, {m}, {m} - {v})"
        stretches.append(f"if({m} is not null and {t0} is not null, {made(k, 0, f'if(ts = {t0}, period_no, {_CELL.format(t0, step)})', 'period_no', t0, inc)}, null)")
    spans = rows.select(source, F.explode(F.expr(f"array({', '.join(stretches)})")).alias("s")).select(source, "s.*")
    cells = _pieces(spans).repartition(source, "_at").withColumn("c", F.explode(F.expr("sequence(first, last)")))
    sums = [F.expr(f"sum(if(k = {k}, {_share(step)}, null)) as `{m}_inc`") for k, m in enumerate(measures, 1)]
    out = cells.groupBy(source, "_at", F.col("c").alias("period_no")).agg(F.sum("n").cast("bigint").alias("n_readings"), *sums).drop("_at")  # no further shuffle
    return out.withColumns({f"{m}_inc": F.col(f"{m}_inc").cast("bigint") for m in measures}).withColumn("missing", F.col("n_readings") == 0)
