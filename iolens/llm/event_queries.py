"""Queries of problems 5, 6 and 7 and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from iolens.llm import bitmaps, percentiles, runs
from iolens.runtime import event_day, normal_form, records, table, written

GROUP = ["measure", "event_day", "name"]


def _day_counts(spark: SparkSession, d: str) -> DataFrame:
    cols = {"event_day": event_day(F.col("ts")), "name": normal_form(F.col("name")), "dur": F.col("dur"), "size": F.col("size")}
    rows = records(table(spark, d, "trace_events").where("ts is not null and (dur > 0 or size > 0)"), "event_id", cols)
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("v")) for m in ("dur", "size")]))
    rows = rows.select("event_day", "name", each.alias("m")).select("m.measure", "event_day", "name", "m.v").where("v > 0")
    return percentiles.value_counts(rows, GROUP, "v")


def p5_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return percentiles.percentiles(_day_counts(spark, d), GROUP, (50, 95, 99))


def p5_merged(spark: SparkSession, d: str) -> DataFrame:
    """Over all days, from counts written day by day as partitions of one table, and the last day's apart as a second delivery."""
    whole = ["measure", "name"]
    counts = written(_day_counts(spark, d), "days")
    last = counts.agg(F.max("event_day")).first()[0] or ""
    parts = [written(counts.where(F.col("event_day") != last), "earlier"), written(counts.where(F.col("event_day") == last), "last")]
    return percentiles.percentiles(percentiles.merged(parts, whole), whole, (50, 95, 99))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return percentiles.percentiles(_day_counts(spark, d), GROUP, (50, 95)).where("n >= 40 and p95 >= 8 * p50").select(*GROUP)


def _runs(spark: SparkSession, d: str) -> DataFrame:
    like = {"name": normal_form(F.col("name")), "file_pattern": F.regexp_replace("file_name", "[0-9]+", "#")}
    return runs.collapse_runs(table(spark, d, "trace_events"), ["pid", "tid"], like).withColumnRenamed("first_id", "first_event_id")


def p6_runs(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d).select("pid", "tid", "first_event_id", "name", "file_pattern", "first_ts", "n", "duration")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d).where("n >= 3").select("pid", "tid", "first_event_id")


def _pairs(spark: SparkSession, d: str, value: str, dims: dict) -> DataFrame:
    """dims, value, n: records per group and identifier."""
    rows = records(table(spark, d, "trace_events").where(f"ts is not null and {value} is not null"), "event_id", dims | {"value": F.col(value)})
    return rows.groupBy(*dims, "value").agg(F.count(F.lit(1)).alias("n_records"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    dims = {"event_day": event_day(F.col("ts")), "cat": normal_form(F.col("cat"))}
    coded = written(bitmaps.encoded(_pairs(spark, d, "file_name", dims), "value"), "coded")  # read twice
    distinct = bitmaps.counted(bitmaps.bitmaps(coded, list(dims)), list(dims))
    size = coded.groupBy(*dims).agg(F.sum("n_records").alias("n_records")).where("n_records >= 50")
    both = distinct.alias("a").join(size.alias("b"), F.expr("a.event_day = b.event_day and a.cat <=> b.cat"))
    return both.where("10 * a.n_distinct >= 3 * b.n_records").select("a.event_day", "a.cat")


def p7_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Distinct identifiers per combination of day, cat and host, united from the bitmaps of all three."""
    dims = {"event_day": event_day(F.col("ts")), "cat": normal_form(F.col("cat")), "host_hash": F.col("host_hash")}
    out = []
    for value in ("file_name", "proc_name", "host_name"):
        fine = bitmaps.bitmaps(bitmaps.encoded(_pairs(spark, d, value, dims), "value"), list(dims))
        sets = [F.struct(F.lit(g).alias("grouping"), *[(F.col(c) if g >> i & 1 == 0 else F.lit(None).cast("string")).alias(c) for i, c in enumerate(dims)]) for g in range(8)]
        coarse = fine.select(F.explode(F.array(*sets)).alias("g"), "shard", "hi", "bits").select("g.*", "shard", "hi", "bits")
        keys = ["grouping", *dims]
        out.append(bitmaps.counted(bitmaps.merge(coarse, keys), keys).withColumn("field_name", F.lit(value)))
    return reduce(DataFrame.unionByName, out)


QUERIES = {f.__name__: f for f in (p5_percentiles, p5_merged, p5_found, p6_runs, p6_found, p7_found, p7_distinct)}

_DAY = "strftime(make_timestamp(ts), '%Y-%m-%d')"
_V = f"""e AS (SELECT DISTINCT event_id, {_DAY} AS event_day, lower(trim(name)) AS name, dur, size FROM trace_events WHERE ts IS NOT NULL),
  m AS (SELECT 'dur' AS measure, event_day, name, dur AS v FROM e WHERE dur > 0 UNION ALL SELECT 'size', event_day, name, size FROM e WHERE size > 0)"""


def _ranks(keys: str, percents: tuple[int, ...]) -> str:
    picks = ", ".join(f"max(CASE WHEN rn = ({p} * k + 99) // 100 THEN v END) AS p{p}" for p in percents)
    return f"""WITH {_V}, o AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY v) AS rn, count(*) OVER (PARTITION BY {keys}) AS k FROM m)
      SELECT {keys}, count(*) AS n, {picks} FROM o GROUP BY {keys}"""


_RUNS = """e AS (SELECT DISTINCT event_id, pid, tid, ts, te, dur, lower(trim(name)) AS name, regexp_replace(file_name, '[0-9]+', '#', 'g') AS f
    FROM trace_events WHERE ts IS NOT NULL),
  s AS (SELECT *, CASE WHEN name IS NOT DISTINCT FROM lag(name) OVER w AND f IS NOT DISTINCT FROM lag(f) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS b
    FROM e WINDOW w AS (PARTITION BY pid, tid ORDER BY ts, event_id)),
  r AS (SELECT *, sum(b) OVER (PARTITION BY pid, tid ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS no FROM s)"""
_END = "greatest(ts, coalesce(te, ts + CASE WHEN dur > 0 THEN dur WHEN dur IS NOT NULL THEN 0 END, ts))"
_CUBE = " UNION ALL ".join(
    f"""SELECT CAST(grouping(event_day) + 2 * grouping(cat) + 4 * grouping(host_hash) AS INT) AS "grouping", event_day, cat, host_hash, count(DISTINCT {v}) AS n_distinct, '{v}' AS field_name
    FROM e WHERE {v} IS NOT NULL GROUP BY CUBE (event_day, cat, host_hash) HAVING count(*) > 0"""
    for v in ("file_name", "proc_name", "host_name")
)

SQL = {
    "p5_percentiles": _ranks("measure, event_day, name", (50, 95, 99)),
    "p5_merged": _ranks("measure, name", (50, 95, 99)),
    "p5_found": f"SELECT measure, event_day, name FROM ({_ranks('measure, event_day, name', (50, 95))}) WHERE n >= 40 AND p95 >= 8 * p50",
    "p6_runs": f"""WITH {_RUNS} SELECT pid, tid, arg_min(event_id, (ts, event_id)) AS first_event_id, any_value(name) AS name, any_value(f) AS file_pattern,
      min(ts) AS first_ts, count(*) AS n, max({_END}) - min(ts) AS duration FROM r GROUP BY pid, tid, no""",
    "p6_found": f"WITH {_RUNS} SELECT pid, tid, arg_min(event_id, (ts, event_id)) AS first_event_id FROM r GROUP BY pid, tid, no HAVING count(*) >= 3",
    "p7_found": f"""WITH e AS (SELECT DISTINCT event_id, {_DAY} AS event_day, lower(trim(cat)) AS cat, file_name FROM trace_events WHERE ts IS NOT NULL AND file_name IS NOT NULL)
      SELECT event_day, cat FROM e GROUP BY event_day, cat HAVING count(*) >= 50 AND 10 * count(DISTINCT file_name) >= 3 * count(*)""",
    "p7_distinct": f"WITH e AS (SELECT {_DAY} AS event_day, lower(trim(cat)) AS cat, host_hash, file_name, proc_name, host_name FROM trace_events WHERE ts IS NOT NULL) {_CUBE}",
}
