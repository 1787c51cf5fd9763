"""Queries of problems 1 to 4 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from iolens.operators import compaction, gridding, intervals, skew
from iolens.runtime import normal_form, records, table, written

FIVE_SECONDS = 5_000_000


FIELDS = ("cat", "name", "file_name")


def _events(spark: SparkSession, d: str) -> DataFrame:
    return records(table(spark, d, "trace_events"), "event_id", {"cat": normal_form(F.col("cat")), "name": normal_form(F.col("name")), "file_name": F.col("file_name"), "dur": F.col("dur")})


def p1_key_stats(spark: SparkSession, d: str) -> DataFrame:
    return skew.keyed_stats(written(_events(spark, d), "events"), {c: F.col(c) for c in FIELDS}, "dur").withColumn("total", F.expr("try_cast(total as bigint)"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """From the merged histograms alone: counts need no refinement."""
    totals = skew.key_totals(skew.histograms(_events(spark, d), {c: F.col(c) for c in FIELDS}, "dur"))
    return skew.heavy_keys(totals, 0.05).select("field_name", "key_value")


def _spans(spark: SparkSession, d: str) -> DataFrame:
    rows = records(table(spark, d, "app_spans"), "span_id", {"pid": F.col("pid"), "cat": normal_form(F.col("cat")), "start": F.col("ts"), "stop": F.coalesce("te", F.expr("try_add(ts, dur)"))})
    return rows.where("cat is not null and start <= stop")


def p2_periods(spark: SparkSession, d: str) -> DataFrame:
    found = intervals.chunk_periods(_spans(spark, d), ["pid", "cat"])
    return intervals.periods(found, ["pid", "cat"]).selectExpr("pid", "cat", "start as period_ts", "stop as period_te")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return intervals.gaps(intervals.chunk_periods(_spans(spark, d), ["pid", "cat"]), ["pid", "cat"])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    folder = compaction.compact(table(spark, d, "trace_files"))
    return compaction.read_compacted(spark, folder).select("host_hash", "pid", "record_id").distinct()  # records without a whole key share theirs


def p3_manifest(spark: SparkSession, d: str) -> DataFrame:
    groups = compaction.read_manifest(compaction.compact(table(spark, d, "trace_files")))
    rows = [(m["group_no"], m["n_records"], m["n_bytes"]) for m in groups]
    return spark.createDataFrame(rows, "group_no bigint, n_records bigint, n_bytes bigint")


def p4_series(spark: SparkSession, d: str) -> DataFrame:
    cols = {c: F.col(c) for c in ("pid", "reading_id", "ts", "dur", "size")}
    readings = records(table(spark, d, "counter_samples"), "reading_id", cols)
    return gridding.to_grid(readings, "pid", FIVE_SECONDS, ["dur", "size"], "reading_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_series(spark, d).where("missing").select("pid", "period_no")


QUERIES = {f.__name__: f for f in (p1_key_stats, p1_found, p2_periods, p2_found, p3_found, p3_manifest, p4_series, p4_found)}

_EVENTS = "SELECT DISTINCT event_id, lower(trim(cat)) AS cat, lower(trim(name)) AS name, file_name, dur FROM trace_events"
_MELT = f"""e AS ({_EVENTS}), m AS (
  SELECT 'cat' AS field_name, cat AS key_value, dur AS v FROM e UNION ALL
  SELECT 'name', name, dur FROM e UNION ALL SELECT 'file_name', file_name, dur FROM e)"""
_SPANS = """s AS (SELECT DISTINCT span_id, pid, lower(trim(cat)) AS cat, ts, coalesce(te, ts + dur) AS te FROM app_spans),
  u AS (SELECT * FROM s WHERE cat IS NOT NULL AND ts <= te),
  o AS (SELECT pid, cat, ts, te, max(te) OVER (PARTITION BY pid, cat ORDER BY ts, te DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM u)"""
_READ = f"""r AS (SELECT DISTINCT reading_id, pid, ts FROM counter_samples WHERE ts IS NOT NULL AND (dur >= 0 OR size >= 0)),
  c AS (SELECT DISTINCT pid, CAST(floor(ts / {FIVE_SECONDS}) AS BIGINT) AS p FROM r)"""
_USABLE = """r AS (SELECT DISTINCT reading_id, pid, ts, CASE WHEN dur >= 0 THEN dur END AS dur, CASE WHEN size >= 0 THEN size END AS size
    FROM counter_samples WHERE ts IS NOT NULL AND (dur >= 0 OR size >= 0))"""


def _increments(m: str) -> str:
    """Per pid and cell the share of each increment of a counter, in whole numbers."""
    cell = lambda t: f"CAST(floor({t} / {FIVE_SECONDS}) AS BIGINT)"
    upto = lambda c: f"(CAST(inc AS HUGEINT) * greatest(0, least(ts, {c} * {FIVE_SECONDS}) - t0)) // (ts - t0)"
    return f"""l_{m} AS (SELECT pid, ts, {m} AS v, lag(ts) OVER w AS t0, lag({m}) OVER w AS v0 FROM r WHERE {m} IS NOT NULL WINDOW w AS (PARTITION BY pid ORDER BY ts, reading_id)),
  c_{m} AS (SELECT pid, ts, t0, CASE WHEN v < v0 THEN v ELSE v - v0 END AS inc, unnest(range(CASE WHEN ts = t0 THEN {cell('ts')} ELSE {cell('t0')} END, {cell('ts')} + 1)) AS c FROM l_{m} WHERE t0 IS NOT NULL),
  s_{m} AS (SELECT pid, c, CAST(sum(CASE WHEN ts = t0 THEN inc ELSE {upto('(c + 1)')} - {upto('c')} END) AS BIGINT) AS inc FROM c_{m} GROUP BY ALL)"""


_LINES = """l AS (SELECT unnest(string_split(payload, chr(10))) AS line FROM trace_files),
  t AS (SELECT rtrim(trim(line, chr(13) || chr(9) || ' '), ', ') AS t FROM l),
  j AS (SELECT CASE WHEN t LIKE '{%' AND json_valid(t) THEN t END AS j FROM t)"""

_TARGET, _LEAST = compaction.TARGET, compaction.LEAST_GROUPS
# the lines as the operator cleans them, one of each record, sizes by file, and the files one after another to the least loaded group
_MANIFEST = f"""WITH RECURSIVE l AS (SELECT file_id, unnest(string_split(payload, chr(10))) AS line, generate_subscripts(string_split(payload, chr(10)), 1) AS line_no FROM trace_files),
  t AS (SELECT file_id, line_no, regexp_replace(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), '\\s*,$', '') AS t FROM l),
  j AS (SELECT *, CAST(t->'args'->>'hhash' AS VARCHAR) AS h, CAST(t->>'pid' AS BIGINT) AS pid, CAST(t->>'id' AS BIGINT) AS id FROM t WHERE t LIKE '{{%' AND json_valid(t)),
  k AS (SELECT arg_min({{'f': file_id, 't': t}}, (file_id, line_no)) AS r FROM j GROUP BY h, pid, id, CASE WHEN h IS NULL OR pid IS NULL OR id IS NULL THEN t END),
  s AS (SELECT r.f AS f, sum(strlen(r.t)) AS b, count(*) AS n, row_number() OVER (ORDER BY sum(strlen(r.t)) DESC, r.f) AS i FROM k GROUP BY r.f),
  g AS (SELECT greatest(1, least(count(*), {_LEAST}), (sum(b) + {_TARGET} - 1) // {_TARGET})::INT AS g FROM s),
  w AS (SELECT 0::BIGINT AS i, list_transform(range(g), lambda x: 0::BIGINT) AS load, 0 AS at FROM g
    UNION ALL SELECT s.i, list_transform(range(len(load)), lambda x: load[x + 1] + CASE WHEN x + 1 = list_position(load, list_min(load)) THEN s.b::BIGINT ELSE 0 END), list_position(load, list_min(load)) FROM w JOIN s ON s.i = w.i + 1)
  SELECT (w.at - 1)::BIGINT AS group_no, sum(s.n)::BIGINT AS n_records, sum(s.b)::BIGINT AS n_bytes FROM w JOIN s USING (i) GROUP BY w.at"""

SQL = {
    "p1_key_stats": f"""WITH {_MELT}, g AS (
      SELECT field_name, key_value, count(*) AS n, count(v) AS n_values, CAST(sum(v) AS BIGINT) AS total FROM m GROUP BY ALL),
    o AS (SELECT field_name, key_value, v, row_number() OVER (PARTITION BY field_name, key_value ORDER BY v) AS rn,
             count(*) OVER (PARTITION BY field_name, key_value) AS k FROM m WHERE v IS NOT NULL),
    q AS (SELECT field_name, key_value, max(CASE WHEN rn = (50 * k + 99) // 100 THEN v END) AS p50,
             max(CASE WHEN rn = (95 * k + 99) // 100 THEN v END) AS p95 FROM o GROUP BY ALL)
    SELECT g.*, q.p50, q.p95 FROM g LEFT JOIN q ON g.field_name = q.field_name AND g.key_value IS NOT DISTINCT FROM q.key_value""",
    "p1_found": f"""WITH {_MELT} SELECT field_name, key_value FROM m WHERE key_value IS NOT NULL GROUP BY ALL
      HAVING count(*) >= 0.05 * (SELECT count(*) FROM e)""",
    "p2_periods": f"""WITH {_SPANS}, i AS (SELECT *, sum(CASE WHEN reach IS NULL OR ts > reach THEN 1 ELSE 0 END)
        OVER (PARTITION BY pid, cat ORDER BY ts, te DESC ROWS UNBOUNDED PRECEDING) AS no FROM o)
      SELECT pid, cat, min(ts) AS period_ts, max(te) AS period_te FROM i GROUP BY pid, cat, no""",
    "p2_found": f"WITH {_SPANS} SELECT pid, cat, reach AS gap_ts, ts AS gap_te FROM o WHERE reach < ts",
    "p3_found": f"""WITH {_LINES} SELECT DISTINCT j->'args'->>'hhash' AS host_hash, CAST(j->>'pid' AS BIGINT) AS pid, CAST(j->>'id' AS BIGINT) AS record_id
      FROM j WHERE j IS NOT NULL""",
    "p3_manifest": _MANIFEST,
    "p4_series": f"""WITH {_USABLE}, {_increments('dur')}, {_increments('size')},
      p AS (SELECT pid, CAST(floor(ts / {FIVE_SECONDS}) AS BIGINT) AS p FROM r), n AS (SELECT pid, p, count(*) AS n FROM p GROUP BY ALL),
      g AS (SELECT pid, unnest(range(min(p), max(p) + 1)) AS period_no FROM p GROUP BY pid)
    SELECT g.pid, g.period_no, coalesce(n.n, 0) AS n_readings, a.inc AS dur_inc, b.inc AS size_inc, n.n IS NULL AS missing FROM g
      LEFT JOIN n ON n.pid IS NOT DISTINCT FROM g.pid AND n.p = g.period_no LEFT JOIN s_dur a ON a.pid IS NOT DISTINCT FROM g.pid AND a.c = g.period_no
      LEFT JOIN s_size b ON b.pid IS NOT DISTINCT FROM g.pid AND b.c = g.period_no""",
    "p4_found": f"""WITH {_READ}, n AS (SELECT pid, p, lead(p) OVER (PARTITION BY pid ORDER BY p) AS q FROM c)
      SELECT pid, unnest(range(p + 1, q)) AS period_no FROM n WHERE q > p + 1""",
}
