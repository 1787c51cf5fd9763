import json
import random

import pytest

from iolens.operators import compaction as C

from .conftest import rows

KINDS = "file_id bigint, payload string, pid bigint, line string"


def line(host, pid, i, **more):
    return json.dumps({"id": i, "pid": pid, "args": {"hhash": host}} | more)


def test_every_record_once_whatever_the_lines_look_like(spark):
    a, b = line("h", 1, 1), line("h", 1, 2)
    odd = json.dumps({"args": {"hhash": "h"}, "pid": 1, "id": 3}, indent=None, separators=(" , ", " : "))
    payloads = [f"[\n{a},\r\n{b}\r\n]\n", a, f"  {odd} ,", b[:-3], "", None, "[\n]\n", "\n\n", f"{a} {b}", "[1, 2]", '{"id": 9}', "x" * 100_000 + "\n" + line("g", 1, 1, big="y" * 50_000)]
    df = spark.createDataFrame([(i, p, 5, "clash") for i, p in enumerate(payloads)], KINDS)
    folder = C.compact(df)
    got = C.read_compacted(spark, folder)
    assert rows(got, "host_hash", "pid", "record_id") == [(None, None, 9), ("g", 1, 1), ("h", 1, 1), ("h", 1, 2), ("h", 1, 3)]
    assert all(json.loads(r["line"]) for r in got.collect())


def test_records_without_a_whole_key_are_told_apart_by_their_lines(spark):
    lines = [json.dumps({"pid": 1, "args": {"hhash": "h"}, "ts": t} | more) for t in (1, 2) for more in ({}, {"id": "7"}, {"id": 7.5}, {"id": None})]
    lines += ['{"id": 3, "args": {"hhash": "h"}, "ts": 1}', '{"id": 3, "pid": 1, "ts": 1}', '{"id": 3, "pid": 1, "ts": 2}']
    payloads = ["[\n" + ",\n".join(lines) + "\n]", "\n".join(f"  {x} ," for x in reversed(lines))]
    folder = C.compact(spark.createDataFrame([(i, p, 5, "clash") for i, p in enumerate(payloads)], KINDS))
    assert rows(C.read_compacted(spark, folder), "line") == [(x,) for x in sorted(lines)]
    assert sum(m["n_records"] for m in C.read_manifest(folder)) == len(lines)


def test_groups_are_balanced_and_the_manifest_holds_every_record(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(i, "\n".join(line("h", i, j, pad="p" * rng.randrange(200)) for j in range(rng.randrange(30))), 0, "") for i in range(60)], KINDS)
    folder = C.compact(df, target=20_000)
    manifest = C.read_manifest(folder)
    sizes = [m["n_bytes"] for m in manifest]
    assert len(manifest) > 3 and max(sizes) < 1.5 * min(sizes)
    assert sum(m["n_records"] for m in manifest) == C.read_compacted(spark, folder).count() == C.distinct_records(df).count()


def test_longest_first_to_the_least_loaded(spark):
    sizes = spark.createDataFrame([(i, n) for i, n in enumerate([7, 6, 5, 4, 3])], "file_id bigint, n_bytes bigint")
    plan = {r["file_id"]: r["groups"][0] for r in C.plan_groups(sizes, 5, 2).collect()}
    loads = [sum(n for i, n in enumerate([7, 6, 5, 4, 3]) if plan[i] == g) for g in (0, 1)]
    assert sorted(loads) == [11, 14]


def test_nothing_to_keep(spark):
    folder = C.compact(spark.createDataFrame([(1, None, 1, "")], KINDS))
    assert C.read_manifest(folder) == [] and C.read_compacted(spark, folder).count() == 0


def test_a_lost_record_is_not_published(spark, monkeypatch):
    monkeypatch.setattr(C, "_publish", lambda *a: pytest.fail("published"))
    monkeypatch.setattr(C, "_write_groups", lambda folder: lambda batches: iter(()))
    with pytest.raises(RuntimeError, match="nothing was published"):
        C.compact(spark.createDataFrame([(1, line("h", 1, 1), 1, "")], KINDS))


def test_a_file_beyond_the_target_is_split(spark):
    big = "\n".join(line("h", 1, j, pad="p" * 200) for j in range(400))
    folder = C.compact(spark.createDataFrame([(1, big, 1, ""), (2, line("h", 2, 1), 1, ""), (None, line("h", 3, 1), 1, "")], KINDS), target=10_000)
    manifest = C.read_manifest(folder)
    assert len(manifest) >= 9 and max(m["n_bytes"] for m in manifest) < 20_000
    assert sum(m["n_records"] for m in manifest) == 402 == C.read_compacted(spark, folder).distinct().count()


def test_what_is_not_json_is_no_record(spark):
    bad = ['{"id": 1, "pid": 1, "args": {"hhash": "h"}, "x": NaN}', '{"id": 2, "pid": 1, "args": {"hhash": "h"}, "x": -Infinity}', "{'id': 3}", '{"id": 4,}', '{"id": 5} {"id": 6}']
    folder = C.compact(spark.createDataFrame([(1, "\n".join([*bad, line("h", 1, 7)]), 1, "")], KINDS))
    assert rows(C.read_compacted(spark, folder), "record_id") == [(7,)]
