import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from iolens.llm import bitmaps as B
from iolens.llm import percentiles as Q
from iolens.llm import runs as R

from ..conftest import rows


def nearest(values, p):
    v = sorted(values)
    return v[(p * len(v) + 99) // 100 - 1]


def test_percentiles_with_hot_group_nulls_and_ties(spark):
    rng = random.Random(3)
    data = [(rng.choice(["hot"] * 5 + ["b", None]), rng.choice([None, 0, 7, 7, -3, rng.randrange(50), rng.randrange(10**12)]), "x") for _ in range(900)]
    df = spark.createDataFrame(data, "g string, v bigint, part string")
    want = defaultdict(list)
    for g, v, _ in data:
        if v is not None:
            want[g].append(v)
    got = Q.percentiles(Q.value_counts(df, ["g"], "v"), ["g"], (1, 50, 95, 100)).collect()
    assert {r["g"]: tuple(r)[1:] for r in got} == {g: (len(v), *[nearest(v, p) for p in (1, 50, 95, 100)]) for g, v in want.items()}


def test_percentiles_of_days_combine(spark):
    df = spark.createDataFrame([(d, v) for d in (1, 2) for v in range(d * 50)], "day int, v bigint")
    parts = [Q.value_counts(df.where(F.col("day") == d), ["day"], "v") for d in (1, 2)]
    one = Q.percentiles(Q.merged([p.withColumn("day", F.lit(0)) for p in parts], ["day"]), ["day"], (50,))
    assert rows(one) == [(0, 150, nearest([*range(50), *range(100)], 50))]
    assert Q.percentiles(Q.value_counts(df.where("false"), ["day"], "v"), ["day"], (50,)).count() == 0


EVENTS = "pid bigint, tid bigint, ts bigint, te bigint, dur bigint, event_id bigint, name string, file string, n string"


def brute_runs(data, least):
    out, seen = [], set()
    kept = []
    for d in data:
        if d[2] is None or (d[5] is not None and d[5] in seen):
            continue
        seen.add(d[5])
        kept.append(d)
    kept.sort(key=lambda d: tuple((x is not None, x or 0) for x in (d[0], d[1], d[2], d[5])))
    for d in kept:
        end = max(d[2], d[3] if d[3] is not None else d[2] + max(d[4], 0) if d[4] is not None else d[2])
        if out and out[-1][0] == (d[0], d[1], d[6], d[7]):
            out[-1][2] += 1
            out[-1][4] = max(out[-1][4], end)
        else:
            out.append([(d[0], d[1], d[6], d[7]), d[5], 1, d[2], end])
    return sorted(((*k[:2], i, n, e - s) for k, i, n, s, e in out if n >= least), key=str)


@pytest.mark.parametrize("seed", range(4))
def test_runs_across_batches_and_partitions(spark, seed):
    rng = random.Random(seed)
    data = []
    for i in range(400):
        ts = rng.choice([None, *[rng.randrange(300)] * 8])
        data.append((rng.choice([1, 1, 1, 2, None]), rng.choice([1, 1, None]), ts, rng.choice([None, 5, 400]), rng.choice([None, -1, 30]), i, rng.choice(["a"] * 9 + ["b", None]), rng.choice(["f"] * 9 + [None]), "z"))
    data += data[:40]
    df = spark.createDataFrame(data, EVENTS)
    got = R.collapse_runs(df, ["pid", "tid"], {"name": F.col("name"), "file": F.col("file")})
    assert sorted((tuple(r) for r in got.select("pid", "tid", "first_id", "n", "duration").collect()), key=str) == brute_runs(data, 1)


def test_one_run_over_every_partition_and_none(spark):
    df = spark.createDataFrame([(1, 1, i, None, 1, i, "a", None, "z") for i in range(200)], EVENTS)
    like = {"name": F.col("name"), "file": F.col("file")}
    assert rows(R.collapse_runs(df, ["pid", "tid"], like), "first_id", "n", "last_ts", "duration") == [(0, 200, 199, 200)]
    assert R.collapse_runs(df.where("false"), ["pid", "tid"], like).count() == 0


@pytest.mark.parametrize("n", [0, 1, 4096, 4097, 65536])
def test_buckets_pack_and_unpack(n):
    low = np.sort(np.random.default_rng(n).permutation(65536)[:n])
    assert np.array_equal(B.unpack(B.pack(low)), low) and len(B.pack(low)) <= 8193


def test_union_and_intersection_of_buckets():
    a, b = B.pack(np.arange(0, 10000, 2)), B.pack(np.arange(0, 9000, 3))
    assert set(B.combine([a, b], "or")) == set(range(0, 10000, 2)) | set(range(0, 9000, 3))
    assert set(B.combine([a, b], "and")) == set(range(0, 10000, 2)) & set(range(0, 9000, 3))


def test_distinct_counts_merge_over_days_and_groups(spark):
    rng = random.Random(5)
    data = [(rng.choice(["d1", "d2", None]), rng.choice(["x", "y"]), f"id{rng.randrange(300)}") for _ in range(3000)]
    pairs = spark.createDataFrame(data, "day string, cat string, value string").groupBy("day", "cat", "value").agg(F.count(F.lit(1)).alias("n"))
    fine = B.bitmaps(B.encoded(pairs, "value"), ["day", "cat"])
    count = lambda key: {k: len({v for *x, v in data if key(x) == k}) for k in {key(d[:2]) for d in data}}
    assert {(r["day"], r["cat"]): r["n_distinct"] for r in B.counted(fine, ["day", "cat"]).collect()} == count(lambda x: tuple(x))
    assert {r["day"]: r["n_distinct"] for r in B.counted(B.merge(fine, ["day"]), ["day"]).collect()} == count(lambda x: x[0])
    one, two = (fine.where(F.col("cat") == c).drop("cat", "n") for c in "xy")
    both = B.counted(B.both(one.where("day = 'd1'"), two.where("day = 'd1'"), ["day"]), ["day"])
    assert rows(both) == [("d1", len({v for d, c, v in data if (d, c) == ("d1", "x")} & {v for d, c, v in data if (d, c) == ("d1", "y")}))]
    assert B.counted(B.bitmaps(B.encoded(pairs.where("false"), "value"), ["day"]), ["day"]).count() == 0


@pytest.mark.parametrize(("hot", "sent"), [(0, 10**6), (0, 2), (10**6, 1)])
def test_a_hot_identifier_is_counted_once_a_group(spark, monkeypatch, hot, sent):
    monkeypatch.setattr(B, "LEAST_HOT", hot)
    monkeypatch.setattr(B.runtime, "BROADCAST_ROWS", sent)
    pairs = spark.createDataFrame([(f"g{i}", "hot") for i in range(400)] + [(f"g{i % 3}", f"v{i}") for i in range(50)] + [("g0", None)], "g string, value string")
    coded = B.encoded(pairs.distinct(), "value")
    assert coded.count() == 450 and coded.select("shard", "id").distinct().count() == 51
    fine = B.bitmaps(coded, ["g"])
    got = {r["g"]: r["n_distinct"] for r in B.counted(fine, ["g"]).collect()}
    assert got == {f"g{i}": 1 + (len(range(i, 50, 3)) if i < 3 else 0) for i in range(400)}
    whole = B.counted(B.merge(fine.withColumn("all", F.lit("x")), ["all"]), ["all"])
    assert rows(whole) == [("x", 51)]


def test_a_full_bucket_over_many_batches(spark):
    coded = spark.range(70_000).selectExpr("'g' as g", "0 as shard", "id", "id % 5 as part")
    maps = B.bitmaps(coded, ["g", "part"])
    assert rows(B.counted(B.merge(maps, ["g"]), ["g"])) == [("g", 70_000)]
