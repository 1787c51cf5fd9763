import random

import pytest
from pyspark.sql import functions as F

from iolens.operators import skew
from iolens.runtime import records

from .conftest import rows

KINDS = "cat string, name string, dur bigint, n bigint, code bigint, extra string"


def stats(spark, data, **kw):
    df = spark.createDataFrame(data, KINDS)
    return {(r["field_name"], r["key_value"]): r for r in skew.keyed_stats(df, {"cat": F.col("cat"), "name": F.col("name")}, "dur", **kw).collect()}


def brute(values, p):
    v = sorted(x for x in values if x is not None)
    return v[(p * len(v) + 99) // 100 - 1] if v else None


def test_matches_brute_force_with_hot_key_nulls_and_extremes(spark):
    rng = random.Random(1)
    data = []
    for i in range(1500):
        cat = rng.choice(["hot"] * 6 + ["a", "b", None, f"rare{i}"])
        dur = rng.choice([None, -5, 0, 1, rng.randrange(10), rng.randrange(10**6), rng.randrange(10**15), 2**63 - 1, -(2**63) + 1])
        data.append((cat, rng.choice(["x", "y"]), dur, 7, 8, "z"))
    got = stats(spark, data, percents=(1, 50, 95, 100))
    for field, i in (("cat", 0), ("name", 1)):
        keys = {d[i] for d in data}
        assert {k for f, k in got if f == field} == keys
        for k in keys:
            own = [d[2] for d in data if d[i] == k]
            r = got[field, k]
            assert r["n"] == len(own) and r["n_values"] == sum(x is not None for x in own)
            assert [r[f"p{p}"] for p in (1, 50, 95, 100)] == [brute(own, p) for p in (1, 50, 95, 100)]


def test_no_values_ties_and_empty(spark):
    got = stats(spark, [("a", None, None, 1, 1, None), ("b", "x", 4, 1, 1, None), ("b", "x", 4, 1, 1, None)])
    assert got["cat", "a"]["p50"] is None and got["cat", "a"]["total"] is None
    assert (got["cat", "b"]["p50"], got["cat", "b"]["total"], got["name", None]["n"]) == (4, 8, 1)
    assert stats(spark, []) == {}


def test_heavy_keys_count_rows_with_null_keys_in_the_total(spark):
    data = [("a", "x", 1, 0, 0, "")] * 5 + [(None, "y", 1, 0, 0, "")] * 95
    df = spark.createDataFrame(data, KINDS)
    found = skew.heavy_keys(skew.keyed_stats(df, {"cat": F.col("cat"), "name": F.col("name")}, "dur"), 0.05)
    assert rows(found, "field_name", "key_value") == [("cat", "a"), ("name", "x"), ("name", "y")]


def test_records_count_copies_once_and_rows_without_id_each(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (None, "b"), (2, None)], "id bigint, v string")
    assert rows(records(df, "id", {"v": F.col("v")})) == [(None,), ("a",), ("b",), ("b",)]


@pytest.mark.parametrize("values", [[1, 2], [1023, 1024, 1025], list(range(3000))])
def test_refinement_ends_on_one_value(spark, values):
    got = stats(spark, [("k", "n", v, 0, 0, "") for v in values], percents=(50,))
    assert got["cat", "k"]["p50"] == brute(values, 50)


@pytest.mark.parametrize("limit", [1, 3, 10**6])
def test_any_number_of_keys_may_be_sent_to_the_rows(spark, monkeypatch, limit):
    monkeypatch.setattr(skew.runtime, "BROADCAST_ROWS", limit)
    rng = random.Random(3)
    hot = [("hot", "n", 2**40 + rng.randrange(2**35), 0, 0, "") for _ in range(600)]  # one code
    data = hot + [(rng.choice("abc"), "n", rng.randrange(10**6), 0, 0, "") for _ in range(300)]
    got = stats(spark, data, percents=(5, 50))
    for k in ("hot", "a", "b", "c"):
        own = [d[2] for d in data if d[0] == k]
        assert (got["cat", k]["p5"], got["cat", k]["p50"]) == (brute(own, 5), brute(own, 50))


def test_values_of_a_hot_key_are_not_shuffled(spark, monkeypatch):
    """Ten keys may be sent: the hot key's ranks come from counts, at most SPLITS rows a range and task."""
    monkeypatch.setattr(skew.runtime, "BROADCAST_ROWS", 10)
    sizes = []
    plain = skew._narrowed
    monkeypatch.setattr(skew, "_narrowed", lambda parts, *a: (sizes.append(parts.where("key_value = 'hot'").groupBy("code").count().agg(F.max("count")).first()[0] or 0), plain(parts, *a))[1])
    data = [("hot", "n", 2**40 + i * 7, 0, 0, "") for i in range(5000)]
    got = stats(spark, data, percents=(50,))
    assert got["cat", "hot"]["p50"] == brute([d[2] for d in data], 50) and max(sizes) <= skew.SPLITS
