import random

import pytest

from iolens.operators.gridding import to_grid

KINDS = "pid bigint, reading_id bigint, ts bigint, dur bigint, size bigint, n string"


def grid(spark, data, step=10):
    df = spark.createDataFrame([(*d, "x") for d in data], KINDS)
    return {(r["pid"], r["period_no"]): r for r in to_grid(df, "pid", step, ["dur", "size"], "reading_id").collect()}


def brute(data, step):
    out = {}
    for pid in {d[0] for d in data}:
        own = sorted((d[2], d[1], d[3], d[4]) for d in data if d[0] == pid and d[2] is not None and any(x is not None and x >= 0 for x in d[3:5]))
        if not own:
            continue
        cells = {c: [0, None, None] for c in range(own[0][0] // step, own[-1][0] // step + 1)}
        for r in own:
            cells[r[0] // step][0] += 1
        for m in (0, 1):
            last = None
            for r in own:
                v = r[2 + m]
                if v is None or v < 0:
                    continue
                if last:
                    t0, t1 = last[0], r[0]
                    inc = v if v < last[1] else v - last[1]
                    for c in range(t0 // step, t1 // step + 1):
                        if t1 == t0:
                            part = inc if c == t1 // step else 0
                        else:
                            upto = lambda x: max(0, min(t1, x) - t0) * inc // (t1 - t0)
                            part = upto((c + 1) * step) - upto(c * step)
                        cells[c][1 + m] = (cells[c][1 + m] or 0) + part
                last = (r[0], v)
        out |= {(pid, c): tuple(v) for c, v in cells.items()}
    return out


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    data = [(rng.choice([1, 2]), i, rng.choice([None, *[rng.randrange(-500, 6000)] * 9]), rng.choice([None, -1, rng.randrange(100)]), rng.choice([None, -3, rng.randrange(10**6)])) for i in range(120)]
    got = grid(spark, data)
    assert {k: (r["n_readings"], r["dur_inc"], r["size_inc"]) for k, r in got.items()} == brute(data, 10)
    assert all(r["missing"] == (r["n_readings"] == 0) for r in got.values())


def test_reset_shares_and_missing_cells(spark):
    got = grid(spark, [(1, 1, 5, 100, None), (1, 2, 35, 130, None), (1, 3, 38, 4, None)])
    assert [(k[1], r["dur_inc"], r["size_inc"], r["missing"]) for k, r in sorted(got.items())] == [(0, 5, None, False), (1, 10, None, True), (2, 10, None, True), (3, 5 + 4, None, False)]


def test_null_source_ties_and_empty(spark):
    got = grid(spark, [(None, 2, 7, 9, 0), (None, 1, 7, 4, 0)])
    assert [(r["n_readings"], r["dur_inc"]) for r in got.values()] == [(2, 5)]
    assert grid(spark, []) == {} == grid(spark, [(1, 1, None, 5, 5), (1, 2, 4, None, -2)])


def test_shares_are_exact_over_long_spans(spark):
    data = [(1, 1, 3, 0, None), (1, 2, 7_000_001, 999_999_937, None), (1, 3, 7_000_100, 999_999_999, 5)]
    got = grid(spark, data, 700)
    assert {k: (r["n_readings"], r["dur_inc"], r["size_inc"]) for k, r in got.items()} == brute(data, 700)


def test_one_wrong_time_gives_its_cells_from_many_rows(spark):
    df = spark.createDataFrame([(1, 1, 0, 5, None), (1, 2, 3_000_000_000, 9, None), (1, 3, 3_000_000_010, 9, None)], "pid bigint, reading_id bigint, ts bigint, dur bigint, size bigint")
    got = to_grid(df, "pid", 1000, ["dur", "size"], "reading_id")
    assert got.count() == 3_000_001 and got.where("missing").count() == 2_999_999 and got.selectExpr("sum(dur_inc)").first()[0] == 4
