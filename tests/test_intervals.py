import random

import pytest

from iolens.operators import intervals as I

from .conftest import rows

KINDS = "pid bigint, cat string, start bigint, stop bigint, chunk string, level int"


def brute(spans):
    periods, gaps = [], []
    reach = None
    for a, b in sorted(spans, key=lambda s: (s[0], -s[1])):
        if reach is None or a > reach:
            if reach is not None:
                gaps.append((reach, a))
            periods.append([a, b])
            reach = b
        elif b > reach:
            reach = periods[-1][1] = b
    return [tuple(p) for p in periods], gaps


def both(spark, data, least):
    df = spark.createDataFrame([(*d, "x", 3) for d in data], KINDS)
    found = I.chunk_periods(df, ["pid", "cat"], least)
    return rows(I.periods(found, ["pid", "cat"])), rows(I.gaps(found, ["pid", "cat"]))


@pytest.mark.parametrize("seed", range(4))
def test_random_spans_across_chunks(spark, seed, monkeypatch):
    monkeypatch.setattr(I, "ROWS", 9)
    rng = random.Random(seed)
    data = []
    for pid, cat in [(1, "a"), (1, None), (None, "a"), (2, "b")]:
        for _ in range(rng.randrange(1, 60)):
            a = rng.randrange(-300, 900)
            data.append((pid, cat, a, a + rng.choice([0, 0, 1, 2, rng.randrange(20), rng.randrange(200)])))
    periods, gaps = both(spark, data + data[:5], rng.choice([2, 4, 6]))
    want_p, want_g = [], []
    for key in {d[:2] for d in data}:
        p, g = brute([d[2:] for d in data if d[:2] == key])
        want_p += [(*key, *x) for x in p]
        want_g += [(*key, *x) for x in g]
    order = lambda v: sorted(v, key=lambda r: tuple((x is not None, str(type(x)), x if x is not None else 0) for x in r))
    assert periods == order(want_p)
    assert gaps == order(want_g)


def test_touching_ends_leave_no_gap_and_a_point_divides_one(spark):
    periods, gaps = both(spark, [(1, "a", 0, 5), (1, "a", 5, 9), (1, "a", 12, 12), (1, "a", 20, 21)], 3)
    assert periods == [(1, "a", 0, 9), (1, "a", 12, 12), (1, "a", 20, 21)]
    assert gaps == [(1, "a", 9, 12), (1, "a", 12, 20)]


def test_an_absurdly_long_span(spark):
    periods, gaps = both(spark, [(1, "a", 0, 2**61), (1, "a", 2**61 + 7, 2**61 + 9)], 4)
    assert periods == [(1, "a", 0, 2**61), (1, "a", 2**61 + 7, 2**61 + 9)]
    assert gaps == [(1, "a", 2**61, 2**61 + 7)]


@pytest.mark.parametrize("seed", range(3))
def test_long_and_short_spans_of_all_tiers(spark, seed, monkeypatch):
    monkeypatch.setattr(I, "ROWS", 25)
    monkeypatch.setattr(I, "STEP", 2)
    rng = random.Random(seed)
    data = [(rng.choice([1, None]), "a", a := rng.randrange(-(2**20), 2**20), a + rng.choice([0, 1, rng.randrange(2 ** rng.randrange(1, 17))])) for _ in range(150)]
    data += [(1, "a", -(2**63), -(2**62)), (1, "a", 2**63 - 9, 2**63 - 1), (1, "a", 0, 2**14), (1, "a", 2**14, 2**15)]
    periods, gaps = both(spark, data, 4)
    want = {k: brute([d[2:] for d in data if d[0] == k]) for k in (1, None)}
    assert periods == [(k, "a", *x) for k in (None, 1) for x in want[k][0]]
    assert gaps == [(k, "a", *x) for k in (None, 1) for x in want[k][1]]


def test_sentinel_ends_beside_very_many_entities(spark):
    n = 20_000
    data = [(i, "a", 10**15 + i, 10**15 + i + 5) for i in range(n)] + [(i, "a", 10**15 - 50, 2**62) for i in range(0, n, 2000)] + [(i, "a", 0, 3) for i in range(n)]
    periods, gaps = both(spark, data, I.TOP)
    assert len(periods) == 2 * n and len(gaps) == n
    assert [p for p in periods if p[0] == 2000] == [(2000, "a", 0, 3), (2000, "a", 10**15 - 50, 2**62)]
    assert [g for g in gaps if g[0] == 2001] == [(2001, "a", 3, 10**15 + 2001)]


def test_pieces_are_at_most_two_a_span_and_chunk_tier(spark):
    spans = spark.createDataFrame([(1, "a", 5 + i, 2**30 * 3 + i) for i in range(50)], "pid bigint, cat string, start bigint, stop bigint")
    assert I._pieces(spans, ["pid", "cat"], I.TOP).count() <= 3 * 50
    short = spark.createDataFrame([(1, "a", 2**30 * i - 3, 2**30 * i + 3) for i in range(50)], "pid bigint, cat string, start bigint, stop bigint")
    assert I._pieces(short, ["pid", "cat"], I.TOP).count() == 100


def test_empty(spark):
    assert both(spark, [], 4) == ([], [])
