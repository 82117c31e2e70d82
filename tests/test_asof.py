"""Nearest rows in time and sliding ranks against plain loops, with keys that are cut into stretches."""

from __future__ import annotations

import datetime
import random

import pytest

from strikeline.operators import asof

DAY = datetime.datetime(2024, 1, 1)


def at(minutes):
    return None if minutes is None else DAY + datetime.timedelta(minutes=minutes)


def frames(spark, seed, n=300):
    rng = random.Random(seed)
    keys = ["hot"] * 6 + ["a", "b", None]
    left = [(rng.choice(keys), k, None if k % 41 == 0 else rng.randint(0, 500)) for k in range(n)]
    right = [(rng.choice([*keys, "c"]), k, None if k % 37 == 0 else rng.randint(0, 500)) for k in range(n // 2)]
    make = lambda rows: spark.createDataFrame([(k, i, at(m)) for k, i, m in rows], "sym string, id long, at timestamp").repartition(3)
    return left, right, make(left), make(right)


def plain(left, right, tolerance, forward):
    out = {}
    for key, i, m in left:
        best = None
        for k, j, x in right:
            if k == key and m is not None and x is not None and (x >= m if forward else x <= m) and (tolerance is None or abs(x - m) <= tolerance):
                rank = (-x if forward else x, j)
                best = max(best, rank) if best else rank
        out[i] = best and best[1]
    return out


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize(("tolerance", "stretch"), [(None, 10**6), (7, 10**6), (None, 20), (7, 20)])
def test_against_all_pairs(spark, forward, tolerance, stretch):
    left, right, one, other = frames(spark, 1)
    got = asof.asof_join(one, other, ["sym"], "at", "at", "id", tolerance and tolerance * 60_000_000, forward, stretch).collect()
    assert {r.id: r.match and r.match.id for r in got} == plain(left, right, tolerance, forward) and len(got) == len(left)


def test_a_long_key_is_cut(spark):
    _, _, one, other = frames(spark, 2)
    rows = one.select("sym", asof.F.unix_micros("at").alias("_t")).filter("_t is not null")
    parts = {r.sym: r.n for r in asof._stretches(rows, ["sym"], 50).groupBy("sym").agg(asof.F.countDistinct("_part").alias("n")).collect()}
    assert parts["hot"] > 20 and parts["a"] == parts["b"] == 1
    largest = asof._stretches(rows, ["sym"], 50).filter("sym = 'hot'").groupBy("_part").count().agg({"count": "max"}).first()[0]
    assert largest < 30


def test_empty_sides(spark):
    _, _, one, other = frames(spark, 3)
    assert all(r.match is None for r in asof.asof_join(one, other.limit(0), ["sym"], "at", "at", "id").collect())
    assert asof.asof_join(one.limit(0), other, ["sym"], "at", "at", "id").collect() == []


@pytest.mark.parametrize(("size", "segment"), [(252, 4096), (10, 7), (5, 3), (30, 10)])
def test_ranks(spark, size, segment):
    rng = random.Random(size)
    rows = [(s, (DAY + datetime.timedelta(days=3 * k)).date(), None if rng.random() < 0.1 else rng.randint(0, 20) / 4) for s, n in (("x", 300), ("y", 40), ("z", 1)) for k in range(n)]
    df = spark.createDataFrame([*rows, (None, DAY.date(), 1.0), ("x", None, 1.0)], "symbol string, date date, iv double").repartition(4)
    got = {(r.symbol, r.date): (r.iv_rank, r.iv_percentile) for r in asof.rolling_rank(df, "symbol", "date", "iv", size, segment).collect()}
    assert len(got) == len(rows)
    for k, (s, d, v) in enumerate(rows):
        seen = [x for t, e, x in rows[max(0, k - size + 1) : k + 1] if t == s and x is not None]
        want = (None, None) if v is None else ((v - min(seen)) / (max(seen) - min(seen)) * 100 if max(seen) > min(seen) else 50.0, sum(x <= v for x in seen) / len(seen) * 100)
        assert got[s, d] == want, (s, d)
