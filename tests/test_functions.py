from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from strikeline.functions import expressions as X
from strikeline.functions import pricing as P

C = F.col


@pytest.fixture(scope="module")
def options(spark):
    rows = [(call, s, k, t, 0.05, q, v) for call in (True, False) for s in (80.0, 100.0, 125.0) for k in (90.0, 100.0) for t in (0.02, 0.25, 1.0) for q in (0.0, 0.02) for v in (0.1, 0.2, 0.6)]
    return spark.createDataFrame(rows, "call boolean, s double, k double, t double, r double, q double, v double")


def args():
    return [C(c) for c in "sktrqv"]


def test_known_price(spark):
    row = spark.range(1).select(P.price(F.lit(True), F.lit(100.0), F.lit(100.0), F.lit(0.25), F.lit(0.05), F.lit(0.0), F.lit(0.2))).first()
    assert row[0] == pytest.approx(4.61499, abs=1e-4)


def test_put_call_parity(options):
    both = options.select(P.price(F.lit(True), *args()).alias("c"), P.price(F.lit(False), *args()).alias("p"), *"sktrq").collect()
    for r in both:
        assert r.c - r.p == pytest.approx(r.s * math.exp(-r.q * r.t) - r.k * math.exp(-r.r * r.t), abs=1e-4)


@pytest.mark.parametrize("solve", [P.implied_vol, P.implied_vol_bulk])
def test_implied_vol_recovers_vol(options, solve):
    priced = options.withColumn("m", P.price(C("call"), *args())).filter("m > 0.01 and t > 0.1")
    for r in priced.select(solve(C("m"), C("call"), *args()[:-1]).alias("iv"), "v", P.vega(*args()).alias("vega")).collect():
        assert r.iv == pytest.approx(r.v, abs=1e-5) or r.vega < 1e-4 or r.iv == 0.01


def test_implied_vol_edges(spark):
    rows = [(0.0, True, 100.0), (-1.0, True, 100.0), (None, True, 100.0), (5.0, True, 120.0), (99.9, True, 100.0), (3.0, True, None)]
    df = spark.createDataFrame(rows, "m double, c boolean, s double")
    terms = (C("m"), C("c"), C("s"), F.lit(100.0), F.lit(0.5), F.lit(0.01), F.lit(0.0))
    assert [r[0] for r in df.select(P.implied_vol(*terms)).collect()] == [None, None, None, 0.01, 5.0, None]
    assert [r[0] for r in df.select(P.implied_vol_bulk(*terms)).collect()] == [None, None, None, 0.01, 5.0, None]


def test_invalid_terms_are_null(spark):
    df = spark.createDataFrame([(100.0, 100.0, 0.0, 0.2), (100.0, 100.0, 1.0, 0.0), (-1.0, 100.0, 1.0, 0.2)], "s double, k double, t double, v double")
    assert [r[0] for r in df.select(P.price(F.lit(True), C("s"), C("k"), C("t"), F.lit(0.0), F.lit(0.0), C("v"))).collect()] == [None, None, None]


def test_rounding_and_missing(spark):
    df = spark.createDataFrame([(2.5, None), (-2.5, 0.0), (None, 1.0)], "x double, y double")
    got = df.select(X.round_half_up(C("x")), X.zero_as_missing(C("y")), X.intrinsic_value(F.lit(True), C("x"), F.lit(1.0))).collect()
    assert [tuple(r) for r in got] == [(3, None, 1.5), (-2, None, 0.0), (None, 1.0, None)]


@pytest.mark.parametrize(("text", "days"), [("30d", 30), (" 7D", 7), ("0d", 1), ("x", 90), ("", 90), (None, 90), ("12", 12)])
def test_window_days(spark, text, days):
    assert spark.createDataFrame([(text,)], "w string").select(X.window_days(C("w"))).first()[0] == days


def test_side_and_underlying(spark):
    df = spark.createDataFrame([("Call", "O:AAPL240119C"), ("put", "x"), (" p", None), ("?", "O:")], "s string, t string")
    assert [tuple(r) for r in df.select(X.side(C("s")), X.underlying_of(C("t"))).collect()] == [("C", "AAPL"), ("P", "UNKNOWN"), ("P", "UNKNOWN"), (None, "UNKNOWN")]


def test_values_together_and_alone_agree(spark):
    """The columns that share their parts, and the functions that do not, also where terms are invalid."""
    from strikeline.functions import pricing as P

    rows = [(c, s, 100.0, t, v) for c in (True, False) for s in (40.0, 99.0, 160.0, None, 0.0) for t in (0.0, 0.1, 2.0) for v in (0.05, 0.6, None, 0.0)]
    df = spark.createDataFrame(rows, "c boolean, s double, k double, t double, v double")
    terms = (F.col("s"), F.col("k"), F.col("t"), F.lit(0.05), F.lit(0.01), F.col("v"))
    names = ["price", "delta", "gamma", "theta", "vega", "rho"]
    sided = {"price", "delta", "theta", "rho"}
    alone = df.select("*", *[(getattr(P, n)(F.col("c"), *terms) if n in sided else getattr(P, n)(*terms)).alias(f"{n}_alone") for n in names])
    for r in P.valued(alone, names, F.col("c"), *terms).collect():
        for n in names:
            a, b = r[n], r[f"{n}_alone"]
            assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-12), (n, r)
