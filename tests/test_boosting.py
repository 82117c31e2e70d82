"""Quantile boosting against a plain implementation, and its coverage on a frame of known spread."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from strikeline.operators import boosting


def rank(values, q):
    return sorted(values)[max(0, math.ceil(q * len(values)) - 1)]


def plain(rows, cuts, q, trees, depth, rate, least):
    """rows of (features, y): predictions after the rounds, by one recursion a tree."""
    at = [rank([y for _, y in rows], q)] * len(rows)

    def grow(own, level):
        if level < depth:
            best, gain = None, 1e-12
            g = lambda part: sum(q if rows[i][1] > at[i] else q - 1 for i in part)
            for f, cut in enumerate(cuts):
                for c in cut:
                    left = [i for i in own if rows[i][0][f] is None or rows[i][0][f] <= c]
                    right = [i for i in own if i not in set(left)]
                    if len(left) < least or len(right) < least:
                        continue
                    better = g(left) ** 2 / len(left) + g(right) ** 2 / len(right) - g(own) ** 2 / len(own)
                    if better > gain * (1 + 1e-9):
                        best, gain = (left, right), better
            if best:
                return {**grow(best[0], level + 1), **grow(best[1], level + 1)}
        value = rank([rows[i][1] - at[i] for i in own], q)
        return dict.fromkeys(own, value)

    for _ in range(trees):
        leaf = grow(list(range(len(rows))), 0)
        at = [a + rate * leaf[i] for i, a in enumerate(at)]
    return at


def test_against_a_plain_tree(spark):
    rng = random.Random(5)
    rows = [((rng.randint(0, 6), None if rng.random() < 0.1 else rng.random()), rng.random() * 4) for _ in range(150)]
    rows = [((a, b), y + a * (b or 0)) for (a, b), y in rows]
    df = spark.createDataFrame([(k, float(a), b, y) for k, ((a, b), y) in enumerate(rows)], "k int, a double, b double, target double").repartition(3)
    models = boosting.fit(df, ["a", "b"], trees=3, depth=2, rate=0.5, bins=6, least=5)
    cuts = list(boosting.edges(df, ["a", "b"], 6).values())
    got = {r.k: r for r in models.predict(df, ["k"]).collect()}
    for name, q in boosting.BANDS.items():
        for k, want in enumerate(plain(rows, cuts, q, 3, 2, 0.5, 5)):
            assert abs(got[k][name] - want) < 1e-9, (name, k)


@pytest.fixture(scope="module")
def known(spark):
    """Targets uniform over [x, 3x + 1] of their feature x, so that the spread depends on it."""
    rows = spark.range(24_000).select(F.col("id"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 250).alias("x"), (F.pmod(F.xxhash64(F.col("id") + 10**6), F.lit(10_000)) / 10_000).alias("u"))
    return rows.select("id", "x", F.lit(1.0).alias("constant"), (F.col("x") + F.col("u") * (2 * F.col("x") + 1)).alias("target"))


def test_coverage(spark, known):
    train, test = known.filter("id % 3 > 0"), known.filter("id % 3 = 0")
    models = boosting.fit(train, ["x", "constant"], trees=15, depth=3, rate=0.3, bins=24)
    scored = models.predict(test, ["id"]).join(test, "id")
    inside = lambda lo, hi: F.avg(F.col("target").between(F.col(lo), F.col(hi)).cast("int"))
    low = F.col("x") < 1
    r = scored.agg(inside("band68_low", "band68_high").alias("a"), inside("band95_low", "band95_high").alias("b")).first()
    assert abs(r.a - 0.68) < 0.02 and abs(r.b - 0.95) < 0.02
    for part in (low, ~low):  # a constant band would cover the narrow part always and the wide one seldom
        r = scored.filter(part).agg(inside("band68_low", "band68_high").alias("a")).first()
        assert abs(r.a - 0.68) < 0.05


def test_a_missing_model_gives_null_bands(spark, known, tmp_path):
    models = boosting.fit(known.limit(500), ["x"], bands={"band68_low": 0.16, "band68_high": 0.84, "band95_low": 0.025}, trees=2, depth=1)
    models.save(spark, str(tmp_path), n_train=500, features="x")
    loaded = boosting.QuantileModels.load(spark, str(tmp_path))
    a, b = (m.predict(known.limit(50), ["id"]).collect() for m in (models, loaded))
    assert a == b and all(r.band68_low is not None and r.band95_low is None and r.band95_high is None for r in a)
    assert spark.read.parquet(f"{tmp_path}/model_meta").first().n_train == "500"


def test_edges_and_empty_frames(spark):
    df = spark.createDataFrame([(1.0, None, 5.0)] * 60, "a double, b double, target double")
    models = boosting.fit(df, ["a", "b"], trees=2, depth=2)
    assert {r.band68_low for r in models.predict(df, []).collect()} == {5.0}
    none = boosting.fit(df.limit(0), ["a", "b"])
    assert none.base == {} and none.predict(df.limit(1), []).first().band95_high is None


def test_time_split(spark):
    df = spark.range(1000).select(F.timestamp_seconds(F.col("id") * 60).alias("quote_ts"))
    first, last = boosting.early(df, "quote_ts", 0.85)
    assert abs(first.count() - 850) <= 1 and last.count() == 1000 - first.count()


def test_query_against_a_plain_tree(spark, sf_dir):
    """The registered query, on the whole table: predictions of the plain implementation for the newest rows."""
    from strikeline.operators import modelling
    from strikeline.plans.domain import EMKEY, FEATURES, LABELS
    from strikeline.plans.fixtures import Tables
    from strikeline.plans.stores import _quantile_bands

    t = Tables(spark, sf_dir)
    frame, features, _ = modelling.training_frame(FEATURES(t), LABELS(t), EMKEY)
    first, _ = boosting.early(frame, "quote_ts")
    train = [(tuple(None if r[f] is None else float(r[f]) for f in features), float(r.target)) for r in first.collect()]
    newest = modelling.latest_features(FEATURES(t)).select(*EMKEY, *features).collect()
    cuts = list(boosting.edges(first, features, 16).values())
    got = {tuple(r[k] for k in EMKEY): r for r in _quantile_bands(t).collect()}
    assert len(got) == len(newest)
    models = boosting.fit(first, features, trees=4, depth=2, rate=0.2, bins=16)
    on_train = {(x, y): r for (x, y), r in zip(train, models.predict(first, []).collect(), strict=True)}
    for name, q in boosting.BANDS.items():
        for row, want in zip(train, plain(train, cuts, q, 4, 2, 0.2, 20), strict=True):
            assert abs(on_train[row][name] - want) < 1e-9
    again = {tuple(r[k] for k in EMKEY): r for r in models.predict(modelling.latest_features(FEATURES(t)), EMKEY).collect()}
    assert got == again
