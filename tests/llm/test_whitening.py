"""Whitening against covariances by definition and numpy's own eigen-solver."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pytest

from strikeline.llm import whitening
from strikeline.llm.queries import QUERIES


@pytest.mark.parametrize("width", [1, 2, 3, 17, 64])
def test_symmetric_qr(width):
    rng = np.random.default_rng(width)
    for rank in {width, max(1, width // 2)}:
        a = rng.normal(size=(width, rank))
        v = a @ a.T
        values, vectors = whitening.symmetric_qr(v)
        assert np.allclose(values, np.linalg.eigvalsh(v)[::-1], atol=1e-12 * max(1, values[0]))
        assert np.allclose(vectors.T @ vectors, np.eye(width), atol=1e-13)
        assert np.allclose(vectors * values @ vectors.T, v, atol=1e-12 * max(1, values[0]))
    values, vectors = whitening.symmetric_qr(np.diag(np.arange(width, dtype=float)))
    assert np.array_equal(values, np.arange(width)[::-1])


def test_moments_are_exact_enough():
    """Large offsets, small spreads: what a sum of squares would lose."""
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 5, size=(300, 4)) + 10**9
    parts = [whitening.Moments.none(4) for _ in range(3)]
    for k, m in enumerate(parts):
        for start in range(k * 100, k * 100 + 100, 7):
            m.add(rows[start : min(start + 7, k * 100 + 100)])
    m = parts[0].merge(parts[1]).merge(whitening.Moments.none(4)).merge(parts[2])
    exact = [[sum((Fraction(int(a)) - Fraction(int(rows[:, i].sum()), 300)) * (Fraction(int(b)) - Fraction(int(rows[:, j].sum()), 300)) for a, b in zip(rows[:, i], rows[:, j], strict=True)) / 300 for j in range(4)] for i in range(4)]
    assert m.n == 300 and np.array_equal(m.sums, rows.sum(axis=0))
    assert np.allclose(m.covariance, np.array(exact, float), rtol=0, atol=1e-7)


def test_query(spark, sf_dir):
    given = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    x = np.floor(64 * np.array([v for _, v in given], float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    centred = x - s / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    want = centred @ vectors[:, :32] / np.sqrt(values[:32])
    at = {k: i for i, (k, _) in enumerate(given)}
    rows = QUERIES["op12_whitening"](spark, sf_dir).collect()
    assert len(rows) == n * 32
    got = np.zeros((n, 32))
    for r in rows:
        i = at[r.vec_id]
        got[i, r.component - 1] = r.whitened
        assert r.n == n and r.deviation == sum((n * int(a) - int(b)) ** 2 for a, b in zip(x[i], s, strict=True))
        assert abs(r.explained - values[r.component - 1] / values.sum()) < 1e-10 and r.identity_error < 1e-9
    sign = np.sign((got * want).sum(axis=0))
    assert np.allclose(got, want * sign, atol=1e-7)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, n string")


def test_poor_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], "a"), (1, [1.0, 2.0], "a"), (None, [3.0, -1.0], "b"), (4, None, "c"), (5, [1.0, None], "c"), (6, [nan, 0.0], "c"), (7, [0.0, -inf], "c"), (8, [], "c"), (9, [1.0], "c"), (10, [2.0**40, 1.0], "c"), (11, [None, None], "c")]
    out = whitening.whiten(frame(spark, rows).repartition(3)).collect()
    assert sorted((r.vec_id or 0, r.component) for r in out) == [(0, 1), (0, 2), (1, 1), (1, 1), (1, 2), (1, 2)]
    assert {r.n for r in out} == {3} and all((r.whitened is None) == (r.component == 2) for r in out)
    assert {r.explained for r in out if r.component == 2} == {0.0}


@pytest.mark.parametrize("rows", [[], [(1, None, "a")]])
def test_no_vectors(spark, rows):
    out = whitening.whiten(frame(spark, rows))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and out.collect() == []


def test_no_spread(spark):
    out = whitening.whiten(frame(spark, [(k, [1.0, 2.0, 3.0], "a") for k in range(4)])).collect()
    assert len(out) == 12 and all(r.whitened is None and r.deviation == 0 and r.explained == 0 and r.identity_error is None for r in out)


def test_many_states(spark):
    rng = np.random.default_rng(2)
    rows = [(k, [float(v) for v in rng.normal(size=3)], "a") for k in range(300)]
    one = {(r.vec_id, r.component): abs(r.whitened) for r in whitening.whiten(frame(spark, rows).coalesce(1)).collect()}
    many = {(r.vec_id, r.component): abs(r.whitened) for r in whitening.whiten(frame(spark, rows).repartition(40)).collect()}
    assert one.keys() == many.keys() and all(abs(one[k] - many[k]) < 1e-9 for k in one)


def test_deviations_beyond_a_long():
    model = whitening.Whitening(10**6, np.array([10**12, 10**12]), np.eye(2), np.ones(2))
    rows = np.array([[10**6, 10**6], [2**31, 0], [10**6 + 3, 10**6]])
    assert model.deviations(rows) == [0, None, 9 * 10**12]
