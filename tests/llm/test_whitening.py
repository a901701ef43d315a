"""Whitening against the covariance's eigenvectors from whole-matrix algebra."""

import math
import os
from fractions import Fraction

import numpy as np
import pytest

from corpusloom.llm import whitening as w

SF = "/root/testdata/sf0.001"
RNG = np.random.default_rng(5)
SCHEMA = "vec_id long, embedding array<float>, whitened string, x string"


def exact(vectors):
    """(n, sums, deviations, centred rows) in fractions."""
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors]
    n, total = len(x), [sum(c) for c in zip(*x)]
    return n, total, [sum((n * a - s) ** 2 for a, s in zip(r, total)) for r in x], np.array([[float(Fraction(n * a - s, n)) for a, s in zip(r, total)] for r in x])


def compare(model, got, vectors, k):
    n, total, deviations, y = exact(vectors)
    cov = y.T @ y / n
    e, c = np.linalg.eigh(cov)
    e, c = e[::-1][:k], c[:, ::-1][:, :k]
    assert model.n == n and model.total.tolist() == total and len(model.values) == k
    assert np.allclose(model.values, e, rtol=1e-9) and np.allclose(model.explained, e / np.trace(cov), rtol=1e-9)
    assert np.allclose(model.components @ cov @ model.components.T, np.diag(e), atol=1e-9 * e[0])
    want = y @ c / np.sqrt(e)
    mine = np.array([r["whitened"] for r in got])
    sign = np.sign((want * mine).sum(axis=0))
    assert np.abs(mine * sign - want).max() < 1e-6
    assert [r["deviation"] for r in got] == deviations
    assert model.identity_error < 1e-8
    assert np.abs(mine.T @ mine / n - np.eye(k)).max() < 1e-8


def applied(spark, vectors, k, repeat=3):
    df = spark.createDataFrame([(i, v if v is None else [None if c is None else float(c) for c in v], "s", "x") for i, v in enumerate(vectors)], SCHEMA).repartition(repeat)
    model = w.fit(df, components=k)
    return model, sorted(model.apply(df).collect(), key=lambda r: r["vec_id"]) if model else []


@pytest.mark.parametrize(("n", "d", "k"), [(300, 12, 5), (300, 12, 32), (40, 3, 32), (7, 3, 2)])
def test_components(spark, n, d, k):
    vectors = RNG.standard_normal((n, d)) * np.linspace(5, 0.5, d)
    vectors[: n // 3] = vectors[0]
    model, got = applied(spark, vectors, k)
    compare(model, got, vectors, min(k, d))


def test_steps_stop_early(spark):
    vectors = RNG.standard_normal((200, 40)) * 0.8 ** np.arange(40) * 1000
    model, got = applied(spark, vectors, 3)
    compare(model, got, vectors, 3)


def test_equal_values_and_lost_dimensions(spark):
    corners = np.array([[a, b, c, a, 7.0] for a in (-8, 8) for b in (-8, 8) for c in (-8, 8)] * 3)
    model, got = applied(spark, corners, 32)
    assert np.allclose(model.values, np.array([2, 1, 1]) * (64 * 8) ** 2, rtol=1e-12)
    mine = np.array([r["whitened"] for r in got])
    assert np.abs(mine.T @ mine / len(mine) - np.eye(3)).max() < 1e-12
    few, got = applied(spark, RNG.standard_normal((4, 9)), 32)
    assert len(few.values) == 3 and few.identity_error < 1e-9 and len(got) == 4


def test_odd_rows(spark):
    good = [list(v) for v in RNG.standard_normal((20, 4))]
    odd = [None, [], [1.0, None, 2.0, 3.0], [math.nan] * 4, [1.0, math.inf, 0.0, 0.0], [1.0, 2.0]]
    model, got = applied(spark, [*odd, *good, *good], 4)
    compare(model, got, [*good, *good], 4)
    assert [r["vec_id"] for r in got] == list(range(6, 46)) and got[0]["x"] == "x"
    for rows, n in (([], None), (odd[:5], None), ([[1.0, 2.0]], 1), ([[1.0, 2.0]] * 5, 5)):
        model, got = applied(spark, rows, 4)
        assert (model and model.n) == n and all(r["whitened"] == [] and r["deviation"] == 0 for r in got)


def test_integers_beyond_64_bits():
    x = np.array([[3 << 40, 5], [-(1 << 41), 7]])
    scaled = w._scaled(x, 1 << 30, np.array([1, 2]))
    assert scaled.tolist() == [[(3 << 70) - 1, (5 << 30) - 2], [-(1 << 71) - 1, (7 << 30) - 2]]
    assert w._deviation(np.array([[1 << 31, 1]])).tolist() == [(1 << 62) + 1]
    with pytest.raises(OverflowError):
        w._deviation(np.array([[1 << 32, 0]]))


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables are not here")
def test_query(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    got = w.op13_embedding_whitening(spark, SF).collect()
    n, _, deviations, y = exact([r["embedding"] for r in rows])
    e, c = np.linalg.eigh(y.T @ y / n)
    e, want = e[::-1], (y @ c[:, ::-1]) / np.sqrt(e[::-1])
    assert len(got) == 32 * n
    own = {(r["vec_id"], r["component"]): r for r in got}
    mine = np.array([[own[r["vec_id"], j + 1]["whitened"] for j in range(32)] for r in rows])
    assert np.abs(mine * np.sign((mine * want[:, :32]).sum(axis=0)) - want[:, :32]).max() < 1e-8
    assert [own[r["vec_id"], 1]["deviation"] for r in rows] == deviations
    assert np.allclose([own[rows[0]["vec_id"], j + 1]["explained"] for j in range(32)], e[:32] / e.sum(), rtol=1e-10)
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-9
