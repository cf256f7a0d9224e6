"""Whitening against dense linear algebra and exact integers."""

import math

import numpy as np
import pytest

from catalogq.llm import whitening as W

SCHEMA = "vec_id long, embedding array<double>, _x string, sums int"


def dense(vectors):
    """(integer rows, exact sums, covariance) of plain Python numbers."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    z = np.array([[(n * c - s) / n for c, s in zip(row, sums)] for row in x])
    return x, sums, z, z.T @ z / n


def check(got, ids, vectors, components):
    x, sums, z, covariance = dense(vectors)
    n = len(x)
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(components, int((values > 1e-11 * values[0]).sum()))
    assert len(got) == n * k and {r["n"] for r in got} == {n}
    assert max(r["identity_error"] for r in got) < 1e-9
    table = sorted((r["vec_id"], r["component"], r["deviation"], r["whitened"], r["explained"]) for r in got)
    for c in range(1, k + 1):
        rows = [r for r in table if r[1] == c]
        assert np.allclose([r[4] for r in rows], values[c - 1] / covariance.trace(), rtol=1e-9)
        want = z @ axes[:, c - 1] / math.sqrt(values[c - 1])
        order = sorted(range(n), key=lambda i: ids[i])
        mine, want = np.array([r[3] for r in rows]), want[order]
        sign = math.copysign(1, float(mine @ want))
        assert np.abs(mine - sign * want).max() < 1e-8
        exact = [sum((n * a - s) ** 2 for a, s in zip(x[i], sums)) for i in order]
        assert [r[2] for r in rows] == [e if e < 1 << 63 else None for e in exact]


@pytest.mark.parametrize("size, components", [(3, 32), (40, 7), (6, 6)])
def test_equals_dense_algebra(spark, size, components):
    draw = np.random.default_rng(size)
    vectors = (draw.standard_normal((150, size)) * np.linspace(5, 0.5, size)).tolist()
    rows = [(i, v, "a", 1) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = W.whiten(df, components=components).collect()
    check(got, list(range(150)), vectors, components)


def test_rows_without_a_whole_vector_and_other_lengths_go(spark):
    draw = np.random.default_rng(4)
    vectors = draw.standard_normal((20, 4)).tolist()
    bad = [None, [], [None, 1.0, 1.0, 1.0], [float("nan")] * 4, [1.0, float("-inf"), 0.0, 0.0], [1.0, 2.0]]
    rows = [(i, v, "a", 1) for i, v in enumerate(vectors)] + [(100 + i, v, None, None) for i, v in enumerate(bad)]
    check(W.whiten(spark.createDataFrame(rows, SCHEMA)).collect(), list(range(20)), vectors, 32)


def test_repeated_rows_null_ids_and_missing_rank(spark):
    base = [[0.0, 1.0, 5.0], [1.0, 0.0, 5.0], [3.0, 0.5, 5.0]]
    rows = [(None, base[0], "a", 1)] * 3 + [(1, base[1], "a", 1)] * 2 + [(2, base[2], "a", 1)]
    got = W.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 6 * 2 and {r["component"] for r in got} == {1, 2}
    assert len({(r["vec_id"], r["component"], round(r["whitened"], 12)) for r in got}) == 6
    assert sum(r["vec_id"] is None for r in got) == 6


@pytest.mark.parametrize("vectors", [[], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [None]])
def test_nothing_to_whiten_gives_no_rows(spark, vectors):
    rows = [(i, v, "a", 1) for i, v in enumerate(vectors)]
    assert W.whiten(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_huge_entries_are_exact_or_null(spark):
    vectors = [[1e6, 1.0], [-1e6, 2.0], [3.5e7, 4.0], [0.0, 1e7]]
    rows = [(i, v, "a", 1) for i, v in enumerate(vectors)]
    check(W.whiten(spark.createDataFrame(rows, SCHEMA)).collect(), list(range(4)), vectors, 2)
    rows = [(i, [c * 1e300 for c in v], "a", 1) for i, v in enumerate(vectors)]
    got = W.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert got and all(math.isfinite(r["whitened"]) for r in got) and any(r["deviation"] is None for r in got)


@pytest.mark.parametrize("kind", ["falling", "close", "negative"])
def test_solver_reaches_double_precision_on_large_matrices(kind):
    draw = np.random.default_rng(2)
    turn = np.linalg.qr(draw.standard_normal((300, 300)))[0]
    values = {"falling": 0.9 ** np.arange(300.0), "close": 1 + np.arange(300.0) * 1e-3, "negative": np.linspace(-1, 1, 300)}[kind]
    matrix = turn * values @ turn.T
    passes = []

    def product(block):
        passes.append(block.shape[1])
        return matrix @ block

    found, axes = W.leading(product, 300, 24)
    assert np.abs(found - np.sort(values)[::-1][:24]).max() < 1e-13 * np.abs(values).max()
    assert np.linalg.norm(matrix @ axes - axes * found, axis=0).max() < 1e-13 * np.abs(values).max()
    assert np.abs(axes.T @ axes - np.eye(24)).max() < 1e-13
    assert len(passes) < 200


def test_inner_minres_solves_indefinite_systems():
    draw = np.random.default_rng(5)
    half = draw.standard_normal((30, 30))
    matrix = half + half.T
    right = draw.standard_normal((30, 4))
    right[:, 2] = 0
    got = W._minres(lambda y: matrix @ y, right, 60, 1e-12)
    assert np.allclose(matrix @ got, right, atol=1e-8)
