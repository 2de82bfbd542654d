"""Factors of tall matrices against numpy, ill-conditioned and rank-deficient ones included."""

import numpy as np
import pytest

from axisframe.operators import linalg as A


def table(spark, x, parts=3):
    return spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id long, x array<double>").repartition(parts)


def matrix(df, column):
    rows = df.select("id", column).collect()
    return np.array([r[column] for r in sorted(rows, key=lambda r: r["id"])])


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(A, "BLOCK", 12)  # some blocks have fewer rows than the matrix has columns
    monkeypatch.setattr(A, "FAN", 3)


def test_qr_of_a_matrix_whose_gram_matrix_is_singular_in_doubles(spark):
    rng = np.random.default_rng(1)
    u, _ = np.linalg.qr(rng.normal(size=(300, 8)))
    v, _ = np.linalg.qr(rng.normal(size=(8, 8)))
    x = u * np.logspace(0, -9, 8) @ v.T
    made, r = A.qr(table(spark, x), "x")
    q = matrix(made, "q")
    assert abs(q.T @ q - np.eye(8)).max() < 1e-10
    assert abs(q @ r - x).max() < 1e-12
    assert (np.diag(r) >= 0).all() and abs(np.tril(r, -1)).max() == 0
    made, s, v2 = A.svd(table(spark, x), "x")
    left = matrix(made, "u")
    assert s == pytest.approx(np.logspace(0, -9, 8), rel=1e-5)
    assert abs(left.T @ left - np.eye(8)).max() < 1e-10
    assert abs(left * s @ v2.T - x).max() < 1e-12


def test_rank_deficient(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(100, 4)) @ rng.normal(size=(4, 7))
    made, r = A.qr(table(spark, x), "x")
    q = matrix(made, "q")
    assert abs(q.T @ q - np.eye(7)).max() < 1e-10 and abs(q @ r - x).max() < 1e-11
    made, s, v = A.svd(table(spark, x), "x")
    assert len(s) == 4 and abs(matrix(made, "u") * s @ v.T - x).max() < 1e-11
    assert A.matrix_rank(table(spark, x), "x") == 4
    assert A.matrix_rank(table(spark, x * 0), "x") == 0
    b = x @ np.arange(7.0)
    df = spark.createDataFrame([(row.tolist(), float(y)) for row, y in zip(x, b, strict=True)], "x array<double>, y double")
    assert A.lstsq(df, "x", "y") == pytest.approx(np.linalg.lstsq(x, b, rcond=None)[0])


def test_pca(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 5)) * [9, 5, 1, 1, 0.5] + 1000
    scored, components, explained = A.pca(table(spark, x), "x", 2)
    values, vectors = A.eigh(np.cov(x.T))
    assert components == pytest.approx(vectors[:, :2], abs=1e-9)
    assert explained == pytest.approx(values[:2] / values.sum())
    assert np.cov(matrix(scored, "scores").T) == pytest.approx(np.diag(values[:2]), abs=1e-8)


def test_one_block_and_ragged_rows(spark):
    made, r = A.qr(table(spark, np.array([[3.0], [4.0]]), 1), "x")
    assert r == pytest.approx(np.array([[5.0]])) and matrix(made, "q").ravel() == pytest.approx([0.6, 0.8])
    with pytest.raises(ValueError):
        A.qr(spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "x array<double>"), "x")
    with pytest.raises(ValueError):
        A.qr(table(spark, np.ones((2, 3))), "x")
