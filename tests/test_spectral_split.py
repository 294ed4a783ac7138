"""Eigenvalues by splitting and tearing, with parts small enough that every step is taken."""

import numpy as np
import pytest

from gridloom.operators import blocks, spectral, split
from gridloom.operators.rows import matrix_of, to_rows
from gridloom.operators.rows import small as array
from gridloom.operators.spectral import vector_of


def rows_of(frame, m, n):
    out = np.zeros((m, n))
    for r in frame.collect():
        out[r["i"]] = r["a"]
    return out


def symmetric(values, seed):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))
    a = q * np.array(values) @ q.T
    return (a + a.T) / 2


def test_rows_to_tiles_and_back(spark):
    x = np.random.default_rng(1).normal(size=(23, 17))
    x[5:15] = 0
    tiles = blocks.of_rows(to_rows(matrix_of(spark, x)), 5)
    assert np.array_equal(rows_of(blocks.to_rows(tiles).df, 23, 17), x)
    assert np.array_equal(rows_of(blocks.to_rows(blocks.transpose(tiles)).df, 17, 23), x.T)


@pytest.mark.parametrize("worst", [1e-1, 1e-12])
def test_polar_factor(spark, worst):
    rng = np.random.default_rng(2)
    u, v = (np.linalg.qr(rng.normal(size=(n, 20)))[0] for n in (35, 20))
    s = np.geomspace(1e3 * worst, 1e3, 20)
    got = rows_of(split.polar(to_rows(matrix_of(spark, u * s @ v.T)), panel=12, side=18).df, 35, 20)
    assert np.abs(got.T @ got - np.eye(20)).max() < 1e-13
    assert np.abs(got - u @ v.T).max() < 1e-14 / worst


CASES = {
    "spread": np.linspace(-3, 5, 45),
    "clusters": [1.0] * 15 + [2.0] * 15 + [2.0 + 1e-9] * 5 + [-7.0] * 10,
    "one far out": [1e6, *np.linspace(0, 1, 39)],
    "equal": [4.0] * 40,
}


@pytest.mark.parametrize("name", CASES)
def test_eigenvalues_by_splitting(spark, name):
    values = np.sort(CASES[name])
    a = symmetric(values, 3)
    got, v = split.eigen(to_rows(matrix_of(spark, a)), leaf=30, panel=64, side=23)
    v, size = rows_of(v.df, len(a), len(a)), max(np.abs(values).max(), 1e-300)
    assert np.abs(np.sort(got) - values).max() <= 1e-13 * size * len(a)
    assert np.abs(v.T @ v - np.eye(len(a))).max() < 1e-11 and np.abs(v * got @ v.T - a).max() <= 1e-12 * size * len(a)


@pytest.mark.parametrize("rank", [14])
def test_svd_by_splitting(spark, rank):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, rank)) @ rng.normal(size=(rank, 30))
    f = spectral._split_svd(to_rows(matrix_of(spark, x)), True, leaf=16, panel=64, side=20)
    u, v, s = array(f.u), array(f.v), np.array([r["v"] for r in sorted(f.s.df.collect())])
    want = np.linalg.svd(x, compute_uv=False)
    assert np.abs(s - want).max() < 1e-11 and (np.diff(s) <= 0).all()
    assert np.abs(u.T @ u - np.eye(30)).max() < 1e-10 and np.abs(v.T @ v - np.eye(30)).max() < 1e-10
    assert np.abs(u * s @ v.T - x).max() < 1e-10


@pytest.mark.parametrize("kind", ["random", "toeplitz", "torn", "equal"])
def test_tridiagonal_by_tearing(spark, kind):
    rng, n = np.random.default_rng(5), 70
    d, e = rng.normal(size=n), rng.normal(size=n - 1)
    if kind == "toeplitz":
        d, e = np.full(n, 2.0), np.full(n - 1, -1.0)
    if kind == "torn":
        e[[17, 34, 35, 52]] = 0
    if kind == "equal":
        d, e = np.ones(n), np.zeros(n - 1)
    values, v = spectral._torn(spark, d, e, leaf=18, side=40)
    v, a = rows_of(v.df, n, n), np.diag(d) + np.diag(e, 1) + np.diag(e, -1)
    size = np.abs(a).max()
    assert np.abs(np.sort(values) - np.linalg.eigvalsh(a)).max() < 1e-13 * n * size
    assert np.abs(v.T @ v - np.eye(n)).max() < 1e-11 and np.abs(v * values @ v.T - a).max() < 1e-12 * n * size


def test_tridiagonal_in_order(spark):
    rng = np.random.default_rng(6)
    d, e = rng.normal(size=9), rng.normal(size=8)
    f = spectral.tridiagonal_eigen(vector_of(spark, d), vector_of(spark, e))
    values, v = np.array([r["v"] for r in sorted(f.values.df.collect())]), array(f.vectors)
    want, _ = np.linalg.eigh(np.diag(d) + np.diag(e, 1) + np.diag(e, -1))
    assert np.allclose(values, want) and (v[np.abs(v).argmax(axis=0), np.arange(9)] > 0).all()
