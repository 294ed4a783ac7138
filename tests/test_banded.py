"""Tri- and bidiagonal forms by way of a band, against numpy and with their jobs counted."""

import numpy as np
import pytest

from gridloom.functions.cut import cut
from gridloom.operators import banded, condensed, spectral
from gridloom.operators.matrix import make_triangular
from gridloom.operators.rows import Rows, ShapeError, matrix_of, to_rows

RNG = np.random.default_rng(71)


def array(a):
    got = a.df.toPandas()
    out = np.zeros((a.rows, a.cols))
    np.add.at(out, (got["i"].to_numpy(), got["j"].to_numpy()), got["v"].to_numpy())
    return out


def near_identity(q):
    return np.abs(q.T @ q - np.eye(q.shape[1])).max() < 1e-12


def jobs(spark, name, work):
    """(result of work, number of Spark jobs it started)."""
    spark.sparkContext.setJobGroup(name, name)
    try:
        return work(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("symmetric", [True, False])
@pytest.mark.parametrize(("n", "b"), [(1, 2), (2, 2), (3, 2), (9, 8), (13, 3), (40, 7), (130, 16)])
def test_chase_of_a_band(symmetric, n, b):
    x = np.triu(np.tril(RNG.normal(size=(n, n)), b), 0)
    x = x + np.triu(x, 1).T if symmetric else x
    band = np.zeros((n, b + 1))
    for k in range(min(b, n - 1) + 1):
        band[: n - k, k] = np.diag(x, k)
    sides, seen = [np.eye(n), np.eye(n)], []
    for kind, g, at, low, v, t in banded._chase(band, symmetric, True, 4096):
        if kind == banded._END:
            d, e = np.frombuffer(v), np.frombuffer(t)
            assert low == max(seen, default=0) + 1
            break
        assert at == len(seen)
        seen.append(g)
        k = round((len(t) / 8) ** 0.5)
        v, t = np.frombuffer(v).reshape(-1, k), np.frombuffer(t).reshape(k, k)
        y = sides[kind][:, low : low + len(v)]
        y -= ((y @ v) @ t) @ v.T
    middle = np.diag(d) + np.diag(e, 1) + (np.diag(e, -1) if symmetric else 0)
    q, p = sides[0], sides[0] if symmetric else sides[1]
    assert near_identity(q) and near_identity(p) and np.allclose(q @ middle @ p.T, x, atol=1e-12)
    assert seen == sorted(seen)


@pytest.mark.parametrize("n", [1, 2, 4, 5, 8, 30])
def test_symmetric_band_of_every_size(spark, n):
    x = RNG.normal(size=(n, n))
    x = x + x.T
    f = condensed.tridiagonal(make_triangular(matrix_of(spark, x), "lower"), "lower", panel=3)
    q = array(f.q)
    assert near_identity(q) and np.allclose(q @ array(f.middle()) @ q.T, x, atol=1e-12)


@pytest.mark.parametrize("shape", [(1, 1), (2, 2), (4, 4), (7, 7), (40, 9), (9, 40), (2, 1)])
def test_upper_band_of_every_size(spark, shape):
    x = RNG.normal(size=shape)
    f = condensed.bidiagonal(matrix_of(spark, x), panel=3)
    q, p = array(f.q), array(f.p)
    assert near_identity(q) and near_identity(p) and np.allclose(q @ array(f.middle()) @ p.T, x, atol=1e-12)


@pytest.mark.parametrize("kind", ["zero", "rank one", "diagonal", "huge", "tiny"])
def test_special_matrices(spark, kind):
    n = 17
    one = np.outer(np.arange(1.0, n + 1), np.arange(1.0, n + 1))
    x = {"zero": 0 * one, "rank one": one, "diagonal": np.diag(np.arange(n) - 4.0), "huge": one * 1e200 + np.eye(n), "tiny": one * 1e-200}[kind]
    unit = max(np.abs(x).max(), 1e-300)
    for f in (condensed.tridiagonal(matrix_of(spark, x), panel=4), condensed.bidiagonal(matrix_of(spark, x), panel=4)):
        q, p = array(f.q), array(f.p)
        assert near_identity(q) and near_identity(p) and np.abs(q @ (array(f.middle()) / unit) @ p.T - x / unit).max() < 1e-13


def test_jobs_go_with_panels_not_columns(spark):
    n, b = 200, 20
    x = RNG.normal(size=(n, n))
    x = x + x.T
    a = matrix_of(spark, x)
    rows = Rows(cut(to_rows(a).df), n, n)
    band, count = jobs(spark, "band", lambda: banded.symmetric_band(rows, b, None))
    assert count <= 3 * n // b + 3
    whole = np.zeros((n, n))
    for k in range(b + 1):
        whole += np.diag(band[: n - k, k], -k) + (np.diag(band[: n - k, k], k) if k else 0)
    assert np.allclose(np.linalg.eigvalsh(whole), np.linalg.eigvalsh(x), atol=1e-11)
    q, p = banded.Turned(spark, n), banded.Turned(spark, n)
    band, count = jobs(spark, "upper", lambda: banded.upper_band(rows, b, q, p))
    assert count <= 3 * n // b + 3
    whole = sum(np.diag(band[: n - k, k], k) for k in range(b + 1))
    assert np.allclose(np.linalg.svd(whole, compute_uv=False), np.linalg.svd(x, compute_uv=False), atol=1e-11)
    values = [r["v"] for r in sorted(spectral.eigen_sym_selected(a, first=3, last=9).collect())]
    assert np.allclose(values, np.linalg.eigvalsh(x)[3:9], atol=1e-10)


def test_blocks_go_out_in_groups(spark):
    """Q is written once for each group of blocks that may be sent to every task."""
    n = 40
    x = RNG.normal(size=(n, n))
    q, p = banded.Turned(spark, n, most=6000), banded.Turned(spark, n, most=6000)
    d, e = banded.chased(spark, banded.upper_band(to_rows(matrix_of(spark, x)), 5, q, p), False, q, p, most=9000)
    left, right = array(q.matrix()), array(p.matrix())
    assert near_identity(left) and near_identity(right) and np.allclose(left @ (np.diag(d) + np.diag(e, 1)) @ right.T, x, atol=1e-12)


def test_a_panel_too_large_is_refused(spark):
    with pytest.raises(ShapeError):
        banded.symmetric_band(Rows(to_rows(matrix_of(spark, np.eye(3))).df, 10**8, 10**8), 8, None)


def test_width_follows_memory():
    assert banded.width_of(64) == 16 and banded.width_of(10_000) == 64 and banded.width_of(1) == 2
    assert 48 * 500_000 * banded.width_of(500_000) <= 256 << 20
