"""Singular vectors of bidiagonal matrices by tearing, against numpy."""

import numpy as np
import pytest

from gridloom.operators import spectral
from gridloom.operators.spectral import vector_of

from test_banded import array, near_identity

RNG = np.random.default_rng(83)
N = 40

CASES = {
    "random": (RNG.normal(size=N), RNG.normal(size=N - 1)),
    "graded": (10.0 ** -np.arange(N), 10.0 ** -np.arange(N - 1.0)),
    "zeros in both": (np.where(np.arange(N) % 5, RNG.normal(size=N), 0.0), np.where(np.arange(N - 1) % 7, RNG.normal(size=N - 1), 0.0)),
    "equal values": (np.ones(N), np.zeros(N - 1)),
    "all zero": (np.zeros(N), np.zeros(N - 1)),
    "huge": (RNG.normal(size=N) * 1e200, RNG.normal(size=N - 1) * 1e200),
    "near to singular": (np.ones(N), np.full(N - 1, 2.0)),
    "one": (np.array([-3.0]), np.zeros(0)),
}


@pytest.mark.parametrize("case", list(CASES))
def test_torn_bidiagonal(spark, case):
    d, e = CASES[case]
    b, unit = np.diag(d) + np.diag(e, 1), max(np.abs(d).max(), 1e-300)
    f = spectral.bidiagonal_svd(vector_of(spark, d), vector_of(spark, e), leaf=16 if case == "graded" else 32, panel=20, side=32)
    u, v, s = array(f.u), array(f.v), np.array([r["v"] for r in sorted(f.s.df.collect())])
    assert near_identity(u) and near_identity(v)
    assert np.allclose(s / unit, np.linalg.svd(b / unit, compute_uv=False), atol=1e-12)
    assert np.abs(u @ np.diag(s / unit) @ v.T - b / unit).max() < 1e-12 * max(1.0, np.abs(b / unit).max())


def test_values_that_are_not_finite_are_refused(spark):
    with pytest.raises(ArithmeticError):
        spectral.bidiagonal_svd(vector_of(spark, np.array([1.0, np.nan])), vector_of(spark, np.ones(1)))


def test_secular_offsets_below_the_square_root_of_the_range(spark):
    """Poles whose gaps are so small that products of offsets underflow."""
    d, z = np.array([-1.01, -0.99, 0.5, 1.0]) * 1e-30, np.array([0.99, 0.99, 0.1, 0.05])
    f = spectral.rank_one_eigen(spark, list(d), list(z), 1e-30)
    v, values = array(f.vectors), np.array([r["v"] for r in sorted(f.values.df.collect())])
    x = np.diag(d * 1e30) + np.outer(z, z)
    assert near_identity(v) and np.allclose(values * 1e30, np.linalg.eigvalsh(x), atol=1e-14)
    assert np.abs(v @ np.diag(values * 1e30) @ v.T - x).max() < 1e-14
