"""Operators on one matrix in pieces: panels, blocks and cells far smaller than the matrix."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import blocks, condensed, elementwise, factor, iterative, orthogonal, pivoted, small, sorting, sparse, spectral
from gridloom.operators.applied import Triangle, gathered, incomplete_lu, table
from gridloom.operators.matrix import Matrix, Vector, from_table, make_triangular, vector_from
from gridloom.operators.rows import levels, matrix_of, solve_narrow, to_rows
from gridloom.operators.rows import small as array

RNG = np.random.default_rng(4)
N = 13
A = RNG.normal(size=(N, N))
S = A + A.T
P = A @ A.T + np.eye(N)


def orthonormal(q):
    return np.abs(q.T @ q - np.eye(q.shape[1])).max() < 1e-12


@pytest.mark.parametrize("uplo", ["lower", "upper"])
def test_tridiagonal_by_panels(spark, uplo):
    f = condensed.tridiagonal(make_triangular(matrix_of(spark, S), uplo), uplo, panel=4)
    q, t = array(f.q), array(f.middle())
    assert orthonormal(q) and np.allclose(q @ t @ q.T, S, atol=1e-12)


@pytest.mark.parametrize("n", [1, 2, 3, N])
def test_hessenberg_by_panels(spark, n):
    f = condensed.hessenberg(matrix_of(spark, A[:n, :n]), panel=4)
    q, h = array(f.q), array(f.h)
    assert orthonormal(q) and not np.tril(h, -2).any() and np.allclose(q @ h @ q.T, A[:n, :n], atol=1e-12)


@pytest.mark.parametrize("shape", [(N, N), (N, 5), (4, N), (1, 1)])
def test_bidiagonal_by_panels(spark, shape):
    x = A[: shape[0], : shape[1]]
    f = condensed.bidiagonal(matrix_of(spark, x), panel=3)
    q, b, p = array(f.q), array(f.middle()), array(f.p)
    assert orthonormal(q) and orthonormal(p) and np.allclose(q @ b @ p.T, x, atol=1e-12)


@pytest.mark.parametrize(("how", "x"), [("cholesky", P), ("ldl", P), ("bunch_kaufman", S), ("bunch_kaufman", S - np.diag(np.diag(S)))])
def test_pivoted_by_panels(spark, how, x):
    f = getattr(pivoted, how)(make_triangular(matrix_of(spark, x), "lower"), panel=3)
    low, b = array(f.factor), RNG.normal(size=(N, 2))
    assert not np.triu(low, 1).any() and np.allclose(array(pivoted.rebuilt(f)), x, atol=1e-11) and sorted(f.order) == list(range(N))
    assert np.allclose(x @ array(pivoted.solve(f, matrix_of(spark, b))), b, atol=1e-9)
    if how == "bunch_kaufman":
        assert np.abs(low).max() < 1 / (1 - pivoted.BK) + 1e-9
        # The recorded interchanges give the same order.
        assert sorting.compose(f.pivots, N) == f.order


def test_bunch_kaufman_upper(spark):
    x = S - np.diag(np.diag(S))
    f = pivoted.bunch_kaufman(make_triangular(matrix_of(spark, x), "upper"), "upper", panel=4)
    assert not np.tril(array(f.factor), -1).any() and min(f.pivots) < 0 and np.allclose(array(pivoted.rebuilt(f)), x, atol=1e-11)


def test_cholesky_of_less_than_full_rank(spark):
    low = A[:, :4] @ A[:, :4].T
    f = pivoted.cholesky(matrix_of(spark, low), panel=3)
    assert f.rank == 4 and np.allclose(array(pivoted.rebuilt(f)), low, atol=1e-11)
    with pytest.raises(ArithmeticError):
        pivoted.solve(f, matrix_of(spark, A[:, :1]))


@pytest.mark.parametrize("uplo", ["lower", "upper"])
def test_updates_of_a_factor(spark, uplo):
    l, x = np.linalg.cholesky(P), RNG.normal(size=N)  # noqa: E741
    given = matrix_of(spark, l if uplo == "lower" else l.T)
    up = pivoted.cholesky_update(given, table(spark, x), uplo, panel=4)
    got = array(up)
    assert np.allclose(got @ got.T if uplo == "lower" else got.T @ got, P + np.outer(x, x), atol=1e-10)
    back = array(pivoted.cholesky_update(up, table(spark, x), uplo, -1.0, panel=4))
    assert np.allclose(np.abs(back), np.abs(array(given)), atol=1e-9)
    with pytest.raises(ArithmeticError):
        pivoted.cholesky_update(given, table(spark, 100 * x), uplo, -1.0)


def test_eigen_with_equal_and_opposite_values(spark):
    q = np.linalg.qr(A)[0]
    d = np.array([2.0] * 4 + [-2.0] * 4 + [0.0] * 3 + [5.0, 7.0])
    f = spectral.eigen_sym(matrix_of(spark, q @ np.diag(d) @ q.T))
    v = array(f.vectors)
    assert np.allclose(gathered(f.values), np.sort(d), atol=1e-12) and orthonormal(v) and np.allclose(v @ np.diag(np.sort(d)) @ v.T, q @ np.diag(d) @ q.T, atol=1e-12)
    got = spectral.eigen_sym_selected(matrix_of(spark, q @ np.diag(d) @ q.T), low=-0.5, high=5.5).orderBy("i").collect()
    assert [r["i"] for r in got] == list(range(4, 12)) and np.allclose([r["v"] for r in got], np.sort(d)[4:12], atol=1e-9)


def test_both_ways_of_the_svd_agree(spark):
    """The factors do not depend on the size that picks the way, not even for zero values."""
    for x in (A, A[:, :4] @ A[:4]):
        f, g = spectral.svd(matrix_of(spark, x)), spectral._jacobi_svd(matrix_of(spark, x), True, width=3)
        s = gathered(f.s)
        real = s > 1e-10
        assert np.allclose(s, gathered(g.s), atol=1e-12)
        for a, b in ((f.u, g.u), (f.v, g.v)):
            assert orthonormal(array(b)) and np.allclose(array(a)[:, real], array(b)[:, real], atol=1e-9)
    with pytest.raises(ArithmeticError):
        spectral._orthogonalise(to_rows(matrix_of(spark, A)), 1e-13, 1, 3)


def test_small_singular_values_keep_their_digits(spark):
    d, e = 10.0 ** RNG.uniform(-9, 2, N), 10.0 ** RNG.uniform(-9, 2, N - 1)
    got = np.array([r["v"] for r in spectral.bidiagonal_values(table(spark, d), table(spark, e)).orderBy("i").collect()])
    graded = np.array([2.0**-k for k in range(0, 300, 30)])
    exact = np.array([r["v"] for r in spectral.bidiagonal_values(table(spark, graded), table(spark, np.zeros(9))).orderBy("i").collect()])
    assert np.allclose(got, np.linalg.svd(np.diag(d) + np.diag(e, 1))[1], rtol=1e-9) and np.allclose(exact, graded, rtol=1e-13, atol=0)


@pytest.mark.parametrize("case", [(1.0, [0.3, 1, 2, 5, 9], [1, 1, 1, 1, 1]), (-0.7, [0.3, 1, 2, 5, 9], [1, 2, 1, 2, 1]), (2.0, [1, 1, 1, 4, 4, 9], [1, 2, 3, 0, 1, 1e-20]), (0.5, [9, 1, 1 + 1e-16, 3], [1, 1, 1, 1]), (3.0, [1, 2], [0, 0])])
def test_rank_one_updates_of_a_diagonal(spark, case):
    rho, d, z = case[0], np.array(case[1], float), np.array(case[2], float)
    f = spectral.rank_one_eigen(spark, table(spark, d), table(spark, z), rho)
    v, w, x = array(f.vectors), gathered(f.values), np.diag(d) + rho * np.outer(z, z)
    assert np.allclose(w, np.linalg.eigvalsh(x), atol=1e-12) and orthonormal(v) and np.allclose(v @ np.diag(w) @ v.T, x, atol=1e-12)


@pytest.mark.parametrize("lower", [True, False])
@pytest.mark.parametrize("trans", [True, False])
def test_triangles_are_solved_where_they_lie(spark, lower, trans):
    """The other triangle holds something else, as in packed factors."""
    x, b = A + 9 * np.eye(N), RNG.normal(size=(N, 2))
    t = np.tril(x) if lower else np.triu(x)
    got = solve_narrow(to_rows(matrix_of(spark, x)), b, lower, trans=trans, panel=4)
    assert np.allclose((t.T if trans else t) @ got, b, atol=1e-10)
    unit = t - np.diag(np.diag(t)) + np.eye(N)
    got = solve_narrow(to_rows(matrix_of(spark, x)), b, lower, True, trans, panel=5)
    assert np.allclose((unit.T if trans else unit) @ got, b, atol=1e-6)


def test_wide_right_hand_sides_stay_tables(spark, monkeypatch):
    monkeypatch.setattr(factor, "NARROW_BYTES", 8)
    x, b = matrix_of(spark, P), matrix_of(spark, A[:, :3])
    for got in (factor.lu_solve(factor.lu(x, panel=4), b), factor.cholesky_solve(factor.cholesky(x, panel=4), b)):
        assert np.allclose(P @ array(got), A[:, :3], atol=1e-9)


def test_reflectors_hold_all_of_q(spark):
    x = RNG.normal(size=(20, 5))
    f = orthogonal.reflectors(matrix_of(spark, x))
    y, q = array(f.y), array(orthogonal.update_qr(f, matrix_of(spark, np.eye(20))))
    assert np.allclose(np.diag(y), 1) and not np.triu(y, 1).any() and not np.tril(f.t, -1).any() and orthonormal(q)
    assert np.allclose(q[:, :5] @ array(f.r), x, atol=1e-12) and all(len(b) <= 2 for b in f.blocks(2))
    product = np.eye(20)
    for k, tau in enumerate(f.taus):
        product = product @ (np.eye(20) - tau * np.outer(y[:, k], y[:, k]))
    assert np.allclose(product, q, atol=1e-12)


@pytest.mark.parametrize("shape", [(50, 40, 30), (5, 300, 6), (7, 3, 90), (4, 4, 4)])
def test_grids_of_a_product(spark, shape):
    r, k, c = shape
    x, y = RNG.normal(size=(r, k)), RNG.normal(size=(k, c))
    a, b = blocks.to_blocks(matrix_of(spark, x), 8), blocks.to_blocks(matrix_of(spark, y), 8)
    assert np.allclose(array(blocks.from_blocks(blocks.mult(a, b, 2.0))), 2 * x @ y, atol=1e-10)


def test_grid_uses_all_tasks(spark):
    make = lambda r, c: blocks.Blocks(None, r, c, 256)
    for r, k, c in ((2000, 2000, 2000), (2000, 100, 2000), (200, 100_000, 200), (100_000, 256, 256)):
        p, q, s = blocks.grid(make(r, k), make(k, c), 64)
        assert p * q * s >= min(64, -(-r // 256) * -(-c // 256) * -(-k // 256))
    p, q, s = blocks.grid(make(1 << 20, 1 << 20), make(1 << 20, 1 << 20), 64)
    assert max((1 << 20) // p, (1 << 20) // q) * ((1 << 20) // s) * 8 <= blocks.HELD


def test_levels_follow_the_tasks(spark):
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "100000")
    found = levels(spark.range(1), 8)
    spark.conf.set("spark.sql.shuffle.partitions", held)
    assert found[0] == 12500 and found[-1] == 8 and all(a <= 8 * b for a, b in zip(found, found[1:]))


def test_incomplete_factors_by_blocks(spark):
    """Of a grid's matrix, against elimination on the pattern and against sweeps over tables."""
    side = 12
    n = side * side
    x = np.zeros((n, n))
    for k in range(n):
        x[k, k] = 4 + k % 3
        for q in ((k - 1) if k % side else -1, k + 1 if (k + 1) % side else -1, k - side, k + side):
            if 0 <= q < n:
                x[k, q] = -1.0 - (k + q) % 2
    want, mask = x.copy(), x != 0
    for i in range(1, n):
        for k in range(i):
            if mask[i, k]:
                want[i, k] /= want[k, k]
                own = mask[i] & (np.arange(n) > k)
                want[i, own] -= want[i, k] * want[k, own]
    a = matrix_of(spark, x).where(F.col("v") != 0)
    for block in (16, 1000):
        assert np.allclose(array(incomplete_lu(a, block)), want, atol=1e-12)
    assert np.allclose(array(sparse.ilu0(a)), want, atol=1e-12)


def test_sparse_triangles_by_blocks(spark):
    """A chain through all rows, over many blocks."""
    n = 500
    cells = spark.range(n).select(F.col("id").alias("i"), F.explode(F.array(F.lit(0), F.lit(1))).alias("d")).where("i >= d")
    t = Matrix(cells.select("i", (F.col("i") - F.col("d")).alias("j"), F.when(F.col("d") == 0, 2.0).otherwise(-1.0).alias("v")), n, n)
    b = np.arange(n) % 5 + 1.0
    want = np.linalg.solve(array(t), b)
    assert np.allclose(Triangle(t, True, False, block=64)(b), want) and np.allclose(Triangle(t.T, False, False, block=64)(b), np.linalg.solve(array(t).T, b))
    assert np.allclose(gathered(sparse.solve_triangular(t, table(spark, b))), want)


@pytest.mark.parametrize("shared", [True, False])
def test_solvers_on_a_long_system(spark, monkeypatch, shared):
    """100,000 unknowns with vectors in all tasks, 60 with vectors as tables."""
    n = 100_000 if shared else 60
    if not shared:
        for module in (iterative, sparse):
            monkeypatch.setattr(module, "fits", lambda *_: False)
    ring = spark.range(n).select(F.col("id").alias("i"), F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("d"))
    a = Matrix(ring.select("i", F.pmod(F.col("i") + F.col("d"), F.lit(n)).alias("j"), F.when(F.col("d") == 0, 6.0 + F.col("i") % 3).otherwise(-1.0).alias("v")), n, n)
    b = vector_from(spark.range(n), "id", F.col("id") % 7 + 1.0, n)
    f = iterative.conjugate_gradient(a, b, uplo=None, control=iterative.Control(smult=1e-8))
    x = gathered(f.x)
    i = np.arange(n)
    assert f.converged and np.abs((6 + i % 3) * x - np.roll(x, 1) - np.roll(x, -1) - (i % 7 + 1)).max() < 1e-4


def test_scaling_at_the_ends_of_the_range():
    for source, target in ((1e-300, 1e300), (1e300, 1e-300), (5e-324, 1.0), (1.0, 5e-324), (1e308, 1e308), (3.0, 7.0), (-2.0, 1e200), (5e-324, 1.7e308)):
        factors = elementwise.scale_factors(source, target)
        assert all(math.isfinite(f) and f != 0 for f in factors)
        x = source
        for f in factors:
            x *= f
            assert math.isfinite(x) and x != 0
        assert x == pytest.approx(target, rel=1e-15)
    assert elementwise.scale_factors(2.0, 0.0) == [0.0]
    for bad in (0.0, math.nan, math.inf):
        with pytest.raises(ValueError):
            elementwise.scale_factors(bad, 1.0)


def test_rows_without_a_place_or_value_are_no_cells(spark):
    rows = [(0, 0, 1.0), (0, 0, 2.0), (None, 0, 5.0), (0, None, 5.0), (1, 1, None), (1, 0, 4.0)]
    frame = spark.createDataFrame(rows, "i long, j long, v double")
    assert sorted(map(tuple, from_table(frame, "i", "j", "v", 2, 2).df.collect())) == [(0, 0, 3.0), (1, 0, 4.0)]
    odd = Matrix(spark.createDataFrame([(0, 0, 1.0), (0, 1, None), (0, 2, 3.0)], "i long, j long, v double"), 1, 3)
    assert to_rows(odd).df.first()["a"] == [1.0, 0.0, 3.0]


def test_a_value_that_does_not_converge_is_an_error():
    with pytest.raises(ArithmeticError):
        small.dqds(np.full((3, 3), np.nan))


def test_orders_are_global(spark):
    x = Vector(spark.range(1000).select(F.col("id").alias("i"), ((F.col("id") * 37) % 101).cast("double").alias("v")), 1000)
    got = [r["i"] for r in sorting.ranked(x.df, ascending=False).orderBy("k").collect()]
    assert got == sorted(range(1000), key=lambda k: (-((k * 37) % 101), k))
