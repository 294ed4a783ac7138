"""Sparse triangles and incomplete factors by waves of blocks and levels of rows."""

import time

import numpy as np
import pytest

from gridloom.operators import applied, iterative, sparse
from gridloom.operators.matrix import Matrix
from gridloom.operators.rows import small as array
from gridloom.operators.spectral import vector_of


def matrix(spark, cells, n):
    return Matrix(spark.createDataFrame([(int(i), int(j), float(v)) for i, j, v in cells], "i long, j long, v double"), n, n)


def scattered(n, each, seed):
    """A diagonally heavy pattern with `each` random cells a row."""
    rng = np.random.default_rng(seed)
    cells = {(i, i): 2.0 * each + rng.random() for i in range(n)}
    for i in range(n):
        for j in rng.integers(0, n, each):
            cells.setdefault((i, int(j)), float(rng.normal()))
    return [(i, j, v) for (i, j), v in cells.items()]


def ilu_by_hand(x, held):
    f = x.copy()
    n = len(x)
    for i in range(n):
        for k in range(i):
            if held[i, k]:
                f[i, k] /= f[k, k]
                for j in range(k + 1, n):
                    if held[i, j]:
                        f[i, j] -= f[i, k] * f[k, j]
    return np.where(held, f, 0.0)


@pytest.mark.parametrize("block", [1, 7, 64, 1000])
@pytest.mark.parametrize("lower", [False, True])
def test_triangles_in_blocks(spark, block, lower):
    n = 60
    cells = [(i, j, v) for i, j, v in scattered(n, 3, 1) if (i >= j) == lower or i == j]
    x, b = array(matrix(spark, cells, n)), np.random.default_rng(2).normal(size=n)
    t = applied.Triangle(matrix(spark, cells, n), lower, False, block)
    assert np.allclose(x @ t(b), b, atol=1e-12) and sum(map(len, t.waves)) == -(-n // block)
    unit = x - np.diag(np.diag(x)) + np.eye(n)
    t = applied.Triangle(matrix(spark, [c for c in cells if c[0] != c[1]] + [(k, k, 1.0) for k in range(0, n, 3)], n), lower, True, block)
    assert np.allclose(unit @ t(b), b, atol=1e-9 * np.linalg.cond(unit))


def test_independent_blocks_share_a_wave(spark):
    cells = [(k, k, 2.0) for k in range(100)] + [(95, 3, 1.0)]
    t = applied.Triangle(matrix(spark, cells, 100), True, False, 10)
    assert sorted(map(len, t.waves)) == [1, 9]


def test_levels_are_longest_paths():
    assert applied.levels(np.array([1, 2, 3, 3, 4]), np.array([0, 1, 0, 2, 0]), 6).tolist() == [0, 1, 2, 3, 1, 0]


@pytest.mark.parametrize("block", [1, 9, 50, 1000])
def test_incomplete_factors_in_blocks(spark, block):
    n = 50
    cells = scattered(n, 4, 5)
    x = array(matrix(spark, cells, n))
    want = ilu_by_hand(x, x != 0)
    got = applied.incomplete_lu(matrix(spark, cells, n), block)
    assert got.df.count() == len(cells) and np.allclose(array(got), want, atol=1e-13)
    assert np.allclose(array(sparse.ilu0(matrix(spark, cells, n), sweeps=200)), want, atol=1e-12)


def test_a_long_chain(spark):
    """100,000 rows that each need the one before: as many levels as rows, each block done once."""
    n = 100_000
    frame = spark.range(n).selectExpr("id as i", "explode(array(id - 1, id)) as j", "0D as w").selectExpr("i", "j", "CASE WHEN i = j THEN 2D ELSE -1D END AS v").where("j >= 0")
    t = applied.Triangle(Matrix(frame, n, n), True, False)
    assert len(t.waves) == -(-n // applied.BLOCK)
    start = time.time()
    x = t(np.ones(n))
    assert np.allclose(x[:5], [0.5, 0.75, 0.875, 0.9375, 0.96875]) and abs(x[-1] - 1) < 1e-12
    assert time.time() - start < 60


def test_a_chain_of_1000_rows_is_factored_exactly(spark):
    """ILU(0) of a tridiagonal matrix is its LU."""
    n = 1000
    cells = [(i, j, 4.0 if i == j else -1.0) for i in range(n) for j in (i - 1, i, i + 1) if 0 <= j < n]
    f = applied.incomplete_lu(matrix(spark, cells, n), 64)
    d = [4.0]
    for _ in range(n - 1):
        d.append(4.0 - 1.0 / d[-1])
    got = {(r["i"], r["j"]): r["v"] for r in f.df.collect()}
    assert all(abs(got[k, k] - d[k]) < 1e-14 for k in range(n)) and all(abs(got[k, k - 1] + 1 / d[k - 1]) < 1e-14 for k in range(1, n))


def test_preconditioned_solvers_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(applied.Triangle.__init__, "__defaults__", (16,))
    monkeypatch.setattr(applied.incomplete_lu, "__defaults__", (16,))
    n = 80
    cells = [(i, j % n, 6.0 + i % 3 if d == 0 else -1.0) for i in range(n) for d in (-1, 0, 1) for j in (i + d,)]
    a, b = matrix(spark, cells, n), np.arange(1.0, n + 1)
    for made in (iterative.conjugate_gradient(a, vector_of(spark, b), None, sparse.ic_preconditioner(a)), iterative.gmres(a, vector_of(spark, b), sparse.ilu_preconditioner(a))):
        x = np.zeros(n)
        for r in made.x.df.collect():
            x[r["i"]] = r["v"]
        assert made.converged and np.allclose(array(a) @ x, b, atol=1e-9)
    assert len(applied.Triangle(a, True, False).waves) > 1


def ring(spark, n):
    frame = spark.range(n).selectExpr("id as i", "explode(array(-1, 0, 1)) as d").selectExpr("i", f"pmod(i + d, {n}) as j", "CASE WHEN d = 0 THEN 6D + i % 3 ELSE -1D END AS v")
    return Matrix(frame, n, n)


def counted(monkeypatch, owner, name):
    calls, own = [], getattr(owner, name)
    monkeypatch.setattr(owner, name, lambda *a, **b: (calls.append(1), own(*a, **b))[1])
    return calls


def test_a_ring_takes_few_rounds_and_is_exact(spark, monkeypatch):
    """20 blocks that each need the one before: two rounds over all, and the bits of one row after another."""
    n = 1000
    done, waves = counted(monkeypatch, applied.Triangle, "_done"), counted(monkeypatch, applied, "_in_waves")
    x = array(ring(spark, n))
    want = ilu_by_hand(x, x != 0)
    got = applied.incomplete_lu(ring(spark, n), 50)
    assert not waves and np.array_equal(array(got), want)
    t, b = applied.Triangle(ring(spark, n), True, False, 50), np.random.default_rng(3).normal(size=n)
    assert len(t.waves) == 20
    y = t(b)
    by_hand = np.zeros(n)
    for i in range(n):
        by_hand[i] = (b[i] - x[i, 0] * by_hand[0] - x[i, i - 1] * by_hand[i - 1] if i == n - 1 else b[i] - (x[i, i - 1] * by_hand[i - 1] if i else 0.0)) / x[i, i]
    assert len(done) == 2 and np.allclose(y, by_hand, rtol=1e-15, atol=0)


def test_what_does_not_settle_goes_in_waves(spark, monkeypatch):
    """Sums of all rows before: nothing is forgotten on the way."""
    n = 200
    frame = spark.range(n).selectExpr("id as i", "explode(array(id - 1, id)) as j").selectExpr("i", "j", "CASE WHEN i = j THEN 1D ELSE -1D END AS v").where("j >= 0")
    t, b = applied.Triangle(Matrix(frame, n, n), True, False, 25), np.arange(1.0, n + 1)
    for _ in range(2):
        assert np.array_equal(t(b), np.cumsum(b))
    waves = counted(monkeypatch, applied, "_in_waves")
    rng = np.random.default_rng(8)
    cells = [(i, j, 2.0 if i == j else -rng.random()) for i in range(n) for j in (i - 1, i, i + 1) if 0 <= j < n]
    x = array(matrix(spark, cells, n))
    x[range(1, n), range(n - 1)] *= -30  # pivots that grow and shrink
    cells = [(i, j, x[i, j]) for i, j, _ in cells]
    assert np.allclose(array(applied.incomplete_lu(matrix(spark, cells, n), 40)), ilu_by_hand(x, x != 0), rtol=1e-13)
    monkeypatch.setattr(applied, "ROUNDS", 1)
    assert np.allclose(array(applied.incomplete_lu(matrix(spark, cells, n), 40)), ilu_by_hand(x, x != 0), rtol=1e-13) and waves


@pytest.mark.parametrize("sweeps", [0, 3, 128])
def test_deep_blocks_with_and_without_sweeps(spark, monkeypatch, sweeps):
    monkeypatch.setattr(applied, "SHALLOW", 2)
    monkeypatch.setattr(applied, "SWEEPS", sweeps)
    n = 80
    cells = scattered(n, 3, 4)
    a, x = matrix(spark, cells, n), array(matrix(spark, cells, n))
    assert np.allclose(array(applied.incomplete_lu(a, 30)), ilu_by_hand(x, x != 0), atol=1e-13)
    b = np.random.default_rng(2).normal(size=n)
    assert np.allclose(np.tril(x) @ applied.Triangle(a, True, False, 30)(b), b, atol=1e-12)


@pytest.mark.parametrize("restart", [4, 30])
def test_gmres_over_tables_writes_a_table_a_step(spark, monkeypatch, restart):
    monkeypatch.setattr(applied, "SHARED_VECTOR", 1)
    n = 40
    written = []
    own = iterative.cut
    monkeypatch.setattr(iterative, "cut", lambda frame, name="step", by=None: (written.append(name), own(frame, name, by))[1])
    b = np.arange(n) % 7 + 1.0
    made = iterative.gmres(ring(spark, n), vector_of(spark, b), control=iterative.Control(smult=1e-12, restart=restart))
    x = np.zeros(n)
    for r in made.x.df.collect():
        x[r["i"]] = r["v"]
    assert made.converged and np.allclose(array(ring(spark, n)) @ x, b, atol=1e-9)
    assert written.count("basis") == made.iterations and len(written) < made.iterations + 4 + 2 * -(-made.iterations // restart)
    none = iterative.gmres(ring(spark, n), vector_of(spark, np.zeros(n)))
    assert none.converged and none.iterations == 0
