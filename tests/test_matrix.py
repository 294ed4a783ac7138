"""Matrices, products and factorisations against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import compat
from gridloom.operators import blocks, butterfly, elementwise, extended, factor, iterative, orthogonal, products, reductions, small, sorting, sparse, spectral
from gridloom.operators.matrix import Matrix, ShapeError, Vector, as_column, column_of, diagonal, from_table, get, identity, make_triangular, submatrix, uniform, vector_from, zeros
from gridloom.operators.rows import small as array


def values(v: Vector) -> np.ndarray:
    out = np.zeros(v.size)
    for r in v.df.collect():
        out[r["i"]] = r["v"]
    return out


@pytest.fixture(scope="module")
def a(spark):
    return uniform(spark, 30, 12, 3)


@pytest.fixture(scope="module")
def square(spark):
    return uniform(spark, 20, 20, 5)


def test_shapes_are_checked(spark, a, square):
    with pytest.raises(ShapeError):
        products.mult(1.0, a, a)
    with pytest.raises(ShapeError):
        elementwise.plus(1.0, a, 1.0, square)
    with pytest.raises(ShapeError):
        orthogonal.qr(a.T)
    with pytest.raises(IndexError):
        get(a, 99, 0)
    with pytest.raises(ShapeError):
        submatrix(a, 0, 0, 31, 2)


def test_empty_matrices(spark):
    none = zeros(spark, 0, 0)
    assert none.size == 0 and products.mult(1.0, none, none).df.count() == 0
    assert reductions.nrm2(none).first()["value"] == 0.0
    assert reductions.norm(zeros(spark, 3, 3), "one").first()["value"] == 0.0


def test_beta_zero_ignores_what_was_there(spark, square):
    odd = square.with_values(F.lit(float("nan")))
    assert np.isfinite(array(products.mult(1.0, square, square, 0.0, odd))).all()


def test_products_by_transposition(a):
    left, right = array(products.mult(1.0, a, a, trans_a=True)), array(products.mult(1.0, a.T, a.T, trans_b=True))
    assert np.allclose(left, right, atol=1e-12)


def test_tiles_equal_cells(a):
    made = blocks.from_blocks(blocks.mult(blocks.to_blocks(a, 8), blocks.to_blocks(a.T, 8), 2.0))
    assert np.allclose(array(made), 2 * array(a) @ array(a).T)


def test_lu_of_a_singular_matrix(spark):
    m = from_table(spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 0, 2.0), (1, 1, 4.0)], "i long, j long, v double"), "i", "j", "v", 2, 2)
    f = factor.lu(m)
    assert f.singular and np.allclose(array(f.lower) @ array(f.upper), array(m)[f.order])


def test_lu_by_panels(square):
    f, x = factor.lu(square, panel=6), array(square)
    assert np.allclose(array(f.lower) @ array(f.upper), x[f.order])
    assert sorting.compose(f.pivots(), 20) == f.order
    assert np.allclose(x.T @ array(factor.lu_solve(f, identity(square.df.sparkSession, 20), trans=True)), np.eye(20))


def test_cholesky_refuses_an_indefinite_matrix(spark):
    with pytest.raises(ArithmeticError):
        factor.cholesky(elementwise.scale(identity(spark, 4), -1.0))


@pytest.mark.parametrize("form", ["qr", "lq", "ql", "rq"])
def test_orthogonal_forms(a, form):
    m = a if form in ("qr", "ql") else a.T
    f = orthogonal.FORMS[form](m)
    q, t = array(f.q), array(f.factor)
    q = q if form in ("qr", "ql") else q.T
    assert np.allclose(q.T @ q, np.eye(12), atol=1e-12) and np.allclose(array(orthogonal.product(f)), array(m))
    assert np.allclose(t, np.triu(t) if form in ("qr", "rq") else np.tril(t))


def test_least_squares(spark, a):
    b = uniform(spark, 30, 2, 9)
    assert np.allclose(array(orthogonal.least_squares(a, b)), np.linalg.lstsq(array(a), array(b), rcond=None)[0])


def test_svd_with_both_sides_long(spark, square):
    f = spectral._jacobi_svd(square, True, width=5)
    u, s, v = array(f.u), values(f.s), array(f.v)
    assert np.allclose(u @ np.diag(s) @ v.T, array(square)) and np.allclose(s, np.linalg.svd(array(square))[1])


def test_tridiagonal_values(spark):
    d, e = [1.0, 5.0, 2.0, 8.0], [0.5, 0.0, 2.0]
    t = np.diag(d) + np.diag(e, 1) + np.diag(e, -1)
    got = [r["v"] for r in spectral.bisect(spark, d, e).orderBy("i").collect()]
    assert np.allclose(got, np.linalg.eigvalsh(t))


def test_batches_of_small_matrices(spark):
    one = small.keyed(uniform(spark, 6, 6, 1), 1).unionByName(small.keyed(uniform(spark, 6, 6, 2), 2))
    r = small.each(one, 6, 6, small.hessenberg)
    for key in (1, 2):
        h, q = (array(small.part(r, n, 6, 6, key)) for n in "hq")
        assert np.allclose(q @ h @ q.T, array(uniform(spark, 6, 6, key)))


def test_dqds_is_relatively_accurate():
    b = np.diag([1e-8, 2.0, 3.0, 0.5]) + np.diag([1.0, 1.0, 1.0], 1)
    assert np.allclose(small.dqds(b)["s"], np.linalg.svd(b, compute_uv=False), rtol=1e-10, atol=1e-14)


def test_bunch_kaufman_of_a_zero_diagonal():
    x = np.array([[0.0, 1.0, 2.0], [1.0, 0.0, 3.0], [2.0, 3.0, 0.0]])
    f = small.bunch_kaufman(x)
    o = f["order"].astype(int)
    assert np.allclose(f["l"] @ f["d"] @ f["l"].T, x[np.ix_(o, o)]) and (f["pivots"] < 0).sum() == 2


def test_extended_sum_of_cancelling_values(spark):
    n = 9000
    v = F.when(F.col("id") % 3 == 0, 1e16).when(F.col("id") % 3 == 1, 1.0).otherwise(-1e16)
    x = vector_from(spark.range(n), "id", v, n)
    assert extended.total(x).first()["value"] == 3000.0
    ones = vector_from(spark.range(n), "id", F.lit(1.0), n)
    assert extended.dot(x, ones).first()["value"] == 3000.0


def test_butterfly_is_linear_and_transposes(spark):
    d = butterfly.generate(spark, 8, 2, 1)
    u, ut = array(butterfly.apply(identity(spark, 8), d, 2)), array(butterfly.apply(identity(spark, 8), d, 2, trans=True))
    assert np.allclose(u.T, ut) and np.linalg.cond(u) < 2 and butterfly.padded_size(9, 2) == 12


def test_iterative_solvers(spark):
    n = 10
    cells = spark.range(n).select(F.col("id").alias("i"), F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("d"))
    m = Matrix(cells.select("i", (F.col("i") + F.col("d")).alias("j"), F.when(F.col("d") == 0, 4.0).otherwise(-1.0).alias("v")).where(f"j >= 0 and j < {n}"), n, n)
    b = vector_from(spark.range(n), "id", F.col("id") + 1.0, n)
    s = iterative.conjugate_gradient(m, b)
    assert s.converged and np.allclose(array(m) @ values(s.x), values(b))
    s = iterative.conjugate_gradient(m, b, control=iterative.Control(limit=1))
    assert not s.converged and s.iterations == 1
    assert np.allclose(np.tril(array(m)) @ values(sparse.solve_triangular(m, b)), values(b))


def test_customary_names(a, square):
    assert np.allclose(array(compat.gemm("T", "N", 1.0, a, a)), array(compat.syrk("L", "T", 1.0, a)) + np.triu(array(a).T @ array(a), 1))
    x = column_of(square, 0)
    assert np.allclose(values(compat.gemv("T", 2.0, square, x)), 2 * array(square).T @ values(x))
    assert np.allclose(array(compat.getrs("N", compat.getrf(square), as_column(x)))[:, 0], np.linalg.solve(array(square), values(x)))


def test_views(square):
    x = array(square)
    assert np.allclose(values(diagonal(square, 2)), np.diag(x, 2)) and np.allclose(array(make_triangular(square, "upper", unit=True)), np.triu(x, 1) + np.eye(20))


def test_incomplete_factors_end_or_say_so(spark):
    """The tridiagonal (-1, 2, -1): pivot i is (i + 2)/(i + 1), each from the one before."""
    n = 9
    cells = [(i, j, 2.0 if i == j else -1.0) for i in range(n) for j in range(max(i - 1, 0), min(i + 2, n))]
    chain = Matrix(spark.createDataFrame(cells, "i long, j long, v double").coalesce(1), n, n)
    got = {r["i"]: r["v"] for r in sparse.ilu0(chain).df.where("i = j").collect()}
    assert np.allclose([got[i] for i in range(n)], [(i + 2) / (i + 1) for i in range(n)], rtol=1e-12, atol=0)
    for factor_of in (sparse.ilu0, sparse.ic0):
        with pytest.raises(ArithmeticError):
            factor_of(chain, sweeps=3)
