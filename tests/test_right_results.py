"""Singular, rank-deficient and badly scaled input: right results or an error, never a wrong result."""

import numpy as np
import pytest

from gridloom.operators import condensed, factor, orthogonal, qr_tree, sparse, spectral
from gridloom.operators.matrix import Matrix
from gridloom.operators.products import mult
from gridloom.operators.rows import matrix_of, to_rows
from gridloom.operators.rows import small as array
from gridloom.operators.spectral import vector_of

RNG = np.random.default_rng(3)


def deficient(m, n):
    """Repeated, zero and dependent columns."""
    x = RNG.normal(size=(m, n))
    x[:, n // 2] = x[:, 0]
    x[:, n // 3] = 0
    x[:, n - 1] = x[:, 1] - 2 * x[:, 2]
    return x


def orthonormal(q):
    return np.abs(q.T @ q - np.eye(q.shape[1])).max() < 1e-12


def rebuilt(f):
    moved = array(factor.relabel(mult(1.0, f.lower, f.upper), f.moves, inverse=True))
    return moved


def test_repeated_cells_are_summed(spark):
    a = Matrix(spark.createDataFrame([(0, 0, 1.0), (0, 0, 2.0), (1, 1, 5.0)], "i long, j long, v double"), 2, 2)
    assert [list(r["a"]) for r in sorted(to_rows(a).df.collect())] == [[3.0, 0.0], [0.0, 5.0]]
    assert array(a).tolist() == [[3.0, 0.0], [0.0, 5.0]]


@pytest.mark.parametrize("panel", [1, 2, 64])
def test_lu_lets_infinity_through(spark, panel):
    x = np.eye(4)
    x[2, 0] = np.inf
    packed = array(factor.lu(matrix_of(spark, x), pivot=False, panel=panel).packed)
    assert np.isinf(packed[2, 0]) and not np.array_equal(packed, np.eye(4))
    x[2, 0] = np.nan
    assert np.isnan(array(factor.lu(matrix_of(spark, x), pivot=False, panel=panel).packed)[2]).any()


@pytest.mark.parametrize("panel", [1, 2, 64])
def test_unpivoted_factors_of_a_zero_pivot(spark, panel):
    for x in ([[0.0, 1], [1, 0]], [[1.0, 1, 0], [1, 1, 2], [0, 2, 1]]):
        a = matrix_of(spark, np.array(x))
        with pytest.raises(ArithmeticError):
            array(factor.lu(a, pivot=False, panel=panel).packed)
        with pytest.raises(ArithmeticError):
            array(factor.ldl(a, panel=panel).factor)
        with pytest.raises(ArithmeticError):
            array(factor.ldl(a, "upper", panel=panel).factor) if x[0][0] == 0 else factor.ldl_solve(factor.ldl(matrix_of(spark, np.diag([1.0, 0])), panel=panel), matrix_of(spark, np.ones((2, 1))))
    f = factor.ldl(matrix_of(spark, np.diag([2.0, 0, 3])), panel=panel)  # singular, but it has factors
    assert array(f.factor).tolist() == np.eye(3).tolist()


@pytest.mark.parametrize("panel", [1, 4, 64])
def test_lu_of_singular_matrices(spark, panel):
    for x in (deficient(20, 12), deficient(12, 12), np.zeros((5, 5)), np.kron(np.eye(3), np.ones((2, 2)))):
        f = factor.lu(matrix_of(spark, x), panel=panel)
        assert np.allclose(rebuilt(f), x, atol=1e-11)
        if x.shape[0] == x.shape[1] and f.singular:
            with pytest.raises(ArithmeticError):
                factor.lu_solve(f, matrix_of(spark, np.ones((len(x), 1))))
    assert factor.lu(matrix_of(spark, np.zeros((5, 5)))).singular


def test_singular_triangles(spark):
    t, b = np.array([[1.0, 0], [1, 0]]), matrix_of(spark, np.ones((2, 1)))
    for solve in (lambda: factor.solve_triangular(matrix_of(spark, t), b), lambda: factor.solve_triangular(matrix_of(spark, t), b, trans=True)):
        with pytest.raises(ArithmeticError):
            solve()
    cells = spark.createDataFrame([(0, 0, 1.0), (2, 2, 1.0), (2, 0, 3.0)], "i long, j long, v double")
    with pytest.raises(ArithmeticError):
        sparse.solve_triangular(Matrix(cells, 3, 3), vector_of(spark, np.ones(3)))
    assert [r["v"] for r in sorted(sparse.solve_triangular(Matrix(cells, 3, 3), vector_of(spark, np.ones(3)), unit=True).df.collect())] == [1.0, 1.0, -2.0]


@pytest.mark.parametrize("shape", [(3, 2), (40, 12), (12, 12)])
@pytest.mark.parametrize("panel", [5, 64])
def test_orthogonal_forms_of_deficient_matrices(spark, shape, panel):
    x = np.array([[1.0, 1], [1, 1], [0, 0]]) if shape == (3, 2) else deficient(*shape)
    f = orthogonal.qr(matrix_of(spark, x), panel)
    assert orthonormal(array(f.q)) and np.allclose(array(f.q) @ array(f.factor), x, atol=1e-12)
    assert np.allclose(np.tril(array(f.factor), -1), 0) and (np.diag(array(f.factor)) >= 0).all()
    if panel == 64:
        for form, given in (("ql", x), ("lq", x.T), ("rq", x.T)):
            f = orthogonal.FORMS[form](matrix_of(spark, given))
            q = array(f.q)
            assert orthonormal(q if form == "ql" else q.T) and np.allclose(array(orthogonal.product(f)), given, atol=1e-12)
        r = orthogonal.reflectors(matrix_of(spark, x))
        whole = array(orthogonal.update_qr(r, matrix_of(spark, np.eye(len(x)))))
        assert orthonormal(whole) and np.allclose(whole[:, : x.shape[1]] @ array(r.r), x, atol=1e-12)


def test_least_squares_of_deficient_matrices(spark):
    x, b = deficient(30, 9), RNG.normal(size=(30, 2))
    c = RNG.normal(size=(9, 2))
    forms = {k: orthogonal.FORMS[k](matrix_of(spark, x if k in ("qr", "ql") else x.T)) for k in orthogonal.FORMS}
    best, least = np.linalg.pinv(x) @ b, np.linalg.pinv(x.T) @ c
    for k, f in forms.items():
        tall = k in ("qr", "ql")
        assert np.allclose(array(orthogonal.solve(f, matrix_of(spark, b), trans=not tall)), best, atol=1e-10)
        assert np.allclose(array(orthogonal.solve(f, matrix_of(spark, c), trans=tall)), least, atol=1e-10)
    assert np.allclose(array(orthogonal.least_squares(matrix_of(spark, x), matrix_of(spark, b))), best, atol=1e-10)


@pytest.mark.parametrize("shape", [(3, 2), (40, 12), (12, 40), (5, 5)])
def test_singular_vectors_of_deficient_matrices(spark, shape):
    x = np.array([[1.0, 1], [1, 1], [0, 0]]) if shape == (3, 2) else np.zeros(shape) if shape == (5, 5) else deficient(*shape) if shape[0] > shape[1] else deficient(*shape[::-1]).T
    f = spectral.svd(matrix_of(spark, x))
    u, v = array(f.u), array(f.v)
    s = np.array([r["v"] for r in sorted(f.s.df.collect())])
    assert orthonormal(u) and orthonormal(v) and np.allclose(u * s @ v.T, x, atol=1e-12)


def test_bidiagonal_of_a_deficient_tall_matrix(spark):
    x = deficient(40, 8)
    f = condensed.bidiagonal(matrix_of(spark, x))
    q, p = array(f.q), array(f.p)
    assert orthonormal(q) and orthonormal(p) and np.allclose(q @ array(f.middle()) @ p.T, x, atol=1e-11)


def values(frame):
    return np.array([r["v"] for r in sorted(frame.collect())])


def test_values_of_a_wide_range(spark):
    up = lambda x: vector_of(spark, np.array(x))
    got = values(spectral.bidiagonal_values(up([1e200, 1e199]), up([1e198])))
    assert np.allclose(got / 1e199, np.linalg.svd(np.array([[10.0, 0.1], [0, 1]]), compute_uv=False), rtol=1e-14)
    got = values(spectral.bidiagonal_values(up([1.0, 1e-200, 1e-160]), up([0.0, 0.0])))
    assert np.allclose(got, [1.0, 1e-160, 1e-200], rtol=1e-14)
    # Of [1, 1; 0, x] the product of both values is x, and the larger is near the root of 2.
    got = values(spectral.bidiagonal_values(up([1.0, 1e-200]), up([1.0])))
    assert np.allclose(got, [np.sqrt(2), 1e-200 / np.sqrt(2)], rtol=1e-14)
    for unit in (1e-180, 1.0, 1e180):
        d, e = RNG.normal(size=12), RNG.normal(size=11)
        want = np.linalg.eigvalsh(np.diag(d) + np.diag(e, 1) + np.diag(e, -1))
        assert np.allclose(values(spectral.bisect(spark, up(d * unit), up(e * unit))) / unit, want, rtol=0, atol=1e-13)
        points = spark.createDataFrame([(float(x * unit),) for x in (-1.0, 0.0, 0.5)], "x double")
        counts = {round(r["x"] / unit, 6): r["count"] for r in spectral.sturm_counts(spark, up(d * unit), up(e * unit), points).collect()}
        assert counts == {x: int((want < x).sum()) for x in (-1.0, 0.0, 0.5)}
    assert values(spectral.bidiagonal_values(up([0.0, 0.0]), up([0.0]))).tolist() == [0.0, 0.0]
    with pytest.raises(ArithmeticError):
        spectral.bisect(spark, up([1.0, np.inf]), up([1.0]))


def test_qr_with_both_sides_long(spark):
    """Panels of trees with several levels; nothing but a panel's tops meets in a task."""
    x = RNG.normal(size=(420, 300))
    x[:, 100:120] = x[:, 10:30]
    rows = to_rows(matrix_of(spark, x))
    f = qr_tree.factor(type(rows)(rows.df.repartition(5), 420, 300), panel=40, block_bytes=300 * 8 * 30, node_bytes=40 * 300 * 8 * 3)
    assert len(f.panels) == 8 and max(len(p.levels) for p in f.panels) > 2
    q, r = np.zeros((420, 300)), np.zeros((300, 300))
    for row in qr_tree.thin_q(f).df.collect():
        q[row["i"]] = row["a"]
    for row in f.r.df.collect():
        r[row["i"]] = row["a"]
    assert orthonormal(q) and np.allclose(q @ r, x, atol=1e-12) and np.allclose(np.tril(r, -1), 0)


def test_the_whole_of_a_sparse_pattern(spark):
    cells = [(0, 0, 1.0), (0, 99, 2.0), (70, 3, 0.0), (70, 4, 1.0)]
    a = Matrix(spark.createDataFrame(cells, "i long, j long, v double"), 80, 100)
    lines = {r["i"]: r["line"] for r in sparse.spy(a).collect()}
    assert len(lines) == 80 and set(map(len, lines.values())) == {100}
    assert lines[0] == "x" + "." * 98 + "x" and lines[70] == "...xx" + "." * 95 and lines[1] == "." * 100
    assert [r["line"] for r in sorted(sparse.spy(a, 69, 2, 2, 4).collect())] == ["....", ".xx."]




@pytest.mark.parametrize("form", ["qr", "ql", "lq", "rq"])
@pytest.mark.parametrize("rank", ["full", "deficient"])
def test_all_of_q(spark, form, rank):
    x = RNG.normal(size=(14, 6)) if rank == "full" else deficient(14, 6)
    x = x if form in ("qr", "ql") else x.T
    f = orthogonal.whole(matrix_of(spark, x), form)
    eye = matrix_of(spark, np.eye(14))
    q = array(orthogonal.mult_whole(f, eye))
    assert q.shape == (14, 14) and orthonormal(q)
    assert np.allclose(array(orthogonal.mult_whole(f, eye, trans=True)), q.T, atol=1e-12)
    c = RNG.normal(size=(14, 3))
    assert np.allclose(array(orthogonal.mult_whole(f, matrix_of(spark, c), trans=True)), q.T @ c, atol=1e-12)
    assert np.allclose(array(orthogonal.mult_whole(f, matrix_of(spark, c.T), "right")), c.T @ q, atol=1e-12)
    t = array(f.padded())
    assert np.allclose(q @ t if form in ("qr", "ql") else t @ q, x, atol=1e-12)
    assert np.allclose(np.tril(t, -1) if form == "qr" else np.triu(t, 1) if form == "lq" else np.triu(t[-6:], 1) if form == "ql" else np.tril(t[:, -6:], -1), 0, atol=1e-12)


@pytest.mark.parametrize("panel", [8, 128])
def test_pivots_are_fetched_by_panels(spark, monkeypatch, panel):
    from gridloom.operators import pivoted

    calls, plain = [], pivoted.collect_small
    monkeypatch.setattr(pivoted, "collect_small", lambda *a: calls.append(1) or plain(*a))
    x = RNG.normal(size=(40, 40))
    x = x @ x.T + np.diag(np.linspace(0, 60, 40))
    f = pivoted.cholesky(matrix_of(spark, x), panel=panel)
    low = array(f.factor)
    assert np.allclose(low @ low.T, x[np.ix_(f.order, f.order)], atol=1e-9) and (np.diff(np.diag(low)) <= 1e-9).all()
    assert len(calls) <= (3 if panel == 128 else 25)


def test_selected_vectors(spark):
    x = RNG.normal(size=(12, 12))
    x = x + x.T
    values, v = np.linalg.eigh(x)
    f = spectral.eigen_sym_selected_vectors(matrix_of(spark, np.tril(x)), first=2, last=9, low=float(values[4]) - 1e-9)
    got = array(f.vectors)
    assert np.allclose([r["v"] for r in sorted(f.values.df.collect())], values[4:9]) and got.shape == (12, 5)
    assert np.allclose(np.abs((got * v[:, 4:9]).sum(axis=0)), 1)
    none = spectral.eigen_sym_selected_vectors(matrix_of(spark, x), low=float(values[-1]) + 1)
    assert none.values.size == 0 and none.vectors.df.count() == 0
