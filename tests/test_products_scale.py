"""Products through partial sums, heavy inner indices, outer products by stripes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import gustavson, products
from gridloom.operators.matrix import Matrix, Vector
from gridloom.operators.rows import small as array


def sparse(spark, m, n, cells, seed):
    rng = np.random.default_rng(seed)
    held = {(int(rng.integers(m)), int(rng.integers(n))): float(rng.normal()) for _ in range(cells)}
    held |= {(i, 3 % n): float(rng.normal()) for i in range(m)}  # one column with a cell in every row
    return Matrix(spark.createDataFrame([(i, j, v) for (i, j), v in held.items()], "i long, j long, v double").repartition(3), m, n)


@pytest.mark.parametrize("dense", [True, False])
@pytest.mark.parametrize("heavy", [40, 1 << 21])
@pytest.mark.parametrize("uplo", [None, "lower", "upper"])
def test_partial_sums(spark, monkeypatch, dense, heavy, uplo):
    monkeypatch.setattr(gustavson, "DENSE", 1 << 22 if dense else 0)
    monkeypatch.setattr(gustavson, "CHUNK", 50)
    monkeypatch.setattr(gustavson, "HELD", 100)
    monkeypatch.setattr(gustavson, "SIDE", 16)
    a, b = sparse(spark, 40, 25, 200, 1), sparse(spark, 30, 25, 150, 2).T
    x, y = array(a), array(b)
    got = gustavson.product(a.df, b.df, 40, 25, 30, -2.0, uplo, heavy)
    want = {None: lambda w: w, "lower": np.tril, "upper": np.triu}[uplo](-2.0 * x @ y)
    held = {None: lambda w: w, "lower": np.tril, "upper": np.triu}[uplo]((np.abs(x) > 0).astype(float) @ (np.abs(y) > 0))
    assert np.allclose(array(Matrix(got, 40, 30)), want) and got.count() == (held > 0).sum()
    own = gustavson.product(a.df, None, 40, 25, 40, 1.0, "lower", heavy)
    assert np.allclose(array(Matrix(own, 40, 40)), np.tril(x @ x.T))


def test_a_heavy_index_runs_on_many_tasks(spark):
    """Half of all cells have one inner index."""
    n = 3000
    one = spark.range(n).select(F.col("id").alias("i"), F.lit(7).cast("long").alias("j"), (F.col("id") % 5 + 1.0).alias("v"))
    other = spark.range(n).select(F.col("id").alias("i"), (8 + F.col("id")).alias("j"), F.lit(1.0).alias("v"))
    a = Matrix(one.unionByName(other), n, n + 8)
    got = gustavson.product(a.df, None, n, n + 8, n, 1.0, "lower", 1 << 18)
    row = got.agg(F.count("*").alias("n"), F.sum("v").alias("s")).first()
    v = np.arange(n) % 5 + 1.0
    assert row["n"] == n * (n + 1) // 2 and row["s"] == (v.sum() ** 2 + (v * v).sum()) / 2 + n


def test_cells_that_cancel_stay(spark):
    a = Matrix(spark.createDataFrame([(0, 0, 1.0), (0, 1, 1.0)], "i long, j long, v double"), 1, 2)
    b = Matrix(spark.createDataFrame([(0, 0, 1.0), (1, 0, -1.0)], "i long, j long, v double"), 2, 1)
    assert [tuple(r) for r in gustavson.product(a.df, b.df, 1, 2, 1).collect()] == [(0, 0, 0.0)]


@pytest.mark.parametrize("uplo", [None, "lower", "upper"])
@pytest.mark.parametrize("sizes", [(50, 50), (70, 20), (20, 70)])
def test_outer_products_by_stripes(spark, monkeypatch, uplo, sizes):
    monkeypatch.setattr(products, "STRIPE", 16)
    rng = np.random.default_rng(5)
    x, y = (rng.normal(size=n) for n in sizes)
    vector = lambda v: Vector(spark.createDataFrame(list(enumerate(map(float, v))), "i long, v double"), len(v))
    got = products.outer(2.0, vector(x), vector(y), uplo)
    keep = {None: lambda w: w, "lower": np.tril, "upper": np.triu}[uplo]
    assert np.allclose(array(got), keep(2.0 * np.outer(x, y))) and got.df.count() == int(keep(np.ones(sizes)).sum())
    if sizes[0] == sizes[1] and uplo:
        zero = Matrix(spark.createDataFrame([], "i long, j long, v double"), *sizes)
        both = products.mvupdate2_sym(1.0, zero, -1.0, vector(x), vector(y), uplo)
        assert np.allclose(array(both), keep(-np.outer(x, y) - np.outer(y, x)))
    plan = got.df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_twice_a_product(spark):
    a, b = sparse(spark, 12, 9, 60, 3), sparse(spark, 12, 9, 60, 4)
    x, y = array(a), array(b)
    assert np.allclose(array(products.update2_sym(1.5, a, b)), np.tril(1.5 * (x @ y.T + y @ x.T)))
    assert np.allclose(array(products.update2_sym(1.5, a, b, uplo="upper", trans=True)), np.triu(1.5 * (x.T @ y + y.T @ x)))


def exact(x, y):
    from fractions import Fraction

    return np.array([[float(sum((Fraction(a) * Fraction(b) for a, b in zip(r, c, strict=True)), Fraction(0))) for c in y.T] for r in x])


@pytest.mark.parametrize("kind", ["cancelling", "wide range", "huge", "tiny", "zero rows"])
def test_sliced_products_are_right_to_the_last_bit(kind):
    from gridloom.operators.blocks import sliced

    rng = np.random.default_rng(9)
    x, y = rng.normal(size=(6, 40)), rng.normal(size=(40, 5))
    if kind == "cancelling":
        x[:, 20:] = -x[:, :20]
        y[20:] = y[:20] * (1 + 2.0**-50)
    if kind == "wide range":
        x *= 2.0 ** rng.integers(-15, 15, x.shape)
    if kind == "huge":
        x, y = x * 1e250, y * 1e-200
    if kind == "tiny":
        x, y = x * 1e-140, y * 1e-140
    if kind == "zero rows":
        x[2], y[:, 3] = 0, 0
    s, c, n = sliced(x, y)
    want = exact(x, y)
    assert np.array_equal(s + c, want) and np.array_equal(n, (x != 0).astype(float) @ (y != 0))
    if kind == "cancelling":
        assert not np.array_equal(x @ y, want)


def test_sliced_products_over_slabs(spark):
    """Several tiles of the inner index are added up as pairs."""
    from gridloom.operators import blocks, extended
    from gridloom.operators.rows import matrix_of

    rng = np.random.default_rng(10)
    x = rng.normal(size=(7, 60))
    y = np.vstack((rng.normal(size=(30, 4)), np.zeros((30, 4))))
    x[:, 30:], y[30:] = -x[:, :30], y[:30] * (1 + 2.0**-51)
    tiles = lambda v: blocks.to_blocks(matrix_of(spark, v), 4)
    got = blocks.mult_pairs(tiles(x), tiles(y))
    # Pairs hold 106 bits, of which this sum cancels 51.
    want = exact(x, y)
    assert np.abs(array(Matrix(got.selectExpr("i", "j", "s + c as v"), 7, 4)) - want).max() <= 2.0**-48 * np.abs(want).max() < np.abs(x @ y - want).max()
    z = rng.normal(size=(7, 4))
    both = array(extended.mult(0.5, matrix_of(spark, x), matrix_of(spark, y), -3.0, matrix_of(spark, z)))
    want = exact(np.hstack((0.5 * x, -3.0 * np.eye(7))), np.vstack((y, z)))
    assert np.allclose(both, want, rtol=2.0**-52, atol=0)


def test_values_that_are_not_finite_go_through():
    from gridloom.operators.blocks import sliced

    x, y = np.array([[np.inf, 1.0], [1.0, 2.0]]), np.eye(2)
    s, _, _ = sliced(x, y)
    assert s[0, 0] == np.inf and s[1, 1] == 2.0


@pytest.mark.parametrize("uplo", [None, "lower", "upper"])
@pytest.mark.parametrize("piece", [3, 1 << 10])
def test_large_results_by_groups_of_rows(spark, monkeypatch, piece, uplo):
    """One row with half of all cells is dealt over tasks; all others are whole in one, and no partial sums are shuffled."""
    monkeypatch.setattr(gustavson, "DENSE", 0)
    monkeypatch.setattr(gustavson, "CHUNK", 20)
    monkeypatch.setattr(gustavson, "HELD", 30)
    monkeypatch.setattr(gustavson, "PIECE", piece)
    some, other = sparse(spark, 50, 90, 90, 1), sparse(spark, 35, 90, 120, 2).T
    hot = spark.range(90).select(F.lit(60).cast("long").alias("i"), F.col("id").alias("j"), (F.col("id") % 3 - 1.5).alias("v"))
    a = Matrix(some.df.unionByName(hot), 70, 90)
    keep = {None: lambda w: w, "lower": np.tril, "upper": np.triu}[uplo]
    x, y = array(a), array(other)
    held = lambda p, q: (keep((np.abs(p) > 0).astype(float) @ (np.abs(q) > 0)) > 0).sum()
    for b, w in ((other.df, y), (None, x.T)):
        got = gustavson.product(a.df, b, 70, 90, w.shape[1], 0.5, uplo, 4)
        assert np.allclose(array(Matrix(got, 70, w.shape[1])), keep(0.5 * x @ w)) and got.count() == held(x, w)
    even = gustavson.product(some.df, other.df, 50, 90, 35, 1.0, uplo, 1 << 21)
    assert np.allclose(array(Matrix(even, 50, 35)), keep(array(some) @ y))
    assert "Aggregate" not in even._jdf.queryExecution().executedPlan().toString()


def test_large_results_of_nothing(spark, monkeypatch):
    monkeypatch.setattr(gustavson, "DENSE", 0)
    a = Matrix(spark.createDataFrame([(0, 0, 1.0)], "i long, j long, v double"), 3, 4)
    none = spark.createDataFrame([], "i long, j long, v double")
    apart = Matrix(spark.createDataFrame([(2, 1, 1.0)], "i long, j long, v double"), 4, 3)
    assert not gustavson.product(a.df, apart.df, 3, 4, 3).count() and not gustavson.product(none, None, 3, 4, 3, 1.0, "lower").count()
