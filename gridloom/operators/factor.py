"""LU, Cholesky and LDL factorisations, their solvers and inverses."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cut import cut
from .elementwise import solve_diag
from .matrix import Matrix, ShapeError, Vector, as_column, diagonal, identity, make_triangular, mirrored
from .rows import NARROW_BYTES, PANEL, Rows, check_shared, eliminate, from_rows, matrix_of, solve_narrow, solve_rows, to_rows


@dataclass(frozen=True)
class LU:
    """A = P*L*U: packed holds U and the unit triangle L below; `moves` has (i, k) for the
    row i of A that became row k; `singular` says that a pivot was 0."""

    packed: Matrix
    moves: DataFrame
    singular: bool
    rows: Rows | None = None  # packed, in row layout

    @property
    def order(self) -> list[int]:
        """order[k] is the row of A that became row k."""
        check_shared(self.packed.rows)
        return [r["i"] for r in self.moves.orderBy("k").collect()]

    @property
    def lower(self) -> Matrix:
        wide = min(self.packed.rows, self.packed.cols)
        return make_triangular(Matrix(self.packed.df.where(F.col("j") < wide), self.packed.rows, wide), "lower", unit=True)

    @property
    def upper(self) -> Matrix:
        high = min(self.packed.rows, self.packed.cols)
        return make_triangular(Matrix(self.packed.df.where(F.col("i") < high), high, self.packed.cols), "upper")

    def pivots(self) -> list[int]:
        """The order as a 1-based list of interchanges."""
        order = self.order
        at, out = list(range(len(order))), []
        where = {v: k for k, v in enumerate(at)}
        for k, want in enumerate(order):
            p = where[want]
            out.append(p + 1)
            at[k], at[p] = at[p], at[k]
            where[at[k]], where[at[p]] = k, p
        return out


def relabel(a: Matrix, moves: DataFrame, inverse: bool = False) -> Matrix:
    """Rows reordered: row i becomes row k for each (i, k), or the other way round."""
    pairs = moves.select(F.col("k").alias("i"), F.col("i").alias("k")) if inverse else moves
    return Matrix(a.df.join(pairs, "i").select(F.col("k").alias("i"), "j", "v"), a.rows, a.cols)


def lu(a: Matrix, pivot: bool = True, panel: int = PANEL) -> LU:
    """Factorises an m x n matrix; with pivot=False rows stay in place."""
    packed, moves, singular = eliminate(to_rows(a), "partial" if pivot else "none", panel)
    return LU(from_rows(packed), moves, singular, packed)


def solve_triangular(a: Matrix, b: Matrix, alpha: float = 1.0, uplo: str = "lower", side: str = "left", trans: bool = False, unit: bool = False, panel: int = PANEL) -> Matrix:
    """alpha*op(A)^-1*B or alpha*B*op(A)^-1 for a triangle of A."""
    if side == "right":
        return solve_triangular(a, b.T, alpha, uplo, "left", not trans, unit, panel).T
    if a.rows != a.cols or b.rows != a.rows:
        raise ShapeError((a.rows, a.cols, b.rows, b.cols))
    if _narrow(b):
        return matrix_of(a.df.sparkSession, alpha * solve_narrow(to_rows(a), _dense(b), uplo == "lower", unit, trans, panel))
    half = a.where(F.col("i") >= F.col("j")) if uplo == "lower" else a.where(F.col("i") <= F.col("j"))
    half = half.T if trans else half
    out = from_rows(solve_rows(to_rows(half), to_rows(b), (uplo == "lower") != trans, unit, panel))
    return out.with_values(alpha * F.col("v")) if alpha != 1 else out


def _narrow(b: Matrix) -> bool:
    return 8 * b.rows * b.cols <= NARROW_BYTES


def _dense(b: Matrix) -> np.ndarray:
    """A narrow right-hand side as an array."""
    out = np.zeros((b.rows, b.cols))
    cells = b.df.select("i", "j", "v").toArrow()
    np.add.at(out, (cells["i"].to_numpy(), cells["j"].to_numpy()), cells["v"].to_numpy())
    return out


def mvsolve_trm(alpha: float, a: Matrix, x: Vector, uplo: str = "lower", trans: bool = False, unit: bool = False) -> Vector:
    """alpha*op(A)^-1*x."""
    out = solve_triangular(a, as_column(x), alpha, uplo, "left", trans, unit)
    return Vector(out.df.select("i", "v"), x.size)


def lu_solve(f: LU, b: Matrix, trans: bool = False) -> Matrix:
    """X with A*X = B, or A^T*X = B (U^T, then L^T, then the rows put back).  ArithmeticError
    if a pivot was 0."""
    if f.singular:
        raise ArithmeticError("the matrix is singular")
    spark = f.packed.df.sparkSession
    if f.rows is not None and _narrow(b):
        if trans:
            y = solve_narrow(f.rows, _dense(b), False, trans=True)
            return relabel(matrix_of(spark, solve_narrow(f.rows, y, True, unit=True, trans=True)), f.moves, inverse=True)
        y = solve_narrow(f.rows, _dense(relabel(b, f.moves)), True, unit=True)
        return matrix_of(spark, solve_narrow(f.rows, y, False))
    if trans:
        y = solve_triangular(f.packed, b, uplo="upper", trans=True)
        return relabel(solve_triangular(f.packed, y, uplo="lower", trans=True, unit=True), f.moves, inverse=True)
    y = solve_triangular(f.packed, relabel(b, f.moves), uplo="lower", unit=True)
    return solve_triangular(f.packed, y, uplo="upper")


def lu_inverse(f: LU) -> Matrix:
    return lu_solve(f, identity(f.packed.df.sparkSession, f.packed.rows))


def cholesky(a: Matrix, uplo: str = "lower", panel: int = PANEL) -> Matrix:
    """L with A = L*L^T (or U with A = U^T*U) from one triangle of A; ArithmeticError if
    A is not positive definite."""
    packed, _, _ = eliminate(to_rows(mirrored(a, uplo)), "cholesky", panel)
    low = make_triangular(from_rows(packed), "lower")
    return low if uplo == "lower" else low.T


def cholesky_solve(factor: Matrix, b: Matrix, uplo: str = "lower") -> Matrix:
    if _narrow(b):
        rows = to_rows(factor)
        rows = Rows(cut(rows.df, "factor"), rows.rows, rows.cols)
        y = solve_narrow(rows, _dense(b), uplo == "lower", trans=uplo == "upper")
        return matrix_of(factor.df.sparkSession, solve_narrow(rows, y, uplo == "lower", trans=uplo == "lower"))
    y = solve_triangular(factor, b, uplo=uplo, trans=uplo == "upper")
    return solve_triangular(factor, y, uplo=uplo, trans=uplo == "lower")


def cholesky_inverse(factor: Matrix, uplo: str = "lower") -> Matrix:
    return cholesky_solve(factor, identity(factor.df.sparkSession, factor.rows), uplo)


def triangular_inverse(a: Matrix, uplo: str = "lower", unit: bool = False) -> Matrix:
    return make_triangular(solve_triangular(a, identity(a.df.sparkSession, a.rows), uplo=uplo, unit=unit), uplo)


@dataclass(frozen=True)
class LDL:
    """A = L*D*L^T (uplo lower) or U^T... of the mirrored order (upper: U*D*U^T)."""

    factor: Matrix
    d: Vector
    uplo: str


def _reversed(a: Matrix) -> Matrix:
    return Matrix(a.df.select((a.rows - 1 - F.col("i")).alias("i"), (a.cols - 1 - F.col("j")).alias("j"), "v"), a.rows, a.cols)


def ldl(a: Matrix, uplo: str = "lower", panel: int = PANEL) -> LDL:
    """Unpivoted L*D*L^T from the lower, or U*D*U^T from the upper triangle.  The upper
    form is the lower one of the matrix read backwards.  ArithmeticError where a pivot is
    0 and the column below it is not: such a matrix has no factors without pivoting."""
    full = mirrored(a, uplo)
    if uplo == "upper":
        f = ldl(_reversed(full), "lower", panel)
        d = Vector(f.d.df.select((a.rows - 1 - F.col("i")).alias("i"), "v"), a.rows)
        return LDL(_reversed(f.factor), d, "upper")
    packed, _, _ = eliminate(to_rows(full), "none", panel)
    whole = from_rows(packed)
    return LDL(make_triangular(whole, "lower", unit=True), diagonal(whole), "lower")


def ldl_solve(f: LDL, b: Matrix) -> Matrix:
    """X with A*X = B; ArithmeticError if an element of D is 0."""
    if f.d.df.agg(F.coalesce(F.count_if(F.col("v") != 0), F.lit(0))).first()[0] < f.d.size:
        raise ArithmeticError("the matrix is singular")
    y = solve_triangular(f.factor, b, uplo=f.uplo, unit=True)
    return solve_triangular(f.factor, solve_diag(y, 1.0, f.d), uplo=f.uplo, trans=True, unit=True)


def ldl_inverse(f: LDL) -> Matrix:
    return ldl_solve(f, identity(f.factor.df.sparkSession, f.factor.rows))


def residual(a: Matrix, x: Matrix, b: Matrix) -> DataFrame:
    """One row (value): the largest |A*X - B|."""
    from .elementwise import plus
    from .products import mult

    return plus(1.0, mult(1.0, a, x), -1.0, b).df.agg(F.max(F.abs("v")).alias("value"))


__all__ = ["LDL", "LU", "Rows", "cholesky", "cholesky_inverse", "cholesky_solve", "ldl", "ldl_inverse", "ldl_solve", "lu", "lu_inverse", "lu_solve", "mvsolve_trm", "relabel", "residual", "solve_triangular", "triangular_inverse"]
