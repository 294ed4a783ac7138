"""The operators under their customary BLAS and LAPACK names.

Arguments keep the customary letters (N/T, L/U, L/R, N/U) and order, without leading
dimensions and increments, which tables don't have; results are returned.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .functions.scalar import givens
from .operators import elementwise as _e
from .operators import factor as _f
from .operators import products as _p
from .operators import reductions as _r
from .operators.matrix import Matrix, Vector


def _t(flag: str) -> bool:
    return flag.upper() in ("T", "C")


def _uplo(flag: str) -> str:
    return "lower" if flag.upper() == "L" else "upper"


def _side(flag: str) -> str:
    return "left" if flag.upper() == "L" else "right"


def _unit(flag: str) -> bool:
    return flag.upper() == "U"


asum, nrm2, dot, iamax = _r.asum, _r.nrm2, _r.dot, _r.iamax
copy, swap = _e.copy, _e.swap


def axpy(alpha: float, x: Vector, y: Vector) -> Vector:
    return _e.axpy(y, alpha, x)


def scal(alpha: float, x: Vector) -> Vector:
    return _e.scale(x, alpha)


def rot(x: Vector, y: Vector, c: float, s: float) -> tuple[Vector, Vector]:
    return _e.rotate_vectors(x, y, c, s)


def rotg(a: float | Column, b: float | Column) -> tuple:
    """(c, s, r) of two numbers, or of two columns as columns."""
    from math import hypot

    if isinstance(a, Column) or isinstance(b, Column):
        return givens(*(x if isinstance(x, Column) else F.lit(float(x)) for x in (a, b)))
    r = hypot(a, b)
    return (1.0, 0.0, a) if b == 0 else (0.0, 1.0, b) if a == 0 else (a / r, b / r, r)


def gemv(trans: str, alpha: float, a: Matrix, x: Vector, beta: float = 0.0, y: Vector | None = None) -> Vector:
    return _p.mvmult(alpha, a, x, beta, y, trans=_t(trans))


def symv(uplo: str, alpha: float, a: Matrix, x: Vector, beta: float = 0.0, y: Vector | None = None) -> Vector:
    return _p.mvmult_sym(alpha, a, x, beta, y, _uplo(uplo))


def trmv(uplo: str, trans: str, diag: str, a: Matrix, x: Vector) -> Vector:
    return _p.mvmult_trm(1.0, a, x, _uplo(uplo), _t(trans), _unit(diag))


def trsv(uplo: str, trans: str, diag: str, a: Matrix, x: Vector) -> Vector:
    return _f.mvsolve_trm(1.0, a, x, _uplo(uplo), _t(trans), _unit(diag))


def ger(alpha: float, x: Vector, y: Vector, a: Matrix) -> Matrix:
    return _p.mvupdate(1.0, a, alpha, x, y)


def syr(uplo: str, alpha: float, x: Vector, a: Matrix) -> Matrix:
    return _p.mvupdate_sym(1.0, a, alpha, x, _uplo(uplo))


def syr2(uplo: str, alpha: float, x: Vector, y: Vector, a: Matrix) -> Matrix:
    return _p.mvupdate2_sym(1.0, a, alpha, x, y, _uplo(uplo))


def gemm(transa: str, transb: str, alpha: float, a: Matrix, b: Matrix, beta: float = 0.0, c: Matrix | None = None) -> Matrix:
    return _p.mult(alpha, a, b, beta, c, _t(transa), _t(transb))


def symm(side: str, uplo: str, alpha: float, a: Matrix, b: Matrix, beta: float = 0.0, c: Matrix | None = None) -> Matrix:
    return _p.mult_sym(alpha, a, b, beta, c, _uplo(uplo), _side(side))


def trmm(side: str, uplo: str, trans: str, diag: str, alpha: float, a: Matrix, b: Matrix) -> Matrix:
    return _p.mult_trm(alpha, a, b, _uplo(uplo), _side(side), _t(trans), _unit(diag))


def trsm(side: str, uplo: str, trans: str, diag: str, alpha: float, a: Matrix, b: Matrix) -> Matrix:
    return _f.solve_triangular(a, b, alpha, _uplo(uplo), _side(side), _t(trans), _unit(diag))


def syrk(uplo: str, trans: str, alpha: float, a: Matrix, beta: float = 0.0, c: Matrix | None = None) -> Matrix:
    return _p.update_sym(alpha, a, beta, c, _uplo(uplo), _t(trans))


def syr2k(uplo: str, trans: str, alpha: float, a: Matrix, b: Matrix, beta: float = 0.0, c: Matrix | None = None) -> Matrix:
    return _p.update2_sym(alpha, a, b, beta, c, _uplo(uplo), _t(trans))


def getrf(a: Matrix) -> _f.LU:
    return _f.lu(a)


def getrs(trans: str, f: _f.LU, b: Matrix) -> Matrix:
    return _f.lu_solve(f, b, _t(trans))


def potrf(uplo: str, a: Matrix) -> Matrix:
    return _f.cholesky(a, _uplo(uplo))


def potrs(uplo: str, factor: Matrix, b: Matrix) -> Matrix:
    return _f.cholesky_solve(factor, b, _uplo(uplo))


def posv(uplo: str, a: Matrix, b: Matrix) -> Matrix:
    return potrs(uplo, potrf(uplo, a), b)
