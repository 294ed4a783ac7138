"""Element-wise operators: copies, scaling, sums and maps."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .matrix import Matrix, ShapeError, Vector, dense, same_shape, triangle


def copy(b: Matrix, trans: bool = False) -> Matrix:
    return b.T if trans else b


def swap(x: Vector, y: Vector) -> tuple[Vector, Vector]:
    if x.size != y.size:
        raise ShapeError((x.size, y.size))
    return y, x


def scale(a: Matrix | Vector, alpha: float, uplo: str | None = None, unit: bool = False):
    """alpha times the elements of a triangle (None: all); a unit diagonal stays."""
    if isinstance(a, Vector):
        return Vector(a.df.withColumn("v", F.lit(float(alpha)) * F.col("v")), a.size)
    return a.with_values(F.when(triangle(uplo, strict=unit and uplo is not None), float(alpha) * F.col("v")).otherwise(F.col("v")))


def add_constant(a: Matrix, alpha: float, uplo: str | None = None, unit: bool = False) -> Matrix:
    """a + alpha on a triangle (None: everywhere), absent cells included."""
    return dense(a).with_values(F.when(triangle(uplo, strict=unit and uplo is not None), F.col("v") + float(alpha)).otherwise(F.col("v")))


def scale_factors(source: float, target: float) -> list[float]:
    """Factors whose product is target / source, none of which over- or underflows: the
    quotient itself where that is safe, else powers of two that bring the source near 1,
    the quotient of the fractions, and powers of two that lead to the target."""
    if source == 0 or not math.isfinite(source) or math.isnan(target):
        raise ValueError("scale_to needs a finite, non-zero source")
    if target == 0 or math.isinf(target):
        return [target / source]
    (top, up), (bottom, down) = math.frexp(target), math.frexp(source)
    if abs(up - down) < 1000 and min(up, down) > -1021:
        return [target / source]

    def powers(k: int) -> list[float]:
        first = max(-1000, min(1000, k))
        return [math.ldexp(1.0, x) for x in (first, k - first) if x]

    return [*powers(-down), top / bottom, *powers(up)]


def scale_to(a: Matrix, source: float, target: float, uplo: str | None = None) -> Matrix:
    """a * (target / source) without over- or underflow on the way."""
    for factor in scale_factors(source, target):
        a = scale(a, factor, uplo)
    return a


def plus(alpha: float, a: Matrix, beta: float, b: Matrix, trans: bool = False, uplo: str | None = None, absolute: bool = False) -> Matrix:
    """alpha*A + beta*op(B) on a triangle, the rest of A kept; a 1x1 B is added everywhere;
    `absolute` takes B's absolute values.  One shuffle: a union summed by cell."""
    if (b.rows, b.cols) == (1, 1) and (a.rows, a.cols) != (1, 1):
        one = b.df.agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("one"))
        cells = dense(a).df.crossJoin(F.broadcast(one))
        return Matrix(cells.select("i", "j", F.when(triangle(uplo), alpha * F.col("v") + beta * F.col("one")).otherwise(F.col("v")).alias("v")), a.rows, a.cols)
    b = copy(b, trans)
    same_shape(a, b)
    value = F.abs("v") if absolute else F.col("v")
    left = a.df.select("i", "j", F.when(triangle(uplo), alpha * F.col("v")).otherwise(F.col("v")).alias("v"))
    right = b.df.where(triangle(uplo)).select("i", "j", (beta * value).alias("v"))
    return Matrix(left.unionByName(right).groupBy("i", "j").agg(F.sum("v").alias("v")), a.rows, a.cols)


def axpby(beta: float, y: Vector, alpha: float, x: Vector) -> Vector:
    """beta*y + alpha*x; beta = 0 ignores what y holds."""
    if x.size != y.size:
        raise ShapeError((x.size, y.size))
    parts = x.df.select("i", (alpha * F.col("v")).alias("v"))
    if beta != 0:
        parts = parts.unionByName(y.df.select("i", (beta * F.col("v")).alias("v")))
    return Vector(parts.groupBy("i").agg(F.sum("v").alias("v")), y.size)


def axpy(y: Vector, alpha: float, x: Vector) -> Vector:
    return axpby(1.0, y, alpha, x)


def multiply(a: Matrix, b: Matrix) -> Matrix:
    """Element by element; cells absent on one side are 0 and so is the product."""
    same_shape(a, b)
    cells = a.df.alias("a").join(b.df.alias("b"), ["i", "j"]).select("i", "j", (F.col("a.v") * F.col("b.v")).alias("v"))
    return Matrix(cells, a.rows, a.cols)


def apply(a: Matrix, f: Callable[[Column], Column], uplo: str | None = None) -> Matrix:
    """f of every element of a triangle; f builds a column expression, which may hold
    parameters or a pandas UDF.  Absent cells count as 0."""
    return dense(a).with_values(F.when(triangle(uplo), f(F.col("v"))).otherwise(F.col("v")))


def iterate(a: Matrix, f: Callable[[Column], Column], uplo: str | None = None) -> DataFrame:
    """Visits the elements by columns until f gives a negative number: one row (visited,
    stopped_i, stopped_j), the latter null if nothing stopped it.  The first stop is a
    minimum over positions, so nothing is gathered in order."""
    cells = dense(a).df.where(triangle(uplo)).withColumn("at", F.col("j") * a.rows + F.col("i"))
    stop = cells.where(f(F.col("v")) < 0).agg(F.min("at").alias("stop"))
    seen = cells.crossJoin(F.broadcast(stop)).where(F.col("stop").isNull() | (F.col("at") <= F.col("stop")))
    return seen.agg(F.count("*").alias("visited"), F.max("stop").alias("stop")).select(
        "visited", (F.col("stop") % a.rows).alias("stopped_i"), F.floor(F.col("stop") / a.rows).cast("long").alias("stopped_j")
    )


def all_close(a: Matrix, b: Matrix, atol: float = 1e-8, rtol: float = 1e-5) -> DataFrame:
    """One row (close): whether |a - b| <= atol + rtol*|b| in every cell."""
    if (a.rows, a.cols) != (b.rows, b.cols):
        return a.df.sparkSession.range(1).select(F.lit(False).alias("close"))
    both = a.df.select("i", "j", F.col("v").alias("a")).join(b.df.select("i", "j", F.col("v").alias("b")), ["i", "j"], "full")
    x, y = F.coalesce("a", F.lit(0.0)), F.coalesce("b", F.lit(0.0))
    return both.agg(F.coalesce(F.bool_and(F.abs(x - y) <= atol + rtol * F.abs(y)), F.lit(True)).alias("close"))


def scale_rows(a: Matrix, d: Vector, alpha: float = 1.0, invert: bool = False) -> Matrix:
    """alpha * diag(d) * A, or with the inverse diagonal."""
    if d.size != a.rows:
        raise ShapeError((d.size, a.rows))
    factor = F.col("a.v") / F.col("d.v") if invert else F.col("a.v") * F.col("d.v")
    cells = a.df.alias("a").join(d.df.alias("d"), F.col("a.i") == F.col("d.i"))
    return Matrix(cells.select("a.i", "a.j", (alpha * factor).alias("v")), a.rows, a.cols)


def mult_diag(a: Matrix, alpha: float, d: Vector, side: str = "left") -> Matrix:
    """alpha * diag(d) * A or alpha * A * diag(d)."""
    return scale_rows(a, d, alpha) if side == "left" else scale_rows(a.T, d, alpha).T


def solve_diag(a: Matrix, alpha: float, d: Vector, side: str = "left") -> Matrix:
    """alpha * diag(d)^-1 * A or alpha * A * diag(d)^-1."""
    return scale_rows(a, d, alpha, invert=True) if side == "left" else scale_rows(a.T, d, alpha, invert=True).T


def rotate_vectors(x: Vector, y: Vector, c: float, s: float) -> tuple[Vector, Vector]:
    """(c*x + s*y, c*y - s*x)."""
    return axpby(c, x, s, y), axpby(c, y, -s, x)
