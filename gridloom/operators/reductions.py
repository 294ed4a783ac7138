"""Sums, norms and extreme elements; each returns one row with the column value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .matrix import Matrix, ShapeError, Vector


def _cells(x: Matrix | Vector) -> DataFrame:
    return x.df


def total(x: Matrix | Vector) -> DataFrame:
    return _cells(x).agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("value"))


def asum(x: Matrix | Vector) -> DataFrame:
    """Sum of absolute values."""
    return _cells(x).agg(F.coalesce(F.sum(F.abs("v")), F.lit(0.0)).alias("value"))


def nrm2(x: Matrix | Vector) -> DataFrame:
    """Root of the sum of squares, scaled by the largest element against overflow; two
    passes, of which the first is one small row."""
    cells = _cells(x)
    top = cells.agg(F.max(F.abs("v")).alias("top"))
    scaled = cells.crossJoin(F.broadcast(top)).where("top > 0").agg(F.sum(F.pow(F.col("v") / F.col("top"), 2)).alias("s"), F.max("top").alias("top"))
    return scaled.select(F.coalesce(F.col("top") * F.sqrt("s"), F.lit(0.0)).alias("value"))


def dot(x: Vector, y: Vector, alpha: float = 1.0, start: float = 0.0) -> DataFrame:
    """start + alpha * x.y"""
    if x.size != y.size:
        raise ShapeError((x.size, y.size))
    both = x.df.select("i", F.col("v").alias("a")).join(y.df.select("i", F.col("v").alias("b")), "i")
    return both.agg((start + alpha * F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0.0))).alias("value"))


def amax(x: Matrix | Vector) -> DataFrame:
    return _cells(x).agg(F.coalesce(F.max(F.abs("v")), F.lit(0.0)).alias("value"))


def iamax(x: Vector, base: int = 0) -> DataFrame:
    """Index of the largest absolute value, the first of equals."""
    return x.df.agg((F.min_by("i", F.struct(-F.abs("v"), "i")) + base).alias("value"))


def iamin(x: Vector, base: int = 0) -> DataFrame:
    """Index of the smallest absolute value, the first of equals; all elements must be present."""
    return x.df.agg((F.min_by("i", F.struct(F.abs("v"), "i")) + base).alias("value"))


def norm(a: Matrix, which: str = "one", uplo: str | None = None, unit: bool = False, symmetric: bool = False) -> DataFrame:
    """one: largest column sum, inf: largest row sum, frobenius; two: the largest
    singular value.  uplo: of a triangle, with ones on its diagonal if unit, or of the
    symmetric matrix of which it is the stored half."""
    if uplo is not None:
        from .matrix import mirrored
        from .products import triangular

        a = mirrored(a, uplo) if symmetric else triangular(a, uplo, unit)
    if which in ("one", "inf"):
        sums = a.df.groupBy("j" if which == "one" else "i").agg(F.sum(F.abs("v")).alias("s"))
        return sums.agg(F.coalesce(F.max("s"), F.lit(0.0)).alias("value"))
    if which == "frobenius":
        return nrm2(a)
    if which == "two":
        from .spectral import singular_values

        return singular_values(a).agg(F.coalesce(F.max("v"), F.lit(0.0)).alias("value"))
    raise ValueError(which)
