"""Matrices and vectors as coordinate tables; construction, views and access.

A Matrix is a DataFrame (i, j, v) with 0-based long indices, at most one row for a
cell and its size; absent cells are zero.  All operators return new values.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.random import normal_at, uniform_at


@dataclass(frozen=True)
class Vector:
    df: DataFrame
    size: int


@dataclass(frozen=True)
class Matrix:
    df: DataFrame
    rows: int
    cols: int

    @property
    def T(self) -> Matrix:  # noqa: N802
        return Matrix(self.df.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"), self.cols, self.rows)

    @property
    def size(self) -> int:
        return self.rows * self.cols

    def with_values(self, v: Column) -> Matrix:
        return Matrix(self.df.select("i", "j", v.alias("v")), self.rows, self.cols)

    def where(self, condition: Column) -> Matrix:
        return Matrix(self.df.where(condition), self.rows, self.cols)


class ShapeError(ValueError):
    """Operands whose sizes don't fit."""


def same_shape(*matrices: Matrix) -> None:
    if len({(m.rows, m.cols) for m in matrices}) > 1:
        raise ShapeError([(m.rows, m.cols) for m in matrices])


def index(k: int, n: int) -> int:
    """An index with negative ones counted from the end."""
    k = k + n if k < 0 else k
    if not 0 <= k < n:
        raise IndexError(k)
    return k


# Construction


def from_table(table: DataFrame, i: str | Column, j: str | Column, v: str | Column, rows: int, cols: int) -> Matrix:
    """Sums of v by (i, j); the pre-aggregation happens before the shuffle.  Rows without i, j
    or v are no cells and are left out."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    table = table.where(c(i).isNotNull() & c(j).isNotNull() & c(v).isNotNull())
    cells = table.select(c(i).cast("long").alias("i"), c(j).cast("long").alias("j"), c(v).cast("double").alias("v"))
    return Matrix(cells.groupBy("i", "j").agg(F.sum("v").alias("v")), rows, cols)


def from_arrays(table: DataFrame, i: str, values: str, rows: int, cols: int) -> Matrix:
    """One row of the matrix for each row of the table; no shuffle."""
    return Matrix(table.select(F.col(i).cast("long").alias("i"), F.posexplode(values).alias("j", "v")).select("i", F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v")), rows, cols)


def vector_from(table: DataFrame, i: str | Column, v: str | Column, size: int) -> Vector:
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return Vector(table.select(c(i).cast("long").alias("i"), c(v).cast("double").alias("v")).groupBy("i").agg(F.sum("v").alias("v")), size)


def grid(spark: SparkSession, rows: int, cols: int) -> DataFrame:
    """All (i, j), generated where they are used."""
    return spark.range(max(rows, 0) * max(cols, 0)).select((F.col("id") % max(rows, 1)).alias("i"), F.floor(F.col("id") / max(rows, 1)).cast("long").alias("j"))


def triangle(uplo: str | None, strict: bool = False) -> Column:
    """Condition for the lower or upper triangle (None: everywhere)."""
    i, j = F.col("i"), F.col("j")
    if uplo is None:
        return F.lit(True)
    if uplo == "lower":
        return i > j if strict else i >= j
    if uplo == "upper":
        return i < j if strict else i <= j
    raise ValueError(uplo)


def generate(spark: SparkSession, rows: int, cols: int, value, uplo: str | None = None, unit: bool = False, symmetric: bool = False) -> Matrix:
    """value(i, j) in the cells of a triangle (None: all), with a unit diagonal or mirrored."""
    i, j = F.col("i"), F.col("j")
    v = value(F.greatest(i, j), F.least(i, j)) if symmetric else value(i, j)
    v = F.when(i == j, 1.0).otherwise(v) if unit else v
    return Matrix(grid(spark, rows, cols).where(triangle(uplo)).select("i", "j", v.cast("double").alias("v")), rows, cols)


def zeros(spark: SparkSession, rows: int, cols: int) -> Matrix:
    return Matrix(spark.createDataFrame([], "i long, j long, v double"), max(rows, 0), max(cols, 0))


def identity(spark: SparkSession, n: int) -> Matrix:
    return Matrix(spark.range(n).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v")), n, n)


def uniform(spark: SparkSession, rows: int, cols: int, seed: int = 0) -> Matrix:
    return generate(spark, rows, cols, lambda i, j: uniform_at(i, j, seed))


def normal(spark: SparkSession, rows: int, cols: int, seed: int = 0) -> Matrix:
    return generate(spark, rows, cols, lambda i, j: normal_at(i, j, seed))


def make_triangular(a: Matrix, uplo: str, unit: bool = False) -> Matrix:
    """The triangle alone; a unit diagonal is put in."""
    if not unit:
        return a.where(triangle(uplo))
    ones = identity(a.df.sparkSession, min(a.rows, a.cols)).df
    return Matrix(a.df.where(triangle(uplo, strict=True)).unionByName(ones), a.rows, a.cols)


def mirrored(a: Matrix, uplo: str = "lower") -> Matrix:
    """The symmetric matrix of which one triangle is given; the other is not read."""
    half = a.df.where(triangle(uplo))
    off = half.where("i != j").select(F.col("j").alias("i"), F.col("i").alias("j"), "v")
    return Matrix(half.unionByName(off), a.rows, a.cols)


def dense(a: Matrix) -> Matrix:
    """Every cell as a row: absent ones as 0."""
    cells = grid(a.df.sparkSession, a.rows, a.cols).join(a.df, ["i", "j"], "left")
    return Matrix(cells.select("i", "j", F.coalesce("v", F.lit(0.0)).alias("v")), a.rows, a.cols)


def append(a: Matrix, cells: DataFrame) -> Matrix:
    """More cells (i, j, v); those that are there already must not be among them."""
    return Matrix(a.df.unionByName(cells.select("i", "j", "v")), a.rows, a.cols)


# Views and access


def get(a: Matrix, row: int, col: int) -> DataFrame:
    """One row (v), 0 for an absent cell."""
    at = (F.col("i") == index(row, a.rows)) & (F.col("j") == index(col, a.cols))
    return a.df.where(at).agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("v"))


def get_at(a: Matrix, k: int) -> DataFrame:
    """The element at a linear index, columns first."""
    k = index(k, a.size)
    return get(a, k % a.rows, k // a.rows)


def set_value(a: Matrix, row: int, col: int, value: float) -> Matrix:
    row, col = index(row, a.rows), index(col, a.cols)
    rest = a.df.where(~((F.col("i") == row) & (F.col("j") == col)))
    one = a.df.sparkSession.range(1).select(F.lit(row).cast("long").alias("i"), F.lit(col).cast("long").alias("j"), F.lit(float(value)).alias("v"))
    return Matrix(rest.unionByName(one), a.rows, a.cols)


def set_at(a: Matrix, k: int, value: float) -> Matrix:
    """The element at a linear index, columns first, replaced."""
    k = index(k, a.size)
    return set_value(a, k % a.rows, k // a.rows, value)


def submatrix(a: Matrix, row: int, col: int, rows: int = -1, cols: int = -1) -> Matrix:
    """The rectangle from (row, col); negative extents reach to the end."""
    row, col = index(row, a.rows), index(col, a.cols)
    rows = a.rows - row if rows < 0 else rows
    cols = a.cols - col if cols < 0 else cols
    if row + rows > a.rows or col + cols > a.cols:
        raise ShapeError((row, col, rows, cols))
    inside = a.df.where(F.col("i").between(row, row + rows - 1) & F.col("j").between(col, col + cols - 1))
    return Matrix(inside.select((F.col("i") - row).alias("i"), (F.col("j") - col).alias("j"), "v"), rows, cols)


def strided(a: Matrix, row: int, col: int, rows: int, cols: int, row_step: int = 1, col_step: int = 1) -> Matrix:
    """Every row_step-th row and col_step-th column from (row, col)."""
    i, j = F.col("i") - row, F.col("j") - col
    inside = i.between(0, (rows - 1) * row_step) & j.between(0, (cols - 1) * col_step) & (i % row_step == 0) & (j % col_step == 0)
    return Matrix(a.df.where(inside).select((i / row_step).cast("long").alias("i"), (j / col_step).cast("long").alias("j"), "v"), rows, cols)


def row_of(a: Matrix, row: int) -> Vector:
    return Vector(a.df.where(F.col("i") == index(row, a.rows)).select(F.col("j").alias("i"), "v"), a.cols)


def column_of(a: Matrix, col: int) -> Vector:
    return Vector(a.df.where(F.col("j") == index(col, a.cols)).select("i", "v"), a.rows)


def diagonal(a: Matrix, k: int = 0) -> Vector:
    """The k-th diagonal: k > 0 above the main one, k < 0 below."""
    size = max(0, min(a.cols - k, a.rows) if k >= 0 else min(a.rows + k, a.cols))
    return Vector(a.df.where(F.col("j") - F.col("i") == k).select(F.least("i", "j").alias("i"), "v"), size)


def subvector(x: Vector, start: int, size: int = -1) -> Vector:
    start = index(start, x.size)
    size = x.size - start if size < 0 else size
    return Vector(x.df.where(F.col("i").between(start, start + size - 1)).select((F.col("i") - start).alias("i"), "v"), size)


def as_column(x: Vector) -> Matrix:
    return Matrix(x.df.select("i", F.lit(0).cast("long").alias("j"), "v"), x.size, 1)


def as_row(x: Vector) -> Matrix:
    return as_column(x).T


def pretty(a: Matrix, most: int = 9) -> DataFrame:
    """The top left corner as a table of columns c0, c1, ..."""
    cells = a.df.where((F.col("i") < most) & (F.col("j") < most))
    wide = cells.groupBy("i").pivot("j", list(range(min(most, a.cols)))).agg(F.first("v"))
    return wide.select("i", *[F.coalesce(F.col(str(c)), F.lit(0.0)).alias(f"c{c}") for c in range(min(most, a.cols))])
