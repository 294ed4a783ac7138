"""Sorting, permutations and pivots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.cut import cut
from .matrix import Matrix, ShapeError, Vector


def ranked(x: DataFrame, ascending: bool = True, absolute: bool = False) -> DataFrame:
    """(i, v, k): every element of (i, v) with its place k in order; equal ones by their index.

    The order is global: rows are ranged by value and ranked inside the ranges, whose
    sizes are summed first, so no task sees all rows.
    """
    key = F.abs("v") if absolute else F.col("v")
    ranged = x.select("i", "v").withColumn("key", key if ascending else -key).repartitionByRange("key", "i").sortWithinPartitions("key", "i")
    # Written once, so that both uses below see the same ranges.
    ranged = cut(ranged.withColumn("part", F.spark_partition_id()), "ranges")
    inside = ranged.withColumn("n", F.row_number().over(Window.partitionBy("part").orderBy("key", "i")))
    counts = ranged.groupBy("part").count()
    before = counts.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"))
    return inside.join(before, "part").select("i", "v", (F.col("before") + F.col("n") - 1).cast("long").alias("k"))


def sort_vector(x: Vector, ascending: bool = True, absolute: bool = False) -> Vector:
    """Elements in order; equal ones by their index."""
    return Vector(ranked(x.df, ascending, absolute).select(F.col("k").alias("i"), "v"), x.size)


def sort_eigen(d: Vector, u: Matrix | None = None, v: Matrix | None = None, c: Matrix | None = None, ascending: bool = False):
    """(d, u, v, c): d sorted, and with it the columns of u, the rows of v and the columns of c."""
    moved = ranked(d.df, ascending)
    move = moved.select(F.col("i").alias("old"), F.col("k").alias("to"))
    cols = lambda a: a and Matrix(a.df.join(move, F.col("j") == F.col("old")).select("i", F.col("to").alias("j"), "v"), a.rows, a.cols)
    rows = lambda a: a and Matrix(a.df.join(move, F.col("i") == F.col("old")).select(F.col("to").alias("i"), "j", "v"), a.rows, a.cols)
    return Vector(moved.select(F.col("k").alias("i"), "v"), d.size), cols(u), rows(v), cols(c)


def compose(pivots: list[int], n: int, backward: bool = False) -> list[int]:
    """order[k]: which row comes to place k after the interchanges k <-> |p| - 1 (1-based
    p; 0: none; the list may be shorter than n; a negative pair is one interchange of
    its second place)."""
    order = list(range(n))
    steps, k = [], 0
    while k < len(pivots):
        p = pivots[k]
        if p < 0 and k + 1 < len(pivots) and pivots[k + 1] == p:
            steps.append((k + 1, -p - 1))
            k += 2
            continue
        if p:
            steps.append((k, abs(p) - 1))
        k += 1
    for a, b in reversed(steps) if backward else steps:
        if b >= n:
            raise ShapeError((b + 1, n))
        order[a], order[b] = order[b], order[a]
    return order


def _table(spark: SparkSession, order: list[int]) -> DataFrame:
    return spark.createDataFrame([(int(o), k) for k, o in enumerate(order)], "old long, new long")


def pivot_rows(a: Matrix, pivots: list[int], backward: bool = False) -> Matrix:
    move = _table(a.df.sparkSession, compose(pivots, a.rows, backward))
    return Matrix(a.df.join(move, F.col("i") == F.col("old")).select(F.col("new").alias("i"), "j", "v"), a.rows, a.cols)


def pivot_columns(a: Matrix, pivots: list[int], backward: bool = False) -> Matrix:
    return pivot_rows(a.T, pivots, backward).T


def pivot_symmetric(a: Matrix, pivots: list[int], uplo: str = "lower", backward: bool = False) -> Matrix:
    """Rows and columns of a symmetric matrix of which one triangle is stored."""
    move = _table(a.df.sparkSession, compose(pivots, a.rows, backward))
    half = a.df.where(F.col("i") >= F.col("j")) if uplo == "lower" else a.df.where(F.col("i") <= F.col("j"))
    to = half.join(move, F.col("i") == F.col("old")).select(F.col("new").alias("p"), "j", "v").join(move, F.col("j") == F.col("old")).select("p", F.col("new").alias("q"), "v")
    big, low = F.greatest("p", "q"), F.least("p", "q")
    return Matrix(to.select((big if uplo == "lower" else low).alias("i"), (low if uplo == "lower" else big).alias("j"), "v"), a.rows, a.cols)


def pivot_sort(x: Vector, ascending: bool = False) -> DataFrame:
    """(k, p): 1-based index of the k-th element by absolute value, ties by index."""
    return ranked(x.df, ascending, absolute=True).select("k", (F.col("i") + 1).alias("p"))
