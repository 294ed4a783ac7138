"""Random butterfly transforms, level by level, on coordinate tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.random import uniform_at
from .matrix import Matrix, ShapeError


def padded_size(n: int, depth: int) -> int:
    """The least multiple of 2**depth that is not below n."""
    step = 1 << depth
    return -(-n // step) * step


def generate(spark: SparkSession, n: int, depth: int, seed: int = 0) -> DataFrame:
    """(level, i, r): the random diagonals exp(u/10), u uniform on [-1/2, 1/2)."""
    levels = spark.range(n * depth).select((F.col("id") % depth).cast("int").alias("level"), F.floor(F.col("id") / depth).cast("long").alias("i"))
    return levels.select("level", "i", F.exp((uniform_at(F.col("i"), F.col("level"), seed) - 0.5) / 10).alias("r"))


def apply(a: Matrix, diagonals: DataFrame, depth: int, trans: bool = False) -> Matrix:
    """U*A (or U^T*A): U is the product of `depth` levels of butterflies, the outermost
    with two halves.  A level pairs row i with the row half a block further."""
    if a.rows % (1 << depth):
        raise ShapeError(f"{a.rows} rows are no multiple of {1 << depth}")
    cells = a.df
    for level in range(depth) if trans else reversed(range(depth)):
        half = a.rows >> (level + 1)
        low = (F.floor(F.col("i") / half) % 2) == 0
        d = diagonals.where(F.col("level") == level).select("i", "r")
        scaled = cells if trans else cells.join(d, "i").select("i", "j", (F.col("v") * F.col("r")).alias("v"))
        # Each cell reaches both rows of its pair; the sum by cell is one shuffle.
        base = F.when(low, F.col("i")).otherwise(F.col("i") - half)
        spread = scaled.select(base.alias("b"), low.alias("low"), "j", "v").groupBy("b", "j").agg(
            F.coalesce(F.sum(F.when(F.col("low"), F.col("v"))), F.lit(0.0)).alias("x"), F.coalesce(F.sum(F.when(~F.col("low"), F.col("v"))), F.lit(0.0)).alias("y")
        )
        root = 2.0**-0.5
        out = spread.select("j", F.explode(F.array(
            F.struct(F.col("b").alias("i"), ((F.col("x") + F.col("y")) * root).alias("v")),
            F.struct((F.col("b") + half).alias("i"), ((F.col("x") - F.col("y")) * root).alias("v")),
        )).alias("c")).select("c.i", "j", "c.v")
        cells = out.join(d, "i").select("i", "j", (F.col("v") * F.col("r")).alias("v")) if trans else out
    return Matrix(cells, a.rows, a.cols)


def two_sided(a: Matrix, left: DataFrame, right: DataFrame, depth: int) -> Matrix:
    """U^T*A*V."""
    return apply(apply(a, left, depth, trans=True).T, right, depth, trans=True).T
