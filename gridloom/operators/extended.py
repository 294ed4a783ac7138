"""Sums and products in twice the working precision.

A partial result is a pair (s, c): its rounded value and the errors so far.  Pairs are
folded in groups of CHUNK by error-free transforms, group by group and then level by
level, so that no task ever holds more than CHUNK pairs of one result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.eft import sumk, two_prod, two_sum
from . import blocks
from .factor import solve_triangular as plain_solve
from .matrix import Matrix, ShapeError, Vector, as_column, mirrored, triangle
from .products import triangular

CHUNK = 4096


def _fold_pairs(pairs):
    def step(acc, x):
        s, e = two_sum(acc["s"], x["s"])
        return F.struct(s.alias("s"), (acc["c"] + (e + x["c"])).alias("c"))

    return F.aggregate(pairs, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c")), step)


def fold(frame: DataFrame, keys: list[str], n: int) -> DataFrame:
    """(keys, v) from (keys, at, s, c) with at in [0, n).  Groups are folded in the order of at,
    so reruns agree to the last bit."""
    while True:
        frame = frame.groupBy(*keys, F.floor(F.col("at") / CHUNK).alias("part")).agg(_fold_pairs(F.sort_array(F.collect_list(F.struct("at", "s", "c")))).alias("r")).select(*keys, F.col("part").alias("at"), "r.s", "r.c")
        n = -(-n // CHUNK)
        if n <= 1:
            return frame.select(*keys, (F.col("s") + F.col("c")).alias("v"))


def _scalar(frame: DataFrame, n: int, alpha: float = 1.0, start: float = 0.0) -> DataFrame:
    out = fold(frame.withColumn("one", F.lit(1)), ["one"], n)
    return out.agg((start + alpha * F.coalesce(F.sum("v"), F.lit(0.0))).alias("value"))


def total(x: Vector, alpha: float = 1.0, absolute: bool = False) -> DataFrame:
    """One row (value): alpha times the compensated sum (of absolute values)."""
    return _scalar(x.df.select(F.col("i").alias("at"), (F.abs("v") if absolute else F.col("v")).alias("s"), F.lit(0.0).alias("c")), x.size, alpha)


def dot(x: Vector, y: Vector, alpha: float = 1.0, start: float = 0.0) -> DataFrame:
    """start + alpha * x.y"""
    if x.size != y.size:
        raise ShapeError((x.size, y.size))
    p, e = two_prod(F.col("a"), F.col("b"))
    both = x.df.select("i", F.col("v").alias("a")).join(y.df.select("i", F.col("v").alias("b")), "i")
    return _scalar(both.select(F.col("i").alias("at"), p.alias("s"), e.alias("c")), x.size, alpha, start)


def k_fold_sum(x: Vector, k: int = 3) -> DataFrame:
    """One row (value): the sum as if in k-fold precision.  A group of CHUNK elements leaves
    k numbers, its sums of errors of errors; these are summed like elements until one
    group is left."""
    if k < 2:
        raise ValueError("k must be 2 at least")
    frame, n = x.df.select(F.col("i").alias("at"), "v"), x.size
    while True:
        values = F.transform(F.sort_array(F.collect_list(F.struct("at", "v"))), lambda c: c["v"])
        groups = frame.groupBy(F.floor(F.col("at") / CHUNK).alias("part"))
        if n <= CHUNK:
            return groups.agg(sumk(values, k).alias("value")).agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("value"))
        parts = groups.agg(sumk(values, k, parts=True).alias("p")).select("part", F.posexplode("p").alias("q", "v"))
        frame, n = parts.select((F.col("part") * k + F.col("q")).alias("at"), "v"), -(-n // CHUNK) * k


def nrm2(x: Vector) -> DataFrame:
    """Elements are scaled by a power of two, which changes no digit and keeps squares in range."""
    top = x.df.agg(F.max(F.abs("v")).alias("top")).select(F.when(F.col("top") > 0, F.pow(F.lit(2.0), F.floor(F.log2("top")))).otherwise(1.0).alias("unit"))
    scaled = x.df.crossJoin(F.broadcast(top)).select("i", (F.col("v") / F.col("unit")).alias("v"))
    p, e = two_prod(F.col("v"), F.col("v"))
    value = _scalar(scaled.select(F.col("i").alias("at"), p.alias("s"), e.alias("c")), x.size)
    return value.crossJoin(F.broadcast(top)).select((F.sqrt("value") * F.col("unit")).alias("value"))


def scale(x: Matrix | Vector, beta: float) -> DataFrame:
    """beta*x with what rounding loses: the columns of x, v and its error dv."""
    p, e = two_prod(F.lit(float(beta)), F.col("v"))
    return x.df.select(*[c for c in x.df.columns if c != "v"], p.alias("v"), e.alias("dv"))


def mvupdate_trm(beta: float, a: Matrix, alpha: float, x: Vector, y: Vector, uplo: str = "lower") -> Matrix:
    """beta*A + alpha*x*y^T on a triangle, each element rounded once."""
    return mvupdate(beta, a, alpha, x, y, uplo)


def axpby(beta: float, y: Vector, alpha: float, x: Vector) -> Vector:
    """beta*y + alpha*x, rounded once."""
    if x.size != y.size:
        raise ShapeError((x.size, y.size))
    both = y.df.select("i", F.col("v").alias("y")).join(x.df.select("i", F.col("v").alias("x")), "i", "full").select("i", F.coalesce("y", F.lit(0.0)).alias("y"), F.coalesce("x", F.lit(0.0)).alias("x"))
    p, dp = two_prod(F.lit(float(beta)), F.col("y"))
    q, dq = two_prod(F.lit(float(alpha)), F.col("x"))
    s, e = two_sum(p, q)
    return Vector(both.select("i", (s + (e + dp + dq)).alias("v")), y.size)


def mult(alpha: float, a: Matrix, b: Matrix, beta: float = 0.0, c: Matrix | None = None, trans_a: bool = False, trans_b: bool = False, uplo: str | None = None) -> Matrix:
    """beta*C + alpha*op(A)*op(B), each element from a sum in twice the precision and rounded
    once; on a triangle only with uplo.

    Dense tiles are multiplied in slices whose products are exact (`blocks.sliced`); the pairs
    of numbers that are an element so far are what tasks exchange, not its products."""
    a, b = (a.T if trans_a else a), (b.T if trans_b else b)
    if a.cols != b.rows:
        raise ShapeError((a.rows, a.cols, b.rows, b.cols))
    pairs = blocks.mult_pairs(blocks.to_blocks(a), blocks.to_blocks(b)).where(triangle(uplo))
    p, e = two_prod(F.lit(float(alpha)), F.col("s"))
    pairs = pairs.select("i", "j", p.alias("p"), (e + alpha * F.col("c")).alias("e"))
    if c is None or beta == 0:
        out = Matrix(pairs.select("i", "j", (F.col("p") + F.col("e")).alias("v")), a.rows, b.cols)
    else:
        q, f = two_prod(F.lit(float(beta)), F.col("v"))
        given = c.df.where(triangle(uplo)).select("i", "j", q.alias("q"), f.alias("f"))
        zero = lambda n: F.coalesce(n, F.lit(0.0)).alias(n)
        both = pairs.join(given, ["i", "j"], "full").select("i", "j", *map(zero, "peqf"))
        s, g = two_sum(F.col("p"), F.col("q"))
        out = Matrix(both.select("i", "j", (s + (g + (F.col("e") + F.col("f")))).alias("v")), a.rows, b.cols)
    if c is not None and uplo is not None:
        return Matrix(out.df.unionByName(c.df.where(~triangle(uplo))), a.rows, b.cols)
    return out


def _vector(m: Matrix) -> Vector:
    return Vector(m.df.select("i", "v"), m.rows)


def mvmult(alpha: float, a: Matrix, x: Vector, beta: float = 0.0, y: Vector | None = None, trans: bool = False) -> Vector:
    return _vector(mult(alpha, a, as_column(x), beta, as_column(y) if y else None, trans_a=trans))


def mvmult_sym(alpha: float, a: Matrix, x: Vector, beta: float = 0.0, y: Vector | None = None, uplo: str = "lower") -> Vector:
    return mvmult(alpha, mirrored(a, uplo), x, beta, y)


def mvmult_trm(alpha: float, a: Matrix, x: Vector, uplo: str = "lower", trans: bool = False, unit: bool = False) -> Vector:
    return mvmult(alpha, triangular(a, uplo, unit), x, trans=trans)


def mult_sym(alpha: float, a: Matrix, b: Matrix, beta: float = 0.0, c: Matrix | None = None, uplo: str = "lower", side: str = "left") -> Matrix:
    full = mirrored(a, uplo)
    return mult(alpha, full, b, beta, c) if side == "left" else mult(alpha, b, full, beta, c)


def mult_trm(alpha: float, a: Matrix, b: Matrix, uplo: str = "lower", side: str = "left", trans: bool = False, unit: bool = False) -> Matrix:
    half = triangular(a, uplo, unit)
    return mult(alpha, half, b, trans_a=trans) if side == "left" else mult(alpha, b, half, trans_b=trans)


def update_trm(alpha: float, a: Matrix, b: Matrix, beta: float = 0.0, c: Matrix | None = None, uplo: str = "lower") -> Matrix:
    return mult(alpha, a, b, beta, c, uplo=uplo)


def mvupdate(beta: float, a: Matrix, alpha: float, x: Vector, y: Vector, uplo: str | None = None) -> Matrix:
    """beta*A + alpha*x*y^T, each element rounded once."""
    return mult(alpha, as_column(x), as_column(y).T, beta, a, uplo=uplo)


def mvupdate2_sym(beta: float, a: Matrix, alpha: float, x: Vector, y: Vector, uplo: str = "lower") -> Matrix:
    """beta*A + alpha*(x*y^T + y*x^T) on a triangle: one product of n x 2 matrices."""
    left = Matrix(as_column(x).df.unionByName(as_column(y).df.withColumn("j", F.lit(1).cast("long"))), x.size, 2)
    right = Matrix(as_column(y).df.unionByName(as_column(x).df.withColumn("j", F.lit(1).cast("long"))), x.size, 2)
    return mult(alpha, left, right.T, beta, a, uplo=uplo)


def solve_trm(a: Matrix, b: Matrix, alpha: float = 1.0, uplo: str = "lower", trans: bool = False, unit: bool = False, rounds: int = 2) -> Matrix:
    """alpha*op(A)^-1*B: substitution, then corrections from residuals in twice the precision."""
    from .elementwise import plus

    half = triangular(a, uplo, unit)
    x = plain_solve(a, b, alpha, uplo, "left", trans, unit)
    for _ in range(rounds):
        r = mult(-1.0, half, x, alpha, b, trans_a=trans)
        x = plus(1.0, x, 1.0, plain_solve(a, r, 1.0, uplo, "left", trans, unit))
    return x


def mvsolve_trm(alpha: float, a: Matrix, x: Vector, uplo: str = "lower", trans: bool = False, unit: bool = False) -> Vector:
    return _vector(solve_trm(a, as_column(x), alpha, uplo, trans, unit))
