"""Matrix-vector and matrix-matrix products as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gustavson
from .elementwise import axpby, plus
from .matrix import Matrix, ShapeError, Vector, identity, mirrored, triangle


def _op(a: Matrix, trans: bool, absolute: bool) -> Matrix:
    a = a.T if trans else a
    return a.with_values(F.abs("v")) if absolute else a


#: Elements of a vector that is sent to every task (64 MB), and of a stripe of an outer product.
SHARED_VECTOR, STRIPE = 1 << 22, 1024
#: Scalar products of two full matrices up to which a product is a plain join, whatever its cells are.
PLAIN = 1 << 24


def _joined(a: Matrix, b: Matrix, alpha: float = 1.0, uplo: str | None = None, twice: bool = False) -> Matrix:
    """alpha*A*B, restricted to a triangle before anything is summed.  twice: B is A^T.  Where its
    sizes allow more than PLAIN scalar products, these are no rows of a table (`gustavson`)."""
    if a.cols != b.rows:
        raise ShapeError((a.rows, a.cols, b.rows, b.cols))
    if a.rows * a.cols * b.cols > PLAIN:
        return Matrix(gustavson.product(a.df, None if twice else b.df, a.rows, a.cols, b.cols, alpha, uplo), a.rows, b.cols)
    both = a.df.select("i", F.col("j").alias("k"), F.col("v").alias("x")).join(b.df.select(F.col("i").alias("k"), "j", F.col("v").alias("y")), "k")
    cells = both.where(triangle(uplo)).groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))
    return Matrix(cells.select("i", "j", (alpha * F.col("v")).alias("v")), a.rows, b.cols)


def _onto(beta: float, c: Matrix | None, new: Matrix, uplo: str | None = None) -> Matrix:
    """beta*C + new on a triangle, the rest of C kept; beta = 0 ignores what C holds there."""
    if c is None:
        return new
    if (c.rows, c.cols) != (new.rows, new.cols):
        raise ShapeError((c.rows, c.cols, new.rows, new.cols))
    if beta == 0:
        return new if uplo is None else Matrix(c.df.where(~triangle(uplo)).unionByName(new.df), c.rows, c.cols)
    return plus(beta, c, 1.0, new, uplo=uplo)


# Level 2


def mvmult(alpha: float, a: Matrix, x: Vector, beta: float = 0.0, y: Vector | None = None, trans: bool = False, absolute: bool = False) -> Vector:
    """beta*y + alpha*op(A)*x.  x has one row for each of its elements at most."""
    a = _op(a, trans, absolute)
    if a.cols != x.size or (y is not None and y.size != a.rows):
        raise ShapeError((a.rows, a.cols, x.size))
    vector = x.df.select(F.col("i").alias("j"), (F.abs("v") if absolute else F.col("v")).alias("x"))
    # A vector has at most `size` elements, so its size is known: up to SHARED_VECTOR of them go
    # to all tasks and A is not shuffled by column; a longer one meets A's columns.
    out = a.df.join(F.broadcast(vector) if x.size <= SHARED_VECTOR else vector, "j").groupBy("i").agg((alpha * F.sum(F.col("v") * F.col("x"))).alias("v"))
    new = Vector(out, a.rows)
    return new if y is None else axpby(beta, y, 1.0, new)


def mvmult_sym(alpha: float, a: Matrix, x: Vector, beta: float = 0.0, y: Vector | None = None, uplo: str = "lower") -> Vector:
    return mvmult(alpha, mirrored(a, uplo), x, beta, y)


def triangular(a: Matrix, uplo: str, unit: bool) -> Matrix:
    """A triangle of A, with ones on the diagonal if it is a unit triangle."""
    if not unit:
        return a.where(triangle(uplo))
    return Matrix(a.df.where(triangle(uplo, strict=True)).unionByName(identity(a.df.sparkSession, min(a.rows, a.cols)).df), a.rows, a.cols)


def mvmult_trm(alpha: float, a: Matrix, x: Vector, uplo: str = "lower", trans: bool = False, unit: bool = False) -> Vector:
    return mvmult(alpha, triangular(a, uplo, unit), x, trans=trans)


def outer_with(x: DataFrame, y: DataFrame, size: int, uplo: str | None, f) -> DataFrame:
    """(i, j, f(x_i, y_j)) of all i of x and j of y, or of a triangle; both have (i, v), y `size`
    elements at most.

    y is cut into stripes of STRIPE elements, an array each, and x's rows meet those stripes
    that hold something for them.  So there are as many cells as the result has and no others,
    and what moves is a stripe's array."""
    stripe = F.floor(F.col("i") / STRIPE).cast("int")
    right = y.where("v is not null").groupBy(stripe.alias("s")).agg(F.collect_list(F.struct(F.col("i").alias("j"), F.col("v").alias("y"))).alias("c"))
    last = F.lit(max(-(-size // STRIPE) - 1, 0))
    low, high = {None: (F.lit(0), last), "lower": (F.lit(0), F.least(stripe, last)), "upper": (stripe, last)}[uplo]
    left = x.select("i", F.col("v").alias("x"), F.explode(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))).alias("s"))
    inside = {None: lambda c: F.lit(True), "lower": lambda c: c["j"] <= F.col("i"), "upper": lambda c: c["j"] >= F.col("i")}[uplo]
    cells = left.join(right, "s").select("i", "x", F.explode(F.filter("c", inside)).alias("c"))
    return cells.select("i", F.col("c.j").alias("j"), f(F.col("x"), F.col("c.y")).alias("v"))


def outer(alpha: float, x: Vector, y: Vector, uplo: str | None = None) -> Matrix:
    """alpha*x*y^T, or a triangle of it."""
    return Matrix(outer_with(x.df.select("i", "v"), y.df.select("i", "v"), y.size, uplo, lambda p, q: alpha * p * q), x.size, y.size)


def mvupdate(beta: float, a: Matrix, alpha: float, x: Vector, y: Vector, uplo: str | None = None) -> Matrix:
    """beta*A + alpha*x*y^T (on a triangle or trapezoid)."""
    return _onto(beta, a, outer(alpha, x, y, uplo), uplo)


def mvupdate_sym(beta: float, a: Matrix, alpha: float, x: Vector, uplo: str = "lower") -> Matrix:
    return mvupdate(beta, a, alpha, x, x, uplo)


def mvupdate2_sym(beta: float, a: Matrix, alpha: float, x: Vector, y: Vector, uplo: str = "lower") -> Matrix:
    """beta*A + alpha*(x*y^T + y*x^T) on a triangle."""
    if x.size != y.size:
        raise ShapeError((x.size, y.size))
    # Both products share their cells: x_i*y_j + y_i*x_j from rows that hold x and y.
    two = x.df.select("i", F.col("v").alias("x")).join(y.df.select("i", F.col("v").alias("y")), "i", "full").select("i", F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y"))
    pair = F.struct("x", "y")
    cells = outer_with(two.select("i", pair.alias("v")), two.select("i", pair.alias("v")), x.size, uplo, lambda p, q: alpha * (p["x"] * q["y"] + p["y"] * q["x"]))
    return _onto(beta, a, Matrix(cells, a.rows, a.cols), uplo)


# Level 3


def mult(
    alpha: float, a: Matrix, b: Matrix, beta: float = 0.0, c: Matrix | None = None,
    trans_a: bool = False, trans_b: bool = False, abs_a: bool = False, abs_b: bool = False,
) -> Matrix:
    """beta*C + alpha*op(A)*op(B).  `blocks.mult` does the same with dense tiles.  Of A*A^T
    and A^T*A, which are symmetric, one triangle is summed and then read both ways."""
    if a is b and trans_a != trans_b and abs_a == abs_b:
        half = _joined(_op(a, trans_a, abs_a), _op(b, trans_b, abs_b), alpha, "lower", twice=True)
        there, back = F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))
        both = half.df.select(F.explode(F.when(F.col("i") == F.col("j"), F.array(there)).otherwise(F.array(there, back))).alias("at"), "v")
        return _onto(beta, c, Matrix(both.select("at.i", "at.j", "v"), half.rows, half.cols))
    return _onto(beta, c, _joined(_op(a, trans_a, abs_a), _op(b, trans_b, abs_b), alpha))


def mult_sym(alpha: float, a: Matrix, b: Matrix, beta: float = 0.0, c: Matrix | None = None, uplo: str = "lower", side: str = "left", trans_b: bool = False) -> Matrix:
    """beta*C + alpha*A*op(B), or alpha*op(B)*A: A symmetric, one triangle given."""
    full, b = mirrored(a, uplo), _op(b, trans_b, False)
    return _onto(beta, c, _joined(full, b, alpha) if side == "left" else _joined(b, full, alpha))


def mult_trm(alpha: float, a: Matrix, b: Matrix, uplo: str = "lower", side: str = "left", trans: bool = False, unit: bool = False) -> Matrix:
    """alpha*op(A)*B or alpha*B*op(A): A triangular."""
    half = _op(triangular(a, uplo, unit), trans, False)
    return _joined(half, b, alpha) if side == "left" else _joined(b, half, alpha)


def update_sym(alpha: float, a: Matrix, beta: float = 0.0, c: Matrix | None = None, uplo: str = "lower", trans: bool = False) -> Matrix:
    """beta*C + alpha*A*A^T (A^T*A with trans) on a triangle."""
    a = _op(a, trans, False)
    return _onto(beta, c, _joined(a, a.T, alpha, uplo, twice=True), uplo)


def update2_sym(alpha: float, a: Matrix, b: Matrix, beta: float = 0.0, c: Matrix | None = None, uplo: str = "lower", trans: bool = False) -> Matrix:
    """beta*C + alpha*(A*B^T + B*A^T) on a triangle."""
    a, b = _op(a, trans, False), _op(b, trans, False)
    # [A B] * [B A]^T: one product, not one and its transpose.
    beside = lambda x, y: Matrix(x.df.unionByName(y.df.select("i", (F.col("j") + x.cols).alias("j"), "v")), x.rows, x.cols + y.cols)
    return _onto(beta, c, _joined(beside(a, b), beside(b, a).T, alpha, uplo), uplo)


def update_trm(alpha: float, a: Matrix, b: Matrix, beta: float = 0.0, c: Matrix | None = None, uplo: str = "lower", trans_a: bool = False, trans_b: bool = False) -> Matrix:
    """beta*C + alpha*op(A)*op(B) on a triangle or trapezoid only."""
    return _onto(beta, c, _joined(_op(a, trans_a, False), _op(b, trans_b, False), alpha, uplo), uplo)


def gram(table: DataFrame, values: str, width: int) -> Matrix:
    """A^T*A of a table with an array per row: the table is read once, products are summed
    per task before the shuffle and at most width*width cells leave each task."""
    spread = table.select(F.col(values).alias("a")).select(F.posexplode("a").alias("i", "x"), "a").select("i", "x", F.posexplode("a").alias("j", "y"))
    cells = spread.where("i >= j").groupBy("i", "j").agg(F.sum(F.col("x").cast("double") * F.col("y").cast("double")).alias("v"))
    half = Matrix(cells.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "v"), width, width)
    return mirrored(half)
