"""Sparse matrices: layouts, sums, products, triangular solves and incomplete factors.

A sparse matrix is the same coordinate table; its compressed forms are tables with one
row for each major index.  Triangular solves and incomplete factorisations go by blocks
of rows in the order of their dependencies (`applied`).  Where vectors are too long for that,
and where a caller wants few sweeps, they repeat a fixed-point sweep, a join and an aggregation
over all rows at once; as the recurrences are triangular, the sweeps end with the exact
result after as many steps as the longest chain of dependencies (two a row in a factorisation).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cut import cut
from .applied import Triangle, fits, gathered, incomplete_lu, table
from .elementwise import mult_diag, plus
from .matrix import Matrix, ShapeError, Vector, column_of, identity, row_of
from .products import mult, mvmult, triangular


#: Sweeps of a triangular solve between two written tables.
TOGETHER = 4


def at(a: Matrix, p: int, by: str = "row") -> DataFrame:
    """(i, j, v): the p-th stored cell in the order of the compressed form.  Counts of the
    major indices find the one that holds it, so only its cells are ordered."""
    major, minor = ("i", "j") if by == "row" else ("j", "i")
    places = pointers(a if by == "row" else a.T).where((F.col("start") <= p) & (F.col("start") + F.col("size") > p)).select(F.col("k").alias(major), "start")
    own = a.df.join(places, major)
    order = Window.partitionBy(major).orderBy(minor)
    return own.withColumn("n", F.row_number().over(order) - 1 + F.col("start")).where(F.col("n") == p).select("i", "j", "v")


def stored(a: Matrix, row: int, col: int) -> DataFrame:
    """One row (value): whether the cell is stored, even if as 0."""
    return a.df.where((F.col("i") == row) & (F.col("j") == col)).agg((F.count("*") > 0).alias("value"))


def vector(a: Matrix, k: int, by: str = "row") -> Vector:
    """The k-th row (column) as a sparse vector of its stored cells."""
    return row_of(a, k) if by == "row" else column_of(a, k)


def compress(a: Matrix, by: str = "row") -> DataFrame:
    """(k, cells): array of (index, v) by index, for each row (CSR) or column (CSC) that
    has cells."""
    major, minor = ("i", "j") if by == "row" else ("j", "i")
    return a.df.groupBy(F.col(major).alias("k")).agg(F.array_sort(F.collect_list(F.struct(F.col(minor).alias("index"), "v"))).alias("cells"))


def expand(compressed: DataFrame, rows: int, cols: int, by: str = "row") -> Matrix:
    cells = compressed.select("k", F.explode("cells").alias("c")).select("k", F.col("c.index").alias("m"), "c.v")
    major, minor = ("i", "j") if by == "row" else ("j", "i")
    return Matrix(cells.select(F.col("k").alias(major), F.col("m").alias(minor), "v").select("i", "j", "v"), rows, cols)


def pointers(a: Matrix, by: str = "row") -> DataFrame:
    """(k, start, size): where each major index begins in the compressed order.

    Sums inside ranges of 2**16 indices, then over the ranges: the last window has one
    row for each range."""
    major, n = ("i", a.rows) if by == "row" else ("j", a.cols)
    sizes = a.df.sparkSession.range(n).select(F.col("id").alias("k")).join(a.df.groupBy(F.col(major).alias("k")).agg(F.count("*").alias("size")), "k", "left")
    sizes = sizes.select("k", F.coalesce("size", F.lit(0)).cast("long").alias("size"), F.shiftright("k", 16).alias("range"))
    inside = sizes.withColumn("inside", F.sum("size").over(Window.partitionBy("range").orderBy("k")) - F.col("size"))
    whole = sizes.groupBy("range").agg(F.sum("size").alias("n"))
    before = whole.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    return inside.join(before, "range").select("k", (F.col("before") + F.col("inside")).alias("start"), "size")


def sort_cells(a: Matrix, by: str = "row") -> Matrix:
    """Cells in order of rows or columns."""
    return Matrix(a.df.orderBy("i", "j") if by == "row" else a.df.orderBy("j", "i"), a.rows, a.cols)


def has_diagonal(a: Matrix, k: int = 0) -> DataFrame:
    """One row (value): whether every cell of the k-th diagonal is stored."""
    want = max(0, min(a.cols - k, a.rows) if k >= 0 else min(a.rows + k, a.cols))
    return a.df.where(F.col("j") - F.col("i") == k).agg((F.count_distinct("i") == want).alias("value"))


def count(a: Matrix) -> DataFrame:
    return a.df.agg(F.count("*").alias("value"))


def spy(a: Matrix, top: int = 0, left: int = 0, rows: int | None = None, cols: int | None = None) -> DataFrame:
    """(i, line): x where a cell is stored and a point where none is, of all rows and
    columns, or of a window.  A row's stored columns are sorted; its line is made of the gaps
    between them."""
    rows, cols = a.rows - top if rows is None else rows, a.cols - left if cols is None else cols
    inside = a.df.where(F.col("i").between(top, top + rows - 1) & F.col("j").between(left, left + cols - 1))
    held = inside.groupBy("i").agg(F.array_sort(F.collect_set((F.col("j") - left).cast("int"))).alias("js"))
    wide = a.df.sparkSession.range(top, top + rows).select(F.col("id").alias("i")).join(held, "i", "left")
    js = F.coalesce("js", F.array().cast("array<int>"))
    before = F.concat(F.array(F.lit(-1)), js)
    marks = F.zip_with(js, F.slice(before, F.lit(1), F.size(js)), lambda j, p: F.concat(F.repeat(F.lit("."), j - p - 1), F.lit("x")))
    return wide.select("i", F.rpad(F.concat_ws("", marks), cols, ".").alias("line"))


def add(alpha: float, a: Matrix, beta: float, b: Matrix, trans_a: bool = False, trans_b: bool = False) -> Matrix:
    """alpha*op(A) + beta*op(B); cells that cancel stay stored."""
    return plus(alpha, a.T if trans_a else a, beta, b.T if trans_b else b)


def add_diagonal(a: Matrix, mu: float) -> Matrix:
    return plus(1.0, a, mu, identity(a.df.sparkSession, min(a.rows, a.cols))) if a.rows == a.cols else _wide_diagonal(a, mu)


def _wide_diagonal(a: Matrix, mu: float) -> Matrix:
    return plus(1.0, a, mu, Matrix(identity(a.df.sparkSession, min(a.rows, a.cols)).df, a.rows, a.cols))


def spgemm(alpha: float, a: Matrix, b: Matrix, trans_a: bool = False, trans_b: bool = False) -> Matrix:
    """alpha*op(A)*op(B)."""
    return mult(alpha, a, b, trans_a=trans_a, trans_b=trans_b)


def product_count(a: Matrix, b: Matrix) -> DataFrame:
    """One row (value): how many cells A*B stores."""
    cells = a.df.select("i", F.col("j").alias("k")).join(b.df.select(F.col("i").alias("k"), "j"), "k").select("i", "j").distinct()
    return cells.agg(F.count("*").alias("value"))


scale_by = mult_diag
spmv = mvmult


def invertible(half: Matrix) -> None:
    """ArithmeticError if a diagonal cell is not stored or 0."""
    if half.df.where("i = j and v != 0").agg(F.count_distinct("i")).first()[0] < half.rows:
        raise ArithmeticError("the triangle is singular: its diagonal has a zero")


def solve_triangular(a: Matrix, b: Vector, alpha: float = 1.0, uplo: str = "lower", trans: bool = False, unit: bool = False) -> Vector:
    """alpha*op(A)^-1*b for a sparse triangle.  Up to `applied.SHARED_VECTOR` unknowns blocks
    of rows are substituted in waves; beyond, x <- D^-1*(alpha*b - N*x) is swept over tables.
    until nothing changes.  A row without a diagonal raises ArithmeticError."""
    if a.rows != a.cols or b.size != a.rows:
        raise ShapeError((a.rows, a.cols, b.size))
    half = triangular(a, uplo, unit)
    if not unit:
        invertible(half)
    half = half.T if trans else half
    n = a.rows
    if fits(n):
        return table(a.df.sparkSession, alpha * Triangle(half, (uplo == "lower") != trans, unit)(gathered(b)))
    d = half.df.where("i = j").select("i", F.col("v").alias("d"))
    off = cut(half.df.where("i != j").select("i", "j", "v"), "off")
    right = a.df.sparkSession.range(n).select(F.col("id").alias("i")).join(b.df, "i", "left").join(d, "i").select("i", (alpha * F.coalesce("v", F.lit(0.0))).alias("b"), "d")
    right = cut(right, "right")
    x = right.select("i", (F.col("b") / F.col("d")).alias("x"))
    for _ in range(0, n, TOGETHER):
        old = x
        for _ in range(TOGETHER):
            moved = off.join(x.select(F.col("i").alias("j"), "x"), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("s"))
            x = right.join(moved, "i", "left").select("i", ((F.col("b") - F.coalesce("s", F.lit(0.0))) / F.col("d")).alias("x"))
        step = cut(x.join(old.withColumnRenamed("x", "old"), "i"), "sweep")
        changed = step.where(F.col("x") != F.col("old")).limit(1).count()
        x = step.select("i", "x")
        if not changed:
            break
    return Vector(x.select("i", F.col("x").alias("v")), n)


def solve_matrix(a: Matrix, b: Matrix, uplo: str = "lower", trans: bool = False, unit: bool = False) -> list[Vector]:
    """One solve for each column of b."""
    from .matrix import column_of

    return [solve_triangular(a, column_of(b, c), 1.0, uplo, trans, unit) for c in range(b.cols)]


@dataclass(frozen=True)
class Preconditioner:
    """apply(x) is M^-1*x; array() gives the same on arrays, with its tables made once."""

    lower: Matrix
    upper: Matrix
    unit: bool
    apply: Callable[[Vector], Vector]

    def array(self) -> Callable[[np.ndarray], np.ndarray]:
        first = Triangle(triangular(self.lower, "lower", self.unit), True, self.unit)
        second = Triangle(triangular(self.upper, "upper", False), False, False)
        return lambda x: second(first(x))


def _sweep(a: Matrix, limit: int | None, tolerance: float) -> Matrix:
    """ILU(0) by fixed-point sweeps on A's pattern: below the diagonal
    f_ij = (a_ij - sum_k<j f_ik*f_kj)/f_jj, else f_ij = a_ij - sum_k<i f_ik*f_kj.

    A chain of dependencies takes two steps a row, so 2*rows sweeps are always enough;
    a smaller limit that is reached before nothing changes is an error.  Without a limit
    rows are eliminated once, in blocks and waves."""
    if limit is None:
        return incomplete_lu(a)
    base = cut(a.df, "pattern")
    f = base
    enough = 2 * a.rows
    for _ in range(enough if limit is None else min(limit, enough)):
        low = f.where("i > j").select("i", F.col("j").alias("k"), F.col("v").alias("x"))
        up = f.where("i <= j").select(F.col("i").alias("k"), "j", F.col("v").alias("y"))
        sums = low.join(up, "k").where(F.col("k") < F.least("i", "j")).join(base.select("i", "j"), ["i", "j"], "left_semi").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("s"))
        d = f.where("i = j").select("j", F.col("v").alias("d"))
        rest = F.col("v") - F.coalesce("s", F.lit(0.0))
        step = base.join(sums, ["i", "j"], "left").join(d, "j").select("i", "j", F.when(F.col("i") > F.col("j"), rest / F.col("d")).otherwise(rest).alias("v"))
        step = cut(step.join(f.select("i", "j", F.col("v").alias("old")), ["i", "j"]), "ilu")
        gap = step.agg(F.max(F.abs(F.col("v") - F.col("old")) / F.greatest(F.abs("v"), F.lit(1e-300)))).first()[0]
        f = step.select("i", "j", "v")
        if gap is None or gap <= tolerance:
            break
    else:
        if limit is not None and limit < enough:
            raise ArithmeticError(f"incomplete factors still change after {limit} sweeps")
    return Matrix(f, a.rows, a.cols)


def ilu0(a: Matrix, sweeps: int | None = None, tolerance: float = 1e-15) -> Matrix:
    """L (unit, below the diagonal) and U of A on its own pattern; the diagonal must be stored.
    sweeps: most sweeps, an error if they do not suffice; None is as many as it takes."""
    if not has_diagonal(a).first()["value"]:
        raise ArithmeticError("ILU(0) needs every diagonal cell")
    return _sweep(a, sweeps, tolerance)


def ilu_preconditioner(a: Matrix) -> Preconditioner:
    """M = L*U: first L, then U is solved."""
    f = ilu0(a)
    return Preconditioner(f, f, True, lambda x: solve_triangular(f, solve_triangular(f, x, 1.0, "lower", unit=True), 1.0, "upper"))


def ic0(a: Matrix, uplo: str = "lower", sweeps: int | None = None, tolerance: float = 1e-15) -> Matrix:
    """L with L*L^T = A on A's pattern, from one triangle: the unit factor of ILU(0) times
    the roots of its pivots."""
    from .matrix import mirrored

    f = _sweep(mirrored(a, uplo), sweeps, tolerance)
    d = f.df.where("i = j").select("j", F.sqrt("v").alias("r"))
    low = f.df.where("i >= j").join(d, "j").select("i", "j", F.when(F.col("i") == F.col("j"), F.col("r")).otherwise(F.col("v") * F.col("r")).alias("v"))
    out = Matrix(cut(low, "ic"), a.rows, a.cols)
    return out if uplo == "lower" else out.T


def ic_preconditioner(a: Matrix, uplo: str = "lower") -> Preconditioner:
    f = ic0(a, uplo)
    first, second = (False, True) if uplo == "lower" else (True, False)
    low, high = (f, f.T) if uplo == "lower" else (f.T, f)
    return Preconditioner(low, high, False, lambda x: solve_triangular(f, solve_triangular(f, x, 1.0, uplo, trans=first), 1.0, uplo, trans=second))
