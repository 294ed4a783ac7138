"""QR and its relatives, least squares and reflectors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cut import cut
from . import qr_tree
from .elementwise import plus
from .matrix import Matrix, ShapeError, Vector, as_column
from .products import mult
from .rows import SHARED_BYTES, Rows, check_shared, collect_small, from_rows, map_rows, matrix_of, reduce_tree, small, solve_small, to_rows


@dataclass(frozen=True)
class Orthogonal:
    """q and the triangular factor of one of the four forms:
    qr: A = Q*R, lq: A = L*Q, ql: A = Q*L, rq: A = R*Q; rank-wide q."""

    q: Matrix
    factor: Matrix
    form: str


def _positive(r: np.ndarray) -> np.ndarray:
    sign = np.where(np.diag(r) < 0, -1.0, 1.0)
    return r * sign[:, None]


def tsqr(rows: Rows) -> np.ndarray:
    """R of a tall matrix with a non-negative diagonal: tasks factor what they hold, and
    the small R factors meet in a tree."""
    n = rows.cols
    r = reduce_tree(rows.df, n, lambda x: np.linalg.qr(x, mode="r"), lambda x, y: np.linalg.qr(np.vstack((x, y)), mode="r"), (n, n))
    if len(r) < n:
        r = np.vstack((r, np.zeros((n - len(r), n))))
    return _positive(r)


def qr_rows(a: Rows) -> tuple[Rows, np.ndarray]:
    """(Q, R) of a tall matrix with few columns: one panel of reflector trees.  Q is
    orthonormal whatever the rank is; R is an array."""
    check_shared(a.cols, a.cols)
    f = qr_tree.factor(a, max(a.cols, 1))
    return qr_tree.thin_q(f), _square(f.r.df, a.cols)


def _square(rows: DataFrame, n: int) -> np.ndarray:
    """n rows (i, a) of n numbers as an array."""
    out = np.zeros((n, n))
    for r in rows.collect():
        out[r["i"]] = r["a"]
    return out


def _flip(a: Matrix, rows: bool, cols: bool) -> Matrix:
    i = (a.rows - 1 - F.col("i")) if rows else F.col("i")
    j = (a.cols - 1 - F.col("j")) if cols else F.col("j")
    return Matrix(a.df.select(i.alias("i"), j.alias("j"), "v"), a.rows, a.cols)


def qr(a: Matrix | Rows, panel: int = qr_tree.PANEL) -> Orthogonal:
    """A = Q*R for rows >= cols, both of any length; R's diagonal is not negative, and Q is
    orthonormal whatever the rank is.  A table in row layout is not shuffled."""
    if a.rows < a.cols:
        raise ShapeError((a.rows, a.cols))
    f = qr_tree.factor(to_rows(a), panel)
    return Orthogonal(from_rows(qr_tree.thin_q(f)), from_rows(f.r), "qr")


def lq(a: Matrix) -> Orthogonal:
    """A = L*Q for rows <= cols, by the QR of the transpose."""
    f = qr(a.T)
    return Orthogonal(f.q.T, f.factor.T, "lq")


def ql(a: Matrix) -> Orthogonal:
    """A = Q*L for rows >= cols, by the QR of the matrix with its columns reversed."""
    f = qr(_flip(a, False, True))
    return Orthogonal(_flip(f.q, False, True), _flip(f.factor, True, True), "ql")


def rq(a: Matrix) -> Orthogonal:
    """A = R*Q for rows <= cols, by the LQ of the matrix with its rows reversed."""
    f = lq(_flip(a, True, False))
    return Orthogonal(_flip(f.q, True, False), _flip(f.factor, True, True), "rq")


FORMS = {"qr": qr, "lq": lq, "ql": ql, "rq": rq}


def product(f: Orthogonal) -> Matrix:
    """The matrix again from its factors."""
    return mult(1.0, f.q, f.factor) if f.form in ("qr", "ql") else mult(1.0, f.factor, f.q)


def build(f: Orthogonal, k: int | None = None) -> Matrix:
    """The first k columns (qr), last k columns (ql), first rows (lq) or last rows (rq) of Q."""
    n = f.q.cols if f.form in ("qr", "ql") else f.q.rows
    k = n if k is None else k
    low, high = (0, k) if f.form in ("qr", "lq") else (n - k, n)
    axis = "j" if f.form in ("qr", "ql") else "i"
    cells = f.q.df.where(F.col(axis).between(low, high - 1)).withColumn(axis, F.col(axis) - low)
    return Matrix(cells.select("i", "j", "v"), f.q.rows if axis == "j" else k, k if axis == "j" else f.q.cols)


def mult_q(f: Orthogonal, c: Matrix, side: str = "left", trans: bool = False) -> Matrix:
    """Q*C, Q^T*C, C*Q or C*Q^T with the thin Q."""
    return mult(1.0, f.q, c, trans_a=trans) if side == "left" else mult(1.0, c, f.q, trans_b=trans)


def least_squares(a: Matrix | Rows, b: Matrix, trans: bool = False) -> Matrix:
    """X that minimises |A*X - B| for a tall A, or with trans the smallest X with
    A^T*X = B."""
    return solve(qr(a), b, trans)


def min_norm(a: Matrix, b: Matrix) -> Matrix:
    """The smallest X with A*X = B for a wide A."""
    return least_squares(a.T, b, trans=True)


def solve(f: Orthogonal, b: Matrix, trans: bool = False) -> Matrix:
    """With A of any of the forms: X that minimises |A*X - B| for a tall A (qr, ql), the
    smallest X with A*X = B for a wide one (lq, rq); with trans the same of A^T.

    Of a rank-deficient A it is the smallest of the X that minimise |A*X - B|: the triangle's
    pseudo-inverse takes the place of its inverse, as far as the triangle may be sent to all tasks.
    A longer one is substituted, and a zero on its diagonal raises ArithmeticError."""
    tall, n = f.form in ("qr", "ql"), f.factor.rows
    spark = b.df.sparkSession

    def through(c: Matrix) -> Matrix:
        from .factor import solve_triangular

        if 8 * n * n > SHARED_BYTES:
            return solve_triangular(f.factor, c, uplo="upper" if f.form in ("qr", "rq") else "lower", trans=trans)
        t = small(f.factor, n)
        return mult(1.0, matrix_of(spark, np.linalg.pinv(t.T if trans else t, rcond=max(n, 1) * 2.0**-52)), c)

    if tall != trans:  # least squares: project, then the triangle
        return through(mult(1.0, f.q, b, trans_a=tall))
    return mult(1.0, f.q, through(b), trans_a=not tall)


@dataclass(frozen=True)
class Reflectors:
    """A = Q*R with Q = H1*H2*... = I - Y*T*Y^T, all of its columns: y unit lower trapezoidal,
    t a small upper triangle, taus on its diagonal."""

    y: Matrix
    t: np.ndarray
    r: Matrix

    @property
    def taus(self) -> np.ndarray:
        return np.diag(self.t).copy()

    def blocks(self, size: int) -> list[np.ndarray]:
        """The T of each `size` reflectors on their own."""
        return [self.t[k : k + size, k : k + size] for k in range(0, len(self.t), size)]


def reflectors(a: Matrix | Rows) -> Reflectors:
    """Reflector form of a tall matrix, got from the thin Q of TSQR: Q less a diagonal of
    signs is Y*U for a triangle U, where the signs are picked as the top of Q is eliminated,
    so that no pivot is small.  Only the top square is on the driver."""
    rows = to_rows(a)
    n, spark = rows.cols, a.df.sparkSession
    check_shared(n, n)
    q, r = qr_rows(rows)
    q = Rows(cut(q.df, "q"), q.rows, n)
    top = collect_small(q.df.where(F.col("i") < n), n, n)[1]
    signs = np.zeros(n)
    for k in range(n):
        signs[k] = -1.0 if top[k, k] >= 0 else 1.0
        top[k, k] -= signs[k]
        top[k + 1 :, k] /= top[k, k]
        top[k + 1 :, k + 1 :] -= np.outer(top[k + 1 :, k], top[k, k + 1 :])
    low, upper = np.tril(top, -1) + np.eye(n), np.triu(top)
    # T = -U*S*Y1^-T
    t = np.triu(-solve_small(low, (upper * signs).T, True, True).T)
    below = solve_small(upper.T, np.eye(n), True, False).T

    def y(i, x):
        out = x @ below
        mine = i < n
        out[mine] = low[i[mine]]
        return out

    y_rows = Rows(cut(map_rows(q.df, n, y), "y"), rows.rows, n)
    return Reflectors(from_rows(y_rows).where((F.col("i") > F.col("j")) | (F.col("i") == F.col("j"))), t, matrix_of(spark, np.triu(signs[:, None] * r)))


def update_qr(f: Reflectors, c: Matrix, side: str = "left", trans: bool = False) -> Matrix:
    """Q*C, Q^T*C, C*Q or C*Q^T with the whole Q, by two products with Y."""
    t = matrix_of(c.df.sparkSession, f.t.T if trans else f.t)
    if side == "right":
        return plus(1.0, c, -1.0, mult(1.0, mult(1.0, mult(1.0, c, f.y), t), f.y, trans_b=True))
    return plus(1.0, c, -1.0, mult(1.0, f.y, mult(1.0, t, mult(1.0, f.y, c, trans_a=True))))


@dataclass(frozen=True)
class WholeForm:
    """A = Q*F of any form with all of the square Q, which is a product of reflectors: those of
    the QR of A, A^T or one of these read backwards.  factor is the triangle, as in `Orthogonal`;
    in the square form it stands above zeros (qr), below (ql), before (lq) or behind them (rq)."""

    base: Reflectors
    form: str
    factor: Matrix
    rows: int
    cols: int

    @property
    def size(self) -> int:
        return self.rows if self.form in ("qr", "ql") else self.cols

    def padded(self) -> Matrix:
        """F with A's shape, so that A = Q*F (qr, ql) or F*Q (lq, rq)."""
        i = F.col("i") + (self.rows - self.factor.rows if self.form == "ql" else 0)
        j = F.col("j") + (self.cols - self.factor.cols if self.form == "rq" else 0)
        return Matrix(self.factor.df.select(i.alias("i"), j.alias("j"), "v"), self.rows, self.cols)


def whole(a: Matrix, form: str) -> WholeForm:
    """All of Q of one of the four forms: `mult_whole` applies it, and no n x n matrix is made."""
    given = {"qr": lambda: a, "ql": lambda: _flip(a, False, True), "lq": lambda: a.T, "rq": lambda: _flip(a, True, False).T}[form]()
    base = reflectors(given)
    factor = {"qr": lambda r: r, "ql": lambda r: _flip(r, True, True), "lq": lambda r: r.T, "rq": lambda r: _flip(r.T, True, True)}[form](base.r)
    return WholeForm(base, form, factor, a.rows, a.cols)


def mult_whole(f: WholeForm, c: Matrix, side: str = "left", trans: bool = False) -> Matrix:
    """Q*C, Q^T*C, C*Q or C*Q^T with all of Q.  With B the product of the base's reflectors and J
    the reversal of an order, Q is B (qr), B*J (ql), B^T (lq) or J*B^T (rq)."""
    if side == "right":
        return mult_whole(f, c.T, "left", not trans).T
    if c.rows != f.size:
        raise ShapeError((f.size, c.rows, c.cols))
    turned = trans != (f.form in ("lq", "rq"))
    if f.form in ("qr", "lq"):
        return update_qr(f.base, c, trans=turned)
    # J stands on the side of B that A's long side is not on.
    if (f.form == "ql") != trans:
        return update_qr(f.base, _flip(c, True, False), trans=turned)
    return _flip(update_qr(f.base, c, trans=turned), True, False)


# Reflectors


def house(x: Vector, positive: bool = False) -> DataFrame:
    """One row (beta, tau, scale) of the reflector H = I - tau*v*v^T that maps x to
    (beta, 0, ...); v is x with its first element replaced by 1 and the rest times scale."""
    top = x.df.agg(F.max(F.abs("v")).alias("top"))
    parts = x.df.crossJoin(F.broadcast(top)).agg(
        F.max(F.when(F.col("i") == 0, F.col("v"))).alias("alpha"),
        F.sum(F.when((F.col("i") > 0) & (F.col("top") > 0), F.pow(F.col("v") / F.col("top"), 2)).otherwise(0.0)).alias("s"),
        F.max("top").alias("top"),
    ).select(F.coalesce("alpha", F.lit(0.0)).alias("alpha"), (F.col("top") * F.sqrt("s")).alias("sigma"))
    norm = F.hypot("alpha", "sigma")
    beta = norm if positive else F.when(F.col("alpha") >= 0, -norm).otherwise(norm)
    idle = (F.col("sigma") == 0) & (F.lit(not positive) | (F.col("alpha") >= 0))
    # With beta > 0, alpha - beta is found without cancellation.
    gap = F.when(F.col("alpha") > 0, -F.col("sigma") * F.col("sigma") / (F.col("alpha") + norm)).otherwise(F.col("alpha") - norm) if positive else F.col("alpha") - beta
    return parts.select(F.when(idle, F.col("alpha")).otherwise(beta).alias("beta"), F.when(idle, 0.0).otherwise(-gap / beta).alias("tau"), F.when(idle, 0.0).otherwise(1.0 / gap).alias("scale"))


def reflector(x: Vector, positive: bool = False) -> tuple[Vector, float, float]:
    """(v, tau, beta) with v's first element 1."""
    h = house(x, positive).first()
    v = x.df.select("i", F.when(F.col("i") == 0, 1.0).otherwise(F.col("v") * h["scale"]).alias("v"))
    return Vector(v, x.size), h["tau"], h["beta"]


def apply_reflector(a: Matrix, v: Vector, tau: float, side: str = "left") -> Matrix:
    """(I - tau*v*v^T)*A or A*(I - tau*v*v^T), as a product and a rank-one update."""
    if side == "right":
        return apply_reflector(a.T, v, tau).T
    w = mult(1.0, as_column(v), a, trans_a=True)
    return plus(1.0, a, -tau, mult(1.0, as_column(v), w))


def apply_reflectors(a: Matrix, vs: list[tuple[Vector, float]], side: str = "left", trans: bool = False) -> Matrix:
    """Q = H1*H2*... (or its transpose) on one side, through the compact form
    Q = I - Y*T*Y^T, so the whole product costs two products with Y."""
    k = len(vs)
    check_shared(k, k)
    if not vs:
        return a
    cells = None
    for c, (v, _) in enumerate(vs):
        part = v.df.select("i", F.lit(c).cast("long").alias("j"), "v")
        cells = part if cells is None else cells.unionByName(part)
    y = Matrix(cells, vs[0][0].size, k)
    inner = np.zeros((k, k))
    for r in mult(1.0, y, y, trans_a=True).df.collect():
        inner[r["i"], r["j"]] = r["v"]
    t = np.zeros((k, k))
    for c, (_, tau) in enumerate(vs):
        t[:c, c] = -tau * (t[:c, :c] @ inner[:c, c])
        t[c, c] = tau
    t = t.T if trans else t
    if side == "right":
        return plus(1.0, a, -1.0, mult(1.0, mult(1.0, mult(1.0, a, y), matrix_of(a.df.sparkSession, t)), y, trans_b=True))
    return plus(1.0, a, -1.0, mult(1.0, y, mult(1.0, matrix_of(a.df.sparkSession, t), mult(1.0, y, a, trans_a=True))))


def hyperbolic(x: Vector, first: int) -> tuple[Vector, float, float]:
    """(v, tau, beta) of a hyperbolic reflector: with J = diag(1 for i < first, else -1),
    H = I - tau*v*v^T*J maps x to (beta, 0, ...) and keeps x^T*J*x.  Needs x^T*J*x > 0."""
    signed = x.df.withColumn("s", F.when(F.col("i") < first, 1.0).otherwise(-1.0))
    r = signed.agg(F.sum(F.col("s") * F.col("v") * F.col("v")).alias("n"), F.max(F.when(F.col("i") == 0, F.col("v"))).alias("a")).first()
    if r["n"] is None or r["n"] <= 0:
        raise ArithmeticError("x^T*J*x must be positive")
    alpha = r["a"] or 0.0
    beta = -np.copysign(np.sqrt(r["n"]), alpha)
    v = x.df.select("i", F.when(F.col("i") == 0, F.col("v") - float(beta)).otherwise(F.col("v")).alias("v"))
    # v^T*J*v = 2*beta*(beta - alpha)
    return Vector(v, x.size), float(1 / (beta * (beta - alpha))), float(beta)


def apply_hyperbolic(a: Matrix, v: Vector, tau: float, first: int) -> Matrix:
    """(I - tau*v*v^T*J)*A."""
    vj = Vector(v.df.select("i", F.when(F.col("i") < first, F.col("v")).otherwise(-F.col("v")).alias("v")), v.size)
    return plus(1.0, a, -tau, mult(1.0, as_column(v), mult(1.0, as_column(vj), a, trans_a=True)))


def givens_rows(a: Matrix, c: float, s: float, r1: int, r2: int) -> Matrix:
    """Rows r1 and r2 rotated: (c*y1 + s*y2, c*y2 - s*y1); one shuffle of these rows."""
    two = a.df.where(F.col("i").isin(r1, r2)).groupBy("j").agg(
        F.coalesce(F.sum(F.when(F.col("i") == r1, F.col("v"))), F.lit(0.0)).alias("x"), F.coalesce(F.sum(F.when(F.col("i") == r2, F.col("v"))), F.lit(0.0)).alias("y")
    )
    one = two.select(F.lit(r1).cast("long").alias("i"), "j", (c * F.col("x") + s * F.col("y")).alias("v"))
    other = two.select(F.lit(r2).cast("long").alias("i"), "j", (c * F.col("y") - s * F.col("x")).alias("v"))
    return Matrix(a.df.where(~F.col("i").isin(r1, r2)).unionByName(one).unionByName(other), a.rows, a.cols)


def givens_columns(a: Matrix, c: float, s: float, c1: int, c2: int) -> Matrix:
    return givens_rows(a.T, c, s, c1, c2).T


def givens_sequence(a: Matrix, cs: list[tuple[float, float]], start: int = 0, side: str = "left", backward: bool = False) -> Matrix:
    """Rotations k of the rows (columns) start+k and start+k+1, forward or backward.  They
    act on each column (row) alone, so all of them are done where that lies."""
    if side == "left":
        return givens_sequence(a.T, cs, start, "right", backward).T
    check_shared(len(cs), 2)
    turns = list(enumerate(cs))
    turns = turns[::-1] if backward else turns

    def f(_, x):
        x = x.copy()
        for k, (c, s) in turns:
            p, q = x[:, start + k].copy(), x[:, start + k + 1].copy()
            x[:, start + k], x[:, start + k + 1] = c * p + s * q, c * q - s * p
        return x

    rows = to_rows(a)
    return from_rows(Rows(map_rows(rows.df, rows.cols, f), rows.rows, rows.cols))
