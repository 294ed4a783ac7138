"""Hessenberg, tridiagonal and bidiagonal forms of one large matrix.

The tri- and bidiagonal forms go by way of a band (`banded`), which needs two passes over the
matrix for each panel of columns.

A Hessenberg reflector needs the product of the whole matrix with one vector: a pass over its
rows that returns one number for each.  Inside a panel the matrix is left as it is and
products are corrected by the panel's own vectors (sides n and PANEL, checked, the only
thing that every task gets); after the panel all rows are updated where they lie and
written once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..functions.cut import cut, spent
from .banded import Turned, chased, reflector, symmetric_band, times, upper_band, weighted, width_of
from .matrix import Matrix, ShapeError, Vector, mirrored
from .rows import Rows, check_shared, from_rows, map_rows, to_rows

#: Reflectors of one panel of the Hessenberg form.
PANEL = 16


@dataclass(frozen=True)
class Condensed:
    """A = Q*M*P^T.  h: M as a matrix (hessenberg); else d and e, its diagonal and the one
    beside it.  P is Q but for the bidiagonal form."""

    q: Matrix
    p: Matrix
    h: Matrix | None = None
    d: Vector | None = None
    e: Vector | None = None

    def middle(self) -> Matrix:
        """M from d and e: symmetric if P is Q, else bidiagonal (upper; lower if it is wide)."""
        if self.h is not None:
            return self.h
        n = self.d.size
        up = self.e.df.select("i", (F.col("i") + 1).alias("j"), "v")
        low = up.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")
        out = self.d.df.select("i", F.col("i").alias("j"), "v")
        if self.p is self.q:
            return Matrix(out.unionByName(up).unionByName(low), n, n)
        return Matrix(out.unionByName(up if self.q.rows >= self.p.rows else low), n, n)


def _vector(spark, x: np.ndarray) -> Vector:
    """A vector from the driver, where a side of the matrix fits."""
    return Vector(spark.createDataFrame(pa.table({"i": np.arange(len(x), dtype=np.int64), "v": np.asarray(x, np.float64)})), len(x))


def tridiagonal(a: Matrix, uplo: str = "lower", panel: int | None = None, vectors: bool = True) -> Condensed:
    """A = Q*T*Q^T of a symmetric matrix of which one triangle is given, by way of a band of
    `panel` columns (by default what memory allows, 64 at most); without vectors Q is left the
    identity."""
    if a.rows != a.cols:
        raise ShapeError((a.rows, a.cols))
    n, spark = a.rows, a.df.sparkSession
    q = Turned(spark, n)
    band = symmetric_band(to_rows(mirrored(a, uplo)), panel or width_of(n), q if vectors else None)
    d, e = chased(spark, band, True, q if vectors else None)
    whole = q.matrix()
    return Condensed(whole, whole, d=_vector(spark, d), e=_vector(spark, e))


def hessenberg(a: Matrix, panel: int = PANEL) -> Condensed:
    """A = Q*H*Q^T with H zero below its first subdiagonal."""
    if a.rows != a.cols:
        raise ShapeError((a.rows, a.cols))
    n, spark = a.rows, a.df.sparkSession
    check_shared(n, 2 * panel)
    state, turned = cut(to_rows(a).df, "rows"), Turned(spark, n)
    for left in range(0, max(n - 2, 0), panel):
        right = min(left + panel, n - 2)
        columns = times(state, n, np.eye(n)[:, left:right], n)
        v, y, taus, t = np.zeros((n, right - left)), np.zeros((n, right - left)), np.zeros(right - left), np.zeros((right - left,) * 2)
        for c, j in enumerate(range(left, right)):
            column = columns[:, c] - y[:, :c] @ v[j, :c]
            column -= v[:, :c] @ (t[:c, :c].T @ (v[:, :c].T @ column))
            v[j + 1 :, c], taus[c], _ = reflector(column[j + 1 :])
            inner = v[:, :c].T @ v[:, c]
            t[:c, c], t[c, c] = -taus[c] * (t[:c, :c] @ inner), taus[c]
            if taus[c]:
                y[:, c] = taus[c] * (times(state, n, v[:, c : c + 1], n)[:, 0] - y[:, :c] @ inner)
        right_side = lambda i, r, v=v, y=y: r - y[i] @ v.T
        z = t.T @ weighted(state, n, v, right_side)

        def both(i, r, v=v, z=z, right_side=right_side, left=left, right=right):
            r = right_side(i, r) - v[i] @ z
            j = np.arange(left, right)
            r[:, left:right][i[:, None] > j[None, :] + 1] = 0.0
            return r

        old, state = state, cut(map_rows(state, n, both), "panel")
        spent(old)
        turned.add(0, v, t)
    q = turned.matrix()
    return Condensed(q, q, h=from_rows(Rows(state, n, n)))


def bidiagonal(a: Matrix, panel: int | None = None) -> Condensed:
    """A = Q*B*P^T: B upper bidiagonal if rows >= cols, else lower, by way of a band of `panel`
    columns (by default what memory allows, 64 at most).  A tall matrix is brought to the
    triangle of its QR form first, so only the short side has panels."""
    if a.rows < a.cols:
        f = bidiagonal(a.T, panel)
        return Condensed(f.p, f.q, d=f.d, e=f.e)
    spark, n = a.df.sparkSession, a.cols
    if a.rows > n:
        from .orthogonal import qr
        from .products import mult

        tall = qr(a)
        f = bidiagonal(tall.factor, panel)
        return Condensed(mult(1.0, tall.q, f.q), f.p, d=f.d, e=f.e)
    q, p = Turned(spark, n), Turned(spark, n)
    d, e = chased(spark, upper_band(to_rows(a), panel or width_of(n), q, p), False, q, p)
    return Condensed(q.matrix(), p.matrix(), d=_vector(spark, d), e=_vector(spark, e))
