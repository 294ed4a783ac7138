"""Eigenvalues of symmetric matrices of any size by splitting the spectrum.

The polar factor of A - s*I has the eigenvectors of A and the eigenvalues +1 and -1, so
(I + U)/2 projects on all eigenvectors with values above s.  Bases of both sides turn A
into two smaller problems, until each fits one task.  The polar factor comes from
the iteration with dynamic weights, which needs at most seven QR factorisations of X above
the identity, whatever the condition is; these are trees of reflectors (`qr_tree`), all else
is products of tiles.  So A is read a fixed number of times for each level of the recursion,
and nothing with n^2 numbers is ever on the driver or in one task.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ..functions.cut import cut, spent
from . import blocks, qr_tree
from .matrix import ShapeError
from .rows import Rows, check_shared, map_rows

#: Most rows of a problem that is solved in one piece.
LEAF = 2048
_EPS = 2.0**-53


def _kept(a: Rows, name: str) -> Rows:
    return Rows(cut(a.df.select("i", "a"), name), a.rows, a.cols)


def _times(a: Rows, b: Rows, trans_a: bool = False, trans_b: bool = False, side: int = blocks.SIDE) -> Rows:
    x, y = blocks.of_rows(a, side), blocks.of_rows(b, side)
    return blocks.to_rows(blocks.mult(blocks.transpose(x) if trans_a else x, blocks.transpose(y) if trans_b else y))


def _sum(alpha: float, a: Rows, beta: float, b: Rows) -> Rows:
    """alpha*A + beta*B, row by row."""
    both = a.df.select("i", "a").join(b.df.select("i", F.col("a").alias("b")), "i")
    return Rows(both.select("i", F.zip_with("a", "b", lambda x, y: alpha * x + beta * y).alias("a")), a.rows, a.cols)


def _shifted(a: Rows, scale: float, shift: float) -> Rows:
    """scale*A + shift*I."""

    def f(i, x):
        x = scale * x
        own = i < x.shape[1]
        x[np.flatnonzero(own), i[own]] += shift
        return x

    return Rows(map_rows(a.df, a.cols, f), a.rows, a.cols)


def _weights(low: float) -> tuple[float, float, float, float]:
    """(a, b, c) of a step for singular values in [low, 1], and the next low."""
    d = (4 * (1 - low * low) / low**4) ** (1 / 3) if low < 1 else 0.0
    root = math.sqrt(1 + d)
    a = root + 0.5 * math.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - low * low) / (low * low * root)))
    b = (a - 1) ** 2 / 4
    c = a + b - 1
    return a, b, c, min(1.0, low * (a + b * low * low) / (1 + c * low * low))


def polar(a: Rows, panel: int = qr_tree.PANEL, side: int = blocks.SIDE) -> Rows:
    """The orthonormal factor U of A = U*H (H symmetric, not negative) for rows >= cols.
    Directions in which A is 0 to working precision stay undetermined, of length 0 to 1."""
    m, n = a.rows, a.cols
    if m < n:
        raise ShapeError((m, n))
    size = F.sqrt(F.sum(F.aggregate("a", F.lit(0.0), lambda t, x: t + (x / F.col("top")) * (x / F.col("top")))))
    top = a.df.agg(F.max(F.array_max(F.transform("a", lambda x: F.abs(x))))).first()[0] or 0.0
    if not math.isfinite(top):
        raise ArithmeticError("the matrix holds values that are not finite")
    norm = top * a.df.withColumn("top", F.lit(top)).agg(size).first()[0] if top else 1.0
    x = _kept(Rows(map_rows(a.df, n, lambda _, v: v / norm), m, n), "polar")
    low = _EPS
    while abs(1 - low) > 4 * _EPS:
        wa, wb, wc, low = _weights(low)
        root = math.sqrt(wc)
        eye = Rows(map_rows(a.df.sparkSession.range(n).select((F.col("id") + m).alias("i"), F.array(F.lit(0.0)).alias("a")), 1, lambda i, _: (i[:, None] == m + np.arange(n)[None, :]).astype(np.float64)), n, n)
        above = map_rows(x.df, n, lambda _, v, root=root: root * v)
        q = qr_tree.thin_q(qr_tree.factor(Rows(above.unionByName(eye.df), m + n, n), panel))
        q = _kept(q, "q")
        q1 = Rows(q.df.where(F.col("i") < m), m, n)
        q2 = Rows(q.df.where(F.col("i") >= m).select((F.col("i") - m).alias("i"), "a"), n, n)
        step = _kept(_sum(wb / wc, x, (wa - wb / wc) / root, _times(q1, q2, trans_b=True, side=side)), "polar")
        spent(x.df, q.df)
        x = step
    return x


def _drawn(spark, n: int, k: int, seed: int) -> Rows:
    """n x k normal numbers that depend on row and seed."""

    def f(i, _):
        return np.stack([np.random.default_rng((seed, int(r))).normal(size=k) for r in i])

    return Rows(map_rows(spark.range(n).select(F.col("id").alias("i"), F.array(F.lit(0.0)).alias("a")), 1, f), n, k)


def _orthonormal(g: Rows, panel: int, name: str) -> Rows:
    return _kept(qr_tree.thin_q(qr_tree.factor(g, panel)), name)


def _bases(p: Rows, k: int, panel: int, side: int) -> tuple[Rows, Rows]:
    """Orthonormal columns that span the range of the projector P of rank k, and others that
    complete them.  Each is P (what the first leave of) random columns, and of that again,
    which takes out what rounding left of other directions."""
    n, spark = p.rows, p.df.sparkSession
    first = _drawn(spark, n, k, 7)
    for _ in range(2):
        first = _orthonormal(_times(p, first, side=side), panel, "basis")
    rest = _drawn(spark, n, n - k, 11)
    for _ in range(2):
        rest = _orthonormal(_sum(1.0, rest, -1.0, _times(first, _times(first, rest, trans_a=True, side=side), side=side)), panel, "basis")
    return first, rest


def _small(a: Rows) -> np.ndarray:
    check_shared(a.rows, a.cols)
    out = np.zeros((a.rows, a.cols))
    for r in a.df.select("i", "a").collect():
        out[r["i"]] = r["a"]
    return (out + out.T) / 2


def eigen(a: Rows, vectors: bool = True, leaf: int = LEAF, panel: int = qr_tree.PANEL, side: int = blocks.SIDE) -> tuple[np.ndarray, Rows | None]:
    """(values, vectors as columns) of a symmetric matrix in row layout, in no order.  Both
    triangles must be given.  Values are a vector on the driver, checked."""
    n, spark = a.rows, a.df.sparkSession
    check_shared(n)
    if n <= leaf:
        own = _small(a)
        if not np.isfinite(own).all():
            raise ArithmeticError("the matrix holds values that are not finite")
        values, v = np.linalg.eigh(own)
        if not vectors:
            return values, None
        where = spark.range(n).select(F.col("id").alias("i"), F.array(F.lit(0.0)).alias("a"))
        return values, Rows(map_rows(where, 1, lambda i, _: v[i]), n, n)
    a = _kept(a, "symmetric")
    diagonal = np.array(sorted((r["i"], r["d"]) for r in a.df.select("i", F.get("a", F.col("i").cast("int")).alias("d")).collect()))[:, 1]
    whole = a.df.agg(F.sqrt(F.sum(F.aggregate("a", F.lit(0.0), lambda t, x: t + x * x)))).first()[0]
    for shift in (float(np.median(diagonal)), float(diagonal.mean())):
        moved = _shifted(a, 1.0, -shift)
        rest = moved.df.agg(F.sqrt(F.sum(F.aggregate("a", F.lit(0.0), lambda t, x: t + x * x)))).first()[0]
        if rest <= 8 * n * _EPS * whole:  # a multiple of the identity
            eye = map_rows(a.df, n, lambda i, _: (i[:, None] == np.arange(n)[None, :]).astype(np.float64))
            return np.full(n, shift), Rows(eye, n, n) if vectors else None
        u = polar(moved, panel, side)
        trace = u.df.agg(F.sum(F.get("a", F.col("i").cast("int")))).first()[0]
        k = round((n + trace) / 2)
        if 0 < k < n:
            break
    else:
        raise ArithmeticError("no split of the spectrum was found")
    found, columns = [], []
    # The projector on the smaller side.
    sign, size = (1.0, k) if 2 * k <= n else (-1.0, n - k)
    p = Rows(map_rows(u.df, n, lambda i, x: 0.5 * (sign * x + (i[:, None] == np.arange(n)[None, :]))), n, n)
    for v in _bases(p, size, panel, side):
        inner = _times(v, _times(a, v, side=side), trans_a=True, side=side)
        values, w = eigen(inner, vectors, leaf, panel, side)
        found.append(values)
        if vectors:
            columns.append(_kept(_times(v, w, side=side), "vectors"))
    spent(u.df, a.df)
    if not vectors:
        return np.concatenate(found), None
    both = columns[0].df.join(columns[1].df.select("i", F.col("a").alias("b")), "i").select("i", F.concat("a", "b").alias("a"))
    return np.concatenate(found), Rows(both, n, n)
