"""Eigenvalues and singular values.

The long side of a matrix stays distributed: it is reduced by a tree of reflectors to a
triangle with the short side's size.  Symmetric matrices, and matrices with both sides
long, are split at values of their spectrum until the parts fit one task (`split`);
tridiagonal ones are torn in two and joined by the secular equation.  Single
eigenvalues come from a tridiagonal form by bisection, where each is a row of its own.
Block Jacobi sweeps serve bidiagonal matrices, whose small values they keep.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cut import cut, spent
from . import blocks, qr_tree, split
from .matrix import Matrix, ShapeError, Vector, mirrored
from .orthogonal import qr_rows, tsqr
from .rows import Rows, arrays, check_shared, from_rows, map_rows, matrix_of, times_small, to_rows
from .sorting import ranked

#: Most columns of a triangle that is left by TSQR and decomposed in one piece; beyond it
#: the same factors come from Jacobi sweeps.
SMALL = 2048


@dataclass(frozen=True)
class SVD:
    """A = U*diag(s)*V^T, s descending; columns of U signed so that the largest component
    of each right vector is positive."""

    u: Matrix | None
    s: Vector
    v: Matrix | None


@dataclass(frozen=True)
class Eigen:
    """Eigenvalues ascending and their vectors as columns, largest component positive."""

    values: Vector
    vectors: Matrix | None


def vector_of(spark, values: np.ndarray) -> Vector:
    table = pd.DataFrame({"i": np.arange(len(values)), "v": np.asarray(values, np.float64)})
    return Vector(spark.createDataFrame(table, "i long, v double"), len(values))


def _signed(v: np.ndarray) -> np.ndarray:
    """+1 or -1 for each column: the sign of its largest component."""
    if not v.size:
        return np.ones(v.shape[1])
    top = v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])]
    return np.where(top < 0, -1.0, 1.0)


def svd(a: Matrix | Rows, vectors: bool = True) -> SVD:
    """Singular values and vectors.  Up to SMALL columns (or rows) the shorter side is
    decomposed in one piece; a tall table in row layout is not shuffled."""
    if isinstance(a, Rows) and (a.rows < a.cols or a.cols > SMALL):
        a = from_rows(a)
    if a.rows < a.cols:
        f = svd(a.T, vectors)
        return SVD(f.v, f.s, f.u)
    if a.cols > SMALL:
        return _split_svd(to_rows(a), vectors)
    spark, rows = a.df.sparkSession, to_rows(a)
    if not vectors:
        return SVD(None, vector_of(spark, np.linalg.svd(tsqr(rows), compute_uv=False)), None)
    q, r = qr_rows(rows)
    u, s, vt = np.linalg.svd(r)
    sign = _signed(vt.T)
    return SVD(from_rows(times_small(q, u * sign)), vector_of(spark, s), matrix_of(spark, vt.T * sign))


def _split_svd(a: Rows, vectors: bool, leaf: int = SMALL, panel: int = qr_tree.PANEL, side: int = blocks.SIDE) -> SVD:
    """SVD with both sides long: A = W*H by its polar factor, H = V*diag(s)*V^T by splitting,
    U = W*V.  Where s is 0 to working precision, columns of U fill up the others to an
    orthonormal set."""
    spark, m, n = a.df.sparkSession, a.rows, a.cols
    a = Rows(cut(a.df.select("i", "a"), "rows"), m, n)
    w = split.polar(a, panel, side)
    h = split._times(w, a, trans_a=True, side=side)
    h = Rows(cut(h.df, "polar"), n, n)
    both = split._sum(0.5, h, 0.5, blocks.to_rows(blocks.transpose(blocks.of_rows(h, side))))
    values, v = split.eigen(both, vectors, leaf, panel, side)
    rank = np.argsort(-values, kind="stable")
    s = np.maximum(values[rank], 0.0)
    if not vectors:
        return SVD(None, vector_of(spark, s), None)
    v = Rows(cut(map_rows(v.df, n, lambda _, x: x[:, rank]), "vectors"), n, n)
    missing = np.flatnonzero(s <= max(m, n) * 2.0**-50 * s.max(initial=0.0)).tolist()
    u = from_rows(Rows(cut(split._times(w, v, side=side).df, "vectors"), m, n)).where(~F.col("j").isin(missing) if missing else F.lit(True))
    v = from_rows(v)
    signs = cut(_signs(v), "signs")
    return SVD(_turned(_completed(u, missing), signs), vector_of(spark, s), _turned(v, signs))


def singular_values(a: Matrix | Rows) -> DataFrame:
    return svd(a, vectors=False).s.df


def eigen_sym(a: Matrix, uplo: str = "lower", vectors: bool = True) -> Eigen:
    """All eigenvalues of a symmetric matrix from one triangle.  Up to SMALL rows it is
    decomposed in one piece; a larger one is split at values of its spectrum until its parts are."""
    if a.rows != a.cols:
        raise ShapeError((a.rows, a.cols))
    if not a.rows:
        return Eigen(vector_of(a.df.sparkSession, np.zeros(0)), a if vectors else None)
    return _ordered(a.df.sparkSession, *split.eigen(to_rows(mirrored(a, uplo)), vectors, SMALL))


def _ordered(spark, values: np.ndarray, vectors: Rows | None) -> Eigen:
    """Values ascending, and their vectors with the largest component positive."""
    rank = np.argsort(values, kind="stable")
    out = vector_of(spark, values[rank])
    if vectors is None:
        return Eigen(out, None)
    v = from_rows(Rows(cut(map_rows(vectors.df, vectors.cols, lambda _, x: x[:, rank]), "vectors"), vectors.rows, vectors.cols))
    return Eigen(out, _turned(v, _signs(v)))


def eigen_sym_selected(a: Matrix, uplo: str = "lower", first: int | None = None, last: int | None = None, low: float | None = None, high: float | None = None) -> DataFrame:
    """(i, v): eigenvalues with index in [first, last) and value in [low, high].  Only those
    are computed, from the tridiagonal form."""
    from .condensed import tridiagonal

    f = tridiagonal(a, uplo, vectors=False)
    first, last = first or 0, a.rows if last is None else last
    spark = a.df.sparkSession
    if low is not None or high is not None:
        # A value just outside by rounding is sorted out below.
        ends = [float(low) - 1e-9 * (1 + abs(low)) if low is not None else -np.inf, float(high) + 1e-9 * (1 + abs(high)) if high is not None else np.inf]
        below = dict(_counts_below(*_bands(f.d, f.e), np.array(ends)))
        first, last = max(first, below[ends[0]]), min(last, below[ends[1]])
    frame = bisect(spark, f.d, f.e, first, max(first, last))
    frame = frame.where(F.col("v") >= low) if low is not None else frame
    return frame.where(F.col("v") <= high) if high is not None else frame


def eigen_sym_selected_vectors(a: Matrix, uplo: str = "lower", first: int | None = None, last: int | None = None, low: float | None = None, high: float | None = None) -> Eigen:
    """Eigenvalues with index in [first, last) and value in [low, high], numbered from 0, and their
    vectors as columns.  All of them are decomposed first: those that are close to each
    other are only orthogonal if they are found together."""
    f = eigen_sym(a, uplo)
    n, first = a.rows, first or 0
    values = np.sort(_numbers(f.values))
    inside = np.ones(n, bool)
    inside[: max(first, 0)] = False
    inside[n if last is None else last :] = False
    inside &= (values >= (-np.inf if low is None else low)) & (values <= (np.inf if high is None else high))
    at, count = int(inside.argmax()), int(inside.sum())
    j = F.col("j")
    vectors = Matrix(f.vectors.df.where(j.between(at, at + count - 1)).select("i", (j - at).alias("j"), "v"), n, count)
    return Eigen(vector_of(a.df.sparkSession, values[inside]), vectors)


# Block Jacobi for long short sides


def _rounds(n: int):
    """Pairings of n (even) blocks such that every pair meets once: a round-robin."""
    ring = list(range(n))
    for _ in range(n - 1):
        yield [(min(a, b), max(a, b)) for a, b in zip(ring[: n // 2], reversed(ring[n // 2 :]), strict=True)]
        ring = [ring[0], ring[-1], *ring[1:-1]]


def _with_path(frame: DataFrame, table: DataFrame) -> DataFrame:
    """`frame`, which only reads `table`, with that table's place."""
    frame.written_to = table.written_to
    return frame


def _orthogonalise(rows: Rows, tolerance: float, sweeps: int, width: int, beside: int = 0) -> DataFrame:
    """(i, a) with rows made orthogonal to each other by rotations: one-sided Jacobi on
    row blocks of `width`.  The last `beside` elements of a row only turn with the others.  A task holds two blocks; sweeps end when no pair of rows is
    off by more than the tolerance (rows that are rounding errors of the whole don't
    count), and ArithmeticError is raised if that takes too many."""
    count = max(2, -(-rows.rows // width))
    count += count % 2
    n, whole_width = rows.cols - beside, rows.cols
    state = cut(rows.df.select("i", "a", F.lit(0.0).alias("off")), "jacobi")
    whole = state.agg(F.sum(F.aggregate(F.slice("a", 1, n), F.lit(0.0), lambda t, x: t + x * x))).first()[0] or 0.0
    least = max(n, rows.rows) * 2.0**-53 * np.sqrt(whole)

    def turn(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("i")
        x = np.stack(frame["a"].to_numpy()) if len(frame) else np.zeros((0, whole_width))
        g = x[:, :n] @ x[:, :n].T
        size = np.sqrt(np.maximum(np.diag(g), 1e-300))
        real = size > least
        close = np.abs(g / size[:, None] / size[None, :]) * real[:, None] * real[None, :]
        np.fill_diagonal(close, 0.0)
        off = close.max(initial=0.0)
        if off > tolerance:
            _, v = np.linalg.eigh(g)
            x = v[:, ::-1].T @ x
        off = max(off, frame["off"].max())  # rows carry the worst of the sweep along
        return pd.DataFrame({"i": frame["i"].to_numpy(), "a": list(x), "off": np.full(len(frame), off)})

    for _ in range(sweeps):
        state = _with_path(state.withColumn("off", F.lit(0.0)), state)
        for pairs in _rounds(count):
            partner = {b: k for k, pair in enumerate(pairs) for b in pair}
            key = F.create_map(*[F.lit(x) for kv in partner.items() for x in kv])[F.floor(F.col("i") / width).cast("int")]
            old, state = state, cut(state.groupBy(key.alias("pair")).applyInPandas(turn, "i long, a array<double>, off double"), "jacobi")
            spent(old)
        if (state.agg(F.max("off")).first()[0] or 0.0) <= tolerance:
            return state.select("i", "a")
    raise ArithmeticError(f"rows are not orthogonal after {sweeps} sweeps")


def _signs(a: Matrix) -> DataFrame:
    """(j, sign): the sign of each column's largest component, the first of equals."""
    return a.df.groupBy("j").agg(F.when(F.max_by("v", F.struct(F.abs("v"), -F.col("i"))) < 0, -1.0).otherwise(1.0).alias("sign"))


def _turned(a: Matrix, signs: DataFrame) -> Matrix:
    return Matrix(a.df.join(signs, "j").select("i", "j", (F.col("v") * F.col("sign")).alias("v")), a.rows, a.cols)


def _completed(a: Matrix, missing: list[int]) -> Matrix:
    """Orthonormal columns with those of `missing`, which have no cells, filled up to an
    orthonormal set: random ones less their part in the others, then QR."""
    from .elementwise import plus
    from .matrix import normal
    from .products import mult

    if not missing:
        return a
    check_shared(len(missing), len(missing))
    have = Matrix(cut(a.df, "have"), a.rows, a.cols)
    fill = normal(a.df.sparkSession, a.rows, len(missing), 5)
    for _ in range(2):
        fill = plus(1.0, fill, -1.0, mult(1.0, have, mult(1.0, have, fill, trans_a=True)))
        fill = from_rows(qr_rows(to_rows(fill))[0])
    to = F.array(*[F.lit(int(c)) for c in missing])[F.col("j").cast("int")].cast("long")
    return Matrix(have.df.unionByName(fill.df.select("i", to.alias("j"), "v")), a.rows, a.cols)


def _width(n: int) -> int:
    """Rows of a Jacobi block: a task holds two."""
    return min(256, max(32, -(-n // 4)))


def _jacobi_svd(a: Matrix, vectors: bool, width: int | None = None, tolerance: float = 1e-13, sweeps: int = 60) -> SVD:
    """SVD with both sides long.  Rows of A^T (columns of A) are made orthogonal: they are
    then s*u.  The identity beside them turns along and becomes V^T.  Where s is 0 to
    working precision, columns of U fill up the others to an orthonormal set."""
    m, n = a.rows, a.cols
    rows = to_rows(a.T)
    if vectors:
        rows = Rows(map_rows(rows.df, m, lambda i, x: np.hstack((x, (i[:, None] == np.arange(n)[None, :]).astype(np.float64)))), n, m + n)
    turned = _orthogonalise(rows, tolerance, sweeps, width or _width(n), n if vectors else 0)
    sized = cut(turned.withColumn("v", F.sqrt(F.aggregate(F.slice("a", 1, m), F.lit(0.0), lambda t, x: t + x * x))), "sized")
    order = cut(ranked(sized.select("i", "v"), ascending=False), "ranked")
    s = Vector(order.select(F.col("k").alias("i"), "v"), n)
    if not vectors:
        return SVD(None, s, None)
    top = order.agg(F.max("v")).first()[0] or 0.0
    real = F.col("v") > max(m, n) * 2.0**-52 * top
    missing = [r["k"] for r in order.where(~real).select("k").collect()]
    placed = sized.join(order.select("i", F.col("k").alias("j")), "i").select("j", "v", F.posexplode("a").alias("i", "x"))
    cells = cut(placed.select(F.col("i").cast("long").alias("i"), "j", "v", "x"), "placed")
    u = Matrix(cells.where(F.col("i") < m).where(real).select("i", "j", (F.col("x") / F.col("v")).alias("v")), m, n)
    v = Matrix(cells.where(F.col("i") >= m).select((F.col("i") - m).alias("i"), "j", F.col("x").alias("v")), n, n)
    signs = _signs(v)
    return SVD(_turned(_completed(u, missing), signs), s, _turned(v, signs))


def _jacobi_eigen(a: Matrix, vectors: bool) -> Eigen:
    """The left vectors of a symmetric A are its eigenvectors (up to equal |values|); a shift
    makes all values positive first, far from 0, so that none share an absolute value."""
    from .elementwise import plus
    from .matrix import identity
    from .reductions import norm

    shift = 2 * float(norm(a, "inf").first()[0]) or 1.0
    raised = plus(1.0, a, shift, identity(a.df.sparkSession, a.rows))
    turned = _orthogonalise(to_rows(raised), 1e-13, 60, _width(a.rows))
    sized = cut(turned.withColumn("v", F.sqrt(F.aggregate("a", F.lit(0.0), lambda t, x: t + x * x))), "sized")
    order = cut(ranked(sized.select("i", "v")), "ranked")
    values = Vector(order.select(F.col("k").alias("i"), (F.col("v") - shift).alias("v")), a.rows)
    if not vectors:
        return Eigen(values, None)
    unit = sized.join(order.select("i", F.col("k").alias("j")), "i").select("j", "v", F.posexplode("a").alias("i", "x"))
    u = Matrix(unit.select(F.col("i").cast("long").alias("i"), "j", (F.col("x") / F.col("v")).alias("v")), a.rows, a.rows)
    return Eigen(values, _turned(u, _signs(u)))


# Tridiagonal and bidiagonal matrices.  Their bands are vectors, which every task gets.


def _numbers(x: Vector | list, size: int | None = None) -> np.ndarray:
    """A vector as an array; absent elements are 0."""
    if not isinstance(x, Vector):
        return np.array(x, np.float64)
    check_shared(x.size)
    out = np.zeros(x.size)
    got = x.df.select("i", "v").toArrow()
    out[got["i"].to_numpy()] = got["v"].to_numpy()
    return out


def _bands(d: Vector | list, e: Vector | list) -> tuple[np.ndarray, np.ndarray]:
    d, e = _numbers(d), _numbers(e)
    if len(e) != max(len(d) - 1, 0):
        raise ShapeError((len(d), len(e)))
    return d, e


def _below(d: np.ndarray, e: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For each x how many eigenvalues of the tridiagonal (d, e) are below it.  Pivots come
    from quotients, e * (e / q), and never from squares, so with a largest element near 1
    nothing over- or underflows that could change a count."""
    q, count = np.ones(len(x)), np.zeros(len(x), np.int64)
    beside = np.concatenate(([0.0], e))
    with np.errstate(over="ignore", under="ignore", divide="ignore"):
        for m in range(len(d)):
            q = np.where(q == 0, -1e-307, q)
            q = d[m] - x - beside[m] * (beside[m] / q)
            count += q < 0
    return count


def _unit(*parts: np.ndarray) -> float:
    """The power of two that brings the largest of all elements to one half at least."""
    top = max((np.abs(p).max(initial=0.0) for p in parts), default=0.0)
    if not np.isfinite(top):
        raise ArithmeticError("the matrix holds values that are not finite")
    return float(np.ldexp(1.0, max(-1000, min(1000, -int(np.frexp(top)[1]))))) if top else 1.0


def _places(x: np.ndarray) -> np.ndarray:
    """Doubles as integers of the same order: neighbours differ by one."""
    bits = np.ascontiguousarray(x, np.float64).view(np.int64)
    return np.where(bits < 0, np.int64(-(2**63)) - bits, bits)


def _doubles(places: np.ndarray) -> np.ndarray:
    return np.where(places < 0, np.int64(-(2**63)) - places, places).view(np.float64)


def _halved(low: float, high: float, above: np.ndarray, count) -> np.ndarray:
    """For each k of `above` the least double with count(x) > k, down to neighbouring
    doubles: small values keep all their digits."""
    a, b = np.full(len(above), _places(np.array([low]))[0]), np.full(len(above), _places(np.array([high]))[0])
    while len(a) and (b - a > 1).any():
        x = a // 2 + b // 2 + (a & b & 1)
        below = count(_doubles(x)) > above
        b, a = np.where(below, x, b), np.where(below, a, x)
    return _doubles(a)


def _counts_below(d: np.ndarray, e: np.ndarray, x: np.ndarray):
    return zip(x.tolist(), np.where(x == np.inf, len(d), np.where(x == -np.inf, 0, _below(d * _unit(d, e), e * _unit(d, e), np.nan_to_num(x) * _unit(d, e)))).tolist(), strict=True)


def sturm_counts(spark, d: Vector | list, e: Vector | list, points: DataFrame) -> DataFrame:
    """(x, count): how many eigenvalues of the tridiagonal (d, e) are below each x of
    `points`; any number of points is one narrow pass."""
    diag, off = _bands(d, e)
    unit = _unit(diag, off)

    def count(batches):
        for frame in batches:
            yield pd.DataFrame({"x": frame["x"], "count": _below(diag * unit, off * unit, frame["x"].to_numpy(np.float64) * unit).astype(np.int32)})

    return points.select(F.col("x").cast("double").alias("x")).mapInPandas(count, "x double, count int")


def bisect(spark, d: Vector | list, e: Vector | list, first: int = 0, last: int | None = None) -> DataFrame:
    """(i, v): eigenvalues first <= i < last of a symmetric tridiagonal matrix, ascending.
    Each is a row with its own interval, which is halved down to neighbouring doubles."""
    diag, off = _bands(d, e)
    n, unit = len(diag), _unit(diag, off)
    diag, off = diag * unit, off * unit
    last = n if last is None else last
    size = np.abs(off)
    reach = np.concatenate((size, [0.0])) + np.concatenate(([0.0], size)) if n else np.zeros(0)
    wide = 1e-12 * (np.abs(diag).max(initial=0.0) + reach.max(initial=0.0)) + 1e-300
    low, high = (diag - reach).min(initial=0.0) - wide, (diag + reach).max(initial=0.0) + wide

    def halve(batches):
        for frame in batches:
            k = frame["i"].to_numpy()
            yield pd.DataFrame({"i": k, "v": _halved(low, high, k, lambda x: _below(diag, off, x)) / unit})

    return spark.range(first, last).select(F.col("id").alias("i")).mapInPandas(halve, "i long, v double")


def tridiagonal_eigen(d: Vector, e: Vector, vectors: bool = True) -> Eigen:
    """Of the symmetric tridiagonal matrix (d, e): values by bisection if they are all that
    is wanted, else both by tearing it in two."""
    if not vectors:
        return Eigen(Vector(bisect(d.df.sparkSession, d, e), d.size), None)
    return _ordered(d.df.sparkSession, *_torn(d.df.sparkSession, *_bands(d, e)))


#: Rows of a tridiagonal matrix that is decomposed in one task.
LEAF = 512


def _torn(spark, d: np.ndarray, e: np.ndarray, leaf: int = LEAF, side: int = blocks.SIDE) -> tuple[np.ndarray, Rows]:
    """(values, vectors as columns) by divide and conquer: without its middle element off the
    diagonal the matrix is two, and that element is a rank-one matrix beside them.

    The leaves are decomposed all at once, a row each.  Two neighbours are joined by the
    eigenvectors of diag(values) + rho*z*z^T, z being the last row of one's and the first of
    the other's vectors; theirs are multiplied by these as tiles."""
    n = len(d)
    check_shared(n, 8)
    if not np.isfinite(d).all() or not np.isfinite(e).all():
        raise ArithmeticError("the matrix holds values that are not finite")
    cuts = [0, *(k * n // -(-n // leaf) for k in range(1, -(-n // leaf))), n] if n else [0, 0]
    rho, d = [abs(float(e[c - 1])) for c in cuts[1:-1]], d.copy()
    for c, r in zip(cuts[1:-1], rho, strict=True):
        d[c - 1] -= r
        d[c] -= r

    def solve(batches):
        for batch in batches:
            for k in batch.column("id").to_pylist():
                a, b = cuts[k], cuts[k + 1]
                own = np.diag(d[a:b]) + np.diag(e[a : b - 1], 1) + np.diag(e[a : b - 1], -1)
                values, v = np.linalg.eigh(own)
                yield pa.record_batch([pa.array(np.full(b - a, k)), pa.array(np.arange(b - a)), arrays(np.hstack((v, values[:, None])))], names=["leaf", "i", "a"])

    count = len(cuts) - 1
    table = cut(spark.range(0, count, 1, count).mapInArrow(solve, "leaf long, i long, a array<double>"), "leaves")
    last = {(r["leaf"], r["i"]): r for r in table.select("leaf", "i", F.element_at("a", -1).alias("value")).collect()}
    parts = []
    for k in range(count):
        size = cuts[k + 1] - cuts[k]
        values = np.array([last[k, i]["value"] for i in range(size)])
        own = table.where(F.col("leaf") == k).select("i", F.slice("a", 1, size).alias("a"))
        parts.append((values, Rows(own, size, size), float(np.sign(e[cuts[k + 1] - 1])) if k + 1 < count else 1.0, rho[k] if k + 1 < count else 0.0))
    while len(parts) > 1:
        joined = [_join(spark, *parts[k : k + 2], side) for k in range(0, len(parts) - 1, 2)]
        parts = joined + ([parts[-1]] if len(parts) % 2 else [])
    return parts[0][0], parts[0][1]


def _join(spark, left: tuple, right: tuple, side: int) -> tuple:
    """Two torn neighbours (values, vectors, sign and size of the element after it) as one."""
    (x, p, sign, rho), (y, q, *after) = left, right
    m, n = len(x), len(y)
    row = lambda v, k: np.array(v.df.where(F.col("i") == k).first()["a"])
    z = np.concatenate((row(p, m - 1), sign * row(q, 0)))
    f = rank_one_eigen(spark, np.concatenate((x, y)), z, rho)
    values = np.zeros(m + n)
    for r in f.values.df.collect():
        values[r["i"]] = r["v"]
    # The rows of one part have nothing in the other's columns: two products, not one of twice the size.
    w = cut(to_rows(f.vectors).df, "rank-one")
    top = split._times(p, Rows(w.where(F.col("i") < m), m, m + n), side=side)
    low = split._times(q, Rows(w.where(F.col("i") >= m).select((F.col("i") - m).alias("i"), "a"), n, m + n), side=side)
    v = cut(top.df.unionByName(low.df.select((F.col("i") + m).alias("i"), "a")), "joined")
    spent(w)
    return values, Rows(v, m + n, m + n), *after


def bidiagonal_values(d: Vector, e: Vector) -> DataFrame:
    """(i, v): singular values of the upper bidiagonal (d, e), descending, each a row of its
    own and right to its last digits however small it is.

    They are the upper half of the eigenvalues of the tridiagonal matrix with a zero diagonal
    and d0, e0, d1, e1, ... beside it.  Its count of values below x is the differential
    transform q <- -x - b * (b / q), which holds relative accuracy since nothing in it
    cancels against a diagonal; scaling by a power of two keeps it in range."""
    diag, off = _bands(d, e)
    n, unit = len(diag), _unit(diag, off)
    beside = np.zeros(max(2 * n - 1, 0))
    beside[0::2], beside[1::2] = diag * unit, off * unit
    zero, high = np.zeros(2 * n), 2 * np.abs(beside).max(initial=0.0) + 1e-300

    def halve(batches):
        for frame in batches:
            k = frame["i"].to_numpy()
            yield pd.DataFrame({"i": k, "v": _halved(0.0, high, 2 * n - 1 - k, lambda x: _below(zero, beside, x)) / unit})

    return d.df.sparkSession.range(n).select(F.col("id").alias("i")).mapInPandas(halve, "i long, v double")


def bidiagonal_svd(d: Vector, e: Vector, vectors: bool = True, leaf: int = LEAF, panel: int = qr_tree.PANEL, side: int = blocks.SIDE) -> SVD:
    """Of the upper bidiagonal matrix B = (d, e), values descending.

    The tridiagonal matrix of `bidiagonal_values` is torn for its vectors, which hold v and u
    in turns.  Where s is small, v and u of one vector need not be of equal length, and v's of
    equal s not orthogonal; so V is the Q of the v's in this order, U that of B*V.  Columns
    that are lost to rounding, as where s is 0, come out of the reflectors orthonormal."""
    spark, n = d.df.sparkSession, d.size
    s = Vector(bidiagonal_values(d, e), n)
    if not vectors or not n:
        return SVD(None, s, None)
    diag, off = _bands(d, e)
    unit = _unit(diag, off)
    beside = np.zeros(2 * n - 1)
    beside[0::2], beside[1::2] = diag * unit, off * unit
    values, both = _torn(spark, np.zeros(2 * n), beside, leaf, side)
    rank = np.argsort(-values, kind="stable")[:n]
    even = both.df.where(F.col("i") % 2 == 0).select((F.col("i") / 2).cast("long").alias("i"), "a")
    halves = Rows(map_rows(even, 2 * n, lambda _, x: x[:, rank]), n, n)
    v = Rows(cut(qr_tree.thin_q(qr_tree.factor(halves, panel)).df, "right"), n, n)
    band = spark.createDataFrame(pa.table({"i": np.arange(n), "d": beside[0::2], "e": np.append(beside[1::2], 0.0)}))
    after = v.df.select((F.col("i") - 1).alias("i"), F.col("a").alias("b"))
    own, next_ = F.transform("a", lambda x: x * F.col("d")), F.zip_with("a", "b", lambda x, y: x * F.col("d") + y * F.col("e"))
    image = v.df.join(band, "i").join(after, "i", "left").select("i", F.when(F.col("b").isNull(), own).otherwise(next_).alias("a"))
    u = cut(qr_tree.thin_q(qr_tree.factor(Rows(image, n, n), panel)).df, "left")
    right = from_rows(v)
    signs = cut(_signs(right), "signs")
    return SVD(_turned(from_rows(Rows(u, n, n)), signs), s, _turned(right, signs))


# The secular equation: eigenvalues of diag(d) + rho*z*z^T


@dataclass(frozen=True)
class _Secular:
    """d ascending, z turned so that equal d's share one; kept: places that have a root of
    their own; turns: (p, q, c, s) done to z, in order; order: place -> index."""

    d: np.ndarray
    z: np.ndarray
    kept: np.ndarray
    turns: list
    order: np.ndarray
    rho: float


def _secular(d: np.ndarray, z: np.ndarray, rho: float) -> _Secular:
    """Sorts d and takes out what has no root of its own: places where z is 0 to working
    precision, and all but one of places whose d are so close that turning one z into the
    other changes nothing else."""
    order = np.argsort(d, kind="stable")
    d, z = d[order].copy(), z[order].copy()
    n = len(d)
    scale = max(np.abs(d).max(initial=0.0), abs(rho) * float(z @ z))
    tiny = 8 * 2.0**-53 * scale
    turns, last = [], None
    kept = np.abs(rho * z) * np.sqrt(float(z @ z)) > tiny
    for k in range(n):
        if not kept[k]:
            z[k] = 0.0
            continue
        if last is not None:
            r = np.hypot(z[last], z[k])
            c, s = z[k] / r, z[last] / r
            if abs((d[k] - d[last]) * c * s) <= tiny:
                turns.append((last, k, c, s))
                d[last], d[k] = d[last] * c * c + d[k] * s * s, d[last] * s * s + d[k] * c * c
                z[last], z[k], kept[last] = 0.0, r, False
        last = k
    return _Secular(d, z, np.flatnonzero(kept), turns, order, rho)


def _offsets(spark, p: _Secular) -> tuple[np.ndarray, np.ndarray]:
    """For each kept place the pole that its root is nearest to and the offset from it."""
    base, w, rho = p.d[p.kept], p.z[p.kept] ** 2, p.rho
    ends = np.append(base[1:], (base[-1:] + rho * w.sum()))

    def find(batches):
        for frame in batches:
            k = frame["i"].to_numpy()

            def value(pole, x):
                with np.errstate(divide="ignore", invalid="ignore"):
                    return 1 + rho * (w[None, :] / (base[None, :] - base[pole][:, None] - x[:, None])).sum(axis=1)

            gap = ends[k] - base[k]
            # The pole on whose side of the middle the root lies; the last has only its own.
            right = (value(k, gap / 2) < 0) & (k < len(base) - 1)
            pole = np.where(right, np.minimum(k + 1, len(base) - 1), k)
            a, b = np.where(right, -gap / 2, 0.0), np.where(right, 0.0, np.where(k < len(base) - 1, gap / 2, gap))
            for _ in range(160):
                # Towards a pole by the geometric mean, so that a small offset keeps its digits.
                # Roots are taken first: the product of two small offsets may be 0.
                near = np.where(right, -np.sqrt(np.maximum(-a, 0.0)) * np.sqrt(np.maximum(-b, 1e-300)), np.sqrt(np.maximum(b, 0.0)) * np.sqrt(np.maximum(a, 1e-300)))
                wide = np.where(right, a < 4 * b, b > 4 * a)
                x = np.where(wide, near, (a + b) / 2)
                f = value(pole, x)
                a, b = np.where(f < 0, x, a), np.where(f < 0, b, x)
            yield pd.DataFrame({"i": k, "pole": pole, "x": (a + b) / 2})

    got = spark.range(len(base)).select(F.col("id").alias("i")).mapInPandas(find, "i long, pole long, x double").toPandas().sort_values("i")
    return got["pole"].to_numpy(np.int64), got["x"].to_numpy(np.float64)


def rank_one_eigen(spark, d: Vector | list, z: Vector | list, rho: float, vectors: bool = True) -> Eigen:
    """Eigenvalues, ascending, and vectors of diag(d) + rho*z*z^T for any rho.

    Each root of the secular equation is a row with its own interval, found as an offset
    from a pole.  z is then replaced by the one whose roots these are exactly, so the
    vectors (z_k / (d_k - root)), each made in its own row, are orthogonal.
    """
    d, z, rho = _numbers(d), _numbers(z), float(rho)
    check_shared(len(d), 4)
    n, sign = len(d), 1.0
    if rho < 0:
        d, rho, sign = -d, -rho, -1.0
    p = _secular(d, z, rho)
    base = p.d[p.kept]
    pole, x = _offsets(spark, p) if len(base) else (np.zeros(0, np.int64), np.zeros(0))
    values = p.d.copy()
    values[p.kept] = base[pole] + x
    rank = np.argsort(sign * values, kind="stable")
    out = Vector(vector_of(spark, sign * values[rank]).df, n)
    if not vectors:
        return Eigen(out, None)
    own = np.full(n, -1)
    own[p.kept] = np.arange(len(base))

    def weights(batches):
        """zhat_j^2 = prod over roots of (root - d_j) / prod over other poles of (d_i - d_j)."""
        for frame in batches:
            j = frame["i"].to_numpy()
            up = np.abs(base[pole][None, :] - base[j][:, None] + x[None, :])
            down = np.abs(base[None, :] - base[j][:, None])
            down[np.arange(len(j)), j] = rho
            yield pd.DataFrame({"i": j, "v": np.exp(0.5 * (np.log(up) - np.log(down)).sum(axis=1))})

    zhat = np.zeros(0)
    if len(base):
        got = spark.range(len(base)).select(F.col("id").alias("i")).mapInPandas(weights, "i long, v double").toPandas().sort_values("i")
        zhat = np.copysign(got["v"].to_numpy(np.float64), p.z[p.kept])

    def columns(i, _):
        a = np.zeros((len(i), n))
        for r, place in enumerate(rank[i]):
            k = own[place]
            if k < 0:
                a[r, place] = 1.0
            else:
                v = zhat / (base - base[pole[k]] - x[k])
                a[r, p.kept] = v / np.linalg.norm(v)
        for q, k, c, s in reversed(p.turns):
            a[:, q], a[:, k] = c * a[:, q] + s * a[:, k], c * a[:, k] - s * a[:, q]
        back = np.empty_like(a)
        back[:, p.order] = a
        return back

    rows = map_rows(spark.range(n).select(F.col("id").alias("i"), F.array(F.lit(0.0)).alias("a")), 1, columns)
    v = from_rows(Rows(cut(rows, "vectors"), n, n)).T
    return Eigen(out, _turned(v, _signs(v)))


def secular_roots(spark, d: Vector | list, z: Vector | list, rho: float) -> DataFrame:
    """(i, v): the eigenvalues of diag(d) + rho*z*z^T, ascending: roots of
    1 + rho*sum(z^2/(d - x)), and those d that have none of their own."""
    return rank_one_eigen(spark, d, z, rho, vectors=False).values.df
