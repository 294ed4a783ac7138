"""Pivoted Cholesky, LDL and Bunch-Kaufman factorisations of one large symmetric matrix.

The matrix stays in row layout.  Its current diagonal is a vector; a pivot is chosen from
that and from the one or two rows it needs, which are fetched from the table (a few
likely ones at a time) and brought up to date by the panel's columns.  After a panel the
other rows are updated where they lie; rows that have become pivots are split off.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cut import cut, spent
from .factor import _reversed, relabel, solve_triangular
from .matrix import Matrix, ShapeError, Vector, identity, mirrored
from .products import mult
from .rows import SHARED_BYTES, Rows, arrays, block, check_shared, collect_small, from_rows, map_rows, to_rows

#: Most pivots of one panel; with many rows there are fewer, since a panel's columns are vectors.
PANEL = 128
#: Fixed value: the bound (1 + sqrt(17)) / 8 that keeps growth least.
BK = (1 + np.sqrt(17)) / 8


@dataclass(frozen=True)
class Pivoted:
    """P^T*A*P = L*D*L^T (uplo lower) or U*D*U^T (upper), row order[k] of A at place k.
    cholesky: D = I and only `rank` columns of L.  pivots: 1-based interchanges, a
    negative pair marks a block of two."""

    factor: Matrix
    d: Matrix
    inverse_d: Matrix | None
    order: list[int]
    rank: int
    uplo: str = "lower"
    unit: bool = True
    pivots: list[int] = field(default_factory=list)

    def moves(self) -> DataFrame:
        """(i, k): row i of A is at place k."""
        table = pa.table({"i": np.array(self.order, np.int64), "k": np.arange(len(self.order), dtype=np.int64)})
        return self.factor.df.sparkSession.createDataFrame(table)


class _Panel:
    """The rows of a symmetric matrix while its pivots are taken out."""

    def __init__(self, a: Matrix, panel: int):
        # Two columns of each pivot and three rows that are fetched for it, within SHARED_BYTES.
        self.n, self.panel = a.rows, max(1, min(panel, SHARED_BYTES // (8 * 6 * max(a.rows, 1))))
        check_shared(self.n, 2 * self.panel + 2)
        self.spark = a.df.sparkSession
        self.state = cut(to_rows(a).df.select("i", "a", F.array().cast("array<double>").alias("l")), "rows")
        self.alive = np.ones(self.n, bool)
        self.diag = np.zeros(self.n)
        for r in self.state.select("i", F.element_at("a", F.col("i").cast("int") + 1).alias("v")).toLocalIterator():
            self.diag[r["i"]] = r["v"]
        self.finished: list[DataFrame] = []
        self.order: list[int] = []
        self.width = 0  # columns of L before this panel
        self.blocks: list[np.ndarray] = []
        self._start()

    def _start(self) -> None:
        self.l, self.w = np.zeros((self.n, self.panel + 1)), np.zeros((self.n, self.panel + 1))
        self.c, self.held = 0, {}

    def row(self, p: int, likely) -> np.ndarray:
        """Row p as it is now, over the rows that are left; `likely` gives the rows to be
        fetched with it."""
        if p not in self.held:
            wanted = [p, *[int(q) for q in likely() if q != p and q not in self.held]][: self.panel]
            if len(self.held) + len(wanted) > 3 * self.panel:
                self.held = {}
            names, x = collect_small(self.state.where(F.col("i").isin(wanted)), self.n, len(wanted))
            self.held |= dict(zip(names.tolist(), x, strict=True))
        x = self.held[p] - self.l[:, : self.c] @ self.w[p, : self.c]
        x[~self.alive] = 0.0
        return x

    def take(self, pivots: list[int], low: np.ndarray, product: np.ndarray, block_: np.ndarray) -> None:
        """Makes `pivots` the next columns: low of L, product of L*D."""
        k = len(pivots)
        self.l[:, self.c : self.c + k], self.w[:, self.c : self.c + k] = low, product
        self.diag -= (low * product).sum(axis=1)
        self.alive[pivots] = False
        self.order += pivots
        self.blocks.append(block_)
        self.c += k
        if self.c >= self.panel:
            self.flush()

    def flush(self) -> None:
        """Updates all rows by the panel's columns and splits its pivots off."""
        if not self.c:
            return
        l, w, n, c = self.l[:, : self.c], self.w[:, : self.c], self.n, self.c  # noqa: E741

        def step(batches):
            for b in batches:
                if b.num_rows:
                    i, a = b.column("i").to_numpy(), block(b, "a", n)
                    held = b.column("l").flatten().to_numpy(zero_copy_only=False).reshape(len(i), -1)
                    yield pa.record_batch([b.column("i"), arrays(a - w[i] @ l.T), arrays(np.hstack((held, l[i])))], names=["i", "a", "l"])

        old, self.state = self.state, cut(self.state.mapInArrow(step, "i long, a array<double>, l array<double>"), "panel")
        spent(old)
        self.width += c
        done = self.order[self.width - c : self.width]
        self.finished.append(self.state.where(F.col("i").isin(done)).select("i", "l"))
        rest = self.state.where(~F.col("i").isin(done))
        self.state = cut(rest, "rest") if self.alive.any() else rest
        self._start()

    def factor(self) -> tuple[Matrix, list[int]]:
        """(L by place, order) with the rows that never were pivots at the end."""
        self.flush()
        order = self.order + [int(i) for i in np.flatnonzero(self.alive)]
        parts = self.state.select("i", "l")
        for part in self.finished:
            parts = parts.unionByName(part)
        place = np.empty(self.n, np.int64)
        place[order] = np.arange(self.n)

        def run(batches):
            for b in batches:
                if b.num_rows:
                    yield pa.record_batch([pa.array(place[b.column("i").to_numpy()]), b.column("l")], names=["i", "a"])

        placed = cut(parts.mapInArrow(run, "i long, a array<double>"), "factor")
        return from_rows(Rows(placed, self.n, self.n)).where(F.col("v") != 0), order


def _band(spark, n: int, blocks: list[np.ndarray], inverse: bool) -> Matrix | None:
    """The block diagonal matrix, or its inverse (None if it has none)."""
    rows, cols, values, at = [], [], [], 0
    for b in blocks:
        if inverse:
            if abs(np.linalg.det(b / (np.abs(b).max() or 1))) == 0:
                return None
            b = np.linalg.inv(b)
        for p in range(len(b)):
            for q in range(len(b)):
                rows.append(at + p), cols.append(at + q), values.append(float(b[p, q]))
        at += len(b)
    table = pa.table({"i": pa.array(rows, pa.int64()), "j": pa.array(cols, pa.int64()), "v": pa.array(values, pa.float64())})
    return Matrix(spark.createDataFrame(table), n, n)


def _square(a: Matrix) -> None:
    if a.rows != a.cols:
        raise ShapeError((a.rows, a.cols))


def cholesky(a: Matrix, uplo: str = "lower", stop: float | None = None, panel: int = PANEL) -> Pivoted:
    """Largest diagonal first; it ends when what is left of the diagonal is not above
    `stop` (n * 2^-53 * the largest)."""
    _square(a)
    work = _Panel(mirrored(a, uplo), panel)
    n, rank = a.rows, 0
    limit = n * 2.0**-53 * work.diag.max(initial=0.0) if stop is None else stop
    while work.alive.any():
        now = np.where(work.alive, work.diag, -np.inf)
        p = int(now.argmax())
        if now[p] <= limit:
            break
        x = work.row(p, lambda now=now: np.argsort(-now, kind="stable")[: panel])
        low = (x / np.sqrt(x[p]))[:, None]
        work.take([p], low, low, np.ones((1, 1)))
        rank += 1
    factor, order = work.factor()
    eye = identity(work.spark, n)
    return Pivoted(factor, eye, eye if rank == n else None, order, rank, unit=False)


def ldl(a: Matrix, uplo: str = "lower", panel: int = PANEL) -> Pivoted:
    """Largest |diagonal| first; columns whose pivot is 0 stay unit vectors."""
    _square(a)
    work = _Panel(mirrored(a, uplo), panel)
    while work.alive.any():
        now = np.where(work.alive, np.abs(work.diag), -np.inf)
        p = int(now.argmax())
        x = work.row(p, lambda now=now: np.argsort(-now, kind="stable")[: panel])
        low = x / x[p] if x[p] else np.zeros(a.rows)
        low[p] = 1.0
        work.take([p], low[:, None], (low * x[p])[:, None], x[p].reshape(1, 1))
    factor, order = work.factor()
    return Pivoted(factor, _band(work.spark, a.rows, work.blocks, False), _band(work.spark, a.rows, work.blocks, True), order, a.rows)


def bunch_kaufman(a: Matrix, uplo: str = "lower", panel: int = PANEL) -> Pivoted:
    """Of an indefinite matrix, with blocks of one and two.  The upper form is the lower one
    of the matrix read backwards."""
    _square(a)
    n = a.rows
    if uplo == "upper":
        f = bunch_kaufman(_reversed(mirrored(a, "upper")), "lower", panel)
        back = lambda m: m and _reversed(m)
        order = [n - 1 - i for i in reversed(f.order)]
        pivots = [np.sign(p) * (n + 1 - abs(p)) for p in reversed(f.pivots)]
        return Pivoted(_reversed(f.factor), _reversed(f.d), back(f.inverse_d), order, n, "upper", pivots=[int(p) for p in pivots])
    work = _Panel(mirrored(a, "lower"), panel)
    at, where, pivots = np.arange(n), np.arange(n), []  # index by place, place by index

    def exchange(k: int, q: int) -> None:
        at[[k, q]] = at[[q, k]]
        where[at[[k, q]]] = [k, q]

    k = 0
    while k < n:
        p = int(at[k])
        likely = lambda k=k: at[k : k + panel]
        x = work.row(p, likely)
        off = np.where(work.alive, np.abs(x), -1.0)
        off[p] = -1.0
        rest = at[k + 1 :]
        r = int(rest[off[rest].argmax()]) if len(rest) else p
        high, width = off[r] if len(rest) else 0.0, 1
        if high > 0 and abs(x[p]) < BK * high:
            y = work.row(r, likely)
            sigma = np.where(np.arange(n) == r, -1.0, np.abs(y)).max()
            if abs(x[p]) * sigma < BK * high * high:
                if abs(y[r]) >= BK * sigma:
                    p, x = r, y
                else:
                    width = 2
        if width == 1:
            pivots.append(int(where[p]) + 1)
            exchange(k, int(where[p]))
            low = x / x[p] if x[p] else np.zeros(n)
            low[p] = 1.0
            work.take([p], low[:, None], (low * x[p])[:, None], x[p].reshape(1, 1))
        else:
            pivots += [-(int(where[r]) + 1)] * 2
            exchange(k + 1, int(where[r]))
            corner = np.array([[x[p], x[r]], [x[r], y[r]]])
            both = np.stack((x, y), axis=1)
            low = np.linalg.solve(corner, both.T).T
            low[[p, r]] = np.eye(2)
            work.take([p, r], low, both, corner)
        k += width
    factor, order = work.factor()
    return Pivoted(factor, _band(work.spark, n, work.blocks, False), _band(work.spark, n, work.blocks, True), order, n, pivots=pivots)


def rebuilt(f: Pivoted) -> Matrix:
    """A again from its factors."""
    n = f.factor.rows
    whole = mult(1.0, mult(1.0, f.factor, f.d), f.factor, trans_b=True)
    moves = f.moves()
    return Matrix(relabel(relabel(whole, moves, inverse=True).T, moves, inverse=True).T.df, n, n)


def solve(f: Pivoted, b: Matrix) -> Matrix:
    """X with A*X = B; ArithmeticError if A is singular."""
    if f.inverse_d is None:
        raise ArithmeticError("the matrix is singular")
    moves = f.moves()
    y = solve_triangular(f.factor, relabel(b, moves), uplo=f.uplo, unit=f.unit)
    y = mult(1.0, f.inverse_d, y) if f.unit else y
    return relabel(solve_triangular(f.factor, y, uplo=f.uplo, trans=True, unit=f.unit), moves, inverse=True)


def inverse(f: Pivoted) -> Matrix:
    return solve(f, identity(f.factor.df.sparkSession, f.factor.rows))


def cholesky_update(factor: Matrix, x: Vector, uplo: str = "lower", sign: float = 1.0, panel: int = PANEL) -> Matrix:
    """The factor of L*L^T + sign*x*x^T (or of U^T*U + sign*x*x^T), sign 1 or -1, by
    rotations: a panel's own rows give them, all later rows are turned where they lie.
    ArithmeticError if what is left is not positive definite."""
    if uplo == "upper":
        return cholesky_update(factor.T, x, "lower", sign, panel).T
    n = factor.rows
    check_shared(panel, n + 1)
    beside = factor.df.where("i >= j").unionByName(x.df.select("i", F.lit(n).cast("long").alias("j"), "v"))
    state = cut(to_rows(Matrix(beside, n, n + 1)).df, "rows")
    done = None
    for left in range(0, n, panel):
        right = min(left + panel, n)
        _, own = collect_small(state.where(F.col("i").between(left, right - 1)), n + 1, right - left)
        turns = []
        for k in range(left, right):
            row = own[k - left]
            square = row[k] ** 2 + sign * row[n] ** 2
            if square <= 0 or row[k] == 0:
                raise ArithmeticError("the matrix is not positive definite")
            c, s = np.sqrt(square) / row[k], row[n] / row[k]
            turns.append((k, c, s))
            _turn(own[k - left :], turns[-1:], sign, n)
        part = map_rows(state.where(F.col("i").between(left, right - 1)), n + 1, lambda i, _, own=own, left=left: own[i - left])
        done = part if done is None else done.unionByName(part)

        def step(_, a, turns=tuple(turns)):
            a = a.copy()
            _turn(a, turns, sign, n)
            return a

        if right < n:
            state = cut(map_rows(state.where(F.col("i") >= right), n + 1, step), "panel")
    whole = from_rows(Rows(cut(done, "factor"), n, n + 1))
    return Matrix(whole.df.where("j <= i"), n, n)


def _turn(a: np.ndarray, turns, sign: float, n: int) -> None:
    for k, c, s in turns:
        a[:, k] = (a[:, k] + sign * s * a[:, n]) / c
        a[:, n] = c * a[:, n] - s * a[:, k]
