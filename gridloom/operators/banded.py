"""Tri- and bidiagonal forms by way of a band.

First the matrix is brought to a band: a panel of `width` columns (and rows) is factored
by QR at once, so the rows of the matrix are read twice and written once a panel, not a
column, and every product with them is one of matrices.  What is done is dropped, so the
rows get shorter.  The panel (both sides n and `width`, checked) is what every task gets.

Then the band, which has n * width numbers, is chased down to two diagonals: a sweep zeroes
one column of the band and pushes the bulge that this makes off its end.  Each sweep needs
the one before it, so this is one task; it holds the band and writes its reflectors as
it goes.  Reflectors of `width` sweeps that lie in the same place are joined to one block.

The orthogonal factors are rows of the identity, turned where they lie by as many blocks as
may be sent to every task at once, and written.  No n x n array is on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import as_strided
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cut import cut, spent
from . import qr_tree
from .matrix import Matrix
from .rows import SHARED_BYTES, Rows, block, check_shared, from_rows, levels, map_rows

#: Widest band, and the narrowest one that is made to fit a long panel.
WIDEST, NARROWEST = 64, 8
_BOTH, _RIGHT, _END = 0, 1, 2


def width_of(n: int) -> int:
    """Columns of a panel: as many as six panels of SHARED_BYTES allow, and four panels at least."""
    return max(2, min(WIDEST, n // 4, max(NARROWEST, SHARED_BYTES // (48 * max(n, 1)))))


def reflector(x: np.ndarray) -> tuple[np.ndarray, float, float]:
    """(v, tau, beta) with (I - tau*v*v^T)*x = (beta, 0, ...) and v[0] = 1."""
    top = np.abs(x).max(initial=0.0)
    rest = top * np.linalg.norm(x[1:] / top) if top else 0.0
    if rest == 0:
        return np.eye(1, len(x))[0], 0.0, float(x[0])
    beta = -np.copysign(np.hypot(x[0], rest), x[0])
    v = x / (x[0] - beta)
    v[0] = 1.0
    return v, float((beta - x[0]) / beta), float(beta)


def compact(v: np.ndarray, taus: np.ndarray) -> np.ndarray:
    """T with H1*H2*... = I - V*T*V^T."""
    return np.linalg.solve(np.eye(len(taus)) + taus[:, None] * np.triu(v.T @ v, 1), np.diag(taus)) if len(taus) else np.zeros((0, 0))


def times(state: DataFrame, n: int, x: np.ndarray, rows: int) -> np.ndarray:
    """A*X for a narrow X: rows x k, zero where `state` has no row."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                y = block(b, "a", n) @ x
                yield pa.record_batch([b.column("i"), *(pa.array(np.ascontiguousarray(y[:, c])) for c in range(y.shape[1]))], names=["i", *(f"y{c}" for c in range(y.shape[1]))])

    got = state.select("i", "a").mapInArrow(run, "i long, " + ", ".join(f"y{c} double" for c in range(x.shape[1]))).toArrow()
    out = np.zeros((rows, x.shape[1]))
    for c in range(x.shape[1]):
        out[got["i"].to_numpy(), c] = got[f"y{c}"].to_numpy()
    return out


def weighted(state: DataFrame, n: int, w: np.ndarray, change=None) -> np.ndarray:
    """W^T*A for a narrow W: k x n, summed in tasks and over a tree.  change(i, a), if
    given, is done to the rows first."""
    k = w.shape[1]
    check_shared(k, n)

    def local(batches):
        total = np.zeros((k, n))
        for b in batches:
            if b.num_rows:
                i, a = b.column("i").to_numpy(), block(b, "a", n)
                total += w[i].T @ (change(i, a) if change else a)
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["m"])

    def join(batches):
        total = np.zeros((k, n))
        for b in batches:
            for m in b.column("m").to_pylist():
                total += np.frombuffer(m).reshape(k, n)
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["m"])

    parts = state.select("i", "a").mapInArrow(local, "m binary")
    for count in levels(state, 8) if int(state.sparkSession.conf.get("spark.sql.shuffle.partitions")) > 8 else []:
        parts = parts.repartition(count).mapInArrow(join, "m binary")
    return sum((np.frombuffer(r["m"]).reshape(k, n) for r in parts.collect()), np.zeros((k, n)))


class Turned:
    """The identity times one block reflector after another, from the right, as a table of
    rows.  Blocks wait until they fill what may be sent to every task."""

    def __init__(self, spark, n: int, most: int = SHARED_BYTES):
        self.spark, self.n, self.most = spark, n, most
        self.state, self.group, self.held = None, [], 0

    def add(self, low: int, v: np.ndarray, t: np.ndarray) -> None:
        """Q * (I - V*T*V^T) with V in rows [low, low + len(v))."""
        if self.group and self.held + v.nbytes + t.nbytes > self.most:
            self._flush()
        self.group.append((low, v, t))
        self.held += v.nbytes + t.nbytes

    def _flush(self) -> None:
        n, group, first, old = self.n, self.group, self.state is None, self.state

        def f(i, a):
            if first:
                a = np.zeros((len(i), n))
                a[np.arange(len(i)), i] = 1.0
            for low, v, t in group:
                x = a[:, low : low + len(v)]
                x -= ((x @ v) @ t) @ v.T
            return a

        start = self.spark.range(n).select(F.col("id").alias("i"), F.array(F.lit(0.0)).alias("a")) if first else old
        self.state = cut(map_rows(start, 1 if first else n, f), "q")
        if not first:
            spent(old)
        self.group, self.held = [], 0

    def matrix(self) -> Matrix:
        if self.group or self.state is None:
            self._flush()
        return from_rows(Rows(self.state, self.n, self.n))


def _panel(rows: DataFrame, n: int) -> np.ndarray:
    """At most a panel's rows of n numbers, in order of i; one job (a limit would take several)."""
    got = rows.toArrow().sort_by("i")
    return got["a"].combine_chunks().flatten().to_numpy().reshape(len(got), n)


def symmetric_band(a: Rows, width: int, q: Turned | None) -> np.ndarray:
    """Lower band of Q^T*A*Q for a symmetric A with all its cells: element [j, k] is that at
    (j + k, j).  q, if given, is multiplied by Q.  Three jobs a panel."""
    n = a.rows
    check_shared(n, 6 * width)
    band, state = np.zeros((n, width + 1)), cut(a.df.select("i", "a"), "rows")

    def keep(left: int, x: np.ndarray) -> None:
        """x: cells (left + r, left + c) of finished columns."""
        r, c = np.nonzero(np.tri(*x.shape, dtype=bool))
        near = r - c <= width
        band[left + c[near], (r - c)[near]] = x[r[near], c[near]]

    for left in range(0, n, width):
        right = left + width
        top = _panel(state.where(F.col("i") < right), n - left)
        if n - right < 2:
            # What is left is no wider than the band.
            keep(left, np.concatenate((top, _panel(state.where(F.col("i") >= right), n - left))))
            break
        own, tau, r = qr_tree.compact(top[:, width:].T)
        t = compact(own, tau)
        keep(left, np.concatenate((top[:, :width], r)))
        v = np.zeros((n, len(tau)))
        v[right:] = own
        y = times(state.where(F.col("i") >= right), n - left, v[left:], n)
        x = y @ t - 0.5 * v @ (t.T @ (v.T @ y) @ t)
        old = state

        def change(i, rows, v=v, x=x, right=right):
            return rows[:, width:] - x[i] @ v[right:].T - v[i] @ x[right:].T

        state = cut(map_rows(state.where(F.col("i") >= right), n - left, change), "panel")
        spent(old)
        if q:
            q.add(right, own, t)
    spent(state)
    return band


def upper_band(a: Rows, width: int, q: Turned, p: Turned) -> np.ndarray:
    """Upper band of Q^T*A*P for a square A: element [i, k] is that at (i, i + k).  q and p
    are multiplied by Q and P.  Three jobs a panel."""
    n = a.rows
    check_shared(n, 6 * width)
    band, state = np.zeros((n, width + 1)), cut(a.df.select("i", "a"), "rows")
    for left in range(0, n, width):
        right = min(left + width, n)
        k = right - left
        columns = times(state, n - left, np.eye(n - left, k), n)[left:]
        own, tau, r = qr_tree.compact(columns)
        t = compact(own, tau)
        q.add(left, own, t)
        for c in range(k):
            band[left : left + c + 1, :][np.arange(c + 1), c - np.arange(c + 1)] = r[: c + 1, c]
        if right == n:
            break
        # V^T*A and the panel's own rows, in one pass.
        v = np.zeros((n, 2 * k))
        v[left:, :k] = own
        v[np.arange(left, right), k + np.arange(k)] = 1.0
        both = weighted(state, n - left, v)
        z = (t.T @ both[:k])[:, k:]
        rows = both[k:, k:] - own[:k] @ z
        u, tau_u, r_u = qr_tree.compact(rows.T)
        t_u = compact(u, tau_u)
        p.add(right, u, t_u)
        for c in range(k):
            far = min(c + 1, len(r_u))
            band[left + c, k - c : k - c + far] = r_u[:far, c]
        old, v = state, np.ascontiguousarray(v[:, :k])

        def change(i, x, v=v, z=z, u=u, t_u=t_u, k=k):
            x = x[:, k:] - v[i] @ z
            return x - ((x @ u) @ t_u) @ u.T

        state = cut(map_rows(state.where(F.col("i") >= right), n - left, change), "panel")
        spent(old)
    spent(state)
    return band


def _sweep_symmetric(view, b: int, n: int, s: int) -> Iterator[tuple[int, np.ndarray, float]]:
    """Zeroes column s of the band below its subdiagonal and chases the bulge; yields the
    reflectors (kind, v, tau), one for each `b` rows."""
    below = np.tri(b, dtype=bool)
    x = view(s + 1, s, b, 1)[:, 0]
    v, tau, beta = reflector(x.copy())
    x[:] = 0.0
    x[0] = beta
    for r in range(s + 1, n - 1, b):
        yield _BOTH, v, tau
        under = view(r + b, r, b, b)
        if tau:
            diagonal = view(r, r, b, b)
            y = tau * (np.where(below, diagonal, diagonal.T) @ v)
            y -= (tau / 2 * (y @ v)) * v
            diagonal -= v[:, None] * y + y[:, None] * v
            under -= (tau * (under @ v))[:, None] * v
        v, tau, beta = reflector(under[:, 0].copy())
        if tau:
            under[:, 0] = 0.0
            under[0, 0] = beta
            under[:, 1:] -= (tau * v)[:, None] * (v @ under[:, 1:])


def _sweep_upper(view, b: int, n: int, s: int) -> Iterator[tuple[int, np.ndarray, float]]:
    """The same for row s of an upper band: a reflector of columns, then one of rows."""
    x = view(s, s + 1, 1, b)[0]
    u, tau, beta = reflector(x.copy())
    x[:] = 0.0
    x[0] = beta
    for r in range(s + 1, n - 1, b):
        yield _RIGHT, u, tau
        diagonal, beside = view(r, r, b, b), view(r, r + b, b, b)
        if tau:
            diagonal -= (tau * (diagonal @ u))[:, None] * u
        v, tau, beta = reflector(diagonal[:, 0].copy())
        yield _BOTH, v, tau
        if tau:
            diagonal[:, 0] = 0.0
            diagonal[0, 0] = beta
            diagonal[:, 1:] -= (tau * v)[:, None] * (v @ diagonal[:, 1:])
            beside -= (tau * v)[:, None] * (v @ beside)
        u, tau, beta = reflector(beside[0].copy())
        if tau:
            beside[0] = 0.0
            beside[0, 0] = beta
            beside[1:] -= (tau * (beside[1:] @ u))[:, None] * u


def _chase(band: np.ndarray, symmetric: bool, emit: bool, most: int) -> Iterator[tuple]:
    """Rows (kind, g, at, low, v, t) of block reflectors, at numbering them in the order in which they
    are applied; then the two diagonals, low being the number of g's.  All of one g have at most `most` bytes."""
    n, b = len(band), band.shape[1] - 1
    # Row i holds its cells from column i - 2b (i - b if upper) on, 3b of them; rows behind n are zero.
    before, long = (2 * b if symmetric else b), 3 * b
    flat = np.zeros((n + 3 * b) * long)
    held = flat.reshape(-1, long)
    for k in range(b + 1):
        if symmetric:
            held[k : n, before - k] = band[: n - k, k] if k < n else 0.0
        else:
            held[:n, before + k] = band[:, k]

    def view(i: int, j: int, h: int, w: int) -> np.ndarray:
        return as_strided(flat[i * (long - 1) + j + before :], (h, w), ((long - 1) * 8, 8))

    sweep, kinds = (_sweep_symmetric, (_BOTH,)) if symmetric else (_sweep_upper, (_BOTH, _RIGHT))
    g, at, size = 0, 0, 0
    for start in range(0, n - 2, b):
        count, places = min(b, n - 2 - start), -(-(n - 2 - start) // b)
        v, tau = ({kind: np.zeros((places, *shape)) for kind in kinds} for shape in ((b, b), (b,)))
        for c in range(count):
            seen = dict.fromkeys(kinds, 0)
            for kind, own, scale in sweep(view, b, n, start + c):
                v[kind][seen[kind], c], tau[kind][seen[kind], c] = own, scale
                seen[kind] += 1
        # A reflector meets those of later sweeps in its own place and in the one before: last places first.
        for kind in kinds if emit else ():
            for place in reversed(range(places)):
                if not tau[kind][place].any():
                    continue
                low = start + 1 + place * b
                x = np.zeros((b + count - 1, count))
                for c in range(count):
                    x[c : c + b, c] = v[kind][place, c]
                x = x[: n - low]
                t = compact(x, tau[kind][place, :count])
                if size and size + x.nbytes + t.nbytes > most:
                    g, size = g + 1, 0
                size += x.nbytes + t.nbytes
                yield kind, g, at, low, x.tobytes(), t.tobytes()
                at += 1
    e = held[1:n, before - 1] if symmetric else held[: max(n - 1, 0), before + 1]
    yield _END, -1, at, g + 1, held[:n, before].tobytes(), e.tobytes()


def chased(spark, band: np.ndarray, symmetric: bool, q: Turned | None, p: Turned | None = None, most: int = SHARED_BYTES // 4) -> tuple[np.ndarray, np.ndarray]:
    """(d, e) of the band's tri- or bidiagonal form; q and p are multiplied by what was done."""
    check_shared(len(band), 3 * band.shape[1])
    emit = q is not None

    def run(_):
        for kind, *numbers, v, t in _chase(band, symmetric, emit, most):
            yield pa.record_batch([pa.array([kind], pa.int32()), *(pa.array([x]) for x in numbers), pa.array([v], pa.binary()), pa.array([t], pa.binary())], names=["kind", "g", "at", "low", "v", "t"])

    done = cut(spark.range(1).coalesce(1).mapInArrow(run, "kind int, g long, at long, low long, v binary, t binary"), "chase")
    (end,) = done.where(F.col("kind") == _END).collect()
    for g in range(end["low"] if emit else 0):
        for row in sorted(done.where(F.col("g") == g).select("at", "kind", "low", "v", "t").collect()):
            t = np.frombuffer(row["t"])
            k = round(len(t) ** 0.5)
            (q if row["kind"] == _BOTH else p).add(row["low"], np.frombuffer(row["v"]).reshape(-1, k), t.reshape(k, k))
    spent(done)
    return np.frombuffer(end["v"]), np.frombuffer(end["t"])
