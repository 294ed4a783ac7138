"""Decompositions of many small matrices: one group per matrix.

`cells` is (key, i, j, v): a table of matrices that all have the given sizes.  Sides
are at most SIDE, so a group is bounded; the work scales with the number of keys.
One large matrix is for `condensed`, `pivoted` and `spectral`.  Each operator returns long rows (key, part, i, j, v), part naming the factor.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .matrix import Matrix, ShapeError

SIDE = 2048
SCHEMA = "key long, part string, i long, j long, v double"


def keyed(a: Matrix, key: int = 0) -> DataFrame:
    """One matrix as a table of matrices."""
    return a.df.select(F.lit(key).cast("long").alias("key"), "i", "j", "v")


def part(result: DataFrame, name: str, rows: int, cols: int, key: int = 0) -> Matrix:
    """One factor of one matrix."""
    return Matrix(result.where((F.col("key") == key) & (F.col("part") == name)).select("i", "j", "v"), rows, cols)


def each(cells: DataFrame, rows: int, cols: int, kernel: Callable[[np.ndarray], dict[str, np.ndarray]]) -> DataFrame:
    """kernel(matrix) -> {part: array of one or two dimensions}, for every key."""
    if max(rows, cols) > SIDE:
        raise ShapeError(f"{rows} x {cols} is larger than {SIDE}")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros((rows, cols))
        np.add.at(x, (frame["i"].to_numpy(), frame["j"].to_numpy()), frame["v"].to_numpy())
        out = []
        for name, value in kernel(x).items():
            value = np.asarray(value, np.float64)
            value = value[:, None] if value.ndim == 1 else value
            n, m = value.shape
            out.append(pd.DataFrame({"key": frame["key"].iloc[0], "part": name, "i": np.repeat(np.arange(n), m), "j": np.tile(np.arange(m), n), "v": value.ravel()}))
        return pd.concat(out)

    return cells.select("key", "i", "j", "v").groupBy("key").applyInPandas(run, SCHEMA)


def _house(x: np.ndarray) -> tuple[np.ndarray, float]:
    """(v, tau) with (I - tau*v*v^T)*x = (+-|x|, 0, ...), v[0] = 1."""
    alpha, rest = x[0], np.linalg.norm(x[1:])
    if rest == 0:
        return np.eye(len(x))[0], 0.0
    beta = -np.copysign(np.hypot(alpha, rest), alpha)
    v = x / (alpha - beta)
    v[0] = 1.0
    return v, (beta - alpha) / beta


def _reflect(a: np.ndarray, v: np.ndarray, tau: float) -> None:
    a -= tau * np.outer(v, v @ a)


def hessenberg(a: np.ndarray) -> dict[str, np.ndarray]:
    """A = Q*H*Q^T with H zero below the subdiagonal; of a symmetric A, H is tridiagonal."""
    h, q = a.copy(), np.eye(len(a))
    for k in range(len(a) - 2):
        v, tau = _house(h[k + 1 :, k])
        _reflect(h[k + 1 :], v, tau)
        _reflect(h[:, k + 1 :].T, v, tau)
        _reflect(q[:, k + 1 :].T, v, tau)
        h[k + 2 :, k] = 0.0
    return {"h": h, "q": q}


def tridiagonal(a: np.ndarray, uplo: str = "lower") -> dict[str, np.ndarray]:
    """A = Q*T*Q^T of a symmetric A from one triangle: diagonal d, off-diagonal e, and q."""
    half = np.tril(a) if uplo == "lower" else np.triu(a).T
    full = half + np.tril(half, -1).T
    made = hessenberg(full)
    return {"d": np.diag(made["h"]).copy(), "e": np.diag(made["h"], -1).copy(), "q": made["q"]}


def bidiagonal(a: np.ndarray) -> dict[str, np.ndarray]:
    """A = Q*B*P^T: B upper bidiagonal if rows >= cols, else lower; d, e, q, p."""
    if a.shape[0] < a.shape[1]:
        made = bidiagonal(a.T)
        return {"d": made["d"], "e": made["e"], "q": made["p"], "p": made["q"]}
    b, q, p = a.copy(), np.eye(a.shape[0]), np.eye(a.shape[1])
    n = a.shape[1]
    for k in range(n):
        v, tau = _house(b[k:, k])
        _reflect(b[k:, k:], v, tau)
        _reflect(q[:, k:].T, v, tau)
        if k < n - 2:
            v, tau = _house(b[k, k + 1 :])
            _reflect(b[k:, k + 1 :].T, v, tau)
            _reflect(p[:, k + 1 :].T, v, tau)
    return {"d": np.diag(b).copy(), "e": np.diag(b, 1)[: max(n - 1, 0)].copy(), "q": q, "p": p}


def band(d: np.ndarray, e: np.ndarray, symmetric: bool) -> np.ndarray:
    out = np.diag(d)
    k = np.arange(len(e))
    out[k, k + 1] = e
    if symmetric:
        out[k + 1, k] = e
    return out


def tridiagonal_eigen(x: np.ndarray) -> dict[str, np.ndarray]:
    """Of a tridiagonal matrix: values ascending and vectors."""
    values, vectors = np.linalg.eigh(x)
    return {"values": values, "vectors": vectors}


def bidiagonal_svd(x: np.ndarray) -> dict[str, np.ndarray]:
    """Of a bidiagonal matrix: u, s descending and the rows vt."""
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    return {"u": u, "s": s, "vt": vt}


def dqds(x: np.ndarray) -> dict[str, np.ndarray]:
    """Singular values of an upper bidiagonal matrix, descending, by the differential
    quotient-difference iteration; subtraction-free when the shift is 0."""
    q, e = np.diag(x) ** 2, np.append(np.diag(x, 1) ** 2, 0.0)
    q, e, shift, out = q.copy(), e.copy(), 0.0, []
    n = len(q)
    while n:
        for _ in range(100 * n + 400):
            if n == 1 or e[n - 2] <= 2.0**-106 * (q[n - 1] + shift) or e[n - 2] < 1e-300:
                break
            s = 0.0
            # A shift just below the smallest value of the trailing 2 x 2 part speeds it up.
            a, b, c = q[n - 2] + e[n - 2], q[n - 1], e[n - 2] * q[n - 1]
            low = (a + b) / 2 - np.hypot((a - b) / 2, np.sqrt(c))
            for s in (max(0.0, 0.999 * low), 0.25 * max(0.0, low), 0.0):
                nq, ne, d, fine = q[:n].copy(), e[:n].copy(), q[0] - s, True
                for k in range(n - 1):
                    nq[k] = d + e[k]
                    ratio = q[k + 1] / nq[k] if nq[k] > 0 else 0.0
                    ne[k] = e[k] * ratio
                    d = d * ratio - s
                    fine &= d >= 0 and nq[k] >= 0
                nq[n - 1] = d
                if fine or s == 0.0:
                    break
            q[:n], e[: n - 1], shift = np.maximum(nq, 0.0), ne[: n - 1], shift + s
        else:
            raise ArithmeticError("a singular value did not converge")
        out.append(np.sqrt(max(q[n - 1] + shift, 0.0)))
        n -= 1
    return {"s": np.sort(np.array(out))[::-1]}


def cholesky_pivoted(a: np.ndarray, stop: float | None = None) -> dict[str, np.ndarray]:
    """P^T*A*P = L*L^T with the largest diagonal first; l, order and rank.  It stops when
    the rest of the diagonal is below stop (n * 2^-53 * largest diagonal)."""
    x, n = np.tril(a) + np.tril(a, -1).T, len(a)
    order, rank = np.arange(n), 0
    limit = n * 2.0**-53 * np.diag(x).max(initial=0.0) if stop is None else stop
    for k in range(n):
        p = k + int(np.argmax(np.diag(x)[k:]))
        if x[p, p] <= limit:
            break
        x[[k, p]], order[[k, p]] = x[[p, k]], order[[p, k]]
        x[:, [k, p]] = x[:, [p, k]]
        x[k, k] = np.sqrt(x[k, k])
        x[k + 1 :, k] /= x[k, k]
        x[k, k + 1 :] = 0.0
        x[k + 1 :, k + 1 :] -= np.outer(x[k + 1 :, k], x[k + 1 :, k])
        rank += 1
    l = np.tril(x)  # noqa: E741
    l[:, rank:] = 0.0
    return {"l": l, "order": order, "rank": np.array([rank])}


def ldl_pivoted(a: np.ndarray) -> dict[str, np.ndarray]:
    """P^T*A*P = L*D*L^T with the largest |diagonal| first; l, d and order."""
    x, n = np.tril(a) + np.tril(a, -1).T, len(a)
    order, l = np.arange(n), np.eye(n)  # noqa: E741
    for k in range(n):
        p = k + int(np.argmax(np.abs(np.diag(x)[k:])))
        x[[k, p]], order[[k, p]] = x[[p, k]], order[[p, k]]
        x[:, [k, p]] = x[:, [p, k]]
        l[[k, p], :k] = l[[p, k], :k]
        if x[k, k] != 0:
            l[k + 1 :, k] = x[k + 1 :, k] / x[k, k]
            x[k + 1 :, k + 1 :] -= np.outer(l[k + 1 :, k], x[k, k + 1 :])
    return {"l": l, "d": np.diag(x).copy(), "order": order}


#: Fixed value: the bound (1 + sqrt(17)) / 8 that keeps growth least.
BK = (1 + np.sqrt(17)) / 8


def bunch_kaufman(a: np.ndarray) -> dict[str, np.ndarray]:
    """P^T*A*P = L*D*L^T of an indefinite A, D with blocks of one and two; l, d, order,
    and pivots: 1-based, a negative pair marks a block of two."""
    x, n = np.tril(a) + np.tril(a, -1).T, len(a)
    order, l, d, pivots = np.arange(n), np.eye(n), np.zeros((n, n)), np.zeros(n)  # noqa: E741

    def exchange(p, q):
        x[[p, q]], order[[p, q]] = x[[q, p]], order[[q, p]]
        x[:, [p, q]] = x[:, [q, p]]
        l[[p, q], :k] = l[[q, p], :k]

    k = 0
    while k < n:
        width, p = 1, k
        if k < n - 1:
            r = k + 1 + int(np.argmax(np.abs(x[k + 1 :, k])))
            high = abs(x[r, k])
            if high > 0 and abs(x[k, k]) < BK * high:
                others = np.abs(np.delete(x[k:, r], r - k))
                sigma = others.max()
                if abs(x[k, k]) * sigma < BK * high * high:
                    p = r
                    width = 1 if abs(x[r, r]) >= BK * sigma else 2
        if p != k + width - 1:
            exchange(k + width - 1, p)
        pivots[k : k + width] = (p + 1) if width == 1 else -(p + 1)
        block = x[k : k + width, k : k + width].copy()
        d[k : k + width, k : k + width] = block
        low = x[k + width :, k : k + width]
        if np.abs(block).max() > 0:
            w = np.linalg.solve(block, low.T).T
            l[k + width :, k : k + width] = w
            x[k + width :, k + width :] -= w @ low.T
        k += width
    return {"l": l, "d": d, "order": order, "pivots": pivots}


def cholesky_update(l: np.ndarray, x: np.ndarray) -> np.ndarray:  # noqa: E741
    """The Cholesky factor of L*L^T + x*x^T by a row of rotations."""
    l, x = l.copy(), x.copy()  # noqa: E741
    for k in range(len(l)):
        r = np.hypot(l[k, k], x[k])
        c, s = r / l[k, k], x[k] / l[k, k]
        l[k, k] = r
        l[k + 1 :, k] = (l[k + 1 :, k] + s * x[k + 1 :]) / c
        x[k + 1 :] = c * x[k + 1 :] - s * l[k + 1 :, k]
    return l


def rank_one_eigen(d: np.ndarray, z: np.ndarray, rho: float) -> dict[str, np.ndarray]:
    """Values and vectors of diag(d) + rho*z*z^T (see spectral.secular_roots for one row a root)."""
    values, vectors = np.linalg.eigh(np.diag(d) + rho * np.outer(z, z))
    return {"values": values, "vectors": vectors}


def solve_pivoted(factors: dict[str, np.ndarray], b: np.ndarray) -> np.ndarray:
    """X with A*X = B from l, order and d (or none: Cholesky) of one of the above."""
    order = factors["order"].astype(int)
    y = np.linalg.solve(factors["l"], b[order])
    d = factors.get("d")
    if d is not None:
        y = y / d[:, None] if d.ndim == 1 else np.linalg.solve(d, y)
    y = np.linalg.solve(factors["l"].T, y)
    out = np.empty_like(y)
    out[order] = y
    return out


#: Factorisations of `solve` by name.
SOLVERS = {"cholesky": cholesky_pivoted, "ldl": ldl_pivoted, "bunch_kaufman": bunch_kaufman}


def solve(cells: DataFrame, n: int, width: int, how: str) -> DataFrame:
    """x of A*X = B for every key; cells hold [A | B], n x (n + width)."""
    kernel = SOLVERS[how]
    return each(cells, n, n + width, lambda x: {"x": solve_pivoted(kernel(x[:, :n]), x[:, n:])})


def inverse(cells: DataFrame, n: int, how: str) -> DataFrame:
    """inverse for every key."""
    kernel = SOLVERS[how]
    return each(cells, n, n, lambda x: {"inverse": solve_pivoted(kernel(x), np.eye(n))})
