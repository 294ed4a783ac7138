"""QR of matrices with both sides long, by trees of reflectors.

A panel of columns is factored block by block: the reflectors of a block of rows bring
its part of the panel to a triangle, which stays in the block's top rows.  The tops of
many blocks meet at a node, are factored again, and so on up to a root, whose top holds
the panel's rows of R.  All reflectors are applied to the columns behind the panel where
the rows lie; only tops move.  The rows of a node that are not its top become a block of
their own for the next panel.

Q is applied by the same trees backwards.  It is orthonormal whatever the rank is, since
it is a product of reflectors, never A*R^-1.  Neither R nor Q is on the driver; a task holds a
block, or the tops of one node.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cut import cut, spent
from .matrix import ShapeError
from .rows import Rows, arrays, block

#: Bytes of a block of rows, and of the tops that meet at a node.
BLOCK_BYTES, NODE_BYTES = 16 << 20, 64 << 20
#: Most bytes of tops that are sent to every task, when all of a level are smaller than that.
SMALL_BYTES = 32 << 20
#: Columns of a panel; a matrix of no more is a single one.
PANEL = 512

_REST, _TOP, _FACTOR = 0, 1, 2
_UNIT = "b long, n long, ids binary, data binary, v binary, tau binary, signs binary, children binary, kind int"
_NAMES = [c.split()[0] for c in _UNIT.split(", ")]


@dataclass(frozen=True)
class Panel:
    """Columns [left, right): levels has a table of units for the leaves and for each level
    of nodes, counts their number."""

    left: int
    right: int
    levels: list[DataFrame]
    counts: list[int]


@dataclass(frozen=True)
class TreeQR:
    """A = Q*R of a matrix with rows >= cols; R's diagonal is not negative."""

    panels: list[Panel]
    r: Rows
    rows: int
    cols: int


def compact(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(V, tau, R) of a block: Q = I - V*T*V^T with `turn`, R upper trapezoidal."""
    h, tau = np.linalg.qr(x, mode="raw")
    k = len(tau)
    packed = h.T
    v = np.tril(packed[:, :k], -1)
    v[np.arange(k), np.arange(k)] = 1.0
    return v, tau, np.triu(packed[:k])


def turn(v: np.ndarray, tau: np.ndarray, x: np.ndarray, trans: bool) -> np.ndarray:
    """Q^T*X or Q*X."""
    if not len(tau) or not x.size:
        return x
    # T = (D^-1 + M)^-1 for M the strict upper triangle of V^T*V, written so that tau may be 0.
    t = np.linalg.solve(np.eye(len(tau)) + tau[:, None] * np.triu(v.T @ v, 1), np.diag(tau))
    return x - v @ ((t.T if trans else t) @ (v.T @ x))


def _factor(name: int, x: np.ndarray, width: int, ids: bytes | None, children: np.ndarray | None, root: bool) -> list[tuple]:
    """Rows of a unit: its factor, its top and what is left."""
    v, tau, r = compact(x[:, :width])
    behind, k = turn(v, tau, x[:, width:], True), len(tau)
    signs = np.where(np.diag(r) < 0, -1.0, 1.0) if root else np.ones(k)
    top = np.hstack((r, behind[:k])) * signs[:, None]
    out = [(name, len(x), ids, None, v.tobytes(), tau.tobytes(), signs.tobytes(), None if children is None else children.tobytes(), _FACTOR), (name, k, None, top.tobytes(), None, None, None, None, _TOP)]
    if len(x) > k:
        out.append((name, len(x) - k, None, behind[k:].tobytes(), None, None, None, None, _REST))
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 6, pa.int32()]
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=_NAMES)


def _leaves_of_rows(cols: int, width: int, block_bytes: int):
    """mapInArrow over (i, a): rows are gathered into blocks, each a leaf."""
    most = max(1, block_bytes // (8 * cols))

    def run(batches) -> Iterator[pa.RecordBatch]:
        base, number, ids, parts, held = TaskContext.get().partitionId() << 24, 0, [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                ids.append(part.column("i").to_numpy())
                parts.append(block(part, "a", cols))
                held += part.num_rows
                if held >= most:
                    yield _batch(_factor(base + number, np.concatenate(parts), width, np.concatenate(ids).tobytes(), None, False))
                    number, ids, parts, held = number + 1, [], [], 0
        if held:
            yield _batch(_factor(base + number, np.concatenate(parts), width, np.concatenate(ids).tobytes(), None, False))

    return run


def _leaves_of_blocks(width: int):
    """mapInArrow over the blocks that the panel before has left."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, n, data in zip(*(batch.column(c) for c in ("b", "n", "data")), strict=True):
                yield _batch(_factor(b.as_py(), np.frombuffer(data.as_buffer()).reshape(n.as_py(), -1), width, None, None, False))

    return run


def _node(base: int, width: int, root: bool):
    def run(tops: pa.Table) -> pa.Table:
        order = np.argsort(tops["b"].to_numpy())
        children = np.stack((tops["b"].to_numpy()[order], tops["n"].to_numpy()[order]), axis=1)
        x = np.concatenate([np.frombuffer(tops["data"][int(k)].as_py()).reshape(int(n), -1) for k, (_, n) in zip(order, children, strict=True)])
        return pa.Table.from_batches([_batch(_factor(base + tops["node"][0].as_py(), x, width, None, children, root))])

    return run


def factor(a: Rows, panel: int = PANEL, block_bytes: int = BLOCK_BYTES, node_bytes: int = NODE_BYTES) -> TreeQR:
    """The trees of all panels.  A panel writes the columns behind it once; a null or
    absent row is an error of the caller's layout, not filled here."""
    m, n = a.rows, a.cols
    if m < n:
        raise ShapeError((m, n))
    state, panels, roots, before = None, [], [], []
    for number, left in enumerate(range(0, n, panel)):
        right = min(left + panel, n)
        width = right - left
        leaves = a.df.select("i", "a").mapInArrow(_leaves_of_rows(n, width, block_bytes), _UNIT) if state is None else state.mapInArrow(_leaves_of_blocks(width), _UNIT)
        levels, counts = [cut(leaves, "leaves", by="kind")], []
        spent(*before, part=f"kind={_REST}")
        ways = max(2, min(64, node_bytes // (8 * width * (n - left))))
        while True:
            tops = levels[-1].where(F.col("kind") == _TOP).select("b", "n", "data")
            counts.append(tops.count())
            if len(levels) > 1 and counts[-1] == 1:
                break
            nodes = -(-counts[-1] // ways)
            base = (number + 1 << 48) + (len(levels) << 40)
            key = F.pmod(F.xxhash64("b"), F.lit(nodes)).alias("node")
            met = tops.select("b", "n", "data", key).groupBy("node").applyInArrow(_node(base, width, nodes <= 1), _UNIT)
            levels.append(cut(met, "nodes", by="kind"))
        before = levels
        panels.append(Panel(left, right, levels, counts))
        roots.append(tops.mapInArrow(_r_rows(left, n), "i long, a array<double>"))
        state = None
        for level in levels:
            rest = level.where(F.col("kind") == _REST).select("b", "n", "data")
            state = rest if state is None else state.unionByName(rest)
    r = roots[0] if roots else a.df.select("i", "a").limit(0)
    for part in roots[1:]:
        r = r.unionByName(part)
    return TreeQR(panels, Rows(r, n, n), m, n)


def _r_rows(left: int, cols: int):
    def run(batches):
        for batch in batches:
            for n, data in zip(batch.column("n"), batch.column("data"), strict=True):
                x = np.frombuffer(data.as_buffer()).reshape(n.as_py(), -1)
                yield pa.record_batch([pa.array(left + np.arange(len(x))), arrays(np.hstack((np.zeros((len(x), left)), x)))], names=["i", "a"])

    return run


def _unit_back(first: int, columns: int):
    """mapInArrow over units with the rows of their top (null at a root: the identity) and
    of what they left (null: zeros): both turned back, as (b, n, data) of each child, or as
    (b, n, data) of the unit itself if it is a leaf."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda c, kind=np.float64, r=r: None if (x := batch.column(c)[r].as_py()) is None else np.frombuffer(x, kind)  # noqa: B023, E731
                n, tau, signs = batch.column("n")[r].as_py(), get("tau"), get("signs")
                k = len(tau)
                x = np.zeros((n, columns))
                if (top := get("top")) is not None:
                    x[:k] = top.reshape(k, columns)
                else:
                    x[np.arange(k), np.arange(k)] = signs
                if (rest := get("rest")) is not None:
                    x[k:, first:] = rest.reshape(n - k, columns - first)
                x = turn(get("v").reshape(n, k), tau, x, False)
                if (children := get("children", np.int64)) is None:
                    yield pa.record_batch([batch.column("b").slice(r, 1), pa.array([n]), batch.column("ids").slice(r, 1), pa.array([x.tobytes()], pa.binary())], names=["b", "n", "ids", "data"])
                    continue
                at = 0
                for b, size in children.reshape(-1, 2).tolist():
                    yield pa.record_batch([pa.array([b]), pa.array([size]), pa.array([None], pa.binary()), pa.array([x[at : at + size].tobytes()], pa.binary())], names=["b", "n", "ids", "data"])
                    at += size

    return run


def thin_q(f: TreeQR) -> Rows:
    """The first cols columns of Q, orthonormal; row i is a row of A."""
    n, state = f.cols, None
    out = "b long, n long, ids binary, data binary"
    for p in reversed(f.panels):
        width, columns = p.right - p.left, n - p.left
        tops = None
        for level, count in zip(reversed(p.levels), reversed(p.counts), strict=True):
            units = level.where(F.col("kind") == _FACTOR).select("b", "n", "ids", "v", "tau", "signs", "children")
            if tops is None:
                units = units.withColumn("top", F.lit(None).cast("binary"))
            else:
                above = tops.select("b", F.col("data").alias("top"))
                units = units.join(F.broadcast(above) if 8 * count * width * columns <= SMALL_BYTES else above, "b")
            if state is None:
                units = units.withColumn("rest", F.lit(None).cast("binary"))
            else:
                units = units.join(state.select("b", F.col("data").alias("rest")), "b", "left")
            tops = units.mapInArrow(_unit_back(width, columns), out)
        old, state = state, cut(tops, "q") if len(f.panels) > 1 else tops
        if old is not None:
            spent(old)
    if state is None:
        raise ShapeError((f.rows, f.cols))

    def rows(batches):
        for batch in batches:
            for ids, data in zip(batch.column("ids"), batch.column("data"), strict=True):
                names = np.frombuffer(ids.as_buffer(), np.int64)
                yield pa.record_batch([pa.array(names), arrays(np.frombuffer(data.as_buffer()).reshape(len(names), n))], names=["i", "a"])

    return Rows(state.mapInArrow(rows, "i long, a array<double>"), f.rows, n)
