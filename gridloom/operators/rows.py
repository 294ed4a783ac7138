"""Row layout: (i, a) with the dense row i as an array.

Factorisations work on this layout.  A step takes one panel of pivot rows (a fixed
number of rows, so its size is known beforehand), sends it to all tasks and lets every
other row be updated where it lies; rows are never gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cut import cut
from .matrix import Matrix, ShapeError

#: Most bytes of a panel or of the small side that is sent to every task.
SHARED_BYTES = 256 << 20
#: Pivot rows of one step.
PANEL = 64


@dataclass(frozen=True)
class Rows:
    df: DataFrame
    rows: int
    cols: int


def check_shared(*shape: int) -> None:
    """Refuses what would be too large to send to every task."""
    if 8 * int(np.prod(shape, dtype=np.int64)) > SHARED_BYTES:
        raise ShapeError(f"{shape} doubles exceed {SHARED_BYTES} bytes")


def block(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    """An array column of equal lengths as a matrix."""
    column = batch.column(name)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def arrays(matrix: np.ndarray) -> pa.Array:
    n, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(matrix).ravel()))


def from_arrays(table: DataFrame, i: str, values: str, rows: int, cols: int) -> Rows:
    """A table with an array of `cols` numbers in each row, as it lies: no shuffle."""
    return Rows(table.select(F.col(i).cast("long").alias("i"), F.transform(values, lambda v: v.cast("double")).alias("a")), rows, cols)


def to_rows(a: Matrix | Rows) -> Rows:
    """One shuffle by row; rows without cells become zero rows, a null value is 0, repeated
    cells are summed."""
    if isinstance(a, Rows):
        return a
    width = a.cols
    every = a.df.sparkSession.range(a.rows).select(F.col("id").alias("i"))
    cells = a.df.groupBy("i").agg(F.collect_list(F.struct("j", F.coalesce("v", F.lit(0.0)).alias("v"))).alias("c"))

    def run(batches):
        for batch in batches:
            out = np.zeros((batch.num_rows, width))
            cells_ = batch.column("c")
            sizes, flat = cells_.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), cells_.flatten()
            # Repeated cells are summed, as joins do.
            np.add.at(out, (np.repeat(np.arange(batch.num_rows), sizes), flat.field("j").to_numpy(zero_copy_only=False)), flat.field("v").to_numpy(zero_copy_only=False))
            yield pa.record_batch([batch.column("i"), arrays(out)], names=["i", "a"])

    filled = every.join(cells, "i", "left").select("i", "c")
    return Rows(filled.mapInArrow(run, "i long, a array<double>"), a.rows, a.cols)


def from_rows(rows: Rows, name: str = "a") -> Matrix:
    cells = rows.df.select("i", F.posexplode(name).alias("j", "v"))
    return Matrix(cells.select("i", F.col("j").cast("long").alias("j"), "v"), rows.rows, rows.cols)


def collect_small(frame: DataFrame, width: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, a) of at most `count` rows, in order of i."""
    check_shared(count, width)
    got = sorted(frame.select("i", "a").limit(count).collect())
    return np.array([r[0] for r in got], np.int64), np.array([r[1] for r in got], np.float64).reshape(len(got), width)


def map_rows(rows: DataFrame, width: int, f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(i, f(i, a)) with the rows of a batch as one matrix."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.record_batch([batch.column("i"), arrays(f(batch.column("i").to_numpy(), block(batch, "a", width)))], names=["i", "a"])

    return rows.mapInArrow(run, "i long, a array<double>")


def times_small(rows: Rows, b: np.ndarray) -> Rows:
    """A * B for a B that fits every task."""
    check_shared(*b.shape)
    return Rows(map_rows(rows.df, rows.cols, lambda _, x: x @ b), rows.rows, b.shape[1])


def levels(frame: DataFrame, ways: int) -> list[int]:
    """Widths of the levels of a tree over a frame's tasks, down to `ways`, each at most
    `ways` times narrower than the one before.  The session's partitions stand for the number
    of tasks, which is not known before a plan runs."""
    width, out = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")), []
    while width > ways:
        width = max(ways, -(-width // ways))
        out.append(width)
    return out or [ways]


def reduce_tree(frame: DataFrame, width: int, start: Callable, merge: Callable, shape: tuple[int, int], ways: int = 8) -> np.ndarray:
    """Folds rows to one small matrix: start(block) in each batch, merge(x, y) within a
    task and then over a tree of `ways` inputs each."""
    check_shared(*shape)

    def local(batches) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = start(block(batch, "a", width))
                total = own if total is None else merge(total, own)
        if total is not None:
            yield pa.record_batch([pa.array([total.shape[0]], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["n", "m"])

    def join(batches) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for n, m in zip(batch.column("n").to_pylist(), batch.column("m").to_pylist(), strict=True):
                own = np.frombuffer(m).reshape(n, -1)
                total = own if total is None else merge(total, own)
        if total is not None:
            yield pa.record_batch([pa.array([total.shape[0]], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["n", "m"])

    parts = frame.select("a").mapInArrow(local, "n int, m binary")
    for count in levels(frame, ways):
        parts = parts.repartition(count).mapInArrow(join, "n int, m binary")
    out = None
    for r in parts.collect():
        own = np.frombuffer(r["m"]).reshape(r["n"], -1)
        out = own if out is None else merge(out, own)
    return np.zeros(shape) if out is None else np.array(out)


def gram(rows: Rows) -> np.ndarray:
    """A^T*A, one pass; cols x cols."""
    n = rows.cols
    return reduce_tree(rows.df, n, lambda x: x.T @ x, lambda x, y: x + y, (n, n))


def small(a: Matrix, most: int = 2048) -> np.ndarray:
    """A matrix with both sides at most `most`, as an array."""
    if max(a.rows, a.cols) > most:
        raise ShapeError(f"{a.rows} x {a.cols} is larger than {most}")
    out = np.zeros((a.rows, a.cols))
    cells = a.df.select("i", "j", "v").toArrow()
    np.add.at(out, (cells["i"].to_numpy(), cells["j"].to_numpy()), cells["v"].to_numpy())
    return out


def matrix_of(spark, array: np.ndarray) -> Matrix:
    """A small array as a Matrix."""
    n, m = array.shape
    check_shared(n, m)
    table = pa.table({"i": pa.array(np.repeat(np.arange(n), m)), "j": pa.array(np.tile(np.arange(m), n)), "v": pa.array(np.ascontiguousarray(array, dtype=np.float64).ravel())})
    return Matrix(spark.createDataFrame(table), n, m)


# Elimination


def lu_in_place(x: np.ndarray, pivot: bool) -> tuple[np.ndarray, np.ndarray]:
    """(packed L and U, row order) of a small matrix.  A zero pivot with a zero column below
    leaves both; below it a number that is not zero has no quotient: ArithmeticError."""
    x = x.copy()
    m, n = x.shape
    order = np.arange(m)
    for k in range(min(m, n)):
        if pivot:
            p = k + int(np.argmax(np.abs(x[k:, k])))
            if p != k:
                x[[k, p]], order[[k, p]] = x[[p, k]], order[[p, k]]
        if x[k, k] != 0:
            with np.errstate(all="ignore"):  # what is not finite goes on as it is
                x[k + 1 :, k] /= x[k, k]
                x[k + 1 :, k + 1 :] -= np.outer(x[k + 1 :, k], x[k, k + 1 :])
        elif x[k + 1 :, k].any():
            raise ArithmeticError(f"pivot {k} is zero, but not the column below it")
    return x, order


def no_zeros(diagonal: np.ndarray) -> None:
    """ArithmeticError if a triangle with this diagonal has no inverse."""
    if (diagonal == 0).any():
        raise ArithmeticError("the triangle is singular: its diagonal has a zero")


def solve_small(t: np.ndarray, b: np.ndarray, lower: bool, unit: bool) -> np.ndarray:
    """Substitution with a small triangle; the other triangle is not read."""
    x, n = b.copy(), len(t)
    for k in range(n) if lower else reversed(range(n)):
        rest = x[k] - (t[k, :k] @ x[:k] if lower else t[k, k + 1 :] @ x[k + 1 :])
        with np.errstate(divide="ignore", invalid="ignore"):
            x[k] = rest if unit else rest / t[k, k]
    return x


def tournament(active: DataFrame, left: int, right: int, width: int, ways: int = 8) -> list[int]:
    """Row numbers of good pivots for the columns [left, right), in pivot order.

    Every task keeps the rows that partial pivoting picks among its own, then the
    picks meet in a tree.  If all rows are in one task, this is partial pivoting.
    """
    most = right - left
    check_shared(ways, most, most)

    def pick(names: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        by = np.argsort(names, kind="stable")
        names, x = names[by], x[by]
        _, order = lu_in_place(x, True)
        keep = order[:most]
        return names[keep], x[keep]

    def run(wide: bool):
        def local(batches):
            names, held = np.zeros(0, np.int64), np.zeros((0, most))
            for batch in batches:
                if batch.num_rows:
                    own = block(batch, "a", width if wide else most)
                    own = own[:, left:right] if wide else own
                    names, held = pick(np.concatenate((names, batch.column("i").to_numpy())), np.concatenate((held, own)))
            if len(names):
                yield pa.record_batch([pa.array(names), arrays(held)], names=["i", "a"])

        return local

    parts = active.select("i", "a").mapInArrow(run(True), "i long, a array<double>")
    for count in levels(active, ways):
        parts = parts.repartition(count).mapInArrow(run(False), "i long, a array<double>")
    got = parts.collect()
    if not got:
        return []
    names, _ = pick(np.array([r["i"] for r in got]), np.array([r["a"] for r in got]).reshape(len(got), most))
    return [int(x) for x in names]


def eliminate(rows: Rows, pivot: str = "partial", panel: int = PANEL) -> tuple[Rows, DataFrame, bool]:
    """(packed factors by position, moves, singular): L*U with unit L is A with row i at
    position k for each (i, k) of `moves`.

    pivot: partial (by tournament), none, or cholesky (L*L^T of a symmetric positive
    definite A, L packed in the lower triangle; raises ArithmeticError otherwise).
    A zero pivot above a column that is not zero has no factors: ArithmeticError.  Values
    that are not finite are no errors; they go through as arithmetic has them.
    """
    m, n = rows.rows, rows.cols
    # Written first: every step reads it more than once.
    state, singular = cut(rows.df.select("i", F.lit(None).cast("long").alias("k"), "a"), "rows"), False
    done = []  # pivot rows are left in the table of their panel and not written again
    for left in range(0, min(m, n), panel):
        right = min(left + panel, m, n)
        picked = tournament(state, left, right, n) if pivot == "partial" else list(range(left, right))
        names, x = collect_small(state.where(F.col("i").isin(picked)), n, len(picked))
        x = x[[int(np.flatnonzero(names == p)[0]) for p in picked]]
        if pivot == "cholesky":
            try:
                corner = np.linalg.cholesky(x[:, left:right])
            except np.linalg.LinAlgError:
                raise ArithmeticError("the matrix is not positive definite") from None
            top, upper = solve_small(corner, x[:, right:], True, False), corner.T
            x[:, left:right], x[:, right:] = corner, 0.0
        else:
            upper, _ = lu_in_place(x[:, left:right], False)
            singular |= bool((np.diag(upper) == 0).any())
            top = solve_small(upper, x[:, right:], True, True)
            x[:, left:right], x[:, right:] = upper, top
        table = cut(state.mapInArrow(_step(picked, x, upper, top, left, right, n), "i long, k long, a array<double>, odd boolean"), "panel")
        if pivot != "cholesky" and (np.diag(upper) == 0).any() and table.where("odd").limit(1).count():
            raise ArithmeticError(f"a pivot of the columns {left} to {right - 1} is zero, but not the column below it")
        table = table.drop("odd")
        done.append(table.where("k is not null"))
        state = table.where("k is null")
    for part in done:
        state = state.unionByName(part)
    if m > n and pivot == "partial":
        from .matrix import Vector
        from .sorting import sort_vector

        # The rows that were no pivots follow in their order.
        rest = sort_vector(Vector(table.where("k is null").select("i", F.col("i").cast("double").alias("v")), m)).df
        moves = state.where("k is not null").select("i", "k").unionByName(rest.select(F.col("v").cast("long").alias("i"), (F.col("i") + n).alias("k")))
        state = state.drop("k").join(cut(moves, "moves"), "i")
    else:
        state = state.withColumn("k", F.coalesce("k", "i"))
    return Rows(state.select(F.col("k").alias("i"), "a"), m, n), state.select("i", "k"), singular


def _step(picked: list[int], x: np.ndarray, upper: np.ndarray, top: np.ndarray, left: int, right: int, width: int):
    """mapInArrow: the pivot rows take their place, all rows without one are reduced.  odd: a
    row whose part under a zero pivot is not zero, so that no multiple of the pivots makes it."""
    places = {p: r for r, p in enumerate(picked)}
    zero = np.diag(upper) == 0

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            names, k = batch.column("i").to_pylist(), batch.column("k").to_pylist()
            a = block(batch, "a", width).copy()
            own = [r for r, i in enumerate(names) if k[r] is None and i in places]
            rest = np.array([r for r, i in enumerate(names) if k[r] is None and i not in places], np.int64)
            given = a[rest, left:right]
            odd = np.zeros(len(names), bool)
            if zero.any():
                # Under a zero pivot the multiple is 0; what is left there must be rounding.
                part = given.copy()
                for c in range(right - left):
                    part[:, c] -= part[:, :c] @ upper[:c, c]
                    part[:, c] = 0.0 if zero[c] else part[:, c] / upper[c, c]
                odd[rest] = (np.abs(given - part @ np.triu(upper)) > 2.0**-40 * (np.abs(given).max(initial=0.0) + np.abs(upper).max(initial=0.0))).any(axis=1)
            else:
                part = solve_small(upper.T, given.T, True, False).T
            a[rest, left:right] = part
            with np.errstate(all="ignore"):
                a[rest, right:] -= part @ top
            for r in own:
                a[r, left:] = x[places[names[r]], left:]
                k[r] = left + places[names[r]]
            yield pa.record_batch([batch.column("i"), pa.array(k, pa.int64()), arrays(a), pa.array(odd)], names=["i", "k", "a", "odd"])

    return run


#: Most bytes of right-hand sides that are solved together on the driver's side.
NARROW_BYTES = 32 << 20


def solve_narrow(t: Rows, b: np.ndarray, lower: bool, unit: bool = False, trans: bool = False, panel: int = PANEL) -> np.ndarray:
    """op(T)^-1 * B for a triangle of T and a narrow B.  T stays where it is and is not
    written again: for each panel, tasks multiply their rows with what is solved already,
    and only the panel's corner and these sums are gathered.  The other triangle is not used,
    so packed factors will do.  A zero on the diagonal raises ArithmeticError."""
    n, k = b.shape
    x = b.astype(np.float64, copy=True)
    starts = list(range(0, n, panel))
    table = t.df.select("i", "a")
    if len(starts) > 1:
        # Sorted once, so that a panel's rows are found by the files' own statistics.
        table = cut(table.repartitionByRange("i").sortWithinPartitions("i"), "triangle")
    forward = lower != trans
    for left in starts if forward else reversed(starts):
        right = min(left + panel, n)
        known = slice(0, left) if forward else slice(right, n)

        def sums(batches, left=left, right=right, known=known):
            for batch in batches:
                if not batch.num_rows:
                    continue
                i, a = batch.column("i").to_numpy(), block(batch, "a", n)
                own = (i >= left) & (i < right)
                if trans:
                    rest = (i >= known.start) & (i < known.stop)
                    if rest.any():
                        yield pa.record_batch([pa.array([-1]), arrays((a[rest, left:right].T @ x[i[rest]]).reshape(1, -1))], names=["i", "a"])
                    if own.any():
                        yield pa.record_batch([pa.array(i[own]), arrays(a[own, left:right])], names=["i", "a"])
                elif own.any():
                    yield pa.record_batch([pa.array(i[own]), arrays(np.hstack((a[own, left:right], a[own][:, known] @ x[known])))], names=["i", "a"])

        part = table if trans else table.where(F.col("i").between(left, right - 1))
        if trans:
            part = table.where(F.col("i") >= left) if lower else table.where(F.col("i") < right)
        corner, off = np.zeros((right - left, right - left)), np.zeros((right - left, k))
        for r in part.mapInArrow(sums, "i long, a array<double>").collect():
            if r["i"] < 0:
                off += np.array(r["a"]).reshape(right - left, k)
            else:
                corner[r["i"] - left] = r["a"][: right - left]
                if not trans:
                    off[r["i"] - left] = r["a"][right - left :]
        if not unit:
            no_zeros(np.diag(corner))
        x[left:right] = solve_small(corner.T if trans else corner, x[left:right] - off, forward, unit)
    return x


def solve_rows(t: Rows, b: Rows, lower: bool, unit: bool = False, panel: int = PANEL) -> Rows:
    """T^-1 * B for a triangle: each step solves one panel of rows and takes it off the
    right-hand sides of the rows that come after."""
    n, k = t.rows, b.cols
    state = t.df.select("i", "a").join(b.df.select("i", F.col("a").alias("b")), "i").select("i", F.concat("a", "b").alias("a"))
    state = cut(state, "solve")
    starts = list(range(0, n, panel))
    for left in starts if lower else reversed(starts):
        right = min(left + panel, n)
        _, x = collect_small(state.where(F.col("i").between(left, right - 1)), n + k, right - left)
        if not unit:
            no_zeros(np.diag(x[:, left:right]))
        own = solve_small(x[:, left:right], x[:, n:], lower, unit)

        def step(i, a, left=left, right=right, own=own):
            a = a.copy()
            mine = (i >= left) & (i < right)
            a[mine, n:] = own[i[mine] - left]
            rest = i >= right if lower else i < left
            a[rest, n:] -= a[rest, left:right] @ own
            return a

        state = map_rows(state, n + k, step)
        if len(starts) > 1:
            state = cut(state, "solve")
    return Rows(map_rows(state, n + k, lambda _, a: a[:, n:]), n, k)
