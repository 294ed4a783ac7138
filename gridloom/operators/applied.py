"""A sparse matrix as an operator on vectors that every task may hold.

The cells are written once, dealt by row; a product sends the vector to the tasks and
gathers one sum for each row, so an iteration is one narrow pass without a shuffle.
Triangles and incomplete factors go by blocks of neighbouring rows.  All blocks are first done
at once from a guess of what they take from others, then those again that had guessed wrong; when
no block takes anything that has changed since in any bit, the result is that of one row after
another, as each row depends on earlier ones only.  Where that does not come soon, blocks go
in waves that follow the pattern: a block starts when all that it takes from is done.  Inside a
block rows are treated alike: sweeps over all of them until no bit changes, else level by level.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cut import cut, spent
from .matrix import Matrix, Vector

#: Most elements of a vector that is sent to every task (32 MB); longer ones stay tables.
SHARED_VECTOR = 1 << 22
#: Rows of a block of a triangle or an incomplete factor.
BLOCK = 8192
#: Rounds over all blocks, the first included, before blocks go in waves.
ROUNDS = 3
#: Levels of rows up to which a block is not swept, most sweeps, and most updates of a sweep over an incomplete factor.
SHALLOW, SWEEPS, UPDATES = 32, 128, 1 << 22


def fits(*sizes: int) -> bool:
    return max(sizes) <= SHARED_VECTOR


def gathered(x: Vector) -> np.ndarray:
    out = np.zeros(x.size)
    got = x.df.select("i", "v").toArrow()
    out[got["i"].to_numpy()] = got["v"].to_numpy()
    return out


def table(spark, x: np.ndarray) -> Vector:
    return Vector(spark.createDataFrame(pa.table({"i": np.arange(len(x), dtype=np.int64), "v": np.asarray(x, np.float64)})), len(x))


class Operator:
    """x -> A*x.  Cells lie in pieces: some neighbouring rows' columns and values as bytes, so a product reads no cell
    as a row of a table."""

    def __init__(self, cells: DataFrame, rows: int):
        self.rows = rows

        def pieces(batches):
            for b in batches:
                if b.num_rows:
                    i, j, v = (b.column(c).to_numpy() for c in ("i", "j", "v"))
                    first = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1])))
                    yield _bytes({"rows": i[first], "starts": first, "columns": j, "cells": v})

        dealt = cells.select("i", "j", "v").repartition("i").sortWithinPartitions("i")
        self.df = cut(dealt.mapInArrow(pieces, "rows binary, starts binary, columns binary, cells binary"), "operator")

    def __call__(self, x: np.ndarray) -> np.ndarray:
        def run(batches):
            for b in batches:
                for r in range(b.num_rows):
                    get = lambda c, kind, r=r, b=b: np.frombuffer(b.column(c)[r].as_buffer(), kind)
                    yield _bytes({"rows": get("rows", np.int64), "sums": np.add.reduceat(get("cells", np.float64) * x[get("columns", np.int64)], get("starts", np.int64))})

        out = np.zeros(self.rows)
        for row in self.df.mapInArrow(run, "rows binary, sums binary").collect():
            np.add.at(out, np.frombuffer(row["rows"], np.int64), np.frombuffer(row["sums"]))
        return out


def _bytes(arrays: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in arrays.values()], names=list(arrays))


class Triangle:
    """b -> T^-1*b for the sparse triangle that `cells` hold, with or without its diagonal.

    Rows are dealt into blocks of neighbours, and blocks into waves: a block's wave comes
    after those of all blocks whose rows it takes from.  Inside a block rows are dealt into
    levels in the same way.  Both orders are made once and kept in the table.  A block is
    done in the first round and again when something that it takes has changed; if ROUNDS of
    them leave any, those go wave by wave, and so does every later right-hand side."""

    def __init__(self, cells: Matrix, lower: bool, unit: bool, block: int = BLOCK):
        n = self.n = cells.rows
        self.lower, self.unit, self.block = lower, unit, block
        # An upper triangle is a lower one when read from its end.
        at = lambda c: F.col(c) if lower else n - 1 - F.col(c)
        own = cells.df.where(F.col("i") >= F.col("j") if lower else F.col("i") <= F.col("j")).select(at("i").alias("i"), at("j").alias("j"), "v")
        own = cut(own.withColumn("block", F.floor(F.col("i") / block)), "half")
        self.waves = waves(own, block)
        self.df = cut(own.groupBy("block").applyInArrow(lambda key, t: _levelled(t, block, n, unit), _LEVELLED), "triangle")
        self.takes = _takes(own, block) if len(self.waves) > 1 else None
        spent(own)

    def __call__(self, b: np.ndarray) -> np.ndarray:
        b = b.astype(np.float64)
        b = b if self.lower else b[::-1]
        x = b.copy()
        if self.takes is None:
            for wave in self.waves:
                self._done(wave, b, x)
            return x if self.lower else x[::-1]
        columns, owners = self.takes
        todo, used = np.sort(np.concatenate(self.waves)), x[columns]

        def again(blocks: np.ndarray) -> np.ndarray:
            """Does them; all that have taken what is something else now."""
            mine = np.isin(owners, blocks)
            used[mine] = x[columns[mine]]
            self._done(blocks.tolist(), b, x)
            return np.unique(owners[x[columns].view(np.int64) != used.view(np.int64)])

        for _ in range(ROUNDS):
            todo = again(todo) if len(todo) else todo
        for wave in self.waves if len(todo) else ():
            if len(late := np.intersect1d(todo, wave)):
                todo = again(late)
                self.takes = None
        return x if self.lower else x[::-1]

    def _done(self, blocks: list[int], b: np.ndarray, x: np.ndarray) -> None:
        """Puts the unknowns of some blocks into x; they take what is there."""
        size, n = self.block, self.n
        ends = [(k * size, min((k + 1) * size, n)) for k in blocks]
        right = {k: b[i:j] for k, (i, j) in zip(blocks, ends, strict=True)}
        known = x[: min(i for i, _ in ends)] if len(blocks) == 1 else x

        def run(batches):
            for batch in batches:
                for r in range(batch.num_rows):
                    k = batch.column("block")[r].as_py()
                    get = lambda c, kind, r=r, batch=batch: np.frombuffer(batch.column(c)[r].as_buffer(), kind)
                    own = _substituted(right[k], known, get)
                    yield pa.record_batch([pa.array([k]), pa.array([own.tobytes()], pa.binary())], names=["block", "x"])

        # A wave reads its own blocks only.
        part = self.df if len(blocks) == sum(map(len, self.waves)) else self.df.where(F.col("block").isin(blocks))
        for row in part.mapInArrow(run, "block long, x binary").collect():
            i, j = row["block"] * size, min((row["block"] + 1) * size, n)
            x[i:j] = np.frombuffer(row["x"])


_LEVELLED = "block long, far_rows binary, far_columns binary, far binary, rows binary, row_ends binary, starts binary, columns binary, near binary, diagonal binary, swept binary"


def waves(cells: DataFrame, block: int) -> list[list[int]]:
    """Numbers of the blocks of a lower pattern (i, j, block) that have cells, dealt so that a block
    comes after all that it takes from.  Pairs of blocks reach the driver, not cells."""
    pairs = cells.select("block", F.floor(F.col("j") / block).alias("needs")).where("needs <= block").distinct()
    needs: dict[int, list[int]] = {}
    for row in pairs.collect():
        needs.setdefault(row["block"], []).append(row["needs"])
    when: dict[int, int] = {}
    for b in sorted(needs):
        when[b] = 1 + max((when.get(k, 0) for k in needs[b] if k < b), default=0)
    out: list[list[int]] = [[] for _ in range(max(when.values(), default=0))]
    for b, wave in when.items():
        out[wave - 1].append(b)
    return out


def _takes(cells: DataFrame, block: int) -> tuple[np.ndarray, np.ndarray] | None:
    """(column, block) of every column that a block takes from another one; None if they are more
    than the driver should hold."""
    far = cells.where(F.floor(F.col("j") / block) < F.col("block")).select("j", "block").distinct().limit(SHARED_VECTOR + 1).toArrow()
    return None if far.num_rows > SHARED_VECTOR else (far["j"].to_numpy(), far["block"].to_numpy())


def levels(rows: np.ndarray, columns: np.ndarray, n: int, most: int | None = None) -> np.ndarray | None:
    """Level of each of n rows of a strictly lower pattern: one more than the highest level
    among the rows that its columns name.  Every cell is looked at once.  None if there are more than `most`."""
    level, open_ = np.zeros(n, np.int64), np.bincount(rows, minlength=n)
    order = np.argsort(columns, kind="stable")
    below, bounds = rows[order], np.searchsorted(columns[order], np.arange(n + 1))
    front, at = np.flatnonzero(open_ == 0), 0
    while len(front):
        if at == most:
            return None
        level[front] = at
        sizes = bounds[front + 1] - bounds[front]
        hit = below[np.repeat(bounds[front] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
        np.subtract.at(open_, hit, 1)
        hit = np.unique(hit)
        front, at = hit[open_[hit] == 0], at + 1
    return level


def _placed(level: np.ndarray, row: np.ndarray, column: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, ...]:
    """rows by level, where each level ends, and the cells of each row in that order."""
    rows = np.argsort(level, kind="stable")
    place = np.empty(len(level), np.int64)
    place[rows] = np.arange(len(level))
    order = np.argsort(place[row], kind="stable")
    return rows, np.cumsum(np.bincount(level, minlength=1)), np.searchsorted(place[row][order], np.arange(len(level) + 1)), column[order], value[order]


def _levelled(table: pa.Table, block: int, n: int, unit: bool) -> pa.Table:
    """A block's cells: those in columns before it by row, and those inside it by level."""
    number = table["block"][0].as_py()
    left, size = number * block, min(block, n - number * block)
    i, j, v = (table[c].to_numpy() for c in ("i", "j", "v"))
    i = i - left
    order = np.lexsort((j, i))
    i, j, v = i[order], j[order], v[order]
    diagonal = np.ones(size)
    if not unit:
        at = j == i + left
        diagonal = np.bincount(i[at], v[at], size)
    far, near = j < left, (j >= left) & (j < i + left)
    row, column, value = i[near], j[near] - left, v[near]
    level, swept = levels(row, column, size, SHALLOW), 0
    if level is None:
        # Rows with cells in one level, if sweeps over them come to an end soon.
        some = _placed((np.bincount(row, minlength=size) > 0).astype(np.int64), row, column, value)
        swept = int(_swept(np.ones(size), *some, diagonal) is not None)
        placed = some if swept else _placed(levels(row, column, size), row, column, value)
    else:
        placed = _placed(level, row, column, value)
    parts = (i[far], j[far], v[far], *placed, diagonal, np.array([swept]))
    names = [c.split()[0] for c in _LEVELLED.split(", ")]
    return pa.table([pa.array([number], pa.int64()), *(pa.array([np.ascontiguousarray(p).tobytes()], pa.binary()) for p in parts)], names=names)


def _substituted(b: np.ndarray, known: np.ndarray, get) -> np.ndarray:
    """The unknowns of a block, level by level."""
    far_rows, far_columns, far = get("far_rows", np.int64), get("far_columns", np.int64), get("far", np.float64)
    rows, row_ends, starts = (get(c, np.int64) for c in ("rows", "row_ends", "starts"))
    columns, near, diagonal = get("columns", np.int64), get("near", np.float64), get("diagonal", np.float64)
    rest = b - np.bincount(far_rows, far * known[far_columns], len(b)) if len(far) else b
    if get("swept", np.int64)[0]:
        if (x := _swept(rest, rows, row_ends, starts, columns, near, diagonal)) is not None:
            return x
        row = rows[np.repeat(np.arange(len(b)), np.diff(starts))]
        rows, row_ends, starts, columns, near = _placed(levels(row, columns, len(b)), row, columns, near)
    x, top = np.zeros(len(b)), 0
    for end in row_ends.tolist():
        own = rows[top:end]
        at = starts[top : end + 1]
        if at[-1] > at[0]:  # then all rows of the level have cells
            cells = slice(at[0], at[-1])
            x[own] = (rest[own] - np.add.reduceat(near[cells] * x[columns[cells]], at[:-1] - at[0])) / diagonal[own]
        else:
            x[own] = rest[own] / diagonal[own]
        top = end
    return x


def _swept(rest: np.ndarray, rows: np.ndarray, row_ends: np.ndarray, starts: np.ndarray, columns: np.ndarray, near: np.ndarray, diagonal: np.ndarray) -> np.ndarray | None:
    """The same, all rows with cells at once and again until no bit changes; None if that takes more than SWEEPS."""
    own, at = rows[row_ends[0] :], starts[row_ends[0] : -1]
    mine, by = rest[own], diagonal[own]
    with np.errstate(all="ignore"):
        x = rest / diagonal
        for _ in range(SWEEPS):
            new = (mine - np.add.reduceat(near * x[columns], at)) / by
            if np.array_equal(new.view(np.int64), x[own].view(np.int64)):
                return x
            x[own] = new
    return None


def incomplete_lu(a: Matrix, block: int = BLOCK) -> Matrix:
    """ILU(0) on the pattern of A, whose diagonal is stored.  Blocks of rows are eliminated all at
    once, from A's rows instead of finished ones, and again from what that gave; if ROUNDS of it leave rows that
    change, in waves.  A block is sent those rows that its columns name, and no others."""
    n = a.rows
    base = cut(a.df.select("i", "j", "v", F.floor(F.col("i") / block).alias("block")).repartitionByRange("block", "i").sortWithinPartitions("block", "i"), "pattern")
    order = waves(base, block)
    out = None
    if len(order) > 1:
        out = _at_once(base, [b for wave in order for b in wave], n, block)
    if out is None:
        out = _in_waves(base, order, n, block)
    return Matrix(out.select("i", "j", "v"), n, a.cols)


_FACTOR = "i long, j long, v double, block long"


def _at_once(base: DataFrame, every: list[int], n: int, block: int) -> DataFrame | None:
    """(i, j, v, block) of the factors; None if ROUNDS leave blocks that took what has changed."""
    packed = cut(base.groupBy("block").applyInArrow(lambda key, cells: _packed(cells), "block long, i binary, j binary, v binary"), "packed")
    needs = cut(_named(base, block), "needs")
    upper = lambda frame: frame.where("j >= i").select("i", "j", "v").join(needs, "i").select("block", "i", "j", "v")
    eliminate = lambda cells, given: _eliminated(_unpacked(cells), given, n)
    out, todo, given = base, set(every), cut(upper(base), "given")
    done: list[tuple[DataFrame, set[int]]] = []
    for _ in range(ROUNDS):
        some = lambda frame, own=todo: frame if len(own) == len(every) else frame.where(F.col("block").isin(sorted(own)))
        step = some(packed).groupBy("block").cogroup(some(given).groupBy("block")).applyInArrow(eliminate, _FACTOR)
        done = [(t, own - todo) for t, own in done if own - todo] + [(cut(step, "ilu"), todo)]
        out = None
        for t, own in done:
            part = t if len(own) == len(every) else t.where(F.col("block").isin(sorted(own)))
            out = part if out is None else out.unionByName(part)
        rows = cut(upper(out), "given")
        # As text two numbers are the same if all their bits are.
        moved = rows.join(given.withColumnRenamed("v", "old"), ["block", "i", "j"]).where(F.col("v").cast("string") != F.col("old").cast("string"))
        todo = {r["block"] for r in moved.select("block").distinct().collect()}
        spent(given)
        given = rows
        if not todo:
            spent(packed, base)
            return out
    spent(packed, *(t for t, _ in done))
    return None


def _named(own: DataFrame, block: int) -> DataFrame:
    """(block, i): the rows before a block that its columns name."""
    return own.where(F.col("j") < F.col("block") * block).select("block", F.col("j").alias("i")).distinct()


def _packed(table: pa.Table) -> pa.Table:
    names = ["i", "j", "v"]
    return pa.table([table["block"].slice(0, 1), *(pa.array([table[c].to_numpy().tobytes()], pa.binary()) for c in names)], names=["block", *names])


def _unpacked(table: pa.Table) -> pa.Table:
    if not table.num_rows:
        return pa.schema([("i", pa.int64()), ("j", pa.int64()), ("v", pa.float64()), ("block", pa.int64())]).empty_table()
    cells = {c: np.frombuffer(table[c][0].as_buffer(), kind) for c, kind in (("i", np.int64), ("j", np.int64), ("v", np.float64))}
    return pa.table(cells | {"block": np.full(len(cells["i"]), table["block"][0].as_py())})


def _in_waves(base: DataFrame, order: list[list[int]], n: int, block: int) -> DataFrame:
    when = {b: k for k, wave in enumerate(order) for b in wave}
    before = {(r["block"], r["needs"]) for r in base.select("block", F.floor(F.col("j") / block).alias("needs")).where("needs < block").distinct().collect()} if len(order) > 1 else set()
    done: list[DataFrame] = []
    for wave in order:
        own = base if len(order) == 1 else base.where(F.col("block").isin(wave))
        asked = {when[k] for b, k in before if b in set(wave)}
        finished = None
        for k in sorted(asked):
            finished = done[k] if finished is None else finished.unionByName(done[k])
        finished = base.limit(0) if finished is None else finished
        rows = finished.where("j >= i").select("i", "j", "v").join(_named(own, block), "i").select(*[F.col(c).alias(c) for c in ("block", "i", "j", "v")])
        step = own.groupBy("block").cogroup(rows.groupBy("block")).applyInArrow(lambda cells, given: _eliminated(cells, given, n), _FACTOR)
        done.append(cut(step, "ilu"))
    out = done[0] if done else base
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def _eliminated(cells: pa.Table, given: pa.Table, n: int) -> pa.Table:
    """The factors of a block of rows.  All rows of a level take their p-th pivot together."""
    empty = pa.schema([("i", pa.int64()), ("j", pa.int64()), ("v", pa.float64()), ("block", pa.int64())]).empty_table()
    if not cells.num_rows:
        return empty
    number, first = cells["block"][0], given.num_rows
    i, j, v = (np.concatenate((given[c].to_numpy(), cells[c].to_numpy())) for c in ("i", "j", "v"))
    # Given rows come before the block's, so by (i, j) they stay in front.
    order = np.lexsort((j, i))
    i, j, v = i[order], j[order], v[order].astype(np.float64)
    key = i * n + j
    names = np.unique(i)
    bounds = np.append(np.searchsorted(i, names), len(i))
    diagonal = np.searchsorted(key, names * n + names)
    mine = np.searchsorted(names, i[first])  # the block's first row among names
    low = np.flatnonzero((j < i) & (np.arange(len(i)) >= first))
    pivot = np.searchsorted(names, j[low])  # row of each pivot among names
    inner = pivot >= mine
    rows = np.searchsorted(names, i[low])
    count = np.bincount(rows - mine, minlength=len(names) - mine)
    start = np.searchsorted(low, bounds[mine:-1])
    inside = (rows[inner] - mine, pivot[inner] - mine, len(names) - mine)
    level = levels(*inside, SHALLOW)
    whole = _swept_factor(v, key, low, pivot, start, count, diagonal, bounds, i, j, n) if level is None else None
    v, level = (v, levels(*inside) if level is None else level) if whole is None else (whole, np.zeros(0, np.int64))
    ends = np.cumsum(np.bincount(level))
    ranked = np.argsort(level, kind="stable")
    top = 0
    for end in ends.tolist():
        own, top = ranked[top:end], end
        for p in range(int(count[own].max(initial=0))):
            own = own[count[own] > p]
            at, k = low[start[own] + p], pivot[start[own] + p]
            place, by, behind = _updates(at, k, key, diagonal, bounds, i, j, n)
            with np.errstate(divide="ignore", invalid="ignore"):
                v[at] /= v[diagonal[k]]
            v[place] -= v[by] * v[behind]
    own = slice(first, None)
    return pa.table([pa.array(i[own]), pa.array(j[own]), pa.array(v[own]), pa.array([number.as_py()] * (len(i) - first), pa.int64())], names=["i", "j", "v", "block"])


def _updates(at: np.ndarray, k: np.ndarray, key: np.ndarray, diagonal: np.ndarray, bounds: np.ndarray, i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, by, behind): v[place] -= v[by] * v[behind] is what cells `at`, whose pivots are in rows k, take from their rows."""
    sizes = bounds[k + 1] - diagonal[k] - 1
    behind = np.repeat(diagonal[k] + 1 - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    by = np.repeat(at, sizes)
    wanted = i[by] * n + j[behind]
    place = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
    hit = key[place] == wanted
    return place[hit], by[hit], behind[hit]


def _swept_factor(v, key, low, pivot, start, count, diagonal, bounds, i, j, n) -> np.ndarray | None:
    """The factors by sweeps over all rows of a block, each from the pivot rows of the sweep before, until no
    bit changes; None if that takes more than SWEEPS, or more updates at a time or in turn than it should."""
    if count.max(initial=0) > SWEEPS:
        return None
    if (bounds[pivot + 1] - diagonal[pivot]).sum() > UPDATES:
        return None
    steps, rows = [], np.arange(len(count))
    for p in range(int(count.max(initial=0))):
        rows = rows[count[rows] > p]
        at, k = low[start[rows] + p], pivot[start[rows] + p]
        steps.append((at, diagonal[k], *_updates(at, k, key, diagonal, bounds, i, j, n)))
    old = v
    for _ in range(SWEEPS):
        new = v.copy()
        with np.errstate(all="ignore"):
            for at, by, place, times, behind in steps:
                new[at] /= old[by]
                new[place] -= new[times] * old[behind]
        if np.array_equal(new.view(np.int64), old.view(np.int64)):
            return new
        old = new
    return None
