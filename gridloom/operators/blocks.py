"""Dense tiles: the layout for large dense products.

A tile is one row (bi, bj, nr, nc, data) with its elements row by row as doubles.  A
product is cut into a grid of cells: bands of output tiles, and slabs of the inner index
where there are too few output tiles for all tasks or a band would be too large for one.
A tile is copied once for each cell of its row (column) of the grid; slabs are summed as a
sorted stream, so a task holds one tile of the result at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .matrix import Matrix, ShapeError
from .rows import Rows, arrays

SIDE = 256
#: Most bytes of the tiles of either factor in one cell of the grid, on average.
HELD = 64 << 20
_SCHEMA = "bi int, bj int, nr int, nc int, data binary"
_NAMES = ["bi", "bj", "nr", "nc", "data"]


@dataclass(frozen=True)
class Blocks:
    df: DataFrame
    rows: int
    cols: int
    side: int


def _batch(tiles: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
    columns = [pa.array([t[0] for t in tiles], pa.int32()), pa.array([t[1] for t in tiles], pa.int32())]
    columns += [pa.array([t[2].shape[k] for t in tiles], pa.int32()) for k in (-2, -1)]
    return pa.record_batch([*columns, pa.array([t[2].tobytes() for t in tiles], pa.binary())], names=_NAMES)


def to_blocks(a: Matrix, side: int = SIDE) -> Blocks:
    """Tiles with at least one cell; a group holds at most side * side cells."""
    rows, cols = a.rows, a.cols
    cells = a.df.select(F.floor(F.col("i") / side).cast("int").alias("bi"), F.floor(F.col("j") / side).cast("int").alias("bj"), (F.col("i") % side).cast("int").alias("i"), (F.col("j") % side).cast("int").alias("j"), "v")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        bi, bj = (int(x.as_py()) for x in key)
        tile = np.zeros((min(side, rows - bi * side), min(side, cols - bj * side)))
        np.add.at(tile, (table["i"].to_numpy(), table["j"].to_numpy()), table["v"].to_numpy())
        return pa.Table.from_batches([_batch([(bi, bj, tile)])])

    return Blocks(cells.groupBy("bi", "bj").applyInArrow(run, _SCHEMA), rows, cols, side)


def of_rows(a: Rows, side: int = SIDE) -> Blocks:
    """Tiles of a table in row layout: one shuffle of the rows, by bands of `side` rows."""
    rows, cols = a.rows, a.cols

    def run(key: tuple, table: pa.Table) -> pa.Table:
        bi = int(key[0].as_py())
        i, flat = table["i"].to_numpy() - bi * side, table["a"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        band = np.zeros((min(side, rows - bi * side), cols))
        band[i] = flat.reshape(len(i), cols)
        return pa.Table.from_batches([_batch([(bi, j // side, np.ascontiguousarray(band[:, j : j + side])) for j in range(0, cols, side)])])

    return Blocks(a.df.select(F.floor(F.col("i") / side).cast("int").alias("bi"), "i", "a").groupBy("bi").applyInArrow(run, _SCHEMA), a.rows, cols, side)


def to_rows(b: Blocks) -> Rows:
    """Row layout again: a task holds a band of `side` rows."""
    side, rows, cols = b.side, b.rows, b.cols

    def run(key: tuple, table: pa.Table) -> pa.Table:
        bi = int(key[0].as_py())
        band = np.zeros((min(side, rows - bi * side), cols))
        for bj, nr, nc, data in zip(*(table[c] for c in _NAMES[1:]), strict=True):
            at = bj.as_py() * side
            band[: nr.as_py(), at : at + nc.as_py()] = np.frombuffer(data.as_buffer()).reshape(nr.as_py(), nc.as_py())
        return pa.table([pa.array(bi * side + np.arange(len(band))), arrays(band)], names=["i", "a"])

    # Bands without a tile are zero.
    spark = b.df.sparkSession
    every = spark.range(-(-b.rows // side)).select(F.col("id").cast("int").alias("bi"), F.lit(0).alias("bj"), F.lit(0).alias("nr"), F.lit(0).alias("nc"), F.lit(b"").alias("data"))
    return Rows(b.df.unionByName(every).groupBy("bi").applyInArrow(run, "i long, a array<double>"), b.rows, cols)


def from_blocks(b: Blocks) -> Matrix:
    """Cells that are not 0."""
    side = b.side

    def run(batches):
        for batch in batches:
            for bi, bj, nr, nc, data in zip(*(batch.column(c).to_pylist() for c in _NAMES), strict=True):
                tile = np.frombuffer(data).reshape(nr, nc)
                i, j = np.nonzero(tile)
                yield pa.record_batch([pa.array(i + bi * side), pa.array(j + bj * side), pa.array(tile[i, j])], names=["i", "j", "v"])

    return Matrix(b.df.mapInArrow(run, "i long, j long, v double"), b.rows, b.cols)


def transpose(b: Blocks) -> Blocks:
    def run(batches):
        for batch in batches:
            tiles = [(bj, bi, np.ascontiguousarray(np.frombuffer(d).reshape(nr, nc).T)) for bi, bj, nr, nc, d in zip(*(batch.column(c).to_pylist() for c in _NAMES), strict=True)]
            if tiles:
                yield _batch(tiles)

    return Blocks(b.df.mapInArrow(run, _SCHEMA), b.cols, b.rows, b.side)


def grid(a: Blocks, b: Blocks, tasks: int) -> tuple[int, int, int]:
    """(bands of rows, bands of columns, slabs of the inner index).  Bands are cut as long as
    tasks lack work, where it costs the fewest copies; slabs are the rest."""
    height, width, depth = (-(-n // a.side) for n in (a.rows, b.cols, a.cols))
    tile = 8 * a.side * a.side
    p = q = s = 1
    while p * q * s < tasks or max(-(-height // p), -(-width // q)) * -(-depth // s) * tile > HELD:
        # Copies of the left factor grow with q, of the right one with p.
        options = [(a.rows * a.cols * q + b.rows * b.cols * 2 * p, 0)] * (p < height) + [(a.rows * a.cols * 2 * q + b.rows * b.cols * p, 1)] * (q < width)
        if not options or (min(-(-height // p), -(-width // q)) == 1 and max(height // p, width // q) <= 1):
            if s >= depth:
                break
            s = min(2 * s, depth)
        elif min(options)[1] == 0:
            p = min(2 * p, height)
        else:
            q = min(2 * q, width)
    return p, q, s


def mult(a: Blocks, b: Blocks, alpha: float = 1.0) -> Blocks:
    """alpha*A*B."""
    return Blocks(_multiplied(a, b, lambda u, v: (alpha * (u @ v))[None]), a.rows, b.cols, a.side)


def mult_pairs(a: Blocks, b: Blocks) -> DataFrame:
    """(i, j, s, c) of A*B as if in twice the precision: s is the rounded element, c what that
    lost.  Cells that have a product of two elements that are not 0."""
    side = a.side
    tiles = _multiplied(a, b, sliced, 3)

    def run(batches):
        for batch in batches:
            for bi, bj, nr, nc, data in zip(*(batch.column(c) for c in _NAMES), strict=True):
                s, c, n = np.frombuffer(data.as_buffer()).reshape(3, nr.as_py(), nc.as_py())
                i, j = np.nonzero(n)
                yield pa.record_batch([pa.array(i + bi.as_py() * side), pa.array(j + bj.as_py() * side), pa.array(s[i, j]), pa.array(c[i, j])], names=["i", "j", "s", "c"])

    return tiles.mapInArrow(run, "i long, j long, s double, c double")


def _two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


#: Bits below the largest of a row or column that a sliced product regards.
KEPT_BITS = 110


def _slices(x: np.ndarray, axis: int, bits: int) -> list[np.ndarray]:
    """Parts of x that add up to it, as far as KEPT_BITS reach: in each, the elements of a row
    (axis 1) or column are `bits`-bit multiples of one power of two."""
    out = []
    for _ in range(-(-KEPT_BITS // bits)):
        top = np.abs(x).max(axis=axis, keepdims=True, initial=0.0)
        if not top.any():
            break
        # Adding and taking away 1.5 * 2^(e + 52 - bits) rounds to multiples of 2^(e - bits).
        shift = np.ldexp(1.5, np.frexp(top)[1] + 52 - bits)
        part = (x + shift) - shift
        out.append(part)
        x = x - part
    return out


def sliced(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """(rounded product, its error, number of products) by element, in twice the precision.

    Slices are so narrow that the product of two has no rounding at all in floating point;
    these exact products are added up in pairs of numbers.  Rows and columns are scaled by
    powers of two first, so nothing leaves the range."""
    count = (u != 0).astype(np.float64) @ (v != 0)
    if not (np.isfinite(u).all() and np.isfinite(v).all()):
        return np.stack((u @ v, np.zeros(count.shape), count))
    up = np.frexp(np.abs(u).max(axis=1, keepdims=True, initial=0.0))[1]
    across = np.frexp(np.abs(v).max(axis=0, keepdims=True, initial=0.0))[1]
    bits = (52 - max(1, u.shape[1]).bit_length()) // 2
    left, right = _slices(np.ldexp(u, -up), 1, bits), _slices(np.ldexp(v, -across), 0, bits)
    high, low = np.zeros(count.shape), np.zeros(count.shape)
    for order in range(len(left) + len(right) - 1):
        if order * bits > KEPT_BITS:
            break
        for p in range(max(0, order - len(right) + 1), min(order + 1, len(left))):
            high, e = _two_sum(high, left[p] @ right[order - p])
            low += e
    high, low = _two_sum(high, low)
    return np.stack((np.ldexp(high, up + across), np.ldexp(low, up + across), count))


def _multiplied(a: Blocks, b: Blocks, kernel, planes: int = 1) -> DataFrame:
    """Tiles of A*B, of which `kernel` makes those of a cell of the grid from its matrices: one
    plane, or the three of `sliced`."""
    if a.cols != b.rows or a.side != b.side:
        raise ShapeError((a.rows, a.cols, b.rows, b.cols))
    side, rows, cols, inner = a.side, a.rows, b.cols, a.cols
    spark = a.df.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    p, q, s = grid(a, b, tasks)
    height, width, depth = (-(-n // side) for n in (rows, cols, inner))
    band = lambda column, of, n: F.floor(F.col(column) * n / of).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = a.df.withColumn("p", band("bi", height, p)).withColumn("s", band("bj", depth, s)).withColumn("q", every(q))
    right = b.df.withColumn("q", band("bj", width, q)).withColumn("s", band("bi", depth, s)).withColumn("p", every(p))

    def laid_out(table: pa.Table) -> tuple[np.ndarray, int, int]:
        """The tiles of a cell side by side, and the place of the first."""
        bi, bj = table["bi"].to_numpy(), table["bj"].to_numpy()
        nr, nc = table["nr"].to_numpy(), table["nc"].to_numpy()
        i0, j0 = int(bi.min()), int(bj.min())
        out = np.zeros((int((bi * side + nr).max()) - i0 * side, int((bj * side + nc).max()) - j0 * side))
        for i, j, r, c, data in zip(bi.tolist(), bj.tolist(), nr.tolist(), nc.tolist(), table["data"], strict=True):
            out[(i - i0) * side : (i - i0) * side + r, (j - j0) * side : (j - j0) * side + c] = np.frombuffer(data.as_buffer()).reshape(r, c)
        return out, i0, j0

    empty = _batch([])

    def product(x: pa.Table, y: pa.Table) -> pa.Table:
        if not len(x) or not len(y):
            return pa.Table.from_batches([empty])
        (u, i0, k0), (v, l0, j0) = laid_out(x), laid_out(y)
        # Tiles that are missing at either end are zero.
        low, high = max(k0, l0) * side, min(k0 * side + u.shape[1], l0 * side + v.shape[0])
        if low >= high:
            return pa.Table.from_batches([empty])
        w = kernel(u[:, low - k0 * side : high - k0 * side], v[low - l0 * side : high - l0 * side])
        tiles = [(i0 + i // side, j0 + j // side, np.ascontiguousarray(w[:, i : i + side, j : j + side])) for i in range(0, w.shape[1], side) for j in range(0, w.shape[2], side)]
        return pa.Table.from_batches([_batch(tiles)])

    keys = ("p", "q", "s")
    parts = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(product, _SCHEMA)
    if s == 1:
        return parts

    def summed(batches):
        held = None
        for batch in batches:
            for bi, bj, nr, nc, data in zip(*(batch.column(c) for c in _NAMES), strict=True):
                place, tile = (bi.as_py(), bj.as_py()), np.frombuffer(data.as_buffer()).reshape(planes, nr.as_py(), nc.as_py())
                full = np.zeros((planes, min(side, rows - place[0] * side), min(side, cols - place[1] * side)))
                full[:, : tile.shape[1], : tile.shape[2]] = tile
                if held is not None and held[0] == place:
                    own = held[1]
                    if planes == 1:
                        own += full
                    else:
                        own[0], e = _two_sum(own[0], full[0])
                        own[1] += e + full[1]
                        own[2] += full[2]
                    continue
                if held is not None:
                    yield _batch([(*held[0], held[1])])
                held = (place, full)
        if held is not None:
            yield _batch([(*held[0], held[1])])

    return parts.repartition("bi", "bj").sortWithinPartitions("bi", "bj").mapInArrow(summed, _SCHEMA)
