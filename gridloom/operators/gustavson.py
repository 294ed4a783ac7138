"""Products of coordinate tables without a row for each scalar product.

Cells of A meet those of B by the inner index k.  Where the result is small, an index with
very many products is cut into a grid of parts, each with a share of A's column and of B's row, so it
runs on many tasks.  A task multiplies its cells in Arrow batches and adds the products up in a
dense accumulator; only partial sums leave it.

A large result is made by groups of its rows: a group is sent A's cells in these rows and, for each k
among them, B's row k once, so its task has all products of a cell and no partial sums
are shuffled.  A group with very many products, as that of a row with half of all cells, is dealt
by k over several tasks, and only such groups have partial sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cut import cut

#: Products of one k, beyond which it is cut; a part has about as many.
HEAVY = 1 << 21
#: Cells of A and B that meet in one task, on average.
CELLS = 1 << 19
#: Cells of a result that is added up in a dense array (32 MB, and 4 MB of marks).
DENSE = 1 << 22
#: Products that are made at a time, and those of a row that are held before they are added up.
CHUNK, HELD = 1 << 20, 1 << 22
SIDE = 256
#: Cells of a k that lie together, ranges of rows that are counted, and most parts of a group.
PIECE, RANGES, PARTS = 1 << 10, 1 << 12, 1 << 10


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _products(left: pa.Table, right: pa.Table, cols: int, uplo: str | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place = i * cols + j, product) of all pairs with the same part, about CHUNK at a time."""
    key, i, x = (left[c].to_numpy() for c in ("part", "i", "x"))
    other = np.argsort(right["part"].to_numpy(), kind="stable")
    theirs, j, y = (right[c].to_numpy()[other] for c in ("part", "j", "y"))
    first = np.searchsorted(theirs, key)
    size = np.searchsorted(theirs, key, side="right") - first
    total, at = np.cumsum(size), 0
    while at < len(key):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + CHUNK, side="right")))
        own = slice(at, to)
        place = _ranges(first[own], size[own])
        a, b = np.repeat(i[own], size[own]), j[place]
        v = np.repeat(x[own], size[own]) * y[place]
        if uplo is not None:
            keep = a >= b if uplo == "lower" else a <= b
            a, b, v = a[keep], b[keep], v[keep]
        yield a * cols + b, v
        at = to


def _dense(rows: int, cols: int, uplo: str | None):
    """Tiles of partial sums of one task, with a mark for each cell that has a product."""
    schema = pa.schema([("bi", pa.int32()), ("bj", pa.int32()), ("data", pa.binary()), ("marks", pa.binary())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        sums, marks = np.zeros(rows * cols), np.zeros(rows * cols, bool)
        for place, v in _products(left, right, cols, uplo):
            sums += np.bincount(place, v, rows * cols)
            marks[place] = True
        sums, marks = sums.reshape(rows, cols), marks.reshape(rows, cols)
        out = []
        for p in range(0, rows, SIDE):
            for q in range(0, cols, SIDE):
                if (own := marks[p : p + SIDE, q : q + SIDE]).any():
                    out.append((p // SIDE, q // SIDE, np.ascontiguousarray(sums[p : p + SIDE, q : q + SIDE]).tobytes(), np.packbits(own).tobytes()))
        return pa.table(list(zip(*out, strict=True)) if out else [[], [], [], []], schema=schema)

    return run


def _summed(rows: int, cols: int, alpha: float):
    """mapInArrow over tiles in order: their sums as cells."""

    def cells(place, sums, marks):
        i, j = np.nonzero(marks)
        return pa.record_batch([pa.array(i + place[0] * SIDE), pa.array(j + place[1] * SIDE), pa.array(alpha * sums[i, j])], names=["i", "j", "v"])

    def run(batches):
        held = None
        for batch in batches:
            for bi, bj, data, marks in zip(*(batch.column(c) for c in ("bi", "bj", "data", "marks")), strict=True):
                place = (bi.as_py(), bj.as_py())
                shape = (min(SIDE, rows - place[0] * SIDE), min(SIDE, cols - place[1] * SIDE))
                own = np.frombuffer(data.as_buffer()).reshape(shape)
                mark = np.unpackbits(np.frombuffer(marks.as_buffer(), np.uint8), count=shape[0] * shape[1]).reshape(shape)
                if held is not None and held[0] == place:
                    held[1][:] += own
                    held[2][:] |= mark
                    continue
                if held is not None:
                    yield cells(*held)
                held = (place, own.copy(), mark.copy())
        if held is not None:
            yield cells(*held)

    return run


_PIECES = "k long, piece int, {0}s binary, {1}s binary"


def _binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary for each range between `bounds` of an array of eight-byte elements."""
    values = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * 8).astype(np.int32)), pa.py_buffer(values)])


def _elements(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """The elements of all binaries of a column, and where each one's begin."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return np.frombuffer(raw.tobytes(), kind), (at - at[0]) // 8


def _pieces(cells: DataFrame, index: str, value: str) -> DataFrame:
    """(k, piece, indices, values) of cells (k, index, value): PIECE of them at most, in order."""

    def run(batches):
        empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        held, before = empty, 0  # the cells of the last k so far, and its pieces that are out

        def out(k, x, v, before):
            heads = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
            sizes = np.diff(np.append(heads, len(k)))
            count = -(-sizes // PIECE)
            number = _ranges(np.zeros(len(heads), np.int64), count)
            bounds = np.append(np.repeat(heads, count) + number * PIECE, len(k))
            number[: count[0]] += before
            return pa.record_batch([pa.array(k[bounds[:-1]]), pa.array(number.astype(np.int32)), _binary(x, bounds), _binary(v, bounds)], names=["k", "piece", f"{index}s", f"{value}s"])

        for batch in batches:
            k, x, v = held = tuple(np.concatenate((h, batch.column(c).to_numpy())) for h, c in zip(held, ("k", index, value), strict=True))
            if not len(k):
                continue
            last = int(np.searchsorted(k, k[-1]))
            if last:
                yield out(k[:last], x[:last], v[:last], before)
                held, before = tuple(h[last:] for h in held), 0
            if whole := len(held[0]) // PIECE * PIECE:
                yield out(*(h[:whole] for h in held), before)
                held, before = tuple(h[whole:] for h in held), before + whole // PIECE
        if len(held[0]):
            yield out(*held, before)

    dealt = cells.select("k", index, value).repartition("k").sortWithinPartitions("k", index)
    return cut(dealt.mapInArrow(run, _PIECES.format(index, value)), "pieces")


def _meetings(batch: pa.RecordBatch, group: np.ndarray, cols: int, uplo: str | None):
    """Of pieces (is, xs, js, ys) that meet: (cells of A by group of rows as bounds, piece, group, first and number of B's cells that
    these rows take)."""
    i, at = _elements(batch.column("is"), np.int64)
    j, to = _elements(batch.column("js"), np.int64)
    piece = np.repeat(np.arange(len(at) - 1), np.diff(at))
    g = np.searchsorted(group, i, side="right")
    heads = np.flatnonzero(np.concatenate(([True], (piece[1:] != piece[:-1]) | (g[1:] != g[:-1])))) if len(i) else np.zeros(0, np.int64)
    bounds = np.append(heads, len(i))
    own = piece[heads]
    first, end = to[own], to[own + 1]
    if uplo is not None and len(heads):
        key = np.repeat(np.arange(len(to) - 1), np.diff(to)) * cols + j
        if uplo == "lower":
            end = np.searchsorted(key, own * cols + np.minimum(i[bounds[1:] - 1], cols - 1), side="right")
        else:
            first = np.searchsorted(key, own * cols + np.minimum(i[heads], cols))
    return i, j, bounds, own, g[heads], first, end - first


def _row_sums(i: np.ndarray, x: np.ndarray, own: np.ndarray, j: np.ndarray, y: np.ndarray, to: np.ndarray, cols: int, uplo: str | None) -> Iterator[pa.RecordBatch]:
    """Sums of the products of A's cells (i, x) with all of the piece `own` of B's, rows in order."""
    order = np.argsort(i, kind="stable")
    i, x, own = i[order], x[order], own[order]
    first, end = to[own], to[own + 1]
    if uplo is not None:
        key = np.repeat(np.arange(len(to) - 1), np.diff(to)) * cols + j
        if uplo == "lower":
            end = np.maximum(first, np.searchsorted(key, own * cols + np.minimum(i, cols - 1), side="right"))
        else:
            first = np.minimum(end, np.searchsorted(key, own * cols + np.minimum(i, cols)))
    size = end - first
    total, at, held = np.cumsum(size), 0, []
    heads = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1]))) if len(i) else np.zeros(0, np.int64)
    ends = np.append(heads[1:], len(i))
    while at < len(i):
        to_ = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + CHUNK, side="right")))
        whole = int(np.searchsorted(ends, to_, side="right"))  # rows that end in this chunk
        done = whole > 0 and ends[whole - 1] > at
        to_ = int(ends[whole - 1]) if done else to_
        place = _ranges(first[at:to_], size[at:to_])
        row, column, v = np.repeat(i[at:to_], size[at:to_]), j[place], np.repeat(x[at:to_], size[at:to_]) * y[place]
        held.append(_added(row, column, v, cols))
        if not done and sum(len(h[0]) for h in held) > HELD:
            held = [_added(*map(np.concatenate, zip(*held, strict=True)), cols)]
        at = to_
        if done:
            r, c, s = held[0] if len(held) == 1 else _added(*map(np.concatenate, zip(*held, strict=True)), cols)
            held = []
            yield pa.record_batch([pa.array(r), pa.array(c), pa.array(s)], names=["i", "j", "v"])


def _added(row: np.ndarray, column: np.ndarray, v: np.ndarray, cols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums by (row, column), in order."""
    if not len(row):
        return row, column, v
    top, left = row.min(), column.min()
    wide = int(column.max() - left) + 1
    if (int(row.max() - top) + 1) * wide <= 4 * len(row):
        place = (row - top) * wide + (column - left)
        sums, count = np.bincount(place, v), np.bincount(place)
        at = np.flatnonzero(count)
        return at // wide + top, at % wide + left, sums[at]
    order = np.lexsort((column, row))
    row, column, v = row[order], column[order], v[order]
    heads = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (column[1:] != column[:-1]))))
    return row[heads], column[heads], np.add.reduceat(v, heads)


def _by_rows(left: DataFrame, right: DataFrame | None, rows: int, cols: int, uplo: str | None, heavy: int) -> DataFrame:
    """(i, j, v) of a product by groups of rows, from cells (k, i, x) and (k, j, y); right None: the same cells."""
    spark = left.sparkSession
    own = _pieces(left, "i", "x")
    if right is None and not own.where("piece > 0").limit(1).count():
        met = own.select("k", "is", "xs", F.col("is").alias("js"), F.col("xs").alias("ys"))
    else:
        other = own.select("k", F.col("is").alias("js"), F.col("xs").alias("ys")) if right is None else _pieces(right, "j", "y").select("k", "js", "ys")
        met = own.select("k", "is", "xs").join(other, "k")
    width = max(1, -(-rows // RANGES))

    def counted(batches):
        for batch in batches:
            i, at = _elements(batch.column("is"), np.int64)
            to = _elements(batch.column("js"), np.int64)[1]
            products = np.bincount(i // width, np.repeat(np.diff(to), np.diff(at)))
            cells = np.bincount(i // width)
            held = np.flatnonzero(cells)
            yield pa.record_batch([pa.array(held), pa.array(cells[held]), pa.array(products[held].astype(np.int64))], names=["r", "cells", "products"])

    seen = met.mapInArrow(counted, "r long, cells long, products long").groupBy("r").agg(F.sum("cells").alias("cells"), F.sum("products").alias("products")).orderBy("r").toArrow()
    ranges, products = seen["r"].to_numpy(), seen["products"].to_numpy().astype(np.float64)
    most = 4 * heavy
    count = max(spark.sparkContext.defaultParallelism, int(seen["cells"].to_numpy().sum()) >> 19, int(products.sum()) // most)
    # Groups of neighbouring ranges with about as many products each; `group` is where all but the first begin.
    number = (np.cumsum(products) - products) * count // max(products.sum(), 1)
    heads = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1]))) if len(ranges) else np.zeros(0, np.int64)
    group = ranges[heads[1:]] * width
    parts = np.ones(max(len(heads), 1), np.int64)
    if len(heads):
        sums = np.add.reduceat(products, heads)
        parts = np.where(sums > 4 * most, np.minimum(np.ceil(sums / most), PARTS), 1).astype(np.int64)

    def dealt(batches):
        for batch in (b.slice(at, PIECE) for b in batches for at in range(0, b.num_rows, PIECE)):
            i, j, bounds, piece, g, first, size = _meetings(batch, group, cols, uplo)
            x, y = _elements(batch.column("xs"), np.float64)[0], _elements(batch.column("ys"), np.float64)[0]
            part = (batch.column("k").to_numpy()[piece] * np.int64(0x9E3779B1) >> 7) % parts[g]
            # A piece that many groups take is copied for each, so not all copies are made at a time.
            full = np.flatnonzero(size > 0)
            for some in np.split(full, np.flatnonzero(np.diff(np.cumsum(size[full]) // CHUNK)) + 1):
                mine, theirs = _ranges(bounds[some], np.diff(bounds)[some]), _ranges(first[some], size[some])
                ends = [np.concatenate(([0], np.cumsum(n))) for n in (np.diff(bounds)[some], size[some])]
                columns = [pa.array(g[some] * PARTS + part[some]), _binary(i[mine], ends[0]), _binary(x[mine], ends[0]), _binary(j[theirs], ends[1]), _binary(y[theirs], ends[1])]
                yield pa.record_batch(columns, names=["bucket", "is", "xs", "js", "ys"])

    def summed(batches):
        held: list[pa.RecordBatch] = []

        def out():
            table = pa.Table.from_batches(held).combine_chunks()
            (i, at), (x, _), (j, to), (y, _) = (_elements(table[c].chunk(0), kind) for c, kind in (("is", np.int64), ("xs", np.float64), ("js", np.int64), ("ys", np.float64)))
            whole = parts[table["bucket"][0].as_py() // PARTS] == 1
            for b in _row_sums(i, x, np.repeat(np.arange(len(at) - 1), np.diff(at)), j, y, to, cols, uplo):
                yield b.append_column("whole", pa.array(np.full(b.num_rows, whole)))

        for batch in batches:
            bucket = batch.column("bucket").to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)])) if len(bucket) else np.zeros(1, np.int64)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if held and held[0].column("bucket")[0].as_py() != bucket[a]:
                    yield from out()
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield from out()

    records = met.mapInArrow(dealt, "bucket long, is binary, xs binary, js binary, ys binary")
    sums = records.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(summed, "i long, j long, v double, whole boolean")
    if (parts == 1).all():
        return sums.select("i", "j", "v")
    sums = cut(sums, "sums")
    return sums.where("whole").select("i", "j", "v").unionByName(sums.where("not whole").groupBy("i", "j").agg(F.sum("v").alias("v")))


def product(a: DataFrame, b: DataFrame | None, rows: int, inner: int, cols: int, alpha: float = 1.0, uplo: str | None = None, heavy: int = HEAVY) -> DataFrame:
    """(i, j, v) of alpha*A*B from cells (i, j, v), on a triangle if one is named; a cell is there
    if it has a product.  b None: B is A transposed, and A is read for both."""
    if inner >= 1 << 43:
        raise ValueError("inner indices beyond 2^43")
    spark = a.sparkSession
    left = a.select("i", F.col("j").alias("k"), F.col("v").alias("x"))
    if rows * cols > DENSE:
        right = None if b is None else b.select(F.col("i").alias("k"), "j", F.col("v").alias("y"))
        return _by_rows(left, right, rows, cols, uplo, heavy).select("i", "j", (alpha * F.col("v")).alias("v"))
    left = cut(left, "left")
    right = left.select("k", F.col("i").alias("j"), F.col("x").alias("y")) if b is None else cut(b.select(F.col("i").alias("k"), "j", F.col("v").alias("y")), "right")
    sizes = left.groupBy("k").agg(F.count("*").alias("m")).join(right.groupBy("k").agg(F.count("*").alias("n")), "k")
    cut_ = F.least(F.ceil(F.sqrt(F.col("m") * F.col("n") / heavy)), F.lit(1024))
    grids = cut(sizes.where(F.col("m") * F.col("n") > heavy).select("k", F.least(cut_, "m").cast("int").alias("p"), F.least(cut_, "n").cast("int").alias("q")), "heavy")
    some = grids.limit(1).count() > 0
    spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    part = lambda p, q: (F.shiftleft("k", 20) + F.shiftleft(p, 10) + (F.col(q) if isinstance(q, str) else q)).alias("part")
    if some:
        one = F.lit(1)
        left = left.join(grids, "k", "left").select("k", "i", "x", F.pmod(F.xxhash64("i"), F.coalesce("p", one)).cast("int").alias("p"), spread(F.coalesce("q", one)).alias("q"))
        right = right.join(grids, "k", "left").select("k", "j", "y", F.pmod(F.xxhash64("j"), F.coalesce("q", one)).cast("int").alias("q"), spread(F.coalesce("p", one)).alias("p"))
        left, right = left.select(part("p", "q"), "i", "x"), right.select(part("p", "q"), "j", "y")
    else:
        zero = F.lit(0)
        left, right = left.select(part(zero, zero), "i", "x"), right.select(part(zero, zero), "j", "y")
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    buckets = max(tasks, (left.count() + right.count()) // CELLS)
    bucket = F.pmod(F.xxhash64("part"), F.lit(buckets)).cast("int").alias("bucket")
    groups = left.select(bucket, "part", "i", "x").groupBy("bucket").cogroup(right.select(bucket, "part", "j", "y").groupBy("bucket"))
    tiles = groups.applyInArrow(_dense(rows, cols, uplo), "bi int, bj int, data binary, marks binary")
    return tiles.repartition("bi", "bj").sortWithinPartitions("bi", "bj").mapInArrow(_summed(rows, cols, alpha), "i long, j long, v double")
