"""Nearest neighbours by a block matrix join.

Queries are dealt into groups and candidates into stripes; a cell of the grid joins
one group with one stripe.  In a cell, int8 product tiles give every cosine with a
bound on its quantisation error; pairs whose upper bound reaches the k-th lower bound
of their query are recomputed in double precision and kept in a heap of k for each
query.  The cells' heaps are merged last.  The result is exact: a pair is only left
out if k others are certainly nearer.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Search:
    """stripe, group: most candidates and queries in a cell on average; both are less for
    wide vectors, so that those of a cell fill at most `cell_bytes` as doubles.  spread: as many stripes are made, even if they are smaller, as long as
    each keeps `least` candidates.  tile, rows: candidates and queries of one product."""

    k: int = 5
    stripe: int = 65536
    group: int = 16384
    spread: int = 64
    least: int = 512
    tile: int = 4096
    rows: int = 1024
    cell_bytes: int = 1 << 26


def usable(vector: str = "embedding"):
    """True for vectors that take part: not null, no null or non-finite component, not zero."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(F.col(vector).isNotNull() & ~F.exists(vector, odd) & F.exists(vector, lambda x: x != 0), F.lit(False))


class Quantised:
    """Unit rows as int8 with a scale each, and the norms that bound the error.  Rows come
    scaled by `scaled`, so no square over- or underflows."""

    def __init__(self, matrix: np.ndarray):
        self.norm = np.sqrt((matrix * matrix).sum(axis=1))
        unit = matrix / self.norm[:, None]
        self.scale = np.abs(unit).max(axis=1) / 127
        self.code = np.rint(unit / self.scale[:, None]).astype(np.int8)
        kept = self.code * self.scale[:, None]
        self.kept = np.sqrt((kept * kept).sum(axis=1))
        self.lost = np.sqrt(((unit - kept) ** 2).sum(axis=1))


def tile_bounds(a: Quantised, rows: slice, b: Quantised, cols: slice) -> tuple[np.ndarray, np.ndarray]:
    """Cosines of a tile from the int8 codes and how far they may be off.

    With u = p + r and v = q + s (codes and remainders of unit rows), u.v - p.q is
    p.s + r.v, at most |p||s| + |r|.  Products of codes are integers, exact in
    float32 up to 1040 components and in float64 beyond.
    """
    kind = np.float32 if a.code.shape[1] * 127 * 127 < 1 << 24 else np.float64
    near = (a.code[rows].astype(kind) @ b.code[cols].astype(kind).T) * a.scale[rows, None] * b.scale[None, cols]
    return near, a.kept[rows, None] * b.lost[None, cols] + a.lost[rows, None] + 1e-9


def scaled(matrix: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest component to one half at least:
    the cosine stays the same to the last bit."""
    return np.ldexp(matrix, -np.frexp(np.abs(matrix).max(axis=1, initial=0.0))[1][:, None])


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def distinct_rows(matrix: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, list[list[int]]]:
    """The different rows and the `most` smallest different ids of each: of equal
    vectors no others can be among the nearest."""
    order = np.lexsort((ids,))
    view = np.ascontiguousarray(matrix[order] + 0.0).view(np.dtype((np.void, matrix.shape[1] * 8))).ravel()
    _, first, inverse = np.unique(view, return_index=True, return_inverse=True)
    owners: list[list[int]] = [[] for _ in first]
    for j, v in zip(inverse.ravel().tolist(), ids[order].tolist(), strict=True):
        own = owners[j]
        if len(own) < most and (not own or own[-1] != v):
            own.append(v)
    return matrix[order][first], owners


def _offer(heap: list, k: int, score: float, vec_id: int) -> None:
    """Keeps the k best (score, smaller id first); an id is in a heap once."""
    item = (score, -vec_id)
    for place, (s, v) in enumerate(heap):
        if v == -vec_id:
            if score > s:
                heap[place] = item
                heapq.heapify(heap)
            return
    if len(heap) < k:
        heapq.heappush(heap, item)
    elif item > heap[0]:
        heapq.heapreplace(heap, item)


def nearest(queries: np.ndarray, query_ids: np.ndarray, candidates: np.ndarray, ids: np.ndarray, search: Search) -> list[list[tuple[float, int]]]:
    """For each query a heap of its k nearest candidates with another id: (score, -id)."""
    k = search.k
    vectors, owners = distinct_rows(candidates, ids, k + 1)
    # Vectors of one id stand together: only its nearest counts for the k-th lower bound.
    head = np.array([o[0] for o in owners])
    order = np.argsort(head, kind="stable")
    vectors, owners, head = vectors[order], [owners[c] for c in order], head[order]
    queries, vectors = scaled(queries), scaled(vectors)
    lone = np.array([o[0] if len(o) == 1 else 0 for o in owners])
    single = np.array([len(o) == 1 for o in owners])
    a, b = Quantised(queries), Quantised(vectors)
    heaps: list[list] = [[] for _ in query_ids]
    for top in range(0, len(queries), search.rows):
        rows = slice(top, min(top + search.rows, len(queries)))
        mine = query_ids[rows]
        for left in range(0, len(vectors), search.tile):
            cols = slice(left, min(left + search.tile, len(vectors)))
            near, off = tile_bounds(a, rows, b, cols)
            own = single[None, cols] & (lone[None, cols] == mine[:, None])
            low = np.where(head[None, cols] == mine[:, None], -np.inf, near - off)
            first = np.flatnonzero(np.concatenate(([True], head[cols][1:] != head[cols][:-1])))
            if len(first) < low.shape[1]:
                low = np.maximum.reduceat(low, first, axis=1)
            size = low.shape[1]
            least = np.partition(low, size - k, axis=1)[:, size - k] if size >= k else np.full(len(mine), -np.inf)
            held = np.array([heaps[top + r][0][0] if len(heaps[top + r]) == k else -np.inf for r in range(len(mine))])
            i, j = np.nonzero((near + off >= np.maximum(least, held)[:, None]) & ~own)
            for at in range(0, len(i), 65536):
                p, q = i[at : at + 65536] + top, j[at : at + 65536] + left
                score = (queries[p] * vectors[q]).sum(axis=1) / (a.norm[p] * b.norm[q])
                for r, c, s in zip(p.tolist(), q.tolist(), score.tolist(), strict=True):
                    heap, me = heaps[r], int(query_ids[r])
                    if len(heap) == k and s < heap[0][0]:
                        continue
                    for v in owners[c]:
                        if v != me:
                            _offer(heap, k, s, v)
    return heaps


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _cell(search: Search):
    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        if not len(queries) or not len(candidates):
            return _FOUND.empty_table()
        names = queries["vec_id"].to_numpy()
        heaps = nearest(_matrix(queries["embedding"]), names, _matrix(candidates["embedding"]), candidates["vec_id"].to_numpy(), search)
        found = [(int(q), -v, s) for q, heap in zip(names, heaps, strict=True) for s, v in heap]
        return pa.table([pa.array([x[c] for x in found], t) for c, t in enumerate(_FOUND.types)], schema=_FOUND)

    return run


def search(queries: DataFrame, candidates: DataFrame, how: Search = Search()) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest candidates by cosine.

    Both take (vec_id, embedding).  Rows without an id and vectors that are null,
    zero or hold null or non-finite components take no part; vectors only meet
    those of their own length.  A candidate with the query's id is its own and left
    out; an id with several rows counts once, by its nearest vector, on either side.  Ties go to
    the smaller id.  A query without candidates has no row.

    Candidates are copied once for each group of queries and queries once for each
    stripe: that is the join's whole shuffle.  Both are placed by a hash of the row, so a
    task that runs again deals them alike; repeated rows are dropped first, before the
    shuffle if they are in one task.
    """
    fit = lambda frame: frame.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & usable()).dropDuplicates()
    left, right = fit(queries), fit(candidates)
    sides = left.select(F.lit(0).alias("side"), "embedding").unionByName(right.select(F.lit(1).alias("side"), "embedding"))
    found = {r["side"]: (r["n"], r["width"]) for r in sides.groupBy("side").agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("width")).collect()}
    n_left, rows = (found.get(k, (0, 1))[0] for k in (0, 1))
    most = max(how.least, how.cell_bytes // (8 * max((w for _, w in found.values()), default=1)))
    groups = max(1, math.ceil(n_left / min(how.group, most)))
    stripes = max(1, math.ceil(rows / min(how.stripe, most)), min(how.spread, rows // how.least))
    number = lambda n: F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = left.withColumn("part", number(groups)).withColumn("stripe", every(stripes)).withColumn("width", F.size("embedding"))
    right = right.withColumn("stripe", number(stripes)).withColumn("part", every(groups)).withColumn("width", F.size("embedding"))
    keys = ("width", "part", "stripe")
    cells = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_cell(how), "query_id long, vec_id long, score double")
    best = cells.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= how.k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    """op9: the five nearest of every vector whose id is divisible by 50."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(table.where(F.col("vec_id") % 50 == 0), table)
