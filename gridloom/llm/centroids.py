"""Centroid clustering of integer vectors, exact to the last unit.

Squared distances come from |x|^2 - 2 x.c + |c|^2 in blocked float64 products.  With no
component above 2^22 all terms and their sums stay below 2^53, so floating point
computes them without rounding; vectors or centroids beyond that bound go through
integers instead (64-bit, or Python's where those could overflow too).  Blocks of rows
are an RDD whose treeAggregate adds the sums of each round.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

#: 64 components of at most 2^22: 64 * (2^22 + 2^22)^2 = 2^52, below 2^53.
FLOAT_MOST = 1 << 22
#: 64 * (2^27 + 2^27)^2 = 2^62, below 2^63.
INT_MOST = 1 << 27
LONG_MOST = (1 << 63) - 1


@dataclass(frozen=True)
class Clustering:
    """k centroids; rounds of assignment and update; components of a vector (64 at most,
    on which the bounds rest); scale of the integers; salt of the order in which the first
    k are chosen; rows of a block."""

    k: int = 40
    rounds: int = 5
    components: int = 64
    scale: int = 256
    salt: str = "2:"
    rows: int = 4096


def usable(how: Clustering, vector: str = "embedding"):
    """True for vectors of the right size without null or non-finite components."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce((F.size(vector) == how.components) & ~F.exists(vector, odd), F.lit(False))


def whole(x: float, scale: int) -> int:
    """floor(scale * x) without overflow."""
    return scale * int(x) if abs(x) >= 1 << 52 else math.floor(scale * x)


class Centers:
    """Centroids as Python integers, and as floats those that are small enough."""

    def __init__(self, values: list[list[int]]):
        self.values = values
        small = [max(map(abs, v), default=0) <= FLOAT_MOST for v in values]
        self.small = np.flatnonzero(small)
        self.large = np.flatnonzero(~np.array(small, bool))
        self.matrix = np.array([values[k] for k in self.small], np.float64).reshape(len(self.small), len(values[0]))
        self.norms = (self.matrix * self.matrix).sum(axis=1)

    @staticmethod
    def _integers(rows: list[list[int]], centers: list[list[int]]) -> np.ndarray:
        """Squared distances by integer arithmetic, as Python integers."""
        most = max((abs(v) for x in (*rows, *centers) for v in x), default=0)
        kind = np.int64 if most <= INT_MOST else object
        x = np.array(rows, kind)
        return np.stack([((x - np.array(c, kind)) ** 2).sum(axis=1) for c in centers], axis=1).astype(object)

    def nearest(self, x: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, list[int]]]:
        """(cluster, distance, scaled rows, rows that are too large for floats) of raw rows.

        Distances are int64, or Python integers if a large vector or centroid is there.
        Ties go to the smaller number."""
        with np.errstate(over="ignore"):
            scaled = np.floor(x * scale)
        tame = np.abs(scaled).max(axis=1, initial=0.0) <= FLOAT_MOST
        large = {int(r): [whole(v, scale) for v in x[r].tolist()] for r in np.flatnonzero(~tame)}
        scaled[~tame] = 0
        if len(self.small):
            # Blocked product: |x|^2 - 2 x.c + |c|^2, every term an exact integer.
            d = (scaled * scaled).sum(axis=1)[:, None] - 2 * (scaled @ self.matrix.T) + self.norms
            at = d.argmin(axis=1)
            cluster, distance = self.small[at], d[np.arange(len(d)), at].astype(np.int64)
        else:
            cluster, distance = np.full(len(x), -1), np.zeros(len(x), np.int64)
        if not large and not len(self.large):
            return cluster, distance, scaled, large
        distance = distance.astype(object)
        if len(self.large) and tame.any():
            rows = np.flatnonzero(tame)
            far = self._integers(scaled[rows].astype(np.int64).tolist(), [self.values[k] for k in self.large])
            for r, own in zip(rows.tolist(), far, strict=True):
                best = min((int(v), int(k)) for v, k in zip(own, self.large, strict=True))
                if cluster[r] < 0 or best < (int(distance[r]), int(cluster[r])):
                    distance[r], cluster[r] = best
        if large:
            far = self._integers(list(large.values()), self.values)
            for r, own in zip(large, far, strict=True):
                distance[r], cluster[r] = min((int(v), k) for k, v in enumerate(own))
        return cluster, distance, scaled, large


def _pack(how: Clustering):
    """mapInArrow: rows (vec_id, embedding) to blocks of ids and one buffer of components."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, how.rows):
                part = batch.slice(at, how.rows)
                flat = part.column("embedding").flatten().to_numpy(zero_copy_only=False)
                ids = part.column("vec_id")
                offsets = pa.array([0, len(ids)], pa.int32())
                yield pa.record_batch([pa.ListArray.from_arrays(offsets, ids), pa.array([np.ascontiguousarray(flat).tobytes()], pa.binary())], names=["ids", "data"])

    return run


def _matrix(data: bytes, kind: str, how: Clustering) -> np.ndarray:
    return np.frombuffer(data, kind).astype(np.float64).reshape(-1, how.components)


def start(vectors: DataFrame, how: Clustering) -> list[list[int]]:
    """The k vectors whose salted ids have the smallest hashes, in that order; ties go by
    components, rows without an id come last."""
    order = F.sha2(F.concat(F.lit(how.salt), F.col("vec_id").cast("string")), 256)
    first = vectors.orderBy(order.asc_nulls_last(), "embedding").limit(how.k).collect()
    return [[whole(float(v), how.scale) for v in r["embedding"]] for r in first]


def cluster(vectors: DataFrame, how: Clustering = Clustering()) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector of `vectors` (vec_id, embedding) that takes part.

    Vectors of another size, null ones and those with null or non-finite components are
    left out; all others are kept row for row, repeated or without an id.  With fewer than
    k vectors there are as many centroids.  An empty table has no rows.  What exceeds the
    range of a long (vectors beyond 10^8) is null; it is computed rightly all the same.

    What reaches the driver are k vectors at the start and k sums a round.
    """
    if how.components > 64:
        raise ValueError("the bounds of exact products hold for 64 components at most")
    fit = vectors.select("vec_id", "embedding").where(usable(how))
    kind = {"float": "<f4", "double": "<f8"}[fit.schema["embedding"].dataType.elementType.simpleString()]
    centers = start(fit, how)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not centers:
        return fit.sparkSession.createDataFrame([], schema)
    blocks = written(fit.mapInArrow(_pack(how), "ids array<long>, data binary"), "vectors")
    data = blocks.select("data").rdd
    for _ in range(how.rounds):
        centers = _moved(centers, *_sums(data, Centers(centers), kind, how))
    now = Centers(centers)
    within = _inertia(data, now, kind, how)
    held = lambda v: v if v <= LONG_MOST else None
    parts, total = [held(within.get(k, 0)) for k in range(len(centers))], held(sum(within.values()))
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]

    def assign(batches):
        each, hashes = pa.array(parts, pa.int64()), pa.array(names, pa.string())
        for batch in batches:
            for ids, raw in zip(batch.column("ids"), batch.column("data"), strict=True):
                own, distance, *_ = now.nearest(_matrix(raw.as_buffer(), kind, how), how.scale)
                far = pa.array([held(d) for d in distance.tolist()], pa.int64())
                own = pa.array(own, pa.int32())
                yield pa.record_batch([ids.values, own, far, each.take(own), pa.array([total] * len(own), pa.int64()), hashes.take(own)], names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return blocks.mapInArrow(assign, schema)


def _inertia(data, centers: Centers, kind: str, how: Clustering) -> dict[int, int]:
    """Sum of the distances of each cluster."""

    def add(total, row):
        own, distance, *_ = centers.nearest(_matrix(row["data"], kind, how), how.scale)
        out = dict(total)
        for k in np.unique(own).tolist():
            out[k] = out.get(k, 0) + sum(distance[own == k].tolist())
        return out

    def both(a, b):
        return {k: a.get(k, 0) + b.get(k, 0) for k in a.keys() | b.keys()}

    return data.treeAggregate({}, add, both)


def _sums(data, centers: Centers, kind: str, how: Clustering) -> tuple[np.ndarray, np.ndarray, dict]:
    """Sums and counts of each cluster: int64 of the small vectors, and Python integers
    of the large ones by cluster."""
    k, width = len(centers.values), how.components

    def add(total, row):
        sums, counts, beyond = total
        own, _, scaled, large = centers.nearest(_matrix(row["data"], kind, how), how.scale)
        chosen = np.zeros((len(own), k))
        chosen[np.arange(len(own)), own] = 1
        counts = counts + chosen.sum(axis=0).astype(np.int64)
        # At most `rows` values of 2^22 each: exact in floats, and in int64 for 2^41 rows.
        sums = sums + (chosen.T @ scaled).astype(np.int64)
        for r, v in large.items():
            beyond = _joined(beyond, {int(own[r]): v})
        return sums, counts, beyond

    def both(a, b):
        return a[0] + b[0], a[1] + b[1], _joined(a[2], b[2])

    return data.treeAggregate((np.zeros((k, width), np.int64), np.zeros(k, np.int64), {}), add, both)


def _joined(a: dict, b: dict) -> dict:
    out = dict(a)
    for c, v in b.items():
        out[c] = [x + y for x, y in zip(out[c], v, strict=True)] if c in out else list(v)
    return out


def _moved(centers: list[list[int]], sums: np.ndarray, counts: np.ndarray, beyond: dict) -> list[list[int]]:
    """floor(sum / count) by component; a centroid without vectors stays."""
    out = []
    for c, old in enumerate(centers):
        n = int(counts[c])
        total = sums[c].tolist()
        if c in beyond:
            total = [x + y for x, y in zip(total, beyond[c], strict=True)]
        out.append([t // n for t in total] if n else old)
    return out


def query(spark, sf_dir: str) -> DataFrame:
    """op13: cluster, distance and inertia of every vector of 64 components."""
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def oracle_sql(how: Clustering = Clustering()) -> str:
    """The same in SQL: a common table expression for each assignment and each update."""
    parts = [
        f"""fit AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, v, list_dot_product(v, v) AS norm
  FROM (SELECT vec_id, list_transform(embedding, lambda x: floor({how.scale} * CAST(x AS DOUBLE))) AS v FROM embeddings
        WHERE len(embedding) = {how.components} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {how.components}))""",
        f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h) - 1 AS cluster, v FROM (SELECT sha256('{how.salt}' || vec_id) AS h, v FROM fit ORDER BY h LIMIT {how.k}))""",
    ]
    for k in range(how.rounds + 1):
        parts.append(
            f"""a{k} AS MATERIALIZED (
  SELECT rid, CAST(best[2] AS INTEGER) AS cluster, CAST(best[1] AS BIGINT) AS distance FROM (
    SELECT rid, min([norm - 2 * list_dot_product(f.v, c.v) + list_dot_product(c.v, c.v), CAST(cluster AS DOUBLE)]) AS best FROM fit f, c{k} c GROUP BY rid))"""
        )
        if k < how.rounds:
            parts.append(
                f"""c{k + 1} AS MATERIALIZED (
  SELECT c.cluster, coalesce(n.v, c.v) AS v FROM c{k} c LEFT JOIN (
    SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY p) AS v FROM (
      SELECT cluster, p, CAST(sum(f.v[p]) AS BIGINT) AS s, count(*) AS n FROM a{k} JOIN fit f USING (rid), (SELECT unnest(range(1, {how.components + 1})) AS p) GROUP BY cluster, p) GROUP BY cluster) n USING (cluster))"""
            )
    last = how.rounds
    return f"""WITH {", ".join(parts)}
SELECT f.vec_id, a.cluster, a.distance, CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(a.distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(c.v, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
FROM a{last} a JOIN fit f USING (rid) JOIN c{last} c USING (cluster)"""
