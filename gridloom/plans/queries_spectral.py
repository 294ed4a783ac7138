"""Eigenvalues, singular values and reductions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import condensed, small, spectral
from ..operators.elementwise import mult_diag
from ..operators.matrix import Matrix, Vector, diagonal, make_triangular, mirrored, row_of, vector_from
from ..operators.products import mult, mvmult, mvupdate, mvupdate2_sym
from .queries_factor import _eye
from .tables import WIDTH, Tables, cells, checked, faults, not_orthonormal, power_means, power_means_sql, shown, where_not

_G, _H, _E, _I = (cells(u, f"SELECT * FROM {u}") for u in ("g", "h", "e", "eye"))


def _around(q: Matrix, b: Matrix, p: Matrix) -> Matrix:
    return mult(1.0, mult(1.0, q, b), p, trans_b=True)


def _svd(t: Tables):
    f = spectral.svd(t.e_rows)
    return shown(mult(1.0, mult_diag(f.u, 1.0, f.s, "right"), f.v, trans_b=True))


def _eigen(t: Tables):
    f = spectral.eigen_sym(make_triangular(t.g, "upper"), "upper")
    return shown(mult(1.0, mult_diag(f.vectors, 1.0, f.values, "right"), f.vectors, trans_b=True))


def _skew(t: Tables) -> Matrix:
    """h with its lower triangle halved."""
    return t.h.with_values(F.when(F.col("i") > F.col("j"), 0.5 * F.col("v")).otherwise(F.col("v")))


def _hessenberg(t: Tables):
    f = condensed.hessenberg(_skew(t))
    return faults(shown(_around(f.q, f.h, f.q)), where_not(f.h, F.col("i") > F.col("j") + 1), not_orthonormal(f.q))


def _tridiagonal(uplo: str):
    def make(t: Tables):
        f = condensed.tridiagonal(make_triangular(t.h, uplo), uplo)
        return faults(shown(_around(f.q, f.middle(), f.q)), not_orthonormal(f.q))

    return make


def _bidiagonal(tall: bool):
    def make(t: Tables):
        f = condensed.bidiagonal(t.e if tall else _skew(t))
        return faults(shown(_around(f.q, f.middle(), f.p)), not_orthonormal(f.q), not_orthonormal(f.p))

    return make


def _band(t: Tables) -> tuple[Vector, Vector]:
    """g's diagonal and w beside it."""
    return diagonal(t.g), Vector(t.w.df.where("i < 63"), WIDTH - 1)


def _trd_eigen(t: Tables):
    f = spectral.tridiagonal_eigen(*_band(t))
    v = f.vectors
    whole = mult(1.0, mult_diag(v, 1.0, f.values, "right"), v, trans_b=True)
    beyond = F.abs(F.col("i") - F.col("j")) > 1
    return faults(shown(whole).where(~beyond), where_not(whole, beyond, 1e-6), not_orthonormal(v))


def _bd_svd(t: Tables):
    f = spectral.bidiagonal_svd(*_band(t))
    whole = mult(1.0, mult_diag(f.u, 1.0, f.s, "right"), f.v, trans_b=True)
    beyond = ~(F.col("j") - F.col("i")).between(0, 1)
    return faults(shown(whole).where(~beyond), where_not(whole, beyond, 1e-6), not_orthonormal(f.u), not_orthonormal(f.v))


def _known(t: Tables) -> Matrix:
    """H*diag(1..64)*H with H = I - 2*u*u^T and u the first embedding's direction: the
    eigenvalues are 1..64."""
    first = row_of(t.e, 0)
    norm = float(first.df.agg(F.sqrt(F.sum(F.col("v") * F.col("v")))).first()[0] or 1.0)
    u = Vector(first.df.select("i", (F.col("v") / norm).alias("v")), WIDTH)
    w = Matrix(t.w.df.select("i", F.col("i").alias("j"), "v"), WIDTH, WIDTH)
    wu = mvmult(1.0, w, u)
    inner = float(u.df.join(wu.df.withColumnRenamed("v", "x"), "i").agg(F.sum(F.col("v") * F.col("x"))).first()[0] or 0.0)
    return mvupdate(1.0, mvupdate2_sym(1.0, w, -2.0, u, wu), 4.0 * inner, u, u, "lower")


def _suppliers(t: Tables) -> tuple[Vector, Vector]:
    """A row for each supplier's place, the mean label on the diagonal and the mean nation beside it."""
    n = t.size("supplier", "s_suppkey")
    mean = lambda table, c: float(t.table(table).agg(F.avg(c)).first()[0])
    a, b = mean("embeddings", "label"), mean("supplier", "s_nationkey")
    return vector_from(t.spark.range(n), "id", F.lit(a), n), vector_from(t.spark.range(n - 1), "id", F.lit(b), n - 1)


def _selected(t: Tables, **wanted):
    """V^T*A*V of the selected vectors V: their values on the diagonal."""
    a = _known(t)
    v = spectral.eigen_sym_selected_vectors(a, **wanted).vectors
    inner = mult(1.0, v, mult(1.0, mirrored(a, "lower"), v), trans_a=True)
    return faults(shown(inner).where("i = j"), where_not(inner, F.col("i") != F.col("j"), 1e-8), not_orthonormal(v))


def _toeplitz(t: Tables, n: int = 200) -> tuple[Vector, Vector]:
    """2 on the diagonal, -1 beside it."""
    return vector_from(t.spark.range(n), "id", F.lit(2.0), n), vector_from(t.spark.range(n - 1), "id", F.lit(-1.0), n - 1)


def _secular_parts(t: Tables) -> tuple[Vector, Vector]:
    """d: g's diagonal with every third element the one before it; z: (1 + i mod 5) * 2, or 0."""
    d = Vector(t.g.df.where("i = j").select(F.explode(F.when(F.col("i") % 3 == 0, F.array(F.col("i"), F.col("i") + 1)).when(F.col("i") % 3 == 2, F.array("i")).otherwise(F.array().cast("array<bigint>"))).alias("i"), "v").where("i < 64"), WIDTH)
    z = vector_from(t.spark.range(WIDTH), "id", F.when(F.col("id") % 7 == 0, 0.0).otherwise(2.0 * (1 + F.col("id") % 5)), WIDTH)
    return d, z


def _secular_vectors(rho: float):
    """V*diag(values)*V^T = diag(d) + rho*z*z^T."""

    def make(t: Tables):
        f = spectral.rank_one_eigen(t.spark, *_secular_parts(t), rho)
        return faults(shown(mult(1.0, mult_diag(f.vectors, 1.0, f.values, "right"), f.vectors, trans_b=True)), not_orthonormal(f.vectors))

    return make


def _secular_sql(rho: float) -> str:
    return (
        "SELECT a.i, b.i AS j, " + f"{rho}" + " * a.z * b.z + CASE WHEN a.i = b.i THEN a.d ELSE 0.0 END AS v FROM (SELECT CAST(r AS BIGINT) AS i, CASE WHEN r % 7 = 0 THEN 0.0 ELSE 2.0 * (1 + r % 5) END AS z, (SELECT v FROM g WHERE g.i = g.j AND g.i = CASE WHEN r % 3 = 1 THEN r - 1 ELSE r END) AS d FROM range(64) x(r)) a, "
        "(SELECT CAST(r AS BIGINT) AS i, CASE WHEN r % 7 = 0 THEN 0.0 ELSE 2.0 * (1 + r % 5) END AS z FROM range(64) y(r)) b"
    )


def _by_label(t: Tables):
    """The Gram matrix of each label's embeddings, a group each: trace and sum of squares of
    its eigenvalues."""
    rows = t.table("embeddings").select(F.col("label").cast("long").alias("key"), F.col("vec_id").alias("r"), F.posexplode("embedding").alias("j", "v"))
    a = rows.select("key", "r", F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v"))
    pairs = a.join(a.select("key", "r", F.col("j").alias("i"), F.col("v").alias("x")), ["key", "r"])
    grams = pairs.groupBy("key", "i", "j").agg(F.sum(F.col("v") * F.col("x")).alias("v"))
    values = small.each(grams, WIDTH, WIDTH, small.tridiagonal_eigen).where("part = 'values'")
    return values.groupBy("key").agg((F.round(F.sum("v"), 4) + 0.0).alias("trace"), (F.round(F.sqrt(F.sum(F.col("v") * F.col("v"))), 4) + 0.0).alias("norm"))


_BAND = "SELECT i, j, v FROM g WHERE i = j UNION ALL SELECT i, i + 1 AS j, v FROM w WHERE i < 63"
_BAND_SYM = _BAND + " UNION ALL SELECT i + 1 AS i, i AS j, v FROM w WHERE i < 63"
_SKEW = "SELECT i, j, CASE WHEN i > j THEN 0.5 * v ELSE v END AS v FROM h"
_BY_LABEL = (
    "WITH r AS (SELECT CAST(label AS BIGINT) AS key, vec_id, unnest(range(len(embedding))) AS j, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), "
    "m AS (SELECT a.key, a.j AS i, b.j, sum(a.v * b.v) AS v FROM r a JOIN r b ON a.key = b.key AND a.vec_id = b.vec_id GROUP BY 1, 2, 3) "
    "SELECT key, round(sum(CASE WHEN i = j THEN v END), 4) + 0.0 AS trace, round(sqrt(sum(v * v)), 4) + 0.0 AS norm FROM m GROUP BY key"
)

QUERIES = {
    "svd": (_svd, _E),
    "svd_orthonormal": (lambda t: _eye((lambda u: mult(1.0, u, u, trans_a=True))(spectral.svd(t.e_rows).u)), _I),
    "singular_values": (lambda t: power_means(spectral.singular_values(t.e_rows), WIDTH, square=True), power_means_sql("g", "SELECT * FROM g", WIDTH)),
    "eigen_sym": (_eigen, _G),
    "eigenvalue_trace": (lambda t: power_means(spectral.eigen_sym(t.g, vectors=False).values.df, WIDTH), power_means_sql("g", "SELECT * FROM g", WIDTH)),
    "eigen_selected_index": (lambda t: spectral.eigen_sym_selected(_known(t), first=10, last=20).select("i", (F.round("v", 6) + 0.0).alias("v")), "SELECT CAST(r AS BIGINT) AS i, r + 1.0::DOUBLE AS v FROM range(10, 20) t(r)"),
    "eigen_selected_range": (
        lambda t: spectral.eigen_sym_selected(_known(t), low=30.5, high=40.5).select("i", (F.round("v", 6) + 0.0).alias("v")),
        "SELECT CAST(r AS BIGINT) AS i, r + 1.0::DOUBLE AS v FROM range(30, 40) t(r)",
    ),
    "eigen_selected_vectors": (lambda t: _selected(t, first=10, last=20), checked("", "SELECT CAST(r AS BIGINT) AS i, CAST(r AS BIGINT) AS j, r + 11.0::DOUBLE AS v FROM range(10) t(r)")),
    "eigen_selected_vectors_range": (lambda t: _selected(t, low=30.5, high=40.5), checked("", "SELECT CAST(r AS BIGINT) AS i, CAST(r AS BIGINT) AS j, r + 31.0::DOUBLE AS v FROM range(10) t(r)")),
    "eigen_by_label": (_by_label, _BY_LABEL),
    "hessenberg": (_hessenberg, checked("h", _SKEW)),
    "tridiagonal_lower": (_tridiagonal("lower"), checked("h", "SELECT * FROM h")),
    "tridiagonal_upper": (_tridiagonal("upper"), checked("h", "SELECT * FROM h")),
    "bidiagonal": (_bidiagonal(False), checked("h", _SKEW)),
    "bidiagonal_tall": (_bidiagonal(True), checked("e", "SELECT * FROM e")),
    "tridiagonal_eigen": (_trd_eigen, checked("g w", _BAND_SYM)),
    "tridiagonal_values": (lambda t: power_means(spectral.tridiagonal_eigen(*_band(t), vectors=False).values.df, WIDTH), power_means_sql("g w", _BAND_SYM, WIDTH)),
    "bidiagonal_svd": (_bd_svd, checked("g w", _BAND)),
    "dqds": (
        lambda t: power_means(spectral.bidiagonal_values(*_band(t)), WIDTH, square=True),
        power_means_sql("g w", f"SELECT a.j AS i, b.j AS j, sum(a.v * b.v) AS v FROM ({_BAND}) a JOIN ({_BAND}) b ON a.i = b.i GROUP BY 1, 2", WIDTH),
    ),
    "bisect_trace": (lambda t: power_means(spectral.bisect(t.spark, *_band(t)), WIDTH), power_means_sql("g w", _BAND_SYM, WIDTH)),
    "bisect_selected": (
        lambda t: spectral.bisect(t.spark, *_suppliers(t), 3, 8).select("i", (F.round("v", 6) + 0.0).alias("v")),
        "SELECT CAST(r AS BIGINT) AS i, round((SELECT avg(label) FROM embeddings) - 2 * (SELECT avg(s_nationkey) FROM supplier) * cos((r + 1) * pi() / (SELECT max(s_suppkey) + 2 FROM supplier)), 6) + 0.0 AS v FROM range(3, 8) t(r)",
    ),
    "sturm_counts": (
        lambda t: spectral.sturm_counts(t.spark, *_toeplitz(t), t.table("part").select(((F.col("p_partkey") % 41) / 10.0 + 0.03).alias("x")).distinct()),
        "SELECT x, CAST((SELECT count(*) FROM range(200) d(q) WHERE 2 - 2 * cos((q + 1) * pi() / 201) < x) AS INTEGER) AS count FROM (SELECT DISTINCT (p_partkey % 41) / 10.0::DOUBLE + 0.03 AS x FROM part) p",
    ),
    "secular_vectors": (_secular_vectors(0.7), checked("g", _secular_sql(0.7))),
    "secular_vectors_negative": (_secular_vectors(-0.7), checked("g", _secular_sql(-0.7))),
    "secular_roots": (lambda t: power_means(spectral.secular_roots(t.spark, *_secular_parts(t), 0.7), WIDTH), power_means_sql("g", _secular_sql(0.7), WIDTH)),
}
