"""Construction, views, element-wise operators, reductions and sorting."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import eft, scalar
from ..operators import elementwise as ew
from ..operators import matrix as mx
from ..operators import reductions as rd
from ..operators import sorting
from ..sources import json_matrix, matrix_market
from .tables import WIDTH, Tables, cells, entries, number, rounded, shown, sql


def _market(t: Tables, form: str) -> mx.Matrix:
    """g through a Matrix-Market file."""
    from ..functions.cut import cut as written

    place = written(t.spark.range(1), "market").inputFiles()[0].rsplit("/", 1)[0] + "-mm"
    matrix_market.write(t.g, place, form, symmetric=form == "coordinate")
    return matrix_market.read(t.spark, place, mirror=True)


def _json(t: Tables, sparse: bool) -> mx.Matrix:
    texts = json_matrix.write(t.g, sparse).withColumn("key", F.lit(0))
    return mx.Matrix(json_matrix.read(texts).select("i", "j", "v"), WIDTH, WIDTH)


def _sort_eigen(t: Tables):
    d, u, *_ = sorting.sort_eigen(mx.diagonal(t.g), t.g)
    return u.df.join(d.df.select(F.col("i").alias("j"), F.col("v").alias("d")), "j").select("i", "j", (F.round("v", 6) + 0.0).alias("v"), (F.round("d", 6) + 0.0).alias("d"))


def _triples(t: Tables):
    """(k, a, b, c) by part: small numbers for the closed forms."""
    return t.table("part").select(F.col("p_partkey").alias("k"), (F.col("p_size") - 25.0).alias("a"), (F.col("p_partkey") % 17 - 8.0).alias("b"), (F.col("p_retailprice") / 100 - 12.0).alias("c"))


_TRIPLES = "p AS (SELECT p_partkey AS k, p_size - 25.0::DOUBLE AS a, p_partkey % 17 - 8.0::DOUBLE AS b, p_retailprice / 100 - 12.0::DOUBLE AS c FROM part)"


def _columns(t: Tables, **made):
    return _triples(t).select("k", *[(F.round(v, 6) + 0.0).alias(n) for n, v in made.items()])


def _two(make, names):
    def f(t: Tables):
        return _columns(t, **dict(zip(names, make(F.col("a"), F.col("b"), F.col("c")), strict=True)))

    return f



def _eigen_faults(a, b, c):
    first, _ = scalar.sym_eigen2x2(a, b, c)
    x, y = scalar.sym_eigen2x2_vector(a, b, c)
    off = F.abs(a * x + b * y - first * x) + F.abs(b * x + c * y - first * y)
    return off, F.hypot(x, y) - 1, F.when(F.when(F.abs(x) >= F.abs(y), x).otherwise(y) < 0, 1.0).otherwise(0.0)


def _svd_parts(f, g, h):
    """Of [[f, g], [0, h]], turned from both sides."""
    cl, sl, cr, sr = scalar.svd2x2_vectors(f, g, h)
    p, q, r, s = f * cr + g * sr, g * cr - f * sr, h * sr, h * cr
    return F.abs(cl * p + sl * r), F.abs(cl * s - sl * q), F.abs(cl * q + sl * s) + F.abs(cl * r - sl * p)


def _between(*large: float):
    """The embedding between numbers that cancel but swallow it in a plain sum."""
    ends = [F.lit(x) for x in large]
    return F.concat(F.array(*ends), F.transform("embedding", lambda v: v.cast("double")), F.array(*[-x for x in reversed(ends)]))


def _norm_two(t: Tables):
    """Of a matrix whose eigenvalues are 1..64."""
    from .queries_spectral import _known

    return rounded(rd.norm(mx.mirrored(_known(t), "lower"), "two"))


#: Of the tables, in SQL: the number of suppliers' places and the sum of all labels.
_SUPPLIERS, _LABELS = "(SELECT max(s_suppkey) + 1 FROM supplier)", "(SELECT sum(label) FROM embeddings)"


def _drawn(make, low: float, high: float, mean: float, variance: float):
    """What holds for independent elements of a distribution: range, mean and variance within
    five deviations, quartiles, neighbours that don't correlate; and elements that only
    depend on their position and the seed."""

    def f(t: Tables):
        # As many elements as the table of embeddings has, with a seed from its labels.
        rows, cols, seed = t.n, WIDTH, int(t.labels)
        a, n = make(t.spark, rows, cols, seed), rows * cols
        kurtosis = 1.8 if low == 0 else 3.0
        other = mx.submatrix(make(t.spark, rows + 50, cols + 20, seed), 0, 0, rows, cols).df.select("i", "j", F.col("v").alias("x"))
        beside = a.df.select("i", (F.col("j") + 1).alias("j"), F.col("v").alias("y"))
        both = a.df.join(other, ["i", "j"], "left").join(beside, ["i", "j"], "left")
        near = lambda x, want, deviation: F.abs(x - want) < 5 * deviation
        return both.agg(
            F.count("*").alias("n"),
            ((F.min("v") >= low) & (F.max("v") < high)).alias("inside"),
            near(F.avg("v"), mean, (variance / n) ** 0.5).alias("mean"),
            near(F.var_pop("v"), variance, variance * ((kurtosis - 1) / n) ** 0.5).alias("variance"),
            near(F.avg(F.when(F.col("v") < mean, 1.0).otherwise(0.0)), 0.5, 0.5 / n**0.5).alias("spread"),
            near(F.avg((F.col("v") - mean) * (F.col("y") - mean)), 0.0, variance / n**0.5).alias("apart"),
            (F.sum(F.when(F.col("v") == F.col("x"), 0).otherwise(1)) == 0).alias("same"),
        )

    return f


QUERIES = {
    # construction and round trips
    "from_table": (lambda t: shown(t.s), cells("s", "SELECT * FROM s")),
    "from_arrays": (lambda t: shown(t.e), cells("e", "SELECT * FROM e")),
    "set_values_symmetric": (
        lambda t: shown(mx.generate(t.spark, *[t.size("supplier", "s_suppkey")] * 2, lambda i, j: 2.0 * i + 3.0 * j + t.labels, symmetric=True)),
        f"SELECT CAST(a.r AS BIGINT) AS i, CAST(b.r AS BIGINT) AS j, CAST(2.0 * greatest(a.r, b.r) + 3.0 * least(a.r, b.r) + {_LABELS} AS DOUBLE) AS v FROM range({_SUPPLIERS}) a(r), range({_SUPPLIERS}) b(r)",
    ),
    "set_values_unit_lower": (
        lambda t: shown(mx.generate(t.spark, t.size("supplier", "s_suppkey"), 20, lambda i, j: i - 2.0 * j + t.labels, uplo="lower", unit=True)),
        f"SELECT CAST(a.r AS BIGINT) AS i, CAST(b.r AS BIGINT) AS j, CAST(CASE WHEN a.r = b.r THEN 1.0 ELSE a.r - 2.0 * b.r + {_LABELS} END AS DOUBLE) AS v FROM range({_SUPPLIERS}) a(r), range(20) b(r) WHERE a.r >= b.r",
    ),
    "set_all": (lambda t: shown(mx.generate(t.spark, t.size("supplier", "s_suppkey"), 20, lambda i, j: F.lit(t.labels + 0.5))), f"SELECT CAST(a.r AS BIGINT) AS i, CAST(b.r AS BIGINT) AS j, CAST({_LABELS} + 0.5 AS DOUBLE) AS v FROM range({_SUPPLIERS}) a(r), range(20) b(r)"),
    "uniform_elements": (_drawn(mx.uniform, 0.0, 1.0, 0.5, 1 / 12), "SELECT CAST((max(vec_id) + 1) * 64 AS BIGINT) AS n, true AS inside, true AS mean, true AS variance, true AS spread, true AS apart, true AS same FROM embeddings"),
    "normal_elements": (_drawn(mx.normal, -7.0, 7.0, 0.0, 1.0), "SELECT CAST((max(vec_id) + 1) * 64 AS BIGINT) AS n, true AS inside, true AS mean, true AS variance, true AS spread, true AS apart, true AS same FROM embeddings"),
    "set_at": (lambda t: shown(mx.set_at(t.g, 200, -1.5)), cells("g", "SELECT i, j, CASE WHEN i = 8 AND j = 3 THEN -1.5 ELSE v END AS v FROM g")),
    "make_triangular": (lambda t: shown(mx.make_triangular(t.g, "lower")), cells("g", "SELECT * FROM g WHERE i >= j")),
    "make_triangular_unit": (lambda t: shown(mx.make_triangular(t.g, "upper", unit=True)), cells("g", "SELECT i, j, CASE WHEN i = j THEN 1.0 ELSE v END AS v FROM g WHERE i <= j")),
    "market_array": (lambda t: shown(_market(t, "array")), cells("g", "SELECT * FROM g")),
    "market_coordinate_symmetric": (lambda t: shown(_market(t, "coordinate")), cells("g", "SELECT * FROM g")),
    "json_dense": (lambda t: shown(_json(t, False)), cells("g", "SELECT * FROM g")),
    "json_sparse": (lambda t: shown(_json(t, True)), cells("g", "SELECT * FROM g")),
    "to_dense": (
        lambda t: shown(mx.dense(mx.submatrix(t.s, 0, 0, 5, 50))),
        cells("s", "SELECT CAST(a.r AS BIGINT) AS i, CAST(b.r AS BIGINT) AS j, coalesce(s.v, 0.0) AS v FROM range(5) a(r) CROSS JOIN range(50) b(r) LEFT JOIN s ON s.i = a.r AND s.j = b.r"),
    ),
    "pretty_print": (
        lambda t: mx.pretty(t.g, 3).select("i", *[(F.round(f"c{k}", 6) + 0.0).alias(f"c{k}") for k in range(3)]),
        sql("g", "SELECT i, " + ", ".join(f"round(max(CASE WHEN j = {k} THEN v END), 6) + 0.0 AS c{k}" for k in range(3)) + " FROM g WHERE i < 3 AND j < 3 GROUP BY i"),
    ),
    # views and access
    "get_element": (lambda t: mx.get(t.g, -1, 3).select((F.round("v", 6) + 0.0).alias("value")), number("g", "(SELECT v FROM g WHERE i = 63 AND j = 3)")),
    "get_at": (lambda t: mx.get_at(t.g, 200).select((F.round("v", 6) + 0.0).alias("value")), number("g", "(SELECT v FROM g WHERE i = 8 AND j = 3)")),
    "set_element": (lambda t: shown(mx.set_value(t.g, 2, 5, 7.5)), cells("g", "SELECT i, j, CASE WHEN i = 2 AND j = 5 THEN 7.5 ELSE v END AS v FROM g")),
    "row_view": (lambda t: shown(mx.row_of(t.g, 7)), entries("g", "SELECT j AS i, v FROM g WHERE i = 7")),
    "column_view": (lambda t: shown(mx.column_of(t.e, -2)), entries("e", "SELECT i, v FROM e WHERE j = 62")),
    "submatrix": (lambda t: shown(mx.submatrix(t.g, 10, 20, 30, -1)), cells("g", "SELECT i - 10 AS i, j - 20 AS j, v FROM g WHERE i BETWEEN 10 AND 39 AND j >= 20")),
    "strided_view": (lambda t: shown(mx.strided(t.g, 1, 2, 10, 8, 3, 4)), cells("g", "SELECT (i - 1) // 3 AS i, (j - 2) // 4 AS j, v FROM g WHERE i BETWEEN 1 AND 28 AND j BETWEEN 2 AND 30 AND (i - 1) % 3 = 0 AND (j - 2) % 4 = 0")),
    "subvector": (lambda t: shown(mx.subvector(t.x, 5, 100)), entries("x", "SELECT i - 5 AS i, v FROM x WHERE i BETWEEN 5 AND 104")),
    "diagonal_above": (lambda t: shown(mx.diagonal(t.g, 3)), entries("g", "SELECT i, v FROM g WHERE j - i = 3")),
    "diagonal_below": (lambda t: shown(mx.diagonal(t.g, -2)), entries("g", "SELECT j AS i, v FROM g WHERE j - i = -2")),
    "column_as_row": (lambda t: shown(mx.as_row(mx.column_of(t.g, 4))), cells("g", "SELECT CAST(0 AS BIGINT) AS i, i AS j, v FROM g WHERE j = 4")),
    # element by element
    "transpose_copy": (lambda t: shown(ew.copy(t.s, trans=True)), cells("s", "SELECT j AS i, i AS j, v FROM s")),
    "vector_swap": (lambda t: shown(ew.swap(t.x, mx.column_of(t.e, 0))[0]), entries("e", "SELECT i, v FROM e WHERE j = 0")),
    "vector_scale": (lambda t: shown(ew.scale(t.x, 2.5)), entries("x", "SELECT i, 2.5 * v AS v FROM x")),
    "matrix_scale_triangle": (lambda t: shown(ew.scale(t.g, -0.5, "lower", unit=True)), cells("g", "SELECT i, j, CASE WHEN i > j THEN -0.5 * v ELSE v END AS v FROM g")),
    "add_constant_triangle": (lambda t: shown(ew.add_constant(t.g, 1.5, "upper")), cells("g", "SELECT i, j, CASE WHEN i <= j THEN v + 1.5 ELSE v END AS v FROM g")),
    "scale_to": (lambda t: shown(ew.scale_to(t.g, 4.0, 10.0)), cells("g", "SELECT i, j, v * 2.5 AS v FROM g")),
    "plus_transposed": (
        lambda t: shown(ew.plus(2.0, mx.submatrix(t.g, 0, 0, 64, 64), -1.0, mx.make_triangular(t.g, "lower"), trans=True)),
        cells("g", "SELECT i, j, 2.0 * v - CASE WHEN i <= j THEN v ELSE 0.0 END AS v FROM g"),
    ),
    "plus_absolute_lower": (lambda t: shown(ew.plus(1.0, t.g, 3.0, t.g, uplo="lower", absolute=True)), cells("g", "SELECT i, j, CASE WHEN i >= j THEN v + 3.0 * abs(v) ELSE v END AS v FROM g")),
    "plus_constant": (lambda t: shown(ew.plus(2.0, t.g, 3.0, mx.identity(t.spark, 1))), cells("g", "SELECT i, j, 2.0 * v + 3.0 AS v FROM g")),
    "elementwise_product": (lambda t: shown(ew.multiply(t.g, t.h)), cells("g h", "SELECT g.i, g.j, g.v * h.v AS v FROM g JOIN h ON g.i = h.i AND g.j = h.j")),
    "apply_function": (lambda t: shown(ew.apply(t.g, lambda v: F.sqrt(F.abs(v)) + 1, "upper")), cells("g", "SELECT i, j, CASE WHEN i <= j THEN sqrt(abs(v)) + 1 ELSE v END AS v FROM g")),
    "iterate_until": (
        lambda t: ew.iterate(t.e, lambda v: v + 0.2),
        sql("e", ", c AS (SELECT i, j, v, j * (SELECT max(i) + 1 FROM e) + i AS pos FROM e), f AS (SELECT min(pos) AS stop FROM c WHERE v + 0.2 < 0) SELECT count(*) AS visited, max(stop) % (SELECT max(i) + 1 FROM e) AS stopped_i, max(stop) // (SELECT max(i) + 1 FROM e) AS stopped_j FROM c, f WHERE stop IS NULL OR pos <= stop"),
    ),
    "all_close": (lambda t: ew.all_close(t.g, ew.scale(t.g, 1 + 1e-9)), "SELECT true AS close"),
    "not_close": (lambda t: ew.all_close(t.g, t.h), "SELECT false AS close"),
    "mult_diag_left": (lambda t: shown(ew.mult_diag(t.g, 2.0, t.w)), cells("g w", "SELECT g.i, g.j, 2.0 * w.v * g.v AS v FROM g JOIN w ON g.i = w.i")),
    "mult_diag_right": (lambda t: shown(ew.mult_diag(t.e, 1.0, t.w, "right")), cells("e w", "SELECT e.i, e.j, w.v * e.v AS v FROM e JOIN w ON e.j = w.i")),
    "solve_diag_left": (lambda t: shown(ew.solve_diag(t.g, 3.0, t.w)), cells("g w", "SELECT g.i, g.j, 3.0 * g.v / w.v AS v FROM g JOIN w ON g.i = w.i")),
    "solve_diag_right": (lambda t: shown(ew.solve_diag(t.g, 1.0, t.w, "right")), cells("g w", "SELECT g.i, g.j, g.v / w.v AS v FROM g JOIN w ON g.j = w.i")),
    # reductions
    "asum": (lambda t: rounded(rd.asum(mx.column_of(t.e, 3))), number("e", "(SELECT sum(abs(v)) FROM e WHERE j = 3)")),
    "sum_elements": (lambda t: rounded(rd.total(t.s)), number("s", "(SELECT sum(v) FROM s)")),
    "nrm2": (lambda t: rounded(rd.nrm2(mx.column_of(t.e, 3))), number("e", "(SELECT sqrt(sum(v * v)) FROM e WHERE j = 3)")),
    "dot": (lambda t: rounded(rd.dot(mx.column_of(t.e, 0), mx.column_of(t.e, 1))), number("e", "(SELECT sum(a.v * b.v) FROM e a JOIN e b ON a.i = b.i WHERE a.j = 0 AND b.j = 1)")),
    "adot": (lambda t: rounded(rd.dot(t.x, mx.column_of(t.e, 1), alpha=2.0, start=5.0)), number("e x", "(SELECT 5.0 + 2.0 * sum(x.v * e.v) FROM e JOIN x ON e.i = x.i WHERE j = 1)")),
    "amax": (lambda t: rounded(rd.amax(t.e)), number("e", "(SELECT max(abs(v)) FROM e)")),
    "iamax": (lambda t: rd.iamax(mx.column_of(t.e, 5)), sql("e", "SELECT i AS value FROM e WHERE j = 5 ORDER BY abs(v) DESC, i LIMIT 1")),
    "iamin": (lambda t: rd.iamin(t.x), sql("x", "SELECT min(i) AS value FROM x WHERE v = (SELECT min(v) FROM x)")),
    "pivot_index": (lambda t: rd.iamax(t.x, base=1), sql("x", "SELECT min(i) + 1 AS value FROM x WHERE v = (SELECT max(v) FROM x)")),
    "norm_one": (lambda t: rounded(rd.norm(t.e, "one")), number("e", "(SELECT max(s) FROM (SELECT sum(abs(v)) AS s FROM e GROUP BY j) q)")),
    "norm_inf": (lambda t: rounded(rd.norm(t.e, "inf")), number("e", "(SELECT max(s) FROM (SELECT sum(abs(v)) AS s FROM e GROUP BY i) q)")),
    "norm_frobenius": (lambda t: rounded(rd.norm(t.e, "frobenius")), number("e", "(SELECT sqrt(sum(v * v)) FROM e)")),
    "norm_two": (_norm_two, "SELECT 64.0::DOUBLE AS value"),
    "norm_triangle": (lambda t: rounded(rd.norm(t.g, "inf", "lower", unit=True)), number("g", "(SELECT max(s) FROM (SELECT i, sum(CASE WHEN i = j THEN 1.0 ELSE abs(v) END) AS s FROM g WHERE i >= j GROUP BY i) q)")),
    "norm_symmetric": (lambda t: rounded(rd.norm(mx.make_triangular(t.g, "upper"), "frobenius", "upper", symmetric=True)), number("g", "(SELECT sqrt(sum(v * v)) FROM g)")),
    # vectors
    "axpy": (lambda t: shown(ew.axpy(t.x, 2.0, mx.column_of(t.e, 0))), entries("e x", "SELECT x.i, x.v + 2.0 * e.v AS v FROM x JOIN e ON e.i = x.i WHERE e.j = 0")),
    "axpby": (lambda t: shown(ew.axpby(0.5, t.x, -1.0, mx.column_of(t.e, 2))), entries("e x", "SELECT x.i, 0.5 * x.v - e.v AS v FROM x JOIN e ON e.i = x.i WHERE e.j = 2")),
    "rotate_vectors": (
        lambda t: shown(ew.rotate_vectors(t.x, mx.column_of(t.e, 1), 0.6, 0.8)[1]),
        entries("e x", "SELECT x.i, 0.6 * e.v - 0.8 * x.v AS v FROM x JOIN e ON e.i = x.i WHERE e.j = 1"),
    ),
    "givens_scalar": (
        _two(lambda a, b, c: scalar.givens(a, b), ("c", "s", "r")),
        f"WITH {_TRIPLES} SELECT k, round(CASE WHEN b = 0 THEN 1.0 WHEN a = 0 THEN 0.0 ELSE a / sqrt(a * a + b * b) END, 6) + 0.0 AS c, round(CASE WHEN b = 0 THEN 0.0 WHEN a = 0 THEN 1.0 ELSE b / sqrt(a * a + b * b) END, 6) + 0.0 AS s, round(CASE WHEN b = 0 THEN a WHEN a = 0 THEN b ELSE sqrt(a * a + b * b) END, 6) + 0.0 AS r FROM p",
    ),
    "rotate_scalar": (_two(lambda a, b, c: scalar.rotate(a, b, F.lit(0.6), F.lit(0.8)), ("v0", "v1")), f"WITH {_TRIPLES} SELECT k, round(0.6 * a + 0.8 * b, 6) + 0.0 AS v0, round(0.6 * b - 0.8 * a, 6) + 0.0 AS v1 FROM p"),
    "sym_eigen2x2": (
        _two(lambda a, b, c: (F.least(*scalar.sym_eigen2x2(a, b, c)), F.greatest(*scalar.sym_eigen2x2(a, b, c))), ("low", "high")),
        f"WITH {_TRIPLES} SELECT k, round((a + c) / 2 - sqrt((a - c) * (a - c) / 4 + b * b), 6) + 0.0 AS low, round((a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b), 6) + 0.0 AS high FROM p",
    ),
    "svd2x2": (
        _two(lambda a, b, c: scalar.svd2x2(a, b, c), ("small", "large")),
        f"WITH {_TRIPLES} SELECT k, round(abs(sqrt((a + c) * (a + c) + b * b) - sqrt((a - c) * (a - c) + b * b)) / 2, 6) + 0.0 AS small, round((sqrt((a + c) * (a + c) + b * b) + sqrt((a - c) * (a - c) + b * b)) / 2, 6) + 0.0 AS large FROM p",
    ),
    "sym_eigen2x2_vector": (
        # |A*x - first*x|, |x| - 1 and the sign rule: all 0.
        _two(lambda a, b, c: _eigen_faults(a, b, c), ("off", "unit", "sign")),
        f"WITH {_TRIPLES} SELECT k, 0.0::DOUBLE AS off, 0.0::DOUBLE AS unit, 0.0::DOUBLE AS sign FROM p",
    ),
    "svd2x2_vectors": (
        # The diagonal that the rotations leave, and what is left beside it.
        _two(lambda a, b, c: _svd_parts(a, b, c), ("large", "small", "beside")),
        f"WITH {_TRIPLES}, s AS (SELECT k, a, c, sqrt((a + c) * (a + c) + b * b) AS x, sqrt((a - c) * (a - c) + b * b) AS y FROM p) SELECT k, round((x + y) / 2, 6) + 0.0 AS large, round(abs(x - y) / 2, 6) + 0.0 AS small, 0.0::DOUBLE AS beside FROM s",
    ),
    "discriminant": (_two(lambda a, b, c: (scalar.discriminant(a, b, c),), ("d",)), f"WITH {_TRIPLES} SELECT k, round(b * b - a * c, 6) + 0.0 AS d FROM p"),
    "quadratic_roots": (
        lambda t: _triples(t).where("a != 0 and b*b - a*c > 0.001").select("k", *[(F.round(f(*scalar.quadratic_roots(F.col("a"), F.col("b"), F.col("c"))), 6) + 0.0).alias(n) for f, n in ((F.least, "low"), (F.greatest, "high"))]),
        f"WITH {_TRIPLES}, r AS (SELECT k, (b - sqrt(b * b - a * c)) / a AS x, (b + sqrt(b * b - a * c)) / a AS y FROM p WHERE a != 0 AND b * b - a * c > 0.001) SELECT k, round(least(x, y), 6) + 0.0 AS low, round(greatest(x, y), 6) + 0.0 AS high FROM r",
    ),
    "compensated_sum": (
        lambda t: t.table("embeddings").select(F.col("vec_id").alias("i"), (F.round(eft.sum2(_between(2.0**60)), 6) + 0.0).alias("v")),
        entries("e", "SELECT i, sum(v) AS v FROM e GROUP BY i"),
    ),
    "k_fold_sum": (
        lambda t: t.table("embeddings").select(F.col("vec_id").alias("i"), (F.round(eft.sumk(_between(2.0**100, 2.0**60), 4), 6) + 0.0).alias("v")),
        entries("e", "SELECT i, sum(v) AS v FROM e GROUP BY i"),
    ),
    "compensated_dot": (
        lambda t: t.table("embeddings").select(F.col("vec_id").alias("i"), (F.round(eft.dot2(F.transform(_between(2.0**30), lambda v: F.struct(v.alias("a"), F.abs(v).alias("b")))), 6) + 0.0).alias("v")),
        entries("e", "SELECT i, sum(v * abs(v)) AS v FROM e GROUP BY i"),
    ),
    # order
    "sort_vector": (lambda t: shown(sorting.sort_vector(mx.column_of(t.e, 0))), entries("e", "SELECT row_number() OVER (ORDER BY v, i) - 1 AS i, v FROM e WHERE j = 0")),
    "sort_vector_absolute": (lambda t: shown(sorting.sort_vector(mx.column_of(t.e, 0), False, True)), entries("e", "SELECT row_number() OVER (ORDER BY abs(v) DESC, i) - 1 AS i, v FROM e WHERE j = 0")),
    "sort_eigenvectors": (
        _sort_eigen,
        sql("g", ", d AS (SELECT i, v, row_number() OVER (ORDER BY v DESC, i) - 1 AS k FROM g WHERE i = j) SELECT g.i, d.k AS j, round(g.v, 6) + 0.0 AS v, round(d.v, 6) + 0.0 AS d FROM g JOIN d ON g.j = d.i"),
    ),
    "pivot_sort": (lambda t: sorting.pivot_sort(mx.column_of(t.e, 0)), sql("e", "SELECT row_number() OVER (ORDER BY abs(v) DESC, i) - 1 AS k, i + 1 AS p FROM e WHERE j = 0")),
    "pivot_rows": (lambda t: shown(sorting.pivot_rows(t.g, [2, 2, 5])), cells("g", "SELECT CASE i WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 4 WHEN 4 THEN 2 ELSE i END AS i, j, v FROM g")),
    "pivot_columns_backward": (lambda t: shown(sorting.pivot_columns(t.g, [2, 3], backward=True)), cells("g", "SELECT i, CASE j WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 0 ELSE j END AS j, v FROM g")),
    "pivot_symmetric": (
        lambda t: shown(sorting.pivot_symmetric(t.g, [4])),
        cells("g", "SELECT greatest(p, q) AS i, least(p, q) AS j, v FROM (SELECT CASE i WHEN 0 THEN 3 WHEN 3 THEN 0 ELSE i END AS p, CASE j WHEN 0 THEN 3 WHEN 3 THEN 0 ELSE j END AS q, v FROM g WHERE i >= j) m"),
    ),
}
