"""Sparse operators and iterative solvers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import iterative, sparse
from ..operators.matrix import Matrix, Vector, append, from_table, vector_from
from ..operators.products import mult, mvmult, mvmult_sym, mvmult_trm, triangular
from .tables import Tables, shown, sql

#: Users by day of the month: the number of their events.
_U = "u AS (SELECT user_id AS i, CAST(day(ts) AS BIGINT) AS j, CAST(count(*) AS DOUBLE) AS v FROM events GROUP BY 1, 2)"


def _u(t: Tables) -> Matrix:
    events = t.table("events")
    return from_table(events, "user_id", F.dayofmonth("ts"), F.lit(1.0), t.size("events", "user_id"), 32)


def _days(t: Tables) -> Vector:
    return vector_from(t.spark.range(32), "id", F.col("id") + 1.0, 32)


def _customers(t: Tables) -> Matrix:
    return from_table(t.table("orders"), "o_custkey", "o_orderkey", F.lit(1.0), t.size("customer", "c_custkey"), t.size("orders", "o_orderkey"))


def _orders(t: Tables) -> Matrix:
    return from_table(t.table("lineitem"), "l_orderkey", "l_partkey", "l_quantity", t.size("orders", "o_orderkey"), t.size("part", "p_partkey"))


def _nations(t: Tables) -> Matrix:
    """A Laplacian plus 4 on a ring of nations: symmetric positive definite and sparse."""
    n = 25
    ring = t.table("nation").select(F.col("n_nationkey").cast("long").alias("i"), F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("d"))
    cells_ = ring.select("i", F.pmod(F.col("i") + F.col("d"), F.lit(n)).alias("j"), F.when(F.col("d") == 0, 6.0 + F.col("i") % 3).otherwise(-1.0).alias("v"))
    return Matrix(cells_, n, n)


_R = "r AS (SELECT CAST(n_nationkey AS BIGINT) AS i, CAST(((n_nationkey + d) % 25 + 25) % 25 AS BIGINT) AS j, CAST(CASE WHEN d = 0 THEN 6.0 + n_nationkey % 3 ELSE -1.0 END AS DOUBLE) AS v FROM nation, (VALUES (-1), (0), (1)) q(d))"


def _rhs(t: Tables) -> Vector:
    return vector_from(t.table("nation"), "n_nationkey", F.col("n_nationkey") + 1.0, 25)


_RHS = "SELECT i, round(v, 4) + 0.0 AS v FROM (SELECT CAST(n_nationkey AS BIGINT) AS i, CAST(n_nationkey + 1 AS DOUBLE) AS v FROM nation) q"


def _back(t: Tables, solve):
    """A*x for the x that a solver found."""
    a = _nations(t)
    x = solve(a, _rhs(t))
    return mvmult(1.0, a, x).df.select("i", (F.round("v", 4) + 0.0).alias("v"))


def _orders_ring(t: Tables) -> tuple[Matrix, Vector]:
    """The same on a ring of all orders, and a right-hand side."""
    orders = t.table("orders").select(F.col("o_orderkey").cast("long").alias("i"))
    n = t.size("orders", "o_orderkey")
    ring = orders.select("i", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("d"))
    cells_ = ring.select("i", F.pmod(F.col("i") + F.col("d"), F.lit(n)).alias("j"), F.when(F.col("d") == 0, 6.0 + F.col("i") % 3).otherwise(-1.0).alias("v"))
    return Matrix(cells_, n, n), vector_from(orders, "i", F.col("i") % 7 + 1.0, n)


_ORDERS = "SELECT CAST(o_orderkey AS BIGINT) AS i, CAST(o_orderkey % 7 + 1 AS DOUBLE) AS v FROM orders"


def _orders_back(solve, triangle: bool = False):
    def make(t: Tables):
        a, b = _orders_ring(t)
        x = solve(a, b)
        a = a.where(F.col("i") >= F.col("j")) if triangle else a
        return mvmult(1.0, a, x).df.select("i", (F.round("v", 4) + 0.0).alias("v"))

    return make


def _ic(t: Tables):
    """L*L^T on the pattern of A's lower triangle."""
    a = _nations(t)
    low = sparse.ic0(a)
    whole = sparse.spgemm(1.0, low, low, trans_b=True)
    return shown(Matrix(whole.df.join(a.df.where("i >= j").select("i", "j"), ["i", "j"], "left_semi"), 25, 25))


def _ilu(t: Tables):
    a = _nations(t)
    f = sparse.ilu0(a)
    whole = mult(1.0, triangular(f, "lower", True), triangular(f, "upper", False))
    return shown(Matrix(whole.df.join(a.df.select("i", "j"), ["i", "j"], "left_semi"), 25, 25))


def _pattern_product(t: Tables, symmetric: bool):
    """On the ring of all orders: L*U (L*L^T) on the pattern of A, which it must give back."""
    a = _orders_ring(t)[0]
    if symmetric:
        low = sparse.ic0(a)
        whole, pattern = sparse.spgemm(1.0, low, low, trans_b=True), a.df.where("i >= j")
    else:
        f = sparse.ilu0(a)
        whole, pattern = mult(1.0, triangular(f, "lower", True), triangular(f, "upper", False)), a.df
    return shown(Matrix(whole.df.join(pattern.select("i", "j"), ["i", "j"], "left_semi"), a.rows, a.cols))


_RING = "SELECT i, (i + d + n) % n AS j, CASE WHEN d = 0 THEN 6.0 + i % 3 ELSE -1.0 END AS v FROM (SELECT CAST(o_orderkey AS BIGINT) AS i, (SELECT CAST(max(o_orderkey) + 1 AS BIGINT) FROM orders) AS n FROM orders) o, (VALUES (-1), (0), (1)) q(d)"

QUERIES = {
    "sparse_at": (lambda t: shown(Matrix(sparse.at(_u(t), 17), _u(t).rows, 32)), f"WITH {_U} SELECT i, j, v FROM (SELECT *, row_number() OVER (ORDER BY i, j) - 1 AS n FROM u) q WHERE n = 17"),
    "sparse_stored": (lambda t: sparse.stored(_nations(t), 0, 24).unionByName(sparse.stored(_nations(t), 0, 2)), "SELECT true AS value UNION ALL SELECT false AS value"),
    "sparse_vector": (lambda t: shown(sparse.vector(_u(t), 3, "column")), f"WITH {_U} SELECT i, v FROM u WHERE j = 3"),
    "sparse_append": (lambda t: shown(append(Matrix(_u(t).df.where("j < 10"), _u(t).rows, 32), _u(t).df.where("j >= 10"))), f"WITH {_U} SELECT i, j, v FROM u"),
    "sparse_mvmult_sym": (
        lambda t: shown(mvmult_sym(1.0, _orders_ring(t)[0].where(F.col("i") >= F.col("j")), _orders_ring(t)[1])),
        f"WITH x AS ({_ORDERS}), n AS (SELECT count(*) AS n FROM x) SELECT x.i, (6.0 + x.i % 3) * x.v - p.v - q.v AS v FROM n, x JOIN x p ON p.i = (x.i + 1) % (SELECT n FROM n) JOIN x q ON q.i = (x.i + (SELECT n FROM n) - 1) % (SELECT n FROM n)",
    ),
    "sparse_mvmult_trm": (
        lambda t: shown(mvmult_trm(1.0, _orders_ring(t)[0], _orders_ring(t)[1])),
        f"WITH x AS ({_ORDERS}), n AS (SELECT count(*) AS n FROM x) SELECT x.i, (6.0 + x.i % 3) * x.v - CASE WHEN x.i > 0 THEN coalesce(p.v, 0.0) ELSE 0.0 END - CASE WHEN x.i = (SELECT n FROM n) - 1 THEN (SELECT v FROM x WHERE i = 0) ELSE 0.0 END AS v FROM x LEFT JOIN x p ON p.i = x.i - 1",
    ),
    "sparse_solve_orders": (_orders_back(lambda a, b: sparse.solve_triangular(a, b), True), _ORDERS),
    "conjugate_gradient_orders": (_orders_back(lambda a, b: iterative.conjugate_gradient(a, b, uplo=None, control=iterative.Control(smult=1e-13)).x), _ORDERS),
    "gmres_orders": (_orders_back(lambda a, b: iterative.gmres(a, b, control=iterative.Control(smult=1e-12, restart=12)).x), _ORDERS),
    "sparse_compress_rows": (
        lambda t: sparse.compress(_u(t)).select("k", F.size("cells").cast("long").alias("n"), F.element_at("cells", 1)["index"].alias("first"), F.element_at("cells", -1)["v"].alias("last")),
        f"WITH {_U} SELECT i AS k, count(*) AS n, min(j) AS first, arg_max(v, j) AS last FROM u GROUP BY i",
    ),
    "sparse_convert": (lambda t: shown(sparse.expand(sparse.compress(_u(t), "column"), 0, 32, "column")), f"WITH {_U} SELECT i, j, v FROM u"),
    "sparse_transpose": (lambda t: shown(_u(t).T), f"WITH {_U} SELECT j AS i, i AS j, v FROM u"),
    "sparse_pointers": (
        lambda t: sparse.pointers(_u(t).T),
        f"WITH {_U}, n AS (SELECT CAST(k.r AS BIGINT) AS k, count(u.v) AS size FROM range(32) k(r) LEFT JOIN u ON u.j = k.r GROUP BY 1) SELECT k, CAST(sum(size) OVER (ORDER BY k) - size AS BIGINT) AS start, size FROM n",
    ),
    "sparse_sorted": (
        # The place of each cell in the order in which the rows come out.
        lambda t: sparse.sort_cells(_u(t), "column").df.withColumn("at", F.monotonically_increasing_id()).select("i", "j", "v", (F.row_number().over(Window.orderBy("at")) - 1).cast("long").alias("n")),
        f"WITH {_U} SELECT i, j, v, row_number() OVER (ORDER BY j, i) - 1 AS n FROM u",
    ),
    "sparse_has_diagonal": (lambda t: sparse.has_diagonal(_nations(t)), "SELECT true AS value"),
    "sparse_spy": (lambda t: sparse.spy(_nations(t)), f"WITH {_R} SELECT CAST(a.q AS BIGINT) AS i, string_agg(CASE WHEN r.v IS NULL THEN '.' ELSE 'x' END, '' ORDER BY b.q) AS line FROM range(25) a(q) CROSS JOIN range(25) b(q) LEFT JOIN r ON r.i = a.q AND r.j = b.q GROUP BY 1"),
    "sparse_count": (lambda t: sparse.count(t.s), sql("s", "SELECT count(*) AS value FROM s")),
    "sparse_add": (lambda t: shown(sparse.add(2.0, _u(t), -1.0, Matrix(_u(t).df.where("j < 10"), _u(t).rows, 32))), f"WITH {_U} SELECT i, j, 2.0 * v - CASE WHEN j < 10 THEN v ELSE 0.0 END AS v FROM u"),
    "sparse_add_diagonal": (lambda t: shown(sparse.add_diagonal(_nations(t), 2.5)), f"WITH {_R} SELECT i, j, round(v + CASE WHEN i = j THEN 2.5 ELSE 0.0 END, 6) + 0.0 AS v FROM r"),
    "sparse_mult_diag": (lambda t: shown(sparse.scale_by(_u(t), 2.0, _days(t), "right")), f"WITH {_U} SELECT i, j, 2.0 * v * (j + 1) AS v FROM u"),
    "spmv_user_day": (lambda t: shown(sparse.spmv(1.0, _u(t), _days(t))), f"WITH {_U} SELECT i, sum(v * (j + 1)) AS v FROM u GROUP BY 1"),
    "spmv_transposed": (
        lambda t: shown(sparse.spmv(1.0, _u(t), vector_from(t.spark.range(_u(t).rows), "id", F.lit(1.0), _u(t).rows), trans=True)),
        f"WITH {_U} SELECT j AS i, sum(v) AS v FROM u GROUP BY 1",
    ),
    "spgemm_customer_part": (
        lambda t: shown(sparse.spgemm(1.0, _customers(t), _orders(t))),
        "SELECT o_custkey AS i, l_partkey AS j, sum(l_quantity) AS v FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2",
    ),
    "spgemm_count": (lambda t: sparse.product_count(_customers(t), _orders(t)), "SELECT count(*) AS value FROM (SELECT DISTINCT o_custkey, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey) q"),
    "spgemm_gram": (lambda t: shown(sparse.spgemm(1.0, _u(t), _u(t), trans_a=True)), f"WITH {_U} SELECT a.j AS i, b.j AS j, sum(a.v * b.v) AS v FROM u a JOIN u b ON a.i = b.i GROUP BY 1, 2"),
    "sparse_solve_lower": (
        lambda t: mvmult(1.0, _nations(t).where(F.col("i") >= F.col("j")), sparse.solve_triangular(_nations(t), _rhs(t))).df.select("i", (F.round("v", 4) + 0.0).alias("v")),
        _RHS,
    ),
    "sparse_ilu0": (_ilu, f"WITH {_R} SELECT i, j, round(v, 6) + 0.0 AS v FROM r"),
    "sparse_ic0": (_ic, f"WITH {_R} SELECT i, j, round(v, 6) + 0.0 AS v FROM r WHERE i >= j"),
    "sparse_ilu0_orders": (lambda t: _pattern_product(t, False), f"SELECT i, j, round(v, 6) + 0.0::DOUBLE AS v FROM ({_RING}) r"),
    "sparse_ic0_orders": (lambda t: _pattern_product(t, True), f"SELECT i, j, round(v, 6) + 0.0::DOUBLE AS v FROM ({_RING}) r WHERE i >= j"),
    "preconditioned_cg_orders": (_orders_back(lambda a, b: iterative.conjugate_gradient(a, b, None, sparse.ic_preconditioner(a), iterative.Control(smult=1e-12)).x), _ORDERS),
    "preconditioned_gmres_orders": (_orders_back(lambda a, b: iterative.gmres(a, b, sparse.ilu_preconditioner(a), iterative.Control(smult=1e-12)).x), _ORDERS),
    "conjugate_gradient": (lambda t: _back(t, lambda a, b: iterative.conjugate_gradient(a, b, control=iterative.Control(smult=1e-9)).x), _RHS),
    "preconditioned_cg": (lambda t: _back(t, lambda a, b: iterative.conjugate_gradient(a, b, precondition=sparse.ic_preconditioner(a), control=iterative.Control(smult=1e-7)).x), _RHS),
    "cgnr": (lambda t: _back(t, lambda a, b: iterative.cgnr(a, b, iterative.Control(smult=1e-8)).x), _RHS),
    "cgne": (lambda t: _back(t, lambda a, b: iterative.cgne(a, b, iterative.Control(smult=1e-8)).x), _RHS),
    "gmres": (lambda t: _back(t, lambda a, b: iterative.gmres(a, b, control=iterative.Control(smult=1e-8, restart=10)).x), _RHS),
    "preconditioned_gmres": (lambda t: _back(t, lambda a, b: iterative.gmres(a, b, sparse.ilu_preconditioner(a), iterative.Control(smult=1e-7)).x), _RHS),
}
