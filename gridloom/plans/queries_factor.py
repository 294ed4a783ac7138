"""Factorisations, solvers and inverses, shown by what they give back."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import compat
from ..operators import butterfly, factor, orthogonal, pivoted, spectral
from ..operators.elementwise import mult_diag, plus
from ..operators.matrix import Matrix, Vector, column_of, make_triangular
from ..operators.products import mult, mult_trm, mvmult_trm
from ..operators.rows import matrix_of
from .tables import WIDTH, Tables, cells, checked, entries, faults, not_orthonormal, number, rounded, shown, sql, where_not

_G, _H, _B, _I = (cells(u, f"SELECT * FROM {u}") for u in ("g", "h", "b", "eye"))
_E = cells("e", "SELECT * FROM e")
_ET = cells("e", "SELECT j AS i, i AS j, v FROM e")


def _eye(a: Matrix):
    """Rounded, without the cells that are 0."""
    return shown(a).where("v != 0")


def _lu(t: Tables, pivot: bool = True):
    f = factor.lu(t.h, pivot)
    return shown(factor.relabel(mult(1.0, f.lower, f.upper), f.moves, inverse=True))


def _lu_tall(t: Tables):
    f = factor.lu(t.e)
    return shown(factor.relabel(mult(1.0, f.lower, f.upper), f.moves, inverse=True))


def _lu_solve(trans: bool):
    def make(t: Tables):
        a = make_triangular(t.h, "lower")
        a = Matrix(a.df.unionByName(t.h.df.where("j = i + 1")), WIDTH, WIDTH)
        return shown(mult(1.0, a, factor.lu_solve(factor.lu(a), t.b, trans), trans_a=trans))

    return make


def _lu_inverse(t: Tables):
    return _eye(mult(1.0, t.h, factor.lu_inverse(factor.lu(t.h))))


def _cholesky(uplo: str):
    def make(t: Tables):
        c = factor.cholesky(t.h, uplo)
        return shown(mult(1.0, c, c, trans_b=True) if uplo == "lower" else mult(1.0, c, c, trans_a=True))

    return make


def _ldl(uplo: str):
    def make(t: Tables):
        f = factor.ldl(t.h, uplo)
        return shown(mult(1.0, mult_diag(f.factor, 1.0, f.d, "right"), f.factor, trans_b=True))

    return make


def _indefinite(t: Tables) -> Matrix:
    """g without its diagonal: no pivot of one is possible at the start."""
    return Matrix(t.g.df.where("i != j"), WIDTH, WIDTH)


_M = "SELECT i, j, CASE WHEN i = j THEN 0.0 ELSE v END AS v FROM g"


def _rebuilt(f: pivoted.Pivoted, *wrong):
    """The matrix from its factors, with the factor's shape checked."""
    other = F.col("i") < F.col("j") if f.uplo == "lower" else F.col("i") > F.col("j")
    whole = pivoted.rebuilt(f)
    return faults(shown(whole), where_not(f.factor, other), where_not(f.d, F.abs(F.col("i") - F.col("j")) > 1), *wrong)


def _cholesky_pivoted(t: Tables):
    f = pivoted.cholesky(make_triangular(t.h, "lower"))
    # The largest diagonal comes first, so L's own never rises.
    diag = f.factor.df.where("i = j").select("i", "v")
    rising = diag.alias("a").join(diag.alias("b"), F.expr("b.i = a.i + 1")).where("b.v > a.v * (1 + 1e-9)").agg(F.count("*").alias("n"))
    return _rebuilt(f, rising)


def _bunch_kaufman(uplo: str):
    def make(t: Tables):
        f = pivoted.bunch_kaufman(make_triangular(_indefinite(t), uplo), uplo)
        few = t.spark.range(1).select(F.lit(0 if min(f.pivots) < 0 else 1).alias("n"))  # some block of two
        return _rebuilt(f, few)

    return make


def _update(sign: float):
    """h + w*w^T, or h + w*w^T - w*w^T = h by a downdate of its factor."""

    def make(t: Tables):
        low = pivoted.cholesky_update(factor.cholesky(t.h), t.w)
        low = pivoted.cholesky_update(low, t.w, sign=-1.0) if sign < 0 else low
        return faults(shown(mult(1.0, low, low, trans_b=True)), where_not(low, F.col("i") < F.col("j")))

    return make


def _operand(t: Tables, form: str):
    return t.e_rows if form == "qr" else t.e if form == "ql" else t.e.T


def _product(form: str):
    return lambda t: shown(orthogonal.product(orthogonal.FORMS[form](_operand(t, form))))


def _orthonormal(form: str):
    def make(t: Tables):
        q = orthogonal.build(orthogonal.FORMS[form](_operand(t, form)))
        return _eye(mult(1.0, q, q, trans_a=True) if form in ("qr", "ql") else mult(1.0, q, q, trans_b=True))

    return make


def _mult_q(form: str):
    """Q^T*A is the triangle of which there is only one with a positive diagonal and the
    Gram matrix g; likewise for the other forms."""

    def make(t: Tables):
        a = t.e if form in ("qr", "ql") else t.e.T
        f = orthogonal.FORMS[form](a)
        r = orthogonal.mult_q(f, a, trans=True) if form in ("qr", "ql") else orthogonal.mult_q(f, a, side="right", trans=True)
        whole = mult(1.0, r, r, trans_a=True) if form in ("qr", "ql") else mult(1.0, r, r, trans_b=True)
        other = F.col("i") > F.col("j") if form in ("qr", "rq") else F.col("i") < F.col("j")
        return faults(shown(whole), where_not(Matrix(r.df.where(F.abs("v") > 1e-7), r.rows, r.cols), other), where_not(r, (F.col("i") == F.col("j")) & (F.col("v") < 0)))

    return make


def _min_norm(x: Matrix, a: Matrix, t: Tables):
    """A*X, and whether X is the smallest: A^T*y with A*A^T*y = B, found by Cholesky."""
    y = factor.cholesky_solve(factor.cholesky(mult(1.0, a, a, trans_b=True)), t.b)
    apart = plus(1.0, x, -1.0, mult(1.0, a, y, trans_a=True)).df.where(F.abs("v") > 1e-8).agg(F.count("*").alias("n"))
    return faults(shown(mult(1.0, a, x)), apart)


def _least_squares(t: Tables):
    """e^T*(e*X) for the X nearest to the labels: e^T*x."""
    x = orthogonal.least_squares(t.e_rows, Matrix(t.x.df.select("i", F.lit(0).cast("long").alias("j"), "v"), t.n, 1))
    return shown(mult(1.0, t.e, mult(1.0, t.e, x), trans_a=True))


def _house(t: Tables):
    """The first column of H*h: its norm with the other sign, and nothing below."""
    v, tau, _ = orthogonal.reflector(column_of(t.h, 0))
    return _eye(Matrix(orthogonal.apply_reflector(t.h, v, tau).df.where("j = 0"), WIDTH, WIDTH))


def _house_gram(t: Tables, many: bool = False):
    """(H*h)^T*(H*h) = h*h."""
    v, tau, _ = orthogonal.reflector(column_of(t.h, 0), positive=True)
    w, other, _ = orthogonal.reflector(column_of(t.h, 5))
    turned = orthogonal.apply_reflectors(t.h, [(v, tau), (w, other)]) if many else orthogonal.apply_reflector(t.h, v, tau)
    return shown(mult(1.0, turned, turned, trans_a=True))


def _hyperbolic(t: Tables):
    """(H*b)^T*J*(H*b) = b^T*J*b with J negative beyond row 62."""
    v, tau, _ = orthogonal.hyperbolic(column_of(t.h, 0), 63)
    turned = orthogonal.apply_hyperbolic(t.h, v, tau, 63)
    signed = turned.with_values(F.when(F.col("i") < 63, F.col("v")).otherwise(-F.col("v")))
    return shown(mult(1.0, turned, signed, trans_a=True))


_HH = cells("h", "SELECT a.i, b.j, sum(a.v * b.v) AS v FROM h a JOIN h b ON a.j = b.i GROUP BY 1, 2")


def _diagonals(t: Tables, scale: float):
    """Given diagonals for two levels, which SQL can make as well."""
    pairs = t.spark.range(2 * WIDTH).select((F.col("id") % 2).cast("int").alias("level"), F.floor(F.col("id") / 2).cast("long").alias("i"))
    return pairs.select("level", "i", (1 + (F.col("i") + F.col("level")) / scale).alias("r"))


def _butterfly_sql(source: str, trans: bool, scale: int, name: str) -> str:
    """Tables name0, name1: the levels done one after another to the table `source`."""
    out = []
    for step, level in enumerate((0, 1) if trans else (1, 0)):
        half = 32 >> level
        r = "(1 + ({0}.i + " + f"{level}) / {scale}.0)"
        before, after = ("", f" * {r.format('a')}") if trans else (f" * {r.format('x')}", "")
        low = f"((a.i // {half}) % 2 = 0)"
        own, other = f"x.v{before}", f"y.v{before.replace('x.i', 'y.i')}"
        out.append(
            f"{name}{step} AS (SELECT a.i, x.j, (CASE WHEN {low} THEN {own} + {other} ELSE {other} - {own} END) / sqrt(2.0){after} AS v FROM range(64) q(r) "
            f"JOIN (SELECT CAST(r AS BIGINT) AS i FROM range(64) z(r)) a ON a.i = q.r JOIN {source} x ON x.i = a.i JOIN {source} y ON y.j = x.j AND y.i = CASE WHEN {low} THEN a.i + {half} ELSE a.i - {half} END)"
        )
        source = f"{name}{step}"
    return ", " + ", ".join(out)


_BUTTERFLY = sql("h", _butterfly_sql("h", False, 100, "u") + " SELECT i, j, round(v, 6) + 0.0 AS v FROM u1")
_BUTTERFLY2 = sql(
    "h", _butterfly_sql("h", True, 100, "u") + ", t AS (SELECT j AS i, i AS j, v FROM u1)" + _butterfly_sql("t", True, 50, "w") + " SELECT j AS i, i AS j, round(v, 6) + 0.0 AS v FROM w1"
)


def _solved(form: str, trans: bool):
    """Least squares give e^T*(e*X) = e^T*B, smallest solutions B itself."""

    def make(t: Tables):
        tall = form in ("qr", "ql")
        a = t.e if tall else t.e.T
        f = orthogonal.FORMS[form](a)
        if tall == trans:
            x = orthogonal.solve(f, t.b, trans)
            return _min_norm(x, t.e.T, t)
        labels = Matrix(t.x.df.select("i", F.lit(0).cast("long").alias("j"), "v"), t.n, 1)
        return shown(mult(1.0, t.e, mult(1.0, t.e, orthogonal.solve(f, labels, trans)), trans_a=True))

    return make


_NORMAL = cells("e x", "SELECT e.j AS i, CAST(0 AS BIGINT) AS j, sum(e.v * x.v) AS v FROM e JOIN x ON e.i = x.i GROUP BY 1")


def _reflectors(t: Tables):
    """e from its reflectors: Q*[R; 0], with their shape."""
    f = orthogonal.reflectors(t.e_rows)
    r = Matrix(f.r.df, t.n, WIDTH)
    back = Matrix(orthogonal.update_qr(f, r).df, t.n, WIDTH)
    again = orthogonal.update_qr(f, t.e, trans=True)
    below = where_not(Matrix(again.df.where(F.abs("v") > 1e-7), t.n, WIDTH), F.col("i") > F.col("j"))
    # Blocks of T are those of their own reflectors: I - Y*T*Y^T is orthogonal for each.
    y = Matrix(f.y.df.where("j < 16"), t.n, 16)
    tt = f.blocks(16)[0]
    inner = mult(1.0, y, y, trans_a=True)
    both = mult(1.0, mult(1.0, matrix_of(t.spark, tt), inner), matrix_of(t.spark, tt.T))
    gap = plus(1.0, plus(1.0, matrix_of(t.spark, tt), 1.0, matrix_of(t.spark, tt.T)), -1.0, both)
    return faults(shown(back), below, where_not(f.y, F.col("i") < F.col("j")), where_not(Matrix(gap.df.where(F.abs("v") > 1e-8), 16, 16), F.lit(True)))


def _update_right(t: Tables):
    """(C*Q)*Q^T = C with all of Q."""
    f = orthogonal.reflectors(t.e_rows)
    c = Matrix(t.e.T.df, WIDTH, t.n)
    return shown(orthogonal.update_qr(f, orthogonal.update_qr(f, c, side="right"), side="right", trans=True))


def _c0(t: Tables) -> Vector:
    return column_of(t.g, 0)


def _swapped(t: Tables):
    """Both vectors after the swap: the first, then the second column."""
    x, y = compat.swap(t.w, _c0(t))
    put = lambda v, j: v.df.select("i", F.lit(j).cast("long").alias("j"), "v")
    return shown(Matrix(put(x, 0).unionByName(put(y, 1)), WIDTH, 2))


_GH = cells("g h", "SELECT a.i, b.j, sum(a.v * b.v) AS v FROM h a JOIN g b ON a.j = b.i GROUP BY 1, 2")
_MV = "SELECT {0} AS i, sum(a.v * w.v) AS v FROM {1} a JOIN w ON {2} = w.i GROUP BY 1"
_UPPER = "(SELECT * FROM g WHERE i <= j)"

def _deficient(t: Tables) -> Matrix:
    """e with column 5 again as column 9, and column 20 left out."""
    again = t.e.df.where("j = 5").select("i", F.lit(9).cast("long").alias("j"), "v")
    return Matrix(t.e.df.where("j not in (9, 20)").unionByName(again), t.n, WIDTH)


_DEFICIENT = "SELECT i, j, v FROM e WHERE j NOT IN (9, 20) UNION ALL SELECT i, 9 AS j, v FROM e WHERE j = 5"


def _deficient_form(form: str):
    """The product of the factors of a matrix without full rank, and how far Q is from orthonormal."""

    def make(t: Tables):
        tall = form in ("qr", "ql")
        f = orthogonal.FORMS[form](_deficient(t) if tall else _deficient(t).T)
        a = orthogonal.product(f)
        a = Matrix((a if tall else a.T).df.where("j != 20"), t.n, WIDTH)
        return faults(shown(a), not_orthonormal(f.q, rows=not tall))

    return make


def _deficient_solve(t: Tables):
    """A*x for the x that is nearest to labels + 1 of a matrix without full rank: A^T*(A*x - b) is 0,
    so A^T*A*x is A^T*b."""
    a = _deficient(t)
    b = Matrix(t.x.df.select("i", F.lit(0).cast("long").alias("j"), "v"), t.n, 1)
    x = orthogonal.least_squares(a, b)
    return shown(mult(1.0, a, mult(1.0, a, x), trans_a=True)).where("i != 20")


def _deficient_svd(t: Tables):
    f = spectral.svd(_deficient(t))
    a = mult(1.0, mult_diag(f.u, 1.0, f.s, "right"), f.v, trans_b=True)
    return faults(shown(Matrix(a.df.where("j != 20"), t.n, WIDTH)), not_orthonormal(f.u), not_orthonormal(f.v))


def _whole(form: str):
    """A from all of Q and the padded triangle, and a column of ones from Q^T*(Q*ones)."""

    def make(t: Tables):
        a = t.e if form in ("qr", "ql") else t.e.T
        f = orthogonal.whole(a, form)
        ones = Matrix(t.spark.range(f.size).select(F.col("id").alias("i"), F.lit(0).cast("long").alias("j"), F.lit(1.0).alias("v")), f.size, 1)
        back = orthogonal.mult_whole(f, orthogonal.mult_whole(f, ones), trans=True)
        moved = back.df.where(F.abs(F.col("v") - 1.0) > 1e-9).agg(F.count("*").alias("n"))
        long = back.df.agg((F.lit(f.size) - F.count("*")).alias("n"))
        return faults(shown(orthogonal.mult_whole(f, f.padded(), "left" if form in ("qr", "ql") else "right")), moved, long)

    return make


QUERIES = {
    **{f"{form}_deficient": (_deficient_form(form), checked("e", _DEFICIENT)) for form in ("qr", "ql", "lq", "rq")},
    "least_squares_deficient": (_deficient_solve, cells("e x", f"SELECT a.j AS i, 0 AS j, sum(a.v * x.v) AS v FROM ({_DEFICIENT}) a JOIN x ON x.i = a.i GROUP BY 1")),
    "svd_deficient": (_deficient_svd, checked("e", _DEFICIENT)),
    **{f"{form}_whole": (_whole(form), checked("e", "SELECT * FROM e" if form in ("qr", "ql") else "SELECT j AS i, i AS j, v FROM e")) for form in ("qr", "ql", "lq", "rq")},
    "qr_reflectors": (_reflectors, checked("e", "SELECT * FROM e")),
    "qr_update_right": (_update_right, _ET),
    "qr_solve_form": (_solved("qr", False), _NORMAL),
    "ql_solve": (_solved("ql", False), _NORMAL),
    "ql_solve_transposed": (_solved("ql", True), checked("b", "SELECT * FROM b")),
    "lq_solve_transposed": (_solved("lq", True), _NORMAL),
    "rq_solve": (_solved("rq", False), checked("b", "SELECT * FROM b")),
    "rq_solve_transposed": (_solved("rq", True), _NORMAL),
    # customary names
    "compat_axpy": (lambda t: shown(compat.axpy(2.0, t.w, _c0(t))), entries("g w", "SELECT g.i, g.v + 2.0 * w.v AS v FROM g JOIN w ON g.i = w.i WHERE g.j = 0")),
    "compat_scal": (lambda t: shown(compat.scal(-3.0, _c0(t))), entries("g", "SELECT i, -3.0 * v AS v FROM g WHERE j = 0")),
    "compat_copy": (lambda t: shown(compat.copy(_c0(t))), entries("g", "SELECT i, v FROM g WHERE j = 0")),
    "compat_swap": (_swapped, cells("g w", "SELECT i, 0 AS j, v FROM g WHERE j = 0 UNION ALL SELECT i, 1 AS j, v FROM w")),
    "compat_rot": (lambda t: shown(compat.rot(t.w, _c0(t), 0.6, 0.8)[0]), entries("g w", "SELECT w.i, 0.6 * w.v + 0.8 * g.v AS v FROM g JOIN w ON g.i = w.i WHERE g.j = 0")),
    "compat_rotg": (
        lambda t: t.table("part").select(F.col("p_partkey").cast("long").alias("k"), *[F.round(x, 6).alias(n) for x, n in zip(compat.rotg(F.col("p_size") - 25.0, F.col("p_retailprice") * 1.0), "csr", strict=True)]),
        "SELECT CAST(p_partkey AS BIGINT) AS k, round(CASE WHEN b = 0 THEN 1.0 ELSE a / sqrt(a * a + b * b) END, 6) AS c, round(CASE WHEN b = 0 THEN 0.0 ELSE b / sqrt(a * a + b * b) END, 6) AS s, round(CASE WHEN b = 0 THEN a WHEN a = 0 THEN b ELSE sqrt(a * a + b * b) END, 6) AS r FROM (SELECT p_partkey, p_size - 25.0::DOUBLE AS a, p_retailprice AS b FROM part) q",
    ),
    "compat_asum": (lambda t: rounded(compat.asum(_c0(t))), number("g", "(SELECT sum(abs(v)) FROM g WHERE j = 0)")),
    "compat_nrm2": (lambda t: rounded(compat.nrm2(_c0(t))), number("g", "(SELECT sqrt(sum(v * v)) FROM g WHERE j = 0)")),
    "compat_dot": (lambda t: rounded(compat.dot(t.w, _c0(t))), number("g w", "(SELECT sum(g.v * w.v) FROM g JOIN w ON g.i = w.i WHERE g.j = 0)")),
    "compat_iamax": (lambda t: compat.iamax(_c0(t)), sql("g", "SELECT i AS value FROM g WHERE j = 0 ORDER BY abs(v) DESC, i LIMIT 1")),
    "compat_gemv": (lambda t: shown(compat.gemv("T", 2.0, t.g, t.w, 0.5, _c0(t))), entries("g w", "SELECT q.i, 2.0 * q.v + 0.5 * g.v AS v FROM (" + _MV.format("a.j", "g", "a.i") + ") q JOIN g ON g.i = q.i AND g.j = 0")),
    "compat_symv": (lambda t: shown(compat.symv("U", 1.0, make_triangular(t.g, "upper"), t.w)), entries("g w", _MV.format("a.i", "g", "a.j"))),
    "compat_trmv": (lambda t: shown(compat.trmv("U", "T", "N", t.g, t.w)), entries("g w", _MV.format("a.j", _UPPER, "a.i"))),
    "compat_trsv": (lambda t: shown(compat.trmv("U", "N", "N", t.h, compat.trsv("U", "N", "N", t.h, t.w))), entries("w", "SELECT * FROM w")),
    "compat_ger": (lambda t: shown(compat.ger(0.5, t.w, _c0(t), t.g)), cells("g w", "SELECT g.i, g.j, g.v + 0.5 * w.v * c.v AS v FROM g JOIN w ON w.i = g.i JOIN g c ON c.i = g.j AND c.j = 0")),
    "compat_syr": (lambda t: shown(compat.syr("L", 1.0, t.w, t.g)), cells("g w", "SELECT g.i, g.j, g.v + CASE WHEN g.i >= g.j THEN a.v * b.v ELSE 0.0 END AS v FROM g JOIN w a ON a.i = g.i JOIN w b ON b.i = g.j")),
    "compat_syr2": (
        lambda t: shown(compat.syr2("U", 1.0, t.w, _c0(t), t.g)),
        cells("g w", "SELECT g.i, g.j, g.v + CASE WHEN g.i <= g.j THEN a.v * d.v + c.v * b.v ELSE 0.0 END AS v FROM g JOIN w a ON a.i = g.i JOIN w b ON b.i = g.j JOIN g c ON c.i = g.i AND c.j = 0 JOIN g d ON d.i = g.j AND d.j = 0"),
    ),
    "compat_symm": (lambda t: shown(compat.symm("R", "U", 1.0, make_triangular(t.g, "upper"), t.h)), _GH),
    "compat_trmm": (lambda t: shown(compat.trmm("L", "U", "N", "N", 2.0, t.g, t.h)), cells("g h", "SELECT a.i, b.j, 2.0 * sum(a.v * b.v) AS v FROM " + _UPPER + " a JOIN h b ON a.j = b.i GROUP BY 1, 2")),
    "compat_syr2k": (
        lambda t: shown(compat.syr2k("L", "N", 1.0, t.g, t.h)),
        cells("g h", "SELECT a.i, b.i AS j, sum(a.v * b.v) + sum(x.v * y.v) AS v FROM g a JOIN h b ON a.j = b.j JOIN h x ON x.i = a.i AND x.j = a.j JOIN g y ON y.i = b.i AND y.j = b.j WHERE a.i >= b.i GROUP BY 1, 2"),
    ),
    "lu": (_lu, _H),
    "lu_unpivoted": (lambda t: _lu(t, False), _H),
    "lu_tall": (_lu_tall, _E),
    "lu_solve": (_lu_solve(False), _B),
    "lu_solve_transposed": (_lu_solve(True), _B),
    "lu_inverse": (_lu_inverse, _I),
    "cholesky_lower": (_cholesky("lower"), _H),
    "cholesky_upper": (_cholesky("upper"), _H),
    "cholesky_solve": (lambda t: shown(mult(1.0, t.h, factor.cholesky_solve(factor.cholesky(t.h), t.b))), _B),
    "cholesky_inverse": (lambda t: _eye(mult(1.0, t.h, factor.cholesky_inverse(factor.cholesky(t.h)))), _I),
    "cholesky_pivoted": (_cholesky_pivoted, checked("h", "SELECT * FROM h")),
    "cholesky_pivoted_solve": (lambda t: shown(mult(1.0, t.h, pivoted.solve(pivoted.cholesky(t.h), t.b))), _B),
    "cholesky_update": (_update(1.0), checked("h w", "SELECT h.i, h.j, h.v + a.v * b.v AS v FROM h JOIN w a ON a.i = h.i JOIN w b ON b.i = h.j")),
    "cholesky_downdate": (_update(-1.0), checked("h", "SELECT * FROM h")),
    "ldl_lower": (_ldl("lower"), _H),
    "ldl_upper": (_ldl("upper"), _H),
    "ldl_solve": (lambda t: shown(mult(1.0, t.h, factor.ldl_solve(factor.ldl(t.h), t.b))), _B),
    "ldl_inverse": (lambda t: _eye(mult(1.0, t.h, factor.ldl_inverse(factor.ldl(t.h, "upper")))), _I),
    "ldl_pivoted": (lambda t: _rebuilt(pivoted.ldl(make_triangular(t.h, "lower"))), checked("h", "SELECT * FROM h")),
    "ldl_pivoted_solve": (lambda t: shown(mult(1.0, t.h, pivoted.solve(pivoted.ldl(t.h), t.b))), _B),
    "ldl_pivoted_inverse": (lambda t: _eye(mult(1.0, t.h, pivoted.inverse(pivoted.ldl(t.h)))), _I),
    "bunch_kaufman": (_bunch_kaufman("lower"), checked("g", _M)),
    "bunch_kaufman_upper": (_bunch_kaufman("upper"), checked("g", _M)),
    "bunch_kaufman_solve": (lambda t: shown(mult(1.0, _indefinite(t), pivoted.solve(pivoted.bunch_kaufman(_indefinite(t)), t.b))), _B),
    "triangular_inverse": (lambda t: _eye(mult_trm(1.0, t.h, factor.triangular_inverse(t.h))), _I),
    "solve_trm_left": (lambda t: shown(mult_trm(0.5, t.h, factor.solve_triangular(t.h, t.b, 2.0))), _B),
    "solve_trm_right_trans": (
        lambda t: shown(mult_trm(1.0, t.h, factor.solve_triangular(t.h, t.e, side="right", uplo="upper", trans=True), uplo="upper", side="right", trans=True)),
        _E,
    ),
    "mvsolve_trm": (lambda t: shown(mvmult_trm(1.0, t.h, factor.mvsolve_trm(1.0, t.h, t.w, "upper"), "upper")), entries("w", "SELECT * FROM w")),
    "qr": (_product("qr"), _E),
    "lq": (_product("lq"), _ET),
    "ql": (_product("ql"), _E),
    "rq": (_product("rq"), _ET),
    "qr_build": (_orthonormal("qr"), _I),
    "lq_build": (_orthonormal("lq"), _I),
    "ql_build": (_orthonormal("ql"), _I),
    "rq_build": (_orthonormal("rq"), _I),
    "qr_mult": (_mult_q("qr"), checked("g", "SELECT * FROM g")),
    "lq_mult": (_mult_q("lq"), checked("g", "SELECT * FROM g")),
    "ql_mult": (_mult_q("ql"), checked("g", "SELECT * FROM g")),
    "rq_mult": (_mult_q("rq"), checked("g", "SELECT * FROM g")),
    "qr_solve": (_least_squares, cells("e x", "SELECT e.j AS i, CAST(0 AS BIGINT) AS j, sum(e.v * x.v) AS v FROM e JOIN x ON e.i = x.i GROUP BY 1")),
    "qr_solve_min_norm": (lambda t: _min_norm(orthogonal.least_squares(t.e_rows, t.b, trans=True), t.e.T, t), checked("b", "SELECT * FROM b")),
    "lq_solve": (lambda t: _min_norm(orthogonal.min_norm(t.e.T, t.b), t.e.T, t), checked("b", "SELECT * FROM b")),
    "house": (_house, cells("h", "SELECT CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS j, -sqrt(sum(v * v)) AS v FROM h WHERE j = 0")),
    "house_apply": (_house_gram, _HH),
    "house_mult": (lambda t: _house_gram(t, True), _HH),
    "hyperbolic_apply": (_hyperbolic, cells("h", "SELECT a.i, b.j, sum(a.v * CASE WHEN a.j < 63 THEN b.v ELSE -b.v END) AS v FROM h a JOIN h b ON a.j = b.i GROUP BY 1, 2")),
    "givens_rows": (lambda t: shown(orthogonal.givens_rows(t.g, 0.6, 0.8, 2, 5)), cells("g", "SELECT g.i, g.j, CASE g.i WHEN 2 THEN 0.6 * g.v + 0.8 * o.v WHEN 5 THEN 0.6 * g.v - 0.8 * o.v ELSE g.v END AS v FROM g JOIN g o ON o.j = g.j AND o.i = CASE g.i WHEN 2 THEN 5 WHEN 5 THEN 2 ELSE g.i END")),
    "givens_columns": (lambda t: shown(orthogonal.givens_columns(t.e, 0.6, 0.8, 0, 1)), cells("e", "SELECT e.i, e.j, CASE e.j WHEN 0 THEN 0.6 * e.v + 0.8 * o.v WHEN 1 THEN 0.6 * e.v - 0.8 * o.v ELSE e.v END AS v FROM e JOIN e o ON o.i = e.i AND o.j = CASE e.j WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE e.j END")),
    "givens_sequence_turns": (
        # Three rotations of neighbouring columns in turn: (c0, c1), (c1, c2), (c2, c3).
        lambda t: shown(Matrix(orthogonal.givens_sequence(t.e, [(0.6, 0.8), (0.8, -0.6), (0.28, 0.96)], 0, "right").df.where("j < 4"), t.n, 4)),
        cells("e", "SELECT i, j, CASE j WHEN 0 THEN b0 WHEN 1 THEN c1 WHEN 2 THEN 0.28 * c2 + 0.96 * x3 ELSE 0.28 * x3 - 0.96 * c2 END AS v FROM (SELECT *, 0.8 * b1 - 0.6 * x2 AS c1, 0.8 * x2 + 0.6 * b1 AS c2 FROM (SELECT i, x2, x3, 0.6 * x0 + 0.8 * x1 AS b0, 0.6 * x1 - 0.8 * x0 AS b1 FROM (SELECT i, max(CASE WHEN j = 0 THEN v END) AS x0, max(CASE WHEN j = 1 THEN v END) AS x1, max(CASE WHEN j = 2 THEN v END) AS x2, max(CASE WHEN j = 3 THEN v END) AS x3 FROM e GROUP BY i) p) q) r, (SELECT CAST(k AS BIGINT) AS j FROM range(4) z(k)) s"),
    ),
    "givens_sequence": (lambda t: shown(orthogonal.givens_sequence(t.e, [(0.6, 0.8)], 0, "right")), cells("e", "SELECT e.i, e.j, CASE e.j WHEN 0 THEN 0.6 * e.v + 0.8 * o.v WHEN 1 THEN 0.6 * e.v - 0.8 * o.v ELSE e.v END AS v FROM e JOIN e o ON o.i = e.i AND o.j = CASE e.j WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE e.j END")),
    "compat_gemm": (lambda t: shown(compat.gemm("T", "N", 1.0, t.e, t.e, 1.0, t.eye)), _H),
    "compat_syrk": (lambda t: shown(compat.syrk("L", "T", 1.0, t.e)), cells("g", "SELECT * FROM g WHERE i >= j")),
    "compat_trsm": (lambda t: shown(compat.trmm("L", "U", "N", "N", 1.0, t.h, compat.trsm("L", "U", "N", "N", 1.0, t.h, t.b))), _B),
    "compat_posv": (lambda t: shown(compat.symm("L", "L", 1.0, t.h, compat.posv("L", t.h, t.b))), _B),
    "compat_getrs": (lambda t: shown(compat.gemm("T", "N", 1.0, t.h, compat.getrs("T", compat.getrf(t.h), t.b))), _B),
    "butterfly": (lambda t: shown(butterfly.apply(t.h, _diagonals(t, 100.0), 2)), _BUTTERFLY),
    "butterfly_two_sided": (lambda t: shown(butterfly.two_sided(t.h, _diagonals(t, 100.0), _diagonals(t, 50.0), 2)), _BUTTERFLY2),
}
