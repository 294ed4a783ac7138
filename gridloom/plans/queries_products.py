"""Matrix-vector and matrix-matrix products, plain and in extended precision."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import blocks, extended
from ..operators import products as pr
from ..operators.matrix import Matrix, Vector, column_of, make_triangular, triangle, vector_from
from ..operators.rows import gram as row_gram
from ..operators.rows import matrix_of, times_small
from ..operators.rows import from_rows as rows_matrix
from .tables import Tables, cells, entries, number, rounded, shown, sql

_MV = "SELECT {0} AS i, sum(a.v * w.v) AS v FROM {1} a JOIN w ON {2} = w.i GROUP BY 1"
_LOW = "(SELECT * FROM g WHERE i >= j)"
_GG = "SELECT a.i, b.j, sum(a.v * b.v) AS v FROM {0} a JOIN {1} b ON a.j = b.i GROUP BY 1, 2"


def _c0(t: Tables):
    return column_of(t.g, 0)


# Numbers that a plain sum gets wrong: g rounded, plus or minus 2^50 in turn; SQL adds them up
# as integers.


def _m(t: Tables) -> Matrix:
    return t.g.with_values(F.round("v", 0) + F.when((F.col("i") + F.col("j")) % 2 == 0, 2.0**50).otherwise(-(2.0**50)))


def _wi(t: Tables) -> Vector:
    """1, 1, 2, 2, ..., so that the large parts cancel."""
    return Vector(t.w.df.select("i", (1 + F.floor(F.col("i") / 2)).cast("double").alias("v")), 64)


def _wide(t: Tables) -> Matrix:
    """64 x 3: _wi times 1, 2, 3."""
    return Matrix(_wi(t).df.select("i", F.explode(F.array(*[F.lit(k).cast("long") for k in range(3)])).alias("j"), "v").select("i", "j", (F.col("v") * (F.col("j") + 1)).alias("v")), 64, 3)


def _flat(t: Tables) -> Vector:
    """_m row by row."""
    return Vector(_m(t).df.select((F.col("i") * 64 + F.col("j")).alias("i"), "v"), 4096)


def _tiled(t: Tables) -> Vector:
    """_wi for each row of _m."""
    return Vector(t.spark.range(4096).select(F.col("id").alias("i"), (1 + F.floor(F.col("id") % 64 / 2)).cast("double").alias("v")), 4096)


def _huge(t: Tables) -> Vector:
    """_m row by row between +-2^100 and +-2^70."""
    more = t.spark.range(4).select(F.when(F.col("id") < 2, F.col("id")).otherwise(F.col("id") + 4096).alias("i"), F.element_at(F.array(*[F.lit(x) for x in (2.0**100, 2.0**70, -(2.0**70), -(2.0**100))]), (F.col("id") + 1).cast("int")).alias("v"))
    return Vector(_flat(t).df.select((F.col("i") + 2).alias("i"), "v").unionByName(more), 4100)


def _whole(t: Tables) -> Vector:
    """Sums of the labels of every 64th embedding."""
    return vector_from(t.table("embeddings"), F.col("vec_id") % 64, "label", 64)


def _near(t: Tables, offset: float = 0.0) -> Vector:
    """2^30 more than _whole."""
    return Vector(_whole(t).df.select("i", (F.col("v") + offset).alias("v")), 64)


def _against(t: Tables, times: float) -> Matrix:
    """-(2^60 + (x_i + x_j) * 2^30) * times, x being _whole."""
    x = _whole(t).df
    both = t.g.df.select("i", "j").join(x.select("i", F.col("v").alias("x")), "i").join(x.select(F.col("i").alias("j"), F.col("v").alias("y")), "j")
    return Matrix(both.select("i", "j", (-times * (2.0**60 + (F.col("x") + F.col("y")) * 2.0**30)).alias("v")), 64, 64)


_MI = ", mi AS (SELECT i, j, CAST(round(v) AS HUGEINT) + CASE WHEN (i + j) % 2 = 0 THEN 1125899906842624 ELSE -1125899906842624 END AS v FROM g), wi AS (SELECT CAST(r AS BIGINT) AS i, CAST(1 + r // 2 AS HUGEINT) AS v FROM range(64) z(r)), wide AS (SELECT i, CAST(k AS BIGINT) AS j, v * (k + 1) AS v FROM wi, range(3) y(k))"


#: _whole in SQL.
_WHOLE = "(SELECT CAST(vec_id % 64 AS BIGINT) AS i, CAST(sum(label) AS DOUBLE) AS v FROM embeddings GROUP BY 1)"


def _exact(body: str) -> str:
    """body over mi, wi and wide, whose v are integers, however large."""
    names = "i, j, " if " j," in body.split(" FROM")[0] or ".j," in body.split(" FROM")[0] else "i, "
    return sql("g", f"{_MI} SELECT {names}CAST(v AS DOUBLE) AS v FROM ({body}) q")


def _exact_number(expression: str) -> str:
    return sql("g", f"{_MI} SELECT round(CAST({expression} AS DOUBLE), 6) + 0.0 AS value")


QUERIES = {
    "mult_gram_supplier": (lambda t: shown(pr.mult(1.0, t.s, t.s, trans_b=True)), cells("s", "SELECT a.i, b.i AS j, sum(a.v * b.v) AS v FROM s a JOIN s b ON a.j = b.j GROUP BY 1, 2")),
    "mult_update": (lambda t: shown(pr.mult(2.0, t.g, t.h, 0.5, t.g)), cells("g h", "SELECT p.i, p.j, 2.0 * p.v + 0.5 * g.v AS v FROM (" + _GG.format("g", "h") + ") p JOIN g ON p.i = g.i AND p.j = g.j")),
    "mult_transposed": (lambda t: shown(pr.mult(1.0, t.e, t.e, trans_a=True)), cells("g", "SELECT * FROM g")),
    "mult_absolute": (lambda t: shown(pr.mult(1.0, t.g, t.g, abs_a=True, abs_b=True)), cells("g", "SELECT a.i, b.j, sum(abs(a.v) * abs(b.v)) AS v FROM g a JOIN g b ON a.j = b.i GROUP BY 1, 2")),
    "mult_tiles": (lambda t: shown(blocks.from_blocks(blocks.mult(blocks.to_blocks(t.g, 16), blocks.to_blocks(t.h, 16)))), cells("g h", _GG.format("g", "h"))),
    "transpose_tiles": (lambda t: shown(blocks.from_blocks(blocks.transpose(blocks.to_blocks(t.e, 32)))), cells("e", "SELECT j AS i, i AS j, v FROM e")),
    "mult_small_side": (lambda t: shown(rows_matrix(times_small(t.e_rows, row_gram(t.e_rows)))), cells("e g", _GG.format("e", "g"))),
    "gram_rows": (lambda t: shown(matrix_of(t.spark, row_gram(t.e_rows))), cells("g", "SELECT * FROM g")),
    "gram_table": (lambda t: shown(t.g), cells("g", "SELECT * FROM g")),
    "mult_sym_left": (lambda t: shown(pr.mult_sym(1.0, make_triangular(t.g, "lower"), t.h)), cells("g h", _GG.format("g", "h"))),
    "mult_sym_right_upper": (lambda t: shown(pr.mult_sym(1.0, make_triangular(t.g, "upper"), t.e, uplo="upper", side="right")), cells("e g", _GG.format("e", "g"))),
    "mult_trm_left": (lambda t: shown(pr.mult_trm(1.0, t.g, t.h)), cells("g h", _GG.format(_LOW, "h"))),
    "mult_trm_right_trans_unit": (
        lambda t: shown(pr.mult_trm(2.0, t.g, t.h, side="right", trans=True, unit=True)),
        cells("g h", "SELECT a.i, b.i AS j, 2.0 * sum(a.v * CASE WHEN b.i = b.j THEN 1.0 ELSE b.v END) AS v FROM h a JOIN g b ON a.j = b.j WHERE b.i >= b.j GROUP BY 1, 2"),
    ),
    "update_sym": (lambda t: shown(pr.update_sym(1.0, t.e, 2.0, t.h, trans=True)), cells("g h", "SELECT h.i, h.j, CASE WHEN h.i >= h.j THEN g.v + 2.0 * h.v ELSE h.v END AS v FROM h JOIN g ON h.i = g.i AND h.j = g.j")),
    "update_sym_supplier": (lambda t: shown(pr.update_sym(1.0, t.s, uplo="upper")), cells("s", "SELECT a.i, b.i AS j, sum(a.v * b.v) AS v FROM s a JOIN s b ON a.j = b.j WHERE a.i <= b.i GROUP BY 1, 2")),
    "update2_sym": (lambda t: shown(pr.update2_sym(1.0, t.g, t.h)), cells("g h", "SELECT a.i, b.i AS j, sum(a.v * b.v) + sum(x.v * y.v) AS v FROM g a JOIN h b ON a.j = b.j JOIN h x ON x.i = a.i AND x.j = a.j JOIN g y ON y.i = b.i AND y.j = b.j WHERE a.i >= b.i GROUP BY 1, 2")),
    "update_trm": (lambda t: shown(pr.update_trm(1.0, t.g, t.h, uplo="upper")), cells("g h", "SELECT * FROM (" + _GG.format("g", "h") + ") q WHERE i <= j")),
    # level 2
    "mvmult": (lambda t: shown(pr.mvmult(2.0, t.e, t.w, 0.5, t.x)), entries("e w x", "SELECT q.i, 2.0 * q.v + 0.5 * x.v AS v FROM (" + _MV.format("a.i", "e", "a.j") + ") q JOIN x ON x.i = q.i")),
    "mvmult_transposed": (lambda t: shown(pr.mvmult(1.0, t.e, t.x, trans=True)), entries("e x", "SELECT e.j AS i, sum(e.v * x.v) AS v FROM e JOIN x ON e.i = x.i GROUP BY 1")),
    "mvmult_absolute": (lambda t: shown(pr.mvmult(1.0, t.e, t.w, absolute=True)), entries("e w", "SELECT a.i, sum(abs(a.v) * w.v) AS v FROM e a JOIN w ON a.j = w.i GROUP BY 1")),
    "mvmult_sym": (lambda t: shown(pr.mvmult_sym(1.0, make_triangular(t.g, "lower"), t.w)), entries("g w", _MV.format("a.i", "g", "a.j"))),
    "mvmult_trm": (lambda t: shown(pr.mvmult_trm(1.0, t.g, t.w)), entries("g w", _MV.format("a.i", _LOW, "a.j"))),
    "mvmult_trm_trans": (lambda t: shown(pr.mvmult_trm(1.0, t.g, t.w, trans=True)), entries("g w", _MV.format("a.j", _LOW, "a.i"))),
    "mvupdate": (lambda t: shown(pr.mvupdate(2.0, t.g, 0.5, t.w, _c0(t))), cells("g w", "SELECT g.i, g.j, 2.0 * g.v + 0.5 * w.v * c.v AS v FROM g JOIN w ON w.i = g.i JOIN g c ON c.i = g.j AND c.j = 0")),
    "mvupdate_sym": (lambda t: shown(pr.mvupdate_sym(1.0, t.g, 1.0, t.w)), cells("g w", "SELECT g.i, g.j, g.v + CASE WHEN g.i >= g.j THEN a.v * b.v ELSE 0.0 END AS v FROM g JOIN w a ON a.i = g.i JOIN w b ON b.i = g.j")),
    "mvupdate2_sym": (
        lambda t: shown(pr.mvupdate2_sym(1.0, t.g, 1.0, t.w, _c0(t))),
        cells("g w", "SELECT g.i, g.j, g.v + CASE WHEN g.i >= g.j THEN a.v * d.v + c.v * b.v ELSE 0.0 END AS v FROM g JOIN w a ON a.i = g.i JOIN w b ON b.i = g.j JOIN g c ON c.i = g.i AND c.j = 0 JOIN g d ON d.i = g.j AND d.j = 0"),
    ),
    "mvupdate_trm": (lambda t: shown(pr.mvupdate(-0.5, make_triangular(t.g, "upper"), 1.0, t.w, _c0(t), "upper")), cells("g w", "SELECT g.i, g.j, w.v * c.v - 0.5 * g.v AS v FROM g JOIN w ON g.i = w.i JOIN g c ON c.i = g.j AND c.j = 0 WHERE g.i <= g.j")),
    # extended precision
    "ext_sum": (lambda t: rounded(extended.total(_flat(t), 2.0)), _exact_number("(SELECT 2 * sum(v) FROM mi)")),
    "ext_asum": (lambda t: rounded(extended.total(_flat(t), absolute=True)), _exact_number("(SELECT sum(abs(v)) FROM mi)")),
    "ext_k_fold_sum": (lambda t: rounded(extended.k_fold_sum(_huge(t), 4)), _exact_number("(SELECT sum(v) FROM mi)")),
    "ext_dot": (lambda t: rounded(extended.dot(_flat(t), _tiled(t), 3.0)), _exact_number("(SELECT 3 * sum(mi.v * wi.v) FROM mi JOIN wi ON mi.j = wi.i)")),
    "ext_adot": (lambda t: rounded(extended.dot(_flat(t), _tiled(t), 1.0, 0.5)), _exact_number("(SELECT 0.5::DOUBLE + CAST(sum(mi.v * wi.v) AS DOUBLE) FROM mi JOIN wi ON mi.j = wi.i)")),
    "ext_nrm2": (
        lambda t: rounded(extended.nrm2(Vector(column_of(t.e, 0).df.select("i", (F.col("v") * 1e200).alias("v")), t.n)).select((F.col("value") / 1e200).alias("value"))),
        number("e", "(SELECT sqrt(sum(v * v)) FROM e WHERE j = 0)"),
    ),
    "ext_axpby": (
        lambda t: shown(extended.axpby(3.0, column_of(_m(t), 0), -1.0, Vector(t.w.df.select("i", F.when(F.col("i") % 2 == 0, 3 * 2.0**50).otherwise(-3 * 2.0**50).alias("v")), 64))),
        entries("g", "SELECT i, 3.0 * round(v) AS v FROM g WHERE j = 0"),
    ),
    "ext_scale": (
        lambda t: extended.scale(column_of(_m(t), 0), 3.0).select("i", ((F.col("v") - F.when(F.col("i") % 2 == 0, 3 * 2.0**50).otherwise(-3 * 2.0**50)) + F.col("dv") + 0.0).alias("v")),
        entries("g", "SELECT i, 3.0 * round(v) AS v FROM g WHERE j = 0"),
    ),
    "ext_mvmult": (lambda t: shown(extended.mvmult(1.0, _m(t), _wi(t))), _exact("SELECT mi.i, sum(mi.v * wi.v) AS v FROM mi JOIN wi ON mi.j = wi.i GROUP BY 1")),
    "ext_mvmult_sym": (lambda t: shown(extended.mvmult_sym(1.0, make_triangular(_m(t), "upper"), _wi(t), uplo="upper")), _exact("SELECT mi.i, sum(mi.v * wi.v) AS v FROM mi JOIN wi ON mi.j = wi.i GROUP BY 1")),
    "ext_mvmult_trm": (lambda t: shown(extended.mvmult_trm(1.0, _m(t), _wi(t))), _exact("SELECT mi.i, sum(mi.v * wi.v) AS v FROM mi JOIN wi ON mi.j = wi.i WHERE mi.i >= mi.j GROUP BY 1")),
    "ext_mvupdate": (lambda t: shown(extended.mvupdate(1.0, _against(t, 1.0), 1.0, _near(t, 2.0**30), _near(t, 2.0**30))), cells("", f"SELECT a.i, b.i AS j, a.v * b.v AS v FROM {_WHOLE} a, {_WHOLE} b")),
    "ext_mvupdate_trm": (
        lambda t: shown(extended.mvupdate_trm(1.0, make_triangular(_against(t, 1.0), "upper"), 1.0, _near(t, 2.0**30), _near(t, 2.0**30), "upper")),
        cells("", f"SELECT a.i, b.i AS j, a.v * b.v AS v FROM {_WHOLE} a, {_WHOLE} b WHERE a.i <= b.i"),
    ),
    "ext_mvupdate2_sym": (
        lambda t: shown(Matrix(extended.mvupdate2_sym(1.0, _against(t, 2.0), 1.0, _near(t, 2.0**30), _near(t, 2.0**30)).df.where(triangle("lower")), 64, 64)),
        cells("", f"SELECT a.i, b.i AS j, 2 * a.v * b.v AS v FROM {_WHOLE} a, {_WHOLE} b WHERE a.i >= b.i"),
    ),
    "ext_mult": (lambda t: shown(extended.mult(1.0, _m(t), _wide(t))), _exact("SELECT mi.i, wide.j, sum(mi.v * wide.v) AS v FROM mi JOIN wide ON mi.j = wide.i GROUP BY 1, 2")),
    "ext_mult_sym": (lambda t: shown(extended.mult_sym(1.0, make_triangular(_m(t), "lower"), _wide(t))), _exact("SELECT mi.i, wide.j, sum(mi.v * wide.v) AS v FROM mi JOIN wide ON mi.j = wide.i GROUP BY 1, 2")),
    "ext_mult_trm": (lambda t: shown(extended.mult_trm(1.0, _m(t), _wide(t))), _exact("SELECT mi.i, wide.j, sum(mi.v * wide.v) AS v FROM mi JOIN wide ON mi.j = wide.i WHERE mi.i >= mi.j GROUP BY 1, 2")),
    "ext_update_trm": (
        lambda t: shown(extended.update_trm(1.0, _m(t), Matrix(_wide(t).df, 64, 64))),
        _exact("SELECT mi.i, wide.j, sum(mi.v * wide.v) AS v FROM mi JOIN wide ON mi.j = wide.i WHERE mi.i >= wide.j GROUP BY 1, 2"),
    ),
    "ext_solve_trm": (lambda t: shown(pr.mult_trm(1.0, t.h, extended.solve_trm(t.h, t.b))), cells("b", "SELECT * FROM b")),
    "ext_mvsolve_trm": (lambda t: shown(pr.mvmult_trm(1.0, t.h, extended.mvsolve_trm(1.0, t.h, t.w))), entries("w", "SELECT * FROM w")),
}
