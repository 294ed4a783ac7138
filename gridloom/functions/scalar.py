"""Small closed forms as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .eft import two_prod


def givens(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """(c, s, r) of the rotation that maps (a, b) to (r, 0)."""
    r = F.hypot(a, b)
    c = F.when(b == 0, 1.0).when(a == 0, 0.0).otherwise(a / r)
    s = F.when(b == 0, 0.0).when(a == 0, 1.0).otherwise(b / r)
    return c, s, F.when(b == 0, a).when(a == 0, b).otherwise(r)


def rotate(y0: Column, y1: Column, c: Column, s: Column) -> tuple[Column, Column]:
    """The pair rotated by (c, s)."""
    return c * y0 + s * y1, c * y1 - s * y0


def sym_eigen2x2(a: Column, b: Column, c: Column) -> tuple[Column, Column]:
    """Eigenvalues of [[a, b], [b, c]]: the one of larger absolute value first."""
    mean, off = (a + c) / 2, F.hypot((a - c) / 2, b)
    first = F.when(mean < 0, mean - off).otherwise(mean + off)
    # The other from the determinant, which loses nothing when they differ in size.
    other = F.when(first == 0, 0.0).otherwise((a / first) * c - (b / first) * b)
    return first, other


def _let(made, /, **values: Column) -> Column:
    """made(struct of the named values), each computed once however often it is used."""
    return F.transform(F.array(F.struct(*[v.alias(n) for n, v in values.items()])), made)[0]


def _vector(a: Column, b: Column, c: Column) -> Column:
    """Struct (x, y): the unit eigenvector of the first eigenvalue, larger component positive."""

    def pick(v):
        big = v["x1"] * v["x1"] + v["y1"] * v["y1"] >= v["x2"] * v["x2"] + v["y2"] * v["y2"]
        return F.struct(F.when(big, v["x1"]).otherwise(v["x2"]).alias("x"), F.when(big, v["y1"]).otherwise(v["y2"]).alias("y"))

    def unit(v):
        norm = F.hypot(v["x"], v["y"])
        sign = F.when(F.when(F.abs(v["x"]) >= F.abs(v["y"]), v["x"]).otherwise(v["y"]) < 0, -1.0).otherwise(1.0)
        return F.struct(F.when(norm == 0, 1.0).otherwise(sign * v["x"] / norm).alias("x"), F.when(norm == 0, 0.0).otherwise(sign * v["y"] / norm).alias("y"))

    def two(v):
        return _let(lambda w: pick(w), x1=v["b"], y1=v["first"] - v["a"], x2=v["first"] - v["c"], y2=v["b"])

    made = _let(two, a=a, b=b, c=c, first=sym_eigen2x2(a, b, c)[0])
    return F.transform(F.array(made), unit)[0]


def sym_eigen2x2_vector(a: Column, b: Column, c: Column) -> tuple[Column, Column]:
    """(cs, sn): unit eigenvector of the first eigenvalue, its larger component positive."""
    v = _vector(a, b, c)
    return v["x"], v["y"]


def svd2x2(f: Column, g: Column, h: Column) -> tuple[Column, Column]:
    """(smallest, largest) singular value of the triangle [[f, g], [0, h]]."""
    plus, minus = F.hypot(f + h, g), F.hypot(f - h, g)
    large = (plus + minus) / 2
    return F.when(large == 0, 0.0).otherwise(F.abs(f) * (F.abs(h) / large)), large


def svd2x2_vectors(f: Column, g: Column, h: Column) -> tuple[Column, Column, Column, Column]:
    """(cl, sl, cr, sr): the left and right vectors of the largest singular value of
    [[f, g], [0, h]], so that [[cl, sl], [-sl, cl]] * A * [[cr, -sr], [sr, cr]] is
    diagonal.  The right one is the first eigenvector of A^T*A, the left one A times it."""

    def right(v):
        part = lambda n: F.when(v["top"] == 0, 0.0).otherwise(v[n] / v["top"])
        return _let(both, f=part("f"), g=part("g"), h=part("h"))

    def both(v):
        return _let(left, f=v["f"], g=v["g"], h=v["h"], r=_vector(v["f"] * v["f"], v["f"] * v["g"], v["g"] * v["g"] + v["h"] * v["h"]))

    def left(v):
        x, y = v["f"] * v["r"]["x"] + v["g"] * v["r"]["y"], v["h"] * v["r"]["y"]
        norm = F.hypot(x, y)
        return F.struct(F.when(norm == 0, 1.0).otherwise(x / norm).alias("cl"), F.when(norm == 0, 0.0).otherwise(y / norm).alias("sl"), v["r"]["x"].alias("cr"), v["r"]["y"].alias("sr"))

    made = _let(right, f=f, g=g, h=h, top=F.greatest(F.abs(f), F.abs(g), F.abs(h)))
    return made["cl"], made["sl"], made["cr"], made["sr"]


def discriminant(a: Column, b: Column, c: Column) -> Column:
    """b*b - a*c with the rounding errors of both products put back."""
    p, dp = two_prod(b, b)
    q, dq = two_prod(a, c)
    return (p - q) + (dp - dq)


def quadratic_roots(a: Column, b: Column, c: Column) -> tuple[Column, Column]:
    """Roots of a*x*x - 2*b*x + c, larger absolute value first; null if they are complex."""
    d = discriminant(a, b, c)
    r = F.sqrt(d)
    big = b + F.when(b < 0, -r).otherwise(r)
    return F.when(d >= 0, big / a), F.when(d >= 0, F.when(big == 0, 0.0).otherwise(c / big))
