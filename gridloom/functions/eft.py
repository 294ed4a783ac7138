"""Error-free transforms as column expressions.

two_sum and two_prod return the rounded result and its exact error; sums and dot
products that carry the error along are as good as if done in twice the precision.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the splitter of 53-bit numbers, 2**27 + 1.
SPLITTER = 134217729.0


def two_sum(a: Column, b: Column) -> tuple[Column, Column]:
    """(s, e) with s = fl(a + b) and s + e = a + b exactly."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def split(a: Column) -> tuple[Column, Column]:
    """High and low halves of a, with at most 26 bits each."""
    c = SPLITTER * a
    high = c - (c - a)
    return high, a - high


def two_prod(a: Column, b: Column) -> tuple[Column, Column]:
    """(p, e) with p = fl(a * b) and p + e = a * b exactly."""
    p = a * b
    ah, al = split(a)
    bh, bl = split(b)
    return p, al * bl - (((p - ah * bh) - al * bh) - ah * bl)


def _pair(s: Column, c: Column) -> Column:
    return F.struct(s.alias("s"), c.alias("c"))


def sum2(values: Column) -> Column:
    """Compensated sum of an array of doubles."""

    def step(acc, x):
        s, e = two_sum(acc["s"], x)
        return _pair(s, acc["c"] + e)

    return F.aggregate(values, _pair(F.lit(0.0), F.lit(0.0)), step, lambda acc: acc["s"] + acc["c"])


def dot2(pairs: Column) -> Column:
    """Compensated dot product of an array of structs (a, b)."""

    def step(acc, x):
        p, e = two_prod(x["a"], x["b"])
        s, t = two_sum(acc["s"], p)
        return _pair(s, acc["c"] + (t + e))

    return F.aggregate(pairs, _pair(F.lit(0.0), F.lit(0.0)), step, lambda acc: acc["s"] + acc["c"])


def sumk(values: Column, k: int, parts: bool = False) -> Column:
    """Sum of an array as if in k-fold precision: k - 1 levels of errors are kept.  parts:
    the levels themselves, as an array of k numbers, whose sum it is."""

    def step(acc, x):
        levels, carry = [], x
        for n in range(k - 1):
            s, carry = two_sum(acc[f"s{n}"], carry)
            levels.append(s.alias(f"s{n}"))
        return F.struct(*levels, (acc["rest"] + carry).alias("rest"))

    start = F.struct(*[F.lit(0.0).alias(f"s{n}") for n in range(k - 1)], F.lit(0.0).alias("rest"))

    def finish(acc):
        if parts:
            return F.array(*[acc[f"s{n}"] for n in range(k - 1)], acc["rest"])
        total = acc["rest"]
        for n in reversed(range(k - 1)):
            total = total + acc[f"s{n}"]
        return total

    return F.aggregate(values, start, step, finish)
