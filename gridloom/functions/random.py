"""Random elements that depend on position and seed only, not on partitions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform_at(i: Column, j: Column, seed: int = 0) -> Column:
    """Uniform on [0, 1) at (i, j)."""
    return F.pmod(F.xxhash64(i, j, F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)


def normal_at(i: Column, j: Column, seed: int = 0) -> Column:
    """Standard normal at (i, j), by the Box-Muller map of two uniforms."""
    u = 1.0 - uniform_at(i, j, 2 * seed + 1)
    return F.sqrt(-2.0 * F.log(u)) * F.cos(2 * math.pi * uniform_at(i, j, 2 * seed + 2))
