"""The registered queries of the linear-algebra operators and their SQL.

Factorisations are shown by what they must give back: the product of the factors, the
right-hand side from the solution, the identity from an inverse.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import queries_basic, queries_factor, queries_products, queries_sparse, queries_spectral
from .tables import Tables

PARTS = (queries_basic, queries_products, queries_factor, queries_spectral, queries_sparse)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for part in PARTS:
        for name, (make, _) in part.QUERIES.items():
            found[name] = lambda spark, sf_dir, make=make: make(Tables(spark, sf_dir))
    return found


def oracle_sql() -> dict[str, str]:
    return {name: text for part in PARTS for name, (_, text) in part.QUERIES.items() if text}
