"""Matrices and vectors of the test tables that the registered queries work on."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.elementwise import plus
from ..operators.matrix import Matrix, Vector, from_arrays, from_table, identity, vector_from
from ..operators.products import gram
from ..operators.rows import Rows
from ..operators.rows import from_arrays as rows_of

WIDTH = 64


class Tables:
    """e: embeddings, a row each (n x 64).  g: e^T*e.  h: g + I, positive definite.
    s: quantity by supplier and part.  w: 1, 2, ... 64.  x: labels + 1 by vec_id."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def size(self, table: str, key: str) -> int:
        """One more than the largest key."""
        return int(self.table(table).agg(F.coalesce(F.max(key), F.lit(-1))).first()[0]) + 1

    @cached_property
    def n(self) -> int:
        return self.size("embeddings", "vec_id")

    @cached_property
    def labels(self) -> float:
        """The sum of all labels."""
        return float(self.table("embeddings").agg(F.coalesce(F.sum("label"), F.lit(0))).first()[0])

    @cached_property
    def e(self) -> Matrix:
        return from_arrays(self.table("embeddings"), "vec_id", "embedding", self.n, WIDTH)

    @cached_property
    def e_rows(self) -> Rows:
        """e as it lies in the table."""
        return rows_of(self.table("embeddings"), "vec_id", "embedding", self.n, WIDTH)

    @cached_property
    def g(self) -> Matrix:
        return gram(self.table("embeddings"), "embedding", WIDTH)

    @cached_property
    def eye(self) -> Matrix:
        return identity(self.spark, WIDTH)

    @cached_property
    def h(self) -> Matrix:
        return plus(1.0, self.g, 1.0, self.eye)

    @cached_property
    def b(self) -> Matrix:
        """Columns 0 and 1 of g."""
        return Matrix(self.g.df.where("j < 2"), WIDTH, 2)

    @cached_property
    def s(self) -> Matrix:
        return from_table(self.table("lineitem"), "l_suppkey", "l_partkey", "l_quantity", self.size("supplier", "s_suppkey"), self.size("part", "p_partkey"))

    @cached_property
    def w(self) -> Vector:
        return vector_from(self.spark.range(WIDTH), "id", F.col("id") + 1.0, WIDTH)

    @cached_property
    def x(self) -> Vector:
        return vector_from(self.table("embeddings"), "vec_id", F.col("label") + 1.0, self.n)


#: The same in SQL, as common table expressions that follow each other.
CTE = {
    "e": "e AS (SELECT CAST(vec_id AS BIGINT) AS i, CAST(unnest(range(len(embedding))) AS BIGINT) AS j, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)",
    "g": "g AS (SELECT a.j AS i, b.j AS j, sum(a.v * b.v) AS v FROM e a JOIN e b ON a.i = b.i GROUP BY 1, 2)",
    "h": "h AS (SELECT i, j, v + CASE WHEN i = j THEN 1.0 ELSE 0.0 END AS v FROM g)",
    "b": "b AS (SELECT i, j, v FROM g WHERE j < 2)",
    "eye": "eye AS (SELECT CAST(r AS BIGINT) AS i, CAST(r AS BIGINT) AS j, 1.0 AS v FROM range(64) t(r))",
    "s": "s AS (SELECT l_suppkey AS i, l_partkey AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2)",
    "w": "w AS (SELECT CAST(r AS BIGINT) AS i, CAST(r + 1 AS DOUBLE) AS v FROM range(64) t(r))",
    "x": "x AS (SELECT CAST(vec_id AS BIGINT) AS i, CAST(label + 1 AS DOUBLE) AS v FROM embeddings)",
}
NEEDS = {"g": "e", "h": "eg", "b": "eg", "e": "", "eye": "", "s": "", "w": "", "x": ""}


def sql(uses: str, select: str) -> str:
    """`select` after the tables named in `uses` and those that they need."""
    names = uses.split()
    wanted = {n for u in names for n in (*NEEDS[u], u)}
    return ("WITH " if wanted else "") + ", ".join(text for name, text in CTE.items() if name in wanted) + " " + select


def cells(uses: str, body: str) -> str:
    """A matrix (i, j, v), rounded; body gives these columns."""
    return sql(uses, f"SELECT i, j, round(v, 6) + 0.0 AS v FROM ({body}) t")


def entries(uses: str, body: str) -> str:
    """A vector (i, v), rounded."""
    return sql(uses, f"SELECT i, round(v, 6) + 0.0 AS v FROM ({body}) t")


def number(uses: str, expression: str, digits: int = 6) -> str:
    """One rounded value."""
    return sql(uses, f"SELECT round({expression}, {digits}) + 0.0 AS value")


def shown(a: Matrix | Vector) -> DataFrame:
    names = [c for c in ("i", "j") if c in a.df.columns]
    return a.df.select(*names, (F.round("v", 6) + 0.0).alias("v"))


def rounded(frame: DataFrame, digits: int = 6) -> DataFrame:
    return frame.select((F.round("value", digits) + 0.0).alias("value"))


# Checks of more than one product


def faults(frame: DataFrame, *counts: DataFrame) -> DataFrame:
    """`frame` (i, j, v) and one more row (-1, -1, the sum of the counts): what must be 0 if
    the factors have the shape that they claim."""
    every = counts[0].select("n")
    for c in counts[1:]:
        every = every.unionByName(c.select("n"))
    one = every.agg(F.sum("n").cast("double").alias("v")).select(F.lit(-1).cast("long").alias("i"), F.lit(-1).cast("long").alias("j"), "v")
    return frame.unionByName(one)


def checked(uses: str, body: str) -> str:
    """cells, and the row that `faults` adds."""
    return cells(uses, f"{body} UNION ALL SELECT -1 AS i, -1 AS j, 0.0 AS v")


def where_not(a: Matrix, wrong, most: float = 1e-9) -> DataFrame:
    """How many cells are not 0, up to rounding, where `wrong` holds."""
    return a.df.where(wrong).where(F.abs("v") > most).agg(F.count("*").alias("n"))


def not_orthonormal(q: Matrix, rows: bool = False) -> DataFrame:
    """How many cells of Q^T*Q (of Q*Q^T) are not those of the identity."""
    from ..operators.products import mult

    g, n = mult(1.0, q, q, trans_a=not rows, trans_b=rows), q.rows if rows else q.cols
    right = F.sum(F.when((F.col("i") == F.col("j")) & (F.abs(F.col("v") - 1) <= 1e-8), 1).otherwise(0))
    wrong = F.sum(F.when((F.col("i") != F.col("j")) & (F.abs("v") > 1e-8), 1).otherwise(0))
    return g.df.agg((F.coalesce(wrong, F.lit(0)) + n - F.coalesce(right, F.lit(0))).alias("n"))


def power_means(values: DataFrame, n: int, square: bool = False) -> DataFrame:
    """(k, v) for k = 1..4: the k-th root of the mean of v^k (of v^2k), which together tell
    a set of values from others."""
    x = F.col("v") * F.col("v") if square else F.col("v")
    sums = values.select(F.explode(F.sequence(F.lit(1), F.lit(4))).alias("k"), x.alias("x")).groupBy("k").agg(F.sum(F.pow("x", "k")).alias("s"))
    root = F.signum("s") * F.pow(F.abs("s") / n, 1.0 / F.col("k"))
    return sums.select(F.col("k").cast("long").alias("k"), (F.round(root, 5) + 0.0).alias("v"))


def power_means_sql(uses: str, body: str, n: int) -> str:
    """The same of the eigenvalues of the matrix that `body` gives: traces of its powers."""
    trace = "SELECT {k} AS k, sum(a.v * b.v) AS s FROM {x} a JOIN {y} b ON a.i = b.j AND a.j = b.i"
    traces = " UNION ALL ".join(["SELECT 1 AS k, sum(v) AS s FROM m WHERE i = j", *(trace.format(k=k, x=x, y=y) for k, x, y in ((2, "m", "m"), (3, "p", "m"), (4, "p", "p")))])
    return sql(uses, f", m AS ({body}), p AS (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM m a JOIN m b ON a.j = b.i GROUP BY 1, 2), t AS ({traces}) SELECT CAST(k AS BIGINT) AS k, round(sign(s) * pow(abs(s) / {n}, 1.0 / k), 5) + 0.0 AS v FROM t")
