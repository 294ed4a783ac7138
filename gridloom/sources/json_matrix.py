"""Matrices as JSON texts, one matrix in a row of a table.

{"rows": r, "cols": c, "flags": f, "data": [...]}, the data either all elements by
columns or triples [i, j, v] with 0-based indices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.matrix import Matrix, ShapeError

_SHAPE = "rows int, cols int, flags int, data string"


def _parsed(texts: DataFrame, key: str, column: str) -> DataFrame:
    """(key, rows, cols, flags, parts): parts has an array (i, j, v) for each element; it is
    null if the text is no matrix, as is rows."""
    given = texts.select(F.col(key).alias("key"), F.col(column).alias("text")).where("text is not null")
    head = given.select("key", F.from_json("text", _SHAPE).alias("m")).select("key", "m.*")
    nested = F.ltrim(F.substring("data", 2, 1 << 30)).startswith("[")
    high = F.greatest("rows", F.lit(1))
    dense = F.transform(F.from_json("data", "array<double>"), lambda v, k: F.array((k % high).cast("double"), F.floor(k / high).cast("double"), v))
    sound = F.coalesce((F.col("rows") >= 0) & (F.col("cols") >= 0), F.lit(False))
    parts = F.when(sound & nested, F.from_json("data", "array<array<double>>")).when(sound, dense)
    # An empty list of either form reads as dense; of another length than the sizes it is no whole matrix.
    return head.select("key", "rows", "cols", "flags", parts.alias("parts"), (nested | (F.size(parts) == F.col("rows") * F.col("cols"))).alias("whole"))


def _placed(t):
    inside = (F.size(t) == 3) & (t[0] >= 0) & (t[0] < F.col("rows")) & (t[1] >= 0) & (t[1] < F.col("cols")) & t[2].isNotNull()
    return F.coalesce(inside, F.lit(False))


def faults(texts: DataFrame, key: str = "key", column: str = "json") -> DataFrame:
    """(key, matrix, whole, dropped) of every text that is not null: whether it is a matrix, whether a
    dense list has as many elements as its sizes say, and how many elements `read` leaves out
    because they are outside the sizes or no numbers."""
    parsed = _parsed(texts, key, column)
    return parsed.select("key", F.col("parts").isNotNull().alias("matrix"), F.coalesce("whole", F.lit(False)).alias("whole"), F.coalesce(F.size(F.filter("parts", lambda t: ~_placed(t))), F.lit(0)).alias("dropped"))


def read(texts: DataFrame, key: str = "key", column: str = "json", strict: bool = False) -> DataFrame:
    """(key, rows, cols, flags, i, j, v) of every element.  A null text gives no rows.

    Texts that are no matrix and elements outside the sizes are left out, and `faults` counts
    them; with `strict` they, and dense lists of another length, fail the query with their key."""
    parsed = _parsed(texts, key, column)
    parts = F.filter("parts", _placed)
    if strict:
        sound = F.col("parts").isNotNull() & F.col("whole") & F.forall("parts", _placed)
        fault = F.raise_error(F.concat(F.lit("no whole matrix: "), F.coalesce(F.col("key").cast("string"), F.lit("null"))))
        parts = F.when(F.coalesce(sound, F.lit(False)), F.col("parts")).otherwise(fault)
    cells = parsed.select("key", "rows", "cols", "flags", F.explode(parts).alias("t"))
    return cells.select("key", "rows", "cols", "flags", F.col("t")[0].cast("long").alias("i"), F.col("t")[1].cast("long").alias("j"), F.col("t")[2].alias("v"))


def write(a: Matrix, sparse: bool = False, flags: int = 0, most: int = 1 << 24) -> DataFrame:
    """One row (json): a document is one text, so it holds the whole matrix.  More than `most`
    elements are refused with ShapeError; `write_parts` has no limit."""
    elements = a.df.count() if sparse else a.size
    if elements > most:
        raise ShapeError(f"{elements} elements in one document; write_parts makes several")
    return write_parts(a, sparse, flags, max(a.cols, 1)).select("json")


def write_parts(a: Matrix, sparse: bool = False, flags: int = 0, columns: int = 256) -> DataFrame:
    """(part, json): a document for each `columns` columns (0-based from the first of its
    own), so that no task holds more; a matrix without columns has one document."""
    from ..operators.matrix import dense

    cells = a if sparse else dense(a)
    part = F.floor(F.col("j") / columns).cast("long")
    own = F.struct((F.col("j") - part * columns).alias("j"), "i", "v")
    data = cells.df.groupBy(part.alias("part")).agg(F.array_sort(F.collect_list(own)).alias("c"))
    every = a.df.sparkSession.range(max(1, -(-a.cols // columns))).select(F.col("id").alias("part"))
    data = every.join(data, "part", "left").withColumn("c", F.coalesce("c", F.array().cast("array<struct<j:bigint,i:bigint,v:double>>")))
    shown = F.transform("c", lambda c: F.array(c["i"].cast("double"), c["j"].cast("double"), c["v"])) if sparse else F.transform("c", lambda c: c["v"])
    wide = F.least(F.lit(columns), F.lit(a.cols) - F.col("part") * columns)
    return data.select("part", F.to_json(F.struct(F.lit(a.rows).alias("rows"), wide.cast("int").alias("cols"), F.lit(flags).alias("flags"), shown.alias("data"))).alias("json"))
