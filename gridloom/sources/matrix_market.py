"""Matrix-Market files as matrices, read and written by Spark's text source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.matrix import Matrix, grid


class FormatError(ValueError):
    """A file that is not a supported Matrix-Market file."""


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, line): lines with their place, by file, block of the file and inside it."""
    text = spark.read.text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.trim("value").alias("line"))


def read(spark: SparkSession, path: str, mirror: bool = False) -> Matrix:
    """A coordinate or array file, real, integer or pattern, general or symmetric.

    Indices are 1-based in the file.  Symmetric coordinate files give the stored
    triangle (`mirror`: both); symmetric array files are packed by columns of the lower
    triangle.  A folder is read as its files one after another by name.  Only the banner and the size line reach the driver.
    """
    lines = _lines(spark, path)
    banner = lines.where(F.col("line").startswith("%%MatrixMarket")).orderBy("file", "block", "at").select("line").first()
    if banner is None:
        raise FormatError("no banner")
    _, what, form, field, shape = (banner["line"].lower().split() + [""] * 5)[:5]
    if what != "matrix" or form not in ("coordinate", "array") or field not in ("real", "integer", "pattern", "double") or shape not in ("general", "symmetric"):
        raise FormatError(banner["line"])
    data = lines.where((F.col("line") != "") & ~F.col("line").startswith("%"))
    first = data.orderBy("file", "block", "at").limit(1).first()
    sizes = [int(x) for x in first["line"].split()]
    rows, cols = sizes[0], sizes[1]
    data = data.where(~((F.col("file") == first["file"]) & (F.col("block") == first["block"]) & (F.col("at") == first["at"])))
    words = F.split("line", r"\s+")
    if form == "coordinate":
        value = F.lit(1.0) if field == "pattern" else words[2].cast("double")
        out = data.select((words[0].cast("long") - 1).alias("i"), (words[1].cast("long") - 1).alias("j"), value.alias("v"))
    else:
        inside = data.withColumn("n", F.row_number().over(Window.partitionBy("file", "block").orderBy("at")))
        counts = data.groupBy("file", "block").count()
        before = counts.select("file", "block", (F.sum("count").over(Window.orderBy("file", "block")) - F.col("count")).alias("before"))
        placed = inside.join(before, ["file", "block"]).select((F.col("before") + F.col("n") - 1).alias("k"), F.col("line").cast("double").alias("v"))
        if shape == "symmetric":
            # Column j of the packed lower triangle begins at j*n - j*(j-1)/2.
            n = rows
            start = lambda j: j * n - F.floor(j * (j - 1) / 2).cast("long")
            guess = F.floor(((2 * n + 1) - F.sqrt((2 * n + 1) ** 2 - 8.0 * F.col("k"))) / 2).cast("long")
            guess = F.when(start(guess) > F.col("k"), guess - 1).when(start(guess + 1) <= F.col("k"), guess + 1).otherwise(guess)
            out = placed.withColumn("j", guess).select((F.col("k") - start(F.col("j")) + F.col("j")).alias("i"), "j", "v")
        else:
            out = placed.select((F.col("k") % rows).alias("i"), F.floor(F.col("k") / rows).cast("long").alias("j"), "v")
    if shape == "symmetric" and mirror:
        out = out.unionByName(out.where("i != j").select(F.col("j").alias("i"), F.col("i").alias("j"), "v"))
    return Matrix(out, rows, cols)


def write(a: Matrix, path: str, form: str = "array", symmetric: bool = False) -> None:
    """Text files that, one after another by name, are one Matrix-Market file.

    array: all elements by columns; symmetric: the lower triangle only.
    """
    spark = a.df.sparkSession
    cells = a.df.where("i >= j") if symmetric else a.df
    kind = "symmetric" if symmetric else "general"
    if form == "array":
        every = grid(spark, a.rows, a.cols)
        every = every.where("i >= j") if symmetric else every
        cells = every.join(cells, ["i", "j"], "left").select("i", "j", F.coalesce("v", F.lit(0.0)).alias("v"))
        size, line = f"{a.rows} {a.cols}", F.format_string("%.13e", F.col("v"))
    else:
        size, line = f"{a.rows} {a.cols} {cells.count()}", F.format_string("%d %d %.17g", F.col("i") + 1, F.col("j") + 1, F.col("v"))
    head = spark.createDataFrame([(-1, k, x) for k, x in enumerate((f"%%MatrixMarket matrix {form} real {kind}", size))], "j long, i long, line string")
    body = cells.select("j", "i", line.alias("line"))
    head.unionByName(body).repartitionByRange("j", "i").sortWithinPartitions("j", "i").select("line").write.mode("overwrite").text(path)
