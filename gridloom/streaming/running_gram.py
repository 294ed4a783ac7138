"""A running Gram matrix over a stream of rows.

A^T*A is a sum over rows, so its state is one number for each pair of columns; with
event times it is kept for each window and closed by a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_gram(stream: DataFrame, values: str) -> DataFrame:
    """(i, j, v) of the lower triangle so far; for output mode complete or update."""
    spread = stream.select(F.posexplode(values).alias("i", "x"), F.col(values).alias("a"))
    pairs = spread.select("i", "x", F.posexplode("a").alias("j", "y")).where("i >= j")
    return pairs.groupBy("i", "j").agg(F.sum(F.col("x").cast("double") * F.col("y").cast("double")).alias("v"))


def windowed_gram(stream: DataFrame, values: str, time: str, length: str, delay: str) -> DataFrame:
    """(start, i, j, v) for each window of event time; rows later than `delay` are dropped."""
    kept = stream.withWatermark(time, delay).select(time, F.posexplode(values).alias("i", "x"), F.col(values).alias("a"))
    pairs = kept.select(time, "i", "x", F.posexplode("a").alias("j", "y")).where("i >= j")
    sums = pairs.groupBy(F.window(time, length).alias("w"), "i", "j").agg(F.sum(F.col("x").cast("double") * F.col("y").cast("double")).alias("v"))
    return sums.select(F.col("w.start").alias("start"), "i", "j", "v")
