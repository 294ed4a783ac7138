"""A bounded, reproducible sample of labelled rows for fitting a classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Most bytes of the texts of one label that a classifier is fitted on.
CLASS_BYTES = 48 << 20

#: Tasks that a sample is dealt over: what they return reaches the driver one by one.
TASKS = 64


def held_out_flag(column: str = "doc_id"):
    """True where crc32 of the id as text leaves 2 modulo 4; null ids are not held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(documents: DataFrame, labels: DataFrame, label: str, per_class: int, seed: int, class_bytes: int = CLASS_BYTES) -> DataFrame:
    """(doc_id, text, y) of at most `per_class` labelled ids for each of y = 0 and y = 1.

    Held-out ids never take part.  Ids labelled twice with different values,
    null labels and values other than 0 and 1 are left out.  The choice is by a
    hash of the id, so reruns agree.  `per_class` bounds the ids, which makes
    the label side safe to broadcast.  Of the rows of a repeated doc_id one is taken,
    by a hash of the text; that is settled before the shuffle, so an id with a third
    of all rows sends one of each task.  Texts are whole: of each label those are taken, in the
    order of the hash, whose bytes add up to `class_bytes` at most, which bounds what a driver
    may gather; a text that alone has more is left out.  The window leaves a label's rows in one
    task, whose result the driver would have to hold in one piece, so they are dealt anew.
    """
    clean = (
        labels.select("doc_id", F.col(label).alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out_flag())
        .groupBy("doc_id")
        .agg(F.min("y").alias("y"), F.max("y").alias("top"))
        .where(F.col("y") == F.col("top"))
        .select("doc_id", "y", F.xxhash64("doc_id", F.lit(seed)).alias("order"))
    )
    chosen = None
    for y in (0, 1):
        part = clean.where(F.col("y") == y).orderBy("order", "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    found = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("m")
    size = F.coalesce(F.octet_length("m.text"), F.lit(0)).cast("long")
    rows = found.groupBy("doc_id", "y", "order").agg(one).select("doc_id", "m.text", "y", "order", size.alias("size")).where(F.col("size") <= class_bytes)
    # At most per_class rows of each label.
    running = Window.partitionBy("y").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("sum", F.sum("size").over(running)).where(F.col("sum") <= class_bytes).select("doc_id", "text", "y")
    return rows.repartition(TASKS, "doc_id")


def class_shares(labels: DataFrame, label: str) -> tuple[int, int]:
    """How many labelled, not held-out rows carry 0 and 1 (one aggregate over the whole table)."""
    row = (
        labels.where(~held_out_flag())
        .agg(F.sum(F.when(F.col(label) == 0, 1)).alias("no"), F.sum(F.when(F.col(label) == 1, 1)).alias("yes"))
        .first()
    )
    return int(row["no"] or 0), int(row["yes"] or 0)


def platt(z, y, weight):
    """Slope and offset of a logistic map from raw scores to probabilities (Platt's
    targets, Newton steps).  One class only: slope 0 and that class's smoothed share."""
    import numpy as np

    up, down = weight[y == 1].sum(), weight[y == 0].sum()
    prior = float(np.log((up + 1) / (down + 1)))
    if not (y == 1).any() or not (y == 0).any():
        return 0.0, prior
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, prior
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -35, 35)))
        g, h = weight * (p - target), weight * np.maximum(p * (1 - p), 1e-6)
        hess = np.array([[(h * z * z).sum() + 1e-3, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, np.array([(g * z).sum() + 1e-3 * (a - 1), g.sum()]))
        a, b = a - float(np.clip(step[0], -2, 2)), b - float(np.clip(step[1], -2, 2))
        if abs(step).max() < 1e-8:
            break
    return (float(a), float(b)) if a > 0 else (0.0, prior)
