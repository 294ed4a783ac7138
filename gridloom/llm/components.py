"""Connected components by smallest labels and pointer jumping."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import among, gathered, spent, written

#: Edges that `thinned` looks at together.
TOGETHER = 1 << 19

#: Labels that may be sent to all tasks.
FEW = 1 << 14


def _forest(batches, by: str):
    """mapInArrow: of each TOGETHER edges (a, b) as many as connect the same vertices, each to
    one vertex of its component: the smallest of those that are not only in column `by`.  Other
    tasks may see that one too, but not the vertices of `by`, so that the forests of one large
    group get the same root and no long chains."""
    other = "b" if by == "a" else "a"

    def forest(parts):
        shared, own = (pa.concat_arrays([p.column(c) for p in parts]) for c in (other, by))
        first = pc.unique(shared).sort()
        coded = pa.concat_arrays([first, shared, own]).dictionary_encode()
        x, y = np.split(coded.indices.to_numpy()[len(first) :], 2)
        label = np.arange(len(coded.dictionary))
        while True:
            least = np.minimum(label[x], label[y])
            new = label.copy()
            np.minimum.at(new, x, least)
            np.minimum.at(new, y, least)
            new = new[new]
            if np.array_equal(new, label):
                break
            label = new
        own = np.flatnonzero(label != np.arange(len(label)))
        return pa.record_batch([pc.take(coded.dictionary, pa.array(own)), pc.take(coded.dictionary, pa.array(label[own]))], names=["a", "b"])

    parts, held = [], 0
    for batch in batches:
        parts.append(batch.select(["a", "b"]))
        held += batch.num_rows
        if held >= TOGETHER:
            yield forest(parts)
            parts, held = [], 0
    if held:
        yield forest(parts)


def thinned(edges: DataFrame, by: str, rows: int | None = None) -> DataFrame:
    """Fewer edges with the same components, of about `rows` (None: not known).  Tasks hold all edges of their vertices of column
    `by`, of which none should have very many, and keep a forest of them: where those vertices
    share their neighbours, as the members of a large group do, one edge is left of each."""
    kind = edges.schema["a"].dataType.simpleString()
    dealt = gathered(edges.where(F.col("a") != F.col("b")).select("a", "b").repartition(by), rows)
    return dealt.mapInArrow(partial(_forest, by=by), f"a {kind}, b {kind}")


def components(edges: DataFrame) -> DataFrame:
    """(v, c): every vertex of `edges` (a, b) with the smallest vertex of its component.

    Each round takes the least label among a vertex's neighbours, then the label
    of that label.  Labels are written to the shared folder every round, which
    cuts the lineage and leaves plain tables on both sides of the joins, so that
    adaptive execution can split a vertex with very many edges.  Minima are
    pre-aggregated before their shuffle, together with the labels themselves, so a
    round has two joins and two tables: each small join is a broadcast that the
    driver holds.  Up to FEW labels are sent to the tasks by plan, so that neither side
    is shuffled for it.  Only the numbers of edges and labels and whether one has changed reach the driver.
    """
    a, b = F.col("a"), F.col("b")
    # Edges are made once and not compared with each other: an edge that comes twice changes no minimum.
    ways = F.explode(F.array(F.struct(a.alias("a"), b.alias("b")), F.struct(b.alias("a"), a.alias("b")))).alias("way")
    both = written(edges.where(a != b).select(ways).select("way.*"), "edges")
    labels = both.groupBy(a.alias("v")).agg(F.least(F.first("a"), F.min("b")).alias("c"))
    rows = both.count()
    labels = written(gathered(labels, rows), "labels")
    few = labels.count() <= FEW
    while True:
        # Label of my label, then the least such label around me.
        up = labels.alias("x").join(among(labels.select(F.col("v").alias("p"), F.col("c").alias("cc")), few).alias("y"), F.col("x.c") == F.col("y.p")).select("v", "c", "cc")
        up = written(up, "labels")
        near = both.join(among(up.select(F.col("v").alias("b"), F.col("cc").alias("m")), few), "b").select(a.alias("v"), F.lit(None).cast(up.schema["c"].dataType).alias("c"), "m")
        least = up.select("v", "c", F.col("cc").alias("m")).unionByName(near).groupBy("v").agg(F.max("c").alias("c"), F.min("m").alias("m"))
        step = least.select("v", F.col("m").alias("c"), (F.col("c") != F.col("m")).alias("moved"))
        step = written(gathered(step, rows), "labels")
        spent(labels, up)
        still, labels = step.where("moved").isEmpty(), step
        if still:
            spent(both)
            return labels.select("v", "c")
