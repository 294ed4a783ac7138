"""Mixing sources to target weights by a multivariate hypergeometric splitting tree.

Each source is dealt into blocks by a hash of doc_id and text.  Its target decides how
many passes over its blocks the mix takes: whole passes, then a prefix of the
permuted blocks, ending inside one block; rows behind that still fit and the one
row that then comes nearest fill it up.  Every (source, pass, block) is a unit,
and the units of a source are its quota.  A binary tree splits the quotas among
the output shards: at each node a multivariate hypergeometric draw gives the left
child its exact number of units of every source.  Each shard then takes its own
range of the source's permuted units and shuffles its rows locally.

The number of blocks follows the square root of the number of rows, so that neither
the blocks of a source nor the rows of a block, which are ordered in one task each,
outgrow it: 200,000 of each at 40 billion rows.  Targets order one row for each source.
Rows meet their draws by a join on (source, block), so a source with most of the rows is
spread over all of its blocks.  Texts are shuffled once, to their shards.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import aside, among, back, spent, written

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mix:
    """weights repeat over the sources in code point order, null last.  most_repeats
    bounds how often a document is taken.  least_blocks: blocks of a source at least.
    levels: log2 of the number of shards.  shared: rows of the table of blocks that may be
    broadcast; a larger one is joined by a shuffle of the rows it meets.  few: the same for
    tables of a row for each source."""

    weights: tuple = (1, 2, 3)
    most_repeats: int = 3
    least_blocks: int = 256
    levels: int = 4
    shared: int = 200_000
    few: int = 1 << 14
    seed: int = 17

    def blocks(self, rows: int) -> int:
        return max(self.least_blocks, math.isqrt(rows))


def _dealt(documents: DataFrame, mix: Mix, blocks: int) -> DataFrame:
    """`documents` with mix_size (words) and mix_block."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return documents.withColumn("mix_size", size).withColumn("mix_block", F.pmod(F.xxhash64("doc_id", "text", F.lit(mix.seed)), F.lit(blocks)).cast("int"))


def _ranked(dealt: DataFrame, mix: Mix) -> DataFrame:
    """With mix_rank (from 1) and mix_words (running words) in a permuted order of the block."""
    order = Window.partitionBy("source", "mix_block").orderBy("mix_order", "doc_id", "mix_size", "mix_text")
    ranked = dealt.withColumn("mix_rank", F.row_number().over(order)).withColumn("mix_words", F.sum("mix_size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return ranked.drop("mix_order", "mix_text")


def _order(mix: Mix) -> list:
    return [F.xxhash64("doc_id", F.lit(mix.seed + 1)).alias("mix_order"), F.xxhash64("text").alias("mix_text")]


def _rows(documents: DataFrame, mix: Mix, blocks: int) -> DataFrame:
    """Written (doc_id, source, mix_size, mix_block, mix_rank, mix_words), one row for each of
    `documents`, without the texts."""
    narrow = _dealt(documents.select("doc_id", "text", "source"), mix, blocks)
    return written(_ranked(narrow.select("doc_id", "source", "mix_size", "mix_block", *_order(mix)), mix), "rows")


def targets(sizes: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """(s, source, source_size, target) from (source, source_size).

    The sources share the total by weight; none may exceed most_repeats times its
    size, the excess going to the others by weight.  With sources by rising
    limit / weight, the common level is the largest rest / (weights of the rest)
    over all prefixes taken as full, and a target is the smaller of its limit and
    its weight times the level.  This orders one row for each source.
    """
    every = Window.partitionBy()
    n = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weights = F.array(*[F.lit(float(w)) for w in mix.weights])
    table = sizes.withColumn("s", n).withColumn("weight", F.element_at(weights, F.pmod(F.col("s") - 1, len(mix.weights)) + 1))
    table = table.withColumn("limit", mix.most_repeats * F.col("source_size").cast("double"))
    before = Window.orderBy(F.col("limit") / F.col("weight"), "s").rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    table = table.withColumn("level", rest / left).withColumn("level", F.max("level").over(every))
    return table.select("s", "source", "source_size", F.least("limit", F.col("weight") * F.col("level")).alias("target"))


def _behind(place, rank):
    """Whether a row comes after a rank of a block in its source's order."""
    return (F.col("place") > place) | ((F.col("place") == place) & (F.col("mix_rank") > rank))


def _steps(spare: DataFrame, state: DataFrame, few: bool = False) -> DataFrame:
    """(s, lack, from_place, from_rank, to_place, to_rank, left): a source takes its rows of at
    most `lack` words behind one rank and not behind another, and then lacks `left`.

    A step ends at the first row that no longer fits; the next goes on behind it with what
    is lacking.  Such rows get smaller from step to step, so in a permuted order the steps are few.
    As before, only block sums and the rows of one block are ordered.  A step has two joins, as
    each of these small ones is a broadcast that the driver holds.  few: `state` has few rows."""
    done, far = None, 2**31 - 1
    while True:
        fits = _behind(F.col("from_place"), F.col("from_rank")) & (F.col("mix_size") <= F.col("lack"))
        own = ["lack", "from_place", "from_rank"]
        upto = Window.partitionBy("s").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
        sums = spare.join(among(state, few), "s").where(fits).groupBy("s", "place", *own).agg(F.sum("mix_size").alias("words")).withColumn("end", F.sum("words").over(upto))
        over = F.when(F.col("end") > F.col("lack"), F.struct("place", (F.col("end") - F.col("words")).alias("start")))
        ends = written(sums.groupBy("s", *own).agg(F.min(over).alias("m"), F.max("end").alias("whole")).select("s", *own, "whole", F.col("m.place").alias("to_place"), F.col("m.start").alias("start")), "ends")
        ranks = Window.partitionBy("s").orderBy("mix_rank").rowsBetween(Window.unboundedPreceding, 0)
        last = spare.join(among(ends.where("start is not null").withColumn("place", F.col("to_place")), few), ["s", "place"]).where(fits).withColumn("run", F.col("start") + F.sum("mix_size").over(ranks))
        last = last.where(F.col("run") <= F.col("lack")).select(*ends.columns, F.col("mix_rank").alias("to_rank"), "run")
        none = [F.lit(None).cast(last.schema[c].dataType).alias(c) for c in ("to_rank", "run")]
        last = ends.select("*", *none).unionByName(last).groupBy(*ends.columns).agg(F.max("to_rank").alias("to_rank"), F.max("run").alias("run"))
        used = F.when(F.col("start").isNull(), F.col("whole")).otherwise(F.coalesce("run", "start"))
        rank = F.coalesce("to_rank", F.when(F.col("to_place") == F.col("from_place"), F.col("from_rank")).otherwise(0))
        step = last.select("s", "lack", "from_place", "from_rank", F.coalesce("to_place", F.lit(far)).alias("to_place"), rank.alias("to_rank"), (F.col("lack") - used).alias("left"))
        step = written(step, "steps")
        done = step if done is None else done.unionByName(step)
        state = step.where(F.col("to_place") < far).select("s", F.col("left").alias("lack"), F.col("to_place").alias("from_place"), F.col("to_rank").alias("from_rank"))
        if state.isEmpty():
            return done


def _units(rows: DataFrame, goals: DataFrame, mix: Mix, few: bool = False) -> DataFrame:
    """(s, source, block, pass, low, high, whole): what each unit takes of its block, by rank.
    few: `goals` has few rows."""
    goals = goals.withColumn("full", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    goals = goals.withColumn("rest", F.col("target") - F.col("full") * F.col("source_size"))
    blocks = rows.groupBy("source", F.col("mix_block").alias("block")).agg(F.sum("mix_size").alias("words"), F.count("*").cast("int").alias("rows"))
    blocks = blocks.alias("b").join(among(goals, few).alias("g"), F.col("b.source").eqNullSafe(F.col("g.source"))).select("s", "b.source", "block", "words", "rows", "full", "rest")
    order = Window.partitionBy("s").orderBy(F.xxhash64("s", "block", F.lit(mix.seed + 2)), "block")
    blocks = blocks.withColumn("end", F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    blocks = written(blocks.withColumn("place", F.row_number().over(order)).withColumn("start", F.col("end") - F.col("words")), "blocks")
    whole = F.col("end") <= F.col("rest")
    inside = (F.col("start") < F.col("rest")) & (F.col("end") > F.col("rest"))

    # The block in which a source's last pass ends: rows up to a rank, then rows behind
    # it that still fit, then the one row outside that brings the source nearest to its target.
    open_ = blocks.where(~whole & (F.col("rest") > 0))
    outside = rows.alias("r").join(open_.alias("o"), F.col("r.source").eqNullSafe(F.col("o.source")) & (F.col("mix_block") == F.col("block")))
    outside = outside.select("s", "o.source", "block", "full", "place", "mix_rank", "mix_size", "rest", "start", inside.alias("inside"), (inside & (F.col("start") + F.col("mix_words") <= F.col("rest"))).alias("taken"))
    cut = written(
        outside.where("inside").groupBy("s", "source", "block", "full", "place").agg(
            F.count(F.when(F.col("taken"), 1)).cast("int").alias("high"),
            (F.first("rest") - F.first("start") - F.coalesce(F.sum(F.when(F.col("taken"), F.col("mix_size"))), F.lit(0))).alias("lack"),
        ),
        "cuts",
    )
    spare = open_rows = written(outside.where("not taken and mix_size > 0").select("s", "source", "block", "full", "place", "mix_rank", "mix_size"), "spare")
    steps = _steps(spare, cut.select("s", "lack", F.col("place").alias("from_place"), F.col("high").alias("from_rank")), few).groupBy("s")
    steps = cut.select("s", F.col("lack").alias("first")).join(among(steps.agg(F.min("left").alias("left"), F.collect_list(F.struct("lack", "from_place", "from_rank", "to_place", "to_rank")).alias("steps")), few), "s", "left")
    fits = F.exists("steps", lambda t: (F.col("mix_size") <= t["lack"]) & _behind(t["from_place"], t["from_rank"]) & ~_behind(t["to_place"], t["to_rank"]))
    spare = spare.join(among(steps, few), "s").select("s", "source", "block", "full", "mix_rank", "mix_size", F.coalesce("left", "first").alias("lack"), F.coalesce(fits, F.lit(False)).alias("taken"))
    spare = fitted = written(spare, "fitted")
    spent(open_rows)
    # Ranks that follow each other are one range.
    apart = F.col("mix_rank") - F.row_number().over(Window.partitionBy("s", "block").orderBy("mix_rank"))
    fill = spare.where("taken").withColumn("apart", apart).groupBy("s", "source", "block", "full", "apart").agg(F.min("mix_rank").alias("low"), F.max("mix_rank").alias("high")).drop("apart")
    gap = F.abs(F.col("mix_size") - F.col("lack"))
    top = spare.where("not taken").where(gap < F.col("lack")).groupBy("s", "source", "full").agg(F.min(F.struct(gap.alias("gap"), "block", F.col("mix_rank").alias("low"))).alias("m")).select("s", "source", "m.block", "full", "m.low", F.col("m.low").alias("high"))

    passes = F.sequence(F.lit(1), F.col("full") + whole.cast("int"))
    units = blocks.where(F.col("full") + whole.cast("int") > 0).select("s", "source", "block", F.explode(passes).alias("pass"), F.lit(1).alias("low"), F.col("rows").alias("high"), F.lit(True).alias("whole"))
    for part in (cut.where("high > 0").select("s", "source", "block", "full", F.lit(1).alias("low"), "high"), fill, top):
        units = units.unionByName(part.select("s", "source", "block", (F.col("full") + 1).alias("pass"), "low", "high", F.lit(False).alias("whole")))
    units = written(units, "units")
    spent(blocks, cut, fitted)
    return units


def _tree(quotas: DataFrame, mix: Mix) -> DataFrame:
    """(s, shard, q) from (s, q): two levels of the splitting tree after another.  A node's
    group holds one row for each source and leaves four."""
    seed = mix.seed

    def split(levels):
        def run(key, frame):
            import numpy as np
            import pandas as pd

            frame = frame.sort_values("s")
            s = frame["s"].to_numpy()
            nodes = {int(key[0]): frame["q"].to_numpy(np.int64)}
            for _ in range(levels):
                below = {}
                for node, q in nodes.items():
                    total = int(q.sum())
                    left = np.random.default_rng([seed, node]).multivariate_hypergeometric(q, total // 2, method="marginals") if total else q
                    below |= {2 * node: left, 2 * node + 1: q - left}
                nodes = below
            return pd.DataFrame({"node": np.repeat(list(nodes), len(s)), "s": np.tile(s, len(nodes)), "q": np.concatenate(list(nodes.values()))})

        return run

    table = quotas.select(F.lit(1).cast("long").alias("node"), F.col("s").cast("long").alias("s"), F.col("q").cast("long").alias("q"))
    for level in range(0, mix.levels, 2):
        table = table.groupBy("node").applyInPandas(split(min(2, mix.levels - level)), "node long, s long, q long")
    return written(table.select("s", (F.col("node") - (1 << mix.levels)).cast("int").alias("shard"), "q").where("q > 0"), "quotas")


def _draws(rows: DataFrame, goals: DataFrame, mix: Mix) -> DataFrame:
    """(source, block, draws): for each block its units as structs (pass, shard, low, high, whole)."""
    few = goals.count() <= mix.few
    units = _units(rows, goals, mix, few)
    quotas = _tree(units.groupBy("s").agg(F.count("*").alias("q")), mix)
    upto = F.sum("q").over(Window.partitionBy("s").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0))
    ends = quotas.withColumn("upto", upto).groupBy("s").agg(F.array_sort(F.collect_list(F.struct("upto", "shard"))).alias("ends"))
    order = Window.partitionBy("s").orderBy(F.xxhash64("s", "pass", "block", "low", F.lit(mix.seed + 3)), "pass", "block", "low")
    placed = units.withColumn("place", F.row_number().over(order).cast("long")).withColumn("s", F.col("s").cast("long"))
    # A place belongs to the first shard that ends at it or behind.
    found = placed.join(among(ends, few), "s").withColumn("shard", F.filter("ends", lambda e: e["upto"] >= F.col("place"))[0]["shard"])
    draws = written(found.groupBy("source", "block").agg(F.array_sort(F.collect_list(F.struct("pass", "shard", "low", "high", "whole"))).alias("draws")), "draws")
    spent(units)
    return draws


def assign(documents: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """(doc_id, source, size, source_size, target, draws): one row for each row of
    `documents`; draws holds a struct (pass, shard) for each time it is taken.

    Null texts have size 0 and may be taken any number of times up to the limit.
    A null doc_id or source is a value like any other.  Repeated rows are dealt
    one by one.  No source has a target if there are no rows.
    """
    rows = _rows(documents, mix, mix.blocks(documents.count()))
    goals, draws = _plan(rows, mix)
    return _taken(rows, goals, draws)


def _plan(rows: DataFrame, mix: Mix) -> tuple[DataFrame, DataFrame]:
    goals = written(targets(rows.groupBy("source").agg(F.sum("mix_size").alias("source_size")), mix), "targets")
    return goals, _draws(rows, goals, mix)


def _taken(rows: DataFrame, goals: DataFrame, draws: DataFrame) -> DataFrame:
    got = rows.alias("r").join(draws.alias("d"), F.col("r.source").eqNullSafe(F.col("d.source")) & (F.col("mix_block") == F.col("block")), "left")
    mine = F.filter("draws", lambda u: (u["low"] <= F.col("mix_rank")) & (F.col("mix_rank") <= u["high"]))
    mine = F.coalesce(F.transform(mine, lambda u: F.struct(u["pass"].alias("pass"), u["shard"].alias("shard"))), F.array().cast("array<struct<pass:int,shard:int>>"))
    got = got.select("r.*", mine.alias("draws"))
    return got.alias("r").join(goals.alias("g"), F.col("r.source").eqNullSafe(F.col("g.source"))).select("doc_id", "r.source", F.col("mix_size").alias("size"), "source_size", "target", "draws")


def mixed(documents: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mix itself: the rows of `documents`, each as often as it is taken, in equal
    numbers of partitions for each shard and in a random order inside them.

    A unit that takes its whole block needs no ranks, so its rows go straight to
    their shard; only rows of the blocks in which a source's last pass ends are
    ranked again.  No rows, no mix: the result is empty.
    """
    frame, own = aside(documents, ["mix_size", "mix_block", "mix_order", "mix_text", "mix_rank", "mix_words", "mix_draw", "mix_draws", "mix_place", "mix_from", "mix_part", "mix_key"])
    blocks = mix.blocks(documents.count())
    rows = _rows(documents, mix, blocks)
    goals, draws = _plan(rows, mix)
    spent(rows, goals)
    how = "broadcast" if draws.count() <= mix.shared else "merge"
    dealt = _dealt(frame, mix, blocks)

    def meeting(units):
        table = draws.select(F.col("source").alias("mix_from"), F.col("block").alias("mix_place"), units.alias("mix_draws")).where(F.size("mix_draws") > 0)
        return dealt.join(table.hint(how), F.col("source").eqNullSafe(F.col("mix_from")) & (F.col("mix_block") == F.col("mix_place")))

    whole = meeting(F.filter("draws", lambda u: u["whole"])).withColumn("mix_rank", F.lit(0)).withColumn("mix_draw", F.explode("mix_draws"))
    part = meeting(F.filter("draws", lambda u: ~u["whole"]))
    part = _ranked(part.select("*", *_order(mix)), mix).drop("mix_words")
    part = part.withColumn("mix_draw", F.explode(F.filter("mix_draws", lambda u: (u["low"] <= F.col("mix_rank")) & (F.col("mix_rank") <= u["high"]))))
    out = whole.unionByName(part).withColumn("mix_key", F.xxhash64("doc_id", "text", "mix_draw.pass", "mix_rank", F.lit(mix.seed + 4)))
    shards = 1 << mix.levels
    each = -(-int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")) // shards)
    out = out.withColumn("mix_part", (F.col("mix_draw.shard") * each + F.pmod("mix_key", F.lit(each))).cast("int"))
    return back(out.repartitionById(shards * each, F.col("mix_part")).sortWithinPartitions("mix_part", "mix_key"), own)


def query(spark, sf_dir: str) -> DataFrame:
    """op1: how many words the mix takes of every row of `documents`."""
    table = assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return table.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"), "source", F.transform("draws", lambda u: u["shard"]).alias("shards"))
