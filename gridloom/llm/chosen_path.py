"""N-gram Jaccard join by chosen paths.

A text is the set of its 5-word shingles.  Identical sets are one class.  Each
run splits the sets recursively on sampled shared tokens: at a node, a set goes
down every token x of its sample with h(node, x) < branch / |sample|, so two sets
that share most tokens share children.  The sample of a set are its smallest
token hashes; it goes along with the set as a narrow column, so that no level
reads the texts again.  Buckets of at most `small` sets are compared by brute
force.  Of a larger one every member is compared with a few pivots: a bucket that
hangs together by them is done, one whose members have too much in common for a
split to help is compared in blocks, and the others are split again.  Runs repeat
until the target recall.

The bucket comparison uses two bits of each of 128 min-hashes and only yields
spanning edges, never all pairs.  The groups so joined are then compared
exactly, in blocks of the full sets: that gives the links and their number.  Only
this step reads texts again, once.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesplit import Texts, mix, shingle_sets
from .components import FEW, components, thinned
from .shared import among, aside, back, gathered, spent, written

SKETCH = 128
WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Join:
    """recall: of a pair just at the similarity, over all runs, if one of its sets
    holds the other (others are found more often).  branch: expected sampled tokens of
    a set at a node.  sample: tokens of a set that paths choose from.  small: sets in a
    bucket that is compared without further splitting.  pivots: sets that members of a
    larger bucket are compared with.  pays: a bucket is split if its members would share
    at most so many children on average, else comparing them now is no dearer.  depth:
    levels of splitting; what is still large and not done at the last is compared in
    blocks, whatever its size.  block, block_tokens: most sets and shingles in one block
    of a comparison, tile: sets of it at once.  slack: a pair at the similarity may
    fall short of the expected agreement of sketches by so many standard deviations."""

    words: int = 5
    similarity: float = 0.8
    recall: float = 0.999
    branch: float = 2.5
    sample: int = 48
    small: int = 512
    pivots: int = 4
    pays: float = 0.9
    depth: int = 6
    block: int = 4096
    block_tokens: int = 1_600_000
    tile: int = 1024
    slack: float = 4.5
    seed: int = 1

    def runs(self) -> int:
        """Runs for the target recall.  A pair shares Binomial(sample, similarity) tokens
        of the larger set's sample, so its common children at a node are about Poisson;
        s is the chance that a line of common nodes goes on to any depth."""
        m, p = self.sample, self.similarity
        chance, on = [], []
        for k in range(m + 1):
            s = 1.0
            for _ in range(200):
                s = 1 - math.exp(-self.branch * k / m * s)
            chance.append(math.comb(m, k) * p**k * (1 - p) ** (m - k))
            on.append(s)
        runs = 1
        while sum(c * (1 - s) ** runs for c, s in zip(chance, on, strict=True)) > 1 - self.recall:
            runs += 1
        return runs

    def least(self) -> float:
        """Equal values among those of two sketches that make a candidate pair."""
        p = self.similarity + (1 - self.similarity) / 4
        return SKETCH * (p - self.slack * math.sqrt(p * (1 - p) / SKETCH))


_rng = np.random.default_rng(77)
_XOR = _rng.integers(0, 2**32, SKETCH, dtype=np.uint32)
_MUL = _rng.integers(0, 2**31, SKETCH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def _sketch(tokens: np.ndarray) -> bytes:
    """Two bits of each min-hash of a set, from all of its bits: the low bits of a
    product only depend on the low bits of its factors, so those of two tokens would
    agree in every min-hash or in none."""
    x = (tokens >> np.uint64(17)).astype(np.uint32)
    low = np.full(SKETCH, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 1024):
        np.minimum(low, ((x[None, k : k + 1024] ^ _XOR[:, None]) * _MUL[:, None]).min(axis=1), out=low)
    low ^= low >> np.uint32(16)
    low *= np.uint32(0x85EBCA6B)
    low ^= low >> np.uint32(13)
    low *= np.uint32(0xC2B2AE35)
    low ^= low >> np.uint32(16)
    return ((low & np.uint32(3)).astype(np.uint8).reshape(-1, 4) * np.array([1, 4, 16, 64], np.uint8)).sum(axis=1, dtype=np.uint8).tobytes()


def _children(nodes: np.ndarray, sets: np.ndarray, tokens: np.ndarray, sizes: np.ndarray, branch: float) -> tuple[np.ndarray, np.ndarray]:
    """(set, child) for every child that set sets[k] takes at nodes[k].  tokens: the
    samples of all sets, one after another, sizes of them each."""
    start = np.cumsum(sizes) - sizes
    many = sizes[sets]
    at = np.repeat(np.arange(len(sets)), many)
    token = tokens[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + start[sets][at]]
    h = mix(token ^ nodes[at])
    below = np.minimum(branch / np.maximum(many, 1), 1.0) * (2.0**64 - 4096)
    taken = np.flatnonzero(h.astype(np.float64) < below[at])
    return sets[at[taken]], mix(h[taken] + np.uint64(1))


def _roots(join: Join) -> np.ndarray:
    return mix(np.arange(1, join.runs() + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(join.seed))


def _sid(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _describe(join: Join):
    """mapInArrow: set id, size, sketch and sample of each text, without the text."""

    def run(batches):
        for batch in batches:
            keys = [batch.column(c) for c in ("doc_id", "text_key", "row_key")]
            for start, end, texts in Texts.of(batch.column("text")).parts():
                flat, bounds = shingle_sets(texts, join.words)
                own = [flat[bounds[r] : bounds[r + 1]] for r in range(texts.rows)]
                made = [[_sid(x), _sketch(x), x[: join.sample].tobytes()] if len(x) else [None] * 3 for x in own]
                sid, sketch, sample = (pa.array([m[k] for m in made], pa.binary()) for k in range(3))
                yield pa.record_batch(
                    [*(k.slice(start, end - start) for k in keys), sid, pa.array(np.diff(bounds), pa.int64()), sketch, sample],
                    names=["doc_id", "text_key", "row_key", "sid", "n", "sketch", "sample"],
                )

    return run


def _sampled(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The samples of a batch one after another, and their sizes."""
    raw = batch.column("sample").to_pylist()
    return np.frombuffer(b"".join(raw), np.uint64), np.array([len(x) // 8 for x in raw], np.int64)


def _paths(join: Join, root: bool):
    """mapInArrow: sets with their samples, and the nodes they are in (root: those of
    the runs) -> rows (sid, node) of the children."""
    roots = _roots(join)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens, sizes = _sampled(batch)
            if root:
                sets, nodes = np.repeat(np.arange(batch.num_rows), len(roots)), np.tile(roots, batch.num_rows)
            else:
                held = batch.column("nodes")
                sets = np.repeat(np.arange(batch.num_rows), held.value_lengths().to_numpy(zero_copy_only=False))
                nodes = held.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            for k in range(0, len(sets), 1 << 16):
                own, child = _children(nodes[k : k + (1 << 16)], sets[k : k + (1 << 16)], tokens, sizes, join.branch)
                yield pa.record_batch([batch.column("sid").take(pa.array(own)), pa.array(child.view(np.int64))], names=["sid", "node"])

    return run


def _stars(join: Join):
    """mapInArrow: members of large buckets with the bucket's pivots -> per member the
    pivots that it is a candidate pair with (bits of mask; hub is the first) and its
    mean agreement with all."""
    least = join.least()

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            pivots = batch.column("pivots").flatten()
            sid, n, sketch = (pivots.field(k) for k in range(3))
            mine = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(batch.num_rows, 1, -1)
            theirs = np.frombuffer(b"".join(sketch.to_pylist()), np.uint8).reshape(batch.num_rows, join.pivots, -1)
            apart = mine ^ theirs
            agree = SKETCH - np.bitwise_count((apart | (apart >> 1)) & np.uint8(0x55)).sum(axis=2, dtype=np.int64)
            a, b = batch.column("n").to_numpy()[:, None], n.to_numpy(zero_copy_only=False).reshape(agree.shape)
            near = (agree >= least) & (np.minimum(a, b) >= join.similarity * np.maximum(a, b) - 1e-9)
            mask = (near << np.arange(join.pivots)).sum(axis=1)
            first = np.arange(batch.num_rows) * join.pivots + near.argmax(axis=1)
            hub = sid.take(pa.array(first, mask=mask == 0))
            yield pa.record_batch([batch.column("node"), batch.column("sid"), pa.array(mask, pa.int32()), hub, pa.array(agree.mean(axis=1))], names=["node", "sid", "mask", "hub", "agree"])

    return run


def _spread(linked: np.ndarray) -> np.ndarray:
    """Component label of every vertex of a symmetric boolean matrix."""
    n = len(linked)
    label = np.full(n, -1)
    for v in range(n):
        if label[v] >= 0:
            continue
        label[v] = v
        front = np.array([v])
        while len(front):
            reach = linked[front].any(axis=0) & (label < 0)
            front = np.flatnonzero(reach)
            label[front] = v
    return label


def _two_sided(linked: np.ndarray, sides: int) -> np.ndarray:
    """Labels over all rows of a block (sides = 1) or of a pair of blocks (rows first)."""
    if sides == 1:
        return _spread(linked)
    a, b = linked.shape
    full = np.zeros((a + b, a + b), dtype=bool)
    full[:a, a:] = linked
    full[a:, :a] = linked.T
    return _spread(full)


def _blocks(column, k: int):
    """The one or two blocks of row k: lists of member structs."""
    return column[k].as_py()


def _tiles(sides: list, most: int):
    """The comparisons of one block with itself, or of two, as tiles of at most `most`
    members: one list for a tile with itself, two else."""
    cut = [[s[k : k + most] for k in range(0, len(s), most)] for s in sides]
    for i, a in enumerate(cut[0]):
        if len(sides) == 1:
            yield [a]
        for b in cut[0][i + 1 :] if len(sides) == 1 else cut[1]:
            yield [a, b]


def _near(join: Join):
    """mapInArrow: blocks of one bucket -> spanning edges of the pairs whose sketches agree."""
    least = join.least()

    def bits(members):
        raw = np.frombuffer(b"".join(m["sketch"] for m in members), np.uint8).reshape(len(members), -1)
        two = np.stack([(raw >> s) & 3 for s in (0, 2, 4, 6)], axis=2).reshape(len(members), -1)
        return np.concatenate([(two == v).astype(np.float32) for v in range(4)], axis=1)

    def edges(sides):
        b = [bits(s) for s in sides]
        n = [np.array([m["n"] for m in s], np.float64) for s in sides]
        same = b[0] @ b[-1].T >= least
        same &= np.minimum(n[0][:, None], n[-1][None, :]) >= join.similarity * np.maximum(n[0][:, None], n[-1][None, :]) - 1e-9
        if len(sides) == 1:
            np.fill_diagonal(same, False)
        if not same.any():
            return
        label = _two_sided(same, len(sides))
        ids = [m["sid"] for s in sides for m in s]
        for v in np.flatnonzero(label != np.arange(len(label))):
            yield ids[label[v]], ids[v]

    def run(batches):
        for batch in batches:
            found = []
            for k in range(batch.num_rows):
                for sides in _tiles(_blocks(batch.column("blocks"), k), join.tile):
                    found += edges(sides)
            yield pa.record_batch([pa.array([x for x, _ in found], pa.binary()), pa.array([x for _, x in found], pa.binary())], names=["a", "b"])

    return run


def _shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs, exact: products of 0/1 matrices over
    the tokens that occur more than once, some thousand columns at a time."""
    sets = left if right is left else left + right
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    new = np.concatenate(([True], flat[1:] != flat[:-1]))
    col = np.cumsum(new) - 1
    often = np.bincount(col)[col] > 1
    row, col = row[often], col[often]
    out = np.zeros((len(left), len(right)), np.float32)
    if not len(col):
        return out
    col = np.cumsum(np.concatenate(([0], col[1:] != col[:-1])))
    for k in range(0, int(col[-1]) + 1, 4096):
        at = slice(*np.searchsorted(col, [k, k + 4096]))
        m = np.zeros((len(sets), 4096), np.float32)
        m[row[at], col[at] - k] = 1
        out += m[: len(left)] @ (m if right is left else m[len(left) :]).T
    return out


def _exact(join: Join):
    """mapInArrow: blocks of full sets -> (sid, root, links): links of a member into
    the block pair, counted with copies, and a spanning edge."""

    def links(sides):
        sets = [[np.frombuffer(m["tokens"], np.uint64) for m in s] for s in sides]
        copies = [np.array([m["copies"] for m in s], np.int64) for s in sides]
        lone = len(sides) == 1
        common = _shared_counts(sets[0], sets[0] if lone else sets[1]).astype(np.float64)
        size = [np.array([len(x) for x in s], np.float64) for s in sets]
        linked = common / (size[0][:, None] + size[-1][None, :] - common) >= join.similarity
        if lone:
            np.fill_diagonal(linked, False)
        if not linked.any():
            return
        label = _two_sided(linked, len(sides))
        ids = [m["sid"] for s in sides for m in s]
        count = linked @ copies[-1]
        if not lone:
            count = np.concatenate([count, linked.T @ copies[0]])
        for v in np.flatnonzero(count):
            yield ids[v], ids[label[v]], int(count[v])

    def run(batches):
        for batch in batches:
            found = []
            for k in range(batch.num_rows):
                # Split joins may bring the text of a repeated row twice.
                sides = [list({m["sid"]: m for m in block}.values()) for block in _blocks(batch.column("blocks"), k)]
                for tile in _tiles(sides, join.tile):
                    found += links(tile)
            columns = [pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.binary(), pa.binary(), pa.int64()))]
            yield pa.record_batch(columns, names=["sid", "root", "links"])

    return run


def _packed(members: DataFrame, key: str, fields: list[str]) -> DataFrame:
    block = F.pmod(F.xxhash64("sid", F.lit(7)), F.col("parts"))
    return members.withColumn("block", block).groupBy(key, "parts", "block").agg(F.collect_list(F.struct(*fields)).alias("members"))


def _lone(members: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Members (key, parts, fields) of keys of one block, gathered into a row per block."""
    return _packed(members.where("parts = 1"), key, fields).select(F.array("members").alias("blocks"))


def _several(members: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """For keys of several blocks, one row per pair of blocks that both have members.  The
    rows are blocks, so their number is small, and the block of a member is its hash: no key
    meets in one task."""
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    return (
        _packed(members.where("parts > 1"), key, fields).withColumn("other", other)
        .groupBy(key, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
        .agg(F.collect_list("members").alias("blocks")).where("i = j or size(blocks) = 2").select("blocks")
    )


def classes(documents: DataFrame, join: Join = Join()) -> DataFrame:
    """(doc_id, class_id, n_links, n_shingles), one row per row of `documents`.

    n_links counts the other rows whose shingle sets have a Jaccard similarity of
    at least join.similarity; class_id is the smallest doc_id of the connected
    group.  Texts of one to four words are one shingle.  Null texts and texts
    without words are similar to nothing and are their own class.  A repeated row
    links to its copies.  A null doc_id is kept; it is never a class id unless
    the whole class has none.
    """
    return _rows(*_linked(documents, join)).select(
        "doc_id", F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("n").alias("n_shingles"),
    )


def _keyed(documents: DataFrame) -> DataFrame:
    """`documents` with text_key, a hash of the text, and row_key, one of id and text."""
    return documents.withColumn("text_key", F.xxhash64("text")).withColumn("row_key", F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text"))


def _rows(described: DataFrame, named: DataFrame) -> DataFrame:
    """(doc_id, text_key, row_key, sid, n, c, class_id, n_links) of every row; sid is null
    without words, and then c, class_id and n_links are."""
    return described.select("doc_id", "text_key", "row_key", "sid", "n").join(named.hint("merge"), "sid", "left")


def _linked(documents: DataFrame, join: Join) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, text_key, row_key, sid, n, ...), and (sid, c, class_id, n_links) of
    every set, where c is the set that names its class; both are written."""
    texts = _keyed(documents.select("doc_id", "text"))
    shape = "doc_id long, text_key long, row_key long, sid binary, n long, sketch binary, sample binary"
    described = written(texts.mapInArrow(_describe(join), shape), "described")
    first = F.first(F.struct("n", "sketch", "sample")).alias("f")
    sets = described.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("rep"), F.min("row_key").alias("row_key"), F.count("*").alias("copies"), first)
    sets = written(sets.select("sid", "rep", "row_key", "copies", "f.*"), "sets")
    near = _candidates(sets, join)
    groups = components(near)
    spent(near)
    rows = groups.count()
    few = rows <= FEW

    # Exact comparison inside each candidate group, on full sets.  A set is found again
    # by the row it was taken from, so null and repeated ids do no harm.
    known = sets.select(F.col("sid").alias("v"), "row_key", "copies", "n").join(among(groups, few), "v")
    known = written(known.select(F.col("v").alias("sid"), F.col("c").alias("group"), "row_key", "copies", "n"), "groups")
    size = known.groupBy("group").agg(F.greatest(F.ceil(F.sum("n") / join.block_tokens), F.ceil(F.count("*") / join.block)).cast("long").alias("parts"))
    size = written(gathered(size, rows), "sizes")
    known_parts = written(known.join(among(size, few), "group").select("row_key", "sid", "group", "copies", "parts"), "parts")
    full = texts.select("row_key", "text").join(known_parts.hint("merge"), "row_key").select("text", "sid", "group", "copies", "parts")
    full = full.mapInArrow(_tokens(join), "sid binary, group binary, copies long, parts long, tokens binary")
    fields, shape = ["sid", "copies", "tokens"], "sid binary, root binary, links long"
    found = _lone(full, "group", fields).mapInArrow(_exact(join), shape)
    if not size.where("parts > 1").isEmpty():
        found = found.unionByName(_several(full, "group", fields).mapInArrow(_exact(join), shape))
    found = written(found, "links")
    edges, rows = found.select(F.col("sid").alias("a"), F.col("root").alias("b")), found.count()
    final = components(edges if rows <= FEW else thinned(edges, "a", rows))
    spent(known, size, known_parts)
    rows = final.count()
    few = rows <= FEW
    # Only sets with links have another class than their own, so only these are gathered by it.
    names = sets.select(F.col("sid").alias("v"), "rep").join(among(final, few), "v").groupBy("c").agg(F.min("rep").alias("class_id"))
    names = written(gathered(names, rows), "names")
    classed = written(final.join(among(names, few), "c").select(F.col("v").alias("sid"), "c", "class_id"), "classed")

    links = found.groupBy("sid").agg(F.sum("links").alias("links"))
    # One row for each set on all sides, which is one stage if they are merged.
    per_set = sets.select("sid", "rep", "copies").join(classed.hint("merge"), "sid", "left").join(links.hint("merge"), "sid", "left")
    many = F.col("copies") - 1 + F.coalesce("links", F.lit(0))
    named = written(per_set.select("sid", F.coalesce("c", "sid").alias("c"), F.coalesce("class_id", "rep").alias("class_id"), many.alias("n_links")), "linked")
    spent(found, sets, names, classed)
    return described, named


def _tokens(join: Join):
    """mapInArrow: the full shingle set of each wanted text."""

    def run(batches):
        last = None
        for batch in batches:
            for start, end, texts in Texts.of(batch.column("text")).parts():
                flat, bounds = shingle_sets(texts, join.words)
                own = batch.slice(start, end - start)
                raw = [flat[bounds[r] : bounds[r + 1]] for r in range(texts.rows)]
                right = []
                for x, s in zip(raw, own.column("sid").to_pylist(), strict=True):
                    # A repeated row comes right behind itself; another row of the same key has another set.
                    right.append(s != last and len(x) > 0 and _sid(x) == s)
                    last = s if right[-1] else last
                out = pa.record_batch([*(own.column(c) for c in ("sid", "group", "copies", "parts")), pa.array([x.tobytes() for x in raw], pa.binary())], names=["sid", "group", "copies", "parts", "tokens"])
                yield out.filter(pa.array(right, pa.bool_()))

    return run


def _with(rows: DataFrame, many: int, sets: DataFrame, n_sets: int, *columns: str) -> DataFrame:
    """`rows`, which are `many`, with columns of their sets; a few are sent to the sets."""
    sets = sets.select("sid", *columns)
    return sets.join(F.broadcast(rows), "sid") if many <= FEW else gathered(rows.join(sets.hint("merge"), "sid"), many + n_sets)


def _candidates(sets: DataFrame, join: Join) -> DataFrame:
    """Written (a, b): edges between sets that the buckets find, enough to join all of them.

    Pivots and verdicts are a row for each large bucket, so Spark may broadcast them where they
    are few.  What reaches the driver is the rows that a level has in buckets and in large ones,
    which verdicts, and its largest bucket to compare: what no bucket needs is not planned, and
    few rows are not dealt over many tasks."""
    every = (1 << join.pivots) - 1
    edges, compare, used = [], [], []
    most, compared, found, n_sets = join.small, 0, 0, sets.count()
    paths = sets.select("sid", "sample").mapInArrow(_paths(join, True), "sid binary, node long")
    for level in range(join.depth):
        taken = paths.count() if level else None
        sizes = written(gathered(paths.groupBy("node").agg(F.count("*").alias("size")).where("size > 1"), taken), "sizes")
        big = F.when(F.col("size") > join.small, F.col("size"))
        held = sizes.agg(F.sum("size").alias("rows"), F.sum(big).alias("large"), F.count(big).alias("nodes")).first()
        rows, wide, nodes = held["rows"] or 0, held["large"] or 0, held["nodes"]
        shared = written(gathered(paths.join(sizes.hint("merge"), "node").select("sid", "node", "size"), taken), "shared")
        spent(sizes, *([paths] if level else []))
        used.append(shared)
        compare.append(shared.where(F.col("size") <= join.small))
        large = shared.where(F.col("size") > join.small)
        compared += rows - wide
        if not nodes:
            break
        found += wide
        members = written(_with(large, wide, sets, n_sets, "n", "sketch").select("node", "size", "sid", "n", "sketch"), "members")
        pick = [F.min(F.struct(F.xxhash64("sid", "node", F.lit(k)).alias("h"), "sid", "n", "sketch")).alias(f"p{k}") for k in range(join.pivots)]
        pivots = members.groupBy("node").agg(F.first("size").alias("size"), *pick)
        pivots = pivots.select("node", "size", F.array(*[F.struct(f"p{k}.sid", f"p{k}.n", f"p{k}.sketch") for k in range(join.pivots)]).alias("pivots"))
        pivots = written(gathered(pivots, wide), "pivots")
        stars = members.join(pivots.drop("size"), "node").mapInArrow(_stars(join), "node long, sid binary, mask int, hub binary, agree double")
        stars = written(stars, "stars")
        spent(members)
        # All members hang on pivots, and the pivots on each other by members with several.
        judged = stars.groupBy("node").agg(F.min("mask").alias("least"), F.collect_set("mask").alias("masks"), F.avg("agree").alias("agree"))
        reach = F.lit(1)
        for _ in range(join.pivots - 1):
            reach = F.aggregate("masks", reach, lambda acc, m: F.when(acc.bitwiseAND(m) != 0, acc.bitwiseOR(m)).otherwise(acc))
        alike = F.greatest((F.col("agree") / SKETCH - 0.25) / 0.75, F.lit(0.0))
        common = 2 * alike / (1 + alike)
        state = F.when((F.col("least") > 0) & (reach == every), "done").when((common * join.branch <= join.pays) & F.lit(level < join.depth - 1), "split").otherwise("compare")
        judged = judged.join(pivots, "node").select("node", "size", "masks", "pivots", state.alias("state"))
        judged = written(gathered(judged, wide), "judged")
        spent(pivots)
        edges.append(stars.where("hub is not null").select(F.col("hub").alias("a"), F.col("sid").alias("b")))
        bit = lambda m, k: F.shiftright(m, k).bitwiseAND(F.lit(1)) == 1
        mask = judged.select("pivots", F.explode("masks").alias("mask"))
        for k in range(join.pivots):
            for q in range(k + 1, join.pivots):
                edges.append(mask.where(bit(F.col("mask"), k) & bit(F.col("mask"), q)).select(F.col("pivots")[k]["sid"].alias("a"), F.col("pivots")[q]["sid"].alias("b")))
        used += [stars, judged]
        size = {s: F.when(F.col("state") == s, F.col("size")) for s in ("compare", "split")}
        states = judged.agg(F.max(size["compare"]).alias("most"), F.sum(size["compare"]).alias("compare"), F.sum(size["split"]).alias("split")).first()
        if states["most"] is not None:
            compare.append(large.join(judged.where("state = 'compare'").select("node"), "node").select("sid", "node", "size"))
            most, compared = max(most, states["most"]), compared + states["compare"]
        if not states["split"]:
            break
        # The children of different nodes differ, so no path comes twice.
        again = large.join(judged.where("state = 'split'").select("node"), "node").groupBy("sid").agg(F.collect_list("node").alias("nodes"))
        again = _with(gathered(again, states["split"]), states["split"], sets, n_sets, "sample")
        paths = written(again.mapInArrow(_paths(join, False), "sid binary, node long"), "paths")
    buckets = compare[0]
    for part in compare[1:]:
        buckets = buckets.unionByName(part)
    members = _with(buckets.withColumn("parts", F.ceil(F.col("size") / join.block).cast("long")), compared, sets, n_sets, "n", "sketch")
    for pack in (_lone, _several) if most > join.block else (_lone,):
        edges.append(pack(members, "node", ["sid", "n", "sketch"]).mapInArrow(_near(join), "a binary, b binary"))
    out = edges[0]
    for part in edges[1:]:
        out = out.unionByName(part)
    out = written(thinned(out, "b", compared * -(-most // join.tile) + found), "near")
    spent(*used)
    return out


def query(spark, sf_dir: str) -> DataFrame:
    """op7: class and number of links of every row of `documents`."""
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def keep_one(documents: DataFrame, join: Join = Join()) -> DataFrame:
    """One row of each class, with all its columns: of the rows with the smallest doc_id
    one, by a hash of the text.  A class without any doc_id keeps one row too.  Rows
    without words are similar to nothing and all stay, whatever else they hold.
    """
    linked = _linked(documents, join)
    rows = _rows(*linked).where("sid is not null")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row_key", "text_key")
    chosen = rows.groupBy("c").agg(F.min(order).alias("m")).select(F.col("m.row_key").alias("row_key"), F.col("m.text_key").alias("text_key"))
    chosen = written(chosen, "kept")
    spent(*linked)
    frame, own = aside(documents, ["text_key", "row_key"])
    frame = _keyed(frame)
    words = F.coalesce(F.regexp_like("text", F.lit(WORD)), F.lit(False))
    # Both steps need a row's key together, so the rows are shuffled once.
    kept = frame.where(words).join(chosen.hint("merge"), ["row_key", "text_key"], "left_semi").dropDuplicates(["row_key", "text_key"])
    return back(kept, own).unionByName(back(frame.where(~words), own))
