"""Quality rules: fixed counting rules, then hashed word and character n-gram
logistic regression trained on labelled quality rows, calibrated to a
probability and scored in Arrow batches against a fixed threshold.

Nothing is shuffled: documents are scanned once for the (bounded) training
rows and once for the scores.  Each Arrow batch is worked through in pieces of
about one megabyte of text, so a task's memory does not follow the batch.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesplit import SPACE, Texts, Words, mix
from .labelled import class_shares, platt, training_rows
from .shared import aside, back

#: Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS = 20
REPEAT_WINDOW = 8
MOST_REPEAT_PERCENT = 30

BASE_COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"


@dataclass(frozen=True)
class Rules:
    """bits: log2 of the buckets of each n-gram family.  per_class: most training
    rows of each label.  extract: least and most words (less one) of the extract that
    each of them is also fitted on.  threshold: least probability of good quality to keep."""

    bits: int = 16
    per_class: int = 1000
    word_orders: tuple = (1, 2)
    char_orders: tuple = (2, 3, 4)
    threshold: float = 0.5
    l2: float = 1e-3
    steps: int = 100
    extract: tuple = (20, 90)
    seed: int = 11


@dataclass
class RuleModel:
    """weights: one row for words, one for characters; score = slope * z + offset."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float
    rules: Rules


_SYM = np.zeros(256, dtype=bool)
_SYM[list(SYMBOLS)] = True


def base_counts(texts: Texts, words: Words, hashes: np.ndarray) -> dict[str, np.ndarray]:
    """The base columns for each row of a piece."""
    n = words.counts.astype(np.int64)
    lead = (texts.data & 0xC0) != 0x80
    out = {"n_words": n, "word_chars": texts.per_row(words.inside & lead), "n_symbols": texts.per_row(_SYM[texts.data])}
    dup = np.zeros(texts.rows, np.int64)
    for r in range(texts.rows):
        lines = [x for x in texts.row(r).split(b"\n") if x and not x.isspace()]
        if len(lines) > 1:
            dup[r] = len(lines) - len(set(lines))
    out["n_dup_lines"] = dup
    at, grams = words.grams(REPEAT_WINDOW, hashes)
    repeat = np.zeros(texts.rows, np.int64)
    if len(at):
        keys = mix(grams + words.row[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(keys, kind="stable")
        same = keys[order[1:]] == keys[order[:-1]]
        twice = np.zeros(len(keys), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        edge = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(edge, at[twice], 1)
        np.add.at(edge, at[twice] + REPEAT_WINDOW, -1)
        covered = np.cumsum(edge[:-1]) > 0
        total = np.concatenate(([0], np.cumsum(covered)))
        repeat = total[words.bounds[1:]] - total[words.bounds[:-1]]
    out["n_repeat_words"] = repeat
    out["base_failed"] = (n < LEAST_WORDS) | (100 * repeat > MOST_REPEAT_PERCENT * n)
    return out


def gram_ids(texts: Texts, words: Words, hashes: np.ndarray, rules: Rules):
    """For each n-gram family, (row bounds by order, bucket ids): lists of arrays."""
    shift = np.uint64(64 - rules.bits)
    for k in rules.word_orders:
        at, grams = words.grams(k, hashes)
        yield 0, np.searchsorted(words.row[at], np.arange(texts.rows + 1)), (grams >> shift).astype(np.int32)
    # Characters enter as bytes with white space folded to one value.
    data = np.where(SPACE[texts.data], np.uint8(0x20), texts.data)
    n = len(data)
    sizes = np.diff(texts.offsets)
    for k in rules.char_orders:
        if n < k:
            yield 1, np.zeros(texts.rows + 1, np.int64), np.zeros(0, np.int32)
            continue
        h = np.zeros(n - k + 1, np.uint32)
        for j in range(k):
            h = h * np.uint32(0x01000193) + data[j : n - k + 1 + j]
        h = (h * np.uint32(0x9E3779B1)) ^ np.uint32(k * 0x1F123BB5)
        ids = ((h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - rules.bits)).astype(np.int32)
        # Runs that cross into the next row are dropped: the last k-1 of each row.
        keep = np.ones(n, dtype=bool)
        for j in range(1, k):
            ends = texts.offsets[1:][sizes >= j] - j
            keep[ends] = False
        keep = keep[: n - k + 1]
        total = np.maximum(sizes - k + 1, 0)
        yield 1, np.concatenate(([0], np.cumsum(total))), ids[keep]


def raw_scores(texts: Texts, words: Words, hashes: np.ndarray, model: RuleModel) -> np.ndarray:
    """The linear score: each family contributes the mean weight of its n-grams."""
    sums = np.zeros((2, texts.rows))
    counts = np.zeros((2, texts.rows))
    for family, bounds, ids in gram_ids(texts, words, hashes, model.rules):
        total = np.concatenate(([0.0], np.cumsum(model.weights[family][ids], dtype=np.float64)))
        sums[family] += total[bounds[1:]] - total[bounds[:-1]]
        counts[family] += np.diff(bounds)
    return model.bias + (sums / np.maximum(counts, 1)).sum(axis=0)


def _features(rules: Rules):
    """mapInArrow: each training text, and an extract of it, as occupied buckets and their
    shares.  part is 0 for the text and 1 for the extract."""

    def run(batches):
        for batch in batches:
            whole = Texts.of(batch.column("text"))
            cut = [x for r in range(whole.rows) for x in (whole.row(r).decode(), _extract(whole.row(r), rules).decode())]
            found = []
            for _, _, texts in Texts.of(cut).parts():
                words = Words(texts)
                hashes = words.hashes()
                per = [list(gram_ids(texts, words, hashes, rules))]
                for r in range(texts.rows):
                    where, share = [], []
                    for family in (0, 1):
                        own = [ids[b[r] : b[r + 1]] for f, b, ids in per[0] if f == family]
                        own = np.concatenate(own) if own else np.zeros(0, np.int32)
                        u, c = np.unique(own, return_counts=True)
                        where.append(u + (family << rules.bits))
                        share.append(c / max(len(own), 1))
                    found.append((np.concatenate(where).astype("<i4").tobytes(), np.concatenate(share).astype("<f4").tobytes()))
            twice = pa.array(np.repeat(np.arange(batch.num_rows), 2))
            part = pa.array(np.tile([0, 1], batch.num_rows).astype(np.int32))
            yield pa.record_batch([batch.column("doc_id").take(twice), batch.column("y").take(twice), part, pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.binary())], names=["doc_id", "y", "part", "ids", "shares"])

    return run


def _extract(text: bytes, rules: Rules) -> bytes:
    """A run of words of a length and place that the text's own checksum decides."""
    words = text.split()
    rng = np.random.default_rng([zlib.crc32(text), rules.seed])
    n = int(rng.integers(*rules.extract))
    at = int(rng.integers(0, max(1, len(words) - n + 1)))
    return b" ".join(words[at : at + n])


def fit(documents: DataFrame, labels: DataFrame, rules: Rules = Rules()) -> RuleModel:
    """Fit on at most 2 * rules.per_class labelled rows that are not held out.

    Short texts vary more than what a fit on whole documents allows for, so each row
    is also seen as an extract of rules.extract words, and buckets that hardly occur
    are not scaled up.  Executors turn the rows into hashed counts (at most
    2 ** (bits + 1) buckets a row); only those reach the driver.  Every fifth row
    calibrates.  Without rows of both labels the model gives every text the smoothed
    share of good rows (0.5 if there is none).
    """
    rows = training_rows(documents, labels, "quality", rules.per_class, rules.seed)
    rows = rows.mapInArrow(_features(rules), "doc_id long, y int, part int, ids binary, shares binary").toArrow()
    order = pc.sort_indices(rows, sort_keys=[("doc_id", "ascending"), ("part", "ascending")])
    no, yes = class_shares(labels, "quality")
    y = np.asarray(rows["y"].take(order).to_numpy(), dtype=np.int64)
    size = 2 << rules.bits
    n = len(y)
    if not (y == 1).any() or not (y == 0).any():
        prior = float(np.log((yes + 1) / (no + 1)))
        return RuleModel(np.zeros((2, size // 2), np.float32), 0.0, 0.0, prior, rules)
    ids, bounds = _flat(rows["ids"].take(order), "<i4")
    rows = rows.drop_columns(["ids"])
    share, _ = _flat(rows["shares"].take(order), "<f4")
    del rows  # the driver holds their counts once, and one column twice while it is sorted
    fold = np.arange(n) // 2 % 5 == 4  # a text and its extract stay together
    if len(set(y[fold])) < 2 or len(set(y[~fold])) < 2:
        fold = np.zeros(n, dtype=bool)
    w, bias = _descend(ids, share, bounds, y, ~fold, size, rules)
    check = fold if fold.any() else ~fold
    z = np.array([bias + share[a:b] @ w[ids[a:b]] for a, b in ((bounds[k], bounds[k + 1]) for k in np.flatnonzero(check))])
    own = y[check]
    balance = np.where(own == 1, yes / max((own == 1).sum(), 1), no / max((own == 0).sum(), 1))
    slope, offset = platt(z, own, balance / balance.mean())
    return RuleModel(w.reshape(2, -1).astype(np.float32), float(bias), slope, offset, rules)


def _flat(column: pa.ChunkedArray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column in a row, without copies of single rows, and row bounds."""
    column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]].view(kind)
    return data, (at - at[0]) // data.itemsize


def _descend(ids, share, bounds, y, use, size, rules):
    """Adam on the balanced logistic loss over all rows at once, added up over blocks of
    rows so that temporaries stay small."""
    n = len(y)
    blocks = []
    for r in range(0, n, 256):
        e = min(r + 256, n)
        blocks.append((slice(r, e), slice(bounds[r], bounds[e]), np.repeat(np.arange(e - r, dtype=np.int16), np.diff(bounds[r : e + 1]))))
    square = np.zeros(size)
    for rows, at, own in blocks:
        square += np.bincount(ids[at], np.where(use[rows][own], share[at], 0.0) ** 2, size)
    scale = 1 / np.sqrt(square / use.sum() + 1e-6)
    good, bad = max((y[use] == 1).mean(), 1e-9), max((y[use] == 0).mean(), 1e-9)
    weight = np.where(use, np.where(y == 1, 0.5 / good, 0.5 / bad), 0.0) / use.sum()
    w, bias = np.zeros(size), 0.0
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for k in range(1, rules.steps + 1):
        scaled, grad, gb = (w * scale).astype(np.float32), np.zeros(size), 0.0
        for rows, at, own in blocks:
            z = bias + np.bincount(own, share[at] * scaled[ids[at]], rows.stop - rows.start)
            g = weight[rows] * (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y[rows])
            grad += np.bincount(ids[at], share[at] * g.astype(np.float32)[own], size)
            gb += g.sum()
        grad = grad * scale + rules.l2 * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        a, b = 1 - 0.9**k, 1 - 0.999**k
        w -= 0.05 * (m / a) / (np.sqrt(v / b) + 1e-8)
        bias -= 0.05 * (mb / a) / (np.sqrt(vb / b) + 1e-8)
    return w * scale, bias


def score(documents: DataFrame, model: RuleModel) -> DataFrame:
    """All columns of `documents` that are not replaced, plus the base columns,
    prob (double) and kept (boolean).

    Null and empty texts have no words, fail the base rules and are not kept.
    Columns named like the results, in whatever case, are replaced by them.  A text of any length is
    counted and scored whole; it is then a piece of its own.  A probability equal to
    the threshold is kept.  Repeated rows are scored one by one, alike.
    """
    made = [*(c.split()[0] for c in BASE_COLUMNS.split(", ")), "prob", "kept"]
    rest = [c for c in documents.columns if c.lower() not in made]
    frame = documents.select(*rest)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema) + f", {BASE_COLUMNS}, prob double, kept boolean"

    def run(batches):
        for batch in batches:
            for start, end, texts in Texts.of(batch.column("text")).parts():
                words = Words(texts)
                hashes = words.hashes()
                out = base_counts(texts, words, hashes)
                z = model.slope * raw_scores(texts, words, hashes, model) + model.offset
                out["prob"] = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
                out["kept"] = ~out["base_failed"] & (out["prob"] >= model.rules.threshold)
                own = batch.slice(start, end - start)
                yield pa.record_batch([*own.columns, *(pa.array(out[c]) for c in made)], names=[*own.schema.names, *made])

    return frame.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op10: the rules over every whole text of `documents`."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(documents.select("doc_id", "text"), model).drop("text")


def keep(documents: DataFrame, source: DataFrame, labels: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of `documents` that pass, with all their columns as they were; the model
    is fitted on `source` and `labels`.  Rows are judged one by one by their whole text
    (see `score`): all copies of a row stay or none; null and empty texts go."""
    frame, own = aside(documents, [*(c.split()[0] for c in BASE_COLUMNS.split(", ")), "prob", "kept"])
    return back(score(frame, fit(source, labels, rules)).where(F.col("kept")), own)
