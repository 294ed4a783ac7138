"""SimHash near-duplicates by anchor-point covering.

A fingerprint has 64 bits.  The anchors are a covering code: the perfect Hamming code
of the first 63 bits, next to both values of the last one, so every fingerprint is at
most one bit (the covering radius) from an anchor.  Two fingerprints that differ in at
most t bits have a point between them that is no more than ceil(t / 2) bits from either,
and the anchor of that point is within the radius plus ceil(t / 2) of both.  So a
fingerprint is replicated to every anchor within the radius plus its half of the
threshold, and each linked pair meets at an anchor at least.

For t = 2 that are 33 anchors, and no more than 2,081 different fingerprints can lie
within two bits of an anchor: geometry bounds a group, whatever the data.  (Replication
by the radius plus all of the threshold would make 676 copies and groups of 43,745.)
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesplit import Texts, Words
from .components import components, thinned
from .shared import written

#: Bits that the Hamming code covers; the one above them is covered by both its values.
CODED = 63


@dataclass(frozen=True)
class Near:
    """words: of a shingle.  bits: most differing bits of a link.  seed: of XXH64."""

    words: int = 3
    bits: int = 2
    seed: int = 42


def shingle_spans(texts: Texts, k: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, begins, ends, row bounds): every shingle of each row as a span of the buffer,
    in which A-Z are lower case and one space stands between words."""
    words = Words(texts)
    data = texts.data.copy()
    data[(data >= 0x41) & (data <= 0x5A)] |= 0x20
    n = len(words.starts)
    same = np.zeros(n, bool)
    same[1:] = words.row[1:] == words.row[:-1]
    keep = words.inside.copy()
    before = words.starts[same] - 1
    keep[before], data[before] = True, 0x20
    begin = np.cumsum(keep)[words.starts] - 1 if n else np.zeros(0, np.int64)
    buffer = data[keep].tobytes()
    end = np.append(begin[1:] - same[1:], len(buffer))[:n]
    # A shingle begins at each word with k - 1 behind it in its row; a shorter row is one shingle.
    shingles = np.where(words.counts >= k, words.counts - k + 1, np.minimum(words.counts, 1))
    bounds = np.concatenate(([0], np.cumsum(shingles)))
    first = np.arange(bounds[-1]) + np.repeat(words.bounds[:-1] - bounds[:-1], shingles)
    last = first + np.repeat(np.minimum(words.counts, k) - 1, shingles)
    return buffer, begin[first], end[last], bounds


def fingerprints(texts: Texts, how: Near = Near(), chunk: int = 1 << 15) -> np.ndarray:
    """A fingerprint (unsigned) for each row: bit b is set if it is in over half the hashes
    of its shingles; without words it is zero."""
    from xxhash import xxh64_intdigest

    buffer, begin, end, bounds = shingle_spans(texts, how.words)
    counts = np.zeros((texts.rows, 64), np.int64)
    for at in range(0, len(begin), chunk):
        to = min(at + chunk, len(begin))
        hashes = np.fromiter((xxh64_intdigest(buffer[a:b], how.seed) for a, b in zip(begin[at:to].tolist(), end[at:to].tolist(), strict=True)), "<u8", to - at)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        row = np.searchsorted(bounds, np.arange(at, to), side="right") - 1
        cut = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        counts[row[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int64)
    set_ = 2 * counts > np.diff(bounds)[:, None]
    return np.packbits(set_, axis=1, bitorder="little").view("<u8").ravel()


@lru_cache(maxsize=4)
def patterns(reach: int) -> list[np.ndarray]:
    """For each of the 64 syndromes the bit patterns that lead to an anchor in `reach` bits.

    Position p (from 1) of the coded bits has syndrome p; a word is an anchor if the
    positions of its ones have exclusive-or 0."""
    out: list[list[int]] = [[] for _ in range(CODED + 1)]
    for weight in range(reach + 1):
        for places in combinations(range(1, CODED + 1), weight):
            s = mask = 0
            for p in places:
                s ^= p
                mask |= 1 << (p - 1)
            out[s].append(mask)
            if weight < reach:
                out[s].append(mask | 1 << CODED)
    return [np.array(x, np.uint64) for x in out]


def syndromes(prints: np.ndarray) -> np.ndarray:
    out = np.zeros(len(prints), np.int64)
    for k in range(6):
        mask = np.uint64(sum(1 << (p - 1) for p in range(1, CODED + 1) if p >> k & 1))
        out |= (np.bitwise_count(prints & mask).astype(np.int64) & 1) << k
    return out


def anchors(prints: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, fingerprint): every fingerprint with all its anchors."""
    table, s = patterns(1 + (bits + 1) // 2), syndromes(prints)
    found = [(prints[s == v][:, None] ^ table[v][None, :]) for v in np.unique(s)]
    owners = [np.repeat(prints[s == v], len(table[v])) for v in np.unique(s)]
    none = np.zeros(0, np.uint64)
    return (np.concatenate([x.ravel() for x in found]), np.concatenate(owners)) if found else (none, none)


def forest(prints: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """(a, b) with b < a in place: a tree for each component of the links among `prints`."""
    open_, out = np.arange(len(prints)), []
    while len(open_) > 1:
        root, front, open_ = open_[0], open_[:1], open_[1:]
        while len(front) and len(open_):
            hit = np.zeros(len(open_), bool)
            for at in range(0, len(front), 256):
                hit |= (np.bitwise_count(prints[front[at : at + 256], None] ^ prints[None, open_]) <= bits).any(axis=0)
            front, open_ = open_[hit], open_[~hit]
            out += [(int(x), int(root)) for x in front]
    return out


def _links(bits: int):
    """mapInArrow over rows (anchor, fp) sorted by anchor: edges (a, b) that join what is linked at an anchor.

    An anchor's rows may go on in the next batch; no anchor has more of them than points
    in its ball."""

    def edges(at: np.ndarray, prints: np.ndarray):
        cut = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(at) else np.zeros(0, np.int64)
        size = np.diff(np.append(cut, len(at)))
        two = cut[size == 2]
        near = two[np.bitwise_count(prints[two] ^ prints[two + 1]) <= bits] if len(two) else two
        a, b = [prints[near + 1]], [prints[near]]
        for c, n in zip(cut[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            own = prints[c : c + n]
            if tree := forest(own, bits):
                x, y = np.array(tree).T
                a.append(own[x])
                b.append(own[y])
        signed = lambda parts: pa.array(np.concatenate(parts).view(np.int64))
        return pa.record_batch([signed(a), signed(b)], names=["a", "b"])

    def run(batches):
        at = prints = np.zeros(0, np.uint64)
        for batch in batches:
            at = np.concatenate((at, batch.column("anchor").to_numpy().view(np.uint64)))
            prints = np.concatenate((prints, batch.column("fp").to_numpy().view(np.uint64)))
            done = int(np.searchsorted(at.view(np.int64), at.view(np.int64)[-1])) if len(at) else 0
            yield edges(at[:done], prints[:done])
            at, prints = at[done:], prints[done:]
        yield edges(at, prints)

    return run


def with_fingerprints(documents: DataFrame, how: Near = Near()) -> DataFrame:
    """(doc_id, fp): the fingerprint of every row's whole text, as a signed long.  doc_id may
    be of any type; the columns may be written in any case."""
    frame = documents.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text"))
    kind = frame.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for start, end, texts in Texts.of(batch.column("text")).parts():
                yield pa.record_batch([batch.column("doc_id").slice(start, end - start), pa.array(fingerprints(texts, how).view(np.int64))], names=["doc_id", "fp"])

    return frame.mapInArrow(run, f"doc_id {kind}, fp long")


def links(prints: DataFrame, bits: int = Near.bits) -> DataFrame:
    """(a, b): edges that connect what links of at most `bits` differing bits connect, from a column fp of different fingerprints."""

    def spread(batches):
        for batch in batches:
            at, own = anchors(batch.column("fp").to_numpy().view(np.uint64), bits)
            yield pa.record_batch([pa.array(at.view(np.int64)), pa.array(own.view(np.int64))], names=["anchor", "fp"])

    placed = prints.select("fp").mapInArrow(spread, "anchor long, fp long")
    return placed.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_links(bits), "a long, b long")


def near_duplicates(documents: DataFrame, how: Near = Near()) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of `documents` (doc_id, text).

    Null, empty and blank texts have fingerprint zero, which links like any other.
    component_id is the smallest doc_id that links reach; rows without an id belong to a
    component without naming it, and if none has an id, it is null.  Repeated rows and
    ids are kept, one row each.  An empty table has none.

    Equal fingerprints become one before anything is compared, so copies cost nothing.
    """
    prints = written(with_fingerprints(documents, how), "fingerprints")
    each = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    found = components(thinned(written(links(each, how.bits), "edges"), "a"))
    named = written(each.join(found, F.col("fp") == F.col("v"), "left").select("fp", "least", F.coalesce("c", "fp").alias("c")), "named")
    least = written(named.groupBy("c").agg(F.min("least").alias("component_id")), "components")
    of = written(named.select("fp", "c").join(least, "c").select("fp", "component_id"), "named")
    out = prints.join(of, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def query(spark, sf_dir: str) -> DataFrame:
    """op11: fingerprint and component of every document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
