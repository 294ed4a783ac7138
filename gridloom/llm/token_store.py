"""Token-id output: a concatenated id array with Elias-Fano document boundaries.

Documents are ranged by doc_id; each task encodes its range and cuts it into
segments.  A segment is a file image that stands alone:

    magic, id width, low bits                       8 bytes, little endian like all that follows
    documents, ids, samples, bytes of high halves   four unsigned 64-bit numbers
    low halves                                      documents * low bits, packed
    high halves                                     a bit vector with a one for each boundary
    samples                                         unsigned 32-bit: the place of every 256th one
    ids                                             documents' ids on end, 2 or 4 bytes each

Boundary k is where document k + 1 begins.  A select structure (the samples and a
short scan) finds any boundary, so there is no table of 64-bit offsets: a document
costs its low half, two to three bits, and an eighth of a bit for samples.

Segments are rows of a Parquet table in the shared folder, whose commit protocol
keeps exactly one copy of each when executors are lost; `export` writes the images
to files of their own.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesplit import Texts
from .pretokens import byte_tokenizer, tokenizer_text
from .shared import written

MAGIC = b"GLTOK1"
EVERY = 256
_HEAD = struct.Struct("<6sBBQQQQ")


@dataclass(frozen=True)
class Store:
    """end: the id that closes a document.  segment_ids, segment_documents: a segment
    is closed when it holds that many (one longer document is a segment)."""

    end: int = 0
    segment_ids: int = 1 << 20
    segment_documents: int = 1 << 16
    tokenizer: str | None = None


class Boundaries:
    """A rising sequence of non-negative integers in Elias-Fano form."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> Boundaries:
        values = np.asarray(values, np.int64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        bits = ((values[:, None] >> np.arange(low_bits)) & 1).astype(np.uint8).ravel()
        ones = (values >> low_bits) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        return cls(n, low_bits, np.packbits(bits, bitorder="little"), np.packbits(high, bitorder="little"), ones[::EVERY].astype(np.uint32))

    def _low(self, k: np.ndarray) -> np.ndarray:
        at = k[:, None] * self.low_bits + np.arange(self.low_bits)
        return (((self.low[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)

    def select(self, k: int) -> int:
        """The k-th value: the sample before it, then a scan of the bytes behind."""
        if not 0 <= k < self.n:
            raise IndexError(k)
        at = int(self.samples[k // EVERY])
        rest = k % EVERY
        byte, place = at >> 3, -1
        word = int(self.high[byte]) & (0xFF << (at & 7)) & 0xFF
        while (ones := word.bit_count()) <= rest:
            rest -= ones
            byte += 1
            word = int(self.high[byte])
        for place in range(8):
            if word >> place & 1:
                if rest == 0:
                    break
                rest -= 1
        return ((byte * 8 + place - k) << self.low_bits) | int(self._low(np.array([k]))[0])

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        return ((ones - np.arange(self.n)) << self.low_bits) | self._low(np.arange(self.n))


def pack(ids: np.ndarray, sizes: np.ndarray, width: int) -> bytes:
    """A segment's image from the ids of its documents on end."""
    ends = Boundaries.of(np.cumsum(sizes))
    head = _HEAD.pack(MAGIC, width, ends.low_bits, ends.n, len(ids), len(ends.samples), len(ends.high))
    return b"".join((head, ends.low.tobytes(), ends.high.tobytes(), ends.samples.astype("<u4").tobytes(), ids.astype(f"<u{width}").tobytes()))


def unpack(image: bytes) -> tuple[np.ndarray, Boundaries]:
    """(ids, ends of the documents) of a segment's image."""
    magic, width, low_bits, n, count, samples, high = _HEAD.unpack_from(image)
    if magic != MAGIC:
        raise ValueError("not a token segment")
    at, parts = _HEAD.size, []
    for kind, size in ((np.uint8, (n * low_bits + 7) // 8), (np.uint8, high), (np.dtype("<u4"), samples), (np.dtype(f"<u{width}"), count)):
        parts.append(np.frombuffer(image, kind, size, at))
        at += parts[-1].nbytes
    return parts[3], Boundaries(n, low_bits, *parts[:3])


def document(image: bytes, k: int) -> np.ndarray:
    """The ids of the k-th document of a segment, by two selects."""
    ids, ends = unpack(image)
    return ids[ends.select(k - 1) if k else 0 : ends.select(k)]


_SCHEMA = "part int, before long, n_ids long, doc_ids array<long>, image binary"


def _write(tokenizer_json: str, store: Store):
    """mapInArrow over a sorted partition: its segments; before = ids ahead of it in the partition."""

    def run(batches):
        made = byte_tokenizer(tokenizer_json)
        width = 2 if max(made.cut.get_vocab_size(with_added_tokens=True), store.end + 1) <= 1 << 16 else 4
        part, before = TaskContext.get().partitionId(), 0
        keys, parts, sizes, held = [], [], [], 0

        def segment():
            ids = np.concatenate(parts)
            row = [[part], [before], [len(ids)], [keys], [pack(ids, np.array(sizes), width)]]
            return pa.record_batch([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()), strict=True)], names=["part", "before", "n_ids", "doc_ids", "image"])

        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            for start, end, texts in Texts.of(batch.column("text")).parts():
                flat, bounds = made.ids(texts)
                for r in range(end - start):
                    keys.append(names[start + r])
                    parts += (flat[bounds[r] : bounds[r + 1]], np.array([store.end], np.int32))
                    sizes.append(int(bounds[r + 1] - bounds[r]) + 1)
                    held += sizes[-1]
                    if held >= store.segment_ids or len(keys) >= store.segment_documents:
                        yield segment()
                        before += held
                        keys, parts, sizes, held = [], [], [], 0
        if keys:
            yield segment()

    return run


def write(documents: DataFrame, store: Store = Store()) -> DataFrame:
    """The segments of `documents` (doc_id, text) in rising order of doc_id, null first.

    Null texts are empty: the end id alone.  Repeated rows and ids are kept, one
    document each, ordered by a hash of the text.  An empty table has no segments.
    """
    frame = documents.select("doc_id", "text").withColumn("tie", F.xxhash64("text"))
    frame = frame.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    return written(frame.mapInArrow(_write(tokenizer_text(store.tokenizer, "byte_bpe_50k.json"), store), _SCHEMA), "segments")


def _documents(segments: DataFrame, of, schema: str) -> DataFrame:
    """(doc_id, start, n_tokens) and a column more of every document: of(ids) of a segment's
    documents, each as little-endian 4-byte integers, in the task that reads the segment.
    schema: of that column, as "name type"."""
    from pyspark.sql import Window

    total = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    ahead = total.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("ahead"))
    placed = segments.join(F.broadcast(ahead), "part").select((F.col("ahead") + F.col("before")).alias("base"), "doc_ids", "image")
    name = schema.split()[0]

    def run(batches):
        for batch in batches:
            for base, keys, image in zip(*(batch.column(c) for c in ("base", "doc_ids", "image")), strict=True):
                ids, ends = unpack(image.as_py())
                ends = ends.all()
                starts = np.concatenate(([0], ends[:-1]))
                raw = memoryview(ids.astype("<u4").view(np.uint8))
                last = of(raw[4 * a : 4 * b] for a, b in zip(starts, ends, strict=True))
                yield pa.record_batch([keys.values, pa.array(starts + base.as_py()), pa.array(ends - starts), last], names=["doc_id", "start", "n_tokens", name])

    return placed.mapInArrow(run, f"doc_id long, start long, n_tokens long, {schema}")


def read(segments: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids): every document's ids as little-endian 4-byte integers.

    start counts the ids of all documents before it: those of earlier ranges (one
    row for each partition of one stage, so it may be broadcast), of earlier
    segments of its range and of earlier documents of its segment.
    """
    return _documents(segments, lambda own: pa.array([x.tobytes() for x in own], pa.binary()), "ids binary")


def sums(segments: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): `read` with a checksum in place of each
    document's ids, which then do not leave the task that reads them."""
    return _documents(segments, lambda own: pa.array([zlib.crc32(x) for x in own], pa.int64()), "ids_crc32 long")


def export(segments: DataFrame, uri: str) -> DataFrame:
    """Writes each image to a file of its own under `uri` (any store pyarrow reaches)
    and returns (part, before, n_ids, path).  A file appears under its name only when
    it is whole, so a task that runs twice leaves the same files."""

    def run(batches):
        from pyarrow import fs

        to, top = fs.FileSystem.from_uri(uri)
        to.create_dir(top, recursive=True)
        for batch in batches:
            paths = []
            for part, before, image in zip(*(batch.column(c) for c in ("part", "before", "image")), strict=True):
                path = f"{top}/{part.as_py():06d}-{before.as_py():016d}.gltok"
                draft = f"{path}.{TaskContext.get().taskAttemptId()}"
                with to.open_output_stream(draft) as f:
                    f.write(image.as_py())
                to.move(draft, path)
                paths.append(path)
            yield pa.record_batch([*(batch.column(c) for c in ("part", "before", "n_ids")), pa.array(paths, pa.string())], names=["part", "before", "n_ids", "path"])

    return segments.select("part", "before", "n_ids", "image").mapInArrow(run, "part int, before long, n_ids long, path string")


def query(spark, sf_dir: str) -> DataFrame:
    """op2: start, length and checksum of every document's ids, from the segments read back."""
    return sums(write(spark.read.parquet(f"{sf_dir}/documents.parquet")))
