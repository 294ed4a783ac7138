"""Alignment of two tokenizers over a corpus, by common byte offsets.

A piece of many texts is encoded by both tokenizers; cumulated byte lengths give the
ends of all tokens on one scale.  Ends that both have cut the tokens into groups, and
every token of A links with every token of B of its group.  What an id pair counts is
the number of documents that hold it linked.

Counting does not move links.  A block of documents keeps its links as numbers into
a dictionary of its own, so one row for each block and different pair goes to the
shuffle, by pair and salt first and by pair then; the counts come back by block, one
row for each of its pairs, and are gathered there.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesplit import Texts
from .pretokens import Pretokens, WordTable, check_known, gather, library, tokenizer_text
from .shared import written

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"


@dataclass(frozen=True)
class Align:
    """block_bytes: of texts in a block (one longer text is a block).  salts: shares of
    the first sum of a pair.  expand: most links that are expanded at a time."""

    block_bytes: int = 1 << 23
    salts: int = 8
    expand: int = 1 << 20
    a: str | None = None
    b: str | None = None


def byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in byte-level files: printable bytes of Latin-1 for
    themselves, the others in order from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Side:
    """A tokenizer over pieces: ids, and the bytes of every id.

    `words` of a piece are its cuts, which the tokenizer never joins; each distinct one is
    encoded once.  The table keeps (id, 1 if the word's token bytes differ from its own)."""

    bytes_of: list[bytes]

    def __init__(self):
        if len(self.bytes_of) > 1 << 16:
            raise ValueError("ids beyond 16 bits")
        self.sizes = np.array([len(x) for x in self.bytes_of], np.int64)
        self.table = WordTable(self._encode, width=2)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, bounds = self.encode_words(words)
        flat = np.zeros((len(ids), 2), np.int32)
        flat[:, 0] = ids
        raw, sizes = [w.encode() for w in words], np.concatenate(([0], np.cumsum(self.sizes[ids])))[bounds]
        # All words at once; one by one only if that shows a fault.
        if b"".join(map(self.bytes_of.__getitem__, ids.tolist())) != b"".join(raw) or np.diff(sizes).tolist() != list(map(len, raw)):
            for k, word in enumerate(raw):
                own = slice(bounds[k], bounds[k + 1])
                flat[own, 1] = b"".join(map(self.bytes_of.__getitem__, ids[own].tolist())) != word
        return flat, bounds

    def ids(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat ids, row bounds, rows whose token bytes may differ from their text)."""
        words, bounds = self.cut(texts)
        flat, ends = gather(self.table.flat, self.table.bounds, which) if len(which := self.table.look_up(words)) else (self.table.none, np.zeros(1, np.int64))
        rows = ends[bounds]
        odd = np.searchsorted(rows, np.flatnonzero(flat[:, 1]), side="right") - 1
        total = np.concatenate(([0], np.cumsum(self.sizes[flat[:, 0]])))
        short = np.flatnonzero(np.diff(total[rows]) != np.diff(texts.offsets))
        return flat[:, 0], rows, np.union1d(odd, short)


class ByteSide(Side):
    """A byte-level file of the tokenizers library; special tokens' strings are plain text."""

    def __init__(self, tokenizer_json: str):
        check_known(tokenizer_json, True)
        self.made = library(tokenizer_json)
        self.made.encode_special_tokens = True
        letters, special = byte_alphabet(), {k for k, t in self.made.get_added_tokens_decoder().items() if t.special}
        names = {v: k for k, v in self.made.get_vocab(with_added_tokens=True).items()}
        self.bytes_of = [b"" if k in special or k not in names else bytes(map(letters.__getitem__, names[k])) for k in range(max(names) + 1)]
        super().__init__()

    def cut(self, texts: Texts) -> tuple[pa.Array, np.ndarray]:
        cuts = Pretokens(texts, attached=True)
        return cuts.words(), cuts.bounds

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        (got,) = self.made.encode_batch([words], is_pretokenized=True, add_special_tokens=False)
        return np.array(got.ids, np.int64), np.searchsorted(np.array(got.word_ids, np.int64), np.arange(len(words) + 1))


class PieceSide(Side):
    """A sentencepiece BPE model that puts a space before each text and keeps all others.

    No piece of such a file has a space behind another character, and none holds a line
    feed, so texts may be cut before a run of spaces and around line feeds.  A text with
    U+2581, which the model takes for a space, may get other ids than from the library;
    either way its tokens do not give back its bytes."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.made = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = self.made.get_piece_size()
        names = [self.made.id_to_piece(k) for k in range(size)]
        self.bytes_of = []
        for k, name in enumerate(names):
            if self.made.is_byte(k):
                self.bytes_of.append(bytes([int(name[3:5], 16)]))
            elif self.made.is_control(k) or self.made.is_unknown(k):
                self.bytes_of.append(b"")
            else:
                self.bytes_of.append(name.replace("▁", " ").encode())
        texts = [x for k, x in enumerate(self.bytes_of) if not self.made.is_byte(k)]
        if any(b"\n" in x or b" " in x.lstrip(b" ") for x in texts):
            raise ValueError("pieces reach over spaces or line feeds")
        lead = self.made.encode("\n")
        if [self.bytes_of[k] for k in lead] != [b" ", b"\n"] or self.made.encode("  a  \tb") != self.made.encode("  a") + self.made.encode("\n  \tb")[2:]:
            raise ValueError("the model does not keep spaces")
        super().__init__()

    def cut(self, texts: Texts) -> tuple[pa.Array, np.ndarray]:
        data, n = texts.data, len(texts.data)
        first = np.zeros(n, bool)
        first[1:] = (data[1:] == 0x20) & (data[:-1] != 0x20)
        first |= data == 0x0A
        first[1:] |= data[:-1] == 0x0A
        first[texts.offsets[:-1][np.diff(texts.offsets) > 0]] = True
        starts = np.flatnonzero(first)
        offsets = np.append(starts, n).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
        return words, np.searchsorted(starts, texts.offsets)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # Behind a line feed a word is encoded as it stands; the space and the line feed before it go.
        found = self.made.encode(["\n" + w for w in words], num_threads=1)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ends = np.cumsum(sizes)
        keep = np.ones(ends[-1] if len(ends) else 0, bool)
        keep[ends - sizes] = keep[ends - sizes + 1] = False
        flat = np.fromiter(chain.from_iterable(found), np.int64, len(keep))
        return flat[keep], np.concatenate(([0], np.cumsum(sizes - 2)))


@lru_cache(maxsize=2)
def sides(a: str, b: bytes) -> tuple[ByteSide, PieceSide]:
    """One pair for all tasks of a worker process, so their tables are kept."""
    return ByteSide(a), PieceSide(b)


def spaced(column: pa.Array) -> pa.Array:
    """A space before every text; null and empty ones stay empty."""
    text = pc.fill_null(column.cast(pa.large_string()), "")
    return pc.if_else(pc.equal(text, ""), text, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), text, pa.scalar("", pa.large_string())))


@lru_cache(maxsize=1)
def _digits() -> tuple[np.ndarray, np.ndarray]:
    """The decimal digits of every id, and which of them it has."""
    ids, powers = np.arange(1 << 16), 10 ** np.arange(4, -1, -1)
    shown = ids[:, None] >= powers
    shown[:, -1] = True
    return (ids[:, None] // powers % 10 + 48).astype(np.uint8), shown


def _decimal(ids: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, ends): every id in decimal with its mark behind it (0: none)."""
    digits, shown = _digits()
    cells, keep = np.empty((len(ids), 6), np.uint8), np.empty((len(ids), 6), bool)
    cells[:, :5], cells[:, 5] = digits[ids], marks
    keep[:, :5], keep[:, 5] = shown[ids], marks > 0
    return cells[keep], np.cumsum(keep.sum(axis=1))


class Aligned:
    """The groups of a piece: n_a, n_b and n_groups of each row, group hashes and links."""

    def __init__(self, texts: Texts, a: ByteSide, b: PieceSide):
        (ids_a, rows_a, odd_a), (ids_b, rows_b, odd_b) = a.ids(texts), b.ids(texts)
        wrong = [r for r in np.union1d(odd_a, odd_b).astype(int).tolist() if any(b"".join(map(s.bytes_of.__getitem__, ids[rows[r] : rows[r + 1]].tolist())) != texts.row(r) for s, ids, rows in ((a, ids_a, rows_a), (b, ids_b, rows_b)))]
        self.rows = texts.rows
        self.ids_a, self.rows_a = _without(ids_a, rows_a, wrong)
        self.ids_b, self.rows_b = _without(ids_b, rows_b, wrong)
        self.ends_a, self.ends_b = np.cumsum(a.sizes[self.ids_a]), np.cumsum(b.sizes[self.ids_b])
        # Tokens are not empty, so ends differ; every row ends in a common cut, so no group reaches over rows.
        cuts = np.intersect1d(self.ends_a, self.ends_b, assume_unique=True)
        self.group_a, self.group_b = np.searchsorted(cuts, self.ends_a), np.searchsorted(cuts, self.ends_b)
        self.size_a, self.size_b = np.bincount(self.group_a, minlength=len(cuts)), np.bincount(self.group_b, minlength=len(cuts))
        self.first_a, self.first_b = np.cumsum(self.size_a) - self.size_a, np.cumsum(self.size_b) - self.size_b
        n_a = np.diff(self.rows_a)
        row_a = np.repeat(np.arange(self.rows), n_a)
        self.row = row_a[self.first_a] if len(cuts) else np.zeros(0, np.int64)
        self.n_groups = np.bincount(self.row, minlength=self.rows)
        self.n_links = np.bincount(self.row, self.size_a * self.size_b, self.rows).astype(np.int64) if len(cuts) else np.zeros(self.rows, np.int64)

    def hashes(self) -> list[str]:
        """sha256 of each row's groups in decimal; empty without tokens."""
        n = len(self.ids_a) + len(self.ids_b)
        at_a = np.arange(len(self.ids_a)) + self.first_b[self.group_a]
        at_b = np.arange(len(self.ids_b)) + (self.first_a + self.size_a)[self.group_b]
        ids, marks = np.zeros(n, np.int64), np.full(n, ord(","), np.uint8)
        ids[at_a], ids[at_b] = self.ids_a, self.ids_b
        marks[self.first_a + self.size_a - 1 + self.first_b] = ord("|")
        last = self.first_a + self.size_a + self.first_b + self.size_b - 1
        marks[last] = ord(";")
        row_end = (self.rows_a + self.rows_b)[1:] - 1
        marks[row_end[np.diff(self.rows_a) > 0]] = 0
        text, ends = _decimal(ids, marks)
        at = np.concatenate(([0], ends))[self.rows_a + self.rows_b]
        raw = text.tobytes()
        return [hashlib.sha256(raw[x:y]).hexdigest() if y > x else "" for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def pairs(self, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, pair, times): the different linked id pairs of each row, sorted.

        Links are expanded by repeats, `most` at a time; a group with more is
        expanded by its different ids and how often it has them."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        links = self.size_a * self.size_b
        huge = np.flatnonzero(links > most)
        total = np.cumsum(np.where(links > most, 0, links))
        at = 0
        while at < len(links):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, side="right")))
            groups = np.arange(at, to)[links[at:to] <= most]
            tokens_a, _ = _ranges(self.first_a[groups], self.size_a[groups])
            own = self.group_a[tokens_a]
            token_b, repeat = _ranges(self.first_b[own], self.size_b[own])
            pair = self.ids_a[tokens_a][repeat].astype(np.int64) << 16 | self.ids_b[token_b]
            found.append(_counted(self.row[own][repeat], pair, None))
            at = to
        for g in huge.tolist():
            (ua, ca), (ub, cb) = (np.unique(x, return_counts=True) for x in (self.ids_a[self.first_a[g] :][: self.size_a[g]], self.ids_b[self.first_b[g] :][: self.size_b[g]]))
            pair = (ua.astype(np.int64)[:, None] << 16 | ub[None, :]).ravel()
            found.append((np.full(len(pair), self.row[g]), pair, (ca[:, None] * cb[None, :]).ravel()))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        row, pair, times = (np.concatenate(x) for x in zip(*found, strict=True))
        return (row, pair, times) if len(found) == 1 else _counted(row, pair, times)


def _without(ids: np.ndarray, rows: np.ndarray, wrong: list[int]) -> tuple[np.ndarray, np.ndarray]:
    if not wrong:
        return ids, rows
    sizes = np.diff(rows)
    gone = np.zeros(len(sizes), bool)
    gone[wrong] = True
    return ids[~np.repeat(gone, sizes)], np.concatenate(([0], np.cumsum(np.where(gone, 0, sizes))))


def _ranges(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, owner): first[k] ... first[k] + size[k] - 1 of every k, and k."""
    owner = np.repeat(np.arange(len(size)), size)
    return np.arange(len(owner)) + np.repeat(first - (np.cumsum(size) - size), size), owner


def _counted(row: np.ndarray, pair: np.ndarray, times: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal (row, pair) joined, with the sum of their times."""
    order = np.lexsort((pair, row)) if len(row) and row.max() >= 1 << 31 else np.argsort(row << 32 | pair, kind="stable")
    row, pair = row[order], pair[order]
    cut = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (pair[1:] != pair[:-1])))) if len(row) else np.zeros(0, np.int64)
    if times is None:
        return row[cut], pair[cut], np.diff(np.append(cut, len(row)))
    return row[cut], pair[cut], np.add.reduceat(times[order], cut) if len(cut) else times[:0]


_DOC = ("n_a", "n_b", "n_groups", "n_links")
_BLOCK = "block long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, pairs binary, documents binary, sizes binary, refs binary, times binary"


def _encode(a: str, b: bytes, how: Align):
    """mapInArrow over (doc_id, text): a row for each block.

    pairs: its different pairs, most frequent first; documents: of the block that hold each
    one; sizes: different pairs of each document; refs and times: these, by document."""

    def run(batches):
        first, second = sides(a, b)
        part, number = TaskContext.get().partitionId(), 0
        parts, held = [], 0

        def block():
            nonlocal number
            keys, numbers, hashes, sizes, pair, times = (list(x) for x in zip(*parts, strict=True))
            pair, times = np.concatenate(pair), np.concatenate(times)
            own, inverse, documents = np.unique(pair, return_inverse=True, return_counts=True)
            order = np.argsort(-documents, kind="stable")
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order))
            numbers = [np.concatenate(x) for x in zip(*numbers, strict=True)]
            one = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind))
            names = pa.concat_arrays(keys)
            values = [
                pa.array([part << 32 | number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names), *(one(x, pa.int64()) for x in numbers),
                one([h for x in hashes for h in x], pa.string()), *(pa.array([x.tobytes()], pa.binary()) for x in (own[order].astype(np.int64), documents[order].astype(np.int32), np.concatenate(sizes).astype(np.int32), rank[inverse.ravel()], times)),
            ]
            number += 1
            return pa.record_batch(values, names=[c.split()[0] for c in _BLOCK.split(", ")])

        for batch in batches:
            for start, end, texts in Texts.of(spaced(batch.column("text"))).parts():
                found = Aligned(texts, first, second)
                row, pair, times = found.pairs(how.expand)
                parts.append((batch.column("doc_id").slice(start, end - start), (np.diff(found.rows_a), np.diff(found.rows_b), found.n_groups, found.n_links), found.hashes(), np.bincount(row, minlength=texts.rows), pair.astype(np.uint32), times if times.max(initial=0) >= 1 << 31 else times.astype(np.int32)))
                held += len(texts.data)
                if held >= how.block_bytes:
                    yield block()
                    parts, held = [], 0
        if parts:
            yield block()

    return run


def _own_pairs(batches):
    """Rows (block, pair, n) of blocks: how many documents of a block hold each of its pairs."""
    for batch in batches:
        for block, pairs, documents in zip(*(batch.column(c) for c in ("block", "pairs", "documents")), strict=True):
            pair = np.frombuffer(pairs.as_py(), np.int64)
            for at in range(0, len(pair), 1 << 16):
                own = pair[at : at + (1 << 16)]
                yield pa.record_batch([pa.array(np.full(len(own), block.as_py())), pa.array(own), pa.array(np.frombuffer(documents.as_py(), np.int32)[at : at + (1 << 16)].astype(np.int64))], names=["block", "pair", "n"])


def pair_counts(blocks: DataFrame, how: Align = Align()) -> DataFrame:
    """(a, b, pair, n, best) of every linked id pair: the documents that hold it, and
    whether no pair of its A id has more."""
    each = blocks.select("block", "pairs", "documents").mapInArrow(_own_pairs, "block long, pair long, n long")
    salted = each.groupBy("pair", F.pmod("block", F.lit(how.salts)).alias("salt")).agg(F.sum("n").alias("n"))
    counts = written(salted.groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    a = F.shiftright("pair", 16)
    # A row for each id of A at most: bounded by the vocabulary.
    top = counts.groupBy(a.alias("a")).agg(F.max("n").alias("top"))
    return counts.select(a.alias("a"), F.col("pair").bitwiseAND(0xFFFF).alias("b"), "pair", "n").join(F.broadcast(top), "a").select("a", "b", "pair", "n", (F.col("n") == F.col("top")).alias("best"))


def _gather(block: pa.Table, counts: pa.Table) -> pa.Table:
    """cogroup of one block and the counts of its pairs: its documents."""
    out = []
    for r in range(block.num_rows):
        get = lambda c, kind: np.frombuffer(block[c][r].as_py(), kind)  # noqa: B023, E731
        pairs, sizes, refs = get("pairs", np.int64), get("sizes", np.int32), get("refs", np.int32)
        times = get("times", np.int64 if len(refs) and len(block["times"][r].as_py()) == 8 * len(refs) else np.int32).astype(np.int64)
        key = counts["pair"].to_numpy()
        order = np.argsort(key)
        at = order[np.searchsorted(key, pairs, sorter=order)] if len(pairs) else np.zeros(0, np.int64)
        n, best = counts["n"].to_numpy()[at], counts["best"].to_numpy(zero_copy_only=False)[at].astype(np.int64)
        total = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[np.concatenate(([0], np.cumsum(sizes)))])  # noqa: B023, E731
        own = [block["doc_ids"][r].values, *(block[c][r].values for c in (*_DOC, "groups_sha256"))]
        out.append(pa.table([*own, pa.array(total(best[refs] * times)), pa.array(total(n[refs] * times))], names=["doc_id", *_DOC, "groups_sha256", "n_best", "count_sum"]))
    return pa.concat_tables(out) if out else pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in _DOC), ("groups_sha256", pa.string()), ("n_best", pa.int64()), ("count_sum", pa.int64())]).empty_table()


def align(documents: DataFrame, how: Align = Align()) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and
    groups_sha256 of every row of `documents` (doc_id, text), and `pair_counts`.

    Texts that are null or empty, and those whose tokens do not give back their bytes, have
    no tokens: zeros and an empty hash.  Repeated rows and ids are kept and count one
    document each.  An empty table has no rows.
    """
    with open(how.b or _piece_file(), "rb") as f:
        model = f.read()
    a = tokenizer_text(how.a, A_FILE)
    blocks = written(documents.select("doc_id", "text").mapInArrow(_encode(a, model, how), _BLOCK), "blocks")
    counts = written(pair_counts(blocks, how), "pairs")
    asked = blocks.select("block", "pairs", "documents").mapInArrow(_own_pairs, "block long, pair long, n long").select("block", "pair")
    answers = asked.join(counts.select("pair", "n", "best"), "pair")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    out = blocks.drop("documents").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_gather, schema)
    return out.select("doc_id", *_DOC, "n_best", "count_sum", "groups_sha256"), counts


def _piece_file() -> str:
    import public_tokenizers

    return public_tokenizers.path(B_FILE)


def query(spark, sf_dir: str) -> DataFrame:
    """op12: groups, links and corpus-wide counts of every document."""
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"))[0]
