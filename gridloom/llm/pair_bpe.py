"""BPE encoding by a pair occurrence index, and decoding.

A task's new words lie in one linked list of symbols.  The index maps every pair of
neighbouring symbols to all of its positions; ranks that are active (their pair
occurs) are applied in ascending order.  Applying one merges its positions and moves
the neighbouring pairs' entries to the lists of the new pairs, which become active
in turn.  No word is scanned twice.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesplit import Texts
from .pretokens import Pretokens, WordTable, check_known, rows_with, special_strings, tokenizer_text


def byte_letters() -> list[str]:
    """The public byte-level alphabet: printable Latin-1 bytes stand for themselves,
    the others for the code points from 256 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


@dataclass
class Merges:
    """The tables of a tokenizer file: ids of single letters (inside and at the end of
    a word), the rank and result of each pair, and the string of each id."""

    inner: list[int | None]
    final: list[int | None]
    pairs: dict[int, tuple[int, int]]
    tokens: list[str]
    special: dict[str, int] = field(default_factory=dict)

    @classmethod
    def of(cls, tokenizer_json: str) -> Merges:
        data = json.loads(tokenizer_json)
        model = data["model"]
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        pairs = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            pairs.setdefault(vocab[a] << 32 | vocab[b], (rank, vocab[a + b]))
        special = {x["content"]: x["id"] for x in data.get("added_tokens") or ()}
        size = max([*vocab.values(), *special.values()]) + 1
        tokens = [""] * size
        for word, k in (vocab | special).items():
            tokens[k] = word
        return cls([vocab.get(x) for x in letters], [vocab.get(x + end) for x in letters], pairs, tokens, special)


def apply_merges(words: list[str], merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """(flat ids, bounds) of the words' symbols after all merges.

    A letter that the vocabulary lacks is dropped, as the library does without an
    unknown token.  Should a merge activate a lower rank (files that were not built
    by training can), the rest of the current list waits for it.
    """
    inner, final, pairs = merges.inner, merges.final, merges.pairs
    sym: list[int] = []
    cut = [0]
    for word in words:
        raw = word.encode()
        sym += [s for s in map(inner.__getitem__, raw[:-1]) if s is not None]
        if (s := final[raw[-1]]) is not None:
            sym.append(s)
        cut.append(len(sym))
    n = len(sym)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    for k in cut:
        if k < n:
            before[k] = -1
        if k:
            after[k - 1] = -1

    index: dict[int, list[int]] = {}
    for p in range(n):
        if (q := after[p]) >= 0:
            pair = sym[p] << 32 | sym[q]
            if pair in pairs:
                index.setdefault(pair, []).append(p)
    active = [(pairs[pair][0], pair) for pair in index]
    heapq.heapify(active)
    while active:
        rank, pair = heapq.heappop(active)
        places = index.pop(pair, None)
        if not places:
            continue
        left, right = pair >> 32, pair & 0xFFFFFFFF
        made = pairs[pair][1]
        places.sort()
        for at, p in enumerate(places):
            q = after[p]
            if q < 0 or sym[p] != left or sym[q] != right:
                continue  # an earlier merge took one of the two
            sym[p], sym[q] = made, -1
            nxt = after[p] = after[q]
            low = rank
            if nxt >= 0:
                before[nxt] = p
                low = min(low, _enter(index, active, pairs, made << 32 | sym[nxt], p))
            if (prv := before[p]) >= 0:
                low = min(low, _enter(index, active, pairs, sym[prv] << 32 | made, prv))
            if low < rank:
                index.setdefault(pair, []).extend(places[at + 1 :])
                heapq.heappush(active, (rank, pair))
                break
    flat = np.array(sym, np.int64)
    alive = flat >= 0
    return flat[alive].astype(np.int32), np.concatenate(([0], np.cumsum(alive)))[cut] if n else np.zeros(len(cut), np.int64)


def _enter(index, active, pairs, pair, place) -> int:
    """Adds a position to a pair's list; the pair's rank (none: very high)."""
    found = pairs.get(pair)
    if found is None:
        return 1 << 60
    if (places := index.get(pair)) is None:
        index[pair] = [place]
        heapq.heappush(active, (found[0], pair))
    else:
        places.append(place)
    return found[0]


def normalise(text: str) -> str:
    """Canonical composition and lower case letter by letter (a final sigma is like any
    other).  White space needs no folding: it separates pre-tokens and goes."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()


class PairTokenizer:
    """Ids and strings of batches of texts under one tokenizer file."""

    def __init__(self, tokenizer_json: str):
        import regex

        check_known(tokenizer_json, False)
        self.merges = Merges.of(tokenizer_json)
        self.special = special_strings(tokenizer_json)
        self.table = WordTable(lambda words: apply_merges(words, self.merges))
        self._cut = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.table.ids(Pretokens(Texts.of([normalise(t) for t in texts]), attached=False))

    def ids(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, row bounds) of a piece; special tokens' strings are cut out first."""
        rows = [texts.row(r).decode() for r in range(texts.rows)]
        special = set(rows_with(texts, self.special))
        flat, bounds = self._plain([("" if r in special else t) for r, t in enumerate(rows)])
        if not special:
            return flat, bounds
        own = [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        for r in special:
            pieces, names = self._cut.split(rows[r]), self._cut.findall(rows[r])
            got, cut = self._plain(pieces)
            mixed = [got[: cut[1]]]
            for k, name in enumerate(names, 1):
                mixed += (np.array([self.merges.special[name]], np.int32), got[cut[k] : cut[k + 1]])
            own[r] = np.concatenate(mixed)
        return np.concatenate(own), np.concatenate(([0], np.cumsum([len(x) for x in own])))

    def decode(self, ids: list[int]) -> str:
        """As the library does for a file without a decoder: the tokens' strings, spaced."""
        return " ".join(map(self.merges.tokens.__getitem__, ids))


WORD_FILE = "word_bpe_49k.json"


@lru_cache(maxsize=2)
def pair_tokenizer(tokenizer_json: str) -> PairTokenizer:
    """One for all tasks of a worker process, so its tables and words are kept."""
    return PairTokenizer(tokenizer_json)


def _schema(frame: DataFrame, extra: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema), extra])


def encode(documents: DataFrame, tokenizer: str | None = None, column: str = "text") -> DataFrame:
    """All columns of `documents` but one named token_ids, plus token_ids (array of int).

    Null and empty texts have no ids.  Rows are kept one for one, repeated or not.
    """
    tokenizer_json = tokenizer_text(tokenizer, WORD_FILE)
    frame = documents.drop("token_ids")

    def run(batches):
        made = pair_tokenizer(tokenizer_json)
        for batch in batches:
            for start, end, texts in Texts.of(batch.column(column)).parts():
                flat, bounds = made.ids(texts)
                ids = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat))
                own = batch.slice(start, end - start)
                yield pa.record_batch([*own.columns, ids], names=[*own.schema.names, "token_ids"])

    return frame.mapInArrow(run, _schema(frame, "token_ids array<int>"))


def decode(encoded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Replaces or adds decoded (string) from token_ids; null ids decode to nothing."""
    tokens = Merges.of(tokenizer_text(tokenizer, WORD_FILE)).tokens
    frame = encoded.drop("decoded")

    def run(batches):
        for batch in batches:
            texts = pa.array([" ".join(map(tokens.__getitem__, x.as_py() or ())) for x in batch.column("token_ids")], pa.string())
            yield pa.record_batch([*batch.columns, texts], names=[*batch.schema.names, "decoded"])

    return frame.mapInArrow(run, _schema(frame, "decoded string"))


def digests(documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes and decodes every text
    and keeps only the digests, piece by piece, so no array of ids leaves a task."""
    tokenizer_json = tokenizer_text(tokenizer, WORD_FILE)

    def run(batches):
        made = pair_tokenizer(tokenizer_json)
        decimal = [str(k) for k in range(len(made.merges.tokens))].__getitem__
        for batch in batches:
            for start, end, texts in Texts.of(batch.column("text")).parts():
                flat, bounds = made.ids(texts)
                one, two = [], []
                for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                    ids = flat[a:b].tolist()
                    one.append(hashlib.sha256(" ".join(map(decimal, ids)).encode()).hexdigest())
                    two.append(hashlib.sha256(made.decode(ids).encode()).hexdigest())
                yield pa.record_batch([batch.column("doc_id").slice(start, end - start), pa.array(np.diff(bounds)), pa.array(one, pa.string()), pa.array(two, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark, sf_dir: str) -> DataFrame:
    """op6: lengths and digests of the ids and the decoded text of every document."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def with_tokens(documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """`documents` with token_ids and n_tokens, the form in which a corpus is handed on."""
    return encode(documents, tokenizer).withColumn("n_tokens", F.size("token_ids").cast("long"))
