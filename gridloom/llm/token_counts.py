"""Token counts of fields and sections by offset-mapped attribution.

A document is encoded once as a whole; each token has a span of characters.  Spans
are joined to the document's sections by interval, and a token that crosses a
boundary goes to one section by an explicit rule, so counts add up to the whole.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesplit import Texts
from .pretokens import Pretokens, WordTable, check_known, library, rows_with, special_strings, tokenizer_text

RULES = ("most", "first", "last")


@dataclass(frozen=True)
class Count:
    """rule: a token that overlaps several sections goes to the one with most of its
    characters (the first of equals), to the first or to the last of them."""

    rule: str = "most"
    tokenizer: str | None = None

    def __post_init__(self):
        if self.rule not in RULES:
            raise ValueError(f"rule must be one of {RULES}")


class Spans:
    """Ids and character spans of the tokens of a piece, under a byte-level BPE file."""

    def __init__(self, tokenizer_json: str):
        self.made = library(tokenizer_json)
        check_known(tokenizer_json, True)
        self.special = special_strings(tokenizer_json)
        self.table = WordTable(self._encode, width=3)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = self.made.encode_batch(words, add_special_tokens=False)
        bounds = np.concatenate(([0], np.cumsum([len(x.ids) for x in got])))
        flat = np.empty((int(bounds[-1]), 3), np.int32)
        flat[:, 0] = np.fromiter(chain.from_iterable(x.ids for x in got), np.int32, len(flat))
        flat[:, 1:] = np.fromiter(chain.from_iterable(chain.from_iterable(x.offsets) for x in got), np.int32, 2 * len(flat)).reshape(-1, 2)
        return flat, bounds

    def of(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows of id, start, end; row bounds; length of each text), all in characters."""
        words = Pretokens(texts, attached=True)
        which = self.table.look_up(words.words())
        sizes = self.table.bounds[which + 1] - self.table.bounds[which]
        flat, bounds = self.table.ids(words)
        flat = flat.astype(np.int64)
        row = np.repeat(words.rows[:-1], np.diff(words.bounds))
        flat[:, 1:] += np.repeat(words.starts - row, sizes)[:, None]
        for r in rows_with(texts, self.special):
            own = self.made.encode(texts.row(r).decode(), add_special_tokens=False)
            part = np.array([(i, *s) for i, s in zip(own.ids, own.offsets, strict=True)], np.int64).reshape(-1, 3)
            flat = np.concatenate((flat[: bounds[r]], part, flat[bounds[r + 1] :]))
            bounds = bounds + np.where(np.arange(len(bounds)) > r, len(part) - (bounds[r + 1] - bounds[r]), 0)
        return flat, bounds, np.diff(words.rows)


@lru_cache(maxsize=2)
def spans(tokenizer_json: str) -> Spans:
    """One for all tasks of a worker process, so its word table is kept."""
    return Spans(tokenizer_json)


def allocate(starts: np.ndarray, ends: np.ndarray, left: np.ndarray, right: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """For each token [starts, ends) its section among the disjoint, rising [left, right)
    (-1: it overlaps none), and whether it crosses a boundary of that section."""
    if not len(left) or not len(starts):
        return np.full(len(starts), -1), np.zeros(len(starts), bool)
    low = np.searchsorted(right, starts, side="right")
    high = np.searchsorted(left, ends, side="left") - 1
    place = np.where(low <= high, high if rule == "last" else low, -1)
    if rule == "most":
        for t in np.flatnonzero(high > low):
            span = np.arange(low[t], high[t] + 1)
            place[t] = span[np.argmax(np.minimum(right[span], ends[t]) - np.maximum(left[span], starts[t]))]
    hit = place >= 0
    crosses = hit & ((starts < left[place]) | (ends > right[place]))
    return place, crosses


def line_spans(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A line with its newline is a section; there is one even in an empty text."""
    sizes = [len(x) + 1 for x in text.split("\n")]
    sizes[-1] -= 1
    if len(sizes) > 1 and not sizes[-1]:
        del sizes[-1]
    right = np.cumsum(sizes)
    return right - sizes, right


_FIELDS = [("doc_id", pa.int64()), ("section", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("n_tokens", pa.int64()), ("n_crossing", pa.int64())]
_SCHEMA = "doc_id long, section int, start long, end long, n_tokens long, n_crossing long"


def _attribute(tokenizer_json: str, rule: str, given: bool):
    def sections(own, text):
        """(numbers, starts, ends) of a row's sections in rising order; the later of two
        that overlap begins where the earlier ends."""
        if not given:
            left, right = line_spans(text)
            return np.arange(len(left)), left, right
        rows = sorted((s["start"], s["end"], s["section"]) for s in own or () if None not in (s["start"], s["end"], s["section"]))
        edge, kept = 0, []
        for a, b, k in rows:
            a, b = max(a, edge), max(b, a, edge)
            kept.append((k, a, b))
            edge = b
        table = np.array(kept, np.int64).reshape(-1, 3)
        return table[:, 0], table[:, 1], table[:, 2]

    def run(batches):
        made = spans(tokenizer_json)
        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            wanted = batch.column("sections").to_pylist() if given else None
            for top, end, texts in Texts.of(batch.column("text")).parts():
                flat, bounds, _ = made.of(texts)
                out: list[list] = [[] for _ in _FIELDS]
                for r in range(end - top):
                    tokens = flat[bounds[r] : bounds[r + 1]]
                    numbers, left, right = sections(wanted[top + r] if given else None, texts.row(r).decode())
                    place, crosses = allocate(tokens[:, 1], tokens[:, 2], left, right, rule)
                    count = np.bincount(place + 1, minlength=len(left) + 1)
                    over = np.bincount(place[crosses], minlength=len(left))
                    rows = [(int(n), int(a), int(b), int(c), int(o)) for n, a, b, c, o in zip(numbers, left, right, count[1:], over, strict=True)]
                    if count[0]:
                        rows.append((None, None, None, int(count[0]), 0))
                    for row in rows:
                        for column, value in zip(out, (names[top + r], *row), strict=True):
                            column.append(value)
                yield pa.record_batch([pa.array(v, t) for v, (_, t) in zip(out, _FIELDS, strict=True)], names=[n for n, _ in _FIELDS])

    return run


def attribute(documents: DataFrame, sections: DataFrame | str | None = None, how: Count = Count()) -> DataFrame:
    """(doc_id, section, start, end, n_tokens, n_crossing): tokens of each section of each
    row of `documents` (doc_id, text); n_crossing of them reach over its boundaries.

    `sections` has half-open spans in characters: the name of a column of `documents`, an
    array of structs (section, start, end), or a table (doc_id, section, start, end), in which
    every row of an id has the id's spans; without either the lines of a text are its
    sections.  Only a column can give sections to rows without an id, or different ones to
    rows that share an id.  The spans of a row are held together, like its text.  Tokens that overlap no section are counted
    in a row whose section is null, if there are any.  Sections without tokens have a
    row with 0.  Null texts are empty; repeated rows are counted each, whatever their ids;
    texts of any length are encoded whole.  Sections with a null are left out; of two that overlap the earlier keeps the common part.
    """
    frame = documents.select("doc_id", "text")
    if isinstance(sections, str):
        frame = documents.select("doc_id", "text", F.col(sections).alias("sections"))
    elif sections is not None:
        own = sections.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.collect_list(F.struct("section", "start", "end")).alias("sections"))
        frame = frame.join(own, "doc_id", "left").select("doc_id", "text", "sections")
    return frame.mapInArrow(_attribute(tokenizer_text(how.tokenizer, "byte_bpe_50k.json"), how.rule, sections is not None), _SCHEMA)


def join_fields(rows: DataFrame, key: str, fields: list[str], between: str = "\n") -> DataFrame:
    """(doc_id, text, sections) for counting fields with `attribute(..., "sections")`: the
    fields joined into one text, and the span of each (section k is fields[k]); a null
    field is empty.  The spans go with the row, so the key may be null or repeated."""
    values = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    spans, at = [], F.lit(0)
    for k, v in enumerate(values):
        spans.append(F.struct(F.lit(k).alias("section"), at.cast("long").alias("start"), (at + F.char_length(v)).cast("long").alias("end")))
        at = at + F.char_length(v) + len(between)
    return rows.select(F.col(key).alias("doc_id"), F.concat_ws(between, *values).alias("text"), F.array(*spans).alias("sections"))


def query(spark, sf_dir: str) -> DataFrame:
    """op3: tokens of every line of every document."""
    return attribute(spark.read.parquet(f"{sf_dir}/documents.parquet"))
