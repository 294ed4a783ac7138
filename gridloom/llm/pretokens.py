"""Pre-tokens of a batch of texts by numpy passes, and their ids by table.

A BPE tokenizer's ids of a text are the ids of its pre-tokens in a row, so a task
finds the pre-tokens of a whole piece at once, has every distinct one encoded a
single time and gathers the ids of all others from that table.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache, cached_property, lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa

from .bytesplit import Texts

OTHER, LETTER, NUMBER, BLANK = 0, 1, 2, 3

#: The contractions that both public patterns name first.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
#: White space of the patterns' \\s, which lacks U+001C to U+001F.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


@cache
def char_classes() -> np.ndarray:
    """Class of every code point."""
    import regex

    out = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            a, b = m.span()
            move = 0x800 if a >= 0xD800 else 0
            out[a + move : b + move] = kind
    # A run of letters does not reach over the surrogates: U+D7FF and U+E000 are not letters.
    out[[ord(c) for c in BLANKS]] = BLANK
    return out


def code_points(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all rows in a row, and the byte where each begins (one more at the end)."""
    lead = np.flatnonzero((texts.data & 0xC0) != 0x80)
    points = np.frombuffer(texts.data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    return points, np.append(lead, len(texts.data))


class Pretokens:
    """Spans of all pre-tokens of a piece: start and end (code points) and row bounds.

    With `attached`, a space joins the run behind it, runs of numbers stay whole and
    white space is kept; without, white space is dropped and each number stands alone.
    """

    def __init__(self, texts: Texts, attached: bool):
        points, at_byte = code_points(texts)
        n = len(points)
        kind = char_classes()[points]
        rows = np.searchsorted(at_byte, texts.offsets)
        first = np.ones(n, bool)
        if n:
            first[1:] = kind[1:] != kind[:-1]
        heads = rows[:-1][rows[:-1] < rows[1:]]
        first[heads] = True
        if not attached:
            first |= kind == NUMBER
        runs = first.copy()
        if attached and n:
            # The last white space of a run goes with what follows (a space) or stands alone.
            last = np.zeros(n, bool)
            last[:-1] = (kind[:-1] == BLANK) & (kind[1:] != BLANK)
            tails = rows[1:] - 1
            last[tails[tails >= 0]] = False
            first |= last
            behind = np.flatnonzero(last & (points == 0x20)) + 1
            first[behind] = False
        self._contract(points, kind, rows, runs, first, attached)
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], n)
        if not attached:
            keep = kind[starts] != BLANK
            starts, ends = starts[keep], ends[keep]
        self.texts, self.at_byte, self.rows = texts, at_byte, rows
        self.starts, self.ends = starts, ends
        self.bounds = np.searchsorted(starts, rows)

    @staticmethod
    def _contract(points, kind, rows, runs, first, attached) -> None:
        """A quote that begins a run of other characters takes a contraction's letters."""
        n = len(points)
        quote = np.flatnonzero((points == 0x27) & runs)
        if attached:
            # After a space the quote belongs to that space's token, unless a row begins here.
            spaced = (quote > 0) & (points[np.maximum(quote - 1, 0)] == 0x20) & ~np.isin(quote, rows)
            quote = quote[~spaced]
        if not len(quote):
            return
        limit = rows[np.searchsorted(rows, quote, side="right")]
        open_ = np.ones(len(quote), bool)
        for word in CONTRACTIONS:
            size = len(word)
            fits = open_ & (quote + size <= limit)
            for j, c in enumerate(word[1:], 1):
                fits &= points[np.minimum(quote + j, n - 1)] == ord(c)
            hit = quote[fits]
            open_ &= ~fits
            first[hit + 1] = False
            rest = hit + size
            # What follows begins anew: the rest of the letters, or whatever began there anyway.
            inner = rest[rest < n]
            inner = inner[kind[inner] == LETTER]
            first[inner] = True

    def words(self) -> pa.Array:
        """The pre-tokens as strings over the piece's own bytes."""
        a, b = self.at_byte[self.starts], self.at_byte[self.ends]
        n = len(a)
        if n and (b[:-1] == a[1:]).all():
            offsets, data = np.append(a, b[-1]), self.texts.data
        else:
            sizes = b - a
            offsets = np.concatenate(([0], np.cumsum(sizes)))
            data = self.texts.data[np.repeat(a - offsets[:-1], sizes) + np.arange(offsets[-1])] if n else self.texts.data[:0]
        return pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def gather(flat: np.ndarray, bounds: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ragged entries `which` of (flat, bounds) in a row, and their new bounds."""
    sizes = bounds[which + 1] - bounds[which]
    out = np.concatenate(([0], np.cumsum(sizes)))
    return flat[np.repeat(bounds[which] - out[:-1], sizes) + np.arange(out[-1])], out


class WordTable:
    """Ids of the distinct pre-tokens that a task has met.

    `encode` gets new words and returns (flat, bounds), a row of `flat` being an id or
    an id with what else is known of it (`width` numbers).  The table is emptied when
    it holds `most` words, which bounds its memory and changes no result.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], width: int = 1, most: int = 400_000):
        self.encode, self.most = encode, most
        self.none = np.zeros((0, width) if width > 1 else 0, np.int32)
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.bounds = self.none, np.zeros(1, np.int64)

    def look_up(self, words: pa.Array) -> np.ndarray:
        """For each word its entry in (flat, bounds)."""
        if not len(words):
            return np.zeros(0, np.int64)
        if len(self.known) > self.most:
            self._clear()
        coded = words.dictionary_encode()
        own = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        # A piece costs what its own words do, however many the table holds.
        place = np.fromiter(map(self.known.get, own, repeat(-1)), np.int64, len(own))
        new = [own[k] for k in np.flatnonzero(place < 0)]
        if new:
            flat, bounds = self.encode(new)
            at = range(len(self.known), len(self.known) + len(new))
            place[place < 0] = at
            self.known.update(zip(new, at, strict=True))
            self.bounds = np.concatenate((self.bounds, bounds[1:] + self.bounds[-1]))
            self.flat = np.concatenate((self.flat, flat))
        return place[coded.indices.to_numpy()]

    def ids(self, pretokens: Pretokens) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids of the piece, row bounds)."""
        which = self.look_up(pretokens.words())
        flat, bounds = gather(self.flat, self.bounds, which) if len(which) else (self.none, np.zeros(1, np.int64))
        return flat, bounds[pretokens.bounds]


def library(tokenizer_json: str):
    """The public library's tokenizer without truncation and padding, on one thread."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_str(tokenizer_json)
    made.no_truncation()
    made.no_padding()
    return made


#: What the two public files say of normalising and cutting; `Pretokens` does
#: the cutting, with and without attached spaces.
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
KNOWN = {
    True: (None, _BYTE_LEVEL, None),
    False: (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}, _BYTE_LEVEL | {"use_regex": False}]},
        "</w>",
    ),
}


def check_known(tokenizer_json: str, attached: bool) -> None:
    """ValueError for a tokenizer file that normalises, cuts or merges in another way than is
    built in here: its ids would be wrong."""
    import json

    told = json.loads(tokenizer_json)
    model = told.get("model") or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
    odd = any(t.get(k) for t in told.get("added_tokens") or () for k in ("single_word", "lstrip", "rstrip", "normalized"))
    if (told.get("normalizer"), told.get("pre_tokenizer"), model.get("end_of_word_suffix")) != KNOWN[attached] or not plain or odd or told.get("post_processor"):
        raise ValueError("this tokenizer file normalises, cuts or merges in a way that is not built in")


def special_strings(tokenizer_json: str) -> tuple[str, ...]:
    """Strings that the library takes out of a text before anything else."""
    import json

    return tuple(x["content"] for x in json.loads(tokenizer_json).get("added_tokens") or ())


class ByteTokenizer:
    """A byte-level BPE file of the tokenizers library over batches of texts.

    Rows that hold a special token's string go through the library whole.
    """

    def __init__(self, tokenizer_json: str):
        from tokenizers.pre_tokenizers import ByteLevel

        check_known(tokenizer_json, True)
        self.json = tokenizer_json
        # Words are cut already, so this one does not look for the pattern again.
        self.cut = library(tokenizer_json)
        self.cut.pre_tokenizer = ByteLevel(add_prefix_space=False, use_regex=False)
        self.special = special_strings(tokenizer_json)
        # A character of a byte-level token is a byte; an added one is its own text.
        known = self.cut.get_vocab(with_added_tokens=True)
        self.size = np.zeros(max(known.values(), default=-1) + 1, np.int64)
        for token, k in known.items():
            self.size[k] = len(token.encode()) if token in self.special else len(token)
        self.table = WordTable(self._encode)

    @cached_property
    def made(self):
        return library(self.json)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # One encoding of all words, without offsets: the bytes of the
        # tokens tell where a word ends, as long as they are all of its bytes.
        (got,) = self.cut.encode_batch_fast([words], is_pretokenized=True, add_special_tokens=False)
        ids = np.array(got.ids, np.int32)
        ends = np.concatenate(([0], np.cumsum(self.size[ids])))
        heads = np.cumsum([0, *map(len, map(str.encode, words))])
        if ends[-1] == heads[-1]:
            return ids, np.searchsorted(ends, heads)
        # A file without some bytes drops them; each token names its word.
        (got,) = self.cut.encode_batch([words], is_pretokenized=True, add_special_tokens=False)
        return np.array(got.ids, np.int32), np.searchsorted(np.array(got.word_ids, np.int64), np.arange(len(words) + 1))

    def ids(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, row bounds) of a piece."""
        flat, bounds = self.table.ids(Pretokens(texts, attached=True))
        rows = rows_with(texts, self.special)
        if not rows:
            return flat, bounds
        own = [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        for r in rows:
            own[r] = np.array(self.made.encode(texts.row(r).decode(), add_special_tokens=False).ids, np.int32)
        return np.concatenate(own), np.concatenate(([0], np.cumsum([len(x) for x in own])))


@lru_cache(maxsize=2)
def byte_tokenizer(tokenizer_json: str) -> ByteTokenizer:
    """One tokenizer for all tasks of a worker process, so its word table is kept."""
    return ByteTokenizer(tokenizer_json)


def rows_with(texts: Texts, strings: tuple[str, ...]) -> list[int]:
    """Rows that hold one of `strings`."""
    raw = texts.data.tobytes()
    if not any(s.encode() in raw for s in strings):
        return []
    return [r for r in range(texts.rows) if any(s.encode() in texts.row(r) for s in strings)]


def tokenizer_text(path: str | None, default: str) -> str:
    """The JSON of a tokenizer file, by default one of the public package's."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(default)
    with open(path, encoding="utf-8") as f:
        return f.read()
