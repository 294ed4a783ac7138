"""Main text of web pages by a tree-structured graphical model.

Every block element of a page is a binary variable (main content or not) in a tree
that follows the DOM.  A node's potential comes from its tag, names and text; the
potential of a parent-child edge depends on the child's kind.  Sum-product messages
go up the tree and down again and give each node's exact marginal.  The weights are
fitted by the likelihood of labelled pages, whose gradient needs the same messages.

A page is one row and is worked on where it lies; nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_tree import Page

#: Kinds of child elements that share an edge potential.
KINDS = {
    **dict.fromkeys("p pre blockquote".split(), 0),
    **dict.fromkeys("h1 h2 h3 h4 h5 h6 hgroup".split(), 1),
    **dict.fromkeys("li dt dd tr td th tbody thead tfoot caption figcaption option".split(), 2),
    **dict.fromkeys("ul ol dl table figure menu".split(), 3),
    **dict.fromkeys("nav aside footer header form fieldset button select dialog".split(), 4),
    **dict.fromkeys("article main".split(), 5),
    **dict.fromkeys("div section center details".split(), 6),
}
OTHER = 7

_NAMED = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass(frozen=True)
class Train:
    """pages: how many labelled pages are made when none are given; also the most that
    `fit` takes of a given table."""

    pages: int = 1200
    steps: int = 160
    rate: float = 0.1
    l2: float = 0.002
    seed: int = 4


@dataclass
class TreeModel:
    """names: the weight slot of each feature.  unary: their weights for content.
    edge: log potentials [child kind, parent label, child label]."""

    names: dict[str, int]
    unary: np.ndarray
    edge: np.ndarray


def _bin(x: float, cuts: tuple) -> int:
    return sum(x > c for c in cuts)


_cache: dict[tuple[str, str], tuple[str, ...]] = {}


def _named(tag: str, attrs: str) -> tuple[str, ...]:
    """Features of a tag and the words of its class, id and role."""
    key = (tag, attrs)
    found = _cache.get(key)
    if found is None:
        words = []
        for m in _NAMED.finditer(attrs):
            words += [w.lower() for w in _WORD.findall(m[2] or m[3] or m[4] or "")]
        found = (f"t:{tag}", *dict.fromkeys(x for w in words if len(w) > 1 for x in (f"n:{w}", f"s:{w[:4]}")))
        if len(_cache) > 50_000:
            _cache.clear()
        _cache[key] = found
    return found


def features(page: Page) -> list[tuple[str, ...]]:
    """Names of what holds for each element: its tag and names, those of its parent,
    whether it is inside an article or main element, and binned measures of its own
    and its subtree's text, links and controls."""
    n = len(page.tag)
    own, ends, links, controls = [0] * n, [False] * n, list(page.linked), list(page.controls)
    for k, text in page.blocks:
        own[k] += len(text)
        ends[k] = text[-1] in ".!?"
    total, below = own.copy(), [0] * n
    for k in range(n - 1, 0, -1):
        p = page.parent[k]
        total[p] += total[k]
        links[p] += links[k]
        controls[p] += controls[k]
        below[p] += 1
    inside = [False] * n
    semantic = "article" in page.tag or "main" in page.tag
    out = []
    for k in range(n):
        p = page.parent[k]
        inside[k] = page.tag[k] in ("article", "main") or (p >= 0 and inside[p])
        dense = links[k] / max(total[k], 1)
        got = _named(page.tag[k], page.attrs[k])
        out.append((
            *got,
            f"p:{page.tag[p] if p >= 0 else ''}",
            f"a:{'in' if inside[k] else 'out' if semantic else 'none'}",
            f"o:{_bin(own[k], (0, 20, 60, 150, 400))}{ends[k]}",
            f"w:{_bin(total[k], (0, 30, 100, 300, 1000))}",
            f"r:{_bin(total[k] / max(total[0], 1), (0.02, 0.1, 0.3, 0.6))}",
            f"l:{_bin(dense, (0, 0.1, 0.3, 0.6, 0.9))}",
            f"c:{min(controls[k], 2)}{total[k] > 300}",
            f"b:{_bin(below[k], (0, 1, 3, 8))}",
            "bias",
        ))
    return out


class Forest:
    """The trees of many pages in arrays, nodes by level."""

    def __init__(self, pages: list[Page], model_names: dict[str, int], grow: bool = False):
        slots, bounds, parent, kind, level = [], [0], [], [], []
        self.first = [0]
        for page in pages:
            base = len(parent)
            for found in features(page):
                if grow:
                    slots += [model_names.setdefault(x, len(model_names)) for x in found]
                else:
                    slots += [s for x in found if (s := model_names.get(x)) is not None]
                bounds.append(len(slots))
            parent += [p + base if p >= 0 else -1 for p in page.parent]
            kind += [KINDS.get(t, OTHER) for t in page.tag]
            level += page.level
            self.first.append(len(parent))
        self.slots, self.bounds = np.array(slots, np.int64), np.array(bounds, np.int64)
        self.parent, self.kind = np.array(parent, np.int64), np.array(kind, np.int64)
        order = np.argsort(np.array(level, np.int64), kind="stable")
        cuts = np.cumsum(np.bincount(np.array(level, np.int64))) if level else []
        self.levels = np.split(order, cuts[:-1]) if level else []

    def messages(self, unary: np.ndarray, edge: np.ndarray):
        """(up, sent, down): beliefs from below with the node's own potential, the message
        each node sent to its parent, and the message it got from there; all as logs."""
        n = len(self.parent)
        total = np.concatenate(([0.0], np.cumsum(unary[self.slots])))
        up = np.zeros((n, 2))
        up[:, 1] = total[self.bounds[1:]] - total[self.bounds[:-1]]
        sent, down = np.zeros((n, 2)), np.zeros((n, 2))
        for at in reversed(self.levels[1:]):
            both = edge[self.kind[at]] + up[at][:, None, :]
            sent[at] = np.logaddexp(both[:, :, 0], both[:, :, 1])
            np.add.at(up, self.parent[at], sent[at])
        for at in self.levels[1:]:
            p = self.parent[at]
            rest = up[p] + down[p] - sent[at]
            both = edge[self.kind[at]] + rest[:, :, None]
            down[at] = np.logaddexp(both[:, 0, :], both[:, 1, :])
            down[at] -= down[at].max(axis=1, keepdims=True)
        return up, sent, down

    def marginals(self, unary: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """Probability that each node is content."""
        up, _, down = self.messages(unary, edge)
        z = up + down
        return 1 / (1 + np.exp(np.clip(z[:, 0] - z[:, 1], -50, 50)))


def node_labels(page: Page, text: str) -> np.ndarray:
    """Content or not, for each element: whether most of its own text (of its subtree's,
    if it has none) is in the blocks of the known main text, taken in order."""
    wanted = [x for x in (" ".join(line.split()) for line in text.split("\n")) if x]
    good, total = np.zeros(len(page.tag)), np.zeros(len(page.tag))
    mine = np.zeros(len(page.tag), bool)
    labels = np.zeros(len(page.tag), np.int64)
    at = 0
    for k, block in page.blocks:
        hit = at < len(wanted) and block == wanted[at]
        at += hit
        good[k] += hit * len(block)
        total[k] += len(block)
        mine[k] = True
    own = good * 2 > total
    for k in range(len(page.tag) - 1, 0, -1):
        good[page.parent[k]] += good[k]
        total[page.parent[k]] += total[k]
    labels[:] = np.where(mine, own, good * 2 > total)
    return labels


def fit(labelled: Iterable[tuple[str, str]] | DataFrame | None = None, train: Train = Train()) -> TreeModel:
    """Fits on (html, text) pairs: given, train.pages rows of a DataFrame (those of
    the smallest hash, so reruns agree), or made by `labelled_pages`.  At most train.pages pages reach the driver."""
    if labelled is None:
        from .labelled_pages import made

        labelled = made(train.pages, train.seed)
    elif isinstance(labelled, DataFrame):
        labelled = [(r["html"] or "", r["text"] or "") for r in labelled.select("html", "text").orderBy(F.xxhash64("html", "text"), "html", "text").limit(train.pages).collect()]
    pairs = list(labelled)[: train.pages]
    pages = [Page(source) for source, _ in pairs]
    names: dict[str, int] = {}
    forest = Forest(pages, names, grow=True)
    y = np.concatenate([node_labels(p, t) for p, (_, t) in zip(pages, pairs, strict=True)]) if pages else np.zeros(0, np.int64)
    unary, edge = np.zeros(len(names)), np.zeros((OTHER + 1, 2, 2))
    edge[:, 0, 0] = edge[:, 1, 1] = 0.5
    inner = np.flatnonzero(forest.parent >= 0)
    seen = np.zeros_like(edge)
    np.add.at(seen, (forest.kind[inner], y[forest.parent[inner]], y[inner]), 1)
    owner = np.repeat(np.arange(len(y)), np.diff(forest.bounds))
    states = [np.zeros_like(unary), np.zeros_like(unary), np.zeros_like(edge), np.zeros_like(edge)]
    size = max(len(pages), 1)
    for step in range(1, train.steps + 1):
        up, sent, down = forest.messages(unary, edge)
        z = up + down
        prob = 1 / (1 + np.exp(np.clip(z[:, 0] - z[:, 1], -50, 50)))
        slope = np.bincount(forest.slots, (prob - y)[owner], len(unary)) / size + train.l2 * unary
        p = forest.parent[inner]
        pair = (up[p] + down[p] - sent[inner])[:, :, None] + edge[forest.kind[inner]] + up[inner][:, None, :]
        pair = np.exp(pair - pair.max(axis=(1, 2), keepdims=True))
        pair /= pair.sum(axis=(1, 2), keepdims=True)
        bend = -seen
        np.add.at(bend, forest.kind[inner], pair)
        bend = bend / size + train.l2 * edge
        for value, grad, m, v in ((unary, slope, states[0], states[1]), (edge, bend, states[2], states[3])):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            value -= train.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return TreeModel(names, unary, edge)


def main_texts(sources: list[str], model: TreeModel) -> list[str]:
    """The content blocks of each page, joined by newlines."""
    pages = [Page(s) for s in sources]
    forest = Forest(pages, model.names)
    good = forest.marginals(model.unary, model.edge) >= 0.5
    return ["\n".join(t for k, t in page.blocks if good[base + k]) for page, base in zip(pages, forest.first, strict=False)]


def _pieces(column: pa.Array, most: int = 1 << 21) -> Iterator[tuple[int, int, list[str]]]:
    """Rows of about `most` characters together (or one longer row); null is empty."""
    start, held, size = 0, [], 0
    for k, value in enumerate(column):
        text = value.as_py() or ""
        held.append(text)
        size += len(text)
        if size >= most:
            yield start, k + 1, held
            start, held, size = k + 1, [], 0
    if held:
        yield start, start + len(held), held


def extract(pages: DataFrame, model: TreeModel, column: str = "html") -> DataFrame:
    """The columns of `pages` but `column`, text and n_chars, plus text (string, empty if
    there is no main text) and n_chars (long, its code points).

    Null and empty pages give empty texts.  Rows are kept one for one, repeated ones alike;
    a page of any length is worked through whole, in time that follows its length; an
    element at exactly one half is content.  Columns named text or n_chars, in whatever case, are replaced.
    """
    rest = [c for c in pages.columns if c.lower() not in (column.lower(), "text", "n_chars")]
    frame = pages.select(*rest, column)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema if f.name != column), "text string, n_chars long"])

    def run(batches):
        for batch in batches:
            for start, end, sources in _pieces(batch.column(column)):
                texts = main_texts(sources, model)
                own = batch.slice(start, end - start)
                yield pa.record_batch([*(own.column(c) for c in rest), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*rest, "text", "n_chars"])

    return frame.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op5: the main text of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages.select("page_id", "url", "html"), fit())
