"""Quality classifier: a byte-level convolutional network in numpy.

A text is its UTF-8 bytes.  Learned filters slide over every byte; their
responses are max-pooled over overlapping chunks that together cover the whole
text, the chunk vectors are averaged and a logistic unit turns the average into
one probability.  Executors score Arrow batches with the fitted tables; nothing
is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesplit import Texts
from .labelled import class_shares, held_out_flag, platt, training_rows
from .shared import aside, back


@dataclass(frozen=True)
class Shape:
    """A chunk is two neighbouring halves, so chunks overlap by half.

    per_class bounds what is fitted: at most per_class rows of each label.  Fitting,
    calibration and scoring cover every chunk of every text they see.
    """

    filters: int = 32
    width: int = 6
    half: int = 128
    per_class: int = 1000
    epochs: int = 12
    batch: int = 128
    rate: float = 0.02
    l2: float = 1e-5
    seed: int = 5


@dataclass
class Network:
    """filters: (width, 256, filters) responses by byte; then bias, the output
    weights and offset, and the calibration slope and offset."""

    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    offset: float
    slope: float
    shift: float
    shape: Shape


def _halves(texts: Texts, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Zero-padded bytes of all rows, whole halves each, and the row bounds in halves.

    Every row gets at least width - 1 zeros at its end, so no window reaches
    from one text into the next; an empty text is one half of zeros.
    """
    sizes = np.diff(texts.offsets)
    halves = -(-(sizes + shape.width - 1) // shape.half)
    bounds = np.concatenate(([0], np.cumsum(halves)))
    data = np.zeros(int(bounds[-1]) * shape.half + shape.width, np.uint8)
    at = np.arange(len(texts.data)) + np.repeat(bounds[:-1] * shape.half - texts.offsets[:-1], sizes)
    data[at] = texts.data
    return data, bounds


def _pairs(net: Network) -> list[np.ndarray]:
    """Response tables of two neighbouring bytes, which halve the look-ups."""
    w, f = net.filters, net.filters.shape[2]
    tables = [(w[j][:, None, :] + w[j + 1][None, :, :]).reshape(65536, f) for j in range(0, w.shape[0], 2)]
    tables[0] = tables[0] + net.bias
    return [np.ascontiguousarray(t, dtype=np.float32) for t in tables]


def _responses(data: np.ndarray, n: int, tables: list[np.ndarray]) -> np.ndarray:
    two = (data[:-1].astype(np.int32) << 8) | data[1:]
    h = np.take(tables[0], two[:n], axis=0)
    other = np.empty_like(h)
    for k, table in enumerate(tables[1:], 1):
        np.take(table, two[2 * k : 2 * k + n], axis=0, out=other, mode="clip")
        h += other
    return h


def logits(texts: Texts, net: Network, tables: list[np.ndarray]) -> np.ndarray:
    """The uncalibrated score of every row of a piece, from all of its chunks."""
    shape = net.shape
    data, bounds = _halves(texts, shape)
    n = int(bounds[-1])
    top = np.empty((n, shape.filters), np.float32)
    step = max(1, 65536 // shape.half)
    last = bounds[1:] - 1
    for k in range(0, n, step):
        m = min(step, n - k)
        h = _responses(data[k * shape.half : (k + m) * shape.half + shape.width], m * shape.half, tables).reshape(m, shape.half, -1)
        # The windows that would leave a row, at the end of its last half, count as silent.
        ends = last[np.searchsorted(last, k) : np.searchsorted(last, k + m)] - k
        h[ends, shape.half - shape.width + 1 :] = 0
        h.max(axis=1, out=top[k : k + m])
    np.maximum(top, 0, out=top)
    chunk = np.maximum(top[:-1], top[1:]) if n > 1 else top[:0]
    # Chunk k joins halves k and k + 1; pairs across rows are dropped, a row of one half is its own chunk.
    total = np.zeros((n + 1, shape.filters))
    inner = np.ones(max(n - 1, 0), dtype=bool)
    inner[last[:-1]] = False
    np.cumsum(np.where(inner[:, None], chunk, 0), axis=0, out=total[1:n], dtype=np.float64) if n > 1 else None
    total[n] = total[n - 1]
    count = np.diff(bounds) - 1
    mean = (total[bounds[1:] - 1] - total[bounds[:-1]]) / np.maximum(count, 1)[:, None]
    lone = count == 0
    mean[lone] = top[bounds[:-1][lone]]
    return mean @ net.out + net.offset


def _chunks(texts: Texts, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """(chunks, owner): all chunks of every text, with the bytes that windows look
    ahead.  What lies behind a text is zero."""
    data, bounds = _halves(texts, shape)
    data = np.concatenate([data, np.zeros(shape.half, np.uint8)])
    count = np.maximum(np.diff(bounds) - 1, 1)
    owner = np.repeat(np.arange(texts.rows), count)
    start = (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + bounds[:-1][owner]) * shape.half
    size = 2 * shape.half + shape.width
    x = np.lib.stride_tricks.sliding_window_view(data, size)[start].copy()
    left = bounds[1:][owner] * shape.half - start
    short = np.flatnonzero(left < size)
    x[short] *= np.arange(size)[None, :] < left[short, None]
    return x, owner


def _forward(x: np.ndarray, net: Network, tables) -> tuple[np.ndarray, np.ndarray]:
    """Pooled responses of training chunks and where each filter peaked."""
    shape, n = net.shape, len(x)
    long = 2 * shape.half
    top, peak = np.empty((n, shape.filters), np.float32), np.empty((n, shape.filters), np.int64)
    for k in range(0, n, 256):
        part = x[k : k + 256]
        two = (part[:, :-1].astype(np.int32) << 8) | part[:, 1:]
        h = np.take(tables[0], two[:, :long], axis=0)
        for j, table in enumerate(tables[1:], 1):
            h += np.take(table, two[:, 2 * j : 2 * j + long], axis=0)
        peak[k : k + 256] = h.argmax(axis=1)
        top[k : k + 256] = h.max(axis=1)
    return np.maximum(top, 0), peak


def fit(documents: DataFrame, labels: DataFrame, shape: Shape = Shape()) -> Network:
    """Fit on labelled rows that are not held out; a fifth of them calibrates.

    Without rows of both labels every text gets the smoothed share of label 1.
    """
    rows = training_rows(documents, labels, "quality", shape.per_class, shape.seed)
    table = rows.select(F.col("doc_id").cast("long"), F.col("y").cast("int"), "text").toArrow().sort_by("doc_id")
    no, yes = class_shares(labels, "quality")
    y = np.asarray(table["y"].to_numpy(), dtype=np.int64)
    rng = np.random.default_rng(shape.seed)
    net = Network(
        rng.normal(0, 0.05, (shape.width, 256, shape.filters)), np.zeros(shape.filters), rng.normal(0, 0.3, shape.filters), 0.0, 0.0,
        float(np.log((yes + 1) / (no + 1))), shape,
    )
    if not (y == 1).any() or not (y == 0).any():
        return net
    texts = Texts.of(table["text"].cast(pa.large_string()))
    del table
    x, owner = _chunks(texts, shape)
    # Filters start as detectors of windows seen in the training texts, half from each label.
    for f in range(shape.filters):
        own = np.flatnonzero(y[owner] == f % 2)
        c, p = rng.choice(own), rng.integers(0, 2 * shape.half)
        for j in range(shape.width):
            net.filters[j, x[c, p + j], f] += 0.4
    fold = np.arange(len(y)) % 5 == 4
    if len(set(y[fold])) < 2 or len(set(y[~fold])) < 2:
        fold = np.zeros(len(y), dtype=bool)
    _train(net, x, owner, y, np.flatnonzero(~fold), rng)
    check = np.flatnonzero(fold if fold.any() else ~fold)
    tables = _pairs(net)
    z, own = np.concatenate([logits(part, net, tables) for _, _, part in texts.parts()])[check], y[check]
    balance = np.where(own == 1, yes / max((own == 1).sum(), 1), no / max((own == 0).sum(), 1))
    net.slope, net.shift = platt(z, own, balance / balance.mean())
    return net


def _train(net: Network, x, owner, y, use, rng) -> None:
    """Minibatch Adam; through the max only the peak position of each filter learns."""
    shape = net.shape
    first = np.searchsorted(owner, np.arange(len(y) + 1))
    params = {"filters": net.filters, "bias": net.bias, "out": net.out, "offset": np.zeros(1)}
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in params.items()}
    weight = np.where(y == 1, 0.5 / (y[use] == 1).mean(), 0.5 / (y[use] == 0).mean())
    step = 0
    for epoch in range(shape.epochs):
        rate = shape.rate * 0.5 * (1 + np.cos(np.pi * epoch / shape.epochs))
        order = rng.permutation(use)
        for k in range(0, len(order), shape.batch):
            rows = order[k : k + shape.batch]
            counts = first[rows + 1] - first[rows]
            mine = np.concatenate([np.arange(first[r], first[r + 1]) for r in rows])
            seg = np.repeat(np.arange(len(rows)), counts)
            net.offset = float(params["offset"][0])
            top, peak = _forward(x[mine], net, _pairs(net))
            starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
            mean = np.add.reduceat(top, starts, axis=0) / counts[:, None]
            z = mean @ params["out"] + params["offset"][0]
            g = weight[rows] * (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y[rows]) / len(rows)
            grad = {"out": mean.T @ g + shape.l2 * params["out"], "offset": np.array([g.sum()])}
            back = (g / counts)[seg][:, None] * params["out"][None, :] * (top > 0)
            grad["bias"] = back.sum(axis=0)
            grad["filters"] = np.empty_like(params["filters"])
            cols = np.arange(shape.filters)
            for j in range(shape.width):
                byte = x[mine[:, None], peak + j].astype(np.int64)
                grad["filters"][j] = np.bincount((byte * shape.filters + cols).ravel(), back.ravel(), 256 * shape.filters).reshape(256, -1)
            step += 1
            for name, value in params.items():
                m, v = state[name]
                m += 0.1 * (grad[name] - m)
                v += 0.001 * (grad[name] ** 2 - v)
                value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net.offset = float(params["offset"][0])


def score(documents: DataFrame, net: Network) -> DataFrame:
    """All columns of `documents` but one named score, in whatever case, plus score (double, 0 to 1).

    Null and empty texts are scored as one chunk of zeros.  A text of any length is
    scored from all of its chunks; it is then a piece of its own.  Repeated rows are
    scored one by one, alike.
    """
    frame = documents.select(*[c for c in documents.columns if c.lower() != "score"])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema) + ", score double"

    def run(batches):
        tables = _pairs(net)
        for batch in batches:
            for start, end, texts in Texts.of(batch.column("text")).parts():
                z = net.slope * logits(texts, net, tables) + net.shift
                own = batch.slice(start, end - start)
                yield pa.record_batch([*own.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -35, 35))))], names=[*own.schema.names, "score"])

    return frame.mapInArrow(run, schema)


THRESHOLD = 0.7


def query(spark, sf_dir: str) -> DataFrame:
    """op8: doc_id, held_out, score and predicted for every whole text of `documents`."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = fit(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(documents.select("doc_id", "text"), net).select(
        "doc_id", held_out_flag().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def keep(documents: DataFrame, source: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, shape: Shape = Shape()) -> DataFrame:
    """The rows of `documents` that score at least `threshold`, with all their columns as
    they were; fitted on `source` and `labels`.  A score equal to the threshold is kept;
    all copies of a row stay or none; null and empty texts are scored like others."""
    frame, own = aside(documents, ["score"])
    return back(score(frame, fit(source, labels, shape)).where(F.col("score") >= threshold), own)
