"""Quality probability by a byte-level convolutional network in numpy.

A document is cut into chunks of CHUNK bytes that overlap by WIDTH - 1, so that every window of WIDTH bytes lies in a chunk and
the whole text is covered. Each of FILTERS learned filters sums one weight per (place, byte) over a window; a chunk keeps its
maximum (max pooling, then a tanh). The chunks' pooled values are combined as their mean and their maximum, with the
logarithm of the length, by a logistic layer into one probability. Filters and layer are trained together by Adam; the
gradient reaches the windows that won the pooling.

Training takes at most TRAIN_ROWS labelled rows of each label, chosen by hash among those with crc32(doc_id as text) mod
5 != 0; training and scoring read all chunks of a text. Of several texts under one chosen id the longest is learned from. Nulls: a null text is an empty one; an
empty text is scored by the bias and length alone; null labels or ids are never learned from. Repeated rows are scored
alike; an id with several labels is learned with each. Without both labels all scores are 0.5. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.langid import held_out
from tidewire.llm.words import text_blocks, text_buffer

WIDTH = 6
FILTERS = 16
CHUNK = 512
FOLDS, HELD_OUT = 5, 0
TRAIN_ROWS = 1200
EPOCHS = 20
BATCH = 64
CUT = 0.3
SEED = 11


def chunk_bounds(n: int) -> np.ndarray:
    """(start, end) of the chunks of a text of n bytes; windows of WIDTH bytes never fall between chunks."""
    if n < WIDTH:
        return np.zeros((0, 2), np.int64)
    starts = np.arange(0, max(1, n - WIDTH + 1), CHUNK - WIDTH + 1)
    return np.stack([starts, np.minimum(starts + CHUNK, n)], axis=1)


class Network:
    def __init__(self):
        rng = np.random.default_rng(SEED)
        self.filters = rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.shift = np.zeros(FILTERS, np.float32)
        self.layer = rng.normal(0, 0.1, 2 * FILTERS + 1).astype(np.float32)
        self.bias = np.float32(0)

    def responses(self, raw: np.ndarray) -> np.ndarray:
        """Filter sums at each window of a run of bytes."""
        n = len(raw) - WIDTH + 1
        out = self.filters[0][raw[:n]]
        for j in range(1, WIDTH):
            out += self.filters[j][raw[j : j + n]]
        return out

    def scores(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each text; one pass over all bytes, at most a megabyte at a time."""
        sizes = np.diff(offsets)
        count = np.array([len(chunk_bounds(n)) for n in sizes.tolist()], np.int64)
        sums = np.zeros((len(sizes), FILTERS))
        tops = np.full((len(sizes), FILTERS), -1.0)
        for i in np.flatnonzero(count):
            for lo in range(0, int(count[i]), 512):
                bounds = chunk_bounds(int(sizes[i]))[lo : lo + 512] + offsets[i]
                found = self.responses(raw[bounds[0, 0] : bounds[-1, 1]])
                # a chunk's windows are CHUNK - WIDTH + 1 in a row, the next chunk's follow
                pooled = np.maximum.reduceat(found, bounds[:, 0] - bounds[0, 0], axis=0)
                value = np.tanh(pooled + self.shift)
                sums[i] += value.sum(axis=0)
                tops[i] = np.maximum(tops[i], value.max(axis=0))
        mean = sums / np.maximum(count, 1)[:, None]
        tops[count == 0] = 0
        return self._probability(np.concatenate([mean, tops, _length(sizes)[:, None]], axis=1))

    def _probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.layer.astype(np.float64) + float(self.bias), -30, 30)))


def _length(sizes) -> np.ndarray:
    return np.log1p(np.asarray(sizes, np.float64)) / 10


def train(texts: list[list[bytes]], lengths: list[int], labels: np.ndarray, share: float = 0.5) -> Network:
    """Adam on the logistic loss, rows of both labels weighted alike; deterministic. texts: chunks of each text.

    share: of label 1 among all labelled rows that may be learned from; it sets the bias in the end.
    """
    net, rng = Network(), np.random.default_rng(SEED)
    if not len(labels) or labels.min() == labels.max():
        net.layer[:] = 0
        return net
    raws = [[np.frombuffer(c, np.uint8) for c in chunks] for chunks in texts]
    size = _length(lengths).astype(np.float32)
    weight = np.where(labels == 1, 0.5 / (labels == 1).mean(), 0.5 / (labels == 0).mean())
    params = [net.filters, net.shift, net.layer]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    bias_moments, step = [0.0, 0.0], 0
    for epoch in range(EPOCHS):
        rate = 0.02 * (1 - epoch / EPOCHS) + 0.001
        order = rng.permutation(len(labels))
        for lo in range(0, len(order), BATCH):
            rows = order[lo : lo + BATCH]
            chunks = [(i, c) for i, r in enumerate(rows) for c in raws[r]]
            x = np.zeros((len(rows), 2 * FILTERS + 1), np.float32)
            x[:, -1] = size[rows]
            if chunks:
                owner = np.array([i for i, _ in chunks])
                joined = np.concatenate([c for _, c in chunks])
                begin = np.cumsum([0] + [len(c) for _, c in chunks])
                found = net.responses(joined)
                winners = np.stack(
                    [a + found[a : b - WIDTH + 1].argmax(axis=0) for a, b in zip(begin[:-1], begin[1:], strict=True)]
                )
                value = np.tanh(found[winners, np.arange(FILTERS)] + net.shift)
                number = np.bincount(owner, minlength=len(rows))
                np.add.at(x[:, :FILTERS], owner, value / number[owner][:, None])
                tops = np.full((len(rows), FILTERS), -2, np.float32)
                np.maximum.at(tops, owner, value)
                x[:, FILTERS:-1] = np.where(number[:, None] > 0, tops, 0)
            error = (net._probability(x) - labels[rows]) * weight[rows] / len(rows)
            error = error.astype(np.float32)
            grads = [np.zeros_like(net.filters), np.zeros_like(net.shift), x.T @ error + 1e-4 * net.layer]
            if chunks:
                back = error[owner][:, None] * net.layer[None, :FILTERS] / number[owner][:, None]
                back = back + error[owner][:, None] * net.layer[None, FILTERS:-1] * (value == tops[owner])
                back *= 1 - value**2
                grads[1] = back.sum(axis=0)
                for j in range(WIDTH):
                    np.add.at(grads[0][j], (joined[winners + j], np.arange(FILTERS)[None, :]), back)
            step += 1
            for p, g, (m, v) in zip(params, grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            g = float(error.sum())
            bias_moments = [0.9 * bias_moments[0] + 0.1 * g, 0.999 * bias_moments[1] + 0.001 * g * g]
            net.bias -= np.float32(
                rate * (bias_moments[0] / (1 - 0.9**step)) / (np.sqrt(bias_moments[1] / (1 - 0.999**step)) + 1e-8)
            )
    net.bias += np.float32(np.log(share / (1 - share)))
    return net


def training_rows(docs: DataFrame, labels: DataFrame) -> tuple[list[list[bytes]], list[int], np.ndarray, float]:
    """Chunks, byte length and label of at most TRAIN_ROWS rows of each label outside the held-out fold; the share of label 1."""
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("_label"))
    known = known.filter(F.col("_label").isin(0, 1) & F.col("_id").isNotNull() & ~held_out(F.col("_id"), FOLDS, HELD_OUT))
    tally = {r[0]: r[1] for r in known.groupBy("_label").count().collect()}
    share = (tally.get(1, 0) + 1) / (sum(tally.values()) + 2)
    chosen = None
    for label in (0, 1):
        own = known.filter(F.col("_label") == label).distinct().orderBy(F.xxhash64("_id"), "_id").limit(TRAIN_ROWS)
        chosen = own if chosen is None else chosen.unionByName(own)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # the chosen ids are bound by 2 x TRAIN_ROWS
    found = rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "_label", "text")
    table = found.mapInArrow(_training_chunks, "doc_id long, label int, size long, chunks array<binary>")
    table = table.groupBy("doc_id", "label").agg(F.max(F.struct("size", "chunks")).alias("t")).select("doc_id", "label", "t.*").toArrow()
    found = sorted(zip(*(c.to_pylist() for c in table.columns), strict=True))
    return [f[3] for f in found], [f[2] for f in found], np.array([f[1] for f in found]), share


def training_chunks(raw: np.ndarray) -> list[bytes]:
    return [raw[a:b].tobytes() for a, b in chunk_bounds(len(raw))]


def _training_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = text_buffer(batch.column(2))
        chunks = [training_chunks(raw[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(np.diff(offsets)), pa.array(chunks, pa.list_(pa.binary()))],
            ["doc_id", "label", "size", "chunks"],
        )


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            for lo, hi, raw, offsets in text_blocks(batch.column(2)):
                score = net.scores(raw, offsets)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        batch.column(1).slice(lo, hi - lo),
                        pa.array(score),
                        pa.array((score >= CUT).astype(np.int32)),
                    ],
                    ["doc_id", "held_out", "score", "predicted"],
                )

    return run


def scored(docs: DataFrame, labels: DataFrame, net: Network | None = None) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, held_out, score, predicted (score >= CUT). labels(doc_id, quality)."""
    net = net or train(*training_rows(docs, labels))
    shared = docs.sparkSession.sparkContext.broadcast(net)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"),
        F.col("text").cast("string").alias("text"),
    )
    return rows.mapInArrow(_scored(shared), "doc_id long, held_out boolean, score double, predicted int")
