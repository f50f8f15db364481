"""Quality classifier: a byte-level convolutional network in NumPy.

FILTERS learned filters of WIDTH bytes run over every position of the whole text, a rectified response each. Positions
fall into half-chunks of HALF bytes, and two neighbouring halves make a chunk, so chunks overlap by half and cover the
document. Each chunk keeps every filter's largest response; the document keeps their mean, largest and least over its
chunks, and a logistic layer turns these into one probability.

Filters are trained by back-propagation through the max-pooling on chunks of a bounded, class-balanced sample of labelled
documents (at most PER_CLASS a class). The chunks of each whole text are dealt over the epochs in random order, so all of it is
seen; a text of few chunks is seen several times, cut at other places after the first. A document counts the same whatever its
length. The logistic layer is trained on the whole sampled documents and calibrated on a fifth of them. Scoring
always reads whole documents.

Cases: a null or empty text is one chunk of padding. Repeated rows each get their own result. Without labels of both
classes, the score is the one class's share (1 if there is none). Null labels and extra columns are ignored; empty tables
give empty results. A null doc_id is not held out, and never learned from. A score of exactly THRESHOLD is predicted 1.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillmark.llm import vec
from quillmark.llm.common import PER_CLASS, arrow_map, fold, labelled
from quillmark.llm.linear import Adam, class_weights, platt, sigmoid

FILTERS = 16
WIDTH = 8
HALF = 128
#: Chunks that a text gives to an epoch at least, if it has them.
CHUNKS = 2
THRESHOLD = 0.5
#: Bytes that are scored at once.
BLOCK = 200_000


def _respond(data: np.ndarray, table: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Filter responses at each position; table[k, byte] is what a byte at offset k adds to the filters."""
    m = len(data) - WIDTH + 1
    out = table[0][data[:m]]
    for k in range(1, WIDTH):
        out += table[k][data[k : k + m]]
    out += bias
    return np.maximum(out, 0, out=out)


def pooled(raw: np.ndarray, offs: np.ndarray, table: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """By document: mean, maximum and minimum over its chunks of the filters' largest responses."""
    n, size = len(offs) - 1, np.diff(offs)
    data = np.zeros(len(raw) + n * WIDTH + WIDTH, np.uint8)  # zeros keep a document's windows from the next one's bytes
    data[np.arange(len(raw)) + np.repeat(np.arange(n), size) * WIDTH] = raw
    halves = np.maximum(1, -(-size // HALF))
    first = np.concatenate([[0], np.cumsum(halves)])
    doc = np.repeat(np.arange(n), halves)
    start = offs[:-1][doc] + doc * WIDTH + (np.arange(first[-1]) - first[doc]) * HALF
    end = np.minimum(start + HALF, (offs[:-1] + np.maximum(1, size))[doc] + doc * WIDTH)
    act = _respond(data, table, bias)
    top = np.maximum.reduceat(act, np.stack([start, end], 1).ravel(), axis=0)[::2]
    # a chunk is a half and the next one; a document's last half is a chunk of its own only where it is the only one
    chunk = top.copy()
    inner = np.flatnonzero(doc[:-1] == doc[1:])
    chunk[inner] = np.maximum(top[inner], top[inner + 1])
    keep = np.ones(len(doc), bool)
    keep[(first[1:] - 1)[halves > 1]] = False
    chunk, count = chunk[keep], np.maximum(1, halves - 1)
    at = np.concatenate([[0], np.cumsum(count)[:-1]])
    return np.concatenate([np.add.reduceat(chunk, at, axis=0) / count[:, None], np.maximum.reduceat(chunk, at, axis=0), np.minimum.reduceat(chunk, at, axis=0)], 1)


class ByteNetwork:
    def __init__(self, table=None, bias=None, mean=None, scale=None, w=None, b: float = 0.0, slope: float = 1.0, shift: float = 0.0, constant: float | None = None):
        self.table, self.bias, self.mean, self.scale, self.w, self.b, self.slope, self.shift, self.constant = table, bias, mean, scale, w, b, slope, shift, constant

    @classmethod
    def fit_texts(cls, texts: list[bytes], y: np.ndarray, counts: dict, epochs: int = 10) -> ByteNetwork:
        if len(set(y.tolist())) < 2:
            return cls(constant=counts.get(1, 0) / max(1, sum(counts.values())) if counts else 1.0)
        rng, size = np.random.default_rng(5), 2 * HALF
        seen = np.arange(len(texts)) % 5 != 0
        weights = class_weights(y)
        drawn = [i for i in range(len(texts)) if seen[i]]
        chunks = np.array([max(1, -(-len(texts[i]) // size)) for i in drawn])
        each = np.maximum(np.minimum(CHUNKS, chunks), -(-chunks // epochs))  # of a document in an epoch
        doc = np.repeat(np.arange(len(drawn)), each)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)
        orders = [rng.permutation(c) for c in chunks]
        yy, ww = y[drawn][doc], (weights[drawn] / each)[doc]
        ww = ww / ww.mean()
        table, bias = rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32), np.full(FILTERS, -0.2, np.float32)
        out, b, adam = rng.normal(0, 0.3, FILTERS), np.zeros(1), Adam(0.02)
        for epoch in range(epochs):
            turn = epoch * each[doc] + nth
            start = np.array([orders[d][k % chunks[d]] for d, k in zip(doc.tolist(), turn.tolist(), strict=True)]) * size
            start += np.where(turn >= chunks[doc], rng.integers(-HALF, HALF, len(doc)), 0)
            x = bytearray()
            for d, a in zip(doc.tolist(), start.tolist(), strict=True):
                t = texts[drawn[d]]
                a = max(0, min(a, len(t) - size))
                x += t[a : a + size].ljust(size + WIDTH - 1, b"\0")
            x = np.frombuffer(bytes(x), np.uint8).reshape(len(doc), -1)
            for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // 128)):
                xb = x[at]
                act = table[0][xb[:, :size]]
                for k in range(1, WIDTH):
                    act += table[k][xb[:, k : k + size]]
                act += bias
                where = act.argmax(1)
                top = np.maximum(np.take_along_axis(act, where[:, None], 1)[:, 0], 0)
                g = ww[at] * (sigmoid(top @ out + b[0]) - yy[at]) / len(at)
                gf = (g[:, None] * out) * (top > 0)
                gt = np.zeros_like(table)
                for k in range(WIDTH):
                    np.add.at(gt[k], (xb[np.arange(len(at))[:, None], where + k], np.arange(FILTERS)), gf)
                adam.step(table=(table, gt + 1e-6 * table), bias=(bias, gf.sum(0).astype(np.float32)), out=(out, top.T @ g + 1e-4 * out), b=(b, np.array([g.sum()])))
        m = cls(table, bias)
        feats = m.features(pa.array(texts, pa.binary()).cast(pa.string(), safe=False))
        m.mean, m.scale = feats[seen].mean(0), feats[seen].std(0) + 1e-3
        f, w, b, adam = (feats - m.mean) / m.scale, np.zeros(feats.shape[1]), np.zeros(1), Adam(0.05)
        cw = weights[seen] / weights[seen].sum()
        for _ in range(200):
            g = cw * (sigmoid(f[seen] @ w + b[0]) - y[seen])
            adam.step(w=(w, f[seen].T @ g + 1e-3 * w), b=(b, np.array([g.sum()])))
        m.w, m.b = w, float(b[0])
        m.slope, m.shift = platt((f @ w + b[0])[~seen], y[~seen], class_weights(y[~seen], counts))
        return m

    @classmethod
    def fit(cls, documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> ByteNetwork:
        """Learn from labels outside the held-out fold (crc32 of the id mod 3 = 1)."""
        sample, counts = labelled(documents, labels, "quality", fold("doc_id", 3, 1), per_class)
        rows = sorted(sample.collect())
        return cls.fit_texts([r.text.encode("utf-8", "replace") for r in rows], np.array([r.label for r in rows], float), counts)

    def features(self, column) -> np.ndarray:
        return np.concatenate([np.zeros((0, 3 * FILTERS), np.float32), *(pooled(ch.c, ch.offs, self.table, self.bias) for ch in vec.byte_chunks(column, BLOCK))])

    def score(self, column) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(column), self.constant)
        z = ((self.features(column) - self.mean) / self.scale) @ self.w + self.b
        return sigmoid(self.slope * z + self.shift)

    def transform(self, documents: DataFrame) -> DataFrame:
        """(doc_id, score) for each document."""

        def each(b: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(self.score(b.column(1)).astype(float))], names=["doc_id", "score"])

        return arrow_map(documents.select("doc_id", "text"), each, "doc_id long, score double")
