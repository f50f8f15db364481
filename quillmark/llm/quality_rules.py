"""Quality rules: exact base counts, and a calibrated logistic regression over hashed word and character n-grams.

Base rules count over whole texts (see `base_counts`). The model's features are the relative frequencies of word 1- and
2-grams and character 3- and 5-grams, hashed to 2**18 columns. It is fitted with Adam on a class-balanced sample of
labelled documents (1,000 rows a class at most), and Platt's calibration on a fifth of that sample, weighted to the
classes' true shares, turns its score into the probability of quality 1. A document is kept if no base rule fails and
that probability is REJECT_BELOW or more.

Cases: a null or empty text, or one without words, has no words, so a base rule fails it. A null doc_id is passed
through. Repeated rows each get their own result. Without labels of both classes, the model's verdict is True for all.
A probability of exactly REJECT_BELOW is kept. Extra columns are ignored by `transform` and carried by `filter`. Empty tables give
empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillmark.llm import vec
from quillmark.llm.common import arrow_filter, arrow_map, labelled, tidy
from quillmark.llm.linear import Rows, class_weights, fit, platt, sigmoid

BITS = 18
SCALE = 30.0
#: Fixed thresholds.
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
REJECT_BELOW = 0.4
SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)


def base_counts(c: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """By document: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; and the words for later use."""
    n = len(offs) - 1
    starts, ends, doc = vec.words(c, offs)
    n_words = np.bincount(doc, minlength=n)
    word_chars = vec.per_doc(ends - starts, doc, n).astype(np.int64)
    hasher = vec.Hasher(c)
    h = hasher(starts, ends)
    symbol = np.isin(c, SYMBOLS)
    n_symbols = vec.spans(symbol, offs[:-1], offs[1:]).astype(np.int64)
    # lines: the bounds are line feeds and the documents' own bounds
    feeds = np.flatnonzero(c == 10)
    of = np.searchsorted(offs, feeds, "right") - 1
    l_start = np.concatenate([offs[:-1], feeds + 1])
    l_doc = np.concatenate([np.arange(n), of])
    order = np.lexsort((l_start, l_doc))
    l_start, l_doc = l_start[order], l_doc[order]
    last = np.ones(len(l_doc), bool)
    last[:-1] = l_doc[1:] != l_doc[:-1]
    l_end = np.where(last, offs[l_doc + 1], np.concatenate([l_start[1:] - 1, [0]]))
    has_word = np.searchsorted(starts, l_end) > np.searchsorted(starts, l_start)
    l_start, l_end, l_doc = l_start[has_word], l_end[has_word], l_doc[has_word]
    n_dup = np.bincount(l_doc[_repeats(hasher(l_start, l_end), l_doc)[0]], minlength=n)
    # words in 5-word windows that occur twice or more
    w, first = vec.windows(h, doc, 5)
    again = first[_repeats(w, doc[first])[1]]
    covered = np.zeros(len(h) + 5, np.int32)
    np.add.at(covered, again, 1)
    np.add.at(covered, again + 5, -1)
    n_repeat = np.bincount(doc[np.cumsum(covered)[: len(h)] > 0], minlength=n)
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup, "n_repeat_words": n_repeat, "_h": h, "_doc": doc}


def _repeats(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which items equal an earlier one of their document, and which equal any other one."""
    key = vec.mix(h + vec.mix(doc + 1))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    later, any_ = np.zeros(len(h), bool), np.zeros(len(h), bool)
    later[order[1:][same]] = True
    any_[order[1:][same]] = True
    any_[order[:-1][same]] = True
    return later, any_


def base_failed(n_words: np.ndarray, n_repeat: np.ndarray) -> np.ndarray:
    return (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words)


def _grams(c: np.ndarray, offs: np.ndarray, h: np.ndarray, doc: np.ndarray):
    """Groups of n-grams: column of each, and by document the first one and the one after the last."""
    ids, shift = np.arange(len(offs) - 1), vec.U(64 - BITS)
    for k, (x, d) in enumerate(((h, doc), (lambda w: (w[0], doc[w[1]]))(vec.windows(h, doc, 2)))):
        yield ((x * vec.U(2 * k + 0x9FB21C651E98DF25)) >> shift).astype(np.int32), np.searchsorted(d, ids), np.searchsorted(d, ids, "right")
    for n in (3, 5):
        m = max(0, len(c) - n + 1)
        x = np.full(m, 0x27D4EB2F * n & 0xFFFFFFFF, np.uint32)
        for k in range(n):
            x = (x ^ c[k : k + m]) * np.uint32(0x85EBCA6B)
            x ^= x >> np.uint32(15)
        yield ((x * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS)).astype(np.int32), offs[:-1], np.maximum(offs[:-1], offs[1:] - n + 1)


def _sparse(c, offs) -> list[tuple[np.ndarray, np.ndarray]]:
    counts = base_counts(c, offs)
    groups = list(_grams(c, offs, counts["_h"], counts["_doc"]))
    out = []
    for d in range(len(offs) - 1):
        col = np.concatenate([x[lo[d] : hi[d]] for x, lo, hi in groups])
        val = np.concatenate([np.full(hi[d] - lo[d], SCALE / max(1, hi[d] - lo[d])) for _, lo, hi in groups])
        u, inv = np.unique(col, return_inverse=True)
        out.append((u.astype(np.int32), np.bincount(inv, weights=val, minlength=len(u)).astype(np.float32)))
    return out


#: What the model learns from: by sampled document its label, and its features' columns and values.
FEATURES = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("col", pa.binary()), ("val", pa.binary())])


def _learned(rows: pa.Table, counts: dict) -> tuple[np.ndarray, float, float, float] | None:
    """Weights, intercept, slope and shift; None without rows of both classes. One task learns them from the bounded sample, so
    that the driver gets nothing but the model."""
    order = np.argsort(rows["doc_id"].to_numpy(), kind="stable")
    y = rows["label"].to_numpy().astype(float)[order]
    if len(np.unique(y)) < 2:
        return None
    seen = np.arange(len(order)) % 5 != 0

    def part(at: np.ndarray) -> Rows:
        cells = lambda name, kind: [np.frombuffer(rows[name][i].as_buffer(), kind) for i in order[at].tolist()]
        return Rows(cells("col", np.int32), cells("val", np.float32))

    x, rest = part(seen), part(~seen)
    w, b = fit(x, y[seen], class_weights(y[seen]), 1 << BITS)
    return w, b, *platt(rest.dot(w) + b, y[~seen], class_weights(y[~seen], counts))


class QualityRules:
    """The fitted model: weights, intercept, and the calibration's slope and shift. model None: no verdict."""

    def __init__(self, w: np.ndarray | None = None, b: float = 0.0, slope: float = 1.0, shift: float = 0.0):
        self.w, self.b, self.slope, self.shift = w, b, slope, shift

    @classmethod
    def fit(cls, documents: DataFrame, labels: DataFrame, per_class: int = 1000) -> QualityRules:
        sample, counts = labelled(documents, labels, "quality", None, per_class)
        if not (counts.get(0) and counts.get(1)):
            return cls()

        def features(b: pa.RecordBatch) -> pa.RecordBatch:
            cells = [x for ch in vec.chunks(b.column(2)) for x in _sparse(ch.c, ch.offs)]
            cols = [pa.array([x[k].tobytes() for x in cells], pa.binary()) for k in (0, 1)]
            return pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], names=["doc_id", "label", "col", "val"])

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if (found := _learned(pa.Table.from_batches(batches, FEATURES), counts)) is not None:
                w, *rest = found
                yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), *(pa.array([x], pa.float64()) for x in rest)], names=["w", "b", "slope", "shift"])
            tidy()

        rows = arrow_map(sample, features, "doc_id long, label int, col binary, val binary").repartition(1)
        for r in rows.mapInArrow(learn, "w binary, b double, slope double, shift double").collect():
            return cls(np.frombuffer(r.w, np.float32), r.b, r.slope, r.shift)
        return cls()

    def score(self, column) -> dict[str, np.ndarray]:
        """The base counts, base_failed, the probability of quality 1, and kept, for each text."""
        parts = []
        for ch in vec.chunks(column):
            x = base_counts(ch.c, ch.offs)
            h, doc = x.pop("_h"), x.pop("_doc")
            x["base_failed"] = base_failed(x["n_words"], x["n_repeat_words"])
            if self.w is None:
                x["probability"] = np.ones(ch.hi - ch.lo)
            else:
                z = np.full(ch.hi - ch.lo, self.b)
                for col, lo, hi in _grams(ch.c, ch.offs, h, doc):
                    z += SCALE * vec.spans(self.w[col], lo, hi) / np.maximum(1, hi - lo)
                x["probability"] = sigmoid(self.slope * z + self.shift)
            x["kept"] = ~x["base_failed"] & (x["probability"] >= REJECT_BELOW)
            parts.append(x)
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "probability", "kept")
        return {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in names}

    def transform(self, documents: DataFrame) -> DataFrame:
        """One row for each document: its id, the counts, base_failed, kept and the probability."""

        def each(b: pa.RecordBatch) -> pa.RecordBatch:
            s = self.score(b.column(1))
            longs = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
            return pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(s[k].astype(np.int64)) for k in longs), *(pa.array(s[k].astype(bool)) for k in ("base_failed", "kept")), pa.array(s["probability"].astype(float))],
                names=["doc_id", *longs, "base_failed", "kept", "probability"],
            )

        schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double"
        return arrow_map(documents.select("doc_id", "text"), each, schema)

    def filter(self, documents: DataFrame) -> DataFrame:
        """The kept documents, with all their columns."""
        return arrow_filter(documents, "text", lambda texts: pa.array(self.score(texts)["kept"].astype(bool)))
