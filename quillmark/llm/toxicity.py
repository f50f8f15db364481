"""Toxicity: a factorization machine over hashed terms.

Terms are a text's lower-cased runs of letters and digits and those runs' 4- and 5-letter beginnings, as 64-bit hashes.
The labelled sample screens them: a term stays if it occurs in MIN_DOCS sampled documents and its share among toxic
documents differs from that among others by MIN_Z standard errors, or if it is one of a pair whose occurrence together
(the covariance within a class) differs between the classes by PAIR_Z standard errors, however frequent each is by itself.
All pairs of terms of PAIR_DOCS sampled documents are compared: a term of few documents reaches a z of about their root, so
the bound is beyond rarer ones unless the sample itself has fewer than a hundred documents or so. A document is the set of its terms that stay, and its score is  b + sum w_i + sum_{i<j} <v_i, v_j>:  the factors learn pairs (an insult beside a mention of a group) that
additive weights miss. Platt's calibration on a fifth of the sample gives the probability of toxic = 1.

Cases: a null or empty text scores as one without terms. Repeated rows each get their own result. Without labels of both
classes the score is the one class's share (0 if there is none). Null labels are ignored, extra columns too; empty tables
give empty results. A null doc_id is not held out, and never learned from. A score of exactly THRESHOLD is predicted 1.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillmark.llm import vec
from quillmark.llm.common import PER_CLASS, arrow_map, fold, labelled
from quillmark.llm.linear import Adam, class_weights, platt, sigmoid

FACTORS = 8
MIN_DOCS = 6
MIN_Z = 4.0
#: Millions of pairs are compared, so their bound is higher: about one pair in 500 million passes it by chance.
PAIR_Z = 6.0
PAIR_DOCS = 18
#: Terms whose pairs are compared at once.
BLOCK = 1024
THRESHOLD = 0.3
FILTER_BITS = 22


def terms(c: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms of a chunk, with their documents' numbers."""
    lower, _, word = vec.tables()
    starts, ends, doc = vec.runs(word[c], offs)
    hasher, hs, ds = vec.Hasher(lower[c]), [], []
    for size in (0, 4, 5):
        long = ends - starts > size
        s = starts[long]
        hs.append(hasher(s, s + size if size else ends[long]) ^ vec.U(size))
        ds.append(doc[long])
    return np.concatenate(hs), np.concatenate(ds)


def paired(row: np.ndarray, col: np.ndarray, k: int, y: np.ndarray) -> np.ndarray:
    """Which of k terms belong to a pair that occurs together more, or less, in one class. row, col: documents and terms of
    the cells, by col."""
    classes = [np.flatnonzero(y == c) for c in (0, 1)]
    order, sizes = np.concatenate(classes), [len(c) for c in classes]
    place = np.empty(len(y), np.int64)
    place[order] = np.arange(len(y))
    at = np.searchsorted(col, np.arange(0, k + BLOCK, BLOCK))

    def dense(b: int) -> list[np.ndarray]:
        lo, hi = at[b], at[b + 1]
        x = np.zeros((min(BLOCK, k - b * BLOCK), len(y)), np.float32)
        x[col[lo:hi] - b * BLOCK, place[row[lo:hi]]] = 1
        return [x[:, : sizes[0]], x[:, sizes[0] :]]

    out = np.zeros(k, bool)
    blocks = range(-(-k // BLOCK))
    for i in blocks:
        left = dense(i)
        for j in blocks[i:]:
            right = left if j == i else dense(j)
            apart, variance = 0.0, np.float32(1e-12)
            for sign, a, b, n in zip((-1, 1), left, right, sizes, strict=True):
                pa, pb, both = a.mean(1)[:, None], b.mean(1)[None], a @ b.T / np.float32(n)
                spread = both * ((1 - 2 * pa) * (1 - 2 * pb)) + pb**2 * (pa * (1 - 2 * pa)) + pa**2 * (pb * (1 - 2 * pb)) + pa**2 * pb**2
                cov = both - pa * pb
                apart, variance = apart + sign * cov, variance + np.maximum(spread - cov**2, pa * (1 - pa) * (pb * (1 - pb))) / n
            hit = np.abs(apart) >= PAIR_Z * np.sqrt(variance)
            if j == i:
                np.fill_diagonal(hit, False)
            out[i * BLOCK : i * BLOCK + len(hit)] |= hit.any(1)
            out[j * BLOCK : j * BLOCK + hit.shape[1]] |= hit.any(0)
    return out


class FactorizationMachine:
    """keys: the sorted hashes of the screened terms; w and v: their weights and factors."""

    def __init__(self, keys=None, w=None, v=None, b: float = 0.0, slope: float = 1.0, shift: float = 0.0, constant: float | None = None):
        self.keys, self.w, self.v, self.b, self.slope, self.shift, self.constant = keys, w, v, b, slope, shift, constant
        self._filter = None

    def _bitmap(self) -> np.ndarray:
        if self._filter is None:
            self._filter = np.zeros(1 << FILTER_BITS, bool)
            self._filter[self.keys >> vec.U(64 - FILTER_BITS)] = True
        return self._filter

    def _cells(self, h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct (document, screened term) pairs."""
        near = self._bitmap()[h >> vec.U(64 - FILTER_BITS)]
        h, doc = h[near], doc[near]
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        hit = self.keys[at] == h
        cell = np.unique(doc[hit].astype(np.int64) * len(self.keys) + at[hit])
        return cell // len(self.keys), cell % len(self.keys)

    def _raw(self, row: np.ndarray, col: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        z = self.b + np.bincount(row, weights=self.w[col], minlength=n)
        sums = np.stack([np.bincount(row, weights=self.v[col, f], minlength=n) for f in range(self.v.shape[1])], 1)
        squares = np.bincount(row, weights=(self.v**2).sum(1)[col], minlength=n)
        return z + 0.5 * ((sums**2).sum(1) - squares), sums

    @classmethod
    def fit_rows(cls, docs: list[np.ndarray], y: np.ndarray, counts: dict, rounds: int = 150) -> FactorizationMachine:
        """docs: each sampled document's distinct term hashes."""
        total = max(1, counts.get(0, 0) + counts.get(1, 0))
        if len(set(y.tolist())) < 2:
            return cls(constant=counts.get(1, 0) / total)
        seen = np.arange(len(docs)) % 5 != 0
        h = np.concatenate([d for d, s in zip(docs, seen, strict=True) if s])
        toxic = np.repeat(y[seen], [len(d) for d, s in zip(docs, seen, strict=True) if s])
        keys, inv = np.unique(h, return_inverse=True)
        n1, n0 = max(1.0, y[seen].sum()), max(1.0, (1 - y[seen]).sum())
        a, c = np.bincount(inv, weights=toxic), np.bincount(inv, weights=1 - toxic)
        p = (a + c) / (n1 + n0)
        z = (a / n1 - c / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / n1 + 1 / n0))
        stay, often = (a + c >= MIN_DOCS) & (np.abs(z) >= MIN_Z), np.flatnonzero(a + c >= PAIR_DOCS)
        if len(often):
            number = np.full(len(keys), -1, np.int32)
            number[often] = np.arange(len(often))
            row = np.repeat(np.arange(int(seen.sum()), dtype=np.int32), [len(d) for d, s in zip(docs, seen, strict=True) if s])
            col = number[inv]
            row, col = row[col >= 0], col[col >= 0]
            order = np.argsort(col, kind="stable")
            stay[often] |= paired(row[order], col[order], len(often), y[seen])
        keys = keys[stay]
        if len(keys) == 0:
            return cls(constant=counts.get(1, 0) / total)
        k = len(keys)
        rng = np.random.default_rng(7)
        m = cls(keys, np.zeros(k), rng.normal(0, 0.05, (k, FACTORS)))
        row, col = m._cells(np.concatenate(docs), np.repeat(np.arange(len(docs)), [len(d) for d in docs]))
        fit_on, adam, b = seen[row], Adam(0.05), np.zeros(1)
        r, cc, weight = row[fit_on], col[fit_on], np.where(seen, class_weights(y), 0)
        weight = weight / weight.sum()
        for _ in range(rounds):
            m.b = float(b[0])
            raw, sums = m._raw(r, cc, len(docs))
            g = weight * (sigmoid(raw) - y)
            gv = np.stack([np.bincount(cc, weights=g[r] * (sums[r, f] - m.v[cc, f]), minlength=k) for f in range(FACTORS)], 1)
            adam.step(w=(m.w, np.bincount(cc, weights=g[r], minlength=k) + 1e-4 * m.w), v=(m.v, gv + 1e-4 * m.v), b=(b, np.array([g.sum()])))
        m.b = float(b[0])
        raw, _ = m._raw(row, col, len(docs))
        m.slope, m.shift = platt(np.clip(raw[~seen], -12, 12), y[~seen], class_weights(y[~seen], counts))
        return m

    @classmethod
    def fit(cls, documents: DataFrame, labels: DataFrame, per_class: int = 2 * PER_CLASS) -> FactorizationMachine:
        """Learn from labels outside the held-out fold (crc32 of the id mod 4 = 2)."""
        sample, counts = labelled(documents, labels, "toxic", fold("doc_id", 4, 2), per_class)
        if not counts:
            return cls(constant=0.0)

        def features(b: pa.RecordBatch) -> pa.RecordBatch:
            cells = []
            for ch in vec.chunks(b.column(2)):
                h, doc = terms(ch.c, ch.offs)
                order = np.argsort(doc, kind="stable")
                h, at = h[order], np.searchsorted(doc[order], np.arange(ch.hi - ch.lo + 1))
                cells += [np.unique(h[i:j]).tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]
            return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cells, pa.binary())], names=["doc_id", "label", "terms"])

        rows = sorted(arrow_map(sample, features, "doc_id long, label int, terms binary").collect())
        return cls.fit_rows([np.frombuffer(r.terms, vec.U) for r in rows], np.array([r.label for r in rows], float), counts)

    def score(self, column) -> np.ndarray:
        parts = [np.zeros(0)]
        for ch in vec.chunks(column):
            n = ch.hi - ch.lo
            if self.constant is not None:
                parts.append(np.full(n, self.constant))
                continue
            raw, _ = self._raw(*self._cells(*terms(ch.c, ch.offs)), n)
            parts.append(sigmoid(self.slope * np.clip(raw, -12, 12) + self.shift))
        return np.concatenate(parts)

    def transform(self, documents: DataFrame) -> DataFrame:
        """(doc_id, score) for each document."""

        def each(b: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(self.score(b.column(1)))], names=["doc_id", "score"])

        return arrow_map(documents.select("doc_id", "text"), each, "doc_id long, score double")
