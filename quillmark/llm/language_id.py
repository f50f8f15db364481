"""Language identification by error-correcting output codes.

Every language gets a codeword of bits, all at large distance from one another. For each bit a binary logistic classifier
over the relative frequencies of hashed character 1- to 3-grams predicts it, and loss-weighted decoding sums, for each
language, the logistic losses of its codeword's bits under the classifiers' margins, each bit weighted by its classifier's
accuracy on a fifth of the sample. The least loss wins; the score is the softmax of the negative losses, and a document
whose two best losses differ by less than AMBIGUOUS is flagged.

Cases: `und` with score 0 for a text that is null or has no letter; the one language, with score 1, if only one was
learned; `und` if none was. Documents with a null language or id, or in the held-out fold, are never learned from. Repeated rows
each get their own result; of languages with equal losses the first by name wins; extra columns are ignored; empty tables give
empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm import vec
from quillmark.llm.common import arrow_map, fold, stratified
from quillmark.llm.linear import Rows, fit, sigmoid

BITS = 15
SCALE = 10.0
AMBIGUOUS = 1.0
#: Documents that a language may give to the sample, and code points of one document's share in memory at a time.
PER_LANGUAGE = 400
CHUNK = 300_000


def codewords(n: int) -> np.ndarray:
    """n rows of +-1: all columns that split up to 4 languages differently, or the widest-apart of some random codes."""
    if n <= 4:
        cols = [c for c in range(1, 1 << (n - 1))] or [1]
        return np.array([[1 if i < n - 1 and (c >> i) & 1 else -1 for c in cols] for i in range(n)], np.int8)
    width, rng = max(15, int(np.ceil(6 * np.log2(n)))), np.random.default_rng(11)
    best, far = None, -1
    for _ in range(200):
        m = rng.choice(np.array([-1, 1], np.int8), (n, width))
        if (np.abs(m.sum(0, dtype=int)) == n).any():
            continue
        d = (width - m.astype(int) @ m.T.astype(int)) // 2 + width * np.eye(n, dtype=int)
        if d.min() > far:
            best, far = m, d.min()
    return best


def grams(c: np.ndarray, offs: np.ndarray):
    """Hashed lower-case character n-grams: their columns, and each document's first and last."""
    c = vec.tables()[0][c]
    for n in (1, 2, 3):
        m = max(0, len(c) - n + 1)
        x = np.full(m, 0x2545F491 * n & 0xFFFFFFFF, np.uint32)
        for k in range(n):
            x = (x ^ c[k : k + m]) * np.uint32(0x9E3779B1)
            x ^= x >> np.uint32(15)
        yield ((x * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)).astype(np.int32), offs[:-1], np.maximum(offs[:-1], offs[1:] - n + 1)


class OutputCodes:
    def __init__(self, languages: list[str], code=None, w=None, b=None, trust=None):
        self.languages, self.code, self.w, self.b, self.trust = languages, code, w, b, trust

    @classmethod
    def fit(cls, documents: DataFrame, per_language: int = PER_LANGUAGE) -> OutputCodes:
        """Learn from documents outside the held-out fold (crc32 of the id mod 4 = 2)."""
        rows = documents.select("doc_id", "lang", "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~fold("doc_id", 4, 2))
        sample, counts = stratified(rows, "doc_id", "lang", per_language)
        languages = sorted(counts)
        if len(languages) < 2:
            return cls(languages)

        def features(b: pa.RecordBatch) -> pa.RecordBatch:
            cells = []
            for ch in vec.chunks(b.column(2)):
                groups = list(grams(ch.c, ch.offs))
                for d in range(ch.hi - ch.lo):
                    col = np.concatenate([x[lo[d] : hi[d]] for x, lo, hi in groups])
                    val = np.concatenate([np.full(hi[d] - lo[d], SCALE / max(1, hi[d] - lo[d])) for _, lo, hi in groups])
                    u, inv = np.unique(col, return_inverse=True)
                    cells.append((u.astype(np.int32).tobytes(), np.bincount(inv, weights=val, minlength=len(u)).astype(np.float32).tobytes()))
            cols = [pa.array([x[k] for x in cells], pa.binary()) for k in (0, 1)]
            return pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], names=["doc_id", "lang", "col", "val"])

        got = sorted(arrow_map(sample, features, "doc_id long, lang string, col binary, val binary").collect())
        cols = [np.frombuffer(r.col, np.int32) for r in got]
        x = Rows(cols, [np.frombuffer(r.val, np.float32) for r in got])
        return cls.fit_rows(x, np.array([languages.index(r.lang) for r in got]), languages)

    @classmethod
    def fit_rows(cls, x: Rows, y: np.ndarray, languages: list[str]) -> OutputCodes:
        code = codewords(len(languages))
        seen = np.arange(x.n) % 5 != 0
        each = 1 / np.maximum(1, np.bincount(y, minlength=len(languages)))[y]
        w, b, trust = np.zeros((1 << BITS, code.shape[1]), np.float32), np.zeros(code.shape[1]), np.ones(code.shape[1])
        xs = x.take(seen)
        for k in range(code.shape[1]):
            bit = (code[y, k] > 0).astype(float)
            w[:, k], b[k] = fit(xs, bit[seen], each[seen], 1 << BITS, rounds=40)
            if (~seen).any():
                right = ((x.dot(w[:, k]) + b[k] > 0) == (bit > 0))[~seen]
                trust[k] = max(0.05, np.average(right, weights=each[~seen]) - 0.5) * 2
        return cls(languages, code, w, b, trust)

    def score(self, column) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether it is ambiguous, for each text."""
        names, scores, unsure = [], [], []
        for ch in vec.chunks(column, CHUNK):
            n = ch.hi - ch.lo
            letter = vec.spans(vec.tables()[1][ch.c], ch.offs[:-1], ch.offs[1:]) > 0
            if len(self.languages) < 2:
                best, p, gap = np.zeros(n, int), np.ones(n), np.full(n, np.inf)
                letter &= bool(self.languages)
            else:
                z = np.tile(self.b, (n, 1))
                for col, lo, hi in grams(ch.c, ch.offs):
                    full = hi > lo
                    if full.any():  # documents without n-grams would share a bound; between two full ones only n - 1 others lie
                        at = np.stack([lo[full], hi[full]], 1).ravel()
                        got = np.add.reduceat(self.w[np.append(col, 0)], at, axis=0, dtype=np.float32)[::2]
                        z[full] += SCALE * got / (hi - lo)[full, None]
                loss = np.logaddexp(0, -z[:, None, :] * self.code[None]) @ self.trust
                order = np.sort(loss, axis=1)
                best, gap = loss.argmin(1), order[:, 1] - order[:, 0]
                p = 1 / np.exp(order[:, :1] - loss).sum(1)
            names += [self.languages[i] if ok else "und" for i, ok in zip(best.tolist(), letter.tolist(), strict=True)]
            scores.append(np.where(letter, p, 0.0))
            unsure.append(~letter | (gap < AMBIGUOUS))
        return names, np.concatenate([np.zeros(0), *scores]), np.concatenate([np.zeros(0, bool), *unsure])

    def transform(self, documents: DataFrame) -> DataFrame:
        """(doc_id, lang_pred, score, ambiguous) for each document."""

        def each(b: pa.RecordBatch) -> pa.RecordBatch:
            names, scores, unsure = self.score(b.column(1))
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores), pa.array(unsure)], names=["doc_id", "lang_pred", "score", "ambiguous"])

        return arrow_map(documents.select("doc_id", "text"), each, "doc_id long, lang_pred string, score double, ambiguous boolean")
