"""The most similar of many names, for each of many asked ones: exact, behind upper bounds of `name_similarity` in NumPy.

No similarity is above 2 * m / (p + q) of the last parts' lengths p and q, m the length of their longest common subsequence, or,
looser, the number of characters that they have in common; but for names within names and shared words, which are bounded apart.
Names are judged by falling bound, until the k best can't change any more.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np

from quillmark.functions.similarity import SUFFIX, name_similarity, words_of

#: Bins of characters and how often one counts; asked names that are bounded at once; bits of a word; half the last digit of a score.
BINS, LEVELS, ASKED, WORD, HALF = 32, 3, 128, 64, 1e-6


def last_part(name: str) -> str:
    return re.sub(SUFFIX, "", name.lower()).rpartition("/")[2]


def _codes(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all parts after each other, and their lengths."""
    return np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32), np.array([len(p) for p in parts], np.int64)


def _counts(codes: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By part: whether each bin has 1, 2 or 3 characters, and how many are beyond these. Bins may be shared: bounds only rise."""
    small = (codes >= 97) & (codes < 123)
    of = np.where(small, codes - 97, 26 + codes % (BINS - 26)).astype(np.int64)
    n = np.bincount(np.repeat(np.arange(len(size)), size) * BINS + of, minlength=len(size) * BINS).reshape(-1, BINS)
    return np.concatenate([n > level for level in range(LEVELS)], axis=1).astype(np.float32), np.maximum(n - LEVELS, 0).sum(1)


class Names:
    """Names to be searched."""

    def __init__(self, names: list[str]):
        self.names, parts = names, [last_part(n) for n in names]
        self.codes, self.size = _codes(parts)
        self.start = np.cumsum(self.size) - self.size
        self.bits, self.more = _counts(self.codes, self.size)
        by_word, words = defaultdict(list), [words_of(p) for p in parts]
        for i, w in enumerate(words):
            for x in w:
                by_word[x].append(i)
        self.by_word = {x: np.array(at) for x, at in by_word.items()}
        self.words = np.array([len(w) for w in words])

    def bounds(self, asked: list[str]) -> np.ndarray:
        """By asked name and name: an upper bound of the similarity, from common characters, containment and words."""
        parts = [last_part(a) for a in asked]
        codes, size = _codes(parts)
        bits, more = _counts(codes, size)
        common = bits @ self.bits.T + np.minimum(more[:, None], self.more[None])
        out = self._bound(common, size[:, None], self.size[None])
        for row, part in zip(out, parts, strict=True):
            mine = words_of(part)
            if found := [self.by_word[w] for w in mine if w in self.by_word]:
                at, n = np.unique(np.concatenate(found), return_counts=True)
                row[at] = np.maximum(row[at], n / (len(mine) + self.words[at] - n))
        return out

    def _bound(self, common: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        short, long = np.minimum(p, q), np.maximum(1, np.maximum(p, q))
        ratio = np.where(p + q > 0, 2 * common / np.maximum(1, p + q), 1.0)
        return np.where(common >= short, np.maximum(ratio, 0.5 + 0.5 * short / long), ratio)

    def closer(self, asked: str, at: np.ndarray) -> np.ndarray:
        """The bound of the names at these places by longest common subsequences, 64 characters of the asked name at a time."""
        part, size = last_part(asked), self.size[at]
        order = np.argsort(-size, kind="stable")
        start, longest = self.start[at][order], np.sort(size)[::-1]
        common = np.zeros(len(at), np.int64)
        for lo in range(0, len(part), WORD):
            piece, _ = _codes([part[lo : lo + WORD]])
            letters, inv = np.unique(piece, return_inverse=True)
            masks = np.zeros(len(letters) + 1, np.uint64)
            np.bitwise_or.at(masks, inv, np.uint64(1) << np.arange(len(piece), dtype=np.uint64))
            v = np.full(len(at), ~np.uint64(0))
            for j in range(int(longest[0]) if len(at) else 0):
                n = int(np.searchsorted(-longest, -j, "left"))  # names with more than j characters
                c = self.codes[start[:n] + j]
                k = np.minimum(np.searchsorted(letters, c), len(letters) - 1)
                x = v[:n] & np.where(letters[k] == c, masks[k], np.uint64(0))
                v[:n] = (v[:n] + x) | (v[:n] - x)
            low = np.uint64((1 << len(piece)) - 1)
            common[order] += np.bitwise_count(~v & low).astype(np.int64)
        return self._bound(common, np.int64(len(part)), size)

    def nearest(self, asked: list[str], k: int, least: float, best: list[list[tuple[float, str]]]) -> None:
        """Bring the k best (-score, name) of each asked name, of score least or more, up to date with these names."""
        for lo in range(0, len(asked), ASKED):
            some = asked[lo : lo + ASKED]
            for a, bound, top in zip(some, self.bounds(some), best[lo : lo + ASKED], strict=True):

                def floor(top=top) -> float:
                    return max(least, -top[-1][0] if len(top) == k else least) - HALF

                def judge(places: np.ndarray, limit: np.ndarray, a=a, top=top, floor=floor) -> None:
                    for i, u in zip(places.tolist(), limit.tolist(), strict=True):
                        if u < floor():
                            break
                        if (s := round(name_similarity(a, self.names[i]), 6)) >= least:
                            top.append((-s, self.names[i]))
                            top.sort()
                            del top[k:]

                at = np.flatnonzero(bound >= floor())
                first = at[np.argpartition(-bound[at], min(2 * k, len(at) - 1))[: 2 * k]] if len(at) else at
                first = first[np.argsort(-bound[first], kind="stable")]
                judge(first, bound[first])
                at = np.setdiff1d(at[bound[at] >= floor()], first)
                # a name whose words count may be above the bound of its characters
                shared = [self.by_word[w] for w in words_of(last_part(a)) if w in self.by_word]
                close = self.closer(a, at)
                if shared:
                    wordy = np.isin(at, np.concatenate(shared))
                    close[wordy] = bound[at][wordy]
                order = np.argsort(-close, kind="stable")
                judge(at[order], close[order])
