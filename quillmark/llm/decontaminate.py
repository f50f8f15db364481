"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are lower-cased and their white space is collapsed. An item of m characters has an error budget of
k = m * EDIT_PERCENT // 100 edits and is cut into k + 1 pieces: an occurrence with k edits or fewer holds one piece
unchanged. An Aho-Corasick automaton finds the pieces of all items in one pass over a whole text; around each hit Myers'
bit-parallel algorithm looks for an occurrence within the budget. Items of fewer than SHORT characters have no budget and
must stand between word bounds.

The items are the query set: at most BLOCK_CHARS of them are shipped to the tasks at once, and more are searched in blocks,
one pass over the documents each. The driver holds one block at a time: the result of each is written before the next one is
read.

Cases: null, empty or blank items and texts match nothing. Items with equal texts each give their own rows; an item id with
several texts is matched by any of them. Repeated documents each get their own rows. A null doc_id or item_id is passed through.
Extra columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import arrow_filter, cut, tidy

EDIT_PERCENT = 6
SHORT = 24
#: Characters of items that a task holds at once; its automaton takes about 60 bytes for each, so 240 MB.
BLOCK_CHARS = 4_000_000

Item = tuple[int | None, str]


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def myers(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """The least distance of pattern to any part of text, and where the first such part ends; None if above most."""
    m = len(pattern)
    mask, top, eq = (1 << m) - 1, 1 << (m - 1), {}
    for i, ch in enumerate(pattern):
        eq[ch] = eq.get(ch, 0) | 1 << i
    plus, minus, score, best = mask, 0, m, (m, 0)
    for j, ch in enumerate(text):
        e = eq.get(ch, 0)
        v = e | minus
        h = (((e & plus) + plus) ^ plus) | e
        up, down = minus | ~(h | plus), plus & h
        if up & top:
            score += 1
        elif down & top:
            score -= 1
            if score < best[0]:
                best = (score, j + 1)
        up, down = (up << 1) & mask, (down << 1) & mask
        plus, minus = (down | ~(v | up)) & mask, up & v & mask
    return best if best[0] <= most else None


class Matcher:
    """The pieces of some items, and the search of one text."""

    def __init__(self, items: tuple[Item, ...]):
        self.items = [(i, t) for i, x in items if (t := normal(x))]
        self.automaton = ahocorasick.Automaton()
        pieces: dict[str, list[tuple[int, int]]] = {}
        for n, (_, t) in enumerate(self.items):
            k = self.budget(t)
            bounds = [len(t) * j // (k + 1) for j in range(k + 2)]
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                pieces.setdefault(t[a:b], []).append((n, a))
        for p, at in pieces.items():
            self.automaton.add_word(p, (len(p), tuple(at)))
        if pieces:
            self.automaton.make_automaton()

    @staticmethod
    def budget(text: str) -> int:
        return 0 if len(text) < SHORT else len(text) * EDIT_PERCENT // 100

    def search(self, raw: str | None, first_only: bool = False) -> list[tuple[int | None, int, int]]:
        """(item id, distance, end of the best occurrence in the normalised text), the best for each item that occurs."""
        text = normal(raw)
        if not text or not self.items:
            return []
        found: dict[int, tuple[int, int]] = {}
        tried: set[tuple[int, int]] = set()
        for end, (size, places) in self.automaton.iter(text):
            for n, offset in places:
                item, at = self.items[n][1], end + 1 - size - offset
                k = self.budget(item)
                if n in found and found[n][0] == 0:
                    continue
                if k == 0:
                    if text[max(0, at) : at + len(item)] == item and at >= 0 and (len(item) >= SHORT or self._bounded(text, at, at + len(item))):
                        found[n] = (0, at + len(item))
                elif text.startswith(item, at) if at >= 0 else False:
                    found[n] = (0, at + len(item))
                else:
                    group = at // (k + 1)  # alignments [first, first + k] share one searched part
                    if (n, group) in tried:
                        continue
                    tried.add((n, group))
                    first = group * (k + 1)
                    lo = max(0, first - k)
                    if got := myers(item, text[lo : max(0, first + len(item) + 2 * k)], k):
                        if n not in found or got[0] < found[n][0]:
                            found[n] = (got[0], lo + got[1])
                if first_only and found:
                    break
            if first_only and found:
                break
        best: dict[int | None, tuple[int, int]] = {}
        for n, (d, end) in found.items():
            i = self.items[n][0]
            if i not in best or (d, end) < best[i]:
                best[i] = (d, end)
        return [(i, d, end) for i, (d, end) in best.items()]

    @staticmethod
    def _bounded(text: str, a: int, b: int) -> bool:
        return (a == 0 or text[a - 1] == " ") and (b == len(text) or text[b] == " ")


@functools.lru_cache(1)
def _matcher(items: tuple[Item, ...]) -> Matcher:
    return Matcher(items)


def item_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> tuple[int, Iterator[tuple[Item, ...]]]:
    """The number of blocks, and the items in blocks of about block_chars characters, by a hash of the text, one at a time."""
    rows = benchmark.select("item_id", "text").where(F.col("text").isNotNull())
    total = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(1, -(-2 * total // block_chars)) if total > block_chars else 1

    def each() -> Iterator[tuple[Item, ...]]:
        for i in range(n):
            part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("text"), F.lit(n)) == i)
            yield tuple(sorted(((r.item_id, r.text) for r in part.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1])))

    return n, each()


def matches(documents: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, distance, end): one row for each document and each item that occurs in it."""
    n, found = item_blocks(benchmark, block_chars)
    parts = []
    for items in found:

        def each(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            m = _matcher(items)
            for b in batches:
                rows = [(d, *hit) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for hit in m.search(t)]
                cols = list(zip(*rows, strict=True)) if rows else [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], names=["doc_id", "item_id", "distance", "end"])
            tidy()

        part = documents.select("doc_id", "text").mapInArrow(each, "doc_id long, item_id long, distance int, end long")
        parts.append(part if n == 1 else cut(part, "matches"))
    return functools.reduce(DataFrame.unionByName, parts)


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents in which no item occurs, with all their columns."""
    n, found = item_blocks(benchmark, block_chars)
    for items in found:

        def keep(texts: pa.Array, items=items) -> pa.Array:
            m = _matcher(items)
            return pa.array([not m.search(t, True) for t in texts.to_pylist()], pa.bool_())

        left = arrow_filter(documents, "text", keep)
        documents = left if n == 1 else cut(left, "clean")
    return documents
