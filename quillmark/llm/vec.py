"""Vectorised text primitives: an Arrow text column becomes flat NumPy code-point arrays, with no per-document Python loop.

Null texts count as empty ones. A chunk holds whole documents; a document longer than the chunk size is a chunk of its own.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK, ROWS = 1_000_000, 1000
U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)


class Chunk(NamedTuple):
    """Rows [lo, hi) of a batch: code points of all texts after each other, and where each text starts and ends."""

    lo: int
    hi: int
    c: np.ndarray
    offs: np.ndarray


def _ranges(lengths: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    lo, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if total and total + n > size:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(lengths):
        yield lo, len(lengths)


def byte_chunks(column, size: int = CHUNK) -> Iterator[Chunk]:
    """The same with UTF-8 bytes instead of code points. ROWS rows are converted at a time, so no copy of the column is made."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    for first in range(0, len(column), ROWS):
        part = pc.fill_null(column.slice(first, ROWS).cast(pa.large_string()), "")
        n = len(part)
        _, offsets, data = part.buffers()
        offs = np.frombuffer(offsets, np.int64, n + 1, part.offset * 8)
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        for lo, hi in _ranges(np.diff(offs), size):
            yield Chunk(first + lo, first + hi, raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])


def chunks(column, size: int = CHUNK) -> Iterator[Chunk]:
    for lo, hi, raw, offs in byte_chunks(column, size):
        data = raw.tobytes()
        try:
            c = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
            heads = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
            yield Chunk(lo, hi, c, heads[offs])
        except UnicodeError:  # invalid UTF-8: each bad sequence becomes U+FFFD
            texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(offs[:-1], offs[1:], strict=True)]
            c = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
            yield Chunk(lo, hi, c, np.concatenate([[0], np.cumsum([len(t) for t in texts])]))


def strings(column) -> list[str]:
    return [x or "" for x in column.to_pylist()]


@functools.cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: its lower case (where that is one code point), whether it is a letter, whether a letter or digit."""
    chars = [chr(i) for i in range(0x110000)]
    lower = np.arange(0x110000, dtype=np.uint32)
    for i, ch in enumerate(chars[:0x20000]):
        if len(x := ch.lower()) == 1:
            lower[i] = ord(x)
    letter = np.fromiter((ch.isalpha() for ch in chars), bool, 0x110000)
    return lower, letter, letter | np.fromiter((ch.isdigit() for ch in chars), bool, 0x110000)


def white(c: np.ndarray) -> np.ndarray:
    return (c == 0x20) | ((c >= 0x09) & (c <= 0x0D))


def runs(mask: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document numbers of the runs of True that don't cross a document's bound."""
    n = len(mask)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    before = np.empty(n, bool)
    before[0], before[1:] = False, mask[:-1]
    inner = offs[1:-1]
    before[inner[inner < n]] = False
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, mask[1:]
    after[inner[(inner > 0) & (inner <= n)] - 1] = False
    starts = np.flatnonzero(mask & ~before)
    return starts, np.flatnonzero(mask & ~after) + 1, np.searchsorted(offs, starts, "right") - 1


def words(c: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words are runs of anything but ASCII white space."""
    return runs(~white(c), offs)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits (splitmix64's last steps)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


@functools.lru_cache(2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        out = []
        for base in (_P, _PINV):
            x = np.full(1 << bits, base, U)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
    return out[0], out[1]


class Hasher:
    """64-bit hashes of any segments of a code-point array, from one prefix sum."""

    def __init__(self, c: np.ndarray):
        power, self.inverse = _powers(max(20, int(len(c) + 1).bit_length()))
        v = (c.astype(U) + U(1)) * U(0xD6E8FEB86659FD93)
        v ^= v >> U(29)
        v *= power[: len(c)]
        self.sums = np.concatenate([np.zeros(1, U), np.cumsum(v, dtype=U)])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + (ends - starts).astype(U))


def windows(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n successive items of one document, and each window's first item."""
    if len(h) < n:
        return np.zeros(0, U), np.zeros(0, np.int64)
    first = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :])
    x = np.zeros(len(first), U)
    for k in range(n):
        x = (x ^ h[first + k]) * U(0xC2B2AE3D27D4EB4F)
        x ^= x >> U(32)
    return mix(x), first


def per_doc(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, weights=values, minlength=n)


def spans(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Sums of values[lo:hi] for each pair of bounds (0 where hi <= lo, even where these lie behind the last value)."""
    sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    some = hi > lo
    return sums[np.where(some, hi, 0)] - sums[np.where(some, lo, 0)]
