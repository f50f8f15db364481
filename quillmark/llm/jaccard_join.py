"""N-gram Jaccard join by chosen paths.

A document is the set of its 5-word shingles (one shingle of all its words where it has fewer). Documents of equal sets form
one class, so copies are joined once. Each class is embedded as COORDINATES min-hash tokens, whose agreement is the Jaccard
similarity. The join splits recursively: a path is continued by the tokens that its classes hold at one or two coordinates,
sampled by a hash of the path, 1 / SIMILARITY of them on average, so that a pair of similarity 0.8 shares one child on
average. START splits are made at once. A bucket (the classes of one path) of LIMIT classes or fewer is compared by brute
force; a larger one is split again, up to DEEP splits, and what is still larger then is compared by brute force in parts,
every pair of parts, so nothing is left untested. Independent runs are repeated until a pair of similarity 0.8 is found with
probability RECALL after SURE splits (`survival`, `runs`).

Buckets are compared by their sketches, one byte of each token: classes that differ in LINK coordinates or fewer are candidates
(a pair of similarity 0.8 differs in more with a chance of 0.0005). Before a large bucket is split, its least class
is its leader, and classes within CORE + LINK coordinates of the leader are linked to it, which is their home. Two prunings
lose no pair. Classes within CORE of the leader leave the bucket: by the triangle inequality all their candidates are
within CORE + LINK, so linked to the same leader. And a bucket whose classes have one home is done, for links connect them all. So a
dense group of near copies, however large, takes one comparison each instead of splits.

Connected candidates are a block. Blocks are compared exactly, over the shingles themselves: a block of more than PART classes
or KEYS shingles is cut into parts, and each pair of parts is a task's group of its own, so a group holds about twice that at
most, and work is spread. Every pair within a block is compared once. A group returns counts of links and a star for each
connected set, never its pairs.

Cases: null or empty texts, and texts without words, are joined with nothing: class id the document's own, 0 links. Rows
with a null id are returned with null class and 0 links and joined with nothing. Rows that repeat an id count as
several documents of one class if their sets agree. Extra columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.llm import vec
from quillmark.llm.common import cut, fresh, tidy
from quillmark.llm.components import counted_components

SHINGLE = 5
SIMILARITY = 0.8
RECALL = 0.995
COORDINATES = 64
#: Splits made at once, splits after which RECALL holds, and splits at most.
START, SURE, DEEP = 3, 5, 8
#: Classes of a bucket that is compared without another split, and of a part of one that isn't split any more.
LIMIT, PART_SKETCHES = 256, 1024
#: Coordinates in which candidates may differ, and classes that leave a bucket with its leader.
LINK, CORE = 24, 6
#: Classes and shingles of a part of a block.
PART, KEYS = 256, 1 << 20
SLAB = 4096

_MULTIPLIERS = vec.mix(np.arange(1, COORDINATES + 1)) | vec.U(1)
_ADDENDS = vec.mix(np.arange(1001, COORDINATES + 1001))


def survival(depth: int, similarity: float = SIMILARITY) -> float:
    """Chance that a pair of that similarity shares a path after so many splits of one run."""
    second, p = 1 / SIMILARITY - 1, 1.0
    for _ in range(depth):
        p = (1 - second) * similarity * p + second * (1 - (1 - similarity * p) ** 2)
    return p


def runs(recall: float = RECALL, depth: int = SURE) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(depth)))


def shingles(c: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a chunk's documents, sorted by document and hash, and each document's bounds in them."""
    n = len(offs) - 1
    starts, ends, doc = vec.words(c, offs)
    h = vec.Hasher(c)(starts, ends)
    w, first = vec.windows(h, doc, SHINGLE)
    count = np.bincount(doc, minlength=n)
    of, keys = [doc[first]], [w]
    for size in range(1, SHINGLE):  # the short documents
        if (short := count == size).any():
            w, first = vec.windows(h, doc, size)
            keep = short[doc[first]]
            of.append(doc[first][keep])
            keys.append(vec.mix(w[keep] + vec.U(size)))
    of, keys = np.concatenate(of), np.concatenate(keys)
    order = np.lexsort((keys, of))
    of, keys = of[order], keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (of[1:] != of[:-1]) | (keys[1:] != keys[:-1])
    of, keys = of[new], keys[new]
    return keys, np.searchsorted(of, np.arange(n + 1))


def digests(keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each document's set."""
    sums = [np.concatenate([np.zeros(1, vec.U), np.cumsum(vec.mix(keys ^ vec.U(s)), dtype=vec.U)]) for s in (0x51ED27, 0xA2B4C6)]
    size = np.diff(at).astype(vec.U)
    return tuple(vec.mix((s[at[1:]] - s[at[:-1]]) + size).view(np.int64) for s in sums)


def sketches(keys: np.ndarray, at: np.ndarray) -> np.ndarray:
    """COORDINATES min-hashes of each non-empty document, as 32-bit numbers."""
    full = np.flatnonzero(np.diff(at))
    out = np.zeros((len(full), COORDINATES), np.uint32)
    if len(full):
        for i in range(COORDINATES):
            x = keys * _MULTIPLIERS[i]
            x += _ADDENDS[i]
            x >>= vec.U(32)
            out[:, i] = np.minimum.reduceat(x.astype(np.uint32), at[:-1][full])
    return out


def digest_table(documents: DataFrame) -> DataFrame:
    """(doc_id, size, d1, d2, sketch, mini) of each document; mini: a byte of each token."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ch in vec.chunks(b.column(1)):
                keys, at = shingles(ch.c, ch.offs)
                d1, d2 = digests(keys, at)
                size = np.diff(at)
                full = size > 0
                flat, where = sketches(keys, at), (np.cumsum(full) - 1).tolist()
                short = (flat & 0xFF).astype(np.uint8)
                cells = [pa.array([x[k].tobytes() if f else None for k, f in zip(where, full.tolist(), strict=True)], pa.binary()) for x in (flat, short)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(ch.lo, ch.hi - ch.lo), pa.array(size.astype(np.int64)), pa.array(d1), pa.array(d2), *cells], names=["doc_id", "size", "d1", "d2", "sketch", "mini"])
        tidy()

    return documents.select("doc_id", "text").mapInArrow(each, "doc_id long, size long, d1 long, d2 long, sketch binary, mini binary")


def split(row: np.ndarray, path: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The children of paths: rows and path hashes. One coordinate is sampled for each path, or two with chance 1 / SIMILARITY - 1."""
    draw = vec.mix(path ^ vec.U(0x5851F42D4C957F2D))
    one = (draw % vec.U(COORDINATES)).astype(np.int64)
    other = (one + 1 + ((draw >> vec.U(8)) % vec.U(COORDINATES - 1)).astype(np.int64)) % COORDINATES
    both = (draw >> vec.U(32)).astype(np.float64) < (1 / SIMILARITY - 1) * 2.0**32
    row, path, at = np.concatenate([row, row[both]]), np.concatenate([path, path[both]]), np.concatenate([one, other[both]])
    return row, vec.mix((path ^ vec.mix(at + 77)) * vec.U(0x9E3779B97F4A7C15) + sketch[row, at])


def choose_paths(sketch: np.ndarray, run: int, depth: int = START) -> tuple[np.ndarray, np.ndarray]:
    """Rows and path hashes after depth splits of one run."""
    row, path = np.arange(len(sketch)), np.full(len(sketch), vec.mix(np.array([run + 1]))[0])
    for _ in range(depth):
        row, path = split(row, path, sketch)
    return row, path


def _bytes(column: pa.Array, width: int, kind=np.uint8) -> np.ndarray:
    """A binary column of equal lengths as rows of numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def bucket_table(classes: DataFrame, n_runs: int) -> DataFrame:
    """(path, v): the buckets of each class after START splits of all runs."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                v, sk = part.column(0).to_numpy(zero_copy_only=False), _bytes(part.column(1), COORDINATES, np.uint32)
                for r in range(n_runs):
                    row, path = choose_paths(sk, r)
                    yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), pa.array(v[row])], names=["path", "v"])

    return classes.select("v", "sketch").mapInArrow(each, "path long, v long")


def split_again(rows: DataFrame, large: DataFrame, classes: DataFrame) -> DataFrame:
    """(path, v, home): the children of large buckets' rows, and, with a null path, links of classes to their leaders."""
    led = rows.join(large.select("path", F.col("lo").alias("lead")), "path")
    led = led.join(classes.select(F.col("v").alias("lead"), F.col("mini").alias("theirs")), "lead").join(classes.select("v", "sketch", F.col("mini").alias("mine")), "v")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            path, v, home, lead = (b.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            differ = (_bytes(b.column(5), COORDINATES) != _bytes(b.column(6), COORDINATES)).sum(1)
            linked, far = differ <= CORE + LINK, np.flatnonzero(differ > CORE)
            home = np.where(linked, lead, home)
            row, child = split(far, path[far].view(vec.U), _bytes(b.column(4), COORDINATES, np.uint32))
            near = np.flatnonzero(linked & (v != lead))
            pairs = np.unique(np.stack([v[near], lead[near]], 1), axis=0)
            cols = [pa.concat_arrays([pa.array(child.view(np.int64)), pa.nulls(len(pairs), pa.int64())]), pa.array(np.concatenate([v[row], pairs[:, 0]])), pa.array(np.concatenate([home[row], pairs[:, 1]]))]
            yield pa.RecordBatch.from_arrays(cols, names=["path", "v", "home"])

    return led.select("path", "v", "home", "lead", "sketch", "mine", "theirs").mapInArrow(each, "path long, v long, home long")


def stars(near: np.ndarray) -> np.ndarray:
    """For each row of a symmetric relation, the first row that is connected to it."""
    root = np.full(len(near), -1)
    for i in range(len(near)):
        if root[i] < 0:
            new = np.zeros(len(near), bool)
            new[i] = True
            while new.any():
                root[new] = i
                new = near[new].any(0) & (root < 0)
    return root


def by_group(keys: list[str], flush: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> Callable:
    """For mapInArrow over rows sorted by keys: flush gets the rows of each group of two or more."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def whole() -> Iterator[pa.RecordBatch]:
            if sum(h.num_rows for h in held) > 1:
                got = flush(held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                if got is not None and got.num_rows:
                    yield got
            held.clear()

        last = None
        for b in batches:
            if not b.num_rows:
                continue
            k = np.stack([b.column(n).to_numpy(zero_copy_only=False) for n in keys], 1)
            starts = np.flatnonzero(np.concatenate([[last is None or (k[0] != last).any()], (k[1:] != k[:-1]).any(1)])).tolist()
            last = k[-1]
            for lo, hi in zip([0, *starts], [*starts, b.num_rows], strict=True):
                if hi > lo:
                    if lo or starts[:1] == [0]:
                        yield from whole()
                    held.append(b.slice(lo, hi - lo))
        yield from whole()
        tidy()

    return each


def in_parts(rows: DataFrame, key: str, parts: Column, keep: list[str]) -> DataFrame:
    """rows dealt into groups (key, lo, hi): every pair of the parts of a key, each part with itself too; sorted by group."""
    dealt = rows.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("v"), F.col("parts")))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda p: F.struct(F.least(p, F.col("part")).alias("lo"), F.greatest(p, F.col("part")).alias("hi")))
    dealt = dealt.select(key, "part", *keep, F.explode(pairs).alias("pair")).select(key, "pair.lo", "pair.hi", "part", *keep)
    n = max(16, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return dealt.repartition(n, key, "lo", "hi").sortWithinPartitions(key, "lo", "hi", "v")


def _links(b: pa.RecordBatch) -> pa.RecordBatch | None:
    """The candidates of a group of sketches, as stars."""
    v, part, x = b.column("v").to_numpy(), b.column("part").to_numpy(), _bytes(b.column("mini"), COORDINATES)
    near = np.empty((len(v), len(v)), bool)
    for lo in range(0, len(v), 64):
        near[lo : lo + 64] = (x[lo : lo + 64, None] != x[None]).sum(2, dtype=np.uint8) <= LINK
    if b.column("lo")[0] != b.column("hi")[0]:
        near &= part[:, None] != part[None]
    root = stars(near)
    hit = np.flatnonzero(root != np.arange(len(v)))
    return pa.RecordBatch.from_arrays([pa.array(v[hit]), pa.array(v[root[hit]])], names=["a", "b"])


def candidate_edges(classes: DataFrame, n_runs: int) -> DataFrame:
    """(a, b): links that connect all classes which are candidates in a common bucket."""
    rows = cut(bucket_table(classes, n_runs), "buckets").withColumn("home", F.col("v"))
    members, found, some, left = [], [], None, None
    for depth in range(START, DEEP + 1):
        of = rows.groupBy("path").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("v")).alias("mark"), F.min("home").alias("one"), F.max("home").alias("other"))
        size = cut(of.where("lo < hi AND one <> other").drop("one", "other"), "sizes", left)
        done = size if depth == DEEP else size.where(F.col("n") <= LIMIT)
        # runs meet the same bucket again and again: one of them is compared
        kept = done.groupBy("lo", "hi", "n", "mark").agg(F.min("path").alias("path"))
        pairs = kept.where("n = 2").select("path", "n", F.explode(F.array("lo", "hi")).alias("v"))
        members.append(pairs.unionByName(rows.join(kept.where("n > 2").select("path", "n"), "path").select("path", "n", "v")))
        large = size.where(F.col("n") > LIMIT)
        if depth == DEEP or not (left := large.agg(F.sum("n")).first()[0]):
            break
        if some is None:  # no other class is split at any later depth
            split_ = rows.join(large.select("path"), "path").select("v").distinct()
            some = cut(classes.select("v", "sketch", "mini").join(split_, "v", "left_semi"), "some", 16 * left)
        both = cut(split_again(rows, large, some), "splits", 16 * left)  # each row costs more than one that is only written
        found.append(both.where("path is null").select(F.col("v").alias("a"), F.col("home").alias("b")))
        rows = both.where("path is not null")
    all_members = members[0]
    for m in members[1:]:
        all_members = all_members.unionByName(m)
    held = all_members.join(classes.select("v", "mini"), "v")
    out = in_parts(held, "path", F.ceil(F.col("n") / F.lit(PART_SKETCHES)), ["v", "mini"]).mapInArrow(by_group(["path", "lo", "hi"], _links), "a long, b long")
    for f in found:
        out = out.unionByName(f)
    return out


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of incidence matrices over the shared shingles, SLAB at a time."""
    m = len(sets)
    of = np.repeat(np.arange(m), [len(s) for s in sets])
    keys, inv, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[inv] > 1
    col = (np.cumsum(count > 1) - 1)[inv[shared]]
    of, total, n = of[shared], np.zeros((m, m), np.float32), int((count > 1).sum())
    order = np.argsort(col, kind="stable")
    col, of = col[order], of[order]
    for lo in range(0, n, SLAB):
        i, j = np.searchsorted(col, (lo, lo + SLAB))
        a = np.zeros((m, min(SLAB, n - lo)), np.float32)
        a[of[i:j], col[i:j] - lo] = 1
        total += a @ a.T
    return total


def links_of(docs: np.ndarray, part: np.ndarray, sets: list[np.ndarray], across: bool) -> tuple[np.ndarray, np.ndarray]:
    """By class: the number of documents of other classes that link to it, and the first class connected to it.

    In a group of two parts only pairs across them count.
    """
    size, both = np.array([len(s) for s in sets], float), _overlaps(sets)
    near = np.empty(both.shape, bool)
    for lo in range(0, len(sets), 256):
        x = both[lo : lo + 256].astype(float)
        near[lo : lo + 256] = x >= SIMILARITY * (size[lo : lo + 256, None] + size[None, :] - x) - 1e-9
    np.fill_diagonal(near, False)
    if across:
        near &= part[:, None] != part[None, :]
    return np.array([int(docs[r].sum()) for r in near]), stars(near)


def _compared(b: pa.RecordBatch) -> pa.RecordBatch | None:
    _, first = np.unique(b.column("v").to_numpy(), return_index=True)  # a repeated id gives a class's text twice
    b = b.take(pa.array(first))
    v, docs, part = (b.column(n).to_numpy() for n in ("v", "docs", "part"))
    links, root = links_of(docs, part, [np.frombuffer(x.as_buffer(), vec.U) for x in b.column("keys")], b.column("lo")[0] != b.column("hi")[0])
    hit, arm = np.flatnonzero(links), np.flatnonzero(root != np.arange(len(v)))
    cols = [np.concatenate([v[hit], v[arm]]), np.concatenate([links[hit], np.zeros(len(arm), np.int64)])]
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.concat_arrays([pa.nulls(len(hit), pa.int64()), pa.array(v[root[arm]], pa.int64())])], names=["v", "links", "other"])


def compare_blocks(documents: DataFrame, members: DataFrame) -> DataFrame:
    """members (v, d2, rep, docs, block, parts): classes with the document that stands for each. Returns rows
    (v, links, other): counts of linked documents, and stars of connected classes (other not null)."""
    texts = documents.select(F.col("doc_id").alias("rep"), "text").join(members.hint("shuffle_hash"), "rep")
    names = ["v", "docs", "block", "parts"]

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ch in vec.chunks(b.column("text")):
                keys, at = shingles(ch.c, ch.offs)
                d1, d2 = digests(keys, at)
                part = b.slice(ch.lo, ch.hi - ch.lo)
                mine = pa.array((d1 == part.column("v").to_numpy()) & (d2 == part.column("d2").to_numpy()))  # of a repeated id, the text of this class
                keyed = pa.array([keys[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), keyed], names=[*names, "keys"]).filter(mine)
        tidy()

    got = texts.select("text", *names, "d2").mapInArrow(sets, "v long, docs long, block long, parts long, keys binary")
    return in_parts(got, "block", F.col("parts"), ["v", "docs", "keys"]).mapInArrow(by_group(["block", "lo", "hi"], _compared), "v long, links long, other long")


def join(documents: DataFrame, recall: float = RECALL) -> DataFrame:
    """(doc_id, class_id, copy_of, n_links) of each document.

    class_id: the least id among the documents connected to it by links of similarity 0.8 or more (copies included);
    copy_of: the least id with the very same shingle set; n_links: the number of other documents of similarity 0.8 or more.
    """
    return _joined(documents, recall).drop("d1", "d2", "size")


def _joined(documents: DataFrame, recall: float) -> DataFrame:
    """The join's rows with their sets' digests and sizes. Joins read written tables, so that hot groups may be split."""
    table = cut(digest_table(documents), "digests")
    able = table.where(F.col("doc_id").isNotNull() & (F.col("size") > 0))
    classes = cut(able.groupBy(F.col("d1").alias("v"), "d2", "size").agg(F.min("doc_id").alias("rep"), F.count("*").alias("docs"), F.first("sketch").alias("sketch"), F.first("mini").alias("mini")), "classes")
    blocks, n = counted_components(candidate_edges(classes, runs(recall)))
    blocked = cut(classes.select("v", "d2", "size", "rep", "docs").join(blocks.select("v", F.col("root").alias("block")), "v"), "blocks", n)
    parts = F.greatest(F.ceil(F.count("*") / F.lit(PART)), F.ceil(F.sum("size") / F.lit(KEYS)))
    parts = cut(blocked.groupBy("block").agg(parts.cast("long").alias("parts")), "parts", n)
    compared = cut(compare_blocks(documents, blocked.join(parts, "block")), "links")
    n_links = compared.where("other is null").groupBy("v").agg(F.sum("links").alias("links"))
    rep = classes.select("v", "d2", "size", "rep", "docs")
    linked, n = counted_components(compared.where("other is not null").select(F.col("v").alias("a"), F.col("other").alias("b")))
    joined = cut(linked.join(rep.select("v", "rep"), "v"), "joined", n)
    least = cut(joined.groupBy("root").agg(F.min("rep").alias("class_id")), "ids", n)
    known = rep.join(joined.join(least, "root").select("v", "class_id"), "v", "left").join(n_links, "v", "left")
    known = known.select(F.col("v").alias("d1"), "d2", "size", F.col("rep").alias("copy_of"), F.coalesce("class_id", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("docs") - 1).alias("n_links"))
    mine = table.select("doc_id", "d1", "d2", "size")
    hit = mine.where(F.col("doc_id").isNotNull() & (F.col("size") > 0)).join(cut(known, "known"), ["d1", "d2", "size"])
    alone = mine.where(F.col("doc_id").isNull() | (F.col("size") == 0)).select("doc_id", "d1", "d2", "size", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_of"), F.lit(0).cast("long").alias("n_links"))
    return hit.select("doc_id", "d1", "d2", "size", "class_id", "copy_of", "n_links").unionByName(alone)


def one_of_each(documents: DataFrame, recall: float = RECALL) -> DataFrame:
    """The documents that are the least of their class, and those joined with nothing, with all their columns.

    Of rows that repeat a kept id with an equal set one stays. Of an id with several sets each is kept or dropped by its own
    class. Rows without words or without an id all stay.
    """
    mark, d1, d2, size = (fresh(documents, f"__{n}") for n in ("out", "d1", "d2", "size"))
    rows = cut(_joined(documents, recall).where("doc_id is not null").withColumn("gone", F.col("class_id") != F.col("doc_id")), "joined")
    ids = cut(rows.groupBy(F.col("doc_id").alias(mark)).agg(F.every("gone").alias("whole"), (F.some("gone") | (F.count("*") > 1)).alias("some")).where("some").select(mark, "whole"), "gone")
    kept = documents.join(ids.select(mark).hint("shuffle_hash"), documents["doc_id"] == ids[mark], "left_anti")
    partly = ids.where("not whole").select(mark)
    if partly.isEmpty():
        return kept

    at = documents.columns.index("text")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ch in vec.chunks(b.column(at)):
                part = b.slice(ch.lo, ch.hi - ch.lo)
                keys, bounds = shingles(ch.c, ch.offs)
                found = [*digests(keys, bounds), np.diff(bounds).astype(np.int64)]
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(d) for d in found)], names=[*part.schema.names, d1, d2, size])

    several = documents.join(partly.hint("shuffle_hash"), documents["doc_id"] == partly[mark], "left_semi")
    schema = T.StructType([*documents.schema.fields, *(T.StructField(n, T.LongType()) for n in (d1, d2, size))])
    several = several.mapInArrow(digest, schema)
    gone = rows.where("gone").select(F.col("doc_id").alias(mark), F.col("d1").alias("e1"), F.col("d2").alias("e2")).distinct()
    stay = several.where(F.col(size) > 0).join(gone, (several["doc_id"] == gone[mark]) & (several[d1] == gone["e1"]) & (several[d2] == gone["e2"]), "left_anti")
    stay = stay.dropDuplicates(["doc_id", d1, d2]).unionByName(several.where(F.col(size) == 0))
    return kept.unionByName(stay.drop(d1, d2, size))
