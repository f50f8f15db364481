import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.llm import jaccard_join as J
from quillmark.llm.common import table
from quillmark.llm.components import components


def sets(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(texts):
    s = [sets(t) for t in texts]
    near = [[j for j in range(len(s)) if j != i and s[i] and s[j] and 5 * len(s[i] & s[j]) >= 4 * len(s[i] | s[j])] for i in range(len(s))]
    root = list(range(len(s)))
    for _ in range(len(s)):
        new = [min([root[i], *(root[j] for j in near[i])]) for i in range(len(s))]
        if new == root:
            break
        root = new
    return [(root[i], len(near[i])) for i in range(len(s))]


@pytest.fixture(scope="module")
def copies(words):
    """Clusters of near copies of graded similarity, exact copies and loners."""
    rng, texts = random.Random(1), []
    for k in range(25):
        base = words(rng.randint(60, 300), k)
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 8)):
            t = base[:]
            for _ in range(rng.choice((0, 1, 2, 4))):
                t[rng.randrange(len(t))] = f"new{rng.randrange(10**6)}"
            texts.append(" ".join(t))
    rng.shuffle(texts)
    return texts


def test_links_and_classes_equal_brute_force(spark, docs_of, copies):
    got = {r.doc_id: (r.class_id, r.n_links) for r in J.join(docs_of(copies)).collect()}
    want = brute(copies)
    links, found = sum(n for _, n in want), sum(got[i][1] for i in range(len(copies)))
    assert found >= 0.98 * links and all(got[i][1] <= want[i][1] for i in range(len(copies)))
    assert sum(got[i][0] == want[i][0] for i in range(len(copies))) >= 0.98 * len(copies)


def test_large_block_is_cut_and_loses_nothing(spark, docs_of, words, monkeypatch):
    """Also where every bucket counts as large: it is split, led and at last compared in parts."""
    for name, value in (("PART", 16), ("LIMIT", 5), ("PART_SKETCHES", 7), ("CORE", 2)):
        monkeypatch.setattr(J, name, value)
    base = words(400, 3)
    texts = []
    for k in range(90):
        t = base[:]
        t[k] = f"new{k}"
        t[2 * k + 120] = f"more{k}"
        texts.append(" ".join(t))
    got = {r.doc_id: (r.class_id, r.n_links) for r in J.join(docs_of(texts)).collect()}
    assert [got[i] for i in range(90)] == brute(texts)


def test_the_tables_documents(spark, small):
    docs = table(spark, small, "documents")
    rows = sorted(docs.select("doc_id", "text").collect())
    want = {r.doc_id: (rows[c].doc_id, n) for r, (c, n) in zip(rows, brute([r.text for r in rows]), strict=True)}
    got = {r.doc_id: (r.class_id, r.n_links) for r in J.join(docs).collect()}
    assert sum(n for _, n in got.values()) >= 0.98 * sum(n for _, n in want.values())
    assert sum(got[k] == v for k, v in want.items()) >= 0.98 * len(want)
    kept = J.one_of_each(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k, (c, _) in got.items() if c == k}


def test_odd_rows(spark, docs_of, odd):
    docs = docs_of([*odd, *odd, "a  b\nc"], [*range(len(odd)), *range(50, 50 + len(odd) - 1), None, 5])
    got = [(r.doc_id, r.class_id, r.n_links) for r in J.join(docs).collect()]
    assert len(got) == 2 * len(odd) + 1 and (None, None, 0) in got
    by = dict.fromkeys([1, 2, 3], 0)
    assert all((k, k, n) in got for k, n in by.items())  # texts without words
    assert (55, 5, 2) in got and (5, 5, 2) in got
    kept = J.one_of_each(docs)
    # of the two rows of id 5, whose sets are equal, one stays
    assert kept.where("doc_id = 55").count() == 0 and kept.where("doc_id = 5").count() == 1 and kept.where("doc_id is null").count() == 1
    assert J.join(docs_of([])).count() == 0 and J.one_of_each(docs_of([])).count() == 0


def test_an_id_with_two_texts_loses_only_the_copy(spark, docs_of, words):
    base, own, late = words(60, 1), words(60, 2), words(60, 3)
    near = [*base[:-1], "other"]
    texts = [" ".join(t) for t in (base, near, own, late, [*own[:-1], "changed"])]
    docs = docs_of([*texts, " "], [1, 2, 2, 3, 4, 2])
    kept = J.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([(1, texts[0]), (2, texts[2]), (3, texts[3]), (2, " ")])


def test_runs_reach_the_recall():
    """The chance of a common path, told by the recursion, is met by pairs whose tokens agree at 8 of 10 coordinates."""
    assert (1 - J.survival(J.SURE)) ** J.runs() <= 1 - J.RECALL
    rng, found = np.random.default_rng(2), []
    for run in range(400):
        a = rng.integers(0, 1 << 32, J.COORDINATES).astype(np.uint32)
        b = np.where(rng.random(J.COORDINATES) < 0.8, a, a + 1)
        row, path = J.choose_paths(np.stack([a, b]), run)
        found.append(bool(np.intersect1d(path[row == 0], path[row == 1]).size))
    assert abs(np.mean(found) - J.survival(J.START)) < 0.08


def test_a_shared_template_makes_no_large_block(spark, docs_of, words):
    """Texts that share 60 of 160 words are no candidates of one another, however many there are."""
    head, texts = words(60, 5), []
    for k in range(1200):
        texts.append(" ".join([*head, *(f"w{k}x{j}" for j in range(100))]))
    texts += [f"{t} more{k}" for k, t in enumerate(texts[:100])]
    docs = docs_of(texts)
    table = J.digest_table(docs)
    edges = J.candidate_edges(table.select(F.col("d1").alias("v"), "sketch", "mini").dropDuplicates(["v"]), J.runs())
    sizes = [r[0] for r in components(edges).groupBy("root").count().select("count").collect()]
    assert len(sizes) >= 95 and max(sizes) <= 12
    got = {r.doc_id: (r.class_id, r.n_links) for r in J.join(docs).collect()}
    assert sum(got[1200 + k] == (k, 1) and got[k] == (k, 1) for k in range(100)) >= 99 and all(got[k] == (k, 0) for k in range(100, 1200))


def test_groups_that_cross_batches():
    import pyarrow as pa

    key = [1, 1, 1, 2, 3, 3, 4, 4, 4, 4, 5]
    rows = pa.table({"k": pa.array(key, pa.int64()), "x": list(range(11))})
    for size in (1, 2, 3, 5, 11):
        got = []
        list(J.by_group(["k"], lambda b: got.append(b.column("x").to_pylist()))(iter(rows.to_batches(max_chunksize=size))))
        assert got == [[0, 1, 2], [4, 5], [6, 7, 8, 9]]


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1100)]
    got = {r.v: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {v: v for e in edges for v in e}
    for _ in range(400):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {v: r for v, r in root.items() if any(v in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
